import os

import pytest
from pyspark.sql import functions as F

from heron.cli import generate
from heron.functions.vectors import cosine, of_dimension
from heron.operators import retrieval as R
from heron.plans import prompts, providers
from heron.plans.answer import answer, retrieve
from heron.sources.knowledge_base import Store, build, scan, write_markdown
from heron.streaming.windows import ingest, tumbling
from heron.tables import table

PAGE = "---\nname: {n}\ndescription: About {n}\ntags: [a, b]\nfk_to:\n  - {{column: x_id, ref_table: teams, ref_column: id}}\n---\n\nBody of {n} REFERENCES teams (id)\n"


@pytest.fixture
def root(tmp_path):
    for n in ("games", "teams"):
        write_markdown(f"{tmp_path}/kb/ddl/{n}.md", PAGE.format(n=n))
    write_markdown(f"{tmp_path}/kb/ddl/KB.md", "---\nname: ddl\n---\nEntry.\n")
    write_markdown(f"{tmp_path}/kb/ddl/broken.md", "---\nname: never closed\n")
    write_markdown(f"{tmp_path}/kb/ddl/notes.txt", "ignored")
    return tmp_path


def test_scan(spark, root):
    rows = {r["file_path"]: r for r in scan(spark, f"{root}/kb").collect()}
    assert set(rows) == {"ddl/games.md", "ddl/teams.md", "ddl/KB.md", "ddl/broken.md"}
    g = rows["ddl/games.md"]
    assert g["section"] == "ddl" and not g["is_entry_point"] and not g["corrupt"]
    assert g["embedding_text"] == "games — About games  — ['a', 'b']"
    assert g["metadata"]["fk_to"][0]["ref_table"] == "teams" and g["content"].startswith("Body")
    assert rows["ddl/KB.md"]["is_entry_point"] and rows["ddl/KB.md"]["embedding_text"] == ""
    assert rows["ddl/broken.md"]["corrupt"]
    with pytest.raises(Exception):
        scan(spark, f"{root}/missing").count()


def test_build_is_incremental(spark, root):
    store, e = Store(spark, f"{root}/store"), providers.HashingEmbedder(8)
    assert build(spark, f"{root}/kb", store, e) == {"new": 3, "embed_changed": 0, "content_only": 0, "unchanged": 0, "skipped": 0, "total": 3}
    assert build(spark, f"{root}/kb", store, e)["unchanged"] == 3
    before = {r["file_path"]: r for r in store.read().collect()}
    write_markdown(f"{root}/kb/ddl/games.md", PAGE.format(n="games") + "more\n", True)
    write_markdown(f"{root}/kb/ddl/teams.md", PAGE.format(n="teams").replace("About", "All about"), True)
    assert {k: v for k, v in build(spark, f"{root}/kb", store, e).items() if v} == {"content_only": 1, "embed_changed": 1, "unchanged": 1, "total": 3}
    after = {r["file_path"]: r for r in store.read().collect()}
    assert after["ddl/games.md"]["embedding"] == before["ddl/games.md"]["embedding"]
    assert after["ddl/teams.md"]["embedding"] != before["ddl/teams.md"]["embedding"]
    assert after["ddl/games.md"]["created_at"] == before["ddl/games.md"]["created_at"]
    assert store.entry_point("ddl").count() == 1 and store.sub_files("ddl").count() == 2
    assert [r["name"] for r in store.named("ddl", ["games.md", "nothing.md"]).collect()] == ["games.md"]
    assert store.status("ddl").filter("has_embedding").count() == 2


def test_stream_ingest(spark, root):
    store = Store(spark, f"{root}/stream")
    q = ingest(spark, f"{root}/kb", store, f"{root}/cp", providers.HashingEmbedder(8))
    q.awaitTermination(60)
    assert store.read().count() == 3


def test_tumbling_stream(spark, root):
    events = table(spark, "/root/testdata/sf0.001", "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(f"{root}/events")
    stream = tumbling(spark.readStream.schema(events.schema).parquet(f"{root}/events"))
    q = stream.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("tumbled").agg(F.sum("n")).first()[0] == events.count()


def test_fusion(spark):
    lists = spark.createDataFrame([(0, 1, "a", 0.9), (0, 2, "b", 0.8), (1, 1, "b", 0.7), (2, 1, "c", None)], "list_id int, rank int, key string, cosine double")
    got = {r["key"]: r for r in R.reciprocal_rank_fusion(lists, ["key"]).collect()}
    assert got["b"]["rrf_score"] == pytest.approx(1 / 62 + 1 / 61) and got["a"]["rrf_score"] == pytest.approx(1 / 61)
    assert got["c"]["best_cosine"] == 0 and got["b"]["best_cosine"] == 0.8
    shuffled = R.reciprocal_rank_fusion(lists.orderBy(F.desc("key")), ["key"])
    assert sorted(shuffled.collect()) == sorted(got.values())


@pytest.mark.parametrize("scores,kept", [([0.9, 0.8, 0.3, 0.2], 2), ([0.8, 0.4, 0.2], 3), ([0.0, 0.0], 2), ([0.9], 1), ([], 0)])
def test_elbow(spark, scores, kept):
    rows = spark.createDataFrame([(i + 1, s, False) for i, s in enumerate(scores)], "rank int, score double, protected boolean")
    assert R.elbow(rows).count() == kept


def test_elbow_keeps_protected(spark):
    rows = spark.createDataFrame([(1, 0.9, False), (2, 0.1, False), (3, 0.05, True)], "rank int, score double, protected boolean")
    assert sorted(r["rank"] for r in R.elbow(rows).collect()) == [1, 3]


def test_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] is None
    with pytest.raises(Exception):
        df.select(of_dimension(F.col("a"), 3)).collect()
    text = spark.createDataFrame([("hello world",), ("",), (None,)], "t string").select(providers.HashingEmbedder(16).embed(F.col("t")).alias("v")).collect()
    assert sum(x * x for x in text[0]["v"]) == pytest.approx(1) and set(text[1]["v"]) == {0.0} and text[2]["v"] == text[1]["v"]


def test_providers():
    assert providers.routed(["nope"]) == ["ddl"] and providers.routed(["business_rules"]) == ["ddl", "business_rules"]
    assert providers.LocalExpander().variants("Who are the best customers", 4)[0] == "Who are the best customers"
    gate = providers.LocalGate()
    assert [gate.category(q, set()) for q in ("hello", "drop table x", "which tables are there", "total sales")] == ["GREETING", "HARMFUL", "META", "SQL_RELEVANT"]
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "done"

    assert providers.retried(flaky, first_wait=0) == "done"
    with pytest.raises(TimeoutError):
        providers.retried(lambda: (_ for _ in ()).throw(TimeoutError()), first_wait=0)


def test_prompts(spark):
    text = prompts.prompt("How many?", {"t": ["a", "b"]}, "snowflake", errors=["x"])
    assert text.index("## Task") < text.index("## Dialect") < text.index("## Schema") < text.index("## Question") and "t: a, b" in text
    assert prompts.as_markdown([]) == "No sources." and prompts.as_xml([]) == "<citations/>"
    c = prompts.Citation(1, "a<b", "ddl", 0.5, "Low", "x & y")
    assert "x &amp; y" in prompts.as_xml([c]) and "Low" in prompts.as_markdown([c])
    shown = prompts.result_table(spark.sql("SELECT 1 AS a, cast(NULL AS string) AS b"))
    assert "NULL" in shown and shown.endswith("(1 rows)")


def test_lifecycle(spark, tmp_path):
    data = "/root/testdata/sf0.001"
    tables = {t: table(spark, data, t) for t in ("orders", "customer", "part")}
    assert generate(spark, data, f"{tmp_path}/kb") == 15 and generate(spark, data, f"{tmp_path}/kb") == 0
    store, e = Store(spark, f"{tmp_path}/store"), providers.HashingEmbedder()
    build(spark, f"{tmp_path}/kb", store, e)
    context = retrieve(spark, store, "orders by customer", e)
    assert context.tables and context.entry_points and len(context.citations) >= 1
    found = answer(spark, "top 3 customers by sales in 1997", tables, providers.TemplateWriter("orders", "o_totalprice", "o_custkey", "o_orderdate"), store, e)
    assert found.result.count() == 3 and found.error is None
    assert list(found.seconds) == ["gate", "retrieval", "writing", "verification", "review", "entities", "execution"]
    assert answer(spark, "hello", tables, None).category == "GREETING"


def test_retry(spark):
    class Writer:
        asked = 0

        def sql(self, question, prompt):
            self.asked += 1
            return "SELECT missing_column FROM part" if self.asked == 1 else "SELECT 1 AS a"

    w = Writer()
    found = answer(spark, "anything", {"part": table(spark, "/root/testdata/sf0.001", "part")}, w)
    assert w.asked == 2 and found.error is None and found.result.first()["a"] == 1
    assert os.path.exists("/root/testdata")
