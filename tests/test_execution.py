"""Statements that fail while they run, the retry, replies, embeddings and capability probes."""

import pytest
from pyspark.sql import functions as F

from heron.functions.text import count_of, count_of_all, spaced, tokens
from heron.operators import statements
from heron.plans import dialect, providers
from heron.plans.answer import answer, execute
from heron.plans.patch import trigrams_available


@pytest.fixture(scope="module")
def tables(spark):
    return {"sales": spark.createDataFrame([(1, 10.0, "a"), (2, 0.0, "b")], "sale_id long, amount double, kind string")}


class Writer:
    """Gives its statements one after the other and keeps what it was asked."""

    def __init__(self, *statements):
        self.left, self.asked = list(statements), []

    def sql(self, question, prompt):
        self.asked.append(prompt)
        return self.left.pop(0)


def test_failures_at_run_time_are_messages(spark, tables):
    tables["sales"].createOrReplaceTempView("sales")
    ok, result = execute(spark, "SELECT kind FROM sales")
    assert ok and sorted(r[0] for r in result.collect()) == ["a", "b"]
    for sql, part in (("SELECT raise_error(kind) FROM sales", "USER_RAISED_EXCEPTION"), ("SELECT CAST(kind AS INT) FROM sales", "CAST_INVALID_INPUT"), ("SELECT nothing FROM sales", "UNRESOLVED_COLUMN")):
        ok, message = execute(spark, sql)
        assert not ok and isinstance(message, str) and part in message


def test_a_statement_that_fails_while_running_is_written_once_more(spark, tables):
    writer = Writer("SELECT CAST(s.kind AS INT) AS k FROM sales s", "SELECT s.kind, sum(s.amount) AS total FROM sales s GROUP BY s.kind")
    found = answer(spark, "total amount by kind", tables, writer, resolve_entities=False)
    assert found.error is None and {r["kind"]: r["total"] for r in found.result.collect()} == {"a": 10.0, "b": 0.0}
    assert len(writer.asked) == 2 and "CAST_INVALID_INPUT" in writer.asked[1] and "Error of the last statement" in writer.asked[1]
    twice = answer(spark, "total amount by kind", tables, Writer(*["SELECT CAST(s.kind AS INT) AS k FROM sales s"] * 2), resolve_entities=False)
    assert twice.result is None and "CAST_INVALID_INPUT" in twice.error


def test_replies(spark, tables):
    found = answer(spark, "which tables are there?", tables, Writer())
    assert found.category == "META" and "sales (3 columns)" in found.text and found.result is None
    assert answer(spark, "hello", tables, Writer()).text and answer(spark, "drop table sales", tables, Writer()).category == "HARMFUL"


def test_embeddings(spark):
    e = providers.HashingEmbedder(8)
    v = providers.embedded(e, "some words", spark)
    assert len(v) == 8 and sum(x * x for x in v) == pytest.approx(1)
    for text in ("", "  ", None):
        with pytest.raises(ValueError, match="empty"):
            providers.embedded(e, text, spark)
    rows = spark.createDataFrame([(1, "some words"), (2, " "), (3, None), (4, "some words")], "id long, text string")
    got = {r["id"]: r["embedding"] for r in providers.embedded_batch(e, rows).collect()}
    assert got[1] == got[4] == pytest.approx(v) and got[2] == got[3] == [0.0] * 8
    with pytest.raises(ValueError, match="no texts"):
        providers.embedded_batch(e, rows.filter("id > 9"))

    class Short(providers.HashingEmbedder):
        def embed(self, text):
            return F.array(F.lit(1.0).cast("float"))

    with pytest.raises(Exception, match="hasn't 8 numbers"):
        providers.embedded_batch(Short(8), rows).collect()
    with pytest.raises(ValueError, match="instead of 8"):
        providers.embedded(Short(8), "x", spark)


def test_transient_failures_are_tried_again():
    calls = []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ConnectionError
        return "done"

    assert providers.retried(call, first_wait=0.0) == "done" and len(calls) == 3
    with pytest.raises(TimeoutError):
        providers.retried(lambda: (_ for _ in ()).throw(TimeoutError()), first_wait=0.0)


def test_capabilities(spark):
    assert trigrams_available(spark)
    spark.conf.set("heron.trigrams.enabled", "false")
    try:
        assert not trigrams_available(spark)
    finally:
        spark.conf.unset("heron.trigrams.enabled")


def test_rewrites_see_through_literals():
    assert dialect.to_spark("SELECT EXTRACT(YEAR FROM AGE(DATE'2020-06-01', \"b c\")) AS x -- age(a, b)") == "SELECT floor(months_between(DATE'2020-06-01', `b c`,false) / 12) AS x -- age(a, b)"


def test_spaced_tokens_count_as_tokens_do(spark):
    rows = spark.createDataFrame([("a b a",), ("",), (" - ",), ("aa a-a_A",), ("x",), ("a",), ("Éa a",)], "t string")
    held, all_ = spaced(F.col("t")), tokens(F.col("t"))
    for r in rows.select(count_of("a", held).alias("n"), F.size(F.filter(all_, lambda x: x == "a")).alias("m"), count_of_all(held).alias("all"), F.size(all_).alias("size")).collect():
        assert r["n"] == r["m"] and r["all"] == r["size"]


def test_the_whole_retrieval_finds_the_tables_asked_for(spark):
    rows = statements.retrieved_context(spark, "/root/testdata/sf0.001").collect()
    parts = {}
    for r in rows:
        parts.setdefault(r["part"], []).append(r["value"])
    assert parts["section"] == ["ddl"] and parts["variant"][0] == "how many orders has each customer" and parts["entry"] == ["ddl/KB.md"]
    assert {"ddl/orders.md", "ddl/customer.md"} & set(parts["table"]) and set(parts["citation"]) >= set(parts["table"])
