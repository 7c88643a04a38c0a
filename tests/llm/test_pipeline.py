"""The pipeline against its stages done by brute force."""

import os
import shutil

import corpus_pipeline
import pytest

from heron.llm import pii
from tests.llm.test_operators import LOWER, brute_components, frame, corpus


@pytest.fixture(scope="module")
def rows():
    extra = [(9000, "123 456 !!"), (9001, None), (9002, "")]
    return dict([*corpus(), *extra])


def test_stages(spark, rows, tmp_path):
    docs = frame(spark, rows.items()).select("doc_id", "text", "lang", "source", "n_chars")
    docs = docs.withColumn("lang", docs["source"]).fillna("en", "lang")
    os.makedirs(f"{tmp_path}/data")
    docs.write.parquet(f"{tmp_path}/data/documents.parquet")
    left = {i: t for i, t in rows.items() if t and any(c.isalpha() for c in t)}
    by_body: dict[bytes, int] = {}
    for i, t in sorted(left.items()):
        by_body[t.encode().translate(LOWER)] = i
    left = {i: left[i] for i in by_body.values()}
    after_near = {i: left[i] for i, (n, c) in brute_components(left).items() if n == 0 or c == i}
    seen = docs
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, seen, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert seen.columns == docs.columns
        sizes.append({r["doc_id"] for r in seen.select("doc_id").collect()})
    assert sizes[1] == set(left) and sizes[2] == sizes[3] == sizes[4] == set(after_near)
    masked = {r["doc_id"]: r for r in spark.read.parquet(f"{tmp_path}/pii").collect()}
    for i, t in after_near.items():
        spans = pii.base_spans(t)
        assert (masked[i]["text"] == t) == (not spans) and masked[i]["n_chars"] == len(masked[i]["text"])
    final = corpus_pipeline.run(spark, f"{tmp_path}/data")
    assert {r["doc_id"] for r in final.collect()} == set(after_near)
    shutil.rmtree(tmp_path)


def test_repeated_and_missing_ids(spark):
    docs = frame(spark, [(1, "one two three four"), (1, "another text here"), (1, "One Two Three Four"), (None, "one two three four"), (None, "x y z"), (2, "x y z")]).select("doc_id", "text", "lang", "source", "n_chars")
    kept = corpus_pipeline.drop_exact_copies(spark, docs, "").collect()
    assert sorted(r["text"].lower() for r in kept) == ["another text here", "one two three four", "x y z"]
    assert sorted(str(r["doc_id"]) for r in kept) == ["1", "1", "2"]
    near = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted(r["text"].lower() for r in near) == ["another text here", "one two three four", "x y z"]


def test_clashing_columns_and_a_very_long_text(spark, tmp_path):
    """Columns named as the stages might name theirs stay as they are; a text of 3 MB goes through whole."""
    extra = ["row_id", "Row_ID_", "__row", "lang_pred", "LANG_SCORE", "__lang_pred", "keep_id", "component_id", "bucket", "a.b", "node", "n"]
    long = " ".join(f"w{i}" for i in range(400_000))
    texts = {1: long, 2: long + " with one more end", 3: "some words of another kind", 4: "Some words of another kind", 5: "mail x.y@z.com now"}
    docs = spark.createDataFrame([(i, t, "en", "s", len(t), *[f"{c}{i}" for c in extra]) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra))
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, seen, "").write.parquet(f"{tmp_path}/{name}")
        seen = spark.read.parquet(f"{tmp_path}/{name}")
        assert seen.columns == docs.columns
    rows = {r["doc_id"]: r for r in seen.collect()}
    assert set(rows) == {1, 4, 5} and rows[1]["text"] == long and rows[5]["text"] == "mail <EMAIL> now"
    assert all(r[c] == f"{c}{i}" for i, r in rows.items() for c in extra)
    assert corpus_pipeline.STAGES[-1][1](spark, seen, "").count() == 3


def test_shape():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "pii", "packing"] and corpus_pipeline.ORACLE_SQL is None
