"""The pipeline: its stages on odd rows, and the whole on a small table."""

import messy
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from cohortsift.llm import pii
from cohortsift.llm.shared import stored

TINY = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(names)
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "near_duplicates", "personal_data", "mixed_sources", "packed_sequences",
    ]


@pytest.mark.parametrize("rows", [messy.ROWS, []], ids=["odd", "none"])
def test_stages_take_odd_tables(spark, rows):
    docs = messy.documents(spark, rows)
    for name, stage in corpus_pipeline.STAGES:
        columns, kinds = docs.columns, docs.dtypes
        docs = stored(stage(spark, docs, TINY), name)
        if name != "packed_sequences":
            assert docs.columns == columns and docs.dtypes == kinds, name
            assert docs.where(" or ".join(f"`{c}` <> 'x' or `{c}` is null" for c in messy.CLASHING)).isEmpty(), name
    assert (docs.count() > 0) == bool(rows)


def test_each_stage_does_its_part(spark):
    docs = spark.read.parquet(f"{TINY}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    known = stored(stages["language_id"](spark, docs, TINY), "known")
    assert known.count() >= docs.count() - 2
    one = stored(stages["near_duplicates"](spark, known, TINY), "one")
    texts = {r["doc_id"]: r["text"] for r in known.collect()}
    label = messy.components({i: messy.shingles(t, 5) for i, t in texts.items()}, 80)
    assert {r["doc_id"] for r in one.collect()} == {i for i in texts if label[i] == i}
    clean = stored(stages["personal_data"](spark, one, TINY), "clean")
    for r in clean.collect():
        assert r["text"] == pii.redact(texts[r["doc_id"]]) and pii.all_spans(r["text"])[1] == [] and r["n_chars"] == len(r["text"])
    mixed = stored(stages["mixed_sources"](spark, clean, TINY), "mixed")
    assert {r["doc_id"] for r in mixed.collect()} == {r["doc_id"] for r in clean.collect()}
    pieces = stages["packed_sequences"](spark, mixed, TINY)
    assert pieces.selectExpr("count(distinct doc_id) n").first()["n"] == clean.count()


def test_the_whole(spark):
    rows = corpus_pipeline.run(spark, TINY).collect()
    used = {}
    for r in rows:
        used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert rows and max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 2


def test_rows_without_ids_are_spread(spark, many_parts):
    """Nine rows in ten have no id, and most of those the same text: none is lost, and no task holds them all."""
    rows = [(None if k % 10 else k, messy.TALE if k % 3 else f"{messy.TALE} {k}", "en", "a") for k in range(900)]
    docs = messy.documents(spark, rows).repartition(6)
    one = dict(corpus_pipeline.STAGES)["near_duplicates"](spark, docs, TINY)
    parts = [r["n"] for r in one.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(r[0] is None for r in rows) < sum(parts) <= sum(r[0] is None for r in rows) + 31
    assert max(parts) < sum(parts) / 3
