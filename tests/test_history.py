"""Positions within a group, small or holding most rows."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cohortsift.operators.numbering import number_rows


@pytest.fixture(scope="module")
def said(spark, tmp_path_factory):
    """Two thirds of the rows belong to key 1, some to NULL; times often tie."""
    path = str(tmp_path_factory.mktemp("said")) + "/t"
    spark.range(3000).select(
        F.expr("case when id % 3 > 0 then 1 when id % 9 = 0 then null else 100 + id % 50 end").alias("k"),
        F.expr("id * 7919 % 100").alias("ts"),
        F.col("id").alias("event_id"),
        F.concat(F.lit("c"), F.col("id")).alias("comment"),
    ).repartition(6).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def wanted(said):
    groups = defaultdict(list)
    for r in said.collect():
        groups[r["k"]].append((r["ts"], r["event_id"], r["comment"]))
    return {k: [c for *_, c in sorted(rows)] for k, rows in groups.items()}


def test_positions(many_parts, said, wanted):
    numbered = number_rows(said, ["k"], [F.col("ts"), F.col("event_id")], "position")
    found = defaultdict(dict)
    for r in numbered.collect():
        found[r["k"]][r["position"]] = r["comment"]
    assert {k: [v[i] for i in range(len(v))] for k, v in found.items()} == wanted
