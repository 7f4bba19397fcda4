"""Positions of rows in an order, found without one task for a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortsift.operators.rows import sort_all
from cohortsift.session import new_shared_path

PLACE = "__place"
# monotonically_increasing_id() holds the partition above the row's index in it.
_INDEX_BITS = 33


def write_in_order(df: DataFrame, order: Sequence[Column]) -> tuple[DataFrame, str]:
    """Sort ``df`` over all executors and keep it as a table in the shared folder.

    The table's ``__place`` column grows with the order. Range partitioning splits
    a group of any size, and reading the written table cuts the lineage: every
    later use sees the same places.
    """
    path = new_shared_path(df.sparkSession, "ordered")
    sort_all(df, list(order)).withColumn(PLACE, F.monotonically_increasing_id()).write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def part_of(place: Column) -> Column:
    return F.shiftright(place, _INDEX_BITS)


def index_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))


def place_at(part: int, index: int) -> int:
    return (part << _INDEX_BITS) + index


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Add each row's position, from 0, within its ``keys`` group under ``order``.

    ``order`` must leave no ties. A sorted part holds one run of each group, so
    a row's position is its index in the run plus the rows of earlier runs.
    """
    written, _ = write_in_order(df, [*[F.col(k) for k in keys], *order])
    placed = written.select("*", part_of(F.col(PLACE)).alias("__part"), index_of(F.col(PLACE)).alias("__index"))
    runs = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__index").alias("__first"))
    # A group has at most one run per sorted part, so this window stays small.
    earlier = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = runs.select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.col("__part").alias("__run"),
        (F.coalesce(F.sum("__n").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
    )
    same = F.col("__part") == F.col("__run")
    for i, key in enumerate(keys):
        same = same & F.col(key).eqNullSafe(F.col(f"__k{i}"))
    return placed.join(starts, same).select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("__index") + F.col("__shift")).alias(name)
    )
