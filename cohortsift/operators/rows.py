"""What tells one row from another, equal rows included."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsift.plans.spec import MAIN


def row_hash(df: DataFrame) -> Column:
    """A hash that spreads rows, equal ones too, and survives a rerun of a task.

    Rows are told apart by the file and position they were read from: those of
    the main table in a join of several. Where no scan can be named, the
    partition a row is computed in has to do; it needs no further columns, and a
    group too large for one task lies in many partitions.
    """
    for scan in (f"{MAIN}._metadata", "_metadata"):
        place = [F.col(f"{scan}.file_path"), F.col(f"{scan}.row_index")]
        try:
            df.select(*place)
            return F.xxhash64(*place)
        except AnalysisException:
            continue
    return F.xxhash64(F.spark_partition_id())


def sort_all(df: DataFrame, order: list[Column]) -> DataFrame:
    """Sort ``df`` as a whole, ties spread over tasks.

    A sort by ``order`` alone sends all rows with equal keys to one task. With
    the row's hash as the last key a group of ties, or of copies, is split like
    any other range.
    """
    return df.withColumn("__tie", row_hash(df)).orderBy(*order, "__tie").drop("__tie")
