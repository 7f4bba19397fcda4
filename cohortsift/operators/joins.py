"""Joins on one equality that stay balanced when a few keys hold most rows.

When the right side is small enough for Spark to broadcast it, or no key is
heavy, ``join`` is Spark's own join and nothing else. Otherwise rows of a heavy
key are dealt over several tasks: one side's rows each go to one of ``n`` cells
of the key, the other side's rows of that key are repeated for all ``n``, so
each pair meets in exactly one cell. Which keys are heavy comes from one pass
over the key column that keeps a sketch of fixed size; a key the sketch misses
costs time, never rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkAttributeError
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortsift.operators.rows import row_hash

# The size of a profile's sketch: a key with more than 1 in 28 000 rows is in it for
# certain. It reports twice as many keys as there are shuffle partitions, since no
# more can be above the share of one, and as many as the sketch holds at most.
SKETCH_SIZE = 100_000
# A key with fewer rows than this is never worth dealing out.
LIGHT_KEY_ROWS = 1_000_000

# Key types the sketch cannot count; Spark's own skew handling is left to split them.
_UNPROFILED = (
    T.ArrayType, T.StructType, T.MapType, T.BinaryType, T.VariantType, T.NullType,
    T.DayTimeIntervalType, T.YearMonthIntervalType, T.CalendarIntervalType,
)

_LEFT_CELL, _LEFT_COPY = "__left_cell", "__left_copy"
_RIGHT_CELL, _RIGHT_COPY = "__right_cell", "__right_copy"
_LEFT_COPIED, _RIGHT_COPIED = "__left_copied", "__right_copied"
_ADDED = (_LEFT_CELL, _LEFT_COPY, _LEFT_COPIED, _RIGHT_CELL, _RIGHT_COPY, _RIGHT_COPIED)


@dataclass(frozen=True)
class KeyProfile:
    """In how many cells to deal the rows of each heavy key, and of NULL."""

    cells: dict[Any, int] = field(default_factory=dict)
    null_cells: int = 1

    def __bool__(self) -> bool:
        return bool(self.cells) or self.null_cells > 1


def fits_broadcast(df: DataFrame) -> bool:
    """Whether Spark's own size estimate lets it broadcast ``df``."""
    try:
        limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        return 0 <= df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= limit
    except (AttributeError, PySparkAttributeError):
        return False  # no access to the plan from this client: use the profile


def profile_keys(df: DataFrame, key: str, light_rows: int = LIGHT_KEY_ROWS) -> KeyProfile:
    """Find the keys of ``df`` that would overload one shuffle partition."""
    if isinstance(_kind(df, key), _UNPROFILED):
        return KeyProfile()
    setting = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    partitions = int(setting) if setting.isdigit() else df.sparkSession.sparkContext.defaultParallelism
    reported = min(max(1000, 2 * partitions), SKETCH_SIZE)
    row = (
        df.select(F.col(key).alias("k"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(F.col("k").isNull()).alias("nulls"),
            F.expr(f"approx_top_k(k, {reported}, {SKETCH_SIZE})").alias("top"),
        )
        .first()
    )
    share = max(light_rows, row["total"] // (2 * partitions), 1)
    cells = {
        item["item"]: -(-item["count"] // share)
        for item in row["top"] or ()
        if item["item"] is not None and item["count"] > share
    }
    return KeyProfile(cells, max(1, -(-row["nulls"] // share)))


def join(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str = "inner",
    *,
    left_profile: Callable[[], KeyProfile] | None = None,
    right_profile: Callable[[], KeyProfile] | None = None,
    light_rows: int = LIGHT_KEY_ROWS,
    may_broadcast: bool = True,
) -> DataFrame:
    """Join two aliased relations on ``left_on = right_on``.

    Column names are qualified (``main_table.variant_hash``). NULL keys match
    nothing. ``left_profile`` and ``right_profile`` give the profile of a key when it
    is known or cheaper to find elsewhere, such as in the scan a longer chain
    started from. ``light_rows`` is smaller where single rows are large. Without
    ``may_broadcast`` keys are profiled even if a side looks small.
    """
    if may_broadcast and how == "inner" and fits_broadcast(right):
        # Of two small sides Spark would pick by estimates, which are poor for
        # aggregates; the right side is the one looked up in.
        return _plain(left, F.broadcast(right), left_on, right_on, how)
    if may_broadcast and _small_enough(left, right, how) or _plan_type(left, right, left_on, right_on) is None:
        return _plain(left, right, left_on, right_on, how)
    heavy_left = left_profile() if left_profile else profile_keys(left, left_on, light_rows)
    if how in ("left_semi", "left_anti"):
        # Which keys there are is all that counts, however often the right side repeats them.
        keys = _keys(right, right_on)
        if not heavy_left:
            return _plain(left, keys, left_on, right_on, how)
        return _dealt(left, keys, left_on, right_on, how, heavy_left, KeyProfile())
    heavy_right = right_profile() if right_profile else profile_keys(right, right_on, light_rows)
    no_heavy_value = not heavy_left.cells and not heavy_right.cells
    if no_heavy_value and (how == "inner" or not (heavy_left or heavy_right)):
        return _plain(left, right, left_on, right_on, how)
    if how == "inner" or (how == "left" and not heavy_right.cells):
        return _dealt(left, right, left_on, right_on, how, heavy_left, heavy_right)
    return _outer(left, right, left_on, right_on, how, heavy_left, heavy_right)


def _small_enough(left: DataFrame, right: DataFrame, how: str) -> bool:
    """Whether Spark can broadcast a side of this join, or has little to shuffle."""
    if how in ("inner", "right"):
        return fits_broadcast(left)
    return fits_broadcast(right) and (how != "full" or fits_broadcast(left))


def _kind(df: DataFrame, key: str) -> T.DataType:
    return df.select(F.col(key)).schema[0].dataType


def _plan_type(left: DataFrame, right: DataFrame, left_on: str, right_on: str) -> T.DataType | None:
    """One type for heavy keys of both sides; None leaves odd pairs to Spark."""
    ours, theirs = _kind(left, left_on), _kind(right, right_on)
    if isinstance(ours, T.IntegralType) and isinstance(theirs, T.IntegralType):
        return T.LongType()
    return ours if ours == theirs else None


def _plain(left: DataFrame, right: DataFrame, left_on: str, right_on: str, how: str) -> DataFrame:
    return left.join(right, F.col(left_on) == F.col(right_on), how)


def _outer(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str,
    heavy_left: KeyProfile,
    heavy_right: KeyProfile,
) -> DataFrame:
    """An outer join of dealt sides, each shuffled once.

    A row is repeated only for a key that is heavy on the other side, and so found there: it has
    a match, and copies of it that met an empty cell are dropped. A row that may be a miss has no
    copies. Whether a heavy key is on a side is looked up exactly, as profiles may be older than it.
    """
    heavy_left, heavy_right = _there(left, left_on, heavy_left), _there(right, right_on, heavy_right)
    rows = _meet(left, right, left_on, right_on, how, heavy_left, heavy_right)
    if how in ("left", "full"):
        rows = rows.filter(F.col(_RIGHT_CELL).isNotNull() | ~F.col(_LEFT_COPIED))
    if how in ("right", "full"):
        rows = rows.filter(F.col(_LEFT_CELL).isNotNull() | ~F.col(_RIGHT_COPIED))
    return rows.drop(*_ADDED)


def _there(df: DataFrame, key: str, profile: KeyProfile) -> KeyProfile:
    """The profile without the keys that no row of ``df`` has."""
    if not profile.cells:
        return profile
    kind = _heavy_type(df, key)
    heavy = df.sparkSession.createDataFrame([(k,) for k in profile.cells], T.StructType([T.StructField("__key", kind)]))
    # Broadcast is safe: a profile holds at most SKETCH_SIZE keys.
    found = df.select(F.col(key).alias("k")).join(F.broadcast(heavy), F.col("k") == F.col("__key")).select("__key").distinct()
    seen = {row[0] for row in found.collect()}
    return KeyProfile({k: n for k, n in profile.cells.items() if k in seen}, profile.null_cells)


def _keys(df: DataFrame, key: str) -> DataFrame:
    return df.select(F.col(key)).filter(F.col(key).isNotNull()).distinct()


def _dealt(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str,
    heavy_left: KeyProfile,
    heavy_right: KeyProfile,
) -> DataFrame:
    return _meet(left, right, left_on, right_on, how, heavy_left, heavy_right).drop(*_ADDED)


def _meet(
    left: DataFrame,
    right: DataFrame,
    left_on: str,
    right_on: str,
    how: str,
    heavy_left: KeyProfile,
    heavy_right: KeyProfile,
) -> DataFrame:
    dealt_left = _cells(left, left_on, heavy_left, heavy_right, _LEFT_CELL, _LEFT_COPY, _LEFT_COPIED)
    dealt_right = _cells(right, right_on, heavy_right, heavy_left, _RIGHT_CELL, _RIGHT_COPY, _RIGHT_COPIED)
    meet = (
        (F.col(left_on) == F.col(right_on))
        & (F.col(_LEFT_CELL) == F.col(_RIGHT_COPY))
        & (F.col(_LEFT_COPY) == F.col(_RIGHT_CELL))
    )
    return dealt_left.join(dealt_right, meet, how)


def _heavy_type(df: DataFrame, key: str) -> T.DataType:
    kind = _kind(df, key)
    return T.LongType() if isinstance(kind, T.IntegralType) else kind


def _cells(df: DataFrame, key: str, own: KeyProfile, other: KeyProfile, cell: str, copy: str, copied: str) -> DataFrame:
    """Give each row its own cell, one copy per cell of the other side, and whether there are several."""
    heavy = list(dict.fromkeys([*own.cells, *other.cells]))
    if own:
        df = df.withColumn("__row", row_hash(df))
    if not heavy:
        return df.withColumn(cell, _null_cell(key, own)).withColumn(copy, F.lit(0)).withColumn(copied, F.lit(False)).drop("__row")
    plan = df.sparkSession.createDataFrame(
        [(k, own.cells.get(k, 1), other.cells.get(k, 1)) for k in heavy],
        T.StructType(
            [
                T.StructField("__key", _heavy_type(df, key)),
                T.StructField("__own", T.IntegerType()),
                T.StructField("__other", T.IntegerType()),
            ]
        ),
    )
    # Broadcast is safe: two profiles hold at most 2 * SKETCH_SIZE keys.
    planned = df.join(F.broadcast(plan), F.col(key) == F.col("__key"), "left")
    own_cell = _null_cell(key, own)
    if own.cells:
        own_cell = F.when(F.col("__own").isNotNull(), F.pmod("__row", "__own").cast("int")).otherwise(own_cell)
    copies = F.explode(F.sequence(F.lit(0), F.coalesce("__other", F.lit(1)) - 1)) if other.cells else F.lit(0)
    dealt = planned.withColumn(copied, F.coalesce(F.col("__other") > 1, F.lit(False)))
    return dealt.withColumn(cell, own_cell).withColumn(copy, copies).drop("__row", "__key", "__own", "__other")


def _null_cell(key: str, own: KeyProfile) -> Column:
    if own.null_cells == 1:
        return F.lit(0)
    return F.when(F.col(key).isNull(), F.pmod("__row", F.lit(own.null_cells)).cast("int")).otherwise(0)
