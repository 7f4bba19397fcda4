"""A page far in, found by rank and without a sort or a written table.

A quantile sketch of the leading key names a band of values that should hold the
page; exact counts of the rows before and in the band correct the rank, and the
search goes on in the band until it is small, where the page is a top-k. A value that
fills a band on its own is set apart and the search goes on with the next key, so ties of any
number are no harder than distinct values. Each round reads the table twice and
narrows it some hundredfold; what reaches the driver are a sketch and a few counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortsift.operators.paging import PAGE_SIZE, Order, total_order
from cohortsift.operators.relational import order_columns
from cohortsift.plans.spec import OrderKey

#: Rows of a band that a top-k is left to.
BAND_ROWS = 20_000
#: The size of a sketch, and what its ranks may be off by, in parts of all rows.
SKETCH, ERROR = 4000, 0.002


def digits(df: DataFrame, key: OrderKey) -> list[Column] | None:
    """Numbers, never NULL, that order rows one after the other as ``key`` does; None for kinds that have none.

    NULL comes last in both directions, NaN above all numbers.
    """
    column = F.col(key.field)
    kind = df.select(column).schema[0].dataType
    zero = F.lit(0).cast("long")
    if isinstance(kind, (T.IntegralType, T.BooleanType)):
        parts = [column.cast("long")]
    elif isinstance(kind, T.DateType):
        parts = [F.unix_date(column).cast("long")]
    elif isinstance(kind, T.TimestampType):
        parts = [F.unix_micros(column)]
    elif isinstance(kind, T.DecimalType) and kind.precision <= 18:
        parts = [(column * F.lit(10**kind.scale).cast(f"decimal({kind.scale + 1},0)")).cast("long")]
    elif isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        number = column.cast("double")
        parts = [F.isnan(column).cast("long"), F.when(F.isnan(column), 0.0).otherwise(number)]
    else:
        return None
    if key.descending:
        parts = [-p if isinstance(df.select(p).schema[0].dataType, T.DoubleType) else F.bitwise_not(p) for p in parts]
    blank = [F.lit(0.0) if isinstance(df.select(p).schema[0].dataType, T.DoubleType) else zero for p in parts]
    return [column.isNull().cast("long"), *(F.coalesce(p, b) for p, b in zip(parts, blank, strict=True))]


def deep_page(
    df: DataFrame, order: Order, number: int = 1, size: int = PAGE_SIZE, band_rows: int = BAND_ROWS
) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows, as :func:`page` gives it; past the end it is empty.

    Leading keys of numbers, dates and instants guide the search; from the first key of another
    kind on, rows that tie so far are left to a top-k.
    """
    if number < 1 or size < 0:
        raise ValueError("pages are counted from 1 and have no negative size")
    keys = total_order(df, order)
    numbers: list[Column] = []
    for key in keys:
        found = digits(df, key)
        if found is None:
            break
        numbers += found
    first = (number - 1) * size
    parts = _select(df, keys, numbers, [], first, size, band_rows)
    if not parts:
        return df.limit(0)
    return reduce(DataFrame.union, parts).orderBy(*order_columns(keys)).limit(size)


def _select(
    df: DataFrame, keys: Sequence[OrderKey], numbers: list[Column], within: list[Column], first: int, size: int, band_rows: int
) -> list[DataFrame]:
    """Parts that together are the rows ``first`` .. ``first + size`` of those in the band ``within``."""
    while size > 0:
        band = df.filter(reduce(and_, within)) if within else df
        if not numbers:
            return [band.orderBy(*order_columns(keys)).offset(first).limit(size)]
        digit = numbers[0]
        rows, sketch, kind = _sketch(band, digit)
        size = min(size, rows - first)
        if size <= 0:
            return []
        if rows <= band_rows:
            return [band.orderBy(*order_columns(keys)).offset(first).limit(size)]
        last = first + size
        low, high, middle = _values(df, sketch, kind, [first / rows - ERROR, last / rows + ERROR, (first + last) / (2 * rows)])
        counts = band.agg(
            F.count_if(digit < low).alias("before"), F.count_if((digit >= low) & (digit <= high)).alias("in"),
            F.count_if(digit < middle).alias("below"), F.count_if(digit == middle).alias("equal"),
        ).first()
        before, inside, below, equal = counts
        if before <= first and last <= before + inside and 2 * inside < rows:
            within, first = [*within, digit >= low, digit <= high], first - before
            continue
        # the value in the middle of the page holds much of the band: rows before it, of it, and after it are found apart
        parts = []
        for begin, end, where, rest in (
            (0, below, digit < middle, numbers), (below, below + equal, digit == middle, numbers[1:]), (below + equal, rows, digit > middle, numbers),
        ):
            a, b = max(first, begin), min(first + size, end)
            if a < b:
                parts += _select(df, keys, rest, [*within, where], a - begin, b - a, band_rows)
        return parts
    return []


def _sketch(band: DataFrame, digit: Column) -> tuple[int, bytearray, str]:
    """How many rows there are, and a sketch of their values of a kind."""
    kind = "double" if isinstance(band.select(digit).schema[0].dataType, T.DoubleType) else "bigint"
    rows, sketch = band.agg(F.count("*"), F.call_function(f"kll_sketch_agg_{kind}", digit, F.lit(SKETCH))).first()
    return rows, sketch, kind


def _values(df: DataFrame, sketch: bytearray, kind: str, shares: Sequence[float]) -> list[Column]:
    """The values below which about such shares of the rows lie."""
    ranks = [F.call_function(f"kll_sketch_get_quantile_{kind}", F.lit(sketch), F.lit(min(1.0, max(0.0, s)))) for s in shares]
    return [F.lit(v) for v in df.sparkSession.range(1).select(*ranks).first()]
