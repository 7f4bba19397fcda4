"""Pages of an ordered relation, their count, and ways to reach a deep page.

A page is Spark's top-k: every task keeps the rows up to the page's end and the
driver merges them. That stops being cheap when the end lies deep. Who turns to
deep pages asks for a table sorted once (:class:`SortedPages`) or goes on from the
last row seen (:func:`page_after`); the last page is taken from the other end.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, or_
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortsift.functions.sqltext import quoted
from cohortsift.operators.numbering import PLACE, part_of, place_at, write_in_order
from cohortsift.operators.relational import order_columns
from cohortsift.plans.spec import OrderKey

PAGE_SIZE = 10

Order = Sequence[OrderKey | str | tuple[str, str]]


def total_order(df: DataFrame, order: Order) -> list[OrderKey]:
    """``order``, then every other sortable column, so that pages are fixed."""
    keys = [OrderKey.of(k) for k in order]
    named = {k.field.strip("`") for k in keys}
    return keys + [
        OrderKey(quoted(f.name)) for f in df.schema.fields if f.name not in named and _sortable(f.dataType)
    ]


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    return not isinstance(kind, (T.MapType, T.VariantType, T.CalendarIntervalType))


def page(df: DataFrame, order: Order, number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """Page ``number`` (from 1) of ``size`` rows; past the end it is empty. Nothing is written."""
    if number < 1 or size < 0:
        raise ValueError("pages are counted from 1 and have no negative size")
    keys = total_order(df, order)
    return df.orderBy(*order_columns(keys)).offset((number - 1) * size).limit(size)


def page_count(row_count: int, size: int = PAGE_SIZE) -> int:
    """Pages needed for so many rows; an empty relation still has one."""
    return max(1, -(-row_count // size))


def page_stats(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """One row: how many rows there are, and how many pages they fill."""
    rows = F.count("*")
    return df.agg(
        rows.alias("row_count"),
        F.greatest(F.ceil(rows / F.lit(size)), F.lit(1)).cast("bigint").alias("page_count"),
    )


def last_page(df: DataFrame, order: Order, row_count: int, size: int = PAGE_SIZE) -> DataFrame:
    """The last page, taken from the end so that its depth does not matter."""
    keys = total_order(df, order)
    rest = row_count - (page_count(row_count, size) - 1) * size
    return df.orderBy(*order_columns(keys, backwards=True)).limit(rest).orderBy(*order_columns(keys))


def page_after(df: DataFrame, order: Order, last: Mapping[str, Any], size: int = PAGE_SIZE) -> DataFrame:
    """The ``size`` rows that follow the row ``last`` in the order.

    ``last`` maps every column of the total order to that row's value. The scan
    gets the condition as a filter, so the cost does not grow with the depth.
    """
    keys = total_order(df, order)
    return df.filter(_follows(keys, last)).orderBy(*order_columns(keys)).limit(size)


def _follows(keys: Sequence[OrderKey], last: Mapping[str, Any]) -> Column:
    """True for rows after ``last``: a later key decides where earlier ones tie."""
    options, ties = [], []
    for key in keys:
        name = key.field.strip("`")
        value, column = last[name], F.col(key.field)
        if value is not None:
            beyond = column < F.lit(value) if key.descending else column > F.lit(value)
            options.append(reduce(and_, [*ties, beyond | column.isNull()]))
        ties.append(column.isNull() if value is None else column == F.lit(value))
    return reduce(or_, options) if options else F.lit(False)


@dataclass(frozen=True)
class SortedPages:
    """A relation sorted once into the shared folder, to read any page from.

    ``parts`` lists the sorted parts and their row counts: as many entries as
    the write had tasks. A page becomes a range of places, which the Parquet
    reader uses to skip all files but those the page lies in.
    """

    path: str
    table: DataFrame
    parts: tuple[tuple[int, int], ...]

    @classmethod
    def of(cls, df: DataFrame, order: Order) -> SortedPages:
        table, path = write_in_order(df, order_columns(total_order(df, order)))
        counts = table.groupBy(part_of(F.col(PLACE)).alias("part")).count().collect()
        return cls(path, table, tuple(sorted((r["part"], r["count"]) for r in counts)))

    @property
    def row_count(self) -> int:
        return sum(n for _, n in self.parts)

    def page(self, number: int, size: int = PAGE_SIZE) -> DataFrame:
        begin, end = (number - 1) * size, number * size
        place, ranges, before = F.col(PLACE), [], 0
        for part, rows in self.parts:
            first, stop = max(begin - before, 0), min(end - before, rows)
            if first < stop:
                ranges.append((place >= place_at(part, first)) & (place < place_at(part, stop)))
            before += rows
        wanted = reduce(or_, ranges) if ranges else F.lit(False)
        return self.table.filter(wanted).orderBy(PLACE).limit(size).drop(PLACE)

    def show(self, request: int | str = 1, *, current: int = 1, size: int = PAGE_SIZE) -> PageView:
        pages = page_count(self.row_count, size)
        number = turn_to(request, current, pages)
        return PageView(self.page(number, size), number, pages, self.row_count)


@dataclass(frozen=True)
class PageView:
    """A page as shown, with the number it got and the counts beside it."""

    rows: DataFrame
    number: int
    page_count: int
    row_count: int


def turn_to(request: int | str, current: int, pages: int) -> int:
    """The page a number or ``first``/``previous``/``next``/``last`` leads to."""
    moves = {"first": 1, "previous": current - 1, "next": current + 1, "last": pages}
    wanted = moves[request] if isinstance(request, str) else request
    return min(max(wanted, 1), pages)


def show_page(
    df: DataFrame | SortedPages,
    order: Order,
    request: int | str = 1,
    *,
    current: int = 1,
    size: int = PAGE_SIZE,
    row_count: int | None = None,
) -> PageView:
    """Count the rows, then show the wanted page or the nearest there is.

    Who turns pages of one relation can hand on the ``row_count`` of the last
    view, or :class:`SortedPages` in place of the relation for pages far in.
    """
    if isinstance(df, SortedPages):
        return df.show(request, current=current, size=size)
    rows = df.count() if row_count is None else row_count
    pages = page_count(rows, size)
    number = turn_to(request, current, pages)
    if number == pages:
        return PageView(last_page(df, order, rows, size), number, pages, rows)
    return PageView(page(df, order, number, size), number, pages, rows)
