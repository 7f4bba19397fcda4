"""Projection, filter and order of a relation of aliased tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsift.functions.sqltext import expression, qualified, quoted
from cohortsift.operators.joins import join
from cohortsift.operators.rows import sort_all
from cohortsift.plans.spec import FieldSpec, FilterNode, OrderKey

# Up to this many samples a filter lists them; more are joined as a table, with the same result.
LISTED_SAMPLES = 1000


def field_column(item: FieldSpec) -> Column:
    if item.value is not None:
        column = expression(item.value)
    elif item.is_expression:
        table = quoted(item.table) if item.table else ""
        column = expression(item.name.replace("{table}", table))
    else:
        column = qualified(item.table, item.name)
    return column.alias(item.output)


def project(df: DataFrame, fields: Sequence[FieldSpec]) -> DataFrame:
    return df.select(*[field_column(f) for f in fields])


def condition(node: FilterNode) -> Column | None:
    """The tree as one boolean column, or None when it restricts nothing."""
    if not node:
        return None
    if node.kind == "LEAF":
        return expression(node.text)
    parts = [c for c in map(condition, node.children) if c is not None]
    return reduce(and_ if node.kind == "AND" else or_, parts)


def where(df: DataFrame, node: FilterNode) -> DataFrame:
    wanted = condition(node)
    return df if wanted is None else df.filter(wanted)


def order_columns(keys: Iterable[OrderKey], backwards: bool = False) -> list[Column]:
    """Sort columns with NULL after every value, or the exact reverse of that."""
    columns = []
    for key in keys:
        column = F.col(key.field)
        if not backwards:
            columns.append(column.desc_nulls_last() if key.descending else column.asc_nulls_last())
        else:
            columns.append(column.asc_nulls_first() if key.descending else column.desc_nulls_first())
    return columns


def order(df: DataFrame, keys: Sequence[OrderKey]) -> DataFrame:
    return sort_all(df, order_columns(keys)) if keys else df


def restrict(df: DataFrame, column: str, chosen: Sequence[str] | DataFrame) -> DataFrame:
    """Rows whose ``column`` is among the chosen values; NULL never is.

    Listed values are read as the column's type, whatever type they come in; one
    that cannot be is an error.
    """
    if not isinstance(chosen, DataFrame):
        kind = df.select(F.col(column)).schema[0].dataType
        texts = list(dict.fromkeys(str(value) for value in chosen if value is not None))
        if len(texts) <= LISTED_SAMPLES:
            return df.filter(F.col(column).isin([F.lit(t).cast(kind) for t in texts]))
        listed = df.sparkSession.createDataFrame([(t,) for t in texts], "chosen string")
        chosen = listed.select(F.col("chosen").cast(kind).alias("chosen"))
    picks = chosen.select(F.col(quoted(chosen.columns[0])).alias("chosen")).alias("chosen_values")
    return join(df, picks, column, "chosen_values.chosen", "left_semi")
