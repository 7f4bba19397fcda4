"""CSV export of a report."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortsift.functions.sqltext import quoted


def flatten_for_csv(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, so that a list's entries stay apart and NULL among them stays."""
    twice = [name for name, n in Counter(name.lower() for name in df.columns).items() if n > 1]
    if twice:
        raise ValueError(f"a CSV file cannot have the columns {twice} twice; give one an alias")
    return df.select(*[_flat(field) for field in df.schema.fields])


def _flat(field: T.StructField) -> F.Column:
    value = F.col(quoted(field.name))
    kind = field.dataType
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        value = F.to_json(value)
    elif isinstance(kind, T.BinaryType):
        value = F.base64(value)
    return value.alias(field.name)


def export_csv(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Write ``df`` as CSV files with a header, one per task, into ``folder``."""
    (
        flatten_for_csv(df)
        .write.mode(mode)
        .options(header=True, quote='"', escape='"', emptyValue='""', nullValue="")
        .csv(folder)
    )
