"""Values as a reviewer sees them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortsift.functions.sqltext import quoted

# How flags, timestamps and lists are shown, and the column whose
# entries are shown as file stems.
YES, NO = "Yes", "No"
STAMP_FORMAT = "dd/MM/yyyy HH:mm:ss"
LIST_SEPARATOR = ", "
PATH_COLUMN = "parquet_files"


def yes_no(flag: Column) -> Column:
    return F.when(flag, YES).when(~flag, NO)


def stamp_text(stamp: Column) -> Column:
    return F.date_format(stamp, STAMP_FORMAT)


def zoneless_stamp_text(stamp: Column) -> Column:
    """``STAMP_FORMAT`` without a detour by the session's time zone.

    ``date_format`` would move hours that zone skips in spring.
    """
    return F.regexp_replace(stamp.cast("string"), r"^(.{4,6})-(..)-(..) (.{8}).*$", "$3/$2/$1 $4")


def number_text(value: Column) -> Column:
    """A float or double in plain decimal signs: ``12345678.5``, not ``1.23456785E7``.

    Numbers below 1e-6 or from 1e16 on keep the short form with an exponent.
    """
    text = value.cast("string")
    size = F.abs(value.cast("double"))
    plain = F.when((size >= 1e-6) & (size < 1e16), text).try_cast("decimal(38,20)").cast("string")
    trimmed = F.regexp_replace(plain, r"(\.\d+?)0+$", "$1")
    return F.when(F.contains(text, F.lit("E")), F.coalesce(trimmed, text)).otherwise(text)


def path_stem(path: Column) -> Column:
    """File name without its last suffix: ``a/run.1.parquet`` gives ``run.1``."""
    name = F.regexp_extract(path, "([^/]*)/*$", 1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]+$", "")


def path_stems(paths: Column) -> Column:
    return F.array_join(F.transform(paths, path_stem), LIST_SEPARATOR)


def joined(values: Column) -> Column:
    return F.array_join(values, LIST_SEPARATOR)


def shown(field: T.StructField) -> Column:
    """The display value of one column; types without a rule pass through."""
    value = F.col(quoted(field.name))
    kind = field.dataType
    if isinstance(kind, T.BooleanType):
        value = yes_no(value)
    elif isinstance(kind, T.TimestampType):
        value = stamp_text(value)
    elif isinstance(kind, T.TimestampNTZType):
        value = zoneless_stamp_text(value)
    elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
        value = path_stems(value) if field.name == PATH_COLUMN else joined(value)
    return value.alias(field.name)


def shown_text(field: T.StructField, raw: bool = False) -> Column:
    """The display value as text, or the stored value as text when ``raw``."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    value = F.col(quoted(field.name))
    if raw:
        return F.to_json(value) if isinstance(field.dataType, nested) else value.cast("string")
    if isinstance(field.dataType, nested) and not (
        isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StringType)
    ):
        return F.to_json(value)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType)):
        return number_text(value)
    return shown(field).cast("string")


def display(df: DataFrame) -> DataFrame:
    return df.select(*[shown(field) for field in df.schema.fields])
