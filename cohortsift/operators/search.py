"""Case-insensitive search over the columns of a table as it is displayed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsift.functions.display import shown_text


def search(
    df: DataFrame, text: str, columns: Sequence[str] | None = None, *, regexp: bool = False, raw: bool = False
) -> DataFrame:
    """Rows where some column holds ``text``; an empty text keeps all rows.

    Columns are compared as displayed, or as stored when ``raw``. With ``regexp``
    the text is a Java regular expression to be found anywhere in the value.
    """
    if not text:
        return df
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    if columns is not None and len(fields) < len(set(columns)):
        raise ValueError(f"no columns {sorted(set(columns) - {f.name for f in fields})}")

    def holds(value: Column) -> Column:
        if regexp:
            return value.rlike("(?iu)" + text)
        return F.contains(F.lower(value), F.lower(F.lit(text)))

    return df.filter(reduce(or_, [holds(shown_text(f, raw)) for f in fields]))
