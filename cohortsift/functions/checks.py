"""Rules a review job has to meet before it is stored."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: letters of any script, blanks and digits, at least one, nothing else.
# One character class, since Java recurses for each round of a group.
NAME_PATTERN = r"\A[\p{L} 0-9]+\z"


def valid_name(name: Column) -> Column:
    return name.rlike(NAME_PATTERN)


def job_is_complete(name: Column, method: Column, files: Column, samples: Column) -> Column:
    """True when name and method are non-empty and files and samples were chosen."""
    filled = (F.length(name) > 0) & (F.length(method) > 0) & (F.size(files) > 0) & (F.size(samples) > 0)
    return F.coalesce(filled, F.lit(False))
