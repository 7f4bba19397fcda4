"""How often values recur: distinct samples, and samples per variant."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortsift.functions.sqltext import quoted
from cohortsift.operators.joins import join, profile_keys
from cohortsift.plans.spec import MAIN


def distinct_values(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct combinations of ``columns``; NULL counts as a value."""
    return df.select(*[F.col(c) for c in columns]).distinct()


def run_recurrence(df: DataFrame, sample: str, variant: str, name: str = "run_recurr") -> DataFrame:
    """In how many distinct samples each variant occurs, the NULL sample included.

    Repeats are dropped before the shuffle and spread over sample and variant, so
    a variant found in most rows is counted in many tasks first.
    """
    return distinct_values(df, sample, variant).groupBy(quoted(variant)).agg(F.count("*").alias(name))


def with_run_recurrence(
    df: DataFrame, source: DataFrame, sample: str, variant: str, name: str = "run_recurr"
) -> DataFrame:
    """``df`` (alias ``main_table``) joined to the recurrence found in ``source``, alias ``rec``."""
    counts = run_recurrence(source, sample, variant, name).alias("rec")
    key = f"{MAIN}.{quoted(variant)}"
    # The key is as heavy in df as in the calls it came from, which are cheaper to scan.
    profile = partial(profile_keys, source.alias(MAIN), key)
    return join(df, counts, key, f"rec.{quoted(variant)}", left_profile=profile)
