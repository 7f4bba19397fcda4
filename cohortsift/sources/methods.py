"""Review methods: one JSON file per method, each a list of steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortsift.plans.spec import StepSpec, parse_method


def read_methods(spark: SparkSession, folder: str) -> DataFrame:
    """One row per method file: its name (the file stem) and its text."""
    # Spark gives the name as in a URI, where only the plus sign stands for itself.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return spark.read.text(f"{folder.rstrip('/')}/*.json", wholetext=True).select(
        F.regexp_replace(name, r"\.json$", "").alias("method"),
        F.col("value").alias("body"),
    )


def load_method(spark: SparkSession, folder: str, name: str) -> list[StepSpec]:
    """The steps of the method called ``name``."""
    found = read_methods(spark, folder).filter(F.col("method") == name).first()
    if found is None:
        raise LookupError(f"no method {name!r} in {folder}")
    return parse_method(found["body"])
