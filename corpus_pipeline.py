"""From raw documents to packed training sequences: five stages, each written and read again.

Every stage takes (spark, docs, folder) and returns the columns of ``docs``, but for the last,
which returns the pieces of the documents and their places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortsift.llm import language, mixing, packing, pii
from cohortsift.llm.near_copies import without_near_copies
from cohortsift.llm.shared import ship, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _row(docs: DataFrame) -> Column:
    """The columns of a document as one, so that what stages add cannot clash with their names."""
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Without the documents that language identification rejects."""
    ship(spark)
    model = language.fit(docs)
    return docs.select(_row(docs), model.column().alias("language")).where(~F.col("language.rejected")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group of near copies: five words, eight tenths alike."""
    ship(spark)
    return without_near_copies(docs, words=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """With personal data replaced by its kind; ``n_chars`` follows where a text changed."""
    ship(spark)
    clean = docs.select(_row(docs), pii.redacted().alias("clean"))
    new = {"text": F.col("clean")}
    if "n_chars" in docs.columns:
        changed = ~F.col("clean").eqNullSafe(F.col("row.text"))
        new["n_chars"] = F.when(changed, F.length("clean").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return clean.select(*(new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns))


def mixed_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """In the order of the mix; sources with fewer documents than their weight asks for recur."""
    return mixing.in_order(mixing.mix(docs, exponent=0.8, block=8))


def packed_sequences(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.packed(docs, size=2048, end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixed_sources", mixed_sources),
    ("packed_sequences", packed_sequences),
]

#: Language identification and near copies are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
