"""Which files cannot hold a text: signatures of three characters each, kept per file and column.

An index is a dataset. A signature has ``SIZE`` bits, of which each run of three characters of a
lower-cased value sets one; it is kept as rows (file, column, word, bits) of 64 bits, sorted by word,
so that a look reads the words the wanted text needs. A file whose signature lacks a bit of the text
cannot hold it and is not read; the rest is searched as ever, so no row is lost or added by a bit
set by chance. Building it is one pass over the columns, in built-in functions, merged before the shuffle.

A regular expression counts by the characters that stand in every match of it, if it is made of plain
characters, dots, ``^``, ``$`` and ``* + ?``; any other is searched in all files, as is a text of under
three characters. Files that were never taken are always read. A file that is replaced must be taken again.

Defined results: those of ``search``, whatever the index holds.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortsift.functions.display import shown_text
from cohortsift.operators.search import search
from cohortsift.streaming.snapshot import place_of

#: Bits of a signature, and characters of a run.
SIZE, RUN = 1 << 16, 3
_ROW = "file string, column string, word bigint, bits bigint, look int"
#: The word of a row that only says that the file was taken.
_TAKEN = -1
# Letters that a regular expression without regard to case finds in signs lower() leaves apart: long s, Kelvin, dotless i.
_FOLDED = "sSkKiI"


def _runs(text: Column) -> Column:
    """The bit of each run of characters of a text; none of NULL and of shorter ones."""
    signs = F.split(F.lower(text), "")
    starts = F.when(F.size(signs) >= RUN, F.sequence(F.lit(1), F.size(signs) - (RUN - 1)))
    run = F.transform(starts, lambda i: F.array_join(F.slice(signs, i, F.lit(RUN)), ""))
    return F.array_distinct(F.transform(run, lambda r: F.pmod(F.xxhash64(r), F.lit(SIZE))))


def _words(bit: str) -> list[Column]:
    return [F.expr(f"{bit} div 64").alias("word"), F.expr(f"shiftleft(1L, cast({bit} % 64 as int))").alias("bits")]


def required(pattern: str) -> list[str]:
    """Texts that stand in every match of a regular expression, whatever the case; none if it is not a plain one."""
    if re.search(r"[|()\[\]{}\\]", pattern) or not pattern.isascii():
        return []
    # A sign before * or ? may be missing; one before + may be repeated.
    parts = re.sub(r".[*?][+?]?|[.^$+]", "\0", pattern, flags=re.DOTALL)
    return [run for run in re.split(f"[\0{_FOLDED}]", parts) if len(run) >= RUN]


class SearchIndex:
    """The index kept in the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def take(self, df: DataFrame, columns: Sequence[str] | None = None, *, raw: bool = False) -> None:
        """Index the files ``df`` scans, by columns as displayed, or as stored when ``raw``."""
        fields = [f for f in df.schema.fields if columns is None or f.name in columns]
        texts = [F.struct(F.lit(_key(f.name, raw)).alias("column"), _runs(shown_text(f, raw)).alias("runs")) for f in fields]
        rows = df.select(F.col("_metadata.file_path").alias("file"), F.explode(F.array(*texts)).alias("own"))
        none = F.array().cast("array<bigint>")
        # A row for each run, and one that says that the file was taken.
        bits = F.concat(F.coalesce("own.runs", none), F.array(F.lit(_TAKEN * 64).cast("bigint")))
        told = rows.select("file", "own.column", F.explode(bits).alias("bit"))
        found = told.select("file", "column", *_words("bit")).groupBy("file", "column", "word").agg(F.bit_or("bits").alias("bits"))
        looks = self._rows().agg(F.max("look").alias("last")).first()["last"] or 0
        sorted_rows = found.withColumn("look", F.lit(looks + 1)).repartitionByRange("word", "file").sortWithinPartitions("word")
        sorted_rows.write.mode("append").parquet(f"{self.root}/signatures")

    def _rows(self) -> DataFrame:
        schema = T.StructType.fromDDL(_ROW)
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/signatures")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def search(
        self, df: DataFrame, text: str, columns: Sequence[str] | None = None, *, regexp: bool = False, raw: bool = False
    ) -> DataFrame:
        """What ``search`` finds in a scan of files, without reading those that cannot hold it."""
        wanted = required(text) if regexp else [text]
        kept = df
        if any(len(t) >= RUN for t in wanted):
            names = df.columns if columns is None else [c for c in df.columns if c in columns]
            kept = self._left(df, wanted, [_key(c, raw) for c in names])
        return search(kept, text, columns, regexp=regexp, raw=raw)

    def _left(self, df: DataFrame, wanted: list[str], columns: list[str]) -> DataFrame:
        out = self._ruled_out(wanted, columns)
        files = df.inputFiles()
        left = [file for file in files if place_of(file) not in out]
        if len(left) == len(files):
            return df
        # Partition columns are found in paths below the table's own.
        partition = re.compile("/(?:" + "|".join(map(re.escape, df.columns)) + ")=")
        bases = {unquote(partition.split(file, 1)[0]) if partition.search(file) else None for file in left}
        if len(bases) > 1:
            return df
        reader = self.spark.read.schema(df.schema)
        for base in bases - {None}:
            reader = reader.option("basePath", base)
        return reader.parquet(*map(unquote, left)) if left else df.limit(0)

    def _ruled_out(self, wanted: list[str], columns: list[str]) -> set[str]:
        """The files whose signatures of all ``columns`` lack a bit."""
        texts = self.spark.createDataFrame([(text,) for text in wanted], "text string")
        bits = texts.select(F.explode(_runs(F.col("text"))).alias("bit")).select(*_words("bit"))
        # As long as the text at most, and looked up in the scan of signatures.
        needed = {row["word"]: row["bits"] for row in bits.groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()}
        plan = self.spark.createDataFrame([(w, b) for w, b in needed.items()], "needed_word bigint, needed bigint")
        rows = self._rows().filter(F.col("column").isin(columns) & F.col("word").isin([_TAKEN, *needed]))
        met = rows.join(F.broadcast(plan), F.col("word") == F.col("needed_word"), "left")
        whole = F.count_if(F.col("bits").bitwiseAND(F.col("needed")) == F.col("needed"))
        by_look = met.groupBy("file", "column", "look").agg(whole.alias("whole"))
        last = by_look.groupBy("file", "column").agg(F.max_by("whole", "look").alias("whole"))
        by_file = last.groupBy("file").agg(F.max("whole").alias("best"), F.count("*").alias("columns"))
        none = by_file.filter((F.col("best") < len(needed)) & (F.col("columns") == len(columns)))
        return {place_of(row["file"]) for row in none.select("file").collect()}  # of files that df lists


def _key(column: str, raw: bool) -> str:
    return f"{column} as stored" if raw else f"{column} as shown"
