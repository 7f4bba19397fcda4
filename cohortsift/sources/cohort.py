"""What the runs of a cohort say of each variant, kept per run and bucketed by variant.

A cohort is a folder. ``samples`` numbers the samples in the order they came, from 1; 0 is
the NULL sample. ``calls`` is a table partitioned by run and bucketed by variant, with a row
for each variant of a run and each 64 sample numbers: ``bits`` says which of them carry the
variant, and the counts are of the calls of these samples. Rows merge: bits by OR, counts by sum.
So a run is added from its own calls and the samples' numbers alone, may come again or go, and
what many runs say together needs neither their calls nor a shuffle: all rows of a
variant are in one bucket, and a variant has at most a row for 64 samples in each run.

A word of 64 samples, and not Spark's bitmaps of 32 768, since most variants are in few
samples: such a bitmap takes 4 KB however few bits are set, and long values merge in
whole-stage code.

Which counts are kept is the rule of whoever makes the cohort: conditions on a call, by name.

Defined results: NULL samples count as one, NULL variants as one variant, which joins nothing;
a run without calls is in no result; a run added again stands in place of the former one. One process
at a time may add to a cohort; a run's rows are replaced when all are written.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortsift.functions.sqltext import expression, quoted
from cohortsift.operators.joins import LIGHT_KEY_ROWS, join, profile_keys
from cohortsift.operators.numbering import number_rows
from cohortsift.session import new_shared_path

#: Samples in one row's bits.
WORD = 64
TOTAL, RECURRENCE = "total_count", "run_recurr"
_OWN = ("variant", "word", "bits", "run", "sample", "number", TOTAL, RECURRENCE)


@dataclass(frozen=True)
class Shape:
    """What is fixed when a cohort is made: key columns of its calls, their types, rules, buckets."""

    sample: str
    variant: str
    sample_type: str
    variant_type: str
    rules: dict[str, str]
    buckets: int

    @property
    def counts(self) -> list[str]:
        return [*self.rules, TOTAL]


class Cohort:
    """The cohort kept in the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.shape = Shape(**json.loads(spark.read.text(f"{self.root}/shape").first()["value"]))
        self._table = f"cohort_{hashlib.sha256(self.root.encode()).hexdigest()[:32]}"
        self._register()

    @classmethod
    def create(
        cls,
        spark: SparkSession,
        root: str,
        calls: DataFrame,
        sample: str,
        variant: str,
        rules: Mapping[str, str] | None = None,
        buckets: int = 200,
    ) -> Cohort:
        """An empty cohort for calls like ``calls``; ``rules`` names conditions on a call, as SQL text, to count.

        Joins to the cohort run in ``buckets`` tasks, and each run has as many files.
        """
        clash = {name.lower() for name in rules or ()} & set(_OWN)
        if clash:
            raise ValueError(f"the names {sorted(clash)} are the cohort's own")
        kinds = {c: calls.schema[c].dataType.simpleString() for c in (sample, variant)}
        shape = Shape(sample, variant, kinds[sample], kinds[variant], dict(rules or {}), buckets)
        text = spark.createDataFrame([(json.dumps(asdict(shape)),)], "value string")
        text.coalesce(1).write.text(f"{root.rstrip('/')}/shape")
        return cls(spark, root)

    def _register(self) -> None:
        """Make the table known to this session's catalog, with the runs there are now."""
        counts = "".join(f", {quoted(c)} bigint" for c in self.shape.counts)
        place = f"{self.root}/calls".replace("\\", "\\\\").replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self._table} "
            f"(variant {self.shape.variant_type}, word bigint, bits bigint{counts}, run string) "
            f"USING parquet OPTIONS (partitionOverwriteMode 'dynamic') "  # an overwrite replaces the runs it writes, and last
            f"PARTITIONED BY (run) CLUSTERED BY (variant) INTO {self.shape.buckets} BUCKETS LOCATION '{place}'"
        )
        if self._written():
            self.spark.catalog.recoverPartitions(self._table)

    def _written(self) -> bool:
        schema = self.spark.table(self._table).schema
        try:
            return bool(self.spark.read.schema(schema).parquet(f"{self.root}/calls").inputFiles())
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return False

    # -- runs ---------------------------------------------------------------------

    def add(self, run: str, calls: DataFrame) -> None:
        """Take in a run, or several under one name; earlier runs are not read."""
        if not run:
            raise ValueError("a run needs a name")
        self._check(calls)
        counted = [F.count_if(expression(text)).alias(name) for name, text in self.shape.rules.items()]
        rows = calls.groupBy(F.col(quoted(self.shape.sample)).alias("sample"), F.col(quoted(self.shape.variant)).alias("variant"))
        pairs = self._scratch(rows.agg(*counted, F.count("*").alias(TOTAL)))
        self._number(pairs)
        numbered = join(pairs.alias("p"), self._samples().alias("s"), "p.sample", "s.sample", "left")
        number = F.coalesce("s.number", F.lit(0).cast("long"))
        told = numbered.select(
            "p.variant",
            F.floor(number / WORD).cast("long").alias("word"),
            F.expr(f"shiftleft(1L, cast(pmod(coalesce(s.number, 0), {WORD}) as int))").alias("bits"),
            *[F.col(f"p.{quoted(c)}").alias(c) for c in self.shape.counts],
        )
        self._replace(run, self._merged(told, "variant", "word"))

    def drop(self, run: str) -> None:
        """Leave a run out of all results."""
        self._replace(run, self._rows(None).limit(0).drop("run"))

    def runs(self) -> list[str]:
        return sorted(row["run"] for row in self._rows(None).select("run").distinct().collect())

    def _check(self, calls: DataFrame) -> None:
        wanted = {self.shape.sample: self.shape.sample_type, self.shape.variant: self.shape.variant_type}
        for column, kind in wanted.items():
            found = calls.schema[column].dataType.simpleString()
            if found != kind:
                raise ValueError(f"{column} is {found} and not {kind}, as in the cohort")

    def _scratch(self, df: DataFrame) -> DataFrame:
        path = new_shared_path(self.spark, "run")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _samples(self) -> DataFrame:
        schema = T.StructType.fromDDL(f"number bigint, sample {self.shape.sample_type}")
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/samples")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _number(self, pairs: DataFrame) -> None:
        """Give the samples not seen before the next numbers."""
        known = self._samples()
        there = pairs.select("sample").filter("sample is not null").distinct()
        new = self._scratch(there.join(known.select("sample"), "sample", "left_anti"))
        if new.isEmpty():
            return
        last = known.agg(F.max("number").alias("last")).first()["last"] or 0
        numbered = number_rows(new, [], [F.col("sample")], "place")
        numbered.select((F.col("place") + (last + 1)).alias("number"), "sample").write.mode("append").parquet(f"{self.root}/samples")

    def _replace(self, run: str, rows: DataFrame) -> None:
        """Let ``rows`` be all there is of ``run``; the row without a word keeps the run's place if there are none."""
        columns = self.spark.table(self._table).drop("run").columns
        blank = self.spark.range(1).select(
            *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in columns]
        )
        dealt = rows.select(*map(quoted, columns)).unionByName(blank).repartition(self.shape.buckets, "variant")
        named = dealt.withColumn("run", F.lit(run))
        named.write.insertInto(self._table, overwrite=True)

    # -- results ------------------------------------------------------------------

    def _rows(self, runs: Sequence[str] | None) -> DataFrame:
        rows = self.spark.table(self._table).filter("word is not null")
        return rows if runs is None else rows.filter(F.col("run").isin(list(runs)))

    def _merged(self, rows: DataFrame, *keys: str) -> DataFrame:
        sums = [F.sum(quoted(c)).alias(c) for c in self.shape.counts]
        return rows.groupBy(*keys).agg(F.bit_or("bits").alias("bits"), *sums)

    def facts(self, runs: Sequence[str] | None = None) -> DataFrame:
        """Of each variant of all runs, or of some: the counts, and in how many distinct samples it is."""
        words = self._merged(self._rows(runs), "variant", "word")
        sums = [F.sum(quoted(c)).alias(c) for c in self.shape.counts]
        found = words.groupBy("variant").agg(*sums, F.sum(F.bit_count("bits")).alias(RECURRENCE))
        return found.withColumnRenamed("variant", self.shape.variant)

    def recurrence(self, runs: Sequence[str] | None = None, name: str = RECURRENCE) -> DataFrame:
        return self.facts(runs).select(quoted(self.shape.variant), F.col(RECURRENCE).alias(name))

    def pairs(self, runs: Sequence[str] | None = None) -> DataFrame:
        """The distinct pairs of sample and variant."""
        words = self._rows(runs).groupBy("variant", "word").agg(F.bit_or("bits").alias("bits"))
        there = F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda i: F.getbit("bits", i) == 1)
        carried = words.select("variant", "word", F.explode(there).alias("bit"))
        carried = carried.select("variant", (F.col("word") * WORD + F.col("bit")).alias("number"))
        named = join(carried.alias("c"), self._samples().alias("s"), "c.number", "s.number", "left")
        return named.select(F.col("s.sample").alias(self.shape.sample), F.col("c.variant").alias(self.shape.variant))

    def joined(
        self,
        df: DataFrame,
        on: str,
        runs: Sequence[str] | None = None,
        how: str = "inner",
        light_rows: int = LIGHT_KEY_ROWS,
    ) -> DataFrame:
        """``df`` and, in further columns, the facts of the variant in its column ``on``; ``how`` is inner or left.

        Only rows of ``df`` are shuffled, to the buckets. Rows of its heavy variants, and of none, stay
        where they are: the facts of these are a row each, as many as there are heavy keys, and broadcast.
        """
        if how not in ("inner", "left"):
            raise ValueError(f"cannot join {how}")
        found = [*self.shape.counts, RECURRENCE]
        clash = {c.lower() for c in df.columns} & {c.lower() for c in found}
        if clash:
            raise ValueError(f"the columns {sorted(clash)} are there already")
        key = "__variant" + "_" * max(map(len, df.columns))  # no name of df is as long
        facts = self.facts(runs).withColumnRenamed(self.shape.variant, key)
        heavy = list(profile_keys(df, on, light_rows).cells)
        same = F.col(on) == F.col(key)
        apart = self._apart(F.col(on), heavy)
        rows = df.filter(~apart).join(facts, same, how)
        if heavy or how == "left":
            few = facts.filter(F.col(key).isin(heavy) if heavy else F.lit(False))
            rows = rows.union(df.filter(apart).join(F.broadcast(few), same, how))
        return rows.drop(key)

    def _apart(self, key: Column, heavy: list) -> Column:
        return F.coalesce(key.isin(heavy), F.lit(True)) if heavy else key.isNull()
