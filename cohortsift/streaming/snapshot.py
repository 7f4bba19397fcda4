"""The state of an event dataset as a snapshot that a streaming query advances.

The snapshot holds the fold's intermediate states, dealt into a fixed number of
buckets by the first key. :meth:`FoldedLog.advance` runs a streaming query over the event
folder until it has read all files there are: each batch is folded, merged with the
buckets it touches, and those are written anew under the next version; other buckets
stay as they are. A version counts once its commit is there, one file that names the
buckets written and the event files taken in. Since states merge in any order and with the same
events again, a batch that is run twice changes nothing, and late events find their place.

A look reads the newest version of the buckets it needs, and the event files no
commit names; those are found by comparing the folder's listing, which Spark makes
for any scan, with the commits. One process at a time may advance a snapshot; anybody may look.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsift.operators.folds import Fold
from cohortsift.sources.review_log import ReviewLog

#: Parts of a snapshot; a look at one key reads one of them.
BUCKETS = 64
_COMMIT = "version bigint, bucket int, path string"


def place_of(path: str) -> str:
    """A file's path as both listings and rows give it: without scheme and escapes."""
    plain = unquote(path)
    return "/" + plain.split(":", 1)[-1].lstrip("/")


@dataclass(frozen=True)
class Commits:
    """The newest version of each bucket, and the event files that are in the snapshot."""

    heads: dict[int, int]
    covered: frozenset[str]

    @property
    def version(self) -> int:
        return max(self.heads.values(), default=-1)


class FoldedLog:
    """The present state of the events ``name`` of a log under ``fold``."""

    def __init__(self, log: ReviewLog, name: str, fold: Fold, label: str | None = None) -> None:
        """``label`` names the snapshot where events have more than one fold."""
        self.log, self.name, self.fold = log, name, fold
        self.spark = log.spark
        self.root = f"{log.root}/snapshots/{label or name}"

    # -- looking ----------------------------------------------------------------

    def now(self, key: str | None = None) -> DataFrame:
        """What the fold presents now, of one value of its first key if ``key`` is given."""
        return self.fold.present(self.state(key))

    def state(self, key: str | None = None) -> DataFrame:
        """The states of all keys: of the snapshot, and of the events it lacks."""
        commits = self.commits()
        events = self.log.events_of(self.name, key)
        if not commits.heads:
            return self.fold.of(self._own(events, key))
        newer = self._newer(events, commits)
        known = self._own(self._buckets(commits, None if key is None else [self._bucket_of(key)]), key)
        if newer is None:
            return known
        return self.fold.merged(known.unionByName(self.fold.of(self._own(newer, key))))

    def _own(self, rows: DataFrame, key: str | None) -> DataFrame:
        return rows if key is None else rows.filter(F.col(self.fold.keys[0]) == key)

    def _newer(self, events: DataFrame, commits: Commits) -> DataFrame | None:
        """The events of files that no commit names; None if there are none."""
        files = [f for f in events.inputFiles() if place_of(f) not in commits.covered]
        if not files:
            return None
        reader = self.spark.read.option("basePath", f"{self.log.root}/{self.name}")
        return reader.schema(events.schema).parquet(*map(unquote, files))

    def commits(self) -> Commits:
        """The commits there are; none if the snapshot was never advanced."""
        try:
            rows = self.spark.read.schema(_COMMIT).parquet(f"{self.root}/commits")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return Commits({}, frozenset())
        heads: dict[int, int] = {}
        covered = set()
        for row in rows.collect():  # a row for each event file and each bucket written
            if row["path"] is not None:
                covered.add(row["path"])
            else:
                heads[row["bucket"]] = max(row["version"], heads.get(row["bucket"], -1))
        return Commits(heads, frozenset(covered))

    def _buckets(self, commits: Commits, wanted: list[int] | None = None) -> DataFrame:
        """The states in some buckets, or in all."""
        heads = {b: v for b, v in commits.heads.items() if wanted is None or b in wanted}
        state = self.fold.of(self.spark.createDataFrame([], self.log.events_of(self.name).schema)).schema
        if not heads:
            return self.spark.createDataFrame([], state)
        return self.spark.read.schema(state).parquet(*(f"{self.root}/version={v}/bucket={b}" for b, v in sorted(heads.items())))

    def _bucket(self, column: Column) -> Column:
        return (F.crc32(column) % BUCKETS).cast("int")

    def _bucket_of(self, key: str) -> int:
        return zlib.crc32(key.encode()) % BUCKETS

    # -- advancing --------------------------------------------------------------

    def advance(self, files_at_once: int | None = None) -> None:
        """Take all event files into the snapshot that are not in it; returns when that is done."""
        schema = self.log.events_of(self.name).schema
        source = self.spark.readStream.schema(schema)
        if files_at_once is not None:
            source = source.option("maxFilesPerTrigger", files_at_once)
        try:
            stream = source.parquet(f"{self.log.root}/{self.name}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return  # nothing was appended yet
        writer = stream.select("*", F.col("_metadata.file_path").alias("_path")).writeStream
        writer = writer.option("checkpointLocation", f"{self.root}/progress").trigger(availableNow=True)
        writer.foreachBatch(self.take_in).start().awaitTermination()

    def take_in(self, batch: DataFrame, _number: int) -> None:
        """Merge a batch of events, with the ``_path`` of each, into the snapshot as its next version."""
        commits = self.commits()
        version = commits.version + 1
        key = F.col(self.fold.keys[0])
        named = batch.select(self._bucket(key).alias("bucket"), "_path").groupBy().agg(
            F.collect_set("bucket").alias("buckets"), F.collect_set("_path").alias("paths")
        ).first()  # at most BUCKETS numbers, and the batch's files
        touched = sorted(named["buckets"])
        if not touched:
            return
        merged = self.fold.merged(self._buckets(commits, touched).unionByName(self.fold.of(batch.drop("_path"))))
        dealt = merged.withColumn("bucket", self._bucket(key)).hint("rebalance", "bucket")
        # A version without a commit was left by a run that failed, so it may be written over.
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/version={version}")
        rows = [(version, b, None) for b in touched] + [(version, None, place_of(p)) for p in named["paths"]]
        self.spark.createDataFrame(rows, _COMMIT).coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
