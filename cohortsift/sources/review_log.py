"""The review log: append-only Parquet datasets of job and decision events.

Nothing is updated in place. A change is one more event; the present state is
what :mod:`cohortsift.operators.folds` makes of all events. Each append is one
Spark write and so appears whole or not at all, but plain Parquet gives no order
between writers: events are ordered by the instant ``at``, then by ``event_id``;
``ts`` is the writer's wall clock, for display.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The names of the columns that describe jobs and decisions.
JOB_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("kind", T.StringType()),
        T.StructField("table_uuid", T.StringType()),
        T.StructField("parquet_files", T.ArrayType(T.StringType())),
        T.StructField("sample_names", T.ArrayType(T.StringType())),
        T.StructField("username", T.StringType()),
        T.StructField("validation_name", T.StringType()),
        T.StructField("validation_method", T.StringType()),
        T.StructField("last_step", T.IntegerType()),
        T.StructField("completed", T.BooleanType()),
    ]
)

DECISION_EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("at", T.TimestampType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("kind", T.StringType()),
        T.StructField("validation_hash", T.LongType()),
        T.StructField("sample_name", T.StringType()),
        T.StructField("run_name", T.StringType()),
        T.StructField("transcript_ID", T.StringType()),
        T.StructField("accepted", T.BooleanType()),
        T.StructField("tags", T.ArrayType(T.StringType())),
        T.StructField("comment", T.StringType()),
        T.StructField("username", T.StringType()),
        # Who knew of what (operators/causal.py); NULL where the writer does not say.
        T.StructField("writer", T.StringType()),
        T.StructField("turn", T.LongType()),
        T.StructField("seen", T.MapType(T.StringType(), T.LongType())),
        T.StructField("table_uuid", T.StringType()),
    ]
)

# Event kinds.
CREATED, STEP, COMPLETED, DELETED = "created", "step", "completed", "deleted"
DECISION, REMARK = "decision", "comment"

_PARTITIONS = {"job_events": [], "decision_events": ["table_uuid"]}
_SCHEMAS = {"job_events": JOB_EVENT, "decision_events": DECISION_EVENT}
_OPTIONAL = ("writer", "turn", "seen")
# Keys that a partition's folder is named by as they are.
_PLAIN_KEY = re.compile(r"[A-Za-z0-9_.-]+")


class ReviewLog:
    """The two event datasets below ``root``; one that was never appended to is empty."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def job_events(self) -> DataFrame:
        return self._read("job_events")

    def decision_events(self) -> DataFrame:
        return self._read("decision_events")

    def append_job_events(self, events: DataFrame) -> None:
        self._append(events, "job_events")

    def append_decision_events(self, events: DataFrame) -> None:
        """Append any number of decisions, in few files per ``table_uuid``."""
        self._append(_rebalanced(events, "decision_events"), "decision_events")

    def record(self, name: str, rows: Iterable[Mapping[str, Any]]) -> None:
        """Append a handful of events from the caller's values."""
        self._append(self.events(name, rows), name)

    def compact(self, new_root: str) -> ReviewLog:
        """Copy the log to an empty place with few large files per partition.

        Readers keep the old place until they are pointed to the new one, so no
        reader ever sees half a log. What is appended to the old place meanwhile is
        fetched by :meth:`take_over`, once its writers have moved.
        """
        for name in _SCHEMAS:
            whole = _rebalanced(self._read(name), name)
            self._write(whole, name, new_root.rstrip("/"), "errorifexists")
        return ReviewLog(self.spark, new_root)

    def take_over(self, old: ReviewLog) -> None:
        """Append the events of ``old`` that this log lacks; a second call finds none."""
        for name in _SCHEMAS:
            known = self._read(name).select("event_id")
            missing = old._read(name).join(known, "event_id", "left_anti")
            self._append(_rebalanced(missing, name), name)

    def events(self, name: str, rows: Iterable[Mapping[str, Any]]) -> DataFrame:
        """Events from the caller's values, stamped when written. Meant for a handful."""
        schema = _SCHEMAS[name]
        filled = []
        for row in rows:
            unknown = set(row) - set(schema.names)
            if unknown:
                raise ValueError(f"unknown columns {sorted(unknown)}")
            filled.append(tuple({"event_id": next_event_id(), **row}.get(name) for name in schema.names))
        df = self.spark.createDataFrame(filled, schema).coalesce(1)
        # One clock reading per write: Spark fixes it when the write is planned.
        stamped = df.withColumn("ts", F.coalesce("ts", F.localtimestamp()))
        return stamped.withColumn("at", F.coalesce("at", F.current_timestamp()))

    def _append(self, events: DataFrame, name: str) -> None:
        if "at" not in events.columns:
            events = events.withColumn("at", F.col("ts").cast("timestamp"))
        events = events.select("*", *(F.lit(None).alias(c) for c in _OPTIONAL if name == "decision_events" and c not in events.columns))
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in _SCHEMAS[name].fields]
        self._write(events.select(*columns), name, self.root, "append")

    def _write(self, df: DataFrame, name: str, root: str, mode: str) -> None:
        df.write.mode(mode).partitionBy(*_PARTITIONS[name]).parquet(f"{root}/{name}")

    def _read(self, name: str) -> DataFrame:
        return _or_empty(self.spark, self.spark.read, f"{self.root}/{name}", _SCHEMAS[name])

    def events_of(self, name: str, table_uuid: str | None = None) -> DataFrame:
        """The events of a dataset, of one job only if it is given.

        Where the dataset has a folder for each job, that folder alone is listed and read.
        """
        if table_uuid is None:
            return self._read(name)
        if not _PARTITIONS[name] or not _PLAIN_KEY.fullmatch(table_uuid):
            return self._read(name).filter(F.col("table_uuid") == table_uuid)
        base = f"{self.root}/{name}"
        reader = self.spark.read.option("basePath", base)
        return _or_empty(self.spark, reader, f"{base}/table_uuid={table_uuid}", _SCHEMAS[name])


def _or_empty(spark: SparkSession, reader: DataFrameReader, path: str, schema: T.StructType) -> DataFrame:
    """What is stored at ``path``; no rows if there is nothing."""
    try:
        return reader.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _rebalanced(events: DataFrame, name: str) -> DataFrame:
    """Bring each partition's events together; AQE splits what is too large for one file."""
    return events.hint("rebalance", *_PARTITIONS[name])


def next_event_id() -> str:
    """Unique, and later ids of one writer sort after earlier ones."""
    return f"{time.time_ns():020d}-{uuid.uuid4().hex}"


def new_job_key() -> str:
    """``validation_`` and a fresh uuid."""
    return f"validation_{uuid.uuid4()}"
