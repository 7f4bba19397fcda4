"""The life of a review job: choose, create, step through, decide, report, export."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cohortsift.functions.checks import job_is_complete, valid_name
from cohortsift.operators import causal, folds
from cohortsift.operators.recurrence import distinct_values
from cohortsift.operators.relational import restrict
from cohortsift.operators.search import search
from cohortsift.plans.spec import MAIN, StepSpec
from cohortsift.plans.steps import SAMPLE_COLUMN, decision_report, run_step
from cohortsift.sources import review_log
from cohortsift.sources.csv_report import export_csv
from cohortsift.sources.lake import Lake
from cohortsift.sources.review_log import ReviewLog
from cohortsift.streaming.snapshot import FoldedLog

# The columns of the reviewed files and of the decisions in a report.
REPORT_FIELDS = (
    "validation_hash",
    "sample_name",
    "run_name",
    "chromosome",
    "position",
    "reference",
    "alternate",
    "snpeff_Gene_Name",
)
REPORT_VERDICT = ("accepted", "tags")


class ReviewStore:
    """Review jobs kept in a log below ``root``, over the tables of ``lake``."""

    def __init__(
        self, spark: SparkSession, root: str, lake: Lake, report_fields: Sequence[str] = REPORT_FIELDS
    ) -> None:
        """``report_fields`` are the columns of the reviewed files that a report shows."""
        self.spark = spark
        self.lake = lake
        self.report_fields = tuple(report_fields)
        self.log = ReviewLog(spark, root)
        self.job_state = FoldedLog(self.log, "job_events", folds.JOBS)
        self.decision_state = FoldedLog(self.log, "decision_events", folds.DECISIONS)
        self.head_state = FoldedLog(self.log, "decision_events", causal.HEADS, "decision_heads")

    # -- jobs -----------------------------------------------------------------

    def advance(self) -> None:
        """Take what was appended lately into the snapshots, which later looks start from."""
        self.job_state.advance()
        self.decision_state.advance()
        self.head_state.advance()

    def jobs(self) -> DataFrame:
        return self.job_state.now()

    def job(self, table_uuid: str) -> Row:
        """The one job with this key."""
        found = self.job_state.now(table_uuid).first()
        if found is None:
            raise LookupError(f"no review job {table_uuid!r}")
        return found

    def sample_choices(self, files: Sequence[str], text: str = "") -> DataFrame:
        """The distinct samples of the files, those holding ``text`` only."""
        return search(distinct_values(self.lake.main(files), SAMPLE_COLUMN), text)

    def new_job(
        self, name: str, username: str, files: Sequence[str], samples: Sequence[str], method: str
    ) -> str:
        """Store a job and return its key."""
        event = {
            "kind": review_log.CREATED,
            "table_uuid": review_log.new_job_key(),
            "parquet_files": list(files),
            "sample_names": list(samples),
            "username": username,
            "validation_name": name,
            "validation_method": method,
            "last_step": 0,
            "completed": False,
        }
        events = self.log.events("job_events", [event])
        columns = [F.col(c) for c in ("validation_name", "validation_method", "parquet_files", "sample_names")]
        checked = events.select(job_is_complete(*columns).alias("complete"), valid_name(columns[0]).alias("named"))
        verdict = checked.first()
        if not verdict["complete"]:
            raise ValueError("a job needs a name, a method, files and samples")
        if not verdict["named"]:
            raise ValueError("a job name is made of letters, digits and blanks")
        self.log.append_job_events(events)
        return event["table_uuid"]

    def record_step(self, table_uuid: str, step: int) -> None:
        self._job_event(table_uuid, review_log.STEP, last_step=step)

    def complete(self, table_uuid: str, step_count: int) -> None:
        self._job_event(table_uuid, review_log.COMPLETED, last_step=step_count, completed=True)

    def delete(self, table_uuid: str) -> None:
        self._job_event(table_uuid, review_log.DELETED)

    def _job_event(self, table_uuid: str, kind: str, **values: Any) -> None:
        self.log.record("job_events", [{"kind": kind, "table_uuid": table_uuid, **values}])

    # -- decisions --------------------------------------------------------------

    def decide(self, table_uuid: str, rows: Iterable[Mapping[str, Any]]) -> None:
        """Record decisions: ``validation_hash``, ``accepted``, ``tags`` and so on."""
        events = [{"kind": review_log.DECISION, "table_uuid": table_uuid, **row} for row in rows]
        self.log.record("decision_events", events)

    def session(self, table_uuid: str, username: str) -> ReviewSession:
        """Somebody at work on a job, whose decisions say what they knew of."""
        return ReviewSession(self, table_uuid, username)

    def settled(self, table_uuid: str) -> DataFrame:
        """Decisions of one job by who knew of which; ``conflicting`` where some were made at once and differ."""
        return causal.settled(self.head_state.now(table_uuid)).drop("table_uuid")

    def conflicts(self, table_uuid: str) -> DataFrame:
        """The decisions of one job that were made at once and differ, a row each."""
        return causal.conflicts(self.head_state.now(table_uuid)).drop("table_uuid")

    def comment(self, table_uuid: str, validation_hash: int, text: str, username: str) -> None:
        event = {
            "kind": review_log.REMARK,
            "table_uuid": table_uuid,
            "validation_hash": validation_hash,
            "comment": text,
            "username": username,
        }
        self.log.record("decision_events", [event])

    def decisions(self, table_uuid: str) -> DataFrame:
        """Present decisions of one job; only its part of the snapshot and of the log is read."""
        return self.decision_state.now(table_uuid)

    def comments(self, table_uuid: str) -> DataFrame:
        """All comments of one job, a row each."""
        return folds.comments(self._decision_events(table_uuid))

    def _decision_events(self, table_uuid: str) -> DataFrame:
        return self.log.events_of("decision_events", table_uuid)

    # -- steps ------------------------------------------------------------------

    def show_step(self, table_uuid: str, steps: Sequence[StepSpec], number: int, **options: Any) -> DataFrame:
        return self._step(self.job(table_uuid), steps, number, **options)

    def resume(self, table_uuid: str, steps: Sequence[StepSpec]) -> DataFrame:
        """Go on where the job stands: its step, or its report when all are done."""
        job = self.job(table_uuid)
        if job["last_step"] >= len(steps):
            return self._finish(job, steps)
        return self._step(job, steps, job["last_step"])

    def next_step(self, table_uuid: str, steps: Sequence[StepSpec]) -> DataFrame:
        """Advance by one step; past the last one the job is finished."""
        job = self.job(table_uuid)
        reached = job["last_step"] + 1
        if reached >= len(steps):
            return self._finish(job, steps)
        self.record_step(table_uuid, reached)
        return self._step(job, steps, reached)

    def finish(self, table_uuid: str, steps: Sequence[StepSpec]) -> DataFrame:
        """Mark the job as completed, once, and show its report."""
        return self._finish(self.job(table_uuid), steps)

    def report(self, table_uuid: str, how: str = "left", *, apply_samples: bool = True) -> DataFrame:
        """The rows of the job's samples beside their decisions, a row each.

        With ``apply_samples`` off, the rows of all samples of the files. Comments are
        a table of their own (:meth:`comments`).
        """
        return self._report(self.job(table_uuid), how, apply_samples)

    def _step(self, job: Row, steps: Sequence[StepSpec], number: int, **options: Any) -> DataFrame:
        return run_step(steps[number], self.lake, job["parquet_files"], job["sample_names"] or None, **options)

    def _finish(self, job: Row, steps: Sequence[StepSpec]) -> DataFrame:
        if not job["completed"]:
            self.complete(job["table_uuid"], len(steps))
        return self._report(job, "left")

    def _report(self, job: Row, how: str, apply_samples: bool = True) -> DataFrame:
        main = self.lake.main(job["parquet_files"])
        if apply_samples and job["sample_names"]:
            main = restrict(main, f"{MAIN}.{SAMPLE_COLUMN}", job["sample_names"])
        decided = self.decisions(job["table_uuid"]).select("validation_hash", *REPORT_VERDICT)
        return decision_report(main, decided, self.report_fields, how)

    def export(self, table_uuid: str, folder: str, spec: StepSpec | None = None, comments: str | None = None) -> None:
        """Write the report, or the projection ``spec`` asks for, as CSV; the comments too if ``comments`` names a folder."""
        job = self.job(table_uuid)
        if comments is not None:
            export_csv(self.comments(table_uuid).drop("at"), comments)
        rows = self._report(job, "left") if spec is None else self._step(job, [spec], 0)
        export_csv(rows, folder)


class ReviewSession:
    """One reviewer's work on a job, from a first look on.

    :meth:`look` takes notice of all decisions made so far; :meth:`decide` overrules those of the
    last look only. One object is one writer: it decides from one thread.
    """

    def __init__(self, store: ReviewStore, table_uuid: str, username: str) -> None:
        self.store, self.table_uuid, self.username = store, table_uuid, username
        self.writer = review_log.next_event_id()
        self.turn = 0
        self.seen: dict[str, int] = {}
        self.look()

    def look(self) -> DataFrame:
        """The decisions as they stand; later ones of this session overrule them."""
        known = causal.last_seen(self.store.log.events_of("decision_events", self.table_uuid))
        self.seen = {row["writer"]: row["turn"] for row in known.collect()}  # a row for each session of the job
        return self.store.settled(self.table_uuid)

    def decide(self, rows: Iterable[Mapping[str, Any]]) -> None:
        """Record decisions as :meth:`ReviewStore.decide` does, with their place in the course of things."""
        said = []
        for row in rows:
            self.turn += 1
            said.append({"username": self.username, "writer": self.writer, "turn": self.turn, "seen": dict(self.seen), **row})
        self.store.decide(self.table_uuid, said)
