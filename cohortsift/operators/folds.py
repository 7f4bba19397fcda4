"""The present state the review log adds up to."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsift.sources.review_log import CREATED, DECISION, DELETED, REMARK


def when_said(events: DataFrame) -> Column:
    """What orders events: the instant of each, then its id.

    ``ts`` is for display only: it has no zone and repeats an hour each autumn.
    Events without an instant are placed by it, read in the session's zone.
    """
    stamp = F.col("ts").cast("timestamp")
    instant = F.coalesce("at", stamp) if "at" in events.columns else stamp
    return F.struct(instant.alias("at"), "event_id")


def latest(value: Column | str, order: Sequence[str] = ("ts", "event_id")) -> Column:
    """Aggregate: the value of the last row; filter before to skip rows."""
    return F.max_by(value, F.struct(*order))


@dataclass(frozen=True)
class Fold:
    """A fold whose intermediate states merge: in any order, and with the same events again, they give the same.

    ``parts`` gives each event's share of every state column, ``merges`` what joins the shares and the states.
    """

    keys: tuple[str, ...]
    parts: Callable[[DataFrame], dict[str, Column]]
    merges: dict[str, Callable[[str], Column]]
    present: Callable[[DataFrame], DataFrame]
    #: The rows an event counts as, where it counts for more keys than its own.
    spread: Callable[[DataFrame], DataFrame] | None = None

    def of(self, events: DataFrame) -> DataFrame:
        """The state the events add up to, a row for each key."""
        events = events if self.spread is None else self.spread(events)
        shares = self.parts(events)
        return self.merged(events.select(*self.keys, *(share.alias(name) for name, share in shares.items())))

    def merged(self, states: DataFrame) -> DataFrame:
        return states.groupBy(*self.keys).agg(*(merge(name).alias(name) for name, merge in self.merges.items()))


_GIVEN = ("parquet_files", "sample_names", "username", "validation_name", "validation_method")


def _job_parts(events: DataFrame) -> dict[str, Column]:
    created, said = F.col("kind") == CREATED, when_said(events).alias("said")

    def set_by(name: str) -> Column:
        return F.when(F.col(name).isNotNull(), F.struct(said, F.col(name).alias("value")))

    return {
        "given": F.when(created, F.struct(said, *_GIVEN)),
        "first": F.when(created, F.struct(said, "ts")),
        "completed": set_by("completed"),
        "last_step": set_by("last_step"),
        "deleted": F.col("kind") == DELETED,
    }


def _jobs_now(state: DataFrame) -> DataFrame:
    alive = state.filter(F.col("first.ts").isNotNull() & ~F.coalesce("deleted", F.lit(False)))
    return alive.select(
        "given.parquet_files",
        "given.sample_names",
        "given.username",
        "given.validation_name",
        "table_uuid",
        F.col("first.ts").alias("creation_date"),
        F.coalesce("completed.value", F.lit(False)).alias("completed"),
        F.coalesce("last_step.value", F.lit(0)).alias("last_step"),
        "given.validation_method",
    )


JOBS = Fold(
    ("table_uuid",),
    _job_parts,
    {"given": F.max, "first": F.min, "completed": F.max, "last_step": F.max, "deleted": F.bool_or},
    _jobs_now,
)

VERDICT = ("sample_name", "run_name", "transcript_ID", "accepted", "tags")


def _decision_parts(events: DataFrame) -> dict[str, Column]:
    said = when_said(events).alias("said")
    decided = F.col("kind") == DECISION
    return {"last": F.when(decided, F.struct(said, *VERDICT)), "spoken": decided | _is_remark()}


def _decisions_now(state: DataFrame) -> DataFrame:
    return state.filter("spoken").select("validation_hash", *[F.col(f"last.{c}").alias(c) for c in VERDICT])


DECISIONS = Fold(
    ("table_uuid", "validation_hash"), _decision_parts, {"last": F.max, "spoken": F.bool_or}, _decisions_now
)


def review_jobs(events: DataFrame) -> DataFrame:
    """One row per job that was created and not deleted, as it stands now."""
    return JOBS.present(JOBS.of(events))


def decisions(events: DataFrame) -> DataFrame:
    """Last decision per ``validation_hash`` of one job, one row each.

    A later decision replaces an earlier one, also when it is undecided (NULL). A
    hash that was only commented on has a row without a verdict. Comments are
    :func:`comments`.
    """
    return DECISIONS.present(DECISIONS.of(events))


def comments(events: DataFrame) -> DataFrame:
    """Every comment, a row each: what it is about, when and by whom it was made.

    Sort by ``at`` and ``event_id`` for the order in which they were made.
    """
    at = when_said(events)["at"]
    return events.filter(_is_remark()).select(
        "validation_hash", "comment", "username", F.col("ts").alias("creation_timestamp"), at.alias("at"), "event_id"
    )


def _is_remark() -> Column:
    return (F.col("kind") == REMARK) & F.col("comment").isNotNull()
