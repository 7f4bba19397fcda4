"""Decisions by who knew of which, in place of the clock: what stands, and what is in conflict.

A decision event may name its ``writer`` (one session of a reviewer), its ``turn`` (a number that
grows with each of the writer's decisions on a job) and what the writer had ``seen``: of each writer the
last turn known to it. A decision overrules those it has seen and the writer's own earlier ones.
Decisions that no other overrules are heads. A decision with one head is settled, whatever the clocks
say; several heads were made at once, and if their verdicts differ they are in conflict.

Of one writer only the last turn can be a head, and it is one unless some decision on the same record has seen
it. So the state is, for each record and writer, the last decision and the last turn seen by anybody, both
maxima: one shuffle with partial sums before it, and states that merge in any order and with events again.

Events without a writer, or without a turn, are all of one writer that turns by the clock, has seen nothing, and is seen by
every later decision that names its writer. Of two events with the same writer and turn the later one counts, by instant and id; an event without an instant is as of 1970.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsift.operators.folds import VERDICT, Fold, when_said
from cohortsift.sources.review_log import DECISION

RECORD = ("table_uuid", "validation_hash")


def _spread(events: DataFrame) -> DataFrame:
    """A row for each decision under its writer, and one under each writer it has seen."""
    clock = F.coalesce(F.unix_micros(when_said(events)["at"]), F.lit(0))
    writer = F.when(F.col("turn").isNotNull(), F.col("writer"))
    made = events.filter(F.col("kind") == DECISION).withColumns({"_clock": clock, "_said": when_said(events), "writer": writer})
    turn = F.when(F.col("writer").isNull(), F.col("_clock")).otherwise(F.col("turn"))
    last = F.struct(turn.alias("turn"), F.col("_said").alias("said"), *VERDICT)
    own = F.struct("writer", last.alias("last"), F.lit(None).cast("long").alias("covered"))
    nothing = F.when(F.lit(False), last)
    seen = F.transform(
        F.map_entries(F.coalesce("seen", F.create_map().cast("map<string,bigint>"))),
        lambda e: F.struct(e["key"].alias("writer"), nothing.alias("last"), e["value"].alias("covered")),
    )
    # A decision that names its writer comes after all unnamed ones before its instant.
    unnamed = F.struct(F.lit(None).cast("string").alias("writer"), nothing.alias("last"), F.col("_clock").alias("covered"))
    rows = F.when(F.col("writer").isNull(), F.array(own)).otherwise(F.concat(F.array(own, unnamed), seen))
    return made.select(*RECORD, F.explode(rows).alias("row")).select(*RECORD, "row.*")


def _heads(state: DataFrame) -> DataFrame:
    alone = F.col("writer").isNull() & F.col("covered").isNotNull()
    # An unnamed decision at the very instant of a named one is not before it.
    covered = F.when(alone, F.col("covered") - 1).otherwise(F.col("covered"))
    standing = state.filter(F.col("last").isNotNull() & (F.col("last.turn") > F.coalesce(covered, F.lit(-(2**63)))))
    return standing.select(*RECORD, "writer", "last.turn", F.col("last.said.at").alias("at"), F.col("last.said.event_id").alias("event_id"), *[f"last.{c}" for c in VERDICT])


#: Per record and writer the last decision and the last turn seen; presented as the heads.
HEADS = Fold(
    (*RECORD, "writer"),
    lambda rows: {"last": F.col("last"), "covered": F.col("covered")},
    {"last": F.max, "covered": F.max},
    _heads,
    _spread,
)


def heads(events: DataFrame) -> DataFrame:
    """The decisions that no other has overruled, one or more for each record decided on."""
    return HEADS.present(HEADS.of(events))


def _said() -> Column:
    """What a decision says, for comparing; the order of tags does not matter."""
    return F.struct("accepted", F.array_sort("tags"))


def settled(standing: DataFrame) -> DataFrame:
    """One row per record: the verdict that stands, how many heads it has, and whether they differ.

    Where heads differ, the latest by the clock is shown, and ``conflicting`` says that it has not overruled the others.
    """
    latest = F.max(F.struct("at", "event_id", "writer", *VERDICT)).alias("shown")
    # The same if the least and the greatest are; structs that hold NULL order it first.
    apart = ~F.min(_said()).eqNullSafe(F.max(_said()))
    found = standing.groupBy(*RECORD).agg(latest, F.count("*").alias("heads"), apart.alias("conflicting"))
    return found.select(*RECORD, *[f"shown.{c}" for c in VERDICT], "heads", "conflicting")


def conflicts(standing: DataFrame) -> DataFrame:
    """The heads of records whose heads differ, a row each: whose verdict it is and what it says."""
    open_records = settled(standing).filter("conflicting").select(*RECORD)
    same = [F.col(f"open.{c}").eqNullSafe(F.col(f"heads.{c}")) for c in RECORD]
    return standing.alias("heads").join(open_records.alias("open"), same, "left_semi")


def last_seen(events: DataFrame) -> DataFrame:
    """writer and turn: what somebody who has read ``events``, those of one job, has seen, also through others."""
    made = events.filter((F.col("kind") == DECISION) & F.col("writer").isNotNull())
    own = made.select("writer", "turn")
    told = made.select(F.explode("seen").alias("writer", "turn"))
    return own.unionByName(told).groupBy("writer").agg(F.max("turn").alias("turn"))
