"""Decisions made at once: what stands and what is in conflict, against brute force over interleavings."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_snapshot import SECOND, append, spark_rows

from cohortsift.operators import causal
from cohortsift.plans.review import ReviewStore
from cohortsift.sources.lake import Lake
from cohortsift.sources.review_log import ReviewLog
from cohortsift.streaming.snapshot import FoldedLog

JOB = "validation_1"


def course(draw, writers=3, steps=40, records=4):
    """Decisions of writers who now and then look, and for each which others it knew of; clocks are wrong at will."""
    made, known, turns, views = [], [], Counter(), {w: set() for w in range(writers)}
    for k in range(steps):
        w = draw.randrange(writers)
        if draw.random() < 0.4:  # a look: all that is there, whole turns of everybody
            views[w] |= set(range(len(made)))
        turns[w] += 1
        seen = defaultdict(int)
        for e in views[w]:
            seen[made[e]["writer"]] = max(seen[made[e]["writer"]], made[e]["turn"])
        known.append(set(views[w]))
        made.append({
            "event_id": f"{draw.randrange(10**6):06d}-{k:04d}", "at": SECOND + draw.randint(0, 50), "kind": "decision", "table_uuid": JOB,
            "validation_hash": draw.randint(1, records), "accepted": draw.choice([True, False, None]), "tags": draw.choice([["a", "b"], ["b", "a"], None]),
            "writer": f"w{w}", "turn": turns[w], "seen": dict(seen) if seen or draw.random() < 0.5 else None,
        })
        views[w] = views[w] | {k}
    return made, known


def brute(made, known):
    """Events that no later event on the same record knew of."""
    return {
        made[k]["event_id"] for k in range(len(made))
        if not any(made[j]["validation_hash"] == made[k]["validation_hash"] and k in known[j] for j in range(len(made)) if j != k)
    }


def word(e):
    return e["accepted"], None if e["tags"] is None else tuple(sorted(e["tags"]))


@pytest.mark.parametrize("seed", range(6))
def test_heads_and_conflicts_are_those_of_brute_force(spark, tmp_path, seed):
    draw = random.Random(seed)
    made, known = course(draw, writers=draw.choice([2, 3, 5]))
    log = ReviewLog(spark, f"{tmp_path}/log")
    shuffled = draw.sample(made, len(made))
    append(log, "decision_events", shuffled[:20])
    append(log, "decision_events", shuffled[15:])  # some events twice
    wanted = brute(made, known)
    standing = causal.heads(log.decision_events())
    found = standing.collect()
    assert sorted(r["event_id"] for r in found) == sorted(wanted)
    by_record = defaultdict(list)
    for e in made:
        if e["event_id"] in wanted:
            by_record[e["validation_hash"]].append(e)
    rows = {r["validation_hash"]: r for r in causal.settled(standing).collect()}
    assert rows.keys() == by_record.keys()
    for record, own in by_record.items():
        shown = max(own, key=lambda e: (e["at"], e["event_id"]))
        assert rows[record]["heads"] == len(own) and rows[record]["conflicting"] == (len({word(e) for e in own}) > 1)
        assert (rows[record]["accepted"], rows[record]["tags"]) == (shown["accepted"], shown["tags"])
    listed = {r["event_id"] for r in causal.conflicts(standing).collect()}
    assert listed == {e["event_id"] for own in by_record.values() if len({word(e) for e in own}) > 1 for e in own}


def test_snapshots_hold_the_same_heads(spark, tmp_path):
    made, known = course(random.Random(5), writers=4, steps=60)
    log = ReviewLog(spark, f"{tmp_path}/log")
    kept = FoldedLog(log, "decision_events", causal.HEADS, "decision_heads")
    order = random.Random(1).sample(range(60), 60)  # late events come in any batch
    for a in range(0, 60, 20):
        append(log, "decision_events", [made[k] for k in order[a : a + 20]])
        assert spark_rows(kept.now()) == spark_rows(causal.heads(log.decision_events()))
        kept.advance()
        assert spark_rows(kept.now(JOB)) == spark_rows(causal.heads(log.decision_events()))
    assert {r["event_id"] for r in kept.now().collect()} == brute(made, known)


def test_events_without_a_writer_go_by_the_clock(spark, tmp_path):
    def event(k, at, **more):
        return {"event_id": f"{k}", "at": SECOND + at, "kind": "decision", "table_uuid": JOB, "validation_hash": 1, "accepted": True, **more}

    def of(*events):
        log = ReviewLog(spark, f"{tmp_path}/{random.random()}")
        append(log, "decision_events", list(events))
        return sorted(r["event_id"] for r in causal.heads(log.decision_events()).collect())

    assert of(event(1, 5), event(2, 3)) == ["1"]
    assert of(event(1, 5), event(2, 9, writer="w", turn=1)) == ["2"]
    assert of(event(1, 9), event(2, 5, writer="w", turn=1)) == ["1", "2"]  # an unnamed one has seen nothing
    assert of(event(1, 5), event(2, 5, writer="w", turn=1)) == ["1", "2"]
    assert of(event(1, 5), event(2, 3, writer="w")) == ["1"]  # without a turn: by the clock
    assert of(event(1, 3, writer="w", turn=2), event(2, 9, writer="w", turn=1)) == ["1"]  # turns, not clocks
    assert of(event(1, 3, writer="w", turn=1), event(2, 9, writer="w", turn=1)) == ["2"]
    assert of(event(1, 3), {**event(2, 9), "kind": "comment"}) == ["1"]


def test_a_late_clock_does_not_overrule_who_has_seen_more(spark, tmp_path):
    made = [
        {"event_id": "1", "at": SECOND + 900, "kind": "decision", "table_uuid": JOB, "validation_hash": 1, "accepted": True, "writer": "fast", "turn": 1},
        {"event_id": "2", "at": SECOND, "kind": "decision", "table_uuid": JOB, "validation_hash": 1, "accepted": False, "writer": "slow", "turn": 1, "seen": {"fast": 1}},
    ]
    log = ReviewLog(spark, f"{tmp_path}/log")
    append(log, "decision_events", made)
    (row,) = causal.settled(causal.heads(log.decision_events())).collect()
    assert (row["accepted"], row["heads"], row["conflicting"]) == (False, 1, False)


def test_an_empty_log_has_no_heads(spark, tmp_path):
    standing = causal.heads(ReviewLog(spark, f"{tmp_path}/log").decision_events())
    assert standing.collect() == causal.settled(standing).collect() == causal.conflicts(standing).collect() == []


def test_two_reviewers_at_once(spark, tmp_path):
    spark.range(2).select(F.col("id").alias("validation_hash"), F.lit("s").alias("sample_name")).write.parquet(f"{tmp_path}/run.parquet")
    store = ReviewStore(spark, f"{tmp_path}/review", Lake(spark, str(tmp_path)))
    job = store.new_job("Review", "ann", ["run.parquet"], ["s"], "m")
    ann, ben = store.session(job, "ann"), store.session(job, "ben")
    ann.decide([{"validation_hash": 0, "accepted": True}, {"validation_hash": 1, "accepted": True}])
    ben.decide([{"validation_hash": 0, "accepted": False}, {"validation_hash": 1, "accepted": True}])
    store.advance()
    found = {r["validation_hash"]: (r["heads"], r["conflicting"]) for r in store.settled(job).collect()}
    assert found == {0: (2, True), 1: (2, False)}
    assert sorted(r["accepted"] for r in store.conflicts(job).collect()) == [False, True]
    standing = {r["validation_hash"]: r["conflicting"] for r in ann.look().collect()}
    assert standing == {0: True, 1: False}
    ann.decide([{"validation_hash": 0, "accepted": False, "tags": ["agreed"]}])
    found = {r["validation_hash"]: (r["accepted"], r["heads"], r["conflicting"]) for r in store.settled(job).collect()}
    assert found == {0: (False, 1, False), 1: (True, 2, False)} and store.conflicts(job).count() == 0
    assert {r["validation_hash"]: r["accepted"] for r in store.decisions(job).collect()} == {0: False, 1: True}  # the clock's fold goes on


def test_one_shuffle_with_partial_sums(spark, tmp_path):
    log = ReviewLog(spark, f"{tmp_path}/log")
    append(log, "decision_events", course(random.Random(3))[0])
    plan = causal.heads(log.decision_events())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Aggregate") == 2
