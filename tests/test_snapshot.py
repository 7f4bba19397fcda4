"""Snapshots of the review log: the same as a fold of all events, whatever the batches."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortsift.operators import folds
from cohortsift.plans.review import ReviewStore
from cohortsift.sources.lake import Lake
from cohortsift.sources.review_log import DECISION_EVENT, JOB_EVENT, ReviewLog
from cohortsift.streaming import snapshot
from cohortsift.streaming.snapshot import FoldedLog

SECOND = 1_700_000_000


def spark_rows(df):
    """The rows, nested ones too, as text."""
    return Counter(repr(sorted(r.asDict(recursive=True).items())) for r in df.collect())


def job_events(draw, jobs, n, first=0):
    out = []
    for k in range(n):
        kind = draw.choice(["created", "step", "step", "completed", "deleted"] if k % 9 == 0 else ["created", "step", "completed"])
        out.append({
            "event_id": f"{first + k:020d}", "at": SECOND + draw.randint(0, 500), "kind": kind, "table_uuid": f"validation_{draw.randint(1, jobs)}",
            "validation_name": f"n{k}" if kind == "created" else None, "parquet_files": [f"f{k}"] if kind == "created" else None,
            "last_step": draw.choice([None, k]) if kind == "step" else None, "completed": draw.choice([True, False]) if kind == "completed" else None,
        })
    return out


def decision_events(draw, jobs, n, first=0):
    return [
        {"event_id": f"{first + k:020d}", "at": SECOND + draw.randint(0, 500), "kind": draw.choice(["decision", "comment"]),
         "table_uuid": f"validation_{draw.randint(1, jobs)}", "validation_hash": draw.randint(1, 6), "accepted": draw.choice([True, False, None]),
         "tags": [f"t{k}"], "comment": draw.choice([None, "c"])}
        for k in range(n)
    ]


def append(log, name, rows):
    schema = JOB_EVENT if name == "job_events" else DECISION_EVENT
    values = [tuple(r.get(c) for c in schema.names if c not in ("at", "ts")) + (r["at"],) for r in rows]
    kinds = [f for f in schema.fields if f.name not in ("at", "ts")]
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds) + ", second bigint"
    df = log.spark.createDataFrame(values, columns)
    df = df.withColumn("at", F.timestamp_seconds("second")).withColumn("ts", F.col("at").cast("timestamp_ntz")).drop("second")
    (log.append_job_events if name == "job_events" else log.append_decision_events)(df)


CASES = [("job_events", folds.JOBS, job_events), ("decision_events", folds.DECISIONS, decision_events)]


@pytest.mark.parametrize(("name", "fold", "events"), CASES, ids=["jobs", "decisions"])
def test_any_course_of_batches_gives_the_full_fold(spark, tmp_path, name, fold, events):
    draw = random.Random(7)
    log = ReviewLog(spark, f"{tmp_path}/log")
    kept = FoldedLog(log, name, fold)
    assert kept.now().count() == 0
    kept.advance()  # nothing there yet
    for turn in range(3):
        for _ in range(2):
            append(log, name, events(draw, 5 + 3 * turn, 25, first=draw.randint(0, 10**6)))  # late ones among them
        whole = spark_rows(fold.of(log._read(name)))
        assert spark_rows(kept.state()) == whole  # two files are newer than the snapshot
        if turn != 1:
            kept.advance(files_at_once=1 if turn == 2 else None)
            assert spark_rows(kept.state()) == whole
        for key in ("validation_1", "validation_none"):
            wanted = spark_rows(fold.of(log._read(name)).filter(F.col("table_uuid") == key))
            assert spark_rows(kept.state(key)) == wanted
    append(log, name, events(draw, 5, 25))
    assert spark_rows(kept.now()) == spark_rows(fold.present(fold.of(log._read(name))))


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    draw = random.Random(1)
    log = ReviewLog(spark, f"{tmp_path}/log")
    append(log, "job_events", job_events(draw, 6, 60))
    kept = FoldedLog(log, "job_events", folds.JOBS)
    kept.advance()
    before = spark_rows(kept.state())
    batch = log.job_events().select("*", F.col("_metadata.file_path").alias("_path"))
    kept.take_in(batch, 0)
    assert spark_rows(kept.state()) == before == spark_rows(folds.JOBS.of(log.job_events()))
    # a version that was written but not committed is not seen, and is written over
    spark.createDataFrame([], folds.JOBS.of(log.job_events()).schema).write.parquet(f"{kept.root}/version={kept.commits().version + 1}/bucket=0")
    append(log, "job_events", job_events(draw, 6, 30, first=1000))
    kept.advance()
    assert spark_rows(kept.state()) == spark_rows(folds.JOBS.of(log.job_events()))


def test_states_merge_in_any_order(spark):
    draw = random.Random(4)
    for name, fold, events in CASES:
        rows = events(draw, 3, 24)
        schema = JOB_EVENT if name == "job_events" else DECISION_EVENT
        whole = spark.createDataFrame([tuple(r.get(c) for c in schema.names if c != "ts" and c != "at") for r in rows],
                                      ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields if f.name not in ("at", "ts")))
        whole = whole.withColumn("ts", F.timestamp_seconds(F.pmod(F.xxhash64("event_id"), F.lit(5))).cast("timestamp_ntz"))
        parts = [fold.of(whole.filter(F.pmod(F.xxhash64("event_id"), F.lit(3)) == k)) for k in range(3)]
        wanted = spark_rows(fold.of(whole))
        for order in itertools.islice(itertools.permutations(range(3)), 1, 6, 2):
            a, b, c = (parts[k] for k in order)
            again = fold.merged(fold.merged(a.unionByName(b)).unionByName(c).unionByName(b))
            assert spark_rows(again) == wanted


def files_read(df):
    return {snapshot.place_of(f) for f in df.inputFiles()}


def test_a_look_reads_the_bucket_and_newer_files_only(spark, tmp_path):
    draw = random.Random(2)
    log = ReviewLog(spark, f"{tmp_path}/log")
    for name, fold, events in CASES:
        append(log, name, events(draw, 40, 300))
        kept = FoldedLog(log, name, fold)
        kept.advance()
        old = files_read(log._read(name))
        look = kept.state("validation_3")
        assert not files_read(look) & old and all("/snapshots/" in f for f in files_read(look))
        assert len({f.split("/bucket=")[1].split("/")[0] for f in files_read(look)}) == 1
        assert "Exchange" not in look._jdf.queryExecution().executedPlan().toString()  # a state is there as it is
        append(log, name, events(draw, 40, 60, first=5000))
        look = kept.state("validation_3")
        newer = {f for f in files_read(look) if "/snapshots/" not in f}
        assert newer and not newer & old
        if name == "decision_events":  # of all folders of jobs only its own
            assert all("/table_uuid=validation_3/" in f for f in newer)


def test_only_touched_buckets_are_written(spark, tmp_path):
    draw = random.Random(3)
    log = ReviewLog(spark, f"{tmp_path}/log")
    append(log, "job_events", job_events(draw, 60, 300))
    kept = FoldedLog(log, "job_events", folds.JOBS)
    kept.advance()
    first = kept.commits().heads
    log.record("job_events", [{"kind": "step", "table_uuid": "validation_3", "last_step": 9}])
    kept.advance()
    assert [b for b, v in kept.commits().heads.items() if first.get(b) != v] == [kept._bucket_of("validation_3")]


def test_store_goes_on_from_a_snapshot(spark, tmp_path):
    store = ReviewStore(spark, f"{tmp_path}/review", Lake(spark, str(tmp_path)))
    job = store.new_job("Job 1", "ann", ["f.parquet"], ["alice"], "rare")
    store.decide(job, [{"validation_hash": 1, "accepted": True}, {"validation_hash": 2, "accepted": False}])
    store.advance()
    assert store.job(job)["last_step"] == 0 and store.decisions(job).count() == 2
    store.record_step(job, 2)
    store.decide(job, [{"validation_hash": 2, "accepted": None}])
    store.comment(job, 3, "look", "ann")
    for _ in range(2):  # before and after the next advance
        assert store.job(job)["last_step"] == 2
        assert {r["validation_hash"]: r["accepted"] for r in store.decisions(job).collect()} == {1: True, 2: None, 3: None}
        store.advance()
    store.delete(job)
    with pytest.raises(LookupError):
        store.job(job)
    odd = "a key/with=signs"
    store.decide(odd, [{"validation_hash": 5, "accepted": True}])
    assert [r["validation_hash"] for r in store.decisions(odd).collect()] == [5]
