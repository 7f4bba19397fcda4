"""The life of review jobs on the fixture lake."""

import datetime
import json

import lakes
import pytest

from cohortsift.operators.search import search
from cohortsift.functions.display import display
from cohortsift.plans.review import ReviewStore
from cohortsift.plans.spec import StepSpec
from cohortsift.sources.lake import Lake
from cohortsift.sources.review_log import ReviewLog

STEPS = [StepSpec.from_json(lakes.RARE), StepSpec.from_json(lakes.ALL_CALLS)]


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("lake"))
    files = lakes.build(spark, root)
    made = ReviewStore(spark, f"{root}/review", Lake(spark, root))
    made.files = files
    return made


def new(store, name="Job 1", samples=("alice", "bob")):
    return store.new_job(name, "rev'iewer", store.files, list(samples), "rare")


def test_empty_store_is_a_valid_table(spark, tmp_path):
    fresh = ReviewStore(spark, str(tmp_path), Lake(spark, str(tmp_path)))
    assert fresh.jobs().count() == 0
    assert fresh.decisions("validation_x").columns[:2] == ["validation_hash", "sample_name"]
    assert fresh.decisions("validation_x").count() == 0
    ReviewStore(spark, str(tmp_path), fresh.lake)  # opening again changes nothing


def test_new_job(store):
    key = new(store, "Tumeur été 7")
    job = store.job(key)
    assert key.startswith("validation_") and len(key) == len("validation_") + 36
    assert job["validation_name"] == "Tumeur été 7" and job["username"] == "rev'iewer"
    assert (job["last_step"], job["completed"], job["sample_names"]) == (0, False, ["alice", "bob"])
    assert job["parquet_files"] == store.files and job["creation_date"] is not None


@pytest.mark.parametrize(
    ("name", "samples", "reason"),
    [("", ["a"], "needs a name"), ("x", [], "needs a name"), ("no-dash", ["a"], "letters, digits and blanks")],
)
def test_incomplete_jobs_are_refused(store, name, samples, reason):
    before = store.jobs().count()
    with pytest.raises(ValueError, match=reason):
        new(store, name, samples)
    assert store.jobs().count() == before


def test_unknown_job(store):
    with pytest.raises(LookupError):
        store.job("validation_none")


def test_sample_choices(store):
    assert {r[0] for r in store.sample_choices(store.files).collect()} == {"alice", "bob", "o'hara", "carol", None}
    assert {r[0] for r in store.sample_choices(store.files, "O").collect()} == {"bob", "o'hara", "carol"}


def test_steps_resume_and_finish(store):
    key = new(store)
    assert store.resume(key, STEPS).columns[0] == "run_name"
    second = store.next_step(key, STEPS)
    assert second.columns == ["validation_hash", "sample_name"]
    assert {r["sample_name"] for r in second.collect()} == {"alice", "bob"}
    assert store.job(key)["last_step"] == 1
    assert store.resume(key, STEPS).columns == second.columns
    report = store.next_step(key, STEPS)
    assert report.columns[:2] == ["validation_hash", "sample_name"] and report.count() == 6
    job = store.job(key)
    assert (job["last_step"], job["completed"]) == (2, True)
    events = store.log.job_events().filter(f"table_uuid = '{key}'").count()
    assert store.resume(key, STEPS).count() == 6
    assert store.log.job_events().filter(f"table_uuid = '{key}'").count() == events  # finished once only


def test_deleted_job_is_gone(store):
    key = new(store, "Short lived")
    store.delete(key)
    store.record_step(key, 5)  # a late event does not bring it back
    with pytest.raises(LookupError):
        store.job(key)


def test_step_for_a_job_never_created(store):
    before = store.jobs().count()
    store.record_step("validation_stray", 3)
    assert store.jobs().count() == before


def test_decisions_and_report(store, capsys):
    key, other = new(store, "A"), new(store, "B")
    store.decide(key, [
        {"validation_hash": 11, "accepted": True, "tags": ["seen"], "sample_name": "alice"},
        {"validation_hash": 12, "accepted": False},
        {"validation_hash": 13, "accepted": True},
    ])
    store.decide(other, [{"validation_hash": 14, "accepted": True}])
    store.decide(key, [{"validation_hash": 13, "accepted": None, "tags": []}])
    store.decide(key, [{"validation_hash": 11, "accepted": False, "tags": ["seen", "odd"]}])
    store.comment(key, 11, "it's \"fine\"", "ann")
    store.comment(key, 11, "or not", "ben")
    store.comment(key, 21, "no decision yet", "ann")
    now = {r["validation_hash"]: r for r in store.decisions(key).collect()}
    assert set(now) == {11, 12, 13, 21}
    assert (now[11]["accepted"], now[11]["tags"]) == (False, ["seen", "odd"])
    said = store.comments(key).orderBy("at", "event_id").collect()
    assert [(c["validation_hash"], c["comment"], c["username"]) for c in said] == [
        (11, 'it\'s "fine"', "ann"), (11, "or not", "ben"), (21, "no decision yet", "ann"),
    ]
    assert (now[12]["accepted"], now[13]["accepted"], now[13]["tags"]) == (False, None, [])
    everything = store.report(key)
    assert everything.columns == [
        "validation_hash", "sample_name", "run_name", "chromosome", "position", "reference", "alternate",
        "snpeff_Gene_Name", "accepted", "tags",
    ]
    assert everything.count() == 6
    assert sorted(r[0] for r in store.report(key, "inner").collect()) == [11, 12, 13, 21]
    store.decisions(key).explain()
    assert f"PartitionFilters: [isnotnull(table_uuid" in capsys.readouterr().out


def test_a_long_discussion_repeats_no_row(store):
    key = new(store, "Talk")
    store.decide(key, [{"validation_hash": 11, "accepted": True}])
    rows = [{"kind": "comment", "table_uuid": key, "validation_hash": 11, "comment": f"c{i}"} for i in range(1200)]
    store.log.record("decision_events", rows)
    assert store.decisions(key).count() == 1
    assert store.report(key, "inner").count() == 1
    said = store.comments(key).orderBy("at", "event_id").collect()
    assert [r["comment"] for r in said] == [f"c{i}" for i in range(1200)]


def test_later_instants_win_in_any_zone(spark, store):
    key = new(store, "Zones")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        for zone, verdict in (("Asia/Tokyo", True), ("UTC", False)):
            spark.conf.set("spark.sql.session.timeZone", zone)
            store.decide(key, [{"validation_hash": 11, "accepted": verdict}])
        assert store.decisions(key).first()["accepted"] is False
        # 01:30 comes twice in New York on that day, the second time half an hour after 01:59:59.
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        for stamp, verdict in (("2024-11-03T05:50:00Z", True), ("2024-11-03T06:30:00Z", None)):
            event = {"kind": "decision", "table_uuid": key, "validation_hash": 12, "accepted": verdict}
            event["at"] = datetime.datetime.fromisoformat(stamp)
            store.log.record("decision_events", [event])
        assert {r["validation_hash"]: r["accepted"] for r in store.decisions(key).collect()}[12] is None
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_report_holds_the_chosen_samples(store):
    key = new(store, "Some", ["alice"])
    assert {r["sample_name"] for r in store.report(key).collect()} == {"alice"}
    assert store.report(key, apply_samples=False).count() == 10


def test_report_fields_can_be_chosen(spark, store):
    other = ReviewStore(spark, store.log.root, store.lake, report_fields=["validation_hash", "sample_name"])
    assert other.report(new(store, "Few")).columns == ["validation_hash", "sample_name", "accepted", "tags"]


def test_events_appended_meanwhile_are_taken_over(spark, store, tmp_path):
    key = new(store, "Moving")
    copy = store.log.compact(f"{tmp_path}/moved")
    store.decide(key, [{"validation_hash": 13, "accepted": True}])
    moved = ReviewStore(spark, copy.root, store.lake)
    assert moved.decisions(key).count() == 0
    for _ in range(2):
        copy.take_over(store.log)
    assert [r["accepted"] for r in moved.decisions(key).collect()] == [True]
    assert copy.decision_events().count() == store.log.decision_events().count()


def test_job_table_as_displayed(store):
    key = new(store, "Shown")
    shown = display(store.jobs().filter(f"table_uuid = '{key}'")).first()
    assert (shown["completed"], shown["parquet_files"], shown["sample_names"]) == ("No", "run1, run2", "alice, bob")
    assert len(shown["creation_date"]) == len("01/02/2024 10:00:00")
    jobs = store.jobs()
    assert search(jobs, key.upper()).count() == 1  # the key is searched too
    assert search(jobs, "RUN1, run2").count() == jobs.count()
    assert search(jobs, "run1.parquet").count() == 0  # only stems are shown
    assert search(jobs, "run1.parquet", ["parquet_files"], raw=True).count() == jobs.count()
    assert search(jobs, "").count() == jobs.count()
    assert search(jobs, "^sh.wn$", regexp=True).count() == 1
    with pytest.raises(ValueError):
        search(jobs, "x", ["nothing"])


def test_compacted_log_has_the_same_state(spark, store, tmp_path):
    copy = store.log.compact(f"{tmp_path}/compact")
    assert isinstance(copy, ReviewLog)
    moved = ReviewStore(spark, copy.root, store.lake)
    assert sorted(map(str, moved.jobs().collect())) == sorted(map(str, store.jobs().collect()))
    files = spark.read.parquet(f"{copy.root}/job_events").inputFiles()
    assert len(files) < len(spark.read.parquet(f"{store.log.root}/job_events").inputFiles())
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        store.log.compact(copy.root)


def test_export(spark, store, tmp_path):
    key = new(store, "Out")
    store.decide(key, [{"validation_hash": 11, "accepted": True, "tags": ["a", "b"]}])
    store.comment(key, 11, "good, really", "ann")
    store.export(key, f"{tmp_path}/report", comments=f"{tmp_path}/comments")
    rows = spark.read.options(header=True, quote='"', escape='"').csv(f"{tmp_path}/report").collect()
    kept = {r["validation_hash"]: r for r in rows}
    assert len(kept) == 6 and json.loads(kept["11"]["tags"]) == ["a", "b"] and kept["11"]["accepted"] == "true"
    said = spark.read.options(header=True, quote='"', escape='"').csv(f"{tmp_path}/comments").collect()
    assert [(r["validation_hash"], r["comment"]) for r in said] == [("11", "good, really")]
    constant = {"name": "reference_genome", "value": "'hg19'", "is_expression": True}
    final = StepSpec.from_json({**lakes.RARE, "fields": [constant, *lakes.RARE["fields"]], "order": []})
    store.export(key, f"{tmp_path}/final", final)
    rows = spark.read.options(header=True).csv(f"{tmp_path}/final").collect()
    assert {(r["reference_genome"], r["sample_name"]) for r in rows} == {("hg19", "alice"), ("hg19", "bob")}
