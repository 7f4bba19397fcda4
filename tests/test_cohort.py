"""A cohort kept by run: equal to a count of all calls, without reading them again."""

from collections import defaultdict
from glob import glob

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortsift.operators.recurrence import run_recurrence
from cohortsift.sources.cohort import Cohort

CALLS = "sample string, variant bigint, impact string, weight int"
RULES = {"high": "impact = 'HIGH'", "heavy": "weight > 2"}
RUN1 = [
    ("alice", 1, "HIGH", 1),
    ("alice", 1, "LOW", 3),
    ("bob", 1, "HIGH", None),
    (None, 1, None, 5),
    (None, 3, "HIGH", 5),
    ("alice", None, "HIGH", 9),
    ("o'hara", 2, "LOW", 2),
]
RUN2 = [("alice", 1, "HIGH", 7), ("carol", 1, "LOW", 1), (None, 3, "LOW", 1), ("dave", 4, "HIGH", 3)]


def calls(spark, rows):
    return spark.createDataFrame(rows, CALLS)


def expected(rows):
    """variant -> high, heavy, total, recurrence, by hand."""
    found = defaultdict(lambda: [0, 0, 0, set()])
    for sample, variant, impact, weight in rows:
        own = found[variant]
        own[0] += impact == "HIGH"
        own[1] += weight is not None and weight > 2
        own[2] += 1
        own[3].add(sample)
    return {v: (*n[:3], len(n[3])) for v, n in found.items()}


def facts(df):
    return {r["variant"]: (r["high"], r["heavy"], r["total_count"], r["run_recurr"]) for r in df.collect()}


@pytest.fixture
def cohort(spark, tmp_path):
    return Cohort.create(spark, str(tmp_path / "co hort's"), calls(spark, []), "sample", "variant", RULES, buckets=4)


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_nothing_added(cohort):
    assert cohort.runs() == []
    assert cohort.facts().collect() == []
    assert cohort.pairs().collect() == []


def test_runs_together_and_apart(spark, cohort):
    cohort.add("run1", calls(spark, RUN1))
    cohort.add("a/b=2 ü", calls(spark, RUN2))
    assert cohort.runs() == ["a/b=2 ü", "run1"]
    assert facts(cohort.facts()) == expected(RUN1 + RUN2)
    assert facts(cohort.facts(["run1"])) == expected(RUN1)
    assert facts(cohort.facts(["a/b=2 ü"])) == expected(RUN2)
    assert cohort.facts([]).collect() == []
    assert {tuple(r) for r in cohort.pairs().collect()} == {(r[0], r[1]) for r in RUN1 + RUN2}
    assert cohort.pairs().count() == len({(r[0], r[1]) for r in RUN1 + RUN2})


def test_equals_the_count_of_all_calls(spark, cohort):
    cohort.add("run1", calls(spark, RUN1))
    cohort.add("run2", calls(spark, RUN2))
    whole = run_recurrence(calls(spark, RUN1 + RUN2), "sample", "variant")
    assert sorted(map(tuple, cohort.recurrence().collect()), key=str) == sorted(map(tuple, whole.collect()), key=str)


def test_a_run_again_and_gone(spark, cohort):
    cohort.add("run1", calls(spark, RUN1))
    cohort.add("run2", calls(spark, RUN2))
    cohort.add("run1", calls(spark, RUN1))
    assert facts(cohort.facts()) == expected(RUN1 + RUN2)
    cohort.add("run1", calls(spark, RUN2[:2]))
    assert facts(cohort.facts()) == expected(RUN2 + RUN2[:2])
    cohort.drop("run2")
    assert cohort.runs() == ["run1"]
    assert facts(cohort.facts()) == expected(RUN2[:2])
    cohort.add("run1", calls(spark, []))
    assert cohort.runs() == []
    assert cohort.facts().collect() == []


def test_a_run_is_added_without_reading_earlier_ones(spark, cohort):
    cohort.add("run1", calls(spark, RUN1))
    for file in glob(f"{cohort.root}/calls/run=run1/*.parquet"):
        with open(file, "wb") as out:
            out.write(b"spoilt")
    cohort.add("run2", calls(spark, RUN2))
    assert facts(cohort.facts(["run2"])) == expected(RUN2)


def test_opened_again(spark, cohort):
    cohort.add("run1", calls(spark, RUN1))
    spark.sql(f"DROP TABLE {cohort._table}")  # as a new session, whose catalog does not know it
    again = Cohort(spark, cohort.root)
    assert again.shape == cohort.shape
    assert facts(again.facts()) == expected(RUN1)
    again.add("run2", calls(spark, RUN2))
    assert facts(again.facts()) == expected(RUN1 + RUN2)


def test_more_samples_than_a_word(spark, cohort):
    many = [(f"s{k:03}", 1 + k % 2, "HIGH", k) for k in range(150)]
    cohort.add("run1", calls(spark, many[:70]))
    cohort.add("run2", calls(spark, many[60:] + RUN1))
    assert facts(cohort.facts()) == {
        v: (*(a + b for a, b in zip(expected(many[:70]).get(v, (0,) * 4)[:3], own[:3], strict=True)), expected(many + RUN1)[v][3])
        for v, own in expected(many[60:] + RUN1).items()
    }
    numbers = [r["number"] for r in cohort._samples().collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))


def test_facts_need_no_shuffle(spark, cohort, no_broadcast):
    cohort.add("run1", calls(spark, RUN1))
    cohort.add("run2", calls(spark, RUN2))
    assert "Exchange" not in plan(cohort.facts())


def test_join_shuffles_only_the_calls(spark, cohort, no_broadcast, tmp_path):
    cohort.add("run1", calls(spark, RUN1))
    calls(spark, RUN1).write.parquet(str(tmp_path / "calls"))
    joined = cohort.joined(spark.read.parquet(str(tmp_path / "calls")), "variant")
    assert plan(joined).count("Exchange hashpartitioning") == 1
    assert joined.columns == ["sample", "variant", "impact", "weight", "high", "heavy", "total_count", "run_recurr"]


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("light_rows", [1, 1000])
def test_joined_rows(spark, cohort, no_broadcast, how, light_rows, tmp_path):
    cohort.add("run1", calls(spark, RUN1))
    more = RUN1 + RUN2 + [("eve", 1, "LOW", 0)] * 40 + [("eve", None, "LOW", 0)] * 5 + [("eve", 77, "LOW", 0)] * 30
    calls(spark, more).write.parquet(str(tmp_path / "calls"))
    df = spark.read.parquet(str(tmp_path / "calls"))
    known = {v: n for v, n in expected(RUN1).items() if v is not None}
    wanted = [(*r, *known.get(r[1], (None,) * 4)) for r in more if how == "left" or r[1] in known]
    found = cohort.joined(df, "variant", how=how, light_rows=light_rows).collect()
    assert sorted(map(tuple, found), key=str) == sorted(wanted, key=str)


def test_refused(spark, cohort, tmp_path):
    with pytest.raises(ValueError, match="own"):
        Cohort.create(spark, str(tmp_path / "x"), calls(spark, []), "sample", "variant", {"Bits": "true"})
    with pytest.raises(ValueError, match="variant is string"):
        cohort.add("run1", calls(spark, RUN1).selectExpr("sample", "impact as variant", "impact", "weight"))
    with pytest.raises(ValueError, match="name"):
        cohort.add("", calls(spark, RUN1))
    with pytest.raises(ValueError, match="there already"):
        cohort.joined(calls(spark, RUN1).selectExpr("variant", "1 as HIGH"), "variant")


ROW = st.tuples(
    st.sampled_from([None, "a", "b", "c", ""]), st.sampled_from([None, 1, 2, 3]), st.sampled_from([None, "HIGH"]), st.integers(0, 5)
)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("xyz"), st.lists(ROW, max_size=6)), max_size=3))
def test_any_order_of_runs(spark, tmp_path_factory, steps):
    made = Cohort.create(spark, str(tmp_path_factory.mktemp("c") / "c"), calls(spark, []), "sample", "variant", RULES, buckets=2)
    now = {}
    for run, rows in steps:
        made.add(run, calls(spark, rows))
        now[run] = rows
    assert facts(made.facts()) == expected([r for rows in now.values() for r in rows])
    assert made.runs() == sorted(run for run, rows in now.items() if rows)
