"""What reaches the scan, and how much is shuffled."""

import pytest

from cohortsift import catalogue
from cohortsift.catalogue import QUERIES
from cohortsift.operators import joins
from cohortsift.plans import steps

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture
def plan_of(spark, capsys):
    def show(name):
        df = QUERIES[name](spark, FOLDER)
        capsys.readouterr()
        df.explain()
        return capsys.readouterr().out

    return show


def test_step_reads_few_columns_and_pushes_in(plan_of):
    plan = plan_of("step_count")
    assert "PushedFilters: [In(l_returnflag, [A,R])" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_returnflag:string>" in plan
    assert "l_extendedprice" not in plan


def test_recurrence_counts_before_it_shuffles(plan_of):
    plan = plan_of("recurrence")
    assert plan.count("Exchange hashpartitioning") == 2
    assert "partial_count(1)" in plan
    assert "ReadSchema: struct<l_partkey:bigint,l_suppkey:bigint>" in plan


@pytest.mark.parametrize("name", ["step_pages", "page_by_number", "top_k", "page_following"])
def test_pages_are_top_k(plan_of, name):
    plan = plan_of(name)
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_following_page_filters_the_scan(plan_of):
    assert "PushedFilters: [Or(" in plan_of("page_following")


@pytest.mark.parametrize(
    "name", ["search_fixed", "search_regex", "display_table", "name_check", "filter_tree", "ratio_zero_den"]
)
def test_row_wise_operators_do_not_shuffle(plan_of, name):
    plan = plan_of(name)
    assert "Exchange" not in plan and "*(1)" in plan


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_and_no_cross_join(plan_of, name):
    plan = plan_of(name)
    for word in ("Python", "Pandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_counting_or_paging_a_step_does_not_sort_it_first(spark, capsys):
    from cohortsift import catalogue
    from cohortsift.operators.paging import page, page_stats

    rows = catalogue.step_query(spark, FOLDER)
    for df in (page_stats(rows), page(rows, ["var_count"], 2)):
        capsys.readouterr()
        df.explain()
        assert "rangepartitioning" not in capsys.readouterr().out


def test_a_profile_reads_the_chosen_samples_once(spark, monkeypatch):
    """The sample filter reaches the profile's scan, and the next page finds the profile on the lake."""
    seen = []
    monkeypatch.setattr(steps, "profile_keys", lambda df, key, light: seen.append((df, key)) or joins.profile_keys(df, key, light))
    lake = catalogue._cohort(spark, FOLDER)
    options = {"sample_column": "l_suppkey", "may_broadcast": False}
    for _ in range(2):
        steps.run_step(catalogue.STEP_SPEC, lake, ["lineitem.parquet"], [3, 14], **options)
    assert sorted(key for _, key in seen) == ["`agg`.`l_partkey`", "`main_table`.`l_partkey`"]
    plan = next(df for df, key in seen if "main_table" in key)._jdf.queryExecution().executedPlan().toString()
    assert "In(l_suppkey, [14,3])" in plan or "In(l_suppkey, [3,14])" in plan
