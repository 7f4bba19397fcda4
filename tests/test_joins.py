"""Joins with heavy keys: the same rows as Spark's own join, in balanced tasks."""

import pytest
from oracle import spark_rows
from pyspark.sql import functions as F

from cohortsift.operators import joins
from cohortsift.operators.joins import KeyProfile, join, profile_keys

KINDS = ["inner", "left", "right", "full", "left_semi", "left_anti"]


@pytest.fixture(scope="module")
def sides(spark, tmp_path_factory):
    """Heavy on the left: 7. Heavy on the right: 8. On both: 9. And many NULLs."""
    left = spark.range(2000).select(
        F.expr("case when id % 3 = 0 then 7 when id % 10 = 1 then 8 when id % 10 = 2 then 9 "
               "when id % 10 = 4 then null when id % 50 = 5 then 100000 + id else id % 40 end").alias("k"),
        F.expr("id % 4").alias("a"),
    )
    right = spark.range(400).select(
        F.expr("case when id % 4 = 0 then 8 when id % 10 = 1 then 9 when id % 10 = 3 then null "
               "when id % 20 = 2 then 7 else id % 90 end").alias("k"),
        F.expr("id % 3").alias("b"),
    )
    folder = str(tmp_path_factory.mktemp("sides"))
    left.repartition(4).write.parquet(f"{folder}/left")
    right.repartition(3).write.parquet(f"{folder}/right")
    return spark.read.parquet(f"{folder}/left"), spark.read.parquet(f"{folder}/right")


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(joins, "fits_broadcast", lambda df: False)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def numbered(df):
    """Same column names on both sides are told apart by position."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


@pytest.mark.parametrize("light_rows", [5, 10**6])
@pytest.mark.parametrize("how", KINDS)
def test_dealt_join_keeps_rows(no_broadcast, sides, how, light_rows):
    left, right = sides[0].alias("l"), sides[1].alias("r")
    found = join(left, right, "l.k", "r.k", how, light_rows=light_rows)
    wanted = left.join(right, F.col("l.k") == F.col("r.k"), how)
    assert found.columns == wanted.columns
    assert spark_rows(numbered(found)) == spark_rows(numbered(wanted))


@pytest.mark.parametrize("how", KINDS)
def test_dealt_join_of_derived_sides(no_broadcast, sides, how):
    """Sides without a scan position: filtered under the alias, or aggregated."""
    left = sides[0].filter("a < 3").alias("l")
    right = sides[1].groupBy("k").agg(F.count("*").alias("n")).alias("r")
    found = join(left, right, "l.k", "r.k", how, light_rows=20)
    wanted = left.join(right, F.col("l.k") == F.col("r.k"), how)
    assert spark_rows(numbered(found)) == spark_rows(numbered(wanted))


def test_names_stay_qualified(no_broadcast, sides):
    left, right = sides[0].alias("l"), sides[1].alias("r")
    for how in ("inner", "left", "full"):
        rows = join(left, right, "l.k", "r.k", how, light_rows=5)
        assert rows.select("l.k", "r.k", "a", "b").filter("l.k = 9").count() > 0


def test_profile_finds_heavy_keys_and_nulls(sides):
    profile = profile_keys(sides[0], "k", light_rows=125)
    assert set(profile.cells) == {7, 8, 9}
    assert profile.cells[7] == 6  # 667 rows in cells of 125
    assert profile.null_cells == 2
    assert not profile_keys(sides[0], "k", light_rows=10**6)


def heaviest_share(df, spark):
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / sum(sizes)


def test_heavy_key_is_spread(spark, no_broadcast, sides):
    """Equal rows of one key end up in many tasks; without dealing, in one."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = sides[0].alias("l").filter("k = 7 and a = 1")
        right = sides[1].select("k").distinct().alias("r")
        plain = one.join(right, F.col("l.k") == F.col("r.k"))
        dealt = join(one, right, "l.k", "r.k", light_rows=10, left_profile=lambda: KeyProfile({7: 16}))
        assert plain.count() == dealt.count() > 100
        assert heaviest_share(plain, spark) == 1.0
        assert heaviest_share(dealt, spark) < 0.6
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_filters_still_reach_the_scan(no_broadcast, sides, capsys):
    left, right = sides[0].alias("l"), sides[1].alias("r")
    rows = join(left, right, "l.k", "r.k", light_rows=5).filter("l.a = 2").select("l.k", "r.b")
    rows.explain()
    plan = capsys.readouterr().out
    assert "EqualTo(a,2)" in plan
    assert "__left_cell" in plan


def test_small_side_is_left_to_spark(sides, monkeypatch):
    monkeypatch.setattr(joins, "profile_keys", lambda *a: pytest.fail("no profile needed"))
    left, right = sides[0].alias("l"), sides[1].alias("r")
    for how in KINDS:
        assert join(left, right, "l.k", "r.k", how).count() >= 0


def test_equal_sort_keys_are_spread(spark, many_parts, sides):
    """All rows have one sort value; a plain sort would put them in one task."""
    from cohortsift.operators.relational import order
    from cohortsift.plans.spec import OrderKey

    rows = sides[0].select((F.col("a") * 0).alias("one"))
    assert heaviest_share(rows.orderBy("one"), spark) == 1.0
    assert heaviest_share(order(rows, [OrderKey("one")]), spark) < 0.5
    assert order(rows, [OrderKey("one")]).columns == ["one"]


def test_row_of_the_main_table_is_named_in_a_join(sides):
    from cohortsift.operators.rows import row_hash

    both = sides[0].alias("main_table").join(sides[1].alias("r"), F.col("main_table.k") == F.col("r.k"))
    assert "row_index" in str(row_hash(both))
    plan = both.select("main_table.a", row_hash(both).alias("h"))
    assert plan.distinct().count() > 1000


@pytest.mark.parametrize("how", ["inner", "left", "full"])
def test_interval_keys_join_without_broadcast(spark, how):
    """The sketch cannot count intervals: such a join is Spark's own."""
    days = spark.range(40).select(F.expr("make_dt_interval(id % 4)").alias("k"), "id")
    rows = join(days.alias("l"), days.alias("r"), "l.k", "r.k", how, light_rows=1, may_broadcast=False)
    assert rows.count() == 400


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_an_outer_join_shuffles_each_side_once(no_broadcast, sides, how, capsys):
    left, right = sides[0].alias("l"), sides[1].alias("r")
    join(left, right, "l.k", "r.k", how, light_rows=5).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Join") - plan.count("BroadcastHashJoin") == 1


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_profiles_of_other_rows_lose_no_miss(no_broadcast, sides, how):
    """A profile may name keys that a side does not have, or miss some it has; cells may be empty."""
    left, right = sides[0].filter("k <> 8 or k is null").alias("l"), sides[1].filter("k <> 7 or k is null").alias("r")
    profiles = {"left_profile": lambda: KeyProfile({8: 50, 9: 40, 5: 7, -1: 3}, 4), "right_profile": lambda: KeyProfile({7: 30, 9: 500, -1: 2}, 2)}
    found = join(left, right, "l.k", "r.k", how, **profiles)
    wanted = left.join(right, F.col("l.k") == F.col("r.k"), how)
    assert spark_rows(numbered(found)) == spark_rows(numbered(wanted))


def test_whole_tables_reach_the_dealt_join(spark, capsys):
    from cohortsift.catalogue import QUERIES

    folder = "/root/testdata/sf0.01"
    rows = QUERIES["join_dealt_whole_full"](spark, folder)
    rows.explain()
    assert "__left_cell" in capsys.readouterr().out
    found = rows.agg(F.count_distinct("o_orderkey"), F.count_distinct("event_id")).first()
    assert tuple(found) == tuple(spark.read.parquet(f"{folder}/{t}.parquet").count() for t in ("orders", "events"))
