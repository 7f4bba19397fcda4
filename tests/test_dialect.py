"""Functions of step files against DuckDB, by the same text."""

import datetime

import duckdb
import pytest

from cohortsift.functions import dialect
from cohortsift.sources.lake import Lake

AT = "timestamp '2021-03-04 15:06:07.000089'"
SAME = [
    f"strftime({AT}, '%Y-%m-%d')",
    f"strftime({AT}, '%d/%m/%y %H:%M:%S')",
    f"strftime({AT}, 'on %A, %d %B at %I %p (%j) T')",
    f"strftime({AT}, '%S.%f')",
    "strftime(cast(null as timestamp), '%Y')",
    "regexp_matches('abc', 'b')",
    "regexp_matches('abc', '^b')",
    "regexp_matches(null, 'b')",
    "regexp_full_match('abc', 'a|abc')",
    "regexp_full_match('abcd', 'a|abc')",
    "list_contains(string_split('a,b,c', ','), 'b')",
    "list_contains(string_split('a,b,c', ','), 'd')",
    "list_contains(cast(null as varchar[]), 'd')",
    "list_has_any(string_split('a,b', ','), string_split('x,b', ','))",
    "list_has_any(string_split('a,b', ','), string_split('x,y', ','))",
    "list_position(string_split('a.b.c', '.'), 'c')",
    "string_split('a.b..c', '.')",
    "prefix('abc', 'ab')",
    "suffix('abc', 'ab')",
    "strpos('abc', 'c')",
    "strpos('abc', 'x')",
    "parse_filename('/a/b/c.parquet')",
]


@pytest.fixture(scope="module")
def known(spark):
    Lake(spark)
    return spark


@pytest.mark.parametrize("text", SAME)
def test_same_value(known, text):
    ours = text.replace("cast(null as varchar[])", "cast(null as array<string>)").replace("cast(null as timestamp)", "cast(null as timestamp_ntz)")
    ours = ours.replace("timestamp '", "timestamp_ntz '")
    assert known.sql(f"select {ours} as v").first()["v"] == duckdb.sql(f"select {text}").fetchall()[0][0]


def test_unknown_part_is_refused(known):
    with pytest.raises(Exception, match="unknown part"):
        known.sql(f"select strftime({AT}, '%Q')").collect()


def test_no_python_and_the_body_in_place_of_the_call(known):
    df = known.range(3).selectExpr("cast(id as string) t").filter("regexp_matches(t, '^1')")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "RLIKE" in plan
    assert [r.t for r in df.collect()] == ["1"]


def test_a_name_of_the_users_stays(spark):
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION prefix(a STRING, b STRING) RETURNS STRING RETURN a || b")
    try:
        dialect.register(spark)
        assert spark.sql("select prefix('a', 'b') v").first()["v"] == "ab"
    finally:
        spark.sql("DROP TEMPORARY FUNCTION prefix")
        dialect.register(spark)
    assert spark.sql("select prefix('ab', 'a') v").first()["v"] is True


def test_time_of_a_table(known):
    at = datetime.datetime(1999, 12, 31, 23, 59, 58)
    df = known.createDataFrame([(at,)], "at timestamp_ntz").selectExpr("strftime(at, '%d.%m.%Y') v")
    assert df.first()["v"] == "31.12.1999"
