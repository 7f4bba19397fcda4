"""Display values and checks, value by value."""

import datetime

import pytest
from pyspark.sql import functions as F

from cohortsift.functions.checks import job_is_complete, valid_name
from cohortsift.functions.display import display, number_text, path_stem, path_stems
from cohortsift.functions.sqltext import expression, null_division, spark_text


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame([(v,) for v in rows], schema).select(column).collect()]


def test_path_stem(spark):
    paths = ["a/b/run.parquet", "run.1.parquet", "/x/.hidden", "plain", "dir/sub/", "a.", "..", None, ""]
    stems = ["run", "run.1", ".hidden", "plain", "sub", "a.", "..", None, ""]
    assert values(spark, path_stem(F.col("p")), paths, "p string") == stems
    assert values(spark, path_stems(F.col("p")), [["a/r1.parquet", "r2"], []], "p array<string>") == ["r1, r2", ""]


def test_valid_name(spark):
    names = ["Étude 7", "", "a-b", "名前 1", " ", "x\n", None, "long " * 20000]
    assert values(spark, valid_name(F.col("n")), names, "n string") == [True, False, False, True, True, False, None, True]


def test_job_is_complete(spark):
    rows = [("n", "m", ["f"], ["s"]), ("", "m", ["f"], ["s"]), ("n", None, ["f"], ["s"]), ("n", "m", [], ["s"]),
            ("n", "m", ["f"], None)]
    df = spark.createDataFrame(rows, "n string, m string, f array<string>, s array<string>")
    verdicts = df.select(job_is_complete(F.col("n"), F.col("m"), F.col("f"), F.col("s")))
    assert [r[0] for r in verdicts.collect()] == [True, False, False, False, False]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_display_by_type(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # 02:30 does not exist in New York on that day.
        skipped = datetime.datetime(2024, 3, 10, 2, 30, 5, 7)
        df = spark.createDataFrame(
            [(1, True, skipped, ["x", None, "y"], ["d/r.parquet"], 1.5), (2, None, None, None, None, None)],
            "n int, flag boolean, at timestamp_ntz, tags array<string>, parquet_files array<string>, v double",
        )
        shown = display(df.withColumn("zoned", F.expr("timestamp'2024-07-01 10:00:00'")))
        assert [tuple(r) for r in shown.collect()] == [
            (1, "Yes", "10/03/2024 02:30:05", "x, y", "r", 1.5, "01/07/2024 10:00:00"),
            (2, None, None, None, None, None, "01/07/2024 10:00:00"),
        ]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_spark_text():
    assert spark_text("\"a b\" = 'x \"y\" z'") == "`a b` = 'x \"y\" z'"
    assert spark_text("\"a\"\"b`c\" = 'it''s \\d'") == "`a\"b``c` = 'it''s \\\\d'"
    assert spark_text("t.x IN ('HIGH')") == "t.x IN ('HIGH')"


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("a / b", "try_divide(a, b)"),
        ("a + b / c * d % e", "a + try_mod(try_divide(b, c) * d, e)"),
        ("a / -b", "try_divide(a, -b)"),
        ("f(a / 2, 'x/y') / g(b)[1]", "try_divide(f(try_divide(a, 2), 'x/y'), g(b)[1])"),
        ("case when a/b > 1 then 1 end / 2", "try_divide(case when try_divide(a, b) > 1 then 1 end, 2)"),
        ("not a / b > 1 and x in (1, 2)", "not try_divide(a, b) > 1 and x in (1, 2)"),
        ("count(*) / 2", "try_divide(count(*), 2)"),
        ("`a/b` || 'c % d'", "`a/b` || 'c % d'"),
    ],
)
def test_division_is_rewritten(text, wanted):
    assert null_division(text) == wanted


@pytest.mark.parametrize("text", ["a / ", "/ b", "(a / b", "a / b)", "a div b / c", "a / b -- c", "a / b ? c"])
def test_division_that_cannot_be_read_is_refused(text):
    with pytest.raises(ValueError):
        null_division(text)


def test_division_leaves_other_errors(spark):
    df = spark.createDataFrame([(2147483647, 0, 7)], "a int, z int, c int")
    row = df.select(expression("c / z").alias("q"), expression("c % z").alias("r"), expression("c / 2").alias("h")).first()
    assert tuple(row) == (None, None, 3.5)
    for text in ("a + 1 + c / 2", "cast('x' as int) / c"):
        with pytest.raises(Exception, match="OVERFLOW|CAST_INVALID"):
            df.select(expression(text)).collect()


def test_numbers_in_plain_signs(spark):
    rows = [12345678.5, 1e7, -2.5e-4, 1.5, 1e20, 0.0, None, float("nan"), 123456789012.25]
    wanted = ["12345678.5", "10000000.0", "-0.00025", "1.5", "1.0E20", "0.0", None, "NaN", "123456789012.25"]
    assert values(spark, number_text(F.col("v")), rows, "v double") == wanted
