"""Scans, methods and CSV files."""

import json

import lakes
import pytest
from pyspark.sql import functions as F

from cohortsift.plans.spec import TableRef
from cohortsift.sources.csv_report import export_csv, flatten_for_csv
from cohortsift.sources.lake import Lake, scan_files
from cohortsift.sources.methods import load_method, read_methods


def test_first_file_names_the_columns(spark, tmp_path):
    one = lakes.write(spark, f"{tmp_path}/1", [(1, "a"), (2, None)], "n bigint, s string")
    two = lakes.write(spark, f"{tmp_path}/2", [("b", 9.5, 3)], "S string, extra double, n int")
    rows = scan_files(spark, [one, two, one])
    assert rows.columns == ["n", "s"] and rows.schema["n"].dataType.simpleString() == "bigint"
    assert sorted(map(tuple, rows.collect()), key=str) == sorted(
        [(1, "a"), (2, None), (1, "a"), (2, None), (3, "b")], key=str
    )
    # One scan per set of stored types, not one per file.
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 2
    assert scan_files(spark, [two, one, two][:1]).columns == ["S", "extra", "n"]
    with pytest.raises(ValueError, match="extra"):
        scan_files(spark, [two, one])
    with pytest.raises(ValueError, match="no files"):
        scan_files(spark, [])


def test_same_types_share_one_scan(spark, tmp_path):
    files = [lakes.write(spark, f"{tmp_path}/{i}", [(i, str(i))], "n bigint, s string") for i in range(5)]
    rows = scan_files(spark, files)
    assert rows.count() == 5
    assert "Union" not in rows._jdf.queryExecution().optimizedPlan().toString()


def test_table_names(spark, tmp_path):
    lakes.write(spark, f"{tmp_path}/it's.parquet", [(1,)], "n int")
    spark.range(3).createOrReplaceTempView("three_rows")
    lake = Lake(spark, str(tmp_path), {"given": spark.range(4)})

    def count(name, quoted=False):
        return lake.table(TableRef(name, "t", quoted)).select("t.*").count()

    assert count("'it''s.parquet'") == 1
    assert count("read_parquet(['it''s.parquet', 'it''s.parquet'])") == 2
    assert count("three_rows") == count("three_rows", quoted=True) == 3
    assert count("given") == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        Lake(spark, f"{tmp_path}/nowhere").table(TableRef("'t.parquet'", "t", False))


def test_methods(spark, tmp_path):
    (tmp_path / "rare.json").write_text(json.dumps([lakes.RARE, lakes.ALL_CALLS], indent=1), encoding="utf-8")
    (tmp_path / "final.json").write_text(json.dumps(lakes.ALL_CALLS), encoding="utf-8")
    (tmp_path / "méthode n° 2+ %.json").write_text(json.dumps([lakes.ALL_CALLS]), encoding="utf-8")
    names = sorted(r["method"] for r in read_methods(spark, str(tmp_path)).collect())
    assert names == ["final", "méthode n° 2+ %", "rare"]
    assert len(load_method(spark, str(tmp_path), "méthode n° 2+ %")) == 1
    assert [s.title for s in load_method(spark, str(tmp_path), "rare")] == ["Seldom seen", "All"]
    assert len(load_method(spark, str(tmp_path), "final")) == 1
    with pytest.raises(LookupError):
        load_method(spark, str(tmp_path), "none")


def test_csv_keeps_awkward_values(spark, tmp_path):
    schema = "n int, t string, tags array<string>, said array<struct<a:string,b:int>>"
    rows = [
        (1, 'say "hi", twice', ["x, y", None], [("q", 1)]),
        (2, "line\nbreak", [], []),
        (3, None, None, None),
        (4, "", ["x", "y"], [("'", None)]),
    ]
    df = spark.createDataFrame(rows, schema)
    export_csv(df, f"{tmp_path}/out")
    back = (
        spark.read.options(header=True, quote='"', escape='"', multiLine=True)
        .schema("n int, t string, tags string, said string")
        .csv(f"{tmp_path}/out")
    )
    found = {r["n"]: tuple(r)[1:] for r in back.collect()}
    assert found[1] == ('say "hi", twice', '["x, y",null]', '[{"a":"q","b":1}]')
    assert found[4][1] == '["x","y"]'
    assert found[2][0] == "line\nbreak"
    assert found[3] == (None, None, None)
    with pytest.raises(ValueError, match="twice"):
        flatten_for_csv(df.select("n", F.col("t").alias("N")))


def test_declared_schema(spark, tmp_path):
    lakes.write(spark, f"{tmp_path}/1.parquet", [(1, "a")], "n bigint, s string")
    lakes.write(spark, f"{tmp_path}/2.parquet", [(2,)], "n bigint")
    both = ["1.parquet", "2.parquet"]
    lake = Lake(spark, str(tmp_path), schemas=dict.fromkeys(both, "n bigint, s string"))
    assert sorted(map(tuple, lake.main(both).collect())) == [(1, "a"), (2, None)]
    with pytest.raises(ValueError, match="lacks the columns"):
        Lake(spark, str(tmp_path)).main(both)
