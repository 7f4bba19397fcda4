"""Files that cannot hold a text are not read, and no row is lost."""

import re

import pytest
from hypothesis import given
from hypothesis import strategies as st
from oracle import spark_rows

from cohortsift.operators.search import search
from cohortsift.sources.search_index import SearchIndex, required

ROWS = [
    [(1, "Straße ΑΒΓ", 100.5), (2, None, None), (3, "", 7.0)],
    [(11, "abcdef", 1.0), (12, "😀😀😀x", 2.0)],
    [(21, None, None)],
    [(31, "kelvin K and ſunny İi", 12345678.25), (32, "RED apple t", 3.0)],
]
SCHEMA = "k int, t string, x double"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("table") / "a b")
    for rows in ROWS:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(root)
    return spark.read.schema(SCHEMA).parquet(root)


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    made = SearchIndex(spark, str(tmp_path_factory.mktemp("index")))
    made.take(table)
    return made


@pytest.mark.parametrize(
    ("text", "columns", "regexp", "files"),
    [
        ("STRASSE", None, False, 0),
        ("straße αβγ", None, False, 1),
        ("bcd", ["t"], False, 1),
        ("bcd", ["k", "x"], False, 0),
        ("12345678.2", None, False, 1),
        ("😀😀x", None, False, 1),
        ("RED", ["t"], False, 1),
        ("x", None, False, 4),
        ("", None, False, 4),
        ("^red .*t$", ["t"], True, 1),
        ("sunny", ["t"], True, 1),
        ("kelvin k", ["t"], True, 1),
        ("abc|red", ["t"], True, 4),
        ("abq?cdef", ["t"], True, 1),
    ],
)
def test_same_rows_from_fewer_files(table, index, text, columns, regexp, files):
    found = index.search(table, text, columns, regexp=regexp)
    assert spark_rows(found) == spark_rows(search(table, text, columns, regexp=regexp))
    assert len(found.inputFiles()) == files


def test_what_was_not_taken_is_read(spark, table, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"))
    assert len(index.search(table, "abcdef").inputFiles()) == 4
    index.take(table, ["t"])
    assert len(index.search(table, "abcdef").inputFiles()) == 4  # in k and x it may be
    assert len(index.search(table, "abcdef", ["t"]).inputFiles()) == 1
    assert len(index.search(table, "abcdef", ["t"], raw=True).inputFiles()) == 4
    index.take(table, raw=True)
    assert len(index.search(table, "abcdef", ["t"], raw=True).inputFiles()) == 1
    with pytest.raises(ValueError, match="no columns"):
        index.search(table, "abcdef", ["nothing"])


def test_a_file_taken_again(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.createDataFrame([("first text",)], "t string").coalesce(1).write.parquet(root)
    index = SearchIndex(spark, str(tmp_path / "index"))
    index.take(spark.read.parquet(root))
    file = spark.read.parquet(root).inputFiles()[0]
    spark.createDataFrame([("second",)], "t string").coalesce(1).write.parquet(str(tmp_path / "u"))
    other = spark.read.parquet(str(tmp_path / "u")).inputFiles()[0]
    with open(other.removeprefix("file://"), "rb") as new, open(file.removeprefix("file://"), "wb") as old:
        old.write(new.read())
    (tmp_path / "t" / f".{file.rsplit('/', 1)[1]}.crc").unlink()
    spark.catalog.refreshByPath(root)
    index.take(spark.read.parquet(root))
    assert index.search(spark.read.parquet(root), "second").collect() == [("second",)]
    assert len(index.search(spark.read.parquet(root), "first").inputFiles()) == 0


def test_partition_columns_stay(spark, tmp_path):
    root = str(tmp_path / "t")
    spark.createDataFrame([("first text", 1), ("second", 2)], "t string, run int").write.partitionBy("run").parquet(root)
    df = spark.read.parquet(root)
    index = SearchIndex(spark, str(tmp_path / "index"))
    index.take(df)
    found = index.search(df, "second")
    assert found.collect() == [("second", 2)]
    assert len(found.inputFiles()) == 1


@given(st.text("abcx.*+?^$", max_size=12), st.text("abcx", max_size=10))
def test_required_texts_are_in_every_match(pattern, text):
    try:
        found = re.search(pattern, text, re.IGNORECASE)
    except re.error:
        return
    if found:
        assert all(part in text for part in required(pattern))


def test_required():
    assert required("^RED .*tent$") == ["RED ", "tent"]
    assert required("abcd?efg+hhh") == ["abc", "efg", "hhh"]
    assert required("ab.c(d)eee") == required("a\\dbcde") == required("straße") == []
