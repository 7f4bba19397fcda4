"""Pages, their bounds, and the three ways to reach a deep one."""

import pytest
from pyspark.sql import functions as F

from cohortsift.operators import paging
from cohortsift.operators.selection import deep_page
from cohortsift.operators.paging import SortedPages, last_page, page, page_after, page_count, show_page, turn_to

ORDER = ["g desc", "x"]


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """Half the rows share one sort value, some have none."""
    path = str(tmp_path_factory.mktemp("rows")) + "/t"
    spark.range(1003).select(
        F.expr("case when id % 2 = 0 then 5 when id % 7 = 1 then null else id % 11 end").alias("g"),
        F.expr("case when id % 5 = 0 then double('nan') when id % 3 = 0 then null else (id % 17) / 2.0 end").alias("x"),
        F.col("id").alias("n"),
    ).repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def ordered(rows):
    keys = [F.col("g").desc_nulls_last(), F.col("x").asc_nulls_last(), F.col("n").asc_nulls_last()]
    return [r["n"] for r in rows.orderBy(*keys).collect()]


def ids(df):
    return [r["n"] for r in df.collect()]


def test_pages_partition_the_relation(rows, ordered):
    assert [n for p in range(1, 13) for n in ids(page(rows, ORDER, p, 90))] == ordered
    assert ids(page(rows, ORDER, 13, 90)) == []
    assert ids(page(rows, ORDER, 1, 0)) == []
    with pytest.raises(ValueError):
        page(rows, ORDER, 0)


def test_sorted_pages_equal_top_k(many_parts, rows, ordered):
    pages = SortedPages.of(rows, ORDER)
    assert pages.row_count == 1003 and len(pages.parts) > 1
    assert [n for p in range(1, 13) for n in ids(pages.page(p, 90))] == ordered
    assert ids(pages.page(13, 90)) == []
    last = pages.show("last", size=90)
    assert (last.number, last.page_count, ids(last.rows)) == (12, 12, ordered[990:])
    assert ids(show_page(pages, ORDER, 7, size=100).rows) == ordered[600:700]


def test_deep_page_skips_files(rows, capsys):
    SortedPages.of(rows, ORDER).page(60, 10).explain()
    assert "GreaterThanOrEqual(__place" in capsys.readouterr().out


def test_following_pages(rows, ordered):
    last, seen = None, []
    view = page(rows, ORDER, 1, 100).collect()
    while view:
        seen += [r["n"] for r in view]
        last = view[-1].asDict()
        view = page_after(rows, ORDER, last, 100).collect()
    assert seen == ordered


def test_last_page_from_the_end(rows, ordered):
    assert ids(last_page(rows, ORDER, 1003, 10)) == ordered[-3:]
    assert ids(last_page(rows, ORDER, 1003, 17)) == ordered[-17:]


def test_pages_write_nothing(rows, ordered, monkeypatch):
    monkeypatch.setattr(paging, "write_in_order", lambda *a: pytest.fail("a page was written"))
    assert ids(page(rows, ORDER, 3, 400)) == ordered[800:]


def test_show_page_moves(rows, ordered):
    assert (show_page(rows, ORDER, "next", current=2, size=100).number, turn_to("previous", 1, 11)) == (3, 1)
    view = show_page(rows, ORDER, 99, size=100)
    assert (view.number, view.page_count, view.row_count) == (11, 11, 1003)
    assert ids(view.rows) == ordered[1000:]
    assert show_page(rows, ORDER, 99, size=100, row_count=250).number == 3
    assert ids(show_page(rows, ORDER, "last", size=100).rows) == ordered[1000:]


def test_page_count():
    assert [page_count(n, 10) for n in (0, 1, 10, 11)] == [1, 1, 1, 2]


def test_shallow_page_is_top_k(rows, capsys):
    page(rows, ORDER, 5, 10).explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject(limit=50, offset=40" in plan and "Exchange" not in plan


@pytest.mark.parametrize("band_rows", [20, 200, 20_000])
def test_deep_pages_by_rank(rows, ordered, band_rows):
    """Ties over half the rows, NULLs and NaN: the pages of a full sort."""
    for number, size in ((1, 10), (6, 100), (50, 7), (11, 100), (2, 501)):
        assert ids(deep_page(rows, ORDER, number, size, band_rows)) == ordered[(number - 1) * size : number * size]
    assert ids(deep_page(rows, ORDER, 102, 10, band_rows)) == [] == ids(deep_page(rows, ORDER, 1, 0, band_rows))


@pytest.mark.parametrize("key", ["n desc", "d", "t desc", "p desc", "f", "b desc", "s", "one", "x desc"])
def test_keys_of_every_kind_guide_a_deep_page(spark, key):
    table = spark.range(700).selectExpr(
        "case when id % 9 = 0 then null else id * 37 % 700 end n", "date_add(date'2020-01-01', cast(id * 31 % 90 as int)) d",
        "timestamp_micros(id * 7919 % 700 * 1000003) t", "cast(id * 53 % 700 / 100 as decimal(9,2)) p", "cast(id * 17 % 50 as float) / 3 f",
        "id % 3 = 0 b", "concat('s', id % 40) s", "1 one", "case id % 4 when 0 then double('nan') when 1 then -0.0d when 2 then double('inf') else id / 7 end x", "id",
    )
    for number in (1, 30, 70):
        assert [r["id"] for r in deep_page(table, [key, "id"], number, 10, 30).collect()] == [r["id"] for r in page(table, [key, "id"], number, 10).collect()]


def test_a_deep_page_writes_nothing_and_narrows(rows, monkeypatch, capsys):
    monkeypatch.setattr(paging, "write_in_order", lambda *a: pytest.fail("a page was written"))
    deep_page(rows, ["n"], 60, 10, 20).explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan and "n#" in plan and ">= " in plan
