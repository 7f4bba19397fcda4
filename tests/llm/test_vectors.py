"""The two searches against brute force."""

import duckdb
import numpy as np
import pytest

from cohortsift.llm import exact_topk, multi_index, vectors
from cohortsift.llm.queries import ORACLES, QUERIES
from oracle import connect, duck_rows, spark_rows

SMALL = "/root/testdata/sf0.01"
SCHEMA = "vec_id bigint, embedding array<float>, score string, rank int, label int"
NAN, INF = float("nan"), float("inf")
ODD = [
    (0, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (3, [-1.0, 0.0]), (4, [2.0, 0.0]), (5, [0.0, 0.0]),
    (6, None), (7, [NAN, 1.0]), (8, [INF, 1.0]), (9, [None, 1.0]), (None, [1.0, 0.0]), (100, None), (10, [0.1]), (11, []), (12, [1.0, 0.1]),
]


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, 1) for i, v in rows], SCHEMA)


def test_exact_topk_is_the_sql(spark):
    assert spark_rows(QUERIES["op9_exact_topk"](spark, SMALL)) == duck_rows(connect(SMALL), ORACLES["op9_exact_topk"])


def of_odd_rows(k, score, takes_part):
    """The k best other rows of each query among ODD, row by row; repeated rows ask and are found one by one."""
    rows = [(i, np.pad(v, (0, 2 - len(v)))) for i, v in ODD if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    rows = [(i, np.float32(v).astype(np.float64)) for i, v in rows if takes_part(v)]
    out = []
    for n, (q, x) in enumerate(rows):
        if q % 50 == 0:
            best = sorted((-score(x, y), i) for m, (i, y) in enumerate(rows) if m != n)[:k]
            out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_exact_topk_of_odd_rows(spark, tmp_path):
    for k in (1, 3, 20):
        found = sorted(map(tuple, exact_topk.search(table(spark, ODD), every=50, k=k).collect()))
        assert found == of_odd_rows(k, lambda x, y: int(np.floor(256 * x) @ np.floor(256 * y)), lambda v: True)
    assert (50, 1, 4, 131072) in found and found.count((50, 1, 4, 131072)) == 2  # asked by both rows of the id
    few = sorted(map(tuple, exact_topk.search(table(spark, [(0, [1.0]), (7, [-1.0])]), every=50, k=3).collect()))
    assert few == [(0, 1, 7, -65536)]
    assert exact_topk.search(table(spark, []), every=50).collect() == []
    table(spark, ODD + [(50, [3.0, 1.0]), (50, [-3.0, 1.0])] * 7).write.parquet(f"{tmp_path}/embeddings.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = spark_rows(QUERIES["op9_exact_topk"](spark, str(tmp_path)))
    assert found == duck_rows(duck, ORACLES["op9_exact_topk"]) and sum(found.values()) == 5 * (14 + 2 + 1)


def test_exact_topk_among_many_ties(spark):
    rows = [(i, [1.0, 1.0]) for i in range(400)] + [(500, [1.0, 2.0])]
    found = exact_topk.search(table(spark, rows), every=50, k=4).where("query_id = 100").orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in found] == [(500, 196608), (0, 131072), (1, 131072), (2, 131072)]


def test_blocks_of_queries_are_not_broadcast(spark):
    draw = np.random.default_rng(3)
    rows = [(i, draw.normal(size=64).tolist()) for i in range(4000)]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100k")  # the queries are below it, their copies would be beyond
    try:
        found = exact_topk.search(table(spark, rows), every=50, k=3)
        assert len(found.collect()) == 240
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    above = []  # depths of the broadcasts that a line of the plan stands below
    for line in found._jdf.queryExecution().executedPlan().toString().splitlines():
        depth = len(line) - len(line.lstrip(" :+-"))
        above = [d for d in above if d < depth] + [depth] * ("BroadcastExchange" in line)
        assert not above or "MapInArrow" not in line


def test_exact_topk_with_many_panels_of_queries(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PANEL", 1)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    draw = np.random.default_rng(4)
    rows = [(i, np.float32(draw.normal(size=8)).tolist()) for i in range(700)]
    assert vectors.panels(vectors.clean(table(spark, rows), "vec_id", "embedding", 4)) == 44
    whole = np.floor(256 * np.array([v for _, v in rows]))
    wanted = []
    for q in range(0, 700, 10):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:4]
        wanted += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert sorted(map(tuple, exact_topk.search(table(spark, rows), every=10, k=4).collect())) == wanted


def test_panels_hold_few_bytes(spark):
    wide = spark.range(9).selectExpr("id AS vec_id", "array_repeat(0.5D, 1 << 20) AS vector")
    assert vectors.panels(wide) == 3 and vectors.panels(wide.where("vec_id < 0")) == 1


def test_whole_numbers_are_packed_in_few_bytes(spark):
    for size, width in ((127.9, 2), (128.0, 4), (2.0**22, 4), (2.0**23, 8), (1e300, 8)):
        rows = spark.createDataFrame([(1, [size, -0.3]), (2, [-0.25])], "vec_id long, vector array<double>").coalesce(1)
        (block,) = [r.asDict() for r in vectors.pack(rows, whole=True).collect()]
        ids, matrix = vectors.unpack(block)
        assert len(block["matrix"]) == 4 * width and ids.tolist() == [1, 2]
        assert matrix.dtype == np.float64 and matrix.tolist() == [[np.floor(256 * size), -77.0], [-64.0, 0.0]]


def test_parts_of_intervals():
    draw = np.random.default_rng(5)
    for far in (100, 1 << 30, 1 << 50, 1 << 52, 1 << 62):
        for kind in (np.float64, np.int64):
            if far < 1 << 53 or kind == np.int64:
                scores = draw.integers(-far, far, (40, 7)).astype(kind)
                for wide in (2 * far, far // 3 + 1, 70):
                    lo = draw.integers(-far, far, 7)
                    lo[0], wide = -far, min(wide, exact_topk.MOST)
                    hi = lo + np.minimum(wide, exact_topk.MOST - np.maximum(lo, 0))
                    counts = draw.random((40, 7)) < 0.9
                    found = np.sort(exact_topk._cells(scores, counts, lo, hi)).tolist()
                    step = [(int(h) - int(x)) // exact_topk.BINS + 1 for x, h in zip(lo, hi)]
                    wanted = [
                        q * exact_topk.BINS + (int(s) - int(lo[q])) // step[q]
                        for v, row in enumerate(scores) for q, s in enumerate(row) if counts[v, q] and lo[q] <= int(s) <= hi[q]
                    ]
                    assert found == sorted(wanted)


def test_products_beyond_doubles_are_exact():
    a = np.array([[2.0**40, 3.0]])
    assert exact_topk.inner_products(a, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 3]]
    assert exact_topk.inner_products(a, np.array([[2.0**60, 1.0]])).tolist() == [[exact_topk.MOST]]


def near(rows, every, k):
    vectors = {i: np.array(v, dtype=np.float64) for i, v in rows}
    out = {}
    for q, x in vectors.items():
        if q % every == 0:
            score = {i: float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)) for i, y in vectors.items() if i != q}
            out[q] = sorted(score.items(), key=lambda s: (-s[1], s[0]))[:k]
    return out


@pytest.mark.parametrize("groups", [0, 20])
def test_recall(spark, groups):
    draw = np.random.default_rng(groups)
    base = draw.normal(size=(max(groups, 1), 24))
    rows = [(i, (base[i % groups] + 0.3 * draw.normal(size=24) if groups else draw.normal(size=24)).astype(np.float32).tolist()) for i in range(1500)]
    found = {}
    for r in multi_index.search(table(spark, rows), every=50, k=5).collect():
        found.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    wanted = near(rows, 50, 5)
    assert found.keys() == wanted.keys() and all(len(v) == 5 for v in found.values())
    hits = sum(i in found[q] for q, best in wanted.items() for i, _ in best)
    assert hits >= 0.9 * 5 * len(wanted)
    for q, best in wanted.items():
        for i, s in best:
            assert i not in found[q] or abs(found[q][i] - s) < 1e-12


def test_near_vectors_of_odd_rows(spark):
    for k in (2, 4, 20):
        found = sorted(map(tuple, multi_index.search(table(spark, ODD), every=50, k=k).collect()))
        wanted = of_odd_rows(k, lambda x, y: round(float(x @ y / np.sqrt(x @ x) / np.sqrt(y @ y)), 12), lambda v: any(v))
        assert [(*r[:3], round(r[3], 12)) for r in found] == wanted
    few = multi_index.search(table(spark, [(0, [1.0]), (7, [-1.0])]), every=50, k=3).collect()
    assert [tuple(r) for r in few] == [(0, 1, 7, -1.0)]
    assert multi_index.search(table(spark, []), every=50).collect() == []
    huge = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1e-300, 1e-300]), (2, [1.0, -1.0])], "vec_id bigint, embedding array<double>")
    assert [(r["vec_id"], round(r["score"], 12)) for r in multi_index.search(huge, every=50, k=2).orderBy("rank").collect()] == [(1, 1.0), (2, 0.0)]


def test_every_code_within_the_radius_is_reached():
    draw = np.random.default_rng(4)
    a, b = draw.integers(0, 256, (2, 4000, 8), dtype=np.uint8)
    b[:2000] = a[:2000] ^ (draw.random((2000, 8)) < 0.5) * (1 << draw.integers(0, 8, (2000, 8))).astype(np.uint8)
    by_byte = multi_index._POPCOUNT[a ^ b]
    for radius in range(0, 40):
        inside = by_byte.sum(axis=1) <= radius
        assert (by_byte[inside] <= multi_index.reach(radius)).any(axis=1).all()
