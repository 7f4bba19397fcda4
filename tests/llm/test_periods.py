"""Periodic runs against a search of all periods and places."""

import hashlib
import random
import zlib

import messy
import numpy as np
import pytest
from oracle import connect, duck_rows, spark_rows

from cohortsift.llm import periods
from cohortsift.llm.queries import ORACLES, QUERIES


def all_runs(words, least):
    """(start, period, length) of the runs, by comparing every word with every later one."""
    n, best = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                best.setdefault((i, j + q), q)
            i = j
    return sorted((s, q, e - s) for (s, e), q in best.items())


def without_repeats(words, runs):
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def random_words(draw, n):
    out, k = [], draw.choice([1, 2, 3, 10])
    while len(out) < n:
        block = [f"w{draw.randint(0, k)}" for _ in range(draw.randint(1, 60))]
        out += block if draw.random() < 0.5 else (block * 6)[: draw.randint(1, 5 * len(block))]
    return out[:n]


def found(df):
    return [(r["n_words"], [(x["start"], x["period"], x["length"]) for x in r["runs"]], r["collapsed"], r["collapsed_sha256"]) for r in df.collect()]


@pytest.mark.parametrize("shared", [64, 4096])
@pytest.mark.parametrize("least", [2, 5, 12])
def test_runs_are_those_of_brute_force(spark, monkeypatch, shared, least):
    monkeypatch.setattr(periods, "SHARED", shared)  # 64: many tiles and octaves for short texts
    draw = random.Random(shared + least)
    texts = [random_words(draw, draw.randint(1, 700)) for _ in range(60)] + [["x"] * 1000, [f"u{k}" for k in range(400)] * 3]
    for words in texts:
        ids = {w: k for k, w in enumerate(words)}
        numbers = np.array([ids[w] for w in words])
        pieces = []
        for first, n, low, high in periods.tiles(len(words)):
            got = periods.pieces(numbers[first : first + n], np.array([n]), np.array([low]), np.array([high]), least)
            pieces += [(int(q), int(s) + first, int(e) + first) for s, e, q in zip(*got, strict=True)]
        runs = []
        for q, s, e in sorted(pieces):
            if runs and runs[-1][0] == q and s + q <= runs[-1][2]:
                runs[-1][2] = max(runs[-1][2], e)
            else:
                runs.append([q, s, e])
        extent = {}
        for q, s, e in runs:
            extent[s, e] = min(q, extent.get((s, e), q))
        assert sorted((s, q, e - s) for (s, e), q in extent.items()) == all_runs(words, least)


def test_long_texts_are_stitched(spark):
    draw = random.Random(3)
    block = [f"v{draw.randint(0, 10**6)}" for _ in range(3000)]
    own = [f"u{k}" for k in range(5000)]
    words = own + (block * 4)[:10_500] + own[:4000] + ["a", "b"] * 2500 + own
    wanted = [(5000, 3000, 10_500), (19_500, 2, 5000)]
    for table in (messy.documents(spark, [(1, " ".join(words), "en", "a")]), messy.documents(spark, [(k, " ".join(words), "en", "a") for k in range(5)])):
        for n, runs, kept, digest in found(periods.periodic_runs(table)):
            assert n == len(words) and runs == wanted
            assert kept == without_repeats(words, wanted) and digest == hashlib.sha256(kept.encode()).hexdigest()


def test_odd_rows(spark):
    rows = found(periods.periodic_runs(messy.documents(spark)))
    assert len(rows) == len(messy.ROWS)
    kept = {(n, k) for n, runs, k, _ in rows if not runs}
    assert {(len(messy.words(t)), " ".join(messy.words(t))) for _, t, _, _ in messy.ROWS if t is None or len(t) < 1000} == kept
    n = len(messy.words(messy.LONG))
    assert sorted((n, runs, k) for n, runs, k, _ in rows if runs) == [
        (n, [(0, 6, n)], "Von den Dingen und der Welt."), (n + 1, [(0, 6, n)], "Von den Dingen und der Welt. Ende"),
    ]
    assert found(periods.periodic_runs(messy.documents(spark, []))) == []
    repeated = [(None, "a b " * 9, None, None)] * 40 + [(7, "a b " * 9, None, None)] * 3 + [(7, "a  b\n" * 9, None, None)]
    assert {str(r) for r in found(periods.periodic_runs(messy.documents(spark, repeated)))} == {
        str((18, [(0, 2, 18)], "a b", hashlib.sha256(b"a b").hexdigest()))
    }
    with pytest.raises(ValueError, match="at least two words"):
        periods.periodic_runs(messy.documents(spark), least=1)


def test_query_is_its_sql_and_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = QUERIES["op11_periodic_runs"](spark, folder)
    assert spark_rows(rows) == duck_rows(connect(folder), ORACLES["op11_periodic_runs"])
    by_id = {r["doc_id"]: r for r in rows.collect()}
    periodic = 0
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        words = messy.words(r["text"])
        h, n = zlib.crc32(str(r["doc_id"]).encode()), len(words)
        if n > 3000:
            continue
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = all_runs(words, 12)
        got = by_id[r["doc_id"]]
        periodic += bool(runs)
        assert got["n_runs"] == len(runs) and got["collapsed_sha256"] == hashlib.sha256(without_repeats(words, runs).encode()).hexdigest()
        assert got["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, q, m in runs).encode()).hexdigest()
        top = min(((-m, s, q) for s, q, m in runs), default=None)
        assert (got["start"], got["length"], got["period"]) == ((top[1], -top[0], top[2]) if top else (None, None, None))
    assert periodic > 10
