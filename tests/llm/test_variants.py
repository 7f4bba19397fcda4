"""Spelling variants against a comparison of all words."""

import random

import messy
import pytest
from oracle import connect, duck_rows, spark_rows

from cohortsift.llm.queries import ORACLES, QUERIES
from cohortsift.llm.variants import Acceptor, near_words, spelling_variants, vocabulary


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_force(counts, ratio):
    out = {}
    for w, n in counts.items():
        around = [v for v in counts if near(v, w)]
        best = min(around, key=lambda v: (-counts[v], v), default=None)
        form = best if best is not None and counts[best] >= ratio * n else None
        out[w] = (form, n, len(around), counts[form] if form else None)
    rows = set()
    for w, (form, n, around, form_n) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows.add((w, form, root, n, around, form_n))
    return rows


def rows(df):
    return [(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()]


@pytest.mark.parametrize("seed", range(4))
def test_machine_accepts_pairs_one_edit_apart(seed):
    draw = random.Random(seed)
    for _ in range(60):
        letters = "abcdé𝒳g"[: draw.choice([2, 3, 7])]
        words = sorted({"".join(draw.choice(letters) for _ in range(draw.randint(0, 7))) for _ in range(draw.randint(1, 50))})
        machine = Acceptor(words)
        assert sorted(machine.common(machine.start, machine.start)) == words
        pairs = list(machine.one_edit_apart())
        assert len(pairs) == len(set(pairs)) and all(len(a) <= len(b) for a, b in pairs)
        assert {frozenset(p) for p in pairs} == {frozenset((a, b)) for a in words for b in words if near(a, b)}


def test_machine_is_minimal():
    endings = ["".join(p) for p in ("ing", "ed", "er", "s")]
    machine = Acceptor(sorted(f"{a}{b}{e}" for a in "pqrst" for b in "xyz" for e in endings))
    assert len(machine.states) == len(Acceptor(sorted(f"p{e}" for e in endings)).states) + 1


@pytest.mark.parametrize("heavy", [1, 10, 10_000])
def test_variants_are_those_of_brute_force(spark, heavy):
    """A third of the words has the same beginning; with a small bound its state is cut again and again."""
    draw = random.Random(heavy)
    counts = {}
    for _ in range(300):
        word = ("prefix" if draw.random() < 0.4 else "") + "".join(draw.choice("abé") for _ in range(draw.randint(1, 7)))
        counts[word] = draw.choice([1, 2, 5, 11, 60, 61, 400, 3000])
    found = rows(spelling_variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(5), 5, heavy))
    assert len(found) == len(counts) and set(found) == brute_force(counts, 5)
    assert any(form and root != form for _, form, root, *_ in found)


def test_long_words_and_none(spark):
    long = "ab" * 3000
    words = [(long, 100), (long[:-1], 10), ("x" + long, 1), ("cdefgh", 3)]
    found = rows(spelling_variants(spark.createDataFrame(words, "word string, n long")))
    assert set(found) == brute_force(dict(words), 5)
    none = spark.createDataFrame([], "word string, n long")
    assert rows(spelling_variants(none)) == [] and near_words(none).count() == 0
    with pytest.raises(ValueError, match="ratio"):
        spelling_variants(none, ratio=1)


def test_vocabulary_of_odd_rows(spark):
    odd = spark.createDataFrame([("abcdef", "x")] * 5 + [("abcde", "x")] * 9 + [("ghijkl", "x")] * 4 + [(None, "x")] * 7 + [("", "x")] * 7, "word string, n string")
    assert [tuple(r) for r in vocabulary(odd).collect()] == [("abcdef", 5)]


def test_query_is_its_sql(spark, tmp_path):
    for folder in ("/root/testdata/sf0.001", str(tmp_path)):
        if folder == str(tmp_path):
            text = "naïveté Naïveté NAïVETé naïvete naivete ÀÉÎÕÜß " * 7
            own = [*messy.ROWS, (99, text, "fr", "a"), (100, text, "fr", "a"), (None, text, None, None)]
            messy.documents(spark, own).write.parquet(f"{folder}/documents.parquet")
            import duckdb

            duck = duckdb.connect()
            duck.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
        else:
            duck = connect(folder)
        found = spark_rows(QUERIES["op12_spelling_variants"](spark, folder))
        assert found == duck_rows(duck, ORACLES["op12_spelling_variants"]) and sum(found.values()) >= 5
