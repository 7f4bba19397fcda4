"""Tokeniser fertility: base counts and measures against plain forms, verdicts on planted texts."""

import math
import random
import re
from collections import Counter

import messy
import pytest
import sentencepiece
from tokenizers import Tokenizer

from cohortsift.llm import fertility
from cohortsift.llm.queries import QUERIES
from cohortsift.llm.shared import ship
from cohortsift.llm.tokens import default_vocabulary


def base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    words = messy.words(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if messy.words(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
        len(words) < 10 or 100 * len(covered) > 20 * len(words),
    )


def measures(text):
    words = messy.words(text)
    if not words:
        return (None,) * 4
    library, pieces = Tokenizer.from_file(default_vocabulary()), sentencepiece.SentencePieceProcessor(model_file=fertility.piece_vocabulary())
    tokens = sum(len(library.encode(" " + w, add_special_tokens=False).ids) for w in words)
    ids = [k for w in words for k in pieces.encode(w)]
    chars = sum(map(len, words))
    share = [n / len(ids) for n in Counter(ids).values()]
    entropy = 1.0 if len(ids) < 2 else -sum(s * math.log(s) for s in share) / math.log(len(ids))
    return chars / tokens, chars / len(ids), sum(pieces.is_byte(k) for k in ids) / len(ids), entropy


ODD = [
    (20, "a\nb\n\n a\na\nb\r\n##|<>", None, None),
    (21, "Слово за слово, и так далее 漢字 𝒳𝓎", None, None),
    (22, "one two three four five six one two three four five six seven", None, None),
    (23, "x " * 30, None, None),
    (24, "   \x1c\x85 word", None, None),
]


def test_counts_and_measures_of_odd_rows(spark):
    ship(spark)
    rows = [*messy.ROWS, *ODD]
    found = fertility.judged(messy.documents(spark, rows)).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    got = Counter((r["doc_id"], *(r[c] for c in names), *(None if r[m] is None else round(r[m], 9) for m in fertility.MEASURES)) for r in found)
    assert got == Counter((i, *base(t), *(None if m is None else round(m, 9) for m in measures(t))) for i, t, _, _ in rows)
    assert all(r["kept"] is (not r["base_failed"]) for r in found)  # too few rows for a band
    scripts = {r["doc_id"]: r["script"] for r in found}
    assert scripts[1] == "LATIN" and scripts[21] == "CYRILLIC" and scripts[5] == scripts[6] == scripts[8] == "NONE"
    assert fertility.judged(messy.documents(spark, [])).collect() == []


def test_bands_reject_what_splits_unlike_its_script(spark):
    ship(spark)
    draw = random.Random(1)
    stems = [a + b for a in "wind rain stone river house garden letter morning people".split() for b in ("", "s", "ing", "ed")]
    plain = [" ".join(draw.choice(stems) for _ in range(draw.randint(70, 120))) for _ in range(300)]
    odd = ["".join(draw.choice("qxzjkvw") for _ in range(400)), "zqxj " * 3 + " ".join("".join(draw.choice("qxzj7#") for _ in range(9)) for _ in range(80)),
           " ".join("".join(chr(draw.randint(0x10A0, 0x10C5)) if draw.random() < 0.3 else draw.choice("aeio") for _ in range(6)) for _ in range(90))]
    rows = [(k, t, "en", "a") for k, t in enumerate(plain + odd)]
    found = {r["doc_id"]: r for r in fertility.judged(messy.documents(spark, rows)).collect()}
    assert sum(found[k]["kept"] for k in range(300)) >= 290
    assert not found[301]["kept"] and "chars_per_piece" in found[301]["outside"]
    assert not found[302]["kept"] and "byte_share" in found[302]["outside"]
    assert found[300]["base_failed"]


def test_bands_are_bounded_in_number(spark):
    ship(spark)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    known = fertility.bands(fertility.measures(docs), enough=1)
    assert known.count() <= (len(fertility.SCRIPTS) + 2) * 32
    assert known.where("octave is null").count() == known.select("script").distinct().count()


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_words(seed):
    import numpy as np

    draw = random.Random(seed)
    texts = [[draw.randint(0, 2) for _ in range(draw.choice([0, 1, 4, 5, 6, 40, 90]))] for _ in range(200)]
    got = fertility.repeated(np.array([x for t in texts for x in t], np.int64), np.array([len(t) for t in texts]))
    assert [int(x) for x in got] == [base(" ".join(map(str, t)))[4] for t in texts]


def test_query_on_given_documents(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = QUERIES["op13_tokeniser_fertility"](spark, folder).collect()
    assert len(found) == len(texts)
    for r in found:
        counts = base(texts[r["doc_id"]])
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == counts
        assert not (r["kept"] and r["base_failed"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    good = [r["kept"] for r in found if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(good) >= 0.95 * len(good)
