"""Quality by tokeniser fertility: how public vocabularies split a text, held against bands per script.

Four measures of each document: characters per token in the byte-level vocabulary, and in the
piece vocabulary, which falls back to bytes for signs it does not know; the share of such bytes among
its tokens; and the entropy of its tokens over the most that so many tokens can have. The
vocabularies are read as they are. Neither merges over white space, so each distinct word is encoded
once and remembered by the worker.

Documents are grouped by their script, the one most of their letters are of, and by the octave of
their number of words, as short texts scatter more. Over all documents of a group that pass the base rules, approximate
quantiles give each measure a band: the middle half widened by ``WIDTH`` times its own breadth, and by
no less than ``LEAST`` of the median, on both sides; the share of bytes is bounded above only, a twentieth off at least.
A document outside any band is rejected. A group of fewer than ``ENOUGH`` such documents has no
band of its own: it takes the one of all lengths of its script, or rejects nothing if that is small as well.

Base rules reject a text of fewer than 10 words, or with over a fifth of its words in five-word windows that
the text holds twice or more. The bands are a row for each script and octave, at most some hundred whatever the input, so
they are broadcast. Measures are computed once, in one pass over the texts, and kept as a table
of numbers.

Defined results: NULL and empty texts have no words and fail the base rules; a text without letters is of
the script "none"; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsift.llm.shared import stored
from cohortsift.llm.shingles import mixed, parts
from cohortsift.llm.tokens import default_vocabulary, encoder

#: The breadth of a band and what it is at least, in parts of the median.
WIDTH, LEAST = 1.5, 0.02
#: Documents whose quantiles are taken as their group's.
ENOUGH = 100
#: Words one worker remembers; with more it begins anew.
REMEMBERED = 800_000

MEASURES = ["chars_per_byte_token", "chars_per_piece", "byte_share", "token_entropy"]
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
_SCHEMA = f"{BASE}, script string, {', '.join(f'{m} double' for m in MEASURES)}"

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Scripts told apart, by the first word of their letters' names; others are "OTHER".
SCRIPTS = ["LATIN", "GREEK", "CYRILLIC", "ARMENIAN", "HEBREW", "ARABIC", "DEVANAGARI", "BENGALI", "TAMIL", "THAI", "GEORGIAN",
           "HANGUL", "ETHIOPIC", "HIRAGANA", "KATAKANA", "CJK"]
_BEYOND_LATIN = re.compile(r"[^\x00-ɏ]")
#: Bytes that begin a Latin letter (up to U+024F) or are a symbol.
_LATIN, _SYMBOL = np.zeros(256, bool), np.zeros(256, bool)
_LATIN[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC3, 0xCA)]] = True
_SYMBOL[list(SYMBOLS.encode())] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)

_KNOWN: dict[tuple[str, str], Fertility] = {}


def piece_vocabulary() -> str:
    """The path of the public vocabulary of 32 000 pieces with byte fallback."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Fertility:
    """Words as numbers, and what each of them is in the two vocabularies, remembered by the worker."""

    def __init__(self, byte_path: str, piece_path: str) -> None:
        import sentencepiece

        self._bytes = encoder(byte_path)
        self._pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self._is_byte = np.array([self._pieces.is_byte(k) for k in range(self._pieces.get_piece_size())])
        self._forget()

    def _forget(self) -> None:
        self._numbers: dict[bytes, int] = {}
        self._ids, self._ends = array("H"), array("q", [0])  # pieces of all words, one after the other
        self._signs, self._tokens = array("q"), array("q")

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The number of each word; numbers hold until the next call."""
        new = set(words).difference(self._numbers)
        if len(self._numbers) + len(new) > REMEMBERED and self._numbers:
            self._forget()
            new = set(words)
        for part in batched(new, 50_000):
            texts = [w.decode() for w in part]
            for ids in self._pieces.encode(texts, num_threads=1):
                self._ids.extend(ids)
                self._ends.append(len(self._ids))
            self._tokens.extend(len(ids) // 4 for ids in self._bytes.after_space(texts))
            self._signs.extend(map(len, texts))
            self._numbers.update(zip(part, range(len(self._numbers), len(self._signs)), strict=True))
        return np.fromiter(map(self._numbers.__getitem__, words), np.int64, len(words))

    def counts(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The code points and the byte-level tokens of each word."""
        return np.array(self._signs)[numbers], np.array(self._tokens)[numbers]

    def pieces(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many pieces each word has, the pieces of all words, and which of them are bytes."""
        ends = np.array(self._ends)
        starts, lengths = ends[numbers], np.diff(ends)[numbers]
        first = np.cumsum(lengths) - lengths
        ids = np.array(self._ids)[np.repeat(starts - first, lengths) + np.arange(int(lengths.sum()))]
        return lengths, ids, self._is_byte[ids]


def fertility(byte_path: str, piece_path: str) -> Fertility:
    key = (byte_path, piece_path)
    if key not in _KNOWN:
        _KNOWN[key] = Fertility(*key)
    return _KNOWN[key]


def script_of(text: str, latin: int) -> str:
    """The script of most letters, ties to the first by name; NONE without letters. ``latin`` of them are Latin."""
    counts = {"LATIN": latin}
    if not text.isascii():
        for sign, n in Counter(_BEYOND_LATIN.findall(text)).items():
            if sign.isalpha():
                name = unicodedata.name(sign, "OTHER").split(" ")[0]
                name = name if name in SCRIPTS else "OTHER"
                counts[name] = counts.get(name, 0) + n
    best = min(counts, key=lambda s: (-counts[s], s))
    return best if counts[best] else "NONE"


def repeated(numbers: np.ndarray, counts: np.ndarray, window: int = 5) -> np.ndarray:
    """The words of each text in windows that occur in it twice or more; ``numbers`` are the words of all texts."""
    text = np.repeat(np.arange(len(counts)), counts)
    n = len(numbers) - window + 1
    if n < 2:
        return np.zeros(len(counts), np.int64)
    signs = mixed(numbers.astype(np.uint64) + np.uint64(1))
    total = mixed(text[:n].astype(np.uint64) + _ODD)
    for k in range(window):
        total = mixed(total * _ODD + signs[k : k + n])
    inside = np.flatnonzero(text[:n] == text[window - 1 :])
    order = inside[np.argsort(total[inside], kind="stable")]
    same = total[order[1:]] == total[order[:-1]]
    starts = np.union1d(order[1:][same], order[:-1][same])
    edges = np.zeros(len(numbers) + 1, np.int64)
    edges[starts] += 1
    edges[starts + window] -= 1
    return np.bincount(text[np.cumsum(edges[:-1]) > 0], minlength=len(counts))


def entropy(ids: np.ndarray) -> float:
    """The entropy of the ids over that of as many different ones; 1 for a single one."""
    if len(ids) < 2:
        return 1.0
    share = np.bincount(ids)
    share = share[share > 0] / len(ids)
    return float(-(share * np.log(share)).sum() / np.log(len(ids)))


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The sum of each text's values; ``counts`` of them belong to it."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def _measured(batches: Iterator[pa.RecordBatch], byte_path: str, piece_path: str) -> Iterator[pa.RecordBatch]:
    known = fertility(byte_path, piece_path)
    for batch in parts(batches):
        texts = [t or "" for t in batch.column(1).to_pylist()]
        raw = [t.encode() for t in texts]
        signs = np.frombuffer(b"".join(raw), np.uint8)
        sizes = np.array([len(r) for r in raw])
        latin, symbols = _sums(_LATIN[signs], sizes), _sums(_SYMBOL[signs], sizes)
        words: list[bytes] = []
        n_words = np.zeros(len(texts), np.int64)
        for k, r in enumerate(raw):
            own = r.split()  # bytes part at the six ASCII white spaces only
            words += own
            n_words[k] = len(own)
        numbers = known.numbers(words)
        chars, tokens = (_sums(c, n_words) for c in known.counts(numbers))
        lengths, ids, is_byte = known.pieces(numbers)
        n_pieces = _sums(lengths, n_words)
        ends = np.cumsum(n_pieces)
        lines = [[x for x in t.split("\n") if x.strip(SPACES)] for t in texts]
        some = n_words > 0
        per = np.maximum(n_pieces, 1)
        found = [
            chars / np.maximum(tokens, 1), chars / per, _sums(is_byte, n_pieces) / per,
            np.array([entropy(ids[e - n : e]) for e, n in zip(ends, n_pieces, strict=True)], float),
        ]
        counts = [n_words, chars, symbols, [len(x) - len(set(x)) for x in lines], repeated(numbers, n_words)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in counts),
             pa.array([script_of(t, n) for t, n in zip(texts, latin, strict=True)], pa.string()),
             *(pa.array(m, pa.float64(), mask=~some) for m in found)],
            ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "script", *MEASURES],
        )


def measures(docs: DataFrame, byte_vocabulary: str | None = None, piece_model: str | None = None) -> DataFrame:
    """doc_id, the counts of the base rules, script and the four measures (NULL without words) of each document."""
    byte_path, piece_path = byte_vocabulary or default_vocabulary(), piece_model or piece_vocabulary()
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        lambda batches: _measured(batches, byte_path, piece_path), f"doc_id {kind}, {_SCHEMA}"
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _octave() -> Column:
    return F.floor(F.log2(F.greatest("n_words", F.lit(1)))).cast("int")


def bands(measured: DataFrame, width: float = WIDTH, least: float = LEAST, enough: int = ENOUGH) -> DataFrame:
    """script, octave (NULL: all), n and band (an array of low and high, one for each measure) of each group."""
    quarters = [F.percentile_approx(m, [0.25, 0.5, 0.75], 1000).alias(m) for m in MEASURES]
    groups = measured.where(~base_failed()).withColumn("octave", F.explode(F.array(_octave(), F.lit(None).cast("int"))))
    found = groups.groupBy("script", "octave").agg(F.count("*").alias("n"), *quarters).where(F.col("n") >= enough)

    def band(m: str) -> Column:
        low, middle, high = (F.col(m)[k] for k in range(3))
        margin = F.greatest(width * (high - low), least * middle)
        floor = F.lit(float("-inf")) if m == "byte_share" else low - margin
        return F.struct(floor.alias("low"), (high + (F.greatest(margin, F.lit(0.05)) if m == "byte_share" else margin)).alias("high"))

    return found.select("script", "octave", "n", F.array(*(band(m) for m in MEASURES)).alias("band"))


def judged(docs: DataFrame, byte_vocabulary: str | None = None, piece_model: str | None = None, enough: int = ENOUGH) -> DataFrame:
    """The rows of :func:`measures` with base_failed, kept and outside (the measures that lie outside their band)."""
    measured = stored(measures(docs, byte_vocabulary, piece_model), "measures")
    known = stored(bands(measured, enough=enough), "bands")  # a row for each script and octave
    own = known.where("octave is not null").select(F.col("script").alias("own_script"), F.col("octave").alias("own_octave"), F.col("band").alias("own"))
    whole = known.where("octave is null").select(F.col("script").alias("all_script"), F.col("band").alias("whole"))
    joined = measured.join(F.broadcast(own), (F.col("script") == F.col("own_script")) & (_octave() == F.col("own_octave")), "left")
    joined = joined.join(F.broadcast(whole), F.col("script") == F.col("all_script"), "left")
    band = F.coalesce("own", "whole")
    outside = F.array_compact(
        F.array(*(F.when((F.col(m) < band[k]["low"]) | (F.col(m) > band[k]["high"]), F.lit(m)) for k, m in enumerate(MEASURES)))
    )
    judged_ = joined.withColumn("base_failed", base_failed()).withColumn("outside", outside)
    kept = ~F.col("base_failed") & (F.size("outside") == 0)
    return judged_.select(*measured.columns, "base_failed", "outside", kept.alias("kept"))
