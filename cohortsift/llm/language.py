"""Language identification by nearest centroid over TF-IDF character n-grams.

A text is lower-cased, every run of non-letters becomes one space, and its n-grams of one
to three characters are hashed into ``DIMENSIONS`` places. Weights are
``log(1 + count) * idf``, scaled to length one. Document frequencies are counted over
all learning rows. Each language gets several centroids by spherical k-means over a
bounded sample of its learning rows (``fit_rows``, chosen by a hash). A text gets the
language of the centroid with the largest cosine. It is rejected if its cosine lies
below the limit of its language and length: ``share`` of the low ``quantile`` of the cosines that
all learning rows of that language and length (in powers of two) have with their own centroids.
A length with fewer than ``LEAST_ROWS`` such rows counts those of all languages, then shorter ones too;
texts shorter than all learning rows have ``tolerance`` of the quantile of the shortest.

Defined results: NULL texts and texts without a letter get ``und``, score 0, and are
rejected. Without a learning row every text gets ``und`` and score 0, and none with letters is
rejected. Rows with a NULL id or language
are never learned from. Equal cosines go to the smaller language name. Repeated rows are
judged one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsift.llm.shingles import give_back, parts

DIMENSIONS = 8192
#: Documents whose n-grams are counted at once.
BLOCK = 64
#: Characters of a text whose n-grams are counted at once.
STRIDE = 1 << 20
UNKNOWN = "und"
#: Lengths that are told apart, in powers of two of n-grams; bins of a cosine; rows for a quantile.
LENGTHS, BINS, LEAST_ROWS = 32, 100, 40

_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Of each code point, whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def _places(codes: np.ndarray) -> list[np.ndarray]:
    """The places of all n-grams that end at each character, by n."""
    mixed, found = np.zeros(len(codes), np.uint64), []
    for n in range(3):
        mixed = mixed[: len(codes) - n] * np.uint64(0x100000001B3) + codes[n:].astype(np.uint64) + np.uint64(1)
        found.append(((mixed * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(51)).astype(np.int64))
    return found


def counts(texts: list[str | None]) -> np.ndarray:
    """A row of n-gram counts for each text; zeros where it has no letter."""
    out = np.zeros((len(texts), DIMENSIONS), dtype=np.int64)
    is_letter, flat = _letters(), out.reshape(-1)
    buffered: list[tuple[int, np.ndarray]] = []

    def add() -> None:
        rows = np.repeat([r for r, _ in buffered], [len(c) for _, c in buffered])
        for n, place in enumerate(_places(np.concatenate([c for _, c in buffered]))):
            inside = rows[: len(rows) - n] == rows[n:]  # no n-gram over the end of a text
            np.add(flat, np.bincount((rows[n:] * DIMENSIONS + place)[inside], minlength=len(flat)), out=flat)
        buffered.clear()

    for row, text in enumerate(texts):
        for a in range(0, len(text or ""), STRIDE):
            codes = np.frombuffer(text[a : a + STRIDE + 2].lower().encode("utf-32-le", "replace"), "<u4")
            letter = is_letter[codes]
            if letter.any():
                codes = np.where(letter, codes, 32)
                kept = letter.copy()
                kept[1:] |= letter[:-1]  # the first of each run of non-letters
                buffered.append((row, codes[kept]))
                if sum(len(c) for _, c in buffered) >= STRIDE:
                    add()
    if buffered:
        add()
    return out


def _length(counted: np.ndarray) -> np.ndarray:
    """The power of two of each row's n-grams."""
    return np.minimum(np.log2(np.maximum(counted.sum(axis=1), 1)).astype(np.int64), LENGTHS - 1)


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]  # of each centroid
    limits: np.ndarray  # of each centroid and length
    centroids: np.ndarray
    idf: np.ndarray

    def vectors(self, counted: np.ndarray) -> np.ndarray:
        weights = np.log1p(counted, dtype=np.float32) * self.idf
        size = np.linalg.norm(weights, axis=1, keepdims=True)
        return weights / np.where(size > 0, size, 1)

    def judge(self, texts: list[str | None]) -> pd.DataFrame:
        """lang_pred, score and rejected of each text."""
        found = []
        for a in range(0, len(texts), BLOCK):
            counted = counts(texts[a : a + BLOCK])
            some = counted.any(axis=1)
            if not self.languages:
                found.append(pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "rejected": ~some}))
                continue
            cosines = self.vectors(counted) @ self.centroids.T
            best = cosines.argmax(axis=1)
            score = np.clip(cosines[np.arange(len(best)), best].astype(np.float64), 0, 1)
            names = np.where(some, np.array(self.languages, dtype=object)[best], UNKNOWN)
            rejected = ~some | (score < self.limits[best, _length(counted)])
            found.append(pd.DataFrame({"lang_pred": names, "score": np.where(some, score, 0.0), "rejected": rejected}))
        return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"lang_pred": [], "score": [], "rejected": []})

    def column(self, text: str = "text") -> Column:
        """A struct of lang_pred, score and rejected for a column of texts."""

        @F.pandas_udf("lang_pred string, score double, rejected boolean")
        def judged(texts: pd.Series) -> pd.DataFrame:
            give_back()
            return self.judge(texts.tolist())

        return judged(F.col(text))


def _idf(learn: DataFrame) -> np.ndarray:
    """Smoothed inverse document frequency of each place, over all rows."""

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(DIMENSIONS, np.int64), 0
        for part in parts(batches, texts=0):
            texts = part.column(0).to_pylist()
            for a in range(0, len(texts), BLOCK):
                there = counts(texts[a : a + BLOCK]) > 0
                total += there.sum(axis=0)
                rows += int(there.any(axis=1).sum())
        place = np.append(np.flatnonzero(total), -1)  # -1: the rows
        yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.append(total[place[:-1]], rows))], ["place", "n"])

    summed = learn.select("text").mapInArrow(frequencies, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    found = {r.place: r.n for r in summed.collect()}  # one row for each place at most
    rows = found.pop(-1, 0)
    df = np.zeros(DIMENSIONS)
    df[list(found)] = list(found.values())
    return np.log((1 + rows) / (1 + df)).astype(np.float32) + 1


def _clusters(vectors: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means, begun at the mean and the vectors farthest from those chosen."""
    first = vectors.mean(axis=0)
    chosen = [first / (np.linalg.norm(first) or 1)]
    while len(chosen) < min(k, len(vectors)):
        nearest = np.max(vectors @ np.array(chosen).T, axis=1)
        chosen.append(vectors[np.argsort(nearest, kind="stable")[len(nearest) // 10]])  # not the very outliers
    centroids = np.array(chosen)
    for _ in range(rounds):
        own = (vectors @ centroids.T).argmax(axis=1)
        sums = np.array([vectors[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


def _cosines(learn: DataFrame, model: LanguageModel) -> dict[str, np.ndarray]:
    """Of each language, how many of all its rows there are of each length and bin of the cosine with its own centroids."""
    own_centroids = {lang: np.array([name == lang for name in model.languages]) for lang in set(model.languages)}

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            names, texts = (np.array(part.column(i).to_pylist(), dtype=object) for i in range(2))
            for lang in sorted(set(names) & own_centroids.keys()):
                own, centroids = texts[names == lang].tolist(), model.centroids[own_centroids[lang]]
                for a in range(0, len(own), BLOCK):
                    counted = counts(own[a : a + BLOCK])
                    counted = counted[counted.any(axis=1)]
                    cosine = (model.vectors(counted) @ centroids.T).max(axis=1)
                    bins = np.clip((cosine * BINS).astype(np.int64), 0, BINS - 1)
                    cell, n = np.unique(_length(counted) * BINS + bins, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(cell), pa.string()), pa.array(cell), pa.array(n)], ["lang", "cell", "n"])

    binned_rows = learn.select("lang", "text").mapInArrow(binned, "lang string, cell long, n long")
    found = {lang: np.zeros((LENGTHS, BINS), np.int64) for lang in own_centroids}
    for r in binned_rows.groupBy("lang", "cell").agg(F.sum("n").alias("n")).collect():  # LENGTHS * BINS for each language at most
        found[r.lang].reshape(-1)[r.cell] = r.n
    return found


def _limits(own: np.ndarray, every: np.ndarray, quantile: float, share: float, tolerance: float) -> np.ndarray:
    """The limit of each length."""

    def low(rows: np.ndarray) -> float:
        return (int((np.cumsum(rows) > quantile * rows.sum()).argmax())) / BINS

    out, shortest = np.zeros(LENGTHS), np.flatnonzero(own.any(axis=1))[0]
    for length in range(LENGTHS):
        if length < shortest:
            out[length] = tolerance * low(own[shortest])
            continue
        wider = [rows[a : length + 1].sum(axis=0) for a in range(length, -1, -1) for rows in (own, every)]
        enough = next((rows for rows in wider if rows.sum() >= LEAST_ROWS), wider[-1])
        out[length] = share * low(enough)
    return out


def fit(learn: DataFrame, fit_rows: int = 256, per_language: int = 3, tolerance: float = 0.25, quantile: float = 0.05, share: float = 0.5) -> LanguageModel:
    """The model of the rows of ``learn`` (``text``, ``lang``) that have a language."""
    learn = learn.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    idf = _idf(learn)
    sizes = learn.groupBy("lang").agg(F.count("*").alias("__rows"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = learn.join(F.broadcast(sizes), "lang").where(draw * F.col("__rows") < fit_rows)  # a row for each language

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            names, texts = (part.column(i).to_pylist() for i in range(2))
            for a in range(0, len(texts), BLOCK):
                counted = counts(texts[a : a + BLOCK])
                own = [np.flatnonzero(c) for c in counted]
                places = [x.astype("<u2").tobytes() for x in own]
                times = [c[x].astype("<u4").tobytes() for c, x in zip(counted, own, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(names[a : a + BLOCK], pa.string()), pa.array(places, pa.binary()), pa.array(times, pa.binary())],
                    ["lang", "places", "times"],
                )

    rows = sample.select("lang", "text").mapInArrow(sparse, "lang string, places binary, times binary").collect()
    by: dict[str, list[np.ndarray]] = {}
    for lang, places, times in sorted(map(tuple, rows)):
        if len(places):
            by.setdefault(lang, []).append((places, times))
    languages, centroids = [], []
    shape = LanguageModel([], np.zeros(0), np.zeros((0, DIMENSIONS)), idf)
    for lang, own in by.items():
        counted = np.zeros((len(own), DIMENSIONS), np.int64)
        for row, (places, times) in zip(counted, own, strict=True):
            row[np.frombuffer(places, "<u2")] = np.frombuffer(times, "<u4")
        vectors = shape.vectors(counted)
        found = _clusters(vectors, per_language)
        languages += [lang] * len(found)
        centroids += list(found)
    model = LanguageModel(languages, np.zeros((len(languages), LENGTHS)), np.array(centroids, np.float32).reshape(-1, DIMENSIONS), idf)
    if not languages:
        return model
    by_length = _cosines(learn, model)
    limits = {lang: _limits(by_length[lang], sum(by_length.values()), quantile, share, tolerance) for lang in by_length}
    return replace(model, limits=np.array([limits[lang] for lang in languages]))
