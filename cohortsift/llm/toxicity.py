"""Toxicity by weak supervision: many voters, a label model, and a linear classifier.

A text's features are its distinct words (letters only, lower case), their prefixes and
three patterns (shouting, exclamations, repetition), hashed into ``PLACES``. From a bounded
sample of labelled rows (``fit_rows``, by hash) come

* the voters: words, prefixes and patterns found far more often in toxic rows, each as
  "occurs" and as "occurs in two distinct words at least"; the given label is a voter too;
* the label model: by expectation maximisation, how often each voter fires in toxic and
  in other rows. Voters that fire together within a class count for less, by the sum of
  their correlations. It gives each row a posterior label;
* the classifier: logistic regression of the posterior labels on the features whose share of
  toxic rows is unlike that of others (``least_z``).

Every text then gets the classifier's score; labels, language, source and id are no inputs.

Defined results: NULL and empty texts get the score of a text without words; rows with a NULL
id or label are not learned from; several labels of an id count as their maximum. Without
both labels in the sample every score is the share of toxic rows (0 if there are none).
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACES = 1 << 18
PREFIXES = (4, 5, 6)
#: Weights of words that a Python worker remembers.
REMEMBERED = 500_000

_WORDS = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> set[str]:
    """The distinct words of a text, and its patterns (named with a space, which no word has)."""
    text = text or ""
    every = _WORDS.findall(text.lower())
    found = set(every)
    if len(every) >= 20 and len(found) < 0.3 * len(every):
        found.add(" repeats")
    if text.count("!") >= 3:
        found.add(" exclaims")
    if text.isupper():
        found.add(" shouts")
    return found


def places(word: str) -> list[int]:
    """The places of a word and of its prefixes."""
    keys = [word, *(f"{word[:n]} {n}" for n in PREFIXES if len(word) >= n and word[0] != " ")]
    return [zlib.crc32(k.encode("utf-8", "replace")) % PLACES for k in keys]


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The places of a text and in how many distinct words each occurs."""
    return np.unique(np.array([p for w in words(text) for p in places(w)], dtype=np.uint32), return_counts=True)


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    voters: int = 0
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> tuple:
        return self.weights, self.bias, self.voters

    def __setstate__(self, state: tuple) -> None:
        self.weights, self.bias, self.voters = state
        self.known = {}

    def score(self, text: str | None) -> float:
        own = words(text)
        if len(self.known) > REMEMBERED:
            self.known.clear()
        for w in own.difference(self.known):
            self.known[w] = float(self.weights[places(w)].sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + sum(map(self.known.__getitem__, own)), -30, 30))))

    def column(self, text: str = "text") -> Column:
        @F.pandas_udf("double")
        def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([self.score(t) for t in texts], dtype="float64")

        return scored(F.col(text))


@dataclass
class _Rows:
    """Sparse rows: the place and count of each entry, and the row it belongs to."""

    row: np.ndarray
    place: np.ndarray
    count: np.ndarray
    n: int

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.count * weights[self.place], self.n)

    def back(self, by_row: np.ndarray) -> np.ndarray:
        return np.bincount(self.place, self.count * by_row[self.row], PLACES)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def choose_voters(rows: _Rows, toxic: np.ndarray, most: int) -> np.ndarray:
    """Votes (a row for each row, a column for each voter) of the features that tell toxic rows apart best."""
    columns = []
    for least in (1, 2):
        entry = rows.count >= least
        with_toxic = np.bincount(rows.place[entry], toxic[rows.row[entry]], PLACES)
        with_any = np.bincount(rows.place[entry], minlength=PLACES)
        share, base = (with_toxic + 0.5 * toxic.mean()) / (with_any + 0.5), toxic.mean()
        good = np.flatnonzero((with_toxic >= 3) & (share > min(0.9, 3 * base)))
        best = good[np.argsort(-(with_toxic[good] * np.log(share[good] / base)), kind="stable")][:most]
        slot = np.full(PLACES, -1)
        slot[best] = np.arange(len(best))
        votes = np.zeros((rows.n, len(best)), dtype=bool)
        own = entry & (slot[rows.place] >= 0)
        votes[rows.row[own], slot[rows.place[own]]] = True
        columns.append(votes)
    return np.hstack(columns)


def label_model(votes: np.ndarray, label: np.ndarray, rounds: int = 20) -> np.ndarray:
    """The posterior of each row. A voter that does not fire abstains; the given label votes either way."""
    v, given = votes.astype(np.float64), label.astype(np.float64)
    q = 0.02 + 0.96 * given
    prior = np.clip(given.mean(), 1e-3, 1 - 1e-3)  # the balance of the classes is the labels'
    for _ in range(rounds):
        rates, right, correlated = [], [], np.zeros((v.shape[1], v.shape[1]))
        for side, votes_for in ((q, given), (1 - q, 1 - given)):
            mean = (side @ v + 0.5) / (side.sum() + 1)
            apart = (v - mean) * np.sqrt(side)[:, None]
            together = apart.T @ apart / max(side.sum(), 1)
            spread = np.sqrt(np.maximum(np.diag(together), 1e-9))
            correlated = np.maximum(correlated, together / spread[:, None] / spread)
            rates.append(mean)
            right.append(float(np.clip((side @ votes_for + 0.5) / (side.sum() + 1), 0.5, 0.98)))
        counts_for = 1 / np.maximum(1, np.where(correlated > 0.3, correlated, 0).sum(axis=0))
        fires = np.log(np.clip(rates[0], 1e-4, 1) / np.clip(rates[1], 1e-4, 1)) * counts_for
        by_label = np.where(given > 0, np.log(right[0] / (1 - right[1])), np.log((1 - right[0]) / right[1]))
        new = _sigmoid(np.log(prior / (1 - prior)) + v @ fires + by_label)
        if np.abs(new - q).max() < 1e-4:
            break
        q = new
    return q


def telling(rows: _Rows, posterior: np.ndarray, least_z: float) -> np.ndarray:
    """The places whose share of toxic rows differs from that of others by ``least_z`` standard errors."""
    n = np.array([posterior.sum(), (1 - posterior).sum()])
    found = np.array([np.bincount(rows.place, side[rows.row], PLACES) for side in (posterior, 1 - posterior)])
    share = found.sum(axis=0) / rows.n
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n).sum())
    return (found.sum(axis=0) >= 3) & (np.abs(found[0] / n[0] - found[1] / n[1]) > least_z * error)


def logistic(rows: _Rows, target: np.ndarray, ridge: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights and bias by Adam on the cross entropy with soft targets; toxic rows weigh as much as others."""
    weights, bias = np.zeros(PLACES), float(np.log(max(target.mean(), 1e-3) / max(1 - target.mean(), 1e-3)))
    first, second = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    for t in range(1, rounds + 1):
        error = (_sigmoid(rows.times(weights) + bias) - target) / rows.n
        slope = np.append(rows.back(error) + ridge * weights, error.sum())
        first, second = 0.9 * first + 0.1 * slope, 0.999 * second + 0.001 * slope**2
        step = 0.05 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        weights -= step[:-1]
        bias -= step[-1]
    return weights, float(bias)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 8000, most_voters: int = 100, least_z: float = 3.0) -> ToxicityModel:
    """The model of the rows of ``docs`` (``doc_id``, ``text``) that ``labels`` (``doc_id``, ``toxic``) names."""
    known = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
    one = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)  # fit_rows rows at most: broadcast
    joined = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "toxic", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t) for t in batch.column(2).to_pylist()]
            own = [pa.array([p.astype("<u4").tobytes() for p, _ in found], pa.binary()), pa.array([c.astype("<u2").tobytes() for _, c in found], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.int32()), *own], ["doc_id", "toxic", "places", "counts"])

    rows = sorted(map(tuple, joined.mapInArrow(read, "doc_id long, toxic int, places binary, counts binary").collect()))
    toxic = np.array([r[1] > 0 for r in rows], dtype=bool)
    if not toxic.any() or toxic.all():
        share = float(toxic.mean()) if len(toxic) else 0.0
        return ToxicityModel(np.zeros(PLACES, np.float32), 30.0 if share else -30.0)
    sizes = [len(r[2]) // 4 for r in rows]
    sparse = _Rows(
        np.repeat(np.arange(len(rows), dtype=np.int32), sizes),
        np.concatenate([np.frombuffer(r[2], "<u4") for r in rows]).astype(np.int32),
        np.concatenate([np.frombuffer(r[3], "<u2") for r in rows]).astype(np.float32),
        len(rows),
    )
    rows.clear()  # their bytes are in the arrays now
    votes = choose_voters(sparse, toxic, most_voters)
    posterior = label_model(votes, toxic)
    kept = telling(sparse, posterior, least_z)[sparse.place]
    slim = _Rows(sparse.row[kept], sparse.place[kept], np.minimum(sparse.count[kept], 4), sparse.n)
    weights, bias = logistic(slim, posterior)
    return ToxicityModel(weights.astype(np.float32), bias, votes.shape[1] + 1)
