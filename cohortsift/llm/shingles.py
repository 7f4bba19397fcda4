"""Words and runs of words of many texts as hashes, computed on whole Arrow columns."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space between words.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Bytes hashed at once.
STRIDE = 1 << 20
#: Bytes of texts and texts taken together, at most; a longer text is alone.
TOGETHER, TEXTS = 1 << 21, 2000

_ODD = np.uint64(0x9E3779B97F4A7C15)

_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None


def give_back() -> None:
    """Return freed memory to the system: a Python worker outlives its tasks, and Arrow and the C library keep what they freed."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def parts(batches: Iterator[pa.RecordBatch], texts: int = 1) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold a bounded number of bytes in the column ``texts``."""
    give_back()  # what the tasks before this one left
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(texts)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        a = 0
        while a < batch.num_rows:
            before = ends[a - 1] if a else 0
            b = int(np.clip(np.searchsorted(ends, before + TOGETHER, side="right"), a + 1, a + TEXTS))
            yield batch.slice(a, b - a)
            a = b
    batch = None
    give_back()


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Words:
    """The words of a column of texts: hash, text number, and place in the text."""

    def __init__(self, texts: pa.Array, lower: bool, seed: int = 1) -> None:
        texts = texts.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
        ends = offsets - offsets[0]
        self.texts = len(texts)
        inside = ~_SPACE[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        edges = ends[:-1][ends[:-1] < len(raw)]
        first[edges] = inside[edges]  # a text's first character begins a word
        starts = np.flatnonzero(first)
        self.text = np.searchsorted(ends, starts, side="right") - 1
        self.count = np.bincount(self.text, minlength=len(texts)) if len(starts) else np.zeros(len(texts), np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.count)])
        if not len(starts):
            self.hash = np.zeros(0, np.uint64)
            return
        base = int(mixed(np.array([seed], np.uint64))[0]) | 1
        self.hash = np.empty(len(starts), np.uint64)
        groups = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(raw), STRIDE)), len(starts)))
        for a, b in zip(groups, groups[1:], strict=False):  # of words, STRIDE bytes or so each
            own = starts[a:b]
            begin, end = own[0], starts[b] if b < len(starts) else len(raw)
            signs = (_LOWER[raw[begin:end]] if lower else raw[begin:end]).astype(np.uint64) + np.uint64(1)
            signs[~inside[begin:end]] = 0
            place = np.arange(begin, end) - np.repeat(own, np.diff(np.append(own, end)))
            signs *= powers(base, int(place.max()) + 1)[place]
            self.hash[a:b] = mixed(np.add.reduceat(signs, own - begin) + np.uint64(seed))

    def runs(self, n: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The hash, text number and first word of each run of n words."""
        whole = np.maximum(self.count - n + 1, 0)
        text = np.repeat(np.arange(self.texts), whole)
        at = np.arange(len(text)) - np.repeat(np.cumsum(whole) - whole, whole)
        return self.hash_runs(text, at, n, seed), text, at

    def hash_runs(self, text: np.ndarray, at: np.ndarray, n: int, seed: int) -> np.ndarray:
        """The hash of the n words of each text from each place on."""
        first = self.begin[text] + at
        total = np.zeros(len(text), np.uint64)
        weight = powers(int(mixed(np.array([seed + 77], np.uint64))[0]) | 1, n)
        for k in range(n):
            total += self.hash[first + k] * weight[k : k + 1]
        return mixed(total + np.uint64(n))


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of n words; of shorter texts their whole words as one."""
    found = Words(texts, lower=True)
    hashes, text, _ = found.runs(n)
    edges = np.searchsorted(text, np.arange(found.texts + 1))
    out = []
    for k in range(found.texts):
        own = hashes[edges[k] : edges[k + 1]]
        if not len(own) and found.count[k]:
            words = found.hash[found.begin[k] : found.begin[k + 1]]
            own = mixed((words * powers(int(_ODD), len(words))).sum(dtype=np.uint64, keepdims=True) + mixed(np.array([len(words)], np.uint64)))
        out.append(np.unique(own))
    return out
