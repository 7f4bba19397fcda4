"""Best-fit packing of documents into sequences, by exact-complement hashing.

A document is its token ids and an end id. One of at most ``size`` tokens is one piece;
a longer one is cut into pieces of ``size``, the first being shorter if need be. The plan
needs only how many pieces there are of each length, at most ``size`` numbers however
large the corpus is. ``plan`` takes lengths from the longest down and fills the gap that
each leaves exactly: with one length, else a pair, else a triple that sums to the gap,
looked up in the lengths still available and used as often as all of them last. What no
combination fills exactly goes by best fit: each length, longest first, into the
tightest open gap, else into a new sequence.

The plan is a list of kinds of sequence (their lengths and how many of them). A piece
finds its place by its rank among the pieces of its length, which salted ranks give
without bringing a length's pieces together: they are ranked within salts, and each
salt starts at the sum of those before it.

Defined results: a NULL or empty text is one piece, the end id; repeated rows and NULL
ids are packed as documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortsift.llm.shared import stored
from cohortsift.llm.shingles import parts
from cohortsift.llm.tokens import default_vocabulary, encoder

#: Parts in which the pieces of one length are ranked.
SALTS = 1024

#: A kind of sequence and how many there are of it.
Kind = tuple[tuple[int, ...], int]


def pieces(
    docs: DataFrame, size: int = 2048, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False
) -> DataFrame:
    """doc_id, piece (from 0), start, length, ids_crc32 of each piece, and its ``ids`` if asked for."""
    vocabulary, end = vocabulary or default_vocabulary(), np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for part in parts(batches):
            rows = []
            for doc_id, ids in zip(part.column(0).to_pylist(), encode(part.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                edges = [0, *range(n % size or min(size, n), n + 1, size)]
                for k, (b, e) in enumerate(zip(edges, edges[1:], strict=False)):
                    own = ids[4 * b : 4 * e]
                    rows.append((doc_id, k, b, e - b, zlib.crc32(own), *([own] if with_ids else [])))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def exact_fill(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``, the longest possible first."""
    if gap <= 0:
        return None
    if left[gap]:
        return (gap,)
    there = np.flatnonzero(left[:gap])
    if not len(there):
        return None
    rest = gap - there
    pairs = there[(left[rest] > 0) & (there >= rest) & ((there != rest) | (left[there] > 1))]
    if len(pairs):
        return (int(pairs[-1]), int(gap - pairs[-1]))
    for a in there[::-1]:
        if 3 * a < gap:
            return None
        below = there[(there <= a) & (there < gap - a)]
        rest = gap - a - below
        fits = (rest >= 1) & (rest <= below) & (left[rest] > 0)
        need = 1 + (below == a).astype(int) + ((rest == a) & (below == a)) 
        fits &= (left[a] >= need) & ((below != rest) | (below == a) | (left[below] > 1))
        if fits.any():
            b = int(below[fits][-1])
            return (int(a), b, int(gap - a - b))
    return None


def plan(counts: dict[int, int], size: int) -> list[Kind]:
    """Kinds of sequence that use every piece; ``counts`` has the pieces of each length.

    Should best fit alone need fewer sequences, it is the plan.
    """
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    plans = [_exact_first(counts, size), _best_fit(left, size)]
    return min(plans, key=lambda kinds: sum(n for _, n in kinds))


def _exact_first(counts: dict[int, int], size: int) -> list[Kind]:
    """Exact combinations as long as there are any, then best fit."""
    left = np.zeros(size + 1, dtype=np.int64)
    for length, n in counts.items():
        left[length] = n
    kinds: dict[tuple[int, ...], int] = defaultdict(int)
    kinds[(size,)] += int(left[size])
    left[size] = 0
    for longest in range(size - 1, 0, -1):
        while left[longest]:
            left[longest] -= 1  # it must not fill its own gap
            others = exact_fill(left, size - longest)
            left[longest] += 1
            if others is None:
                break
            kind = (longest, *others)
            times = min(int(left[x]) // kind.count(x) for x in set(kind))
            for x in kind:
                left[x] -= times
            kinds[kind] += times
    return [(k, n) for k, n in kinds.items() if n] + _best_fit(left, size)


def _best_fit(left: np.ndarray, size: int) -> list[Kind]:
    """Longest first, each length into the tightest open gap that takes it."""
    opened: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # by gap
    for length in range(size, 0, -1):
        n = int(left[length])
        while n:
            gap = min((g for g in opened if g >= length), default=None)
            if gap is None:
                opened[size - length][(length,)] = opened[size - length].get((length,), 0) + n
                each = size // length  # those just opened take more of the same length
                if each > 1 and n > 1:
                    del opened[size - length][(length,)]
                    full, rest = divmod(n, each)
                    for kind, times in (((length,) * each, full), ((length,) * rest, int(rest > 0))):
                        if times:
                            g = size - length * len(kind)
                            opened[g][kind] = opened[g].get(kind, 0) + times
                    if not opened[size - length]:
                        del opened[size - length]
                n = 0
                continue
            kind, times = opened[gap].popitem()
            used = min(n, times)
            if times > used:
                opened[gap][kind] = times - used
            if not opened[gap]:
                del opened[gap]
            grown = (*kind, length)
            opened[gap - length][grown] = opened[gap - length].get(grown, 0) + used
            n -= used
    return [(kind, times) for kinds in opened.values() for kind, times in kinds.items()]


def _slots(kinds: list[Kind]) -> dict[int, np.ndarray]:
    """Of each length, rows (first rank, first sequence, pieces of the length in a sequence, offset of the first)."""
    slots: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    taken: dict[int, int] = defaultdict(int)
    sequence = 0
    for kind, times in kinds:
        offset = 0
        for length in sorted(set(kind), reverse=True):
            in_each = kind.count(length)
            slots[length].append((taken[length], sequence, in_each, offset))
            taken[length] += in_each * times
            offset += in_each * length
        sequence += times
    return {length: np.array(rows, dtype=np.int64) for length, rows in slots.items()}


def pack(cut: DataFrame, size: int = 2048) -> DataFrame:
    """``cut`` (columns of ``pieces`` and ``salt``, stored) with sequence_id and offset."""
    salted = cut.withColumnRenamed("salt", "__salt")
    # at most size x SALTS rows; summed on the executors, one row for each length comes to the driver
    sizes = stored(salted.groupBy("length", "__salt").agg(F.count("*").alias("n")), "piece-counts")
    totals = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = _slots(plan(totals, size))
    before = Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "__salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("__rank", F.row_number().over(within) - 1).join(bases, ["length", "__salt"])
    kept = [c for c in cut.columns if c != "salt"]
    columns = [*kept, (F.col("__rank") + F.col("__base")).alias("__rank")]
    schema = cut.drop("salt").schema.simpleString()[7:-1].replace(":", " ").replace(",", ", ") + ", sequence_id long, offset long"

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for x in np.unique(length):
                own, rows = np.flatnonzero(length == x), slots[int(x)]
                slot = rows[np.searchsorted(rows[:, 0], rank[own], side="right") - 1]
                k = rank[own] - slot[:, 0]
                sequence[own], offset[own] = slot[:, 1] + k // slot[:, 2], slot[:, 3] + k % slot[:, 2] * x
            own = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, pa.array(sequence), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return ranked.select(*columns).mapInArrow(places, schema)


def packed(docs: DataFrame, size: int = 2048, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of ``docs`` and their places in sequences of at most ``size`` tokens."""
    cut = pieces(docs, size, end_id, vocabulary, with_ids)
    row = F.monotonically_increasing_id()  # so that equal rows are dealt out as well; written once, it stays
    return pack(stored(cut.withColumn("salt", F.pmod(F.xxhash64("ids_crc32", row), F.lit(SALTS))), "pieces"), size)
