"""Periodic runs of words: stretches that repeat themselves with a period, found tile by tile.

A run is a stretch of words with smallest period q, at least ``least`` words and at least
2q long, that no neighbouring word extends with that period. Periods fall into octaves
[P, 2P). For each octave a document is cut into tiles of 16P words that overlap by 4P;
the octaves up to ``SHARED`` words share the tiles of the last of them, and one tile serves
all octaves for which it would hold the whole document. So a run of an octave lies in tiles as
pieces of two periods or more, and neighbouring pieces overlap by more than a period.

A tile is solved on its own. In each octave a boundary lies at every P-th word, so the first
copy in a run holds one. The Z-functions of a boundary b give, for each period q of the octave,
how many words from b on, and how many before it, equal those q further on; if these are
enough for a run, their sum plus q is its piece. Z values of all boundaries of many tiles are
read from one table of hashes of stretches of 1, 2, 4 ... words, from the longest down. A piece with
a smaller period has the extent of that period's piece, so of equal extents the least
period stays.

Tiles are dealt over the cluster, pieces are shuffled by document and period and stitched
where they overlap by a period. A document in which no ``least`` / 2 words occur twice holds no run;
it makes no tiles. What a task holds is bounded by one document's words, times the logarithm of
its longest tile. Rows are told apart by their place in the scan, kept in a written table.

Defined results: NULL and empty texts have no words and no runs; rows that repeat an id, or
have none, are solved one by one; other columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortsift.llm.shared import stored
from cohortsift.llm.shingles import mixed, parts

#: Words of the tiles that the octaves up to SHARED / 16 words share.
SHARED = 4096
#: Words of tiles solved together, at most; a longer tile is alone.
TOGETHER = 1 << 17

_ODD = np.uint64(0x9E3779B97F4A7C15)


def tiles(n: int) -> Iterator[tuple[int, int, int, int]]:
    """first word, words, and the octaves [low, high) of each tile of a document of n words."""
    high = max(1, (n // 2).bit_length())  # 2 ** high exceeds every period
    if n <= SHARED:
        yield 0, n, 0, high
        return
    low, octave = 0, (SHARED // 16).bit_length() - 1
    while 16 << octave < n:
        overlap, length = 4 << octave, 16 << octave
        for first in range(0, n - overlap, length - overlap):
            yield first, min(length, n - first), low, octave + 1
        octave += 1
        low = octave
    yield 0, n, low, high


def _may_repeat(ids: np.ndarray, n: int) -> bool:
    """Whether n words may occur twice."""
    if len(ids) <= n:
        return False
    signs = mixed(ids.astype(np.uint64) + np.uint64(1))
    total = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        total = total * _ODD + signs[k : k + len(total)]
    total.sort()
    return bool((total[1:] == total[:-1]).any())


def _cut(batches: Iterator[pa.RecordBatch], least: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """A row for each document, with its text if it may hold runs, and one for each tile of those."""
    anchor = -(-least // 2)
    for batch in parts(batches, texts=2):
        none = len(batch) * [None]
        held, counts, texts, hashes = [], [], [], []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = (text or "").encode().split()  # bytes part at the six ASCII white spaces only
            numbers: dict[bytes, int] = {}
            ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint32, len(words))
            may = _may_repeat(ids, anchor)
            if may:
                ids = ids.astype("<u2" if len(numbers) <= 1 << 16 else "<u4")
                held += [(key, f, n, low, high, ids[f : f + n].tobytes()) for f, n, low, high in tiles(len(ids))]
            whole = None if may and not with_text else b" ".join(words)
            counts.append(len(words))
            texts.append(whole if with_text else text if may else None)
            hashes.append(None if may else hashlib.sha256(whole).hexdigest())
        yield _rows(batch.column(0), batch.column(1), counts, texts, hashes, [none] * 5)
        if held:
            keys, *columns = zip(*held, strict=True)
            blank = len(held) * [None]
            ids = pa.nulls(len(held), batch.schema.field(1).type)
            yield _rows(pa.array(keys, pa.int64()), ids, blank, blank, blank, columns)


def _rows(keys, ids, counts, texts, hashes, tile) -> pa.RecordBatch:
    first, n, low, high, words = tile
    return pa.RecordBatch.from_arrays(
        [keys, ids, pa.array(counts, pa.int64()), pa.array(texts, pa.string()), pa.array(hashes, pa.string()),
         pa.array(first, pa.int64()), pa.array(n, pa.int32()), pa.array(low, pa.int32()), pa.array(high, pa.int32()),
         pa.array(words, pa.binary())],
        ["key", "doc_id", "n_words", "text", "sha256", "first", "n", "low", "high", "ids"],
    )


class _Stretches:
    """Hashes of the stretches of 1, 2, 4 ... words from each place on."""

    def __init__(self, words: np.ndarray, longest: int) -> None:
        self.levels = [mixed(words.astype(np.uint64) + np.uint64(1))]
        while 2 << (len(self.levels) - 1) <= longest:
            last, step = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(mixed(last[:-step] * _ODD + mixed(last[step:])))

    def forward(self, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """How many words from a on equal those from c on; c > a."""
        done = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            level = self.levels[j]
            at = c + done
            inside = at < len(level)
            equal = level[np.where(inside, a + done, 0)] == level[np.where(inside, at, 0)]
            done += (inside & equal).astype(np.int64) << j
        return done

    def backward(self, a: np.ndarray, c: np.ndarray) -> np.ndarray:
        """How many words before a equal those before c; c > a."""
        done = np.zeros(len(a), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            level, step = self.levels[j], 1 << j
            at = a - done - step
            inside = at >= 0
            equal = level[np.where(inside, at, 0)] == level[np.where(inside, c - done - step, 0)]
            done += (inside & equal).astype(np.int64) << j
        return done


def pieces(ids: np.ndarray, lengths: np.ndarray, low: np.ndarray, high: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """start, end (in ``ids``) and period of the runs' pieces in tiles that follow each other in ``ids``.

    The words of different tiles have different numbers.
    """
    n, tile = len(ids), np.repeat(np.arange(len(lengths)), lengths)
    stretches = _Stretches(ids, int(lengths.max()))
    found = []
    for octave in range(int(high.max())):
        p = 1 << octave
        if 2 * p > n or not ((low <= octave) & (octave < high)).any():
            continue
        b = np.arange(0, n, p)
        c = b[:, None] + np.arange(p, 2 * p)
        row, shift = np.nonzero((c < n) & (ids[b][:, None] == ids[np.minimum(c, n - 1)]))
        b, q = b[row], p + shift
        own = tile[b]
        serves = (low[own] <= octave) & (octave < high[own])
        b, q = b[serves], q[serves]
        after, before = stretches.forward(b, b + q), stretches.backward(b, b + q)
        enough = after + before >= np.maximum(q, least - q)
        found.append(np.stack([(b - before)[enough], (b + q + after)[enough], q[enough]]))
    start, end, period = np.concatenate(found, axis=1) if found else np.zeros((3, 0), np.int64)
    order = np.lexsort([period, end, start])
    start, end, period = start[order], end[order], period[order]
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    return start[new], end[new], period[new]


def _solve(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    held, words = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if held and words + row["n"] > TOGETHER:
                yield _solved(held, least)
                held, words = [], 0
            held.append(row)
            words += row["n"]
    if held:
        yield _solved(held, least)


def _solved(rows: list[dict], least: int) -> pa.RecordBatch:
    own = [np.frombuffer(r["ids"], "<u2" if len(r["ids"]) == 2 * r["n"] else "<u4").astype(np.int64) for r in rows]
    lengths = np.array([len(o) for o in own])
    base = np.cumsum([0] + [int(o.max()) + 1 for o in own])
    begin = np.cumsum(lengths) - lengths
    ids = np.concatenate([o + x for o, x in zip(own, base, strict=False)])
    low, high = (np.array([r[c] for r in rows]) for c in ("low", "high"))
    start, end, period = pieces(ids, lengths, low, high, least)
    tile = np.searchsorted(begin, start, side="right") - 1
    shift = np.array([r["first"] for r in rows])[tile] - begin[tile]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array([r["key"] for r in rows])[tile]), pa.array(period), pa.array(start + shift), pa.array(end + shift)],
        ["key", "period", "start", "end"],
    )


def _stitched(found: DataFrame) -> DataFrame:
    """key and its runs, by start, then period; ``found`` holds pieces."""
    own = Window.partitionBy("key", "period").orderBy("start", "end")
    before = F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1))
    fresh = found.withColumn("fresh", F.coalesce(F.col("start") + F.col("period") > before, F.lit(True)).cast("int"))
    numbered = fresh.withColumn("run", F.sum("fresh").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    whole = numbered.groupBy("key", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    least = whole.groupBy("key", "start", "end").agg(F.min("period").alias("period"))
    run = F.struct("start", "period", (F.col("end") - F.col("start")).alias("length"))
    return least.groupBy("key").agg(F.sort_array(F.collect_list(run)).alias("runs"))  # fewer than a document's words


def collapsed(words: list[bytes], runs: list[dict]) -> bytes:
    """The words that no run holds after its first period, joined by one space."""
    edges = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        edges[r["start"] + r["period"]] += 1
        edges[r["start"] + r["length"]] -= 1
    return b" ".join(words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0))


def _finish(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, texts=2):
        texts, hashes = batch.column(2).to_pylist(), batch.column(3).to_pylist()
        runs = batch.column(4)
        for k, own in enumerate(runs.to_pylist()):
            if hashes[k] is None:
                kept = collapsed(texts[k].encode().split(), own)
                texts[k], hashes[k] = kept.decode(), hashlib.sha256(kept).hexdigest()
        columns = [batch.column(0), batch.column(1), runs, *([pa.array(texts, pa.string())] if with_text else []), pa.array(hashes, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", *(["collapsed"] if with_text else []), "collapsed_sha256"])


def periodic_runs(docs: DataFrame, least: int = 12, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, runs (structs of start, period and length), and the text without their repeats.

    ``collapsed`` keeps of each run its first period, words joined by one space; ``collapsed_sha256``
    is its hash, which alone is returned without ``with_text``.
    """
    if least < 2:
        raise ValueError(f"a run has at least two words, not {least}")
    kind = docs.select("doc_id").schema[0].dataType.simpleString()
    keyed = docs.select(F.monotonically_increasing_id().alias("key"), "doc_id", "text")
    cut = keyed.mapInArrow(
        lambda batches: _cut(batches, least, with_text),
        f"key long, doc_id {kind}, n_words long, text string, sha256 string, first long, n int, low int, high int, ids binary",
    )
    rows = stored(cut, "tiles")
    dealt = rows.where("first is not null").select("key", "first", "n", "low", "high", "ids").repartition(F.xxhash64("key", "first", "low"))
    found = dealt.mapInArrow(lambda batches: _solve(batches, least), "key long, period long, start long, end long")
    joined = rows.where("first is null").join(_stitched(found), "key", "left")
    runs = F.coalesce("runs", F.array().cast("array<struct<start:bigint,period:bigint,length:bigint>>")).alias("runs")
    text = "collapsed string, " if with_text else ""
    return joined.select("doc_id", "n_words", "text", "sha256", runs).mapInArrow(
        lambda batches: _finish(batches, with_text),
        f"doc_id {kind}, n_words long, runs array<struct<start:bigint,period:bigint,length:bigint>>, {text}collapsed_sha256 string",
    )
