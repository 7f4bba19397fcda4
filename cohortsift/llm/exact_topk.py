"""Exact top-k by inner product: distributed histogram selection.

Components become floor(256 x), so scores are whole numbers. Every pass scores all blocks
of vectors against all blocks of queries. The first passes count, for each query, how many
scores fall into each of ``BINS`` parts of the interval that holds its kth best score,
which begins as the range all scores lie in; summed over all tasks, the counts name the
part that holds it, and the next pass divides that one. When the interval is one number,
the last pass keeps the scores that reach it, at most k of a block and query, and the
best k of these, ties to the smaller id, are the result.

Defined results: see ``vectors.clean`` for rows that take no part. Rows that repeat an id are rows of their own:
each is asked for, and only the very row that asks is left out. A shorter vector counts
as ending in zeros. With fewer than k candidates all are returned. Scores beyond the range
of a long are held at its ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortsift.llm import vectors
from cohortsift.llm.shared import stored

#: Parts of an interval in one pass.
BINS = 64
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Blocks of queries whose counts a task holds at once; panels of twice the average still fit.
HELD = 2 * vectors.PANEL


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers: as doubles if all are below 2 ** 53, else as 64-bit integers."""
    dim = min(a.shape[1], b.shape[1])
    a, b = a[:, :dim], b[:, :dim]
    if np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * dim < 2.0**53:
        return a @ b.T
    exact = np.frompyfunc(int, 1, 1)
    return np.clip(exact(a).dot(exact(b).T), LEAST, MOST).astype(np.int64)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as 64-bit integers."""
    return _products(a, b).astype(np.int64)


def _scores(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, query ids, scores (see ``_products``), and which pairs count."""
    ids, matrix = vectors.unpack(row)
    queries, asked = vectors.unpack(row, "q_")
    return ids, queries, _products(matrix, asked), vectors.others(row, ids, queries)


def _cells(scores: np.ndarray, counts: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """query * BINS + part of each score that counts and lies within its query's interval."""
    inside = counts & (scores >= lo) & (scores <= hi)  # right for doubles too, as a bound that is rounded is beyond them all
    step = _step(lo, hi)
    bounded = scores.dtype == np.float64 and max(-int(lo.min(initial=0)), int(hi.max(initial=0))) < 1 << 51
    if bounded and 4 * np.count_nonzero(inside) > inside.size:  # quotients of whole numbers below 2 ** 53 round to no other whole part
        part = (scores - lo) / step.astype(np.float64)
        return (part.astype(np.int64) + BINS * np.arange(len(lo)))[inside]
    v, q = np.divmod(np.flatnonzero(inside), max(1, len(lo)))
    part = (scores[v, q].astype(np.int64).astype(np.uint64) - lo[q].astype(np.uint64)) // step[q]
    return q * BINS + part.astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[bytes, bytes], tuple[np.ndarray, ...]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for queries, own, lo, hi, counts in held.values():
            q, part = np.nonzero(counts)
            step = _step(lo, hi)[q]
            first = (lo[q].astype(np.uint64) + part.astype(np.uint64) * step).astype(np.int64)
            last = np.where(hi[q].astype(np.uint64) - first.astype(np.uint64) < step, hi[q], first + (step - np.uint64(1)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (queries[q], own[q], first, last, counts[q, part])], ["query_id", "query_row", "lo", "hi", "n"])
        held.clear()

    for row in _rows(batches):
        _, queries, scores, counts = _scores(row)
        key = (row["q_ids"], row["q_row"])
        if key not in held:
            if len(held) >= HELD:
                yield from out()
            own, lo, hi = (np.frombuffer(row[c], "<i8") for c in ("q_row", "q_lo", "q_hi"))
            held[key] = (queries, own, lo, hi, np.zeros((len(queries), BINS), np.int64))
        _, _, lo, hi, total = held[key]
        total += np.bincount(_cells(scores, counts, lo, hi), minlength=total.size).reshape(total.shape)
    yield from out()


def _step(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The width of each part of lo .. hi."""
    return (hi.astype(np.uint64) - lo.astype(np.uint64)) // np.uint64(BINS) + np.uint64(1)


def search(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 50, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of all other rows for each row whose id is divisible by ``every``."""
    rows = stored(vectors.clean(table, id_column, vector_column, k), "vectors")
    blocks = stored(vectors.pack(rows, ("row",), whole=True), "vector-blocks")
    whole = F.aggregate("vector", F.lit(0.0), lambda s, x: s + F.pow(F.abs(256 * x) + 1, F.lit(2.0)))
    largest = rows.agg(F.max(whole)).first()[0] or 0.0  # no score is beyond the square of the longest vector
    bound = MOST if largest >= 2.0**62 else int(largest) + 1
    queries = rows.where(vectors.is_query(every))
    state = queries.select("vec_id", "row", F.lit(-bound).cast("long").alias("lo"), F.lit(bound).cast("long").alias("hi"), F.lit(0).cast("long").alias("above"))

    def asked(state: DataFrame) -> DataFrame:
        return vectors.query_blocks(queries.join(state, ["vec_id", "row"]), ("row", "lo", "hi"), whole=True)

    panels = vectors.panels(queries)

    width = 2 * bound + 1
    own = ["query_id", "query_row"]
    down = Window.partitionBy(*own).orderBy(F.col("hi").desc())
    while width > 1:
        parts = vectors.meet(blocks, asked(state), panels).mapInArrow(_counted, "query_id long, query_row long, lo long, hi long, n long")
        summed = parts.groupBy(*own, "lo", "hi").agg(F.sum("n").alias("n"))
        reached = summed.withColumn("reached", F.sum("n").over(down))
        before = state.select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "above", F.col("lo").alias("least"))
        holds = (
            reached.join(before, own)
            .where(F.col("above") + F.col("reached") >= k)
            .groupBy(*own)
            .agg(F.max(F.struct("hi", "lo", (F.col("above") + F.col("reached") - F.col("n")).alias("above"))).alias("part"))
        )
        found = before.join(holds, own, "left")
        # fewer than k candidates: everything from the least score on
        state = stored(
            found.select(
                F.col("query_id").alias("vec_id"),
                F.col("query_row").alias("row"),
                F.coalesce("part.lo", "least").alias("lo"),
                F.coalesce("part.hi", "least").alias("hi"),
                F.coalesce("part.above", "above").alias("above"),
            ),
            "topk-intervals",
        )
        width = -(-width // BINS)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            ids, asking, scores, counts = _scores(row)
            v, q = np.nonzero(counts & (scores >= np.frombuffer(row["q_lo"], "<i8")))
            found = scores[v, q].astype(np.int64)
            order = np.lexsort((ids[v], ~found, q))  # ~x is -x - 1, without overflow
            v, q, found = v[order], q[order], found[order]
            first = np.searchsorted(q, q, side="left")
            best = np.arange(len(q)) - first < k
            columns = [asking[q[best]], np.frombuffer(row["q_row"], "<i8")[q[best]], ids[v[best]], found[best]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "query_row", "vec_id", "score"])

    final = vectors.meet(blocks, asked(state), panels).mapInArrow(kept, "query_id long, query_row long, vec_id long, score long")
    ranks = Window.partitionBy(*own).orderBy(F.col("score").desc(), "vec_id")
    best = final.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return vectors.repeated(best, queries).select("query_id", "rank", "vec_id", "score")
