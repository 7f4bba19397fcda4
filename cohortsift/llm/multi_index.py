"""Nearest neighbours by cosine with multi-index hashing.

Vectors of length one get a 64-bit code: a projection to 64 places, turned by a learned
rotation that keeps the signs' loss small (iterative quantisation over a bounded sample,
``fit_rows``), then the signs. A code is split into eight bytes and every row is indexed by
each of them. Two codes within Hamming distance r agree up to r // 8 bits in one byte at
least (or one bit less in the bytes past the first r % 8 + 1), so a query probes, byte
by byte, all values that close, which retrieves every code within r. Each pair is taken at
the first byte that brings it, tested on its whole code and ranked by its own vectors.

The radius is measured: a bounded set of queries (``measured``) is compared with all rows
without the index, and r is the distance within which ``recall`` of their true neighbours
lie. A query that finds fewer than k rows is compared with all rows, so every result has k
rows if there are as many.

Defined results: see ``vectors.clean`` for rows that take no part; rows that repeat an id are rows of
their own, of which only the one that asks is left out; a shorter vector counts
as ending in zeros; ties go to the smaller id; with k candidates or fewer all are returned.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortsift.llm import vectors
from cohortsift.llm.shared import stored

BITS, BYTES = 64, 8
#: Vectors whose entries of the index are packed together.
PACKED = 1 << 14
#: Found pairs that a task holds before it drops all but the best of each query.
HELD = 200_000
FOUND = "query_id long, query_row long, vec_id long, score double, distance long"
_POPCOUNT = np.array([bin(x).count("1") for x in range(256)], dtype=np.uint8)


def even(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled by powers of two where squares would leave the range of a double."""
    top = np.abs(matrix).max(axis=1, initial=0)
    far = (top > 1e100) | (top < 1e-100)
    if far.any():
        matrix = matrix.copy()
        matrix[far] = np.ldexp(matrix[far], -np.frexp(top[far])[1][:, None])
    return matrix


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each row of a and of b, the cosine, summed place by place so that equal pairs give equal scores."""
    dim = max(a.shape[1], b.shape[1])
    a, b = (even(np.pad(x, ((0, 0), (0, dim - x.shape[1])))) for x in (a, b))
    dot, left, right = (np.zeros(len(a)) for _ in range(3))
    for d in range(dim):
        x, y = a[:, d], b[:, d]
        dot += x * y
        left += x * x
        right += y * y
    return dot / (np.sqrt(left) * np.sqrt(right))


def learn_rotation(sample: np.ndarray, rounds: int = 30) -> np.ndarray:
    """A projection (dim x 64) whose signs are the code."""
    draw = np.random.default_rng(20)
    dim = sample.shape[1]
    if dim >= BITS:
        _, axes = np.linalg.eigh(sample.T @ sample)
        axes = axes[:, ::-1][:, :BITS]
    else:
        axes = np.linalg.qr(draw.normal(size=(BITS, BITS)))[0][:dim]
    placed = sample @ axes
    turn = np.linalg.qr(draw.normal(size=(BITS, BITS)))[0]
    for _ in range(rounds):
        left, _, right = np.linalg.svd(np.where(placed @ turn >= 0, 1.0, -1.0).T @ placed)
        turn = (left @ right).T
    return axes @ turn


def codes(matrix: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """The code of each row as eight bytes; a longer vector counts with the places the rotation knows."""
    dim = min(matrix.shape[1], rotation.shape[0])
    return np.packbits(even(matrix)[:, :dim] @ rotation[:dim] >= 0, axis=1)


def reach(radius: int) -> list[int]:
    """How far each byte must be probed to retrieve all codes within the radius."""
    whole, rest = divmod(radius, BYTES)
    return [whole if byte <= rest else whole - 1 for byte in range(BYTES)]


class _Best:
    """The k best pairs of each query among those a task has met."""

    def __init__(self, k: int) -> None:
        self.k, self.parts, self.held = k, [], 0

    def add(self, *columns: np.ndarray) -> None:
        if len(columns[0]):
            self.parts.append(columns)
            self.held += len(columns[0])
            if self.held > HELD:
                self.parts = [self._pruned()]
                self.held = max(0, len(self.parts[0][0]) - HELD // 2)  # so that a large rest isn't sorted at each call

    def _pruned(self) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(c) for c in zip(*self.parts, strict=True)]
        query, row, vec, score, _ = columns
        order = np.lexsort((vec, -score, row, query))
        query, row = query[order], row[order]
        fresh = np.append(True, (query[1:] != query[:-1]) | (row[1:] != row[:-1]))
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        best = order[np.arange(len(order)) - first < self.k]
        return tuple(c[best] for c in columns)

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            columns = [pa.array(c) for c in self._pruned()]
            yield pa.RecordBatch.from_arrays(columns, ["query_id", "query_row", "vec_id", "score", "distance"])


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def compare_all(blocks: DataFrame, queries: DataFrame, k: int, rotation: np.ndarray, panels: int = 1) -> DataFrame:
    """The k best rows of each query among all, by comparing block with block."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for row in _each(batches):
            ids, matrix = vectors.unpack(row)
            asking, asked = vectors.unpack(row, "q_")
            dim = min(matrix.shape[1], asked.shape[1])
            a, b = even(matrix), even(asked)
            rough = a[:, :dim] @ b[:, :dim].T / np.linalg.norm(a, axis=1)[:, None] / np.linalg.norm(b, axis=1)
            rough[~vectors.others(row, ids, asking)] = -np.inf
            limit = np.partition(rough, max(0, len(ids) - k), axis=0)[max(0, len(ids) - k)]
            v, q = np.nonzero((rough >= limit - 1e-9) & (rough > -np.inf))
            mine, theirs = codes(matrix, rotation), codes(asked, rotation)
            distance = _POPCOUNT[mine[v] ^ theirs[q]].sum(axis=1).astype(np.int64)
            best.add(asking[q], np.frombuffer(row["q_row"], "<i8")[q], ids[v], cosines(matrix[v], asked[q]), distance)
        yield from best.batches()

    return vectors.meet(blocks, vectors.query_blocks(queries, ("row",)), panels).mapInArrow(compared, FOUND)


def best_of(found: DataFrame, k: int) -> DataFrame:
    ranks = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)


def _entries(rows: DataFrame, rotation: np.ndarray, values: Callable[[int], list[np.ndarray]]) -> DataFrame:
    """Packed rows (byte, value, n, dim, ids, matrix, codes); ``values(b)`` has, for each byte, the values under which a b there is filed."""

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= PACKED:
                yield from _file(held)
                held = []
        if held:
            yield from _file(held)

    def _file(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = vectors._block(held, ("row",), False).to_pylist()[0]
        ids, matrix = vectors.unpack(block)
        numbers = np.frombuffer(block["row"], "<i8")
        code = codes(matrix, rotation)
        slim = matrix.astype("<f4")
        if not (slim == matrix).all():
            slim = matrix
        width = slim.dtype.itemsize
        for byte in range(BYTES):
            under = [(v, np.flatnonzero(np.isin(code[:, byte], near))) for v, near in enumerate(values(byte))]
            out = [(byte, v, len(own), matrix.shape[1], width, ids[own].tobytes(), numbers[own].tobytes(), slim[own].tobytes(), code[own].tobytes()) for v, own in under if len(own)]
            names = ["byte", "value", "n", "dim", "width", "ids", "row", "matrix", "codes"]
            types = [pa.int32()] * 5 + [pa.binary()] * 4
            for a in range(0, len(out), 16):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[a : a + 16], strict=True), types, strict=True)], names)

    return rows.select("vec_id", "vector", "row").mapInArrow(
        filed, "byte int, value int, n int, dim int, width int, ids binary, row binary, matrix binary, codes binary"
    )


def _opened(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n, dim, width = row[f"{prefix}n"], row[f"{prefix}dim"], row[f"{prefix}width"]
    ids = np.frombuffer(row[f"{prefix}ids"], "<i8")
    matrix = np.frombuffer(row[f"{prefix}matrix"], f"<f{width}").reshape(n, dim)
    return ids, matrix, np.frombuffer(row[f"{prefix}codes"], np.uint8).reshape(n, BYTES)


def probe(rows: DataFrame, queries: DataFrame, rotation: np.ndarray, radius: int, k: int) -> DataFrame:
    """The k best of all rows whose code lies within the radius of a query's."""
    far = reach(radius)
    every = np.arange(256, dtype=np.uint8)

    def near(byte: int) -> list[np.ndarray]:
        return [every[_POPCOUNT[every ^ v] <= far[byte]] if far[byte] >= 0 else every[:0] for v in every]

    index = _entries(rows, rotation, lambda byte: [every[v : v + 1] for v in range(256)])
    probes = _entries(queries, rotation, near)
    asked = probes.select("byte", "value", *(F.col(c).alias(f"q_{c}") for c in ("n", "dim", "width", "ids", "row", "matrix", "codes")))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(k)
        for row in _each(batches):
            ids, matrix, mine = _opened(row)
            asking, asked_for, theirs = _opened(row, "q_")
            apart = np.bitwise_count(mine.view(np.uint64) ^ theirs.view(np.uint64).T)
            v, q = np.nonzero((apart <= radius) & vectors.others(row, ids, asking))
            by_byte = _POPCOUNT[mine[v] ^ theirs[q]]
            first = ~(by_byte[:, : row["byte"]] <= far[: row["byte"]]).any(axis=1)  # an earlier byte has brought the others
            v, q = v[first], q[first]
            best.add(asking[q], np.frombuffer(row["q_row"], "<i8")[q], ids[v], cosines(matrix[v].astype(np.float64), asked_for[q].astype(np.float64)), apart[v, q].astype(np.int64))
        yield from best.batches()

    return index.join(asked, ["byte", "value"]).mapInArrow(ranked, FOUND)


def search(
    table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", every: int = 50, k: int = 5,
    fit_rows: int = 4096, measured: int = 64, recall: float = 0.97,
) -> DataFrame:
    """query_id, rank, vec_id, score: k near neighbours of each row whose id is divisible by ``every``."""
    rows = stored(vectors.clean(table, id_column, vector_column, k, nonzero=True), "vectors")
    total = rows.count()
    draw = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw * total < fit_rows).select("vector").limit(2 * fit_rows).collect()
    dim = max([1, *(len(r.vector) for r in sample)])
    known = np.array([list(r.vector) + [0.0] * (dim - len(r.vector)) for r in sample]).reshape(-1, dim)
    known = even(known)
    rotation = learn_rotation(known / np.linalg.norm(known, axis=1, keepdims=True)) if len(known) else np.eye(dim, BITS)
    packed = rows.repartition(max(1, -(-total // PACKED)))
    blocks = stored(vectors.pack(rows, ("row",)), "vector-blocks")
    queries = rows.where(vectors.is_query(every))
    trial = compare_all(blocks, queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(measured), k, rotation)
    distances = [r.distance for r in best_of(trial, k).select("distance").collect()]  # measured x k numbers at most
    radius = int(np.quantile(distances, recall, method="higher")) if distances else 0
    found = stored(best_of(probe(packed, queries, rotation, radius, k), k), "near-found")
    enough = found.groupBy("query_id", "query_row").agg(F.count("*").alias("n")).where(F.col("n") >= k)
    rest = queries.join(enough, (queries.vec_id == enough.query_id) & (queries.row == enough.query_row), "left_anti")
    exact = best_of(compare_all(blocks, rest, k, rotation, vectors.panels(queries)), k)
    done = found.join(enough, ["query_id", "query_row"], "left_semi")
    return vectors.repeated(done.unionByName(exact), queries).select("query_id", "rank", "vec_id", "score")
