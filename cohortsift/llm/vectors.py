"""Vectors as packed blocks: the shared part of the two searches.

A row of packed vectors holds the ids and the components of up to ``BLOCK`` vectors, so
that a search works on matrices and Spark shuffles few rows. Blocks of the stated
queries meet blocks of all vectors in a cartesian product: a task reads a part of the
vectors where they lie and a panel of the queries. No block is copied before it is read,
and neither side is broadcast, for which it would pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1024
#: Blocks of queries in a panel, on average, and the bytes of their components at most.
PANEL, PANEL_BYTES = 16, 1 << 25


def clean(table: DataFrame, id_column: str, vector_column: str, k: int, nonzero: bool = False) -> DataFrame:
    """vec_id, vector (doubles), row and copies of all rows; ``row`` tells rows of an id apart, by a hash of vector and number.

    Rows equal in id and vector have equal results. So they are asked for once, by the row whose ``copies`` says
    how many there are (others have 0), and found as k + 1 rows at most, as no result holds more of them.
    Vectors that are NULL or hold a NULL or non-finite component are left out, as are rows
    without an id and, with ``nonzero``, vectors without a component other than zero.
    """
    rows = table.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # false for NaN, which sorts above
    kept = F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(whole, F.lit(False))
    if nonzero:
        kept &= F.exists("vector", lambda x: x != 0)
    counted = rows.where(kept).groupBy("vec_id", "vector").agg(F.count("*").alias("copies"))
    number = F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("copies"), F.lit(k + 1)) - 1))
    each = counted.select("vec_id", "vector", "copies", number.alias("number"))
    copies = F.when(F.col("number") == 0, F.col("copies")).otherwise(0)
    return each.select("vec_id", "vector", F.xxhash64("vector", "number").alias("row"), copies.alias("copies"))


def repeated(found: DataFrame, queries: DataFrame) -> DataFrame:
    """``found`` (query_id, query_row, ...) once for each row that its query stands for, without query_row."""
    more = queries.where("copies > 1").select(F.col("vec_id").alias("query_id"), F.col("row").alias("query_row"), "copies")
    joined = found.join(more, ["query_id", "query_row"], "left")
    times = F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1).cast("long")))
    return joined.withColumn("copies", F.explode(times)).drop("copies", "query_row")


def pack(rows: DataFrame, longs: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Blocks (n, dim, ids, matrix and one binary for each of ``longs``) of vec_id and vector.

    Blocks form within Spark's partitions. With ``whole`` components become floor(256 x), in as few bytes as hold a block's.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                if sum(b.num_rows for b in held) + part.num_rows > BLOCK:
                    yield _block(held, longs, whole)
                    held = []
                held.append(part)
        if held:
            yield _block(held, longs, whole)

    extra = "".join(f", {name} binary" for name in longs)
    return rows.select("vec_id", "vector", *longs).mapInArrow(packed, f"n int, dim int, ids binary, matrix binary{extra}")


def _block(batches: list[pa.RecordBatch], longs: tuple[str, ...], whole: bool) -> pa.RecordBatch:
    rows = pa.Table.from_batches(batches).combine_chunks()
    vectors = rows.column("vector").combine_chunks()
    sizes = np.diff(vectors.offsets.to_numpy())
    matrix = np.zeros((len(sizes), max(1, sizes.max(initial=1))))  # shorter vectors end in zeros
    matrix[np.arange(matrix.shape[1]) < sizes[:, None]] = vectors.flatten().to_numpy()
    if whole:
        with np.errstate(over="ignore"):
            matrix = np.floor(np.clip(256.0 * matrix, -1.7e308, 1.7e308))
    largest = np.abs(matrix).max(initial=0)
    kind = "<i2" if whole and largest < 1 << 15 else "<i4" if whole and largest < 1 << 31 else "<f8"
    columns = [np.asarray(rows.column(c).to_numpy(), dtype="<i8").tobytes() for c in longs]
    return pa.RecordBatch.from_arrays(
        [pa.array([len(sizes)], pa.int32()), pa.array([matrix.shape[1]], pa.int32()),
         pa.array([np.asarray(rows.column("vec_id").to_numpy(), dtype="<i8").tobytes()], pa.binary()),
         pa.array([matrix.astype(kind).tobytes()], pa.binary()), *(pa.array([c], pa.binary()) for c in columns)],
        ["n", "dim", "ids", "matrix", *longs],
    )


def query_blocks(queries: DataFrame, longs: tuple[str, ...] = (), whole: bool = False) -> DataFrame:
    """Blocks of the queries, dealt out by id."""
    return pack(queries.repartition(F.xxhash64("vec_id")), longs, whole)


def panels(queries: DataFrame) -> int:
    """How many panels to deal the blocks of these queries to; a task holds one panel."""
    n, dim = queries.agg(F.count("*"), F.max(F.size("vector"))).first()
    return max(1, -(-n // (PANEL * BLOCK)), -(-n * (dim or 1) * 8 // PANEL_BYTES))


def meet(blocks: DataFrame, queries: DataFrame, panels: int) -> DataFrame:
    """Every block of vectors beside every block of queries (whose columns begin with ``q_``).

    Spark takes blocks for small rows, so that it would choose to broadcast them; the hint rules that out.
    """
    renamed = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    return blocks.crossJoin(renamed.repartition(panels).hint("shuffle_replicate_nl"))


def unpack(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """ids and matrix of a packed row."""
    n, dim, matrix = row[f"{prefix}n"], row[f"{prefix}dim"], row[f"{prefix}matrix"]
    kind = {2: "<i2", 4: "<i4"}.get(len(matrix) // max(1, n * dim), "<f8")
    return np.frombuffer(row[f"{prefix}ids"], "<i8"), np.frombuffer(matrix, kind).astype("<f8", copy=False).reshape(n, dim)


def is_query(every: int) -> Column:
    return (F.col("vec_id") % every == 0) & (F.col("copies") > 0)


def others(row: dict, ids: np.ndarray, asking: np.ndarray) -> np.ndarray:
    """Which pairs of a row's vectors and queries count: all but a query with itself."""
    own, asked = np.frombuffer(row["row"], "<i8"), np.frombuffer(row["q_row"], "<i8")
    counts = np.ones((len(ids), len(asking)), bool)
    q = np.flatnonzero(np.isin(asking, ids))  # none in most blocks
    counts[:, q] = (ids[:, None] != asking[q]) | (own[:, None] != asked[q])
    return counts
