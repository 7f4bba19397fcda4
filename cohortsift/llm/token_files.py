"""Token-ID files: flat unsigned integers plus 64-bit document offsets, memory-mapped.

A dataset is a folder of shards in ascending document order. Shard ``k`` is

* ``<k>.ids``: the token ids of its documents, little-endian unsigned integers of 16 bits
  if the vocabulary and the end id fit in them, else of 32;
* ``<k>.idx``: the offsets (``n + 1`` signed 64-bit, in ids, from 0), then the document
  ids (``n`` signed 64-bit), then one byte for each document, 1 where its id is NULL;
* a row of the manifest (Parquet): shard, documents, ids.

A shard's base is the sum of the ids of the shards before it. Each shard is written by
one task under a name of its own attempt and then moved, so that a task run twice
leaves the same files. Folders are reached through ``pyarrow.fs``; local files are
memory-mapped, other stores read.

Defined results: a NULL or empty text holds the end id alone; NULL ids come first;
repeated rows are documents of their own, ordered by a hash of the text; an empty table
gives a dataset without shards.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohortsift.llm.shingles import parts
from cohortsift.llm.tokens import default_vocabulary, encoder, vocabulary_size
from cohortsift.session import new_shared_path

MANIFEST = "shard int, n_docs long, n_ids long, id_bytes int"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it of a folder named with or without a scheme."""
    return fs.FileSystem.from_uri(uri) if ":/" in uri else (fs.LocalFileSystem(), uri)


@dataclass
class TokenFiles:
    """A written dataset; ``shards`` is its manifest with the base of each shard."""

    path: str
    shards: DataFrame

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> TokenFiles:
        shards = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
        before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
        return cls(path, shards.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0))))

    def documents(self) -> DataFrame:
        """doc_id, start (ids of all documents before it), n_tokens, ids_crc32, from the files."""
        root = f"{self.path}/shards"

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, folder = place(root)
            for batch in batches:
                for shard, n, base, width in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    yield from _read_shard(store, f"{folder}/{shard}", n, base, width)

        each = self.shards.select("shard", "n_docs", "base", "id_bytes")
        spread = each.repartition(max(1, each.sparkSession.sparkContext.defaultParallelism), "shard")
        return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _settle(store: fs.FileSystem, mine: str, name: str) -> None:
    """Move a written file to its name; one that another attempt has put there holds the same."""
    try:
        store.move(mine, name)
    except OSError:
        if store.get_file_info(name).type != fs.FileType.File:
            raise
        store.delete_file(mine)


def _mapped(store: fs.FileSystem, name: str) -> memoryview:
    """The bytes of a file, mapped if it is a local one."""
    if isinstance(store, fs.LocalFileSystem):
        with pa.memory_map(name) as source:
            return memoryview(source.read_buffer())
    with store.open_input_file(name) as source:
        return memoryview(source.read_buffer())


def _read_shard(store: fs.FileSystem, name: str, n: int, base: int, width: int) -> Iterator[pa.RecordBatch]:
    index, ids = _mapped(store, f"{name}.idx"), _mapped(store, f"{name}.ids")
    offsets = np.frombuffer(index, "<i8", n + 1)
    doc_ids = np.frombuffer(index, "<i8", n, 8 * (n + 1))
    null = np.frombuffer(index, "u1", n, 8 * (2 * n + 1)).astype(bool)
    for a in range(0, n, 1000):
        b = min(n, a + 1000)
        wide = np.frombuffer(ids, f"<u{width}", offsets[b] - offsets[a], width * offsets[a]).astype("<u4").tobytes()
        at = (4 * (offsets[a : b + 1] - offsets[a])).tolist()
        crc = [zlib.crc32(memoryview(wide)[x:y]) for x, y in zip(at, at[1:], strict=False)]
        columns = [pa.array(doc_ids[a:b], mask=null[a:b]), base + offsets[a:b], np.diff(offsets[a : b + 1]), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])


def write_token_files(docs: DataFrame, path: str | None = None, end_id: int = 2, vocabulary: str | None = None) -> TokenFiles:
    """Write the documents (``doc_id``, ``text``) in ascending id order as token files.

    ``path`` is a folder that all executors reach; by default a new one of the shared folder.
    """
    spark = docs.sparkSession
    path = path or new_shared_path(spark, "token-files")
    vocabulary, root, end = vocabulary or default_vocabulary(), f"{path}/shards", np.array([end_id], "<u4").tobytes()
    width = 2 if max(vocabulary_size(vocabulary), end_id + 1) <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = place(root)
        store.create_dir(folder, recursive=True)
        shard, encode = TaskContext.get().partitionId(), encoder(vocabulary).encode
        name, mine = f"{folder}/{shard}", f"{folder}/.{shard}-{uuid.uuid4().hex}"
        doc_ids, null, counts = [], [], []
        with store.open_output_stream(f"{mine}.ids") as out:
            for part in parts(batches):
                encoded = [ids + end for ids in encode(part.column(1).to_pylist())]
                ids = b"".join(encoded)
                out.write(ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
                counts.append(np.array([len(ids) // 4 for ids in encoded], "<i8"))
                null.append(part.column(0).is_null().to_numpy(zero_copy_only=False))
                doc_ids.append(part.column(0).fill_null(0).to_numpy())
        n_docs = sum(map(len, counts))
        if n_docs:
            offsets = np.cumsum(np.concatenate([[0], *counts]), dtype="<i8")
            with store.open_output_stream(f"{mine}.idx") as out:
                out.write(offsets.tobytes())
                out.write(np.concatenate(doc_ids).astype("<i8").tobytes())
                out.write(np.concatenate(null).astype("u1").tobytes())
            for kind in ("ids", "idx"):
                _settle(store, f"{mine}.{kind}", f"{name}.{kind}")
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([n_docs]), pa.array([int(offsets[-1])]), pa.array([width], pa.int32())],
                ["shard", "n_docs", "n_ids", "id_bytes"],
            )
        else:
            store.delete_file(f"{mine}.ids")

    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("text")]
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("tie"))
    ranged = keyed.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    ranged.select("doc_id", "text").mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return TokenFiles.open(spark, path)
