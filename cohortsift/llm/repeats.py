"""Passages that repeat across documents, by level-wise doubling.

Level one looks at runs of half the window's words (7 of 13). Only one run is needed for
each window: the one with the smallest hash of the runs in it, which equal windows choose
alike. Only runs found in two documents are extended, to the windows of twice the
length (less a word) that chose them; the longer windows are compared in turn. A word
goes if a window covers it whose words also start in a document with a smaller id.

Runs travel as packed columns, dealt by hash. What a batch of documents settles on its
own is settled there: a run that two of its documents hold, or a window that a smaller
document of the batch holds too. So the run of a passage found everywhere is sent once for
each batch, and no task gathers its documents. Of documents with equal texts only
the one with the smallest id is searched; the others lose every word that a window covers.
The whole is one lazy plan without state outside Spark.

Defined results: NULL and empty texts have no words. A document with a NULL id has no
place in the order: it loses nothing and takes nothing from others. Rows that repeat an id
do not count against each other. Runs are compared by 64-bit hashes, windows by 128 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortsift.llm.shared import partitions
from cohortsift.llm.shingles import Words, mixed, parts

#: Runs of one bucket, packed: column by column, little-endian.
PACKED = "bucket int, known binary, hashes binary, more binary, docs binary, ties binary, places binary"
#: What ``known`` holds in a row of settled places.
SETTLED = b"\x02"
_PACKED_NAMES = ["bucket", "known", "hashes", "more", "docs", "ties", "places"]


class _Runs:
    """Of a batch of texts: the short runs, and the run each window chose."""

    def __init__(self, texts: pa.Array, window: int) -> None:
        self.words = Words(texts, lower=False)
        self.short = (window + 1) // 2
        self.hash, self.text, self.at = self.words.runs(self.short)
        count = self.words.count
        runs = np.maximum(count - self.short + 1, 0)
        begin = np.cumsum(runs) - runs
        windows = np.maximum(count - window + 1, 0)
        self.window_text = np.repeat(np.arange(len(count)), windows)
        self.window_at = np.arange(len(self.window_text)) - np.repeat(np.cumsum(windows) - windows, windows)
        first = begin[self.window_text] + self.window_at
        self.chosen, least = first.copy(), self.hash[first]
        for k in range(1, window - self.short + 1):
            other = self.hash[first + k]
            smaller = other < least
            least = np.where(smaller, other, least)
            self.chosen = np.where(smaller, first + k, self.chosen)

    def chosen_runs(self) -> np.ndarray:
        mark = np.zeros(len(self.hash), dtype=bool)
        mark[self.chosen] = True
        return np.flatnonzero(mark)


def _packed(bucket: np.ndarray, buckets: int, columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Rows of packed columns, one for each bucket that has entries."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    sorted_columns = {name: c[order] for name, c in columns.items()}
    rows = [
        [b, *(sorted_columns[n][edges[b] : edges[b + 1]].tobytes() if n in columns else b"" for n in _PACKED_NAMES[1:])]
        for b in range(buckets) if edges[b] < edges[b + 1]
    ]
    if rows:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] + [pa.binary()] * 6, strict=True)], _PACKED_NAMES
        )


def _single(places: np.ndarray) -> np.ndarray:
    return np.column_stack([places, places + 1])


def _settled(docs: np.ndarray, ties: np.ndarray, places: np.ndarray, which: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row of places that need no comparison: the docs, ties, and pairs of first and last + 1 in ``places``."""
    for batch in _by_doc(docs[which], ties[which], _single(places[which])):
        pairs = [np.frombuffer(r, "<i4").reshape(-1, 2) for r in batch.column(2).to_pylist()]
        times = [len(p) for p in pairs]
        columns = [np.repeat(batch.column(k).to_numpy(), times).tobytes() for k in range(2)]
        row = [0, SETTLED, b"", b"", *columns, np.concatenate(pairs).tobytes()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([c], t) for c, t in zip(row, [pa.int32()] + [pa.binary()] * 6, strict=True)], _PACKED_NAMES
        )


def _in_several(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by key and doc, and for each sorted entry whether its key has several docs."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    start = np.flatnonzero(np.append(True, k[1:] != k[:-1])) if len(k) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(start, len(k)))
    several = d[np.append(start[1:], len(k)) - 1] != d[start] if len(k) else np.zeros(0, bool)
    return order, np.repeat(several, sizes)


def _by_doc(docs: np.ndarray, ties: np.ndarray, pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id, tie and the places of each document as ranges (first, last + 1), joined where they touch."""
    if not len(docs):
        return
    order = np.lexsort((pairs[:, 0], ties, docs))
    d, t, p = docs[order], ties[order], pairs[order].astype(np.int64)
    cut = np.append(True, (d[1:] != d[:-1]) | (t[1:] != t[:-1]))  # places of a document are distinct or nested in order
    jump = cut | np.append(True, p[1:, 0] > p[:-1, 1])
    first = np.flatnonzero(jump)
    ranges = np.column_stack([p[first, 0], np.maximum.reduceat(p[:, 1], first)]).astype("<i4")
    groups = np.flatnonzero(cut[first])
    edges = np.append(groups, len(first))
    own = [ranges[a:b].tobytes() for a, b in zip(edges, edges[1:], strict=False)]
    at = first[groups]
    yield pa.RecordBatch.from_arrays([pa.array(d[at]), pa.array(t[at]), pa.array(own, pa.binary())], ["doc_id", "tie", "ranges"])


_RANGES = "doc_id long, tie long, ranges binary"
#: Places of documents dealt by document: ids, ties, and pairs of first place and last + 1.
_GROUPED = "bucket int, docs binary, ties binary, pairs binary"


def _by_group(docs: np.ndarray, ties: np.ndarray, pairs: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """One row for each group of documents that has places."""
    if not len(docs):
        return
    group = (mixed(docs.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((pairs[:, 0], docs, group))
    edges = np.searchsorted(group[order], np.arange(buckets + 1))
    d, t, p = docs[order], ties[order], pairs[order].astype("<i4")
    rows = [(g, d[a:b].tobytes(), t[a:b].tobytes(), p[a:b].tobytes()) for g, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if a < b]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32()] + [pa.binary()] * 3, strict=True)]
    yield pa.RecordBatch.from_arrays(columns, ["bucket", "docs", "ties", "pairs"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each document of each group, with all its places; a group's rows come together."""
    held: list[tuple] = []

    def merge() -> Iterator[pa.RecordBatch]:
        docs, ties = (np.concatenate([np.frombuffer(r[k], "<i8") for r in held]) for k in (1, 2))
        pairs = np.concatenate([np.frombuffer(r[3], "<i4").reshape(-1, 2) for r in held])
        yield from _by_doc(docs, ties, pairs)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield from merge()
                held.clear()
            held.append(row)
    if held:
        yield from merge()


def _opened(ranges: bytes) -> np.ndarray:
    pairs = np.frombuffer(ranges, "<i4").reshape(-1, 2)
    sizes = pairs[:, 1] - pairs[:, 0]
    return np.repeat(pairs[:, 0] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _by_bucket(batches: Iterator[pa.RecordBatch], passed: list[tuple]) -> Iterator[dict[str, np.ndarray]]:
    """The entries of each bucket; its rows come together. Docs, ties and pairs of settled places go to ``passed``."""
    kinds = {"known": "u1", "hashes": "<u8", "more": "<u8", "docs": "<i8", "ties": "<i8", "places": "<i4"}
    held: list[tuple] = []

    def entries() -> dict[str, np.ndarray]:
        return {n: np.concatenate([np.frombuffer(r[k + 1], kind) for r in held]) for k, (n, kind) in enumerate(kinds.items())}

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[1] == SETTLED:
                passed.append((np.frombuffer(row[4], "<i8"), np.frombuffer(row[5], "<i8"), np.frombuffer(row[6], "<i4").reshape(-1, 2)))
                continue
            if held and held[0][0] != row[0]:
                yield entries()
                held = []
            held.append(row)
    if held:
        yield entries()


def _drained(passed: list[tuple], buckets: int) -> Iterator[pa.RecordBatch]:
    if passed:
        yield from _by_group(*(np.concatenate(c) for c in zip(*passed, strict=True)), buckets)
        passed.clear()


def _dealt(packed: DataFrame, buckets: int) -> DataFrame:
    """Each bucket as a partition of its own, so that no task has several and none waits empty."""
    return packed.repartitionById(buckets, "bucket")


def repeated_words(docs: DataFrame, window: int = 13, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``with_text``, kept (the words left, joined by single spaces)."""
    buckets = partitions(docs.sparkSession)
    # No cast where none is needed: an alias would keep Spark from using one shuffle of the texts twice.
    own_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long").alias("doc_id")
    known_ids = docs.where(F.col("doc_id").isNotNull()).select(own_id, "text", F.xxhash64("text").alias("tie"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            found = _Runs(part.column(1), window)
            mine = found.chosen_runs()
            doc, tie = part.column(0).to_numpy()[found.text[mine]], part.column(2).to_numpy()[found.text[mine]]
            order, several = _in_several(found.hash[mine], doc)
            mine, doc, tie = mine[order], doc[order], tie[order]
            key = found.hash[mine]
            one = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            # a run met in several documents here is sent once, as known, and its other places as settled
            sent = np.flatnonzero(~several | one)
            sent = sent[np.argsort(mine[sent])]  # by document, which packs well
            yield from _packed((key[sent] % np.uint64(buckets)).astype(np.int64), buckets, {
                "known": several[sent].astype("u1"), "hashes": key[sent], "docs": doc[sent], "ties": tie[sent],
                "places": found.at[mine[sent]].astype("<i4"),
            })
            yield from _settled(doc, tie, found.at[mine], several & ~one)

    def surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[tuple] = []
        for x in _by_bucket(batches, passed):
            yield from _drained(passed, buckets)
            order, several = _in_several(x["hashes"], x["docs"])
            known = x["known"][order]
            key = x["hashes"][order]
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            any_known = np.repeat(np.maximum.reduceat(known, start) > 0, np.diff(np.append(start, len(key)))) if len(key) else several
            kept = order[several | any_known]
            yield from _by_group(x["docs"][kept], x["ties"][kept], _single(x["places"][kept]), buckets)
        yield from _drained(passed, buckets)

    spread = F.when(F.col("settled"), F.pmod(F.xxhash64("docs"), F.lit(buckets)).cast("int")).otherwise(F.col("bucket"))
    packed = known_ids.select("doc_id", "text", "tie").mapInArrow(runs, PACKED)
    settled = packed.withColumn("settled", F.col("known") == F.lit(SETTLED))
    survivors = _dealt(settled.withColumn("bucket", spread).drop("settled"), buckets).mapInArrow(surviving, _GROUPED)
    survivors = _dealt(survivors, buckets).mapInArrow(_merged, _RANGES)

    same = known_ids.select("doc_id", "tie", F.md5("text").alias("digest"))
    first = same.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(F.col("first") < F.col("last"))
    copies = same.join(first, "digest").where(F.col("doc_id") > F.col("first")).select("doc_id", "tie", F.lit(None).cast("binary").alias("ranges"))
    marked = survivors.unionByName(copies).groupBy("doc_id").agg(F.collect_list(F.struct("tie", F.coalesce("ranges", F.lit(b"copy")).alias("ranges"))).alias("found"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            ties, found = part.column(2).to_pylist(), part.column(3).to_pylist()
            copied = np.array([any(f["ranges"] == b"copy" and f["tie"] == t for f in own) for t, own in zip(ties, found, strict=True)], bool)
            searched = np.flatnonzero(~copied)
            some = part.take(pa.array(searched))
            runs = _Runs(some.column(1), window)
            alive = np.zeros(len(runs.hash), dtype=bool)
            begin = np.searchsorted(runs.text, np.arange(len(searched) + 1))
            for k, row in enumerate(searched):
                for f in found[row]:
                    if f["tie"] == ties[row]:
                        alive[begin[k] + _opened(f["ranges"])] = True
            candidate = np.flatnonzero(alive[runs.chosen])
            text, at = runs.window_text[candidate], runs.window_at[candidate]
            one = runs.words.hash_runs(text, at, window, 101)
            two = runs.words.hash_runs(text, at, window, 202)
            doc, tie = some.column(0).to_numpy()[text], some.column(2).to_numpy()[text]
            order = np.lexsort((doc, two, one))
            one, two, doc, tie, at = one[order], two[order], doc[order], tie[order], at[order]
            start = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(one) else np.zeros(0, np.int64)
            least = np.repeat(doc[start], np.diff(np.append(start, len(one)))) if len(one) else doc
            mine = doc == least
            # what a smaller document of the batch holds too is settled; the rest asks the others
            columns = {"hashes": one, "more": two, "docs": doc, "ties": tie, "places": at.astype("<i4")}
            asked = np.flatnonzero(mine)
            asked = asked[np.lexsort((at[asked], doc[asked]))]
            yield from _packed((one[asked] % np.uint64(buckets)).astype(np.int64), buckets, {"known": np.zeros(len(asked), "u1")} | {n: c[asked] for n, c in columns.items()})
            yield from _settled(doc, tie, at, ~mine)

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed: list[tuple] = []
        for x in _by_bucket(batches, passed):
            yield from _drained(passed, buckets)
            one, two, doc = x["hashes"], x["more"], x["docs"]
            order = np.lexsort((doc, two, one))
            one, two, doc = one[order], two[order], doc[order]
            start = np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))) if len(one) else np.zeros(0, np.int64)
            least = np.repeat(doc[start], np.diff(np.append(start, len(one)))) if len(one) else doc
            gone = order[doc > least]
            yield from _by_group(x["docs"][gone], x["ties"][gone], _single(x["places"][gone]), buckets)
        yield from _drained(passed, buckets)

    searched = known_ids.join(marked, "doc_id").select("doc_id", "text", "tie", "found")
    second = searched.mapInArrow(windows, PACKED).withColumn("settled", F.col("known") == F.lit(SETTLED))
    gone = _dealt(second.withColumn("bucket", spread).drop("settled"), buckets).mapInArrow(later, _GROUPED)
    gone = _dealt(gone, buckets).mapInArrow(_merged, _RANGES)
    removed = gone.unionByName(copies).groupBy("doc_id").agg(
        F.collect_list(F.struct("tie", F.coalesce("ranges", F.lit(b"copy")).alias("ranges"))).alias("gone")
    )

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            rows = []
            texts = part.column(1).cast(pa.binary()).to_pylist()
            for text, tie, gone in zip(texts, part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                words = (text or b"").split()
                n = len(words)
                own = [g["ranges"] for g in gone or () if g["tie"] == tie]
                if own and n >= window:
                    covered = np.zeros(n + 1, dtype=np.int64)
                    for ranges in own:
                        pairs = np.array([[0, n - window + 1]]) if ranges == b"copy" else np.frombuffer(ranges, "<i4").reshape(-1, 2)
                        np.add.at(covered, pairs[:, 0], 1)
                        np.add.at(covered, pairs[:, 1] + window - 1, -1)
                    left = np.flatnonzero(np.cumsum(covered[:n]) == 0)
                    words = [words[k] for k in left]
                joined = b" ".join(words)
                rows.append((n, n - len(words), hashlib.sha256(joined).hexdigest(), joined.decode()) if with_text else (n, n - len(words), hashlib.sha256(joined).hexdigest()))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string()][: 3 + with_text]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    nothing = F.lit(None).cast("array<struct<tie:bigint,ranges:binary>>")
    without_id = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"), nothing.alias("gone"))
    all_docs = known_ids.join(removed, "doc_id", "left").select("doc_id", "text", "tie", "gone").unionByName(without_id)
    return all_docs.mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text)
