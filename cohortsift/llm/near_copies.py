"""Near-duplicate documents: SetSketch registers, banded, estimated by likelihood, verified.

A document is the set of its runs of words (``shingles``). Equal sets are one class from
the start. A class gets ``BANDS * ROWS`` registers: register i is the smallest of the set's
values under hash i, read as an exponential variate and rounded to powers of ``BASE``, so
that registers of two sets merge by maximum and agree about as often as the sets overlap.
Classes that agree on all registers of a band are candidates of each other.

Candidates are never listed pair by pair. Each bucket names a hub, the member that
shares most buckets; every member is compared with the hubs of its buckets: by the
joint likelihood of both classes' registers, then, unless that rules the link out,
on the full sets. That joins nearly everything that belongs together. Where members of a
hub are in different components afterwards, links between them are found by rare runs. Two linked
sets share at least ``percent`` hundredths of either, so each can do without some of its runs: of
those found in several components the rarest ``shared - least + 1`` are its prefix, and two linked sets have
one of their prefixes in common. A set with fewer shared runs than it needs is out, which is
what becomes of most texts of a common template. Sets that meet in a run of few texts are compared
pair by pair, once; those with a frequent run in the prefix on full sets, block by block within their
hub. Every two classes that share a bucket share its hub, so each such
pair is in one component or has been compared or ruled out. With 32 bands of 5 registers, a pair at
a least similarity s is missed with a chance of (1 - s ** 5) ** 32: 7e-9 at 0.85, 3e-6 at 0.8.

Defined results: a NULL or empty text has the empty set, which is linked with nothing;
fewer words than a run are one run. Rows with a NULL id take no part: no component, kept.
Rows that repeat an id share a component if their sets do. Sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cohortsift.llm.graph import components
from cohortsift.llm.shared import stored
from cohortsift.llm.shingles import mixed, parts, shingle_sets

BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
BASE = 1.02
#: Values of sets sketched at once.
CHUNK = 1 << 15
#: Members of a hub in one block.
BLOCK = 256
#: Texts of a run, at most, whose pairs are formed; those of a more frequent run meet in blocks.
LIGHT = 64
#: Standard errors below the least similarity at which an estimate rules a link out.
ERRORS = 6.0

_DRAW = np.random.default_rng(11)
_ODD = _DRAW.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_TURN = _DRAW.integers(0, 1 << 32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers for each set; zeros for the empty set."""
    out = np.zeros((len(sets), REGISTERS), dtype=np.uint16)
    full = [k for k, s in enumerate(sets) if len(s)]
    a = 0
    while a < len(full):
        b, size = a, 0
        while b < len(full) and (b == a or size + len(sets[full[b]]) <= CHUNK):
            size += len(sets[full[b]])
            b += 1
        own = full[a:b]
        values = (np.concatenate([sets[k] for k in own]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *(len(sets[k]) for k in own)])[:-1]
        least = np.empty((len(own), REGISTERS))
        for i in range(REGISTERS):
            least[:, i] = np.minimum.reduceat((values ^ _TURN[i]) * _ODD[i], starts)
        exponential = -np.log1p(-(least + 0.5) / 2.0**32)
        out[own] = np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)), 0, 65535)
        a = b
    return out


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of each row."""
    banded = sketches.reshape(len(sketches), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), banded.shape[:2]).copy()
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + banded[:, :, k] + np.uint64(1))
    return key.view(np.int64)


def fingerprint(values: np.ndarray) -> int:
    """The class of a set."""
    both = np.array([values.sum(dtype=np.uint64), np.bitwise_xor.reduce(mixed(values)), len(values)], dtype=np.uint64)
    return int((mixed(both) * np.array([1, 3, 5], np.uint64)).sum(dtype=np.uint64).astype(np.int64))


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """The similarity of each pair that makes its registers likeliest, the sizes of both sets given."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - above - below
    u, v = size_a / (size_a + size_b), size_b / (size_a + size_b)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    best, at = np.full(len(a), -np.inf), np.zeros(len(a))
    for j in np.linspace(0, 1, 101):
        up, down = chance(u - v * j), chance(v - u * j)
        with np.errstate(divide="ignore", invalid="ignore"):
            parts = [np.where(n > 0, n * np.log(np.maximum(p, 1e-300)), 0) for n, p in ((above, up), (below, down), (same, 1 - up - down))]
        likely = sum(parts)
        at, best = np.where(likely > best, j, at), np.maximum(likely, best)
    return at


def _overlap(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of all intersections of a set of a with one of b."""
    both = np.intersect1d(np.unique(np.concatenate(a)), np.unique(np.concatenate(b)), assume_unique=True)
    total = np.zeros((len(a), len(b)), dtype=np.float32)
    for c in range(0, len(both), 1 << 14):
        some = both[c : c + (1 << 14)]
        left, right = (np.zeros((len(x), len(some)), dtype=np.float32) for x in (a, b))
        for grid, sets in ((left, a), (right, b)):
            for k, s in enumerate(sets):
                at = np.searchsorted(some, s)
                at[at == len(some)] = 0
                grid[k, at[some[at] == s]] = 1
        total += left @ right.T
    return total.astype(np.int64)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, tie (a hash of the text), n (size of its set), class and band keys of each row; no class or keys for the empty set."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            sets = shingle_sets(part.column(1), words)
            keys = band_keys(registers(sets))
            columns = [
                part.column(0), part.column(2), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([fingerprint(s) if len(s) else None for s in sets], pa.int64()),
                pa.array([k.tolist() if len(s) else None for k, s in zip(keys, sets, strict=True)], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "n", "class", "keys"])

    schema = "doc_id long, tie long, n long, class long, keys array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie")).mapInArrow(sketch, schema)


def _hubs(classes: DataFrame) -> DataFrame:
    """hub and class, once for each class and hub of one of its buckets; a hub is a member too."""
    rows = classes.select("class", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("members")).where(F.col("members") > 1)
    active = stored(rows.join(shared, "key"), "buckets")
    weight = active.groupBy("class").agg(F.sum("members").alias("weight"))
    hub = active.join(weight, "class").groupBy("key").agg(F.max(F.struct("weight", "class"))["class"].alias("hub"))
    return active.join(hub, "key").select("hub", "class").distinct()


def _sets(docs: DataFrame, classes: DataFrame, words: int) -> DataFrame:
    """class, n, sketch and set of the classes named, from a text of each."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches):
            sets = shingle_sets(part.column(1), words)
            rows = zip(part.column(0).to_pylist(), sets, registers(sets), strict=True)
            own = [(c, len(s), r.tobytes(), s.tobytes()) for c, s, r in rows if len(s) and fingerprint(s) == c]
            columns = list(zip(*own, strict=True)) or [(), (), (), ()]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["class", "n", "sketch", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(classes, "doc_id").select("class", "text")
    found = texts.mapInArrow(read, "class long, n long, sketch binary, set binary")
    return found.groupBy("class").agg(*(F.first(c).alias(c) for c in ("n", "sketch", "set")))


def _similar(hub_pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: the pairs of hub and class that are linked."""
    least = percent / 100
    ruled_out = least - ERRORS * np.sqrt(least * (1 - least) / REGISTERS)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                rows = batch.slice(at, 1000)
                a, b = ([np.frombuffer(x, "<u8") for x in rows.column(c).to_pylist()] for c in ("set", "hub_set"))
                left, right = (np.array([np.frombuffer(x, "<u2") for x in rows.column(c).to_pylist()]) for c in ("sketch", "hub_sketch"))
                sizes = [np.array([len(s) for s in x]) for x in (a, b)]
                maybe = np.flatnonzero(estimate(left, right, *sizes) >= ruled_out) if len(a) else []
                linked = []
                for k in maybe:
                    common = len(np.intersect1d(a[k], b[k], assume_unique=True))
                    if 100 * common >= percent * (len(a[k]) + len(b[k]) - common):
                        linked.append(k)
                yield pa.RecordBatch.from_arrays([rows.column(c).take(pa.array(linked, pa.int64())) for c in ("class", "hub")], ["a", "b"])

    member, hub = (sets.select(*(F.col(c).alias(f"{p}{c}") for c in ("class", "sketch", "set"))) for p in ("", "hub_"))
    pairs = hub_pairs.where(F.col("hub") != F.col("class")).join(member, "class").join(hub, F.col("hub") == F.col("hub_class"))
    return pairs.select("class", "hub", "set", "hub_set", "sketch", "hub_sketch").mapInArrow(verify, "a long, b long")


def _runs_of(members: DataFrame, sets: DataFrame) -> DataFrame:
    """class, label, n and each run of the members' sets."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts(batches, texts=3):
            own = [np.frombuffer(x, "<i8") for x in part.column(3).to_pylist()]
            times = [len(x) for x in own]
            columns = [pa.array(np.repeat(part.column(k).to_numpy(), times)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(own) if own else np.zeros(0, np.int64))], ["class", "label", "n", "run"])

    rows = members.join(sets.select("class", "n", "set"), "class").select("class", "label", "n", "set")
    return rows.mapInArrow(runs, "class long, label long, n long, run long")


def _prefixes(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """class, label, n, run and its frequency, for the runs of each member's prefix; of runs within one label none."""
    runs = _runs_of(members, sets)
    shared = runs.groupBy("run").agg(F.count("*").alias("times"), F.min("label").alias("low"), F.max("label").alias("high"))
    shared = shared.where(F.col("low") < F.col("high")).select("run", "times")
    found = runs.join(shared, "run")  # a run of many texts makes a large partition, which the adaptive plan splits
    own = Window.partitionBy("class")
    least = F.ceil(F.col("n") * percent / 100)
    ranked = found.withColumns({"rank": F.row_number().over(own.orderBy("times", "run")), "shared": F.count("*").over(own)})
    return ranked.where(F.col("rank") <= F.col("shared") - least + 1).select("class", "label", "n", "run", "times")


def _rare_pairs(prefixes: DataFrame, percent: int) -> DataFrame:
    """hub and class: every two members in different components that share a rare run of their prefixes, once."""
    rare = prefixes.where(F.col("times") <= LIGHT).drop("times")
    other = rare.select("run", *(F.col(c).alias(f"hub_{c}") for c in ("class", "label", "n")))
    alike = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    met = rare.join(other, "run").where((F.col("class") > F.col("hub_class")) & (F.col("label") != F.col("hub_label")) & alike)
    return met.select(F.col("hub_class").alias("hub"), "class").distinct()


def _between(hub_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between members of a hub that are in different components; ``hub_rows`` has hub, class and label."""
    open_hubs = hub_rows.groupBy("hub").agg(F.min("label").alias("low"), F.max("label").alias("high")).where(F.col("low") < F.col("high"))
    members = stored(hub_rows.join(open_hubs.select("hub"), "hub").select("class", "label").distinct(), "members")
    prefixes = stored(_prefixes(members, sets, percent), "prefixes")
    frequent = prefixes.where(F.col("times") > LIGHT).select("class").distinct()
    blocks = _in_blocks(hub_rows.join(frequent, "class", "left_semi"), sets, percent)
    return _similar(_rare_pairs(prefixes, percent), sets, percent).unionByName(blocks)


def _in_blocks(hub_rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: links between members of a hub that are in different components, all compared on full sets.

    Members are dealt into blocks within their hub
    and label's group; two blocks meet if they may hold different labels.
    """
    labels = hub_rows.groupBy("hub", "label").agg(F.count("*").alias("n"))
    hubs = labels.groupBy("hub").agg(F.sum("n").alias("all"), F.count("*").alias("labels"), F.max("n").alias("largest"))
    mixed_hubs = hubs.where(F.col("labels") > 1)
    main = labels.groupBy("hub").agg(F.max(F.struct("n", "label"))["label"].alias("main")).join(mixed_hubs, "hub")
    rows = hub_rows.join(main, "hub")
    in_main = F.col("label") == F.col("main")
    main_blocks = F.ceil(F.col("largest") / BLOCK).cast("int")
    rest_blocks = F.ceil((F.col("all") - F.col("largest")) / BLOCK).cast("int")
    # blocks of the main label are numbered from 0, those of all others follow
    block = F.when(in_main, F.pmod(F.xxhash64("class"), main_blocks)).otherwise(main_blocks + F.pmod(F.xxhash64("class"), rest_blocks))
    dealt = rows.withColumn("block", block.cast("int"))
    every = F.sequence(F.lit(0), main_blocks + rest_blocks - 1)
    others = F.when(in_main, F.filter(every, lambda x: x >= main_blocks)).otherwise(every)
    met = dealt.withColumn("other", F.explode(others))
    met = met.select(
        "hub", "class", "label", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") < F.col("other")).alias("first")
    ).join(sets.select("class", "set"), "class")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        ids, label = table.column("class").to_numpy(), table.column("label").to_numpy()
        first = np.asarray(table.column("first").to_pylist(), dtype=bool)
        own = [np.frombuffer(x, "<u8") for x in table.column("set").to_pylist()]
        left, right = (np.flatnonzero(first), np.flatnonzero(~first)) if key[1] != key[2] else (np.arange(len(ids)),) * 2
        links = []
        for x in range(0, len(left), BLOCK):
            for y in range(0, len(right), BLOCK):
                i, j = left[x : x + BLOCK], right[y : y + BLOCK]
                size = np.array([len(s) for s in own])
                common = _overlap([own[k] for k in i], [own[k] for k in j])
                union = size[i][:, None] + size[j][None, :] - common
                p, q = np.nonzero((100 * common >= percent * union) & (label[i][:, None] != label[j][None, :]))
                links.append(np.column_stack([ids[i[p]], ids[j[q]]]))
        found = np.concatenate(links) if links else np.zeros((0, 2), np.int64)
        return pa.table({"a": found[:, 0], "b": found[:, 1]})

    return met.groupBy("hub", "low", "high").applyInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, tie, n_shingles, component_id (the smallest id reachable by links), kept (whether it is the own id).

    Two sets are linked if their intersection is at least ``percent`` hundredths of their union.
    """
    found = stored(sketched(docs, words), "sketches")
    known = found.where(F.col("doc_id").isNotNull() & F.col("class").isNotNull())
    classes = known.groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    hub_pairs = stored(_hubs(classes), "hubs")
    active = hub_pairs.select("class").distinct()
    reps = classes.select("class", "doc_id").join(active, "class")
    sets = stored(_sets(docs, reps, words), "sets")
    links = stored(_similar(hub_pairs, sets, percent), "hub-links")
    labels = components(links)
    named = hub_pairs.join(labels, hub_pairs["class"] == labels["node"], "left").select("hub", "class", F.coalesce("label", "class").alias("label"))
    more = _between(named, sets, percent)
    both = components(links.unionByName(more))
    of_class = classes.select("class", "doc_id").join(both, F.col("class") == F.col("node"), "left")
    of_class = of_class.select("class", "doc_id", F.coalesce("label", "class").alias("label"))
    smallest = of_class.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    component = of_class.join(smallest, "label").select(F.col("class").alias("own"), "component_id")
    joined = found.select("doc_id", "tie", "n", "class").join(component, (F.col("class") == F.col("own")) & F.col("doc_id").isNotNull(), "left")
    reached = F.coalesce("component_id", "doc_id")
    return joined.select(
        "doc_id", "tie", F.col("n").alias("n_shingles"), reached.alias("component_id"), F.coalesce(F.col("doc_id") == reached, F.lit(True)).alias("kept")
    )


def without_near_copies(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is kept; of rows equal in id and text one stays, rows with a NULL id all stay."""
    found = near_copies(docs, words, percent)
    apart = F.lit(0).cast("long").alias("apart")
    gone = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias("id"), "tie", apart).distinct(), "gone")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")  # its names are its own
    without = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).otherwise(0).alias("apart")  # each alone
    keyed = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("tie"), without)
    left = keyed.join(gone, ["id", "tie", "apart"], "left_anti")
    repeat = F.row_number().over(Window.partitionBy("id", "tie", "apart").orderBy("tie"))
    return left.withColumn("repeat", repeat).where("repeat = 1").select("row.*")
