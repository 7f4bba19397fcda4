"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions only.

A source of weight v among weights that sum to d gets a window for each of its blocks: block k is
released at slot floor(k d / v) and due at ceil((k + 1) d / v). One block is placed in each slot,
of those released the one due first, ties to the larger source. So after any slot each source has been
served the floor or the ceiling of its share of the slots: it is less than one block off its weight, from
the first slot to the last, however many there are and however unlike the weights.

Time is cut into frames of ``FRAME`` slots, a row each, which any task can schedule on its own. What is served before a
frame is found from the frame before: that one is started with the blocks due first as those served ahead of
their shares, and run to its end. A schedule by deadlines misses none, so what it ends with can be gone on from; and it
can be reached from whatever state that frame really starts with, as blocks whose windows lie in an interval are at most as
many as its slots, also when a frame's bounds cut them, and no window is longer than a frame. So every frame is run twice,
first to find where the next one starts, then from its own start, taking only blocks that the next start counts as served.
Weights are whole numbers (1e12 in all), so no rounding builds up over frames.

Sources with windows longer than a frame share one sequence of slots, those where floor(t v / d) grows for their common v.
Any stretch of slots holds the floor or the ceiling of its share of them, which leaves room for all windows of the other
sources. In the turns they share, such sources are scheduled in the same way, due at floor((k + 1) d / v), which is feasible
too and makes up for the turn that the sequence may be behind. Of those, sources under a thousandth of the shared weight share
turns again; they, and those beside them, can be off by a block and a thousandth.

Documents of a source come in the order of a hash, ranked within salts; each salt starts at the sum of those
before it. The places of a salt are gathered beside it and meet its documents where they lie, so texts move once. The mix ends
when every source has been served whole; a source that has fewer documents than its weight asks for begins again
meanwhile (``epoch`` 1 ...), so no document is dropped and the weights hold to the end. Work grows with the slots
times the sources; no array or broadcast grows with the documents, but for the places of a salt, a 4096th of a source.

Defined results: a NULL source is a source of its own; rows with equal id and text come in any order, placed one
by one; an empty table gives no rows; columns may have any names. A given weight must be positive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortsift.llm.shared import stored

#: Hexadecimal digits of the hash that name a salt.
SALT_DIGITS = 3
#: Slots of a frame.
FRAME = 1000
#: What the weights of all sources add up to, but for rounding.
WHOLE = 10**12
#: Frames that are listed together.
LISTED = 1000


def _div(a: Column, b: Column | int) -> Column:
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _exact(value: Column) -> Column:
    return value.cast("decimal(19,0)")


def _let(value: Column, then) -> Column:  # evaluates the value once
    return F.transform(F.array(value), then)[0]


def content_order() -> Column:
    """The hash that documents of a source are ordered by."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "text")]
    return F.md5(F.concat(text[0], F.lit(":"), text[1]))


def weighed(sources: DataFrame, exponent: float, weights: dict[str | None, float] | None) -> DataFrame:
    """``sources`` (source and n) with ``v``, each one's whole weight: the one given, else n ** exponent."""
    weight = F.pow(F.col("n").cast("double"), F.lit(exponent))
    for source, given in (weights or {}).items():
        if not given > 0:
            raise ValueError(f"the weight of {source!r} is not positive: {given!r}")
        weight = F.when(F.col("source").eqNullSafe(F.lit(source)), F.lit(float(given))).otherwise(weight)
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy())  # a row for each source
    return sources.withColumn("weight", weight).withColumn("v", F.greatest(F.round(share * WHOLE).cast("long"), F.lit(1))).drop("weight")


@dataclass(frozen=True)
class Level:
    """Slots shared by sources: ``d`` is the sum of their weights, ``apart`` that of those that share turns of their own."""

    frame: int
    d: int
    apart: int
    slots: int
    strict: bool

    def deadline(self, s: Column, k: Column) -> Column:
        """The slot, from the frame's start, by which a block is due; ``k`` counts from what is due by the frame's start."""
        return _div((k + 1) * self.d - s["rest"] + (0 if self.strict else s["v"] - 1), s["v"])

    def at(self, turn: Column) -> Column:
        """The slot of a turn of the sources apart."""
        return _div(_exact(turn + 1) * _exact(F.lit(self.d)) + self.apart - 1, self.apart) - 1


def _frames(sources: DataFrame, level: Level) -> DataFrame:
    """A row for each frame: of each source pool, v, what is due before it and what of the next block is; and how many slots are apart."""
    one = sources.agg(F.sort_array(F.collect_list(F.struct("pool", "v"))).alias("all"))
    last = (level.slots - 1) // level.frame
    listed = one.withColumn("list", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last // LISTED).cast("long"))))
    first = F.col("list") * LISTED
    each = listed.select("all", F.explode(F.sequence(first, F.least(first + LISTED - 1, F.lit(last)))).alias("frame"))
    due = _exact(F.col("frame") * level.frame)

    def parts(v: Column, then) -> Column:
        return _let(due * _exact(v), lambda p: then(_div(p, level.d).cast("long"), (p % level.d).cast("long")))

    def stands(s: Column) -> Column:
        return parts(s["v"], lambda q, r: F.struct(s["pool"].alias("pool"), s["v"].alias("v"), q.alias("before"), r.alias("rest")))

    apart = parts(F.lit(level.apart), lambda q, r: F.struct(q.alias("before"), r.alias("rest")))
    return each.repartition("frame").select("frame", F.transform("all", stands).alias("all"), apart.alias("apart"))


def _first_due(level: Level) -> Column:
    """Of each source 1 if its begun block counts as served at the frame's start, else 0: those due first do."""

    def key(s: Column, i: Column) -> Column:
        return F.when(s["rest"] > 0, F.struct(level.deadline(s, F.lit(0)).alias("due"), i.alias("i")))

    begun = F.filter(F.transform("all", key), lambda x: x.isNotNull())
    due = F.aggregate("all", F.col("apart.before"), lambda total, s: total + s["before"])
    ahead = (F.col("frame") * level.frame - due).cast("int")
    return _let(
        F.when(ahead > 0, F.get(F.array_sort(begun), ahead - 1)),
        lambda last: F.transform("all", lambda s, i: F.coalesce((key(s, i) <= last).cast("long"), F.lit(0).cast("long"))),
    )


def _run(start: Column, level: Level, until: Column | None = None) -> Column:
    """served (of each source, from the frame's start) and picks (source and block of each slot) of a frame, earliest deadline first."""

    def place(done: Column, slot: Column) -> Column:
        def due(s: Column, i: Column) -> Column:
            k = done["served"][i]
            ready = k * level.d < s["rest"] + (slot + 1) * s["v"]
            if until is not None:
                ready = ready & (k < until[i])
            return F.when(ready, level.deadline(s, k))

        first = _let(F.transform("all", due), lambda d: F.array_position(d, F.array_min(d)).cast("int") - 1)

        def served(pick: Column) -> Column:
            grown = F.transform(done["served"], lambda k, i: F.when(i == pick, k + 1).otherwise(k)).alias("served")
            if until is None:
                return F.struct(grown, done["picks"].alias("picks"))
            own = F.struct(pick.alias("i"), done["served"][pick].alias("k"), slot.alias("slot"))
            return F.struct(grown, F.concat(done["picks"], F.array(own)).alias("picks"))

        placed = _let(first, served)
        if not level.apart:
            return placed
        rest = F.col("apart.rest") + slot * level.apart
        return F.when(_div(rest + level.apart, level.d) > _div(rest, level.d), done).otherwise(placed)

    nothing = F.struct(start.alias("served"), F.array().cast("array<struct<i:int,k:bigint,slot:bigint>>").alias("picks"))
    slots = F.sequence(F.lit(0).cast("long"), F.lit(level.frame - 1).cast("long"))
    return F.aggregate(slots, nothing, place)


def _turns(sources: DataFrame, level: Level) -> DataFrame:
    """pool, block and slot of every block of the sources of a level."""
    frames = _frames(sources, level)
    absolute = F.transform("served", lambda k, i: k + F.col("all")[i]["before"])
    ends = frames.withColumn("served", _run(_first_due(level), level)["served"]).select("frame", absolute.alias("until"))
    starts = ends.select((F.col("frame") + 1).alias("frame"), F.col("until").alias("start"))
    bounds = frames.join(starts, "frame", "left").join(ends, "frame")
    start = F.transform("all", lambda s, i: F.coalesce(F.col("start")[i] - s["before"], F.lit(0).cast("long")))
    until = F.transform("all", lambda s, i: F.col("until")[i] - s["before"])
    known = bounds.select("frame", "all", "apart", start.alias("begin"), until.alias("stop"))
    run = known.select("frame", "all", F.explode(_run(F.col("begin"), level, F.col("stop"))["picks"]).alias("pick"))
    own = F.col("all")[F.col("pick.i")]
    slot = F.col("frame") * level.frame + F.col("pick.slot")
    return run.where(slot < level.slots).select(own["pool"].alias("pool"), (own["before"] + F.col("pick.k")).alias("block"), slot.alias("slot"))


def schedule(sources: DataFrame, frame: int = FRAME) -> DataFrame:
    """pool, block and slot of every block in the mix of ``sources`` (pool, v, and blocks to be served at least)."""
    total = F.sum("v").over(Window.partitionBy())  # a row for each source
    end = _div(_exact(F.col("blocks")) * _exact(F.col("d")) + F.col("v") - 1, F.col("v"))
    slots = sources.withColumn("d", total).agg(F.max(end)).first()[0] or 0
    levels: list[Level] = []
    found = None
    while slots:
        known = sources.agg(F.sum("v").alias("d"), F.max("v").alias("most")).first()
        length = max(frame, 2 * -(-known.d // known.most) + 4)
        within = F.col("v") * (length - 2) >= known.d
        apart = sources.where(~within).agg(F.sum("v")).first()[0] or 0
        level = Level(length, known.d, apart, int(slots), bool(levels) and not apart)
        turns = _turns(sources.where(within), level)
        slot = F.col("slot")
        for upper in reversed(levels):
            slot = upper.at(slot)
        turns = turns.select("pool", "block", slot.cast("long").alias("slot"))
        found = turns if found is None else found.unionByName(turns)
        levels.append(level)
        sources, slots = sources.where(~within), slots * apart // known.d
    return sources.sparkSession.createDataFrame([], "pool long, block long, slot long") if found is None else found


def mix(
    docs: DataFrame, weights: dict[str | None, float] | None = None, exponent: float = 0.8, block: int = 8,
    frame: int = FRAME, order: Column | None = None,
) -> DataFrame:
    """``row``, a struct of the columns of ``docs``, and ``place``, a struct of epoch, block (of the source), slot and position (in the mix).

    ``weights`` gives the target weight of a source; of others it is their count to the power of
    ``exponent``. ``block`` is the number of documents in a block, ``order`` a hexadecimal hash of each document.
    """
    source = F.col("source").cast("string")
    own = F.concat(F.when(source.isNull(), "0").otherwise("1"), F.coalesce(source, F.lit("")))  # joins as any other does
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    keyed = docs.select(row, own.alias("own"), (content_order() if order is None else order).alias("key"))
    keyed = keyed.withColumn("salt", F.substring("key", 1, SALT_DIGITS))
    salts = keyed.groupBy("own", "salt").agg(F.count("*").alias("rows"), F.max("row.source").alias("source"))
    counted = salts.groupBy("own").agg(F.sum("rows").alias("n"), F.max("source").alias("source"))
    by_size = Window.partitionBy().orderBy(F.col("n").desc(), F.col("own"))  # a row for each source
    sources = weighed(counted, exponent, weights).withColumn("pool", F.row_number().over(by_size).cast("long"))
    sources = sources.withColumn("blocks", F.ceil(F.col("n") / block))
    sources = stored(sources, "sources")
    table = schedule(sources, frame)
    in_pool = Window.partitionBy("own").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    based = salts.drop("source").join(sources.select("own", "n", "pool", "v"), "own")
    based = based.withColumn("base", F.coalesce(F.sum("rows").over(in_pool), F.lit(0).cast("long")))
    zero = F.lit(0).cast("long")
    # a source is served its blocks, and more while the one served last takes its time
    slowest = F.max(F.col("blocks") / F.col("v")).over(Window.partitionBy())  # a row for each source
    served = sources.select("own", (F.ceil(F.col("v") * slowest) + 2).alias("served"))
    epochs = _div(F.col("served") * block - 1 - F.col("base"), F.col("n"))
    begun = based.join(served, "own").where(F.col("served") * block > F.col("base")).withColumn("epoch", F.explode(F.sequence(zero, epochs)))
    first, last = F.col("base") + F.col("epoch") * F.col("n"), F.col("base") + F.col("rows") - 1 + F.col("epoch") * F.col("n")
    spans = begun.select("own", "salt", "pool", "epoch", F.explode(F.sequence(_div(first, block), _div(last, block))).alias("block"))
    turn = F.sort_array(F.collect_list(F.struct("block", "slot")))  # of one salt
    placed = spans.join(table, ["pool", "block"]).groupBy("own", "salt", "epoch").agg(turn.alias("turns"))
    turns = placed.select("own", "salt", F.struct("epoch", F.col("turns")[0]["block"].alias("first"), F.col("turns.slot").alias("slots")).alias("turn"))
    turns = turns.groupBy("own", "salt").agg(F.collect_list("turn").alias("turns"))
    beside = based.select("own", "salt", "base", "n").join(turns, ["own", "salt"])
    within = Window.partitionBy("own", "salt").orderBy("key")
    ranked = keyed.withColumn("rank", F.row_number().over(within).cast("long") - 1).join(beside, ["own", "salt"])

    def decided(t: Column) -> Column:
        return _let(
            F.col("rank") + F.col("base") + t["epoch"] * F.col("n"),
            lambda index: _let(
                F.get(t["slots"], (_div(index, block) - t["first"]).cast("int")),
                lambda slot: F.when(
                    slot.isNotNull(),
                    F.struct(t["epoch"].alias("epoch"), _div(index, block).alias("block"), slot.alias("slot"), (slot * block + index % block).alias("position")),
                ),
            ),
        )

    places = F.filter(F.transform("turns", decided), lambda p: p.isNotNull())
    return ranked.select("row", F.explode(places).alias("place"))


def in_order(mixed: DataFrame) -> DataFrame:
    """The documents of a mix, sorted by position over all partitions."""
    place = F.col("place.position")
    return mixed.repartitionByRange(place).sortWithinPartitions(place).select("row.*")
