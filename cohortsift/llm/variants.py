"""Spelling variants by finite-state composition: words one edit apart, and the form each stands for.

The vocabulary's minimised acceptor is composed with a transducer of exactly one inserted, deleted or
replaced code point and with the acceptor again; every pair the composition accepts is a pair of
near words. The composition is cut by its initial states, so that each part is a small machine of
its own: a pair of length l and l, or l and l + 1, has its edit either behind the first l // 2 code
points, and shares those, or within them, and shares the rest. So each word goes to the state named by
its beginning and the state named by its end, for both lengths; a state's machine accepts what
is between. A pair is accepted in one state only, that of its shorter length and, if both fit,
its beginning. A state with more than ``HEAVY`` words is cut again in the same way, as often as that helps, so
no task gathers a large group; what cannot be cut further is two code points long or less.

A machine is built and walked by a task, which returns for each word the number of its near
words and the best of them; Spark adds them up. Counts of words are one aggregate, partial before
the shuffle. Nothing reaches the driver but whether a heavy state or an unfinished root is left.

Defined results: a NULL or empty word is no word; repeated words count together; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortsift.llm.shared import stored

#: Words of one initial state that are walked together.
HEAVY = 10_000

State = tuple[bool, dict[str, int]]

_STATE = ["size", "limit", "before", "after"]
_FOUND = "word string, n_near long, best struct<less:bigint,word:string>"


class Acceptor:
    """The minimised acceptor of sorted distinct words; equal states are one."""

    def __init__(self, words: list[str]) -> None:
        self.states: list[State] = []
        known: dict[tuple, int] = {}

        def settle(node: list) -> int:
            key = (node[0], *node[1].items())
            if key not in known:
                known[key] = len(self.states)
                self.states.append((node[0], node[1]))
            return known[key]

        path, last = [[False, {}]], ""
        for word in words:
            shared = next((i for i, (a, b) in enumerate(zip(last, word, strict=False)) if a != b), min(len(last), len(word)))
            for k in range(len(last), shared, -1):
                node = path.pop()
                path[-1][1][last[k - 1]] = settle(node)
            for letter in word[shared:]:
                path.append([False, {}])
            path[-1][0] = True
            last = word
        for k in range(len(last), 0, -1):
            node = path.pop()
            path[-1][1][last[k - 1]] = settle(node)
        self.start = settle(path[0])

    def common(self, p: int, q: int) -> Iterator[str]:
        """What is accepted from both states."""
        todo = [(p, q, "")]
        while todo:
            p, q, read = todo.pop()
            (ends, left), (too, right) = self.states[p], self.states[q]
            if ends and too:
                yield read
            if len(left) > len(right):
                left, right = right, left
            todo += [(then, right[letter], read + letter) for letter, then in left.items() if letter in right]

    def one_edit_apart(self) -> Iterator[tuple[str, str]]:
        """Each pair of accepted words that one edit makes equal, once, the shorter first.

        Up to the edit both sides of the composition are in the same state, after it they must agree. An
        inserted letter stands before equal ones.
        """
        todo = [(self.start, "")]
        while todo:
            state, read = todo.pop()
            arcs = list(self.states[state][1].items())
            for k, (letter, then) in enumerate(arcs):
                for other, there in arcs[:k]:
                    for rest in self.common(there, then):
                        yield read + other + rest, read + letter + rest
                if not read.endswith(letter):
                    for rest in self.common(state, then):
                        yield read + rest, read + letter + rest
                todo.append((then, read + letter))


def _walk(size: int, limit: int, before: str, after: str, counts: dict[str, int]) -> list[tuple]:
    """word, number of near words and the best of them, of the pairs that belong to one initial state."""
    near: dict[str, int] = {}
    best: dict[str, tuple[int, str]] = {}
    middle = size - len(before) - len(after)  # of the shorter word
    bound = limit - len(before)
    for pair in Acceptor(sorted(counts)).one_edit_apart():
        u, v = pair
        if len(u) != middle or bound <= middle and u[:bound] == v[:bound]:
            continue
        for own, other in (pair, pair[::-1]):
            near[own] = near.get(own, 0) + 1
            found = (-counts[other], other)
            if own not in best or found < best[own]:
                best[own] = found
    return [(before + w + after, k, -best[w][0], before + best[w][1] + after) for w, k in near.items()]


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Walks each state's machine; rows of a state follow each other."""
    state, counts = None, {}
    found: list[tuple] = []
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in range(6)]
        for size, limit, before, after, rest, n in zip(*columns, strict=True):
            own = (size, limit, before, after)
            if own != state:
                if len(counts) > 1:
                    found += _walk(*state, counts)
                state, counts = own, {}
                if len(found) > 20_000:
                    yield _found(found)
                    found = []
            counts[rest] = n
    if len(counts) > 1:
        found += _walk(*state, counts)
    yield _found(found)


def _found(rows: list[tuple]) -> pa.RecordBatch:
    words, near, best_n, best = zip(*rows, strict=True) if rows else ([], [], [], [])
    pairs = pa.StructArray.from_arrays([pa.array([-n for n in best_n], pa.int64()), pa.array(best, pa.string())], ["less", "word"])
    return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(near, pa.int64()), pairs], ["word", "n_near", "best"])


def _cut(rows: DataFrame) -> DataFrame:
    """Every row twice, in the state of the first half of what its state leaves open, and in that of the rest."""
    middle = F.col("size") - F.length("before") - F.length("after")
    half, length = F.floor(middle / 2).cast("int"), F.length("rest")
    tail = middle - half
    begins = F.struct(
        F.col("limit"), F.concat("before", F.substr("rest", F.lit(1), half)).alias("before"), F.col("after"),
        F.substr("rest", half + 1, length).alias("rest"),
    )
    ends = F.struct(
        F.least("limit", F.length("before") + half).alias("limit"), F.col("before"),
        F.concat(F.substr("rest", length - tail + 1, tail), "after").alias("after"), F.substr("rest", F.lit(1), length - tail).alias("rest"),
    )
    return rows.select("size", "n", F.explode(F.array(begins, ends)).alias("cut")).select("size", "cut.*", "n").select(*_STATE, "rest", "n")


def near_words(vocabulary: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """word, n_near and best (struct of less, the best near word's count below zero, and word) of words with near ones.

    ``vocabulary`` has distinct words and their n. The best near word has the largest n, then the smallest word.
    """
    length = F.length("word")
    whole = vocabulary.select(
        F.explode(F.array(length, length - 1)).alias("size"), F.lit("").alias("before"), F.lit("").alias("after"), F.col("word").alias("rest"), "n"
    ).where("size > 0")
    rows, done = stored(_cut(whole.select("size", (F.col("size") + 1).alias("limit"), "before", "after", "rest", "n")), "states"), []
    while True:
        open_ = F.col("size") - F.length("before") - F.length("after") > 2
        large = rows.where(open_).groupBy(*_STATE).agg(F.count("*").alias("words")).where(F.col("words") > heavy).drop("words")
        large = stored(large, "heavy")  # far fewer rows than states
        if large.isEmpty():
            break
        done.append(rows.join(large, _STATE, "left_anti"))
        rows = stored(_cut(rows.join(large, _STATE, "left_semi")), "states")
    for part in done:
        rows = rows.unionByName(part)
    dealt = rows.repartition(*_STATE).sortWithinPartitions(*_STATE)
    found = dealt.select(*_STATE, "rest", "n").mapInArrow(_walked, _FOUND)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def vocabulary(occurrences: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word and n of the words, one row of ``occurrences`` each, that are long and frequent enough."""
    long = occurrences.where(F.length("word") >= least_length)
    return long.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def spelling_variants(words: DataFrame, ratio: int = 5, heavy: int = HEAVY) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of a vocabulary (word and n).

    A word's form is its near word of largest n, ties to the smallest, if that n is ``ratio`` times its
    own or more; its root is the end of the chain of forms, the word itself where there is none.
    """
    if ratio < 2:
        raise ValueError(f"chains of forms end only where counts grow: ratio {ratio}")
    known = stored(words, "vocabulary")
    near = near_words(known, heavy)
    best = -F.col("best.less")
    has = best >= ratio * F.col("n")
    forms = known.join(near, "word", "left").select(
        "word", F.when(has, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(has, best).alias("form_n")
    )
    forms = stored(forms, "forms")
    roots = forms.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # the part of a chain that is known doubles; a chain is as long as counts can grow
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        stepped = stored(stepped, "roots")
        roots = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            break
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
