"""Repeated passages, near copies and mixing against brute force."""

import collections
import hashlib
import random

import duckdb
import messy
import numpy as np
import pytest
from oracle import connect, duck_rows, spark_rows

from cohortsift.llm import mixing
from cohortsift.llm import near_copies as near
from cohortsift.llm.graph import components
from cohortsift.llm.near_copies import estimate, near_copies, registers, without_near_copies
from cohortsift.llm.queries import ORACLES, QUERIES
from cohortsift.llm.repeats import repeated_words


def table(spark, texts):
    return messy.documents(spark, [(i, t, "en", "a") for i, t in texts])


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_are_those_of_brute_force(spark, seed):
    draw = random.Random(seed)
    passages = [" ".join(draw.choice("abcdefgh") + str(draw.randint(0, 9)) for _ in range(draw.randint(8, 40))) for _ in range(12)]
    texts = []
    for i in range(150):
        parts = []
        for _ in range(draw.randint(0, 5)):
            own = " ".join("w" + str(draw.randint(0, 10**6)) for _ in range(draw.randint(0, 20)))
            parts += [own, draw.choice(passages)] if draw.random() < 0.6 else [own]
        texts.append((i, " \n".join(parts)))
    texts += [(500 + k, texts[k][1]) for k in range(10)] + [(900, "x " * 300), (901, "x " * 20), (902, "x " * 12)]
    wanted = messy.without_repeats(texts, 13)
    found = repeated_words(table(spark, texts).repartition(7), 13).collect()
    assert len(found) == len(texts)
    for r in found:
        own, kept = wanted[r["doc_id"]]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(own), len(own) - len(kept), " ".join(kept)), r["doc_id"]
        assert r["kept_sha256"] == hashlib.sha256(r["kept"].encode()).hexdigest()
    assert sum(len(own) - len(kept) for own, kept in wanted.values()) > 500


def test_repeats_of_odd_rows(spark):
    rows = repeated_words(messy.documents(spark), 13).collect()
    removed = collections.defaultdict(list)
    for r in rows:
        removed[r["doc_id"]].append((r["n_words"], r["n_removed"]))
    n = len(messy.words(messy.TALE))
    assert removed[1] == [(n, 0)] and removed[2] == [(n, n)] * 2 and removed[3] == [(n, 0)] and removed[4] == [(n + 2, n)]
    assert sorted(removed[None]) == [(0, 0), (n, 0)] and removed[5] == removed[6] == removed[7] == [(0, 0)]
    assert removed[10] == [(24001, 24000)] and removed[9] == [(24000, 0)]
    assert repeated_words(messy.documents(spark, []), 13).collect() == []


@pytest.mark.parametrize(("words", "percent"), [(3, 85), (5, 80)])
def test_near_copies_are_those_of_brute_force(spark, words, percent):
    draw = random.Random(words)
    texts = []
    for family in range(12):
        base = [f"w{draw.randint(0, 400)}" for _ in range(draw.choice([3, 20, 120, 200]))]
        for _ in range(draw.choice([1, 5, 25])):
            own = list(base)
            for _ in range(draw.randint(0, 1 + len(base) // 60)):
                own[draw.randrange(len(own))] = f"v{draw.randint(0, 10**6)}"
            texts.append((len(texts), " ".join(own)))
    texts += [(1000 + k, texts[k][1].upper()) for k in range(0, len(texts), 9)] + [(2000, None), (2001, ""), (2002, "")]
    sets = {i: messy.shingles(t, words) for i, t in texts}
    wanted = messy.components(sets, percent)
    found = {r["doc_id"]: r for r in near_copies(table(spark, texts), words, percent).collect()}
    assert {i: found[i]["component_id"] for i in sets} == wanted
    assert all(found[i]["n_shingles"] == len(s) and found[i]["kept"] == (wanted[i] == i) for i, s in sets.items())
    assert 12 <= sum(r["kept"] for r in found.values()) < len(texts)


def test_members_of_a_hub_are_compared_with_each_other(spark):
    """A chain: each is like the next only, and the hub is like none of the far ones."""
    words = [f"w{k}" for k in range(400)]
    texts = [(k, " ".join(words[4 * k : 4 * k + 120])) for k in range(60)]
    wanted = messy.components({i: messy.shingles(t, 3) for i, t in texts}, 85)
    assert {r["doc_id"]: r["component_id"] for r in near_copies(table(spark, texts), 3, 85).collect()} == wanted


def hub_cases():
    draw = random.Random(4)
    frame = [f"t{k}" for k in range(150)]
    unlike = [" ".join(frame[:75] + [f"u{draw.randint(0, 10**7)}" for _ in range(50)] + frame[75:]) for _ in range(300)]
    pool = [" ".join(frame[:75] + [f"p{draw.randint(0, 300)}" for _ in range(40)] + frame[75:]) for _ in range(150)]
    edge = []  # about as alike as the bound asks for, some just below
    for k in range(150):
        own = list(frame)
        for at in draw.sample(range(150), draw.randint(1, 4)):
            own[at] = f"e{draw.randint(0, 40)}"
        edge.append(" ".join(own))
    return {"unlike": unlike, "pool": pool, "edge": edge, "all": unlike[:80] + pool[:80] + edge[:80]}


@pytest.mark.parametrize("case", ["unlike", "pool", "edge", "all"])
@pytest.mark.parametrize("light", [near.LIGHT, 3])
def test_texts_of_one_template_lose_no_link(spark, monkeypatch, case, light):
    """With pairs and with blocks, links between members of a hub are those of brute force."""
    monkeypatch.setattr(near, "LIGHT", light)
    texts = list(enumerate(hub_cases()[case]))
    wanted = messy.components({i: messy.shingles(t, 3) for i, t in texts}, 85)
    assert {r["doc_id"]: r["component_id"] for r in near_copies(table(spark, texts), 3, 85).collect()} == wanted


def test_unlike_texts_of_one_template_are_not_paired(spark, monkeypatch):
    """Half of each of 3000 texts is a template: hubs have thousands of members, but next to no pair is compared."""
    kept = {}
    prefixes, pairs = near._prefixes, near._rare_pairs
    monkeypatch.setattr(near, "_prefixes", lambda *a: kept.setdefault("prefixes", prefixes(*a)))
    monkeypatch.setattr(near, "_rare_pairs", lambda *a: kept.setdefault("pairs", pairs(*a)))
    draw = random.Random(9)
    frame = [f"t{k}" for k in range(60)]
    texts = [(k, " ".join(frame + [f"u{draw.randint(0, 2000)}" for _ in range(30)])) for k in range(3000)]
    rows = near_copies(table(spark, texts), 3, 85).collect()
    assert all(r["kept"] for r in rows) and len(rows) == 3000
    assert kept["pairs"].count() < 3000 and kept["prefixes"].where("times > 64").count() == 0


def test_near_copies_of_odd_rows(spark):
    docs = messy.documents(spark)
    rows = collections.defaultdict(list)
    for r in near_copies(docs, 3, 85).collect():
        rows[r["doc_id"]].append((r["component_id"], r["kept"]))
    assert rows[1] == [(1, True)] and rows[2] == [(1, False)] * 2 and rows[3] == [(1, False)] and rows[4] == [(1, False)]
    assert rows[None] == [(None, True)] * 2 and rows[5] == [(5, True)] and rows[6] == [(6, True)] and rows[7] == [(7, True)]
    assert rows[10] == [(9, False)]
    left = without_near_copies(docs, 3, 85)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in left.collect()) == [0, 0, 1, 5, 6, 7, 8, 9, 11, 12, 13]
    again = without_near_copies(messy.documents(spark, [(1, "a b c", "en", "a")] * 3 + [(None, "a b c", "en", "a")] * 2))
    assert sorted((r["doc_id"] or 0) for r in again.collect()) == [0, 0, 1]
    assert near_copies(messy.documents(spark, [])).collect() == []


def test_estimate_follows_the_similarity():
    draw = np.random.default_rng(1)
    pool = np.unique(draw.integers(0, 1 << 63, 4000, dtype=np.uint64))
    for common in (200, 500, 900):
        a, b = pool[:1000], np.concatenate([pool[:common], pool[1000 : 2000 - common]])
        sketch = registers([a, b])
        guess = estimate(sketch[:1], sketch[1:], np.array([1000]), np.array([len(b)]))[0]
        assert abs(guess - common / (2000 - common)) < 0.13


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(100, 101), (102, 101), (7, 7)], "a bigint, b bigint")
    found = {r["node"]: r["label"] for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(61), 0), **dict.fromkeys((100, 101, 102), 100)}
    assert components(links.where("false")).collect() == []


@pytest.mark.parametrize("name", ["op3_mixed_sources", "op7_repeated_passages", "op8_near_copies"])
def test_queries_are_their_sql(spark, name):
    small = "/root/testdata/sf0.01"
    assert spark_rows(QUERIES[name](spark, small)) == duck_rows(connect(small), ORACLES[name])


def off_target(rows, share):
    """By how many blocks any source is off its weight at most, after any slot; checks that blocks come in order."""
    served, most = dict.fromkeys(share, 0), 0
    for slot, (at, source, block) in enumerate(sorted((r["slot"], r["source"], r["block"]) for r in rows)):
        assert (at, block) == (slot, served[source])
        served[source] += 1
        most = max(most, *(abs(served[s] - (slot + 1) * w) for s, w in share.items()))
    return most


def shares(sizes, weights=None):
    weight = {s: (weights or {}).get(s, n**0.8) for s, n in sizes.items()}
    return {s: w / sum(weight.values()) for s, w in weight.items()}


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 2.0, "c": 3.0, None: 4.0}])
def test_no_source_is_a_block_off(spark, weights):
    sizes = {"a": 300, "b": 100, "c": 40, None: 9}
    docs = messy.documents(spark, [(k, f"t{k}", "en", s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))])
    mixed = mixing.mix(docs, weights, 0.8, 2, 32).select("row.doc_id", "row.source", "place.*")  # several frames
    rows = mixed.orderBy("position").collect()
    assert {r["doc_id"] for r in rows} == set(range(449)) and [r["position"] for r in rows] == list(range(len(rows)))
    assert all(r["slot"] == r["position"] // 2 for r in rows)
    assert off_target(rows[::2], shares(sizes, weights)) < 1
    for s in sizes:  # each round of a source's documents is whole before the next begins
        order = [(r["doc_id"], r["epoch"]) for r in rows if r["source"] == s]
        assert len({i for i, _ in order[: sizes[s]]}) == sizes[s] and [e for _, e in order] == [k // sizes[s] for k in range(len(order))]


def test_mix_of_odd_rows(spark):
    docs = messy.documents(spark)
    mixed = mixing.mix(docs, block=1, frame=20)
    assert mixed.columns == ["row", "place"]
    rows = mixed.where("place.epoch = 0").collect()
    assert len(rows) == len(messy.ROWS)
    every = [r["place"]["position"] for r in mixed.collect()]
    assert sorted(every) == list(range(len(every)))
    assert mixing.in_order(mixed).columns == docs.columns
    assert mixing.mix(messy.documents(spark, [])).collect() == []
    crowd = messy.documents(spark, [(k, "x", "en", f"s{k}") for k in range(40)])
    assert mixing.mix(crowd, block=1, frame=20).select("row.doc_id").distinct().count() == 40  # more sources than a frame has slots


@pytest.mark.parametrize("sizes", [
    {f"s{k}": 1 + k % 2 for k in range(599)} | {None: 2},
    {"hot": 3000, "warm": 300, "one": 1},
    {"a": 200_000, "b": 9000, "c": 1500, "d": 1200},
    {"hot": 3_000_000, "few": 40, "one": 1},
], ids=["600 sources", "one document beside a hot source", "four sources", "windows longer than frames"])
def test_every_source_keeps_its_own_weight(spark, sizes):
    """Over up to hundreds of frames, one block to a slot, as schedules of the sources alone."""
    given = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, n long")
    known = mixing.weighed(given, 0.8, {None: 40.0} if None in sizes else None)
    known = known.selectExpr("source", "v", "ceil(n / 8) blocks", "row_number() over (order by n desc, source) pool").collect()
    sources = spark.createDataFrame([(r["pool"], r["v"], r["blocks"]) for r in known], "pool long, v long, blocks long")
    names = {r["pool"]: r["source"] for r in known}
    rows = [{"slot": r["slot"], "source": names[r["pool"]], "block": r["block"]} for r in mixing.schedule(sources).collect()]
    assert off_target(rows, shares(sizes, {None: 40.0} if None in sizes else None)) < 1
    assert all(sum(r["source"] == s for r in rows) >= -(-n // 8) for s, n in sizes.items())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_random_weights_over_many_frames(spark, seed):
    draw = random.Random(seed)
    weight = [draw.choice([1, 1, 2, 7, 30]) * (1 + draw.random() * draw.choice([0, 1])) for _ in range(draw.randint(2, 9))]
    whole = [round(w / sum(weight) * 10**12) for w in weight]
    sources = spark.createDataFrame([(k, v, draw.randint(1, 90)) for k, v in enumerate(whole)], "pool long, v long, blocks long")
    rows = [{"slot": r["slot"], "source": r["pool"], "block": r["block"]} for r in mixing.schedule(sources, 100).collect()]
    assert len(rows) > 100 and off_target(rows, {k: v / sum(whole) for k, v in enumerate(whole)}) < 1.01


@pytest.mark.parametrize("sizes", [{"a": 600, "b": 60, None: 6}, {"a": 9000, "b": 2500, "c": 700, "d": 90}], ids=["one frame", "several"])
def test_mix_is_its_sql_on_unequal_sources(spark, tmp_path, sizes):
    own = [(None if k % 10 else k, f"t{k % 997}", "en", s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]  # nine ids in ten are NULL
    messy.documents(spark, own).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    found = spark_rows(QUERIES["op3_mixed_sources"](spark, str(tmp_path)))
    assert found == duck_rows(duck, ORACLES["op3_mixed_sources"]) and sum(found.values()) >= sum(sizes.values())


def test_weights_must_be_positive(spark):
    with pytest.raises(ValueError, match="not positive"):
        mixing.mix(messy.documents(spark), {"a": 0.0})
