"""Token ids, token files and packing against the library itself."""

import random
import zlib

import messy
import numpy as np
import pytest
from tokenizers import Tokenizer

from cohortsift.llm import tokens
from cohortsift.llm.packing import exact_fill, packed, pieces, plan
from cohortsift.llm.token_files import TokenFiles, write_token_files
from cohortsift.llm.tokens import Encoder, default_vocabulary


@pytest.fixture(scope="module")
def encoder():
    return Encoder(default_vocabulary())


_FRESH = Tokenizer.from_file(default_vocabulary())


def ids(encoder, text):
    """What the library gives as it is loaded, apart from the encoder's own."""
    return _FRESH.encode(text or "", add_special_tokens=False).ids


def test_cut_texts_get_the_librarys_ids(encoder):
    draw = random.Random(3)
    signs = ["a", "foo", " ", " ", "\n", "\t", "'s", "  ", "é", "　", "12", ".", "\x1c", "\xa0", "<|endoftext|>", "日本", ",", "x" * 60]
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 16))) for _ in range(3000)]
    texts += ["The cat sat.\nThe dog, too, sat.\nÉté naïve.", None, "", "y" * 50_000, messy.LONG, "a <|endoftext|> b", "<|endoftext|>"]
    wanted = [np.array(ids(encoder, t), "<u4").tobytes() for t in texts]
    for _ in range(2):  # from the library, then from memory
        assert encoder.encode(texts) == wanted
    assert wanted[-1] == np.array([50256], "<u4").tobytes() and encoder.encode(["a <|endoftext|> b"])[0] == np.array([64, 220, 50256, 275], "<u4").tobytes()


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


def test_token_files_hold_all_documents(spark, encoder, tmp_path):
    files = write_token_files(messy.documents(spark), f"{tmp_path}/out")
    found = sorted(map(tuple, files.documents().collect()), key=lambda r: r[1])
    texts = {}
    for i, text, *_ in messy.ROWS:
        texts.setdefault(i, []).append([*ids(encoder, text), 2])
    assert [r[0] for r in found] == sorted((r[0] for r in messy.ROWS), key=lambda i: (i is not None, i))
    assert [r[1] for r in found] == [0, *np.cumsum([r[2] for r in found])[:-1]]
    for i, own in texts.items():
        assert sorted((r[2], r[3]) for r in found if r[0] == i) == sorted((len(x), crc(x)) for x in own)
    again = TokenFiles.open(spark, f"{tmp_path}/out").documents()
    assert sorted(map(tuple, again.collect()), key=lambda r: r[1]) == found
    assert write_token_files(messy.documents(spark, [])).documents().collect() == []


def test_large_ids_take_four_bytes(spark, encoder, tmp_path):
    files = write_token_files(messy.documents(spark), f"{tmp_path}/wide", end_id=70_000)
    one = next(r for r in files.documents().collect() if r["doc_id"] == 12)
    assert one["ids_crc32"] == crc([*ids(encoder, "word"), 70_000])
    assert files.shards.first()["id_bytes"] == 4


def test_packing_places_every_piece(spark, encoder):
    size = 64
    rows = packed(messy.documents(spark), size, 0, with_ids=True).collect()
    by_doc = {}
    for r in rows:
        assert crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"] <= 4 * size
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i in (5, 6, 12, 9):
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        text = next(t for d, t, *_ in messy.ROWS if d == i)
        assert np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist() == [*ids(encoder, text), 0]
        assert [r["length"] for r in own[1:]] == [size] * (len(own) - 1)
    assert len(by_doc[2]) == 2 * len(by_doc[1]) and len(by_doc[None]) > 1
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= size
    total = sum(r["length"] for r in rows)
    assert len(bins) <= -(-total // size) + 1
    assert pieces(messy.documents(spark, []), size).count() == 0 and packed(messy.documents(spark, []), size).count() == 0


def first_fit(counts, size):
    """How many sequences plain first fit takes, longest first."""
    gaps = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            k = next((k for k, gap in enumerate(gaps) if gap >= n), None)
            if k is None:
                gaps.append(size - n)
            else:
                gaps[k] -= n
    return len(gaps)


def test_plan_fills_exactly_where_it_can():
    draw = random.Random(5)
    for _ in range(60):
        size = draw.choice([7, 16, 50])
        counts = {n: draw.randint(0, 9) for n in range(1, size + 1)}
        kinds = plan(dict(counts), size)
        used = {}
        for kind, times in kinds:
            assert sum(kind) <= size and times > 0
            for n in kind:
                used[n] = used.get(n, 0) + times
        assert used == {n: c for n, c in counts.items() if c}
        assert sum(t for _, t in kinds) <= first_fit(counts, size)
    assert plan({5: 4, 3: 4}, 8) == [((5, 3), 4)]
    assert plan({4: 3, 2: 3, 1: 6}, 8)[0][0] == (4, 4)


def test_exact_fill_respects_how_many_there_are():
    left = np.zeros(11, dtype=np.int64)
    left[5] = 1
    assert exact_fill(left, 10) is None
    left[5] = 2
    assert exact_fill(left, 10) == (5, 5)
    left[:] = 0
    left[3], left[4] = 2, 1
    assert exact_fill(left, 10) == (4, 3, 3)
    left[3] = 1
    assert exact_fill(left, 10) is None


def test_signs_after_a_word_need_no_call_of_the_library():
    path = default_vocabulary()
    own, library = Encoder(path), Tokenizer.from_file(path)
    texts = ["So wordyish### said,$$$ it.' and \"this\" naïveté!! (or not)", "one\nwordyish&&& two\nup!!\n", "a wordyish%%% wordyish", "a ''' 'tis x'll_ don't;"]
    want = [b"".join(k.to_bytes(4, "little") for k in library.encode(t, add_special_tokens=False).ids) for t in texts]
    asked = []
    ids = own._ids
    own._ids = lambda words: asked.extend(words) or ids(words)
    assert own.encode(texts) == want
    assert not any("wordyish" in w for w in asked)
    own.encode(["z " + " ".join(f"wordyish{'#' * (k % 40)}" for k in range(200))])  # long ends go to the library
    assert len(own._tails) < 40 and any("wordyish" in w for w in asked)


def test_texts_are_coded_alike_whatever_is_remembered(monkeypatch):
    path = default_vocabulary()
    library = Tokenizer.from_file(path)
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    own = Encoder(path)
    texts = [None, "", " ", "\n", "a", "a b", "\na b\n", "a\tb c", "a  b", " a b ", "é è\ncourir, là. ü", "x" * 100 + " " + "x" * 100, "1 2 3, 4.5", "a　b c"]
    want = [b"".join(k.to_bytes(4, "little") for k in library.encode(t or "", add_special_tokens=False).ids) for t in texts]
    for _ in range(4):
        assert own.encode(texts) == want
        assert [own.encode([t])[0] for t in texts] == want
