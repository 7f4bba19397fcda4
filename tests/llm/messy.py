"""Documents with everything that may be wrong with a table, and brute-force forms of the operators."""

import re

CLASHING = ["piece", "start", "length", "tie", "n", "class", "keys", "score", "position", "epoch", "pool", "base", "n_rows", "rank", "label",
            "row", "place", "own", "key", "salt", "id", "apart", "repeat", "clean", "language", "order", "turns", "text_", "__key", "__salt", "__rank",
            "__mix", "__tie", "__gone", "__language", "__clean"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHING)

LONG = "Von den Dingen und der Welt. " * 4000
TALE = "the quick brown fox jumps over the lazy dog and then it runs far away from all of them at once"

ROWS = [
    (1, TALE, "en", "a"),
    (2, TALE, "en", "b"),
    (2, TALE, "en", "b"),
    (3, TALE.upper(), None, "a"),
    (4, TALE + " my friend", "en", None),
    (5, None, "en", "a"),
    (6, "", "de", "b"),
    (7, "   \n ", "de", "b"),
    (8, "12345 67", "en", "c"),
    (9, LONG, "de", "a"),
    (10, LONG + "Ende", "de", "a"),
    (None, TALE, "en", "a"),
    (None, None, None, None),
    (11, "mail ann@mail.example.com or call +49 171 1234567 now", "en", "a"),
    (12, "word", "en", "a"),
    (13, "Ein Satz mit wenigen Worten", "de", "d"),
]


def documents(spark, rows=ROWS):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * len(CLASHING)) for r in rows], SCHEMA)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text, n):
    own = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} or ({tuple(own)} if own else set())


def components(sets, percent):
    """The smallest reachable id of each id, by comparing all pairs."""
    label = {i: i for i in sets}
    ids = sorted(sets)
    links = [
        (a, b) for k, a in enumerate(ids) for b in ids[k + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            least = min(label[a], label[b])
            if label[a] != least or label[b] != least:
                label[a] = label[b] = least
                changed = True
    return label


def without_repeats(rows, window):
    """doc_id -> (words, kept words) after removing repeated windows; ids differ."""
    first, out = {}, {}
    for i, text in sorted(rows):
        own = words(text)
        gone = set()
        for p in range(len(own) - window + 1):
            seen = first.setdefault(tuple(own[p : p + window]), i)
            if seen < i:
                gone.update(range(p, p + window))
        out[i] = (own, [w for k, w in enumerate(own) if k not in gone])
    return out
