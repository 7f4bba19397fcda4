"""Personal data in texts, also where it is disguised, with offsets into the source.

Plain identifiers are found in the source itself (``base_spans``). Then a chain of
transducers rewrites the text and keeps for every piece where it came from: look-alike
characters become ASCII and invisible ones vanish, spelled digits and numbers become digits, and
``(at)``, `` at ``, ``(dot)``, `` dot ``, ``plus`` and the like become signs. Identifiers found in
the rewritten text are mapped back to the characters they came from. Such a span is
added if it uses a rewritten piece and reaches beyond the spans of its kind that it meets;
those that are plain stay beside it.

Spans are (kind, start, end) in code points, the end exclusive, ordered by start, then
by the order of ``KINDS``. Defined results: NULL and empty texts have no span; repeated
rows and NULL ids are read one by one. Each matcher reads a text in linear time, so long
runs of digits or letters do no harm.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsift.llm.shingles import give_back

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# -- plain identifiers -------------------------------------------------------------

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_END = re.compile(r"[^A-Za-z0-9._%+-]")
# A match can only begin where a run of digits does: it takes runs whole.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and not _LOCAL_END.match(text, start - 1, start):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        twice = int(d) * (1 + k % 2)
        total += twice - 9 * (twice > 9)
    return total % 10 == 0


def _is_ip(match: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in match.split("."))


def _is_card(match: str) -> bool:
    digits = _NOT_DIGIT.sub("", match)
    return 14 <= len(digits) <= 19 and _luhn(digits)


def _is_phone(match: str) -> bool:
    return 10 <= len(_NOT_DIGIT.sub("", match)) <= 15


_NUMBERS: tuple[tuple[str, re.Pattern, Callable[[str], bool]], ...] = (
    ("ip", _IP, _is_ip), ("card", _CARD, _is_card), ("phone", _PHONE, _is_phone),
)


def _ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def base_spans(text: str) -> list[Span]:
    """Identifiers written plainly: leftmost matches of each kind that do not overlap, without those that fail its test."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    there = {"ip": _DOTTED.search(text), "card": True, "phone": "+" in text}
    for kind, pattern, holds in _NUMBERS:
        if there[kind]:
            found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if holds(m[0])]
    return _ordered(found)


# -- disguises ---------------------------------------------------------------------

# Cyrillic and Greek letters that look like Latin ones.
_ALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТУХІЈЅαοενικρτυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTYXIJSaoevikptuABEZHIKMNOPTYX", strict=True))
# Letters of other scripts and of phonetic alphabets that look like Latin ones.
_ALIKE |= dict(zip("кмтгвпзԍӏүɑɡıɩοᴏⅼօսցհոքᎪᏴᏟᎬᎻᎫᏦᏞᎷᏢᏚᎢᏙᎳᏃ", "kmtrbn3gly" "agiiool" "oughnq" "ABCEHJKLMPSTVWZ", strict=True))
# Signs in other shapes that have no ASCII form of their own.
_ALIKE |= {"。": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "\xa0": " "}
#: Kinds of compatibility forms that are their character in another shape; raised, lowered and joined ones are not.
_SHAPES = {"<font>", "<wide>", "<narrow>", "<circle>", "<square>", "<small>", "<compat>"}
_PLAIN = re.compile(r"[A-Za-z0-9@.+-]")


def _known_shape(char: str) -> str | None:
    """What a character is another shape of: an ASCII letter, digit or sign, or nothing if it can't be seen."""
    if unicodedata.category(char) == "Cf" or "\ufe00" <= char <= "\ufe0f" or char == "\u034f":
        return ""
    digit = unicodedata.decimal(char, None)
    if digit is not None:
        return str(digit)
    form = unicodedata.decomposition(char).split(" ", 1)
    if form[0] in _SHAPES:
        plain = unicodedata.normalize("NFKC", char)
        return plain if _PLAIN.fullmatch(plain) else None
    return None


for _char in map(chr, range(0x80, 0x20000)):
    if _char not in _ALIKE and (_shape := _known_shape(_char)) is not None:
        _ALIKE[_char] = _shape

# Digits as words in English, German, French and Spanish.
_WORDS = {
    "zero": 0, "oh": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "null": 0, "eins": 1, "zwei": 2, "drei": 3, "vier": 4, "fünf": 5, "sechs": 6, "sieben": 7, "acht": 8, "neun": 9,
    "zéro": 0, "un": 1, "deux": 2, "trois": 3, "quatre": 4, "cinq": 5, "sept": 7, "huit": 8, "neuf": 9,
    "cero": 0, "uno": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9,
}

# Numbers below a hundred as words, and words that repeat the digit after them.
_TEENS = {"ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
_TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
_TIMES = {"double": 2, "triple": 3, "treble": 3, "doppel": 2, "doble": 2}

_ALIKE_RUN = re.compile("[" + re.escape("".join(_ALIKE)) + "]")


def _any_of(words: Iterable[str]) -> str:
    return "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"


_NUMBER = rf"(?:(?:{_any_of(_TIMES)}[ -])?{_any_of(_WORDS)}|{_any_of(_TEENS)}|{_any_of(_TENS)})(?!\w)"
#: Words for digits that follow each other are one number.
_SPELLED = re.compile(rf"(?i)(?<!\w){_NUMBER}(?:[ -]{_NUMBER})*")
_DIGIT_WORDS = frozenset({*_WORDS, *_TEENS, *_TENS})
_RUN = re.compile(r"\w+")
_FOLDED = str.maketrans("ſİı", "sii")
# At and dot as words in several languages. The first of each are also read between blanks.
_AT_SAID, _AT_WORDS = ("at", "arroba", "arobase", "chiocciola", "klammeraffe", "aet"), ("ät", "a", "@")
_DOT_SAID, _DOT_WORDS = ("dot", "punkt", "punto", "point", "ponto", "punt"), (r"\.",)


def _bracketed(words: Iterable[str]) -> str:
    return rf"[ ]?[\[({{<][ ]?{_any_of(words)}[ ]?[\])}}>][ ]?"


#: What parts the labels of a domain after "at", a common word, and after the other signs.
_STRICT = rf"(?:{_bracketed((*_DOT_SAID, *_DOT_WORDS))}|[ ]dot[ ]|\.)"
_LOOSE = rf"(?:{_bracketed((*_DOT_SAID, *_DOT_WORDS))}|[ ]{_any_of(_DOT_SAID)}[ ]|[ ]\.[ ]|\.)"
_THEN = r"(?=[a-z0-9-]++{}[a-z]{{2}})"
#: What stands for the sign of an address; before a label and a dot unless its brackets leave no doubt.
_AT = re.compile(
    rf"(?i){_bracketed(('at',))}|(?<=[a-z0-9])(?:[ ]at[ ]{_THEN.format(_STRICT)}"
    rf"|(?:{_bracketed((*_AT_SAID, *_AT_WORDS))}|[ ]{_any_of(_AT_SAID[1:])}[ ]|[ ]@[ ]?|@[ ]){_THEN.format(_LOOSE)})"
)
_LABEL = re.compile(r"(?i)[a-z0-9-]++")
_NEXT_STRICT, _NEXT_LOOSE = (re.compile(rf"(?i){stop}(?=[a-z0-9-])") for stop in (_STRICT, _LOOSE))
_DOT = re.compile(rf"(?i){_bracketed((*_DOT_SAID, *_DOT_WORDS))}|(?<=[a-z0-9])[ ]dot[ ](?=[a-z0-9])")
_PLUS = re.compile(r"(?i)(?<!\w)plus[ ](?=[0-9])")
_BRACKETED = re.compile(r"(?i)[\[({<][ ]?" + _any_of((*_AT_SAID, *_AT_WORDS, *_DOT_SAID, *_DOT_WORDS)) + r"[ ]?[\])}>]")
_SAID = re.compile(rf"(?i)[ ]{_any_of(_AT_SAID)}[ ]|[ ]@|@[ ]")
#: An edit of a text: where it starts and ends, and what stands there instead.
Edit = tuple[int, int, str]


def _addresses(text: str) -> Iterator[Edit]:
    """The signs of addresses, and the dots of the domain after each."""
    done = 0
    while sign := _AT.search(text, done):
        yield sign.start(), sign.end(), "@"
        done = sign.end()
        stops = _NEXT_STRICT if sign[0].lower() == " at " else _NEXT_LOOSE
        while (label := _LABEL.match(text, done)) and (stop := stops.match(text, label.end())):
            if stop[0] != ".":
                yield stop.start(), stop.end(), "."
            done = stop.end()


#: Of each piece of a rewritten text: its start there, its start and end in the source, and whether it was rewritten.
Piece = tuple[int, int, int, bool]


class Rewritten:
    """A text after some transducers, with the source of its pieces."""

    def __init__(self, text: str, pieces: list[Piece] | None = None) -> None:
        self.text = text
        self.pieces = pieces if pieces is not None else [(0, 0, len(text), False)]
        self._starts = [p[0] for p in self.pieces]

    def _slice(self, a: int, b: int) -> list[tuple[int, int, int, bool]]:
        """(length, source start, source end, rewritten) of the pieces in a .. b."""
        out = []
        k = bisect_right(self._starts, a) - 1
        while k < len(self.pieces) and self.pieces[k][0] < b:
            start, s, e, new = self.pieces[k]
            end = self.pieces[k + 1][0] if k + 1 < len(self.pieces) else len(self.text)
            lo, hi = max(a, start), min(b, end)
            if new:
                out.append((hi - lo, s, e, True))
            elif hi > lo:
                out.append((hi - lo, s + lo - start, s + hi - start, False))
            k += 1
        return out

    def source(self, a: int, b: int) -> tuple[int, int, bool]:
        """Where a .. b came from, and whether any of it was rewritten."""
        own = [p for p in self._slice(a, b) if p[0]] or self._slice(a, b)
        return own[0][1], own[-1][2], any(p[3] for p in self._slice(a, b))

    def rewrite(self, pattern: re.Pattern, becomes: Callable[[re.Match], str]) -> Rewritten:
        """Every match of the pattern replaced."""
        return self.edited((m.start(), m.end(), becomes(m)) for m in pattern.finditer(self.text))

    def edited(self, edits: Iterable[Edit]) -> Rewritten:
        """Every edit made; they come in order and do not overlap."""
        out, pieces, done, at = [], [], 0, 0

        def keep(a: int, b: int) -> None:
            nonlocal at
            for n, s, e, new in self._slice(a, b):
                pieces.append((at, s, e, new))
                at += n
            out.append(self.text[a:b])

        for start, end, new in edits:
            keep(done, start)
            s, e, _ = self.source(start, end)
            pieces.append((at, s, e, True))
            out.append(new)
            at += len(new)
            done = end
        if not pieces:
            return self
        keep(done, len(self.text))
        return Rewritten("".join(out), pieces)


_LATIN_SIGNS = tuple(c for c in map(chr, range(0x80, 0x100)) if c in _ALIKE)


def _may_look_alike(text: str) -> bool:
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _ALIKE_RUN.search(text) is not None
    return any(sign in text for sign in _LATIN_SIGNS)


def _lower(text: str) -> str:
    """In small letters, with those that ``(?i)`` takes for ASCII ones."""
    return (text if text.isascii() else text.translate(_FOLDED)).lower()


def _may_be_spelled(lower: str) -> bool:
    """Whether a digit stands there as a word, between any characters that are not of words."""
    return not _DIGIT_WORDS.isdisjoint(_RUN.findall(lower))


def _digits_of(match: re.Match) -> str:
    """The digits of words for them: tens take the digit after them in, and some words repeat it."""
    out: list[str] = []
    times, tens = 1, False
    for word in re.split("[ -]", _lower(match[0])):
        if word in _WORDS:
            digit = str(_WORDS[word])
            if tens and digit != "0":
                out[-1] = out[-1][0] + digit
            else:
                out.append(digit * times)
            times, tens = 1, False
        elif word in _TIMES:
            times, tens = _TIMES[word], False
        else:
            out.append(str(_TEENS.get(word) or _TENS[word]))
            times, tens = 1, word in _TENS
    return "".join(out)


def rewritten(text: str) -> Rewritten:
    """The text without disguises."""
    plain = Rewritten(text)
    if _may_look_alike(text):
        plain = plain.rewrite(_ALIKE_RUN, lambda m: _ALIKE.get(m[0], ""))
    lower = _lower(plain.text)
    if _may_be_spelled(lower):
        plain = plain.rewrite(_SPELLED, _digits_of)
    bracketed = any(b in lower for b in "[({<") and _BRACKETED.search(lower) is not None
    if bracketed or _SAID.search(lower):
        plain = plain.edited(_addresses(plain.text))
    if bracketed or " dot " in lower:
        plain = plain.rewrite(_DOT, lambda m: ".")
    return plain.rewrite(_PLUS, lambda m: "+") if "plus " in lower else plain


def _union(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the spans cover, in order and apart."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """The base spans, and with them those found behind disguises."""
    base = base_spans(text)
    plain = rewritten(text)
    if plain.text is text:
        return base, base
    taken = {kind: _union((a, b) for k, a, b in base if k == kind) for kind in KINDS}
    more: list[Span] = []
    reached = dict.fromkeys(KINDS, 0)  # the end of those added
    for kind, a, b in base_spans(plain.text):
        start, end, new = plain.source(a, b)
        own = taken[kind]
        k = bisect_right(own, start, key=lambda s: s[0])
        inside = k > 0 and own[k - 1][1] >= end
        if new and not inside and end > reached[kind]:
            more.append((kind, start, end))
            reached[kind] = end
    return base, _ordered(base + more)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, how many plain spans there are of each kind, the hash of the plain spans, all spans, and how many were disguised."""
    names = [f"n_{kind}" for kind in KINDS]
    schema = f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_sha256 string, spans string, n_disguised long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(text or "") for text in batch.column(1).to_pylist()]
            columns = [batch.column(0)]
            columns += [pa.array([sum(s[0] == kind for s in base) for base, _ in found], pa.int64()) for kind in KINDS]
            columns.append(pa.array([hashlib.sha256(_joined(base).encode()).hexdigest() for base, _ in found], pa.string()))
            columns.append(pa.array([_joined(spans) for _, spans in found], pa.string()))
            columns.append(pa.array([len(spans) - len(base) for base, spans in found], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *names, "base_sha256", "spans", "n_disguised"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(read, schema)


def redact(text: str | None) -> str | None:
    """The text with every span replaced by its kind in angle brackets; spans that overlap are one, named by the first."""
    spans = all_spans(text)[1] if text else []
    if not spans:
        return text
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def redacted(text: str = "text") -> Column:
    """A column of texts without personal data; NULL stays NULL."""

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        give_back()
        return pd.Series([redact(t) for t in texts], dtype=object)

    return clean(F.col(text))
