"""Token ids by the ``tokenizers`` library, encoding each distinct word once.

A byte-level BPE vocabulary never merges over the start of a run of white space: its
pre-tokenizer starts a new piece there. So a text is cut before every such run, the
distinct cuts are encoded by the library, and a text's ids are the ids of its cuts.
Where words are parted by single spaces or line ends, a cut at each space is one of
those; other texts are cut by a pattern. Texts with white space beyond ASCII, and those
that hold the name of an added token (which has an id of its own), go to the library whole. A word of letters is one piece to the pre-tokenizer, so it goes to
the library's model at once, as do the signs of ASCII that may follow it, which are the next piece.
"""

from __future__ import annotations

import os
import re
import string
from array import array

#: Words one Python worker remembers, twice: those met lately, and those met before them.
REMEMBERED = 300_000
#: Longer words are encoded each time and not remembered.
LONGEST = 48
#: Signs after a word of letters that are a piece of their own, at most, and how many such ends are remembered.
TAIL, TAILS = 6, 10_000

_CUTS = re.compile(r"[ \t\n\r\x0b\x0c]*[^ \t\n\r\x0b\x0c]+|[ \t\n\r\x0b\x0c]+")
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0 ᠎ -​    ⁠　﻿]")
_SPACES = " \n\t\r\x0b\x0c"

#: The sign that byte-level vocabularies have for each byte: itself if it is printable, else the next one from U+0100 on.
_PRINTABLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_HIDDEN = [b for b in range(256) if b not in _PRINTABLE]
_BYTE_SIGNS = {b: chr(b) if b in _PRINTABLE else chr(256 + _HIDDEN.index(b)) for b in range(256)}

_ENCODERS: dict[str, Encoder] = {}


def default_vocabulary() -> str:
    """The path of the public byte-level vocabulary of 50 257 ids."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _two_spaces(text: str) -> bool:
    """Whether two signs of white space follow each other."""
    own = [c for c in _SPACES if c in text]
    return any(a + b in text for a in own for b in own)


def encoder(path: str) -> Encoder:
    """The encoder of this worker for the vocabulary file at ``path``."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_size(path: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size(with_added_tokens=True)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread for each task
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        self._added = [t.content for t in self._library.get_added_tokens_decoder().values()]
        # the short way for words of letters holds where it gives what the library does
        sample = ["Word", "naïve", "of.", "straße,", "слово", "end###", "so,$$$", "it.'", "\nLine", "\née.", "\nup!!"]
        self._tails: dict[str, bytes] = {}
        self._late: dict[str, bytes] = {}  # a word's ids after a space
        self._before: dict[str, bytes] = {}
        self._by_word = True
        self._by_word = self._spaced(sample) == self._ids([w if w[0] == "\n" else f" {w}" for w in sample])

    def _ids(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        found = self._library.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _word(self, before: str, letters: str) -> bytes:
        """The ids of letters, after a space or nothing, which the pre-tokenizer leaves in one piece."""
        piece = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTE_SIGNS)
        return array("I", [t.id for t in self._model.tokenize(before + piece)]).tobytes()

    def _spaced(self, words: list[str]) -> list[bytes]:
        """The ids of each word after a space, or, if it begins with a line end, after that."""
        found, odd = [], []
        bare: dict[str, bytes] = {}  # letters met here with an end and without, or with several
        late, before, by_word = self._late, self._before, self._by_word
        for k, w in enumerate(words):
            if by_word and w.isalpha():
                found.append(bare.get(w) or bare.setdefault(w, self._word("\u0120", w)))
                continue
            letters = w.rstrip(string.punctuation)
            tail = w[len(letters) :]
            if by_word and letters.isalpha() and len(tail) <= TAIL:
                ids = bare.get(letters) or late.get(letters) or before.get(letters) or bare.setdefault(letters, self._word("\u0120", letters))
                found.append(ids + self._tail(tail))
            elif by_word and w[0] == "\n" and letters[1:].isalpha() and len(tail) <= TAIL:
                found.append(self._tail("\n") + self._word("", letters[1:]) + (self._tail(tail) if tail else b""))
            else:
                odd.append(k)
                found.append(b"")
        for k, ids in zip(odd, self._ids([words[k] if words[k][0] == "\n" else f" {words[k]}" for k in odd]), strict=True):
            found[k] = ids
        return found

    def _tail(self, signs: str) -> bytes:
        if signs not in self._tails:
            if len(self._tails) >= TAILS:
                self._tails.clear()
            self._tails[signs] = self._ids([signs])[0]
        return self._tails[signs]

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of each word after a space; all but the longest words are remembered."""
        late, before = self._late, self._before
        if len(late) > REMEMBERED:
            self._before, self._late = before, late = late, {}
        found = list(map(late.get, words))
        missed = [k for k, ids in enumerate(found) if ids is None]
        new = []
        for k, ids in zip(missed, map(before.get, [words[k] for k in missed]), strict=True):
            if ids is None:
                new.append(k)
            else:
                late[words[k]] = found[k] = ids
        for k, ids in zip(new, self._spaced([words[k] for k in new]), strict=True):
            found[k] = ids
            if len(words[k]) <= LONGEST:
                late[words[k]] = ids
        return found

    def _after_heads(self, rests: list[str]) -> list[memoryview]:
        """The ids of each text of words parted by single spaces, the first word after a space too."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        split = pc.split_pattern(pa.array(rests, pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        found, word = self._learn(coded.dictionary.to_pylist()), coded.indices.to_numpy()
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begin, times = np.cumsum(sizes) - sizes, sizes[word]
        ends = np.concatenate([[0], np.cumsum(times)])
        at = np.repeat(begin[word] - ends[:-1], times) + np.arange(ends[-1])
        ids = memoryview(np.frombuffer(b"".join(found), "<u4")[at].tobytes())
        edges = (4 * ends[split.offsets.to_numpy()]).tolist()
        return [ids[x:y] for x, y in zip(edges, edges[1:], strict=False)]

    def after_space(self, words: list[str]) -> list[bytes]:
        """The ids of each word after a space, not remembered; words hold no white space of ASCII."""
        return self._spaced(words)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; none for NULL."""
        out, whole, cut, plain, rests = [b""] * len(texts), [], [], [], []
        for k, text in enumerate(texts):
            if not text:
                continue
            if not text.isascii() and _OTHER_SPACE.search(text) or any(c in text for c in ("\x1c", "\x1d", "\x1e", "\x1f", *self._added)):
                whole.append(k)
            elif text[0] == " " or text[-1] == " " or _two_spaces(text):
                cut.append((k, _CUTS.findall(text)))
            else:
                head, space, rest = text.replace("\n", " \n").partition(" ")
                if space:
                    plain.append((k, head))
                    rests.append(rest)
                else:
                    cut.append((k, [head]))
        apart = list({*(head for _, head in plain), *(p for _, parts in cut for p in parts)})
        first = dict(zip(apart, self._ids(apart), strict=True))
        for k, parts in cut:
            out[k] = b"".join(map(first.__getitem__, parts))
        for (k, head), rest in zip(plain, self._after_heads(rests), strict=True):
            out[k] = first[head] + rest
        for k, ids in zip(whole, self._ids([texts[k] for k in whole]), strict=True):
            out[k] = ids
        return out
