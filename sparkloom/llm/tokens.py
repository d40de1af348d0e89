"""Whole texts to token ids with a given `tokenizers` file, many texts at a time.

The file's tokenizer lower-cases, splits into words by a pattern and gives each word its byte-level BPE ids, which depend on
the word alone. So texts are split into words by array operations over their code points, equal words of a step are found by
a 64-bit hash and compared letter by letter, and each new word goes to the library's BPE model once; a bounded memo, by the words themselves, holds what a Python
worker has seen. Texts with characters beyond Latin, or with the strings of special tokens, go to the library whole.
"""

from __future__ import annotations

import array
import re
import unicodedata
import zlib
from collections.abc import Sequence

import numpy as np
from tokenizers import Tokenizer

from sparkloom.llm.common import STEP_BYTES

END_ID = 1
#: Words in a Python worker's memo, and the letters of the longest one in it; when full it starts anew. They change speed only.
MEMO_WORDS, MEMO_LETTERS = 300_000, 40
#: Code points that are split here: all are their own composed form.
LATIN = 0x250
#: U+0130, whose lower case is two characters.
DOTTED_I = 0x130
BEYOND = re.compile("[^\u0000-\u024f]|\u0130")
SPACE, LETTER, NUMBER, OTHER = range(4)
_MULTIPLIER = 0x9E3779B97F4A7C15 | 1


def _byte_letters() -> dict[str, str]:
    """The printable letter that byte-level BPE uses for each byte, by the byte's Latin-1 character."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {chr(b): chr(b) if b in plain else chr(next(spare)) for b in range(256)}


def _kind(c: str) -> int:
    if c in "\t\n\v\f\r \x85\xa0":
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(c)[0], OTHER)


_KIND = np.array([_kind(chr(i)) for i in range(LATIN)], np.uint8)
_LOWER = np.array([ord(chr(i).lower()) if i != DOTTED_I else i for i in range(LATIN)], np.uint32)
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The multiplier's powers 0 to n - 1 and their inverses, modulo 2 ** 64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(n, STEP_BYTES + 1)
        both = []
        for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
            column = np.full(size, base, np.uint64)
            column[0] = 1
            both.append(np.cumprod(column, dtype=np.uint64))
        if size > 4 * STEP_BYTES:
            return both[0], both[1]
        _powers = both[0], both[1]
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit value with its bits stirred (in place)."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``values``: a polynomial modulo 2 ** 64 from prefix sums."""
    power, inverse = powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * power[: len(values)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * inverse[starts])


def distinct(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct span of ``values`` among the spans, and the number of each span's; spans of one hash are compared value by value."""
    hashes, number = np.unique(span_hashes(values, starts, ends), return_inverse=True)
    where = np.empty(len(hashes), np.int64)
    where[number] = np.arange(len(starts))
    first, sizes = where[number], ends - starts
    unlike = sizes != sizes[first]
    check = np.flatnonzero(~unlike & (sizes > 0) & (first != np.arange(len(starts))))
    if len(check):
        n = sizes[check]
        begins = np.cumsum(n) - n
        inner = np.arange(int(n.sum()))
        differ = values[np.repeat(starts[check] - begins, n) + inner] != values[np.repeat(starts[first[check]] - begins, n) + inner]
        if differ.any():
            unlike[check] = np.add.reduceat(differ, begins, dtype=np.int64) > 0
    if unlike.any():  # different spans of one hash: told apart one by one
        more: dict[bytes, int] = {}
        for k in np.flatnonzero(unlike).tolist():
            key = values[starts[k] : ends[k]].tobytes()
            if key not in more:
                more[key] = len(where)
                where = np.append(where, k)
            number[k] = more[key]
    return where, number


class Encoder:
    def __init__(self, path: str):
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [str(t.content) for t in self.whole.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.memo: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isprintable() else "".join(map(self.letters.__getitem__, word.encode().decode("latin-1")))
        return array.array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def encode(self, texts: Sequence[str | None]) -> list[np.ndarray]:
        """The ids (uint32) of each text, in order; a null text has none."""
        out: list[np.ndarray | None] = [None] * len(texts)
        step: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if not text:
                out[i] = np.zeros(0, np.uint32)
            elif not text.isascii() and BEYOND.search(text) or "<|" in text and any(s in text for s in self.special):
                out[i] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
            else:
                if step and size + len(text) > STEP_BYTES:
                    self._step(texts, step, out)
                    step, size = [], 0
                step.append(i)
                size += len(text)
        if step:
            self._step(texts, step, out)
        return out

    def _step(self, texts: Sequence[str | None], rows: list[int], out: list) -> None:
        points = np.frombuffer(" ".join([*(texts[i] for i in rows), ""]).encode("utf-32-le"), np.uint32)
        lower = _LOWER[points]
        ends_of_texts = np.cumsum([len(texts[i]) + 1 for i in rows])
        kind = np.append(_KIND[points], np.zeros(3, np.uint8))
        first = kind != SPACE
        first[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
        lower_padded = np.append(lower, np.zeros(3, np.uint32))
        # An apostrophe that starts a run takes the letters of a contraction with it: 's 't 'm 'd, 're 've 'll.
        quote = np.flatnonzero(first & (lower_padded == ord("'")))
        quote = quote[kind[quote + 1] == LETTER]
        if len(quote):
            one, two = lower_padded[quote + 1], lower_padded[quote + 2]
            short = quote[np.isin(one, [ord(c) for c in "stmd"])]
            long = quote[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))]
            first[short + 1] = first[long + 1] = False
            first[short + 2] = kind[short + 2] != SPACE
            first[long + 3] = kind[long + 3] != SPACE
        starts = np.flatnonzero(first)
        # A word ends where the next starts or at white space, whichever is first.
        spaces = np.flatnonzero(kind == SPACE)
        ends = np.minimum(np.append(starts[1:], len(kind)), spaces[np.searchsorted(spaces, starts)])
        where, inverse = distinct(lower, starts, ends)
        if len(self.memo) + len(where) > MEMO_WORDS:
            self.memo.clear()
        memo, ids, all_lower = self.memo, [], lower.tobytes().decode("utf-32-le")
        for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True):
            word = all_lower[a:b]
            found = memo.get(word)
            if found is None:
                found = self._word(word)
                if b - a <= MEMO_LETTERS:
                    memo[word] = found
            ids.append(found)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.frombuffer(b"".join(ids), np.uint32)
        counts = lengths[inverse]
        before = np.concatenate([[0], np.cumsum(counts)])
        source = np.repeat((np.cumsum(lengths) - lengths)[inverse] - before[:-1], counts)
        all_ids = flat[source + np.arange(before[-1])]
        cuts = before[np.searchsorted(starts, ends_of_texts)]
        for i, ids_of in zip(rows, np.split(all_ids, cuts[:-1]), strict=True):
            out[i] = ids_of


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def crc(ids: np.ndarray | bytes) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids if isinstance(ids, bytes) else ids.astype("<u4").tobytes()) & 0xFFFFFFFF
