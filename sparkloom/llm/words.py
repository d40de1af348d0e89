"""Words of many texts at once, their hashes, word n-grams, MinHash signatures and band keys: array operations on UTF-8 bytes.

A word is a longest run of a-z, 0-9 and anything beyond ASCII after A-Z are lower-cased. A word has two independent 64-bit hashes, sums of random values
for each letter at each place. A span of words (``span_pairs``) has two as well: a polynomial of the words' first hashes, which prefix sums give for any span, and
a sum of their second ones stirred with their places, which isn't a polynomial. Equality of spans is equality of both; n-grams go by one 64-bit hash, as
they are compared within pairs only.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np

from sparkloom.llm.tokens import mixed, span_hashes

GRAM_WORDS = 5
_SPACE = 32


def _word_letters() -> np.ndarray:
    table = np.full(256, _SPACE, np.uint8)
    for b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
        table[b] = b
    table[0x41:0x5B] = range(0x61, 0x7B)
    return table


#: Each byte in lower case, or a space if it's no part of a word.
LETTERS = _word_letters()
_GRAM_BASE = np.uint64(0xD6E8FEB86659FD93)
_SHORT = np.uint64(0xA0761D6478BD642F)
PLACE = np.uint64(0x9FB21C651E98DF25)
#: Places of a word that have random values of their own; letters further in are told apart by a factor.
_PLACES = 32
_VALUES = np.random.default_rng(11).integers(0, 1 << 64, (2, _PLACES * 256), dtype=np.uint64)


class Words(NamedTuple):
    starts: np.ndarray  # byte offsets in the step's data
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # n + 1: number of the first word of each text
    checks: np.ndarray  # second hashes


def _spelled(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both hashes of each word; ``letters`` are those inside of words, one word after the other."""
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sizes = ends - starts
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(begins.astype(np.int32), sizes)
    far = np.flatnonzero(place >= _PLACES)
    beyond = mixed((place[far].astype(np.uint64)) * PLACE) | np.uint64(1) if len(far) else None
    index = np.minimum(place, _PLACES - 1) * np.int32(256) + letters
    out = []
    for table in _VALUES:
        value = table[index]
        if beyond is not None:
            value[far] = mixed(value[far] * beyond)
        out.append(mixed(np.add.reduceat(value, begins)))
    return out[0], out[1]


def span_pairs(words: Words, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each span of words."""
    sizes, second = ends - starts, np.zeros(len(starts), np.uint64)
    some = np.flatnonzero(sizes > 0)
    if len(some):
        n = sizes[some]
        begins = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(begins, n)
        value = words.checks[np.repeat(starts[some], n) + place]
        value += (place + 1).astype(np.uint64) * PLACE
        second[some] = mixed(np.add.reduceat(mixed(value), begins))
    return span_hashes(words.hashes, starts, ends), second


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    """``data``: the texts' bytes end to end; ``offsets``: where each begins, and the end."""
    letters = LETTERS[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = letters != _SPACE
    begins = inside[1:] & ~inside[:-1]
    stops = inside[:-1] & ~inside[1:]
    cuts = offsets[1:-1]  # a text may end and the next begin inside what looks like one word
    cuts = np.unique(cuts[inside[cuts] & inside[cuts + 1]])
    begins[cuts] = stops[cuts] = True
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops)
    hashes, checks = _spelled(letters[inside[1:-1]], starts, ends)
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets), checks)


class Grams(NamedTuple):
    values: np.ndarray
    first: np.ndarray  # n + 1


def grams_of(words: Words, first: np.ndarray | None = None, n: int = GRAM_WORDS) -> Grams:
    """Hashes of all word n-grams of each text, or of each span of words that ``first`` delimits; fewer than n words, but not none, are one n-gram."""
    h = words.hashes
    first = words.first if first is None else first
    count = np.diff(first)
    whole = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for k in range(n if len(whole) else 0):
        whole *= _GRAM_BASE
        whole += h[k : len(h) - n + 1 + k]
    whole = mixed(whole)
    sizes = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    at = np.concatenate([[0], np.cumsum(sizes)])
    source = np.repeat(first[:-1] - at[:-1], sizes) + np.arange(at[-1])
    short = (count < n) & (count > 0)
    values = whole[np.minimum(source, max(len(whole) - 1, 0))] if len(whole) else np.zeros(at[-1], np.uint64)
    if short.any():
        values[at[:-1][short]] = span_hashes(h, first[:-1][short], first[1:][short]) ^ _SHORT
    return Grams(values, at)


class Bands(NamedTuple):
    """How a MinHash signature is cut: a pair of similarity s collides in some band with 1 - (1 - s ** rows) ** bands."""

    bands: int
    rows: int


def bands_for(similarity: float, recall: float, most_hashes: int) -> Bands:
    """The longest rows, so the fewest chance collisions, that reach ``recall`` at ``similarity`` within ``most_hashes``."""
    best = None
    for rows in range(1, most_hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows)) if similarity < 1 else 1
        if bands * rows <= most_hashes:
            best = Bands(bands, rows)
    if best is None:
        raise ValueError(f"{most_hashes} hashes can't reach a recall of {recall}")
    return best


def band_keys(grams: Grams, bands: Bands, seed: int = 7) -> np.ndarray:
    """A 64-bit key for each band of each text that has n-grams (others: zeros)."""
    random = np.random.default_rng(seed)
    factors = random.integers(0, 1 << 63, bands.bands * bands.rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = random.integers(0, 1 << 63, bands.bands * bands.rows, dtype=np.uint64)
    have = np.flatnonzero(np.diff(grams.first))
    out = np.zeros((len(grams.first) - 1, bands.bands), np.uint64)
    if not len(have):
        return out
    starts, room = grams.first[:-1][have], np.empty_like(grams.values)
    for b in range(bands.bands):
        key = np.full(len(have), b + 1, np.uint64)
        for r in range(b * bands.rows, (b + 1) * bands.rows):
            np.multiply(grams.values, factors[r], out=room)
            np.add(room, shifts[r], out=room)
            key = mixed(key * _GRAM_BASE + np.minimum.reduceat(room, starts))
        out[have, b] = key
    return out
