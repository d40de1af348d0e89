"""Benchmark decontamination: one Aho-Corasick automaton over the benchmark's normalised words scans each text once.

The benchmark's distinct words are numbered, a number is a code of a few letters, and an item is a string of codes. Of items of a window or more the patterns are the pieces of half a window that follow each
other from the item's first word: wherever a window lies in an item, it holds one of these whole. So the automaton has some three nodes a word of the benchmark, where one of all windows, letter by letter, would have sixty. A shorter item is one pattern.
A text's words become codes too (unknown words one that no item has); where the automaton finds a piece, the text is compared with the item to both sides, and a common run of a window
or more is an occurrence. A code's place is the word's place in the original, and ``spans`` has the characters.

A benchmark of more characters or distinct words than one automaton may have is scanned block by block: the driver holds one block of items at a time, a pass writes what it hits, and the
passes' hits are merged by document.

Defined cases: a null or wordless text has no words and isn't contaminated; an item without words has no windows; repeated items count
once each under their own ids, items of one id are one; a null item_id counts as an item but has no place in the list of ids; empty tables and other columns are harmless.
"""

from __future__ import annotations

import hashlib
import itertools
from collections import defaultdict
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkloom.llm.common import stored
from sparkloom.llm.words import LETTERS

WINDOW_WORDS = 10
#: Letters of a word's code, how many there are for each place, and what stands for a word that no item has.
WIDTH, BASE, UNKNOWN = 3, 64, "\0\0\0"
#: Characters and distinct words of items in one automaton (as many as there are codes); a larger benchmark is scanned in as many passes as it needs. Words of an item that are one piece of a block.
BLOCK_CHARS, BLOCK_WORDS, PIECE_WORDS = 12_000_000, BASE**WIDTH, 100_000
TABLE = LETTERS.tobytes()


def normalised(text: str | None) -> list[bytes]:
    """The words of a text, lower-cased, in UTF-8."""
    return (text or "").encode().translate(TABLE).split()


def _code(number: int) -> str:
    """``WIDTH`` letters for a word's number, each place with letters of its own; so what the automaton finds begins and ends with words, and its nodes have few children."""
    return "".join(chr(1 + place * BASE + number // BASE**place % BASE) for place in range(WIDTH))


class Known(NamedTuple):
    codes: dict[bytes, str]
    items: list[str]  # distinct ones, in codes
    ids: list[set]
    found: ahocorasick.Automaton  # of pieces; a value is the piece's words and where it stands: (item, word), ...
    window: int


def automaton(items: list[tuple[str | None, str | None]], n: int) -> Known:
    codes: dict[bytes, str] = {}
    owners: dict[str, set] = defaultdict(set)
    for item_id, text in items:
        words = normalised(text)
        for w in words:
            if w not in codes:
                codes[w] = _code(len(codes))
        if words:
            owners["".join([codes[w] for w in words])].add(item_id)
    coded, places, half = list(owners), defaultdict(list), (n + 1) // 2
    for k, item in enumerate(coded):
        size = len(item) // WIDTH
        for at in range(0, size - half + 1, half) if size >= n else (0,):
            places[item[WIDTH * at : WIDTH * (at + half)] if size >= n else item].append((k, at))
    found = ahocorasick.Automaton()
    for piece, there in places.items():
        found.add_word(piece, (len(piece) // WIDTH, tuple(there)))
    if places:
        found.make_automaton()
    return Known(codes, coded, [owners[c] for c in coded], found, n)


def _common(a: str, i: int, b: str, j: int) -> int:
    """How many words are the same from the letters ``i`` and ``j`` on."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 16
    while n < most:
        k = min(step, most - n)
        if a[i + n : i + n + k] == b[j + n : j + n + k]:
            n, step = n + k, 2 * step
        elif k == 1:
            break
        else:
            step = k // 2
    return n // WIDTH


def hits(words: list[bytes], known: Known) -> tuple[np.ndarray, set]:
    """Which words lie in an occurrence, as word ranges (k, 2), and the items that occur."""
    if not words or not known.items:
        return np.zeros((0, 2), np.int64), set()
    get, ranges, items, upto, back = known.codes.get, [], set(), {}, None
    line = "".join([get(w, UNKNOWN) for w in words])
    for end, (length, there) in known.found.iter(line):
        last = (end + 1) // WIDTH
        first = last - length
        for k, at in there:
            item = known.items[k]
            if len(item) < WIDTH * known.window:
                a, b = first, last
            elif upto.get((k, first - at), -1) >= last:  # inside a run that is known
                continue
            else:
                back = line[::-1] if back is None else back
                a = first - _common(back, len(line) - WIDTH * first, item[: WIDTH * at][::-1], 0)
                b = last + _common(line, WIDTH * last, item, WIDTH * (at + length))
                upto[k, first - at] = b
                if b - a < known.window:
                    continue
            ranges.append((a, b))
            items.update(known.ids[k])
    return np.array(ranges, np.int64).reshape(-1, 2), items


def covered(ranges: np.ndarray, n: int) -> np.ndarray:
    """Whether each of n words lies in a range."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, ranges[:, 0], 1)
    np.add.at(edge, ranges[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def spans(text: str, ranges: np.ndarray) -> list[tuple[int, int]]:
    """Character ranges of the original text for word ranges of it, joined where they touch."""
    data = text.encode()
    inside = np.concatenate([[False], np.frombuffer(data, np.uint8)[:] >= 0, [False]])
    inside[1:-1] = LETTERS[np.frombuffer(data, np.uint8)] != 32
    starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    hit = covered(ranges, len(starts))
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in edge.reshape(-1, 2)]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, most_chars: int, window: int, most_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, str | None]]]:
    """The benchmark's items, streamed to the driver a partition at a time, in blocks of bounded size. Of a very long item the pieces overlap, so that each window is in one."""
    block, chars, known = [], 0, set()
    for row in benchmark.select(F.col(item_col).cast("string"), F.col(text_col)).toLocalIterator():
        words = normalised(row[1])
        for at in range(0, max(1, len(words) - window + 1), PIECE_WORDS):
            own = words[at : at + PIECE_WORDS + window - 1]
            text, new = b" ".join(own).decode(), set(own)
            if block and (chars + len(text) > most_chars or len(known | new) > most_words):
                yield block
                block, chars, known = [], 0, set()
            block.append((row[0], text))
            chars += len(text)
            known |= new
    yield block


_automata: dict[str, Known] = {}
RANGES, ITEMS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.list_(pa.string())
SCHEMA = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<struct<start: long, end: long>>"
NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids", "spans"]


def _known(key: str, items: list, n: int) -> Known:
    """A worker's automaton for a block of items; the latest block only."""
    if key not in _automata:
        _automata.clear()
        _automata[key] = automaton(items, n)
    return _automata[key]


def _answer(text: str | None, ranges: np.ndarray, ids: set) -> tuple:
    """The columns of ``SCHEMA``."""
    n, named = len(normalised(text)), sorted(i for i in ids if i is not None)
    n_hit = int(covered(ranges, n).sum()) if len(ranges) else 0
    return n, n_hit, len(ids), hashlib.sha256(",".join(named).encode()).hexdigest(), n_hit > 0, named, [{"start": a, "end": b} for a, b in spans(text, ranges)] if len(ranges) else []


def _answers(doc_ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), ITEMS, RANGES)
    columns = list(zip(*rows, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([doc_ids, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=["doc_id", *NAMES])


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """A row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids (strings, sorted), spans (characters of the original)."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # As a schema, not text: an id may be of any type.
    schema = StructType([texts.schema["doc_id"], *StructType.fromDDL(SCHEMA).fields])
    blocks = item_blocks(benchmark, item_col, item_text_col, block_chars, window)
    block, after = next(blocks), next(blocks, None)
    if after is None:
        return _scan_once(texts, block, window, schema)
    return _scan_blocks(texts, itertools.chain((block, after), blocks), window, schema)


def _shared(texts: DataFrame, block: list, window: int) -> tuple:
    """A block of items for the workers, and what names it and the window."""
    return texts.sparkSession.sparkContext.broadcast(block), hashlib.sha256(repr((block, window)).encode()).hexdigest()


def _scan_once(texts: DataFrame, block: list, window: int, schema: StructType) -> DataFrame:
    shared, key = _shared(texts, block, window)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = _known(key, shared.value, window)
            yield _answers(batch.column(0), [_answer(text, *hits(normalised(text), known)) for text in batch.column(1).to_pylist()])

    return texts.mapInArrow(run, schema)


def _scan_blocks(texts: DataFrame, blocks: Iterable[list], window: int, schema: StructType) -> DataFrame:
    """A pass for each block over the written, numbered texts; a pass's row is a document that it hits."""
    numbered = stored(texts.withColumn("row", F.monotonically_increasing_id()), "numbered")
    found = None
    for block in blocks:
        shared, key = _shared(texts, block, window)

        def run(batches: Iterable[pa.RecordBatch], shared=shared, key=key) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                known, rows = _known(key, shared.value, window), []
                for row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ranges, ids = hits(normalised(text), known)
                    if len(ranges):
                        rows.append((row, [{"start": a, "end": b} for a, b in ranges.tolist()], list(ids)))
                columns = list(zip(*rows, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), RANGES, ITEMS), strict=True)], names=["row", "ranges", "items"])

        hit = stored(numbered.select("row", "text").mapInArrow(run, "row long, ranges array<struct<start: long, end: long>>, items array<string>"), "hits")
        shared.destroy()
        found = hit if found is None else found.unionAll(hit)
    merged = found.groupBy("row").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, ranges, ids in zip(*(batch.column(c).to_pylist() for c in ("text", "ranges", "items")), strict=True):
                rows.append(_answer(text, np.array([(r["start"], r["end"]) for r in ranges or ()], np.int64).reshape(-1, 2), set(ids or ())))
            yield _answers(batch.column("doc_id"), rows)

    return numbered.join(merged, "row", "left").select("doc_id", "text", "ranges", "items").mapInArrow(run, schema)
