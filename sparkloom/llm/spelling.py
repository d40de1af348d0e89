"""Spelling variants: words that one inserted, deleted or replaced letter turns into each other, grouped under the most frequent spelling.

Words are indexed by positional q-grams (three letters, two pads at either end). One edit spoils at most ``Q`` grams of a word, and moves those behind it by
one place at most, so of two words at one edit

* each keeps, among its ``Q + 1`` rarest grams, one that is among those of the other: words are dealt by these grams and their length, and meet where they share one;
* all but ``Q`` of the shorter one's grams (``Q - 1`` where letters were added) stand in the longer one at the same place, or one on: the count filter.

Inside a gram's part the postings are by place and gram. A word merges its shortest lists by a heap, as a word that misses all of these can't reach the bound any more,
looks candidates up in the rest, and what reaches the bound is compared letter by letter. A part of more than ``BLOCK`` words is cut into blocks by hash, and each
pair of blocks is a part of its own, so no task holds more, however common a gram is. Grams are ordered by how many words have them: a table of at most
91 ** 3 counts (26 letters, 64 from U+00C0 to U+00FF, the pad), which is what bounds the broadcast.

A word has at most some 200 words a letter at one edit, and a form at least doubles the count, so a chain of forms has at most 62 links.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stored

Q, SYMBOLS = 3, 91
GRAMS = SYMBOLS**Q
#: Words of a part; what a task counts before it sends its counts; characters of a text that are taken apart at a time; places of a word that are indexed.
BLOCK, COUNTED, PIECE, PLACES = 1_000, 400_000, 1 << 20, 64
LEAST_LETTERS, LEAST_COUNT, RATIO = 5, 3, 2
_RUN = re.compile("[a-zÀ-ÿ]+")
_SYMBOL = np.zeros(256, np.int32)
_SYMBOL[0x61:0x7B] = np.arange(1, 27)
_SYMBOL[0xC0:0x100] = np.arange(27, 91)


def runs(text: str) -> Iterator[str]:
    """Maximal runs of letters (a-z, U+00C0 to U+00FF) after A-Z are lower-cased; nothing else changes case."""
    if len(text) <= PIECE:
        return iter(_RUN.findall(text.encode().lower().decode()))
    return (m[0] for m in _RUN.finditer(text.encode().lower().decode()))


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, damage: int | None = None) -> DataFrame:
    """(word, n): words of ``least_letters`` or more that occur ``least_count`` times or more in all texts. A null text has none.

    With ``damage``, a run whose crc32 of ``<id>:<run>`` it divides loses the letter at crc32 % length before it's counted (a null id is written as nothing). Counts
    are summed in each task before they're sent.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}
        get, crc32 = counts.get, zlib.crc32

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text:
                    continue
                start = crc32(f"{'' if key is None else key}:".encode())
                for word, n in Counter(runs(text)).items():
                    letters = len(word)
                    if letters < least_letters:
                        continue
                    if damage:
                        h = crc32(word.encode(), start)
                        if not h % damage:
                            if letters == least_letters:
                                continue
                            word = word[: h % letters] + word[h % letters + 1 :]
                    counts[word] = get(word, 0) + n
                if len(counts) >= COUNTED:
                    yield sent()
        yield sent()

    own = docs.select(F.col(id_col).cast("string"), F.col(text_col))
    return own.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all positional grams of the words, one word after the other (length + 2 each), and where each word's begin."""
    letters = _SYMBOL[np.frombuffer(("\0\0" + "".join(w + "\0\0" for w in words)).encode("latin-1"), np.uint8)]
    codes = (letters[:-2] * SYMBOLS + letters[1:-1]) * SYMBOLS + letters[2:]
    return codes, np.concatenate([[0], np.cumsum([len(w) + Q - 1 for w in words], dtype=np.int64)])


def _gram_counts(words: DataFrame) -> np.ndarray:
    """How many places of words have each gram; at most ``GRAMS`` numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(GRAMS, np.int64)
        for batch in batches:
            total += np.bincount(grams_of(batch.column(0).to_pylist())[0], minlength=GRAMS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["gram", "n"])

    found = words.select("word").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(GRAMS, np.int64)
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out


_DEALT = "gram int, size int, word string, n long, earlier long"
#: Bits that a gram's number takes.
_BITS = 20


def _dealt(words: DataFrame, counts: np.ndarray) -> DataFrame:
    """A row for each of a word's rarest grams and length that it may share with another word: its own, and as the longer one that of one less.

    ``earlier``: the word's rarer grams, ``_BITS`` bits each, so that a pair counts where both have their first common gram.
    """
    known = words.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = known.value
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, first = grams_of(batch.column(0).to_pylist())
            order = np.lexsort((codes, rank[codes], np.repeat(np.arange(batch.num_rows), np.diff(first))))
            rarest = codes[order[first[:-1, None] + np.arange(Q + 1)]].astype(np.int64)
            lengths, earlier = (np.diff(first) - Q + 1).astype(np.int32), np.zeros(batch.num_rows, np.int64)
            for k in range(Q + 1):
                own = np.flatnonzero((rarest[:, :k] != rarest[:, k : k + 1]).all(axis=1))
                rows = batch.take(pa.array(own))
                for size in (lengths, lengths - 1):
                    yield pa.RecordBatch.from_arrays([pa.array(rarest[own, k].astype(np.int32)), pa.array(size[own]), *rows.columns, pa.array(earlier[own])], names=["gram", "size", "word", "n", "earlier"])
                earlier = earlier | (rarest[:, k] + 1) << (_BITS * k)

    return words.select("word", "n").mapInArrow(run, _DEALT)


def _apart(a: int, b: int) -> bool:
    """Whether two words have no rarer gram in common."""
    return not a or not b or {a >> _BITS * k & (1 << _BITS) - 1 for k in range(Q)}.isdisjoint({x for k in range(Q) if (x := b >> _BITS * k & (1 << _BITS) - 1)})


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter turns ``a`` into ``b``; ``b`` is as long or one longer."""
    if a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


class Index:
    """Postings of words of one length by place and gram, each a list of the words' numbers in order."""

    def __init__(self, size: int):
        self.size, self.words = size, []
        self.postings: dict[int, list[int]] = defaultdict(list)

    def add(self, word: str, keys: list[int]) -> None:
        """``keys``: the word's grams with their places."""
        number, postings = len(self.words), self.postings
        for key in keys:
            postings[key].append(number)
        self.words.append(word)

    def near(self, word: str, keys: list[int], moved: list[int] | None = None) -> list[int]:
        """Numbers of the words one edit from ``word``, which is of the index's length, or one longer: then ``moved`` has, for each place, the gram after its own."""
        get = self.postings.get
        if moved is None:
            lists = [(x,) for x in map(get, keys) if x]
        else:
            pairs = [(get(a), get(b) if a != b else None) for a, b in zip(keys, moved, strict=True)]
            lists = [(x, y) if x and y else (x or y,) for x, y in pairs if x or y]
        least = len(keys) - (Q if moved is None else Q - 1)  # how many places must agree
        if len(lists) < least:
            return []
        lists.sort(key=_postings)
        short, found, last, agree = len(lists) - least + 1, [], -1, 0
        rest = lists[short:]
        for k in (*heapq.merge(*[x for lists_of in lists[:short] for x in lists_of]), -1):
            if k == last:
                agree += 1
                continue
            if last >= 0 and self._agree(last, rest, agree + len(rest) - least) and one_edit(self.words[last], word):
                found.append(last)
            last, agree = k, 1
        return found

    @staticmethod
    def _agree(k: int, rest: list[tuple], misses: int) -> bool:
        """Whether at most ``misses`` of the places' lists are without the word ``k``."""
        for lists_of in rest:
            for x in lists_of:
                at = bisect_left(x, k)
                if at < len(x) and x[at] == k:
                    break
            else:
                if not misses:
                    return False
                misses -= 1
        return True


def _postings(lists_of: tuple) -> int:
    return len(lists_of[0]) if len(lists_of) == 1 else len(lists_of[0]) + len(lists_of[1])


def _pairs_in(size: int, roles: list[str], words: list[str], ns: list[int], earlier: list[int], keys: list[int], moved: list[int], first: list[int], out: tuple[list, list, list]) -> None:
    """Appends (word, near word, its n), both ways, for a part's words. Roles: ``both`` is indexed after it was looked up, ``index`` is indexed only and comes first, ``query`` looked up only."""
    index, known = Index(size), []
    places = None if size + Q - 1 <= PLACES else [k * (size + Q - 1) // PLACES for k in range(PLACES)]
    for r in sorted(range(len(words)), key=lambda r: roles[r] != "index"):
        word, a, b = words[r], first[r], first[r] + size + Q - 1
        own = keys[a:b] if places is None else [keys[a + p] for p in places]
        if roles[r] != "index":
            onward = None if len(word) == size else moved[a:b] if places is None else [moved[a + p] for p in places]
            for k in index.near(word, own, onward):
                o = known[k]
                if _apart(earlier[o], earlier[r]):
                    for column, values in zip(out, ((word, words[o]), (words[o], word), (ns[o], ns[r])), strict=True):
                        column += values
        if roles[r] != "query":
            index.add(word, own)
            known.append(r)


def _paired(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts follow each other, each a run of rows of one key; longer words come last in theirs, as they're looked up only. A part is compared when its last row is there."""
    names, left = ("gram", "size", "i", "j"), None

    def whole(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        """The pairs of the parts that end where ``ends`` says."""
        words, sizes, roles = rows.column("word").to_pylist(), rows.column("size").to_pylist(), rows.column("role").to_pylist()
        ns, earlier, out = rows.column("n").to_pylist(), rows.column("earlier").to_pylist(), ([], [], [])
        codes, first = grams_of(words)
        place = (np.arange(len(codes)) - np.repeat(first[:-1], np.diff(first))) * GRAMS
        keys, moved, first = (place + codes).tolist(), (place + np.concatenate([codes[1:], [0]])).tolist(), first.tolist()
        begin = 0
        for end in ends.tolist():
            if end - begin > 1 and len(words[begin]) == sizes[begin]:
                _pairs_in(sizes[begin], roles[begin:end], words[begin:end], ns[begin:end], earlier[begin:end], keys, moved, first[begin:end], out)
            begin = end
        return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["word", "near", "near_n"])

    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([left, rows]).combine_chunks() if left is not None else rows
        key = np.stack([rows.column(c).to_numpy() for c in names])
        ends = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
        left = rows
        if len(ends):
            yield whole(rows.slice(0, int(ends[-1])), ends)
            left = rows.slice(int(ends[-1]))
    if left is not None and left.num_rows:
        yield whole(left, np.array([left.num_rows]))


def near_pairs(words: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(word, near, near_n) for all ordered pairs of words of (word, n) at one edit; words are distinct, of two letters or more from a-z and U+00C0 to U+00FF."""
    dealt = _dealt(words, _gram_counts(words))
    longer = F.length("word") > F.col("size")
    sizes = dealt.groupBy("gram", "size").agg(F.count_if(~longer).alias("own"), F.count_if(longer).alias("longer"))
    # Parts that need blocks: at most eight in ``block`` words.
    hot = sizes.where((F.col("own") > 0) & (F.greatest("own", "longer") > block)).select("gram", "size", F.ceil(F.greatest("own", "longer") / block).cast("int").alias("blocks"))
    cut = dealt.where("size >= 2").join(stored(hot, "hot-grams"), ["gram", "size"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("own", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))

    def places(last: str, part: Callable[..., object]) -> object:
        return F.transform(F.expr(f"IF({last} < 0, array(), sequence(0, {last}))"), part)

    def part(i: object, j: object, role: object) -> object:
        return F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), role.alias("role"))

    own = F.col("own")
    looked_up = places("blocks - 1", lambda i: part(i, own, F.lit("query")))
    indexed = places("blocks - 1", lambda j: part(own, j, F.when(j == own, F.lit("both")).otherwise(F.lit("index"))))
    meets = places("own - 1", lambda i: part(i, own, F.lit("query")))
    parts = cut.select("gram", "size", "word", "n", "earlier", F.inline(F.when(longer, looked_up).otherwise(F.concat(indexed, meets))))
    order = ["gram", "size", "i", "j"]
    dealt_out = parts.withColumn("longer", F.length("word") > F.col("size")).repartition(*order).sortWithinPartitions(*order, "longer", "word")
    return dealt_out.mapInArrow(_paired, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): where forms lead in the end. Each round takes twice as many steps."""
    up = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "forms")
    while not up.where("moved").isEmpty():
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = stored(up.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "forms")
    return up.drop("moved")


def variants(words: DataFrame, *, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """A row per word of (word, n): word, form, root, n, n_near, form_n.

    Two words are near at exactly one inserted, deleted or replaced letter. ``form`` is the near word of largest n (of these the smallest in code-point order) if
    that n is at least ``ratio`` (2 or more) times the word's, else null, ``form_n`` its n, ``n_near`` the number of near words, and ``root`` the end of the chain of forms, or the word
    itself. No words give no rows.
    """
    words = stored(words.select("word", "n"), "words")
    pairs = near_pairs(words, block=block)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("down"), F.col("near").alias("near"))).alias("best"))
    formed = (-F.col("best.down")) >= ratio * F.col("n")
    known = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.down")).alias("form_n"))
    known = stored(known, "near-words")
    roots = _roots(known.where("form is not null"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
