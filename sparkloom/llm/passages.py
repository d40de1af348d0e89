"""Substring dedup by paragraph MinHash banding.

Two sorts of paragraphs are looked at, over whole texts:

* lines of at least ``paragraph_words`` words, alike at a Jaccard similarity of ``similarity`` on five-word n-grams: equal lines are a class, classes that share
  a band are verified on full n-gram sets, and the verified links' components are removed together, all but the lines of the smallest document;
* passages that don't keep to lines: windows of ``window_words`` words at anchors that the words alone decide (the smallest window hash among any
  ``run_words - window_words + 1`` successive ones), so that texts which share ``run_words`` words in a row share a window of them. Windows match as they are, by
  two independent hashes. A match grows to both sides by the words that an earlier document has together with the window, so a shared passage of ``run_words``
  words or more goes whole.

What is removed is held elsewhere. A line goes only where its component's smallest document keeps a line; a window only where a document of smaller id has the
same words and doesn't lose them as a line that's merely alike (such places keep no window, ``near``). Words removed as equal ones are therefore held by a smaller document, or
by a still smaller one that this one has them from. What a line has beyond the line that stays for it (at most a fifth of its n-grams for each link) does go; along
a chain of links that may be more, as components are removed as a whole.

Defined cases: a null text is empty, and stays null where texts are rewritten; documents of one id are one document here; a row with a null id keeps its text and
has a row of its own without removals in ``repeats``; what repeats within one document only stays; empty tables and other columns are harmless.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD_STEP_BYTES, parallelism, steps, stored, text_bytes
from sparkloom.llm.similar import SETS, WORK, links
from sparkloom.llm.tokens import mixed, span_hashes
from sparkloom.llm.words import GRAM_WORDS, PLACE, Bands, Words, band_keys, bands_for, grams_of, span_pairs, words_of

SIMILARITY, RECALL, MOST_HASHES = 0.8, 0.995, 24
#: A line of fewer words than an n-gram has isn't a paragraph.
PARAGRAPH_WORDS, RUN_WORDS, WINDOW_WORDS = GRAM_WORDS, 50, 25
_NEWLINE, COARSE = 10, 5
#: Places of one window that meet in a task; those of more commonly found ones are compared by shuffles of their lengths.
GROUP_ROWS = 16_384
UNITS = "doc_id long, start int, n int, h1 long, h2 long, n_grams int"


def lines_of(data: np.ndarray, words: Words) -> np.ndarray:
    """Numbers of the first words of all lines that have words, and the number of words."""
    if not len(words.starts):
        return np.zeros(1, np.int64)
    breaks = np.flatnonzero(data == _NEWLINE)
    firsts = np.unique(np.concatenate([words.first[:-1], np.searchsorted(words.starts, breaks)]))
    return np.append(firsts[firsts < len(words.starts)], len(words.starts))


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) over each ``width`` successive values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[: len(out) - step], out[step:])
        have += step
    return out


def anchors_of(words: Words, run: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First words of the windows that the texts' words choose, and their two hashes."""
    n = len(words.hashes)
    if n < window:
        none = np.zeros(0, np.int64)
        return none, none.view(np.uint64), none.view(np.uint64)
    at = np.arange(n - window + 1)
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    valid = text[: len(at)] == text[window - 1 :]
    starts = at[valid]
    first = span_hashes(words.hashes, starts, starts + window)
    owner, width = text[starts], run - window + 1
    chosen = np.zeros(len(starts), bool)
    if len(starts) >= width:
        lowest = _sliding(first, width, np.minimum)
        lowest[owner[: len(lowest)] != owner[width - 1 :]] = 0  # of two texts
        padded = np.zeros(len(starts) + width - 1, np.uint64)
        padded[width - 1 : width - 1 + len(lowest)] = lowest
        chosen = (_sliding(padded, width, np.maximum) == first) & (first > 0)
    edges = np.flatnonzero(np.diff(owner, prepend=-1))
    sizes = np.diff(np.append(edges, len(owner)))
    for a, size in zip(edges[sizes < width], sizes[sizes < width], strict=True):  # texts of fewer windows than that
        chosen[a + int(np.argmin(first[a : a + size]))] = True
    k = np.flatnonzero(chosen)
    # Text that repeats itself word by word has the same window everywhere: then one each half window is enough.
    again = (first[k][1:] == first[k][:-1]) & (starts[k][1:] // (window // 2) == starts[k][:-1] // (window // 2)) & (owner[k][1:] == owner[k][:-1])
    k = k[np.concatenate([[True], ~again])] if len(k) else k
    return starts[k], *span_pairs(words, starts[k], starts[k] + window)


def units(docs: DataFrame, bands: Bands, paragraph: int, run: int, window: int, n: int) -> DataFrame:
    """Paragraphs (with n-grams and bands ``b0``, ``b1``, ...) and windows (without) of (doc_id, text)."""
    names = [f"b{b}" for b in range(bands.bands)]

    def of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = batch.column(0).to_numpy()
            for i, j in steps(offsets, WORD_STEP_BYTES):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words = words_of(part, at)
                lines = lines_of(part, words)
                long = np.flatnonzero(np.diff(lines) >= paragraph)
                starts, ends = lines[:-1][long], lines[1:][long]
                first, second = span_pairs(words, starts, ends)
                flat = _joined(words, starts, ends)
                grams = grams_of(flat, n=n)
                keys = band_keys(grams, bands)
                a_starts, a_first, a_second = anchors_of(words, run, window)
                begin = np.concatenate([starts, a_starts])
                text = np.searchsorted(words.first, begin, side="right") - 1
                none = pa.nulls(len(a_starts), pa.int64())
                columns = [
                    pa.array(ids[i:j][text]), pa.array((begin - words.first[text]).astype(np.int32)),
                    pa.array(np.concatenate([ends - starts, np.full(len(a_starts), window)]).astype(np.int32)),
                    pa.array(np.concatenate([first, a_first]).view(np.int64)), pa.array(np.concatenate([second, a_second]).view(np.int64)),
                    pa.array(np.concatenate([np.diff(grams.first), np.zeros(len(a_starts), np.int64)]).astype(np.int32)),
                    *[pa.concat_arrays([pa.array(np.ascontiguousarray(keys[:, b]).view(np.int64)), none]) for b in range(bands.bands)],
                ]
                if len(begin):
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "n", "h1", "h2", "n_grams", *names])

    return docs.mapInArrow(of, ", ".join([UNITS, *[f"{b} long" for b in names]]))


def _joined(words: Words, starts: np.ndarray, ends: np.ndarray) -> Words:
    """The words of some spans, a text each."""
    sizes = ends - starts
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    take = np.repeat(starts - first[:-1], sizes) + np.arange(first[-1])
    return Words(words.starts[take], words.ends[take], words.hashes[take], first, words.checks[take])


WANTED = f"array<struct<h1: long, h2: long, node: long, bands: array<long>, work: array<{WORK}>>>"


def _sets(texts: DataFrame, paragraph: int, n: int) -> DataFrame:
    """The n-gram sets of the wanted paragraphs (``want``) of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            listed = batch.column("want")
            at_want, wanted = listed.offsets.to_numpy(), listed.values
            h1, h2 = (wanted.field(k).to_numpy() for k in (0, 1))
            for i, j in steps(offsets, WORD_STEP_BYTES):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                words = words_of(part, at)
                lines = lines_of(part, words)
                long = np.flatnonzero(np.diff(lines) >= paragraph)
                starts, ends = lines[:-1][long], lines[1:][long]
                first, second = (h.view(np.int64).tolist() for h in span_pairs(words, starts, ends))
                grams = grams_of(_joined(words, starts, ends), n=n)
                rows, sets = [], []
                for k in range(j - i):
                    a, b = np.searchsorted(starts, words.first[k : k + 2])
                    here = dict(zip(zip(first[a:b], second[a:b], strict=True), range(a, b), strict=True))
                    for w in range(at_want[i + k], at_want[i + k + 1]):
                        if (p := here.get((int(h1[w]), int(h2[w])))) is not None:
                            rows.append(w)
                            sets.append(np.unique(grams.values[grams.first[p] : grams.first[p + 1]]).tobytes())
                taken = wanted.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken.field(2), pa.array(np.ones(len(rows), np.int64)), taken.field(3), taken.field(4), pa.array(sets, pa.binary())], names=["node", "weight", "bands", "work", "grams"])

    return texts.mapInArrow(run, SETS)


def clear_of(windows: DataFrame, near: DataFrame, window: int) -> DataFrame:
    """``windows`` (doc_id, start, h1, h2) with free_left and free_right, the words between each and the next range of ``near`` (doc_id, start, n) on its sides, and
    whole: whether it meets none."""
    both = windows.withColumns({"from": F.lit(None).cast("int"), "to": F.lit(None).cast("int")}).unionByName(near.select("doc_id", "start", F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"), F.col("start").alias("from"), (F.col("start") + F.col("n")).alias("to")))
    of, upto = Window.partitionBy("doc_id"), (Window.unboundedPreceding, Window.currentRow)
    # Ranges come first among those of one start, both ways.
    before = F.coalesce(F.max("to").over(of.orderBy("start", F.col("from").desc_nulls_last()).rowsBetween(*upto)), F.lit(0))
    after = F.coalesce(F.min("from").over(of.orderBy(F.desc("start"), F.col("from").desc_nulls_last()).rowsBetween(*upto)), F.lit(1 << 30))
    out = both.withColumns({"free_left": F.col("start") - before, "free_right": after - F.col("start") - window}).where("h1 is not null").drop("from", "to")
    return out.withColumn("whole", F.expr("free_left >= 0 and free_right >= 0"))


def line_fates(docs: DataFrame, lines: DataFrame, similarity: float, paragraph: int, n: int) -> DataFrame:
    """(doc_id, start, n, kept_in, alike): the lines to remove, the document that keeps one for them, and whether that one is merely alike."""
    # Equal lines have equal bands. Numbers alone are summed up without sorting; an array among them would have all lines sorted.
    names = [c for c in lines.columns if c not in ("doc_id", "start", "n", "h1", "h2", "n_grams")]
    equal = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("top"), *[F.min(c).alias(c) for c in ("n_grams", *names)])
    # Numbered when written, once for all.
    classes = stored(equal.select("h1", "h2", "doc_id", "top", "n_grams", F.array(*names).alias("bands")).withColumn("node", F.monotonically_increasing_id()), "lines", hashes=True)

    def sets(members: DataFrame) -> DataFrame:
        known = classes.select("node", "doc_id", "h1", "h2", "bands").join(members.hint("shuffle_hash"), "node")
        want = known.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2", "node", "bands", "work")).cast(WANTED).alias("want"))
        return _sets(docs.join(want.hint("shuffle_hash"), "doc_id").select("text", "want"), paragraph, n)

    linked = links(classes, sets, similarity, "line-links").select("node", "label").join(classes.select("node", "doc_id"), "node")
    kept = linked.groupBy("label").agg(F.min("doc_id").alias("kept"))
    # A line stays in the smallest document of its component, or of its class where it's linked to no other.
    linked = linked.join(kept, "label").select("node", "kept", (F.col("doc_id") > F.col("kept")).alias("alike"))
    fates = classes.select("node", "h1", "h2", "doc_id", "top").join(linked.hint("shuffle_hash"), "node", "left").withColumns({"kept_in": F.coalesce("kept", "doc_id"), "alike": F.coalesce("alike", F.lit(False))})
    # Written, so that the join below has a shuffle on both sides, whose hot keys Spark can split.
    fates = stored(fates.where("kept_in < top").select("h1", "h2", "kept_in", "alike"), "fates")
    return lines.select("doc_id", "start", "n", "h1", "h2").join(fates.hint("shuffle_hash"), ["h1", "h2"]).where("doc_id <> kept_in").select("doc_id", "start", "n", "kept_in", "alike")


def spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = MOST_HASHES, paragraph_words: int = PARAGRAPH_WORDS, run_words: int = RUN_WORDS, window_words: int = WINDOW_WORDS, n: int = GRAM_WORDS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, start, n, kept_in): word ranges to remove and the document that keeps such text; ranges may overlap."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    found = stored(units(docs, bands_for(similarity, recall, most_hashes), paragraph_words, run_words, window_words, n), "paragraphs", hashes=True)
    from_lines = stored(line_fates(docs, found.where("n_grams > 0"), similarity, paragraph_words, n), "line-cuts")
    windows = found.where("n_grams = 0").select("doc_id", "start", "h1", "h2")

    # Written, so that the joins below have a shuffle on both sides, whose hot keys Spark can split.
    shared = stored(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("top")).where("low < top").select("h1", "h2"), "windows")
    shared = stored(clear_of(windows.join(shared.hint("shuffle_hash"), ["h1", "h2"]), from_lines.where("alike"), window_words), "shared")
    again = stored(shared.groupBy("h1", "h2").agg(F.min(F.when(F.col("whole"), F.col("doc_id"))).alias("kept_in"), F.max("doc_id").alias("top"), F.count("*").alias("places")).where("kept_in < top").drop("top"), "windows-again")
    repeated = stored(shared.join(again.hint("shuffle_hash"), ["h1", "h2"]).where("doc_id > kept_in"), "repeated")
    from_windows = repeated.select("doc_id", "start", F.lit(window_words).alias("n"), "kept_in").unionByName(grown(docs, shared.where("whole"), repeated, run_words, window_words, group_rows))
    return from_lines.drop("alike").unionByName(from_windows)


def _grown(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, edge, at, h1, many, keys): for the left and right of the wanted windows (``want``) of each text the hashes of the window with 1, 2, ... words there; ``at`` is where these begin (right) or end (left)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, (data, offsets) = batch.column("doc_id").to_numpy(), text_bytes(batch.column("text"))
            want = batch.column("want")
            at, found = want.offsets.to_numpy(), want.values
            start, h1, left, right = (found.field(k).to_numpy() for k in range(4))
            several = found.field(4).to_numpy(zero_copy_only=False)
            for i, j in steps(offsets, WORD_STEP_BYTES):
                words = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                rows = slice(at[i], at[j])
                text = np.repeat(np.arange(j - i), np.diff(at[i : j + 1]))
                begin, end = words.first[text] + start[rows], words.first[text + 1]
                # Of several texts with one id, those that have the window there.
                has = begin + window <= end
                has[has] = span_hashes(words.hashes, begin[has], begin[has] + window).view(np.int64) == h1[rows][has]
                text, begin, end, own, many = text[has], begin[has], end[has], h1[rows][has], several[rows][has]
                room = np.concatenate([np.minimum(left[rows][has], begin - words.first[text]), np.minimum(right[rows][has], end - begin - window)]).astype(np.int64)
                begin, text, own, many, before = np.tile(begin, 2), np.tile(text, 2), np.tile(own, 2), np.tile(many, 2), np.arange(len(room)) < len(begin)
                some = room > 0
                begin, text, own, many, before, room = begin[some], text[some], own[some], many[some], before[some], room[some]
                edges = np.concatenate([[0], np.cumsum(room)])
                # Words from the window's far end on, each stirred with its place: sums up to each of them are the hashes of all lengths.
                sizes = room + window
                last = np.cumsum(sizes)
                place = np.arange(last[-1] if len(last) else 0) - np.repeat(last - sizes, sizes)
                value = words.checks[np.repeat(np.where(before, begin + window - 1, begin), sizes) + np.where(np.repeat(before, sizes), -place, place)]
                value += (place + 1).astype(np.uint64) * PLACE
                total = np.cumsum(mixed(value))
                total -= np.repeat(np.concatenate([np.zeros(1, np.uint64), total[last[:-1] - 1]]), sizes) if len(last) else total
                keys = mixed(total[place >= window])
                place = begin - words.first[text]
                columns = [
                    pa.array(ids[i:j][text]), pa.array((2 * place + ~before).astype(np.int64)), pa.array(np.where(before, place, place + window).astype(np.int32)), pa.array(own), pa.array(many),
                    pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(keys.view(np.int64))),
                ]
                if len(room):
                    yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "edge", "at", "h1", "many", "keys"])

    return texts.mapInArrow(run, "doc_id long, edge long, at int, h1 long, many boolean, keys array<long>")


def whole_groups(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[pa.RecordBatch]:
    """Sorted batches cut anew, so that rows of equal ``names`` are in one."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows, bool)
        for c in names:
            values = batch.column(c).to_numpy()
            same &= values == values[-1]
        at = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if not at and held and any(held[-1].column(c)[-1].as_py() != batch.column(c)[0].as_py() for c in names):
            yield pa.concat_batches(held)
            held = []
        if at:
            yield pa.concat_batches([*held, batch.slice(0, at)])
            held = []
        held.append(batch.slice(at))
    if held:
        yield pa.concat_batches(held)


def _new(*columns: np.ndarray) -> np.ndarray:
    """Whether each row differs from the one before it."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return out


def _longest(found: DataFrame) -> DataFrame:
    """(doc_id, edge, n, at, kept_in): of (doc_id, edge, at, h1, keys) the longest of each side that an earlier document has too; the places of a window are compared in one task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "h1", "side"):
            doc, edge, h1, side = (batch.column(c).to_numpy() for c in ("doc_id", "edge", "h1", "side"))
            listed = batch.column("keys")
            ends, keys = listed.offsets.to_numpy().astype(np.int64), listed.flatten().to_numpy()
            ends -= ends[0]
            sizes = np.diff(ends)
            row, group = np.repeat(np.arange(len(doc)), sizes), np.cumsum(_new(h1, side))
            # Rows come by window and document, so the first of equal keys is of the smallest document.
            order = np.argsort(keys, kind="stable")
            of = row[order]
            firsts = np.flatnonzero(_new(keys[order], group[of]))
            low = np.empty_like(keys)
            low[order] = np.repeat(doc[of[firsts]], np.diff(np.append(firsts, len(of))))
            n = np.arange(len(keys)) - ends[row] + 1
            best = np.maximum.reduceat(np.where(doc[row] > low, n, 0), ends[:-1])
            kept = low[ends[:-1] + np.maximum(best, 1) - 1]
            # Of rows of one place the longest, then the largest keeper, as where groups are many.
            order = np.lexsort((kept, best, edge, doc, group))
            last = np.append(_new(group[order], doc[order], edge[order])[1:], True)
            k = np.sort(order[last])
            k = k[best[k] > 0]
            yield pa.RecordBatch.from_arrays([pa.array(doc[k]), pa.array(edge[k]), pa.array(best[k].astype(np.int32)), batch.column("at").take(pa.array(k)), pa.array(kept[k])], names=["doc_id", "edge", "n", "at", "kept_in"])

    dealt = found.select("doc_id", "edge", "at", "h1", (F.col("edge") % 2).alias("side"), "keys").repartition(parallelism(found.sparkSession), "h1", "side").sortWithinPartitions("h1", "side", "doc_id")
    return dealt.mapInArrow(run, "doc_id long, edge long, n int, at int, kept_in long")


def _longest_of_many(found: DataFrame, most: int) -> DataFrame:
    """The same as ``_longest``, for windows in any number of places, by shuffles of lengths.

    Whoever shares n words shares fewer too, so every ``COARSE``-th length is tried first, and then those beyond.
    """

    def held(tried: DataFrame, what: str) -> DataFrame:
        """Of (doc_id, edge, at, h1, n, key) the longest of each side that an earlier document has too."""
        keyed = tried.withColumn("side", F.col("edge") % 2)
        again = keyed.groupBy("h1", "side", "key").agg(F.min("doc_id").alias("kept_in"), F.max("doc_id").alias("top"))
        again = stored(again.where("kept_in < top").drop("top"), f"{what}-again")
        kept = keyed.join(again.hint("shuffle_hash"), ["h1", "side", "key"]).where("doc_id <> kept_in")
        return stored(kept.groupBy("doc_id", "edge").agg(F.max(F.struct("n", "at", "kept_in")).alias("x")).select("doc_id", "edge", "x.n", "x.at", "x.kept_in"), what)

    tried = lambda rows, lengths: rows.select("doc_id", "edge", "at", "h1", "keys", F.explode(lengths).alias("n")).withColumn("key", F.element_at("keys", F.col("n"))).drop("keys")
    size = F.size("keys")
    coarse = held(tried(found.where(size >= COARSE), F.sequence(F.lit(COARSE), size, F.lit(COARSE))), "coarse")
    rest = stored(found.join(coarse.select("doc_id", "edge", F.col("n").alias("have")), ["doc_id", "edge"], "left").withColumns({"have": F.coalesce("have", F.lit(0)), "side": F.col("edge") % 2}), "rest")
    # All with a window say what lies beyond each length at which one of them, but its first document, has got.
    levels = range(0, most + 1, COARSE)
    got = rest.groupBy("h1", "side").agg(F.min("doc_id").alias("low"), *[F.max(F.when(F.col("have") == c, F.col("doc_id"))).alias(f"at{c}") for c in levels])
    open_at = F.filter(F.array(*[F.when(F.col(f"at{c}") > F.col("low"), F.lit(c)) for c in levels]), lambda c: c.isNotNull())
    got = stored(got.select("h1", "side", open_at.alias("levels")).where("size(levels) > 0"), "levels")
    beyond = rest.join(got, ["h1", "side"]).withColumn("level", F.explode("levels")).where(size > F.col("level"))
    fine = held(tried(beyond, F.sequence(F.col("level") + 1, F.least(size, F.col("level") + COARSE - 1))), "fine")
    # A document's longest may lie below what it has in common at a later coarse length.
    fine = fine.join(coarse.select("doc_id", "edge", F.col("n").alias("have")), ["doc_id", "edge"], "left").where("have is null or n > have").drop("have")
    return fine.unionByName(coarse.join(fine, ["doc_id", "edge"], "left_anti"))


def grown(docs: DataFrame, windows: DataFrame, repeated: DataFrame, run: int, window: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, start, n, kept_in): the words at both sides of ``repeated`` windows that an earlier document has together with the window; ``windows`` may keep them.

    Any ``run`` shared words have a shared window that begins ``run - window`` words after their first at most, and one that ends so near to their last; so no more
    words than that are looked at, and only where no other repeated window covers them. The places of a window meet in a task, unless they are more than ``group_rows``.
    """
    most, order = run - window, Window.partitionBy("doc_id").orderBy("start")
    room = lambda gap: F.greatest(F.lit(0), F.least(F.lit(most), F.coalesce(gap, F.lit(most))))
    sides = repeated.where("whole").select("doc_id", "start", "h1", "h2", "places").distinct().withColumns({"left": room(F.col("start") - window - F.lag("start").over(order)), "right": room(F.lead("start").over(order) - F.col("start") - window)})
    edges = sides.groupBy("h1", "h2").agg(F.max("left").alias("left"), F.max("right").alias("right"), F.max("places").alias("places")).where("left + right > 0")
    edges = stored(edges.withColumn("many", F.col("places") > group_rows).drop("places"), "edges")
    # Every document with such a window, as each may be the one that keeps the words.
    near = windows.join(edges.hint("shuffle_hash"), ["h1", "h2"]).withColumns({"left": F.greatest(F.lit(0), F.least("left", "free_left")), "right": F.greatest(F.lit(0), F.least("right", "free_right"))})
    want = near.groupBy("doc_id").agg(F.collect_list(F.struct("start", "h1", F.col("left").cast("int"), F.col("right").cast("int"), "many")).alias("want"))
    found = _grown(docs.join(want.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "want"), window)
    if edges.where("many").isEmpty():
        both = stored(_longest(found), "grown")
    else:
        found = stored(found, "sides")
        both = stored(_longest(found.where("not many")), "grown").unionByName(_longest_of_many(found.where("many").drop("many"), most))
    return both.select("doc_id", F.when(F.col("edge") % 2 == 1, F.col("at")).otherwise(F.col("at") - F.col("n")).cast("int").alias("start"), "n", "kept_in")


def _merged(ranges: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


REMOVED = "doc_id long, n_removed long, removed array<struct<start: long, end: long>>, kept_in array<long>, repeated boolean"


def _by_document(found: DataFrame) -> DataFrame:
    """The ranges of (doc_id, start, n, kept_in) merged, a row (``REMOVED``) per document, also where all n are 0; a document has no more than its words can give."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "doc_id"):
            some = batch.column("n").to_numpy() > 0
            doc, start, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("doc_id", "start", "n"))
            number = np.cumsum(_new(doc)) - 1
            ids, m = doc[_new(doc)], int(number[-1]) + 1
            kept = batch.column("kept_in").filter(pa.array(some)).to_numpy().astype(np.int64)
            of, start, n = number[some], start[some], n[some]
            # Rows come by document and start; each document's places lie beyond those of the one before.
            a = start + (of << 40)
            top = np.maximum.accumulate(a + n)
            new = np.ones(len(a), bool)
            new[1:] = a[1:] > top[:-1]
            firsts = np.flatnonzero(new)
            begin, owner = start[firsts], of[firsts]
            end = top[np.append(firsts[1:], len(a)) - 1] - (owner << 40) if len(a) else begin
            total = np.bincount(owner, weights=end - begin, minlength=m).astype(np.int64)
            order = np.lexsort((kept, of))
            pairs = order[_new(of[order], kept[order])]
            lists = lambda owners, values: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=m))]).astype(np.int32)), values)
            ranges = pa.StructArray.from_arrays([pa.array(begin), pa.array(end)], names=["start", "end"])
            columns = [pa.array(ids), pa.array(total), lists(owner, ranges), lists(of[pairs], pa.array(kept[pairs])), pa.array(total > 0)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_removed", "removed", "kept_in", "repeated"])

    return found.repartition(parallelism(found.sparkSession), "doc_id").sortWithinPartitions("doc_id", "start").mapInArrow(run, REMOVED)


def repeats(docs: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """A row per document id, and per row without one: doc_id, n_removed (words), removed (array of word ranges), kept_in (sorted ids of the documents that keep them), repeated (n_removed > 0)."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    marks = ids.where("doc_id is not null").select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("n"), F.lit(None).cast("long").alias("kept_in"))
    nothing = ids.where("doc_id is null").selectExpr("doc_id", "0L as n_removed", "cast(array() as array<struct<start: long, end: long>>) as removed", "cast(array() as array<long>) as kept_in", "false as repeated")
    return _by_document(spans(docs, id_col=id_col, **how).unionByName(marks)).unionByName(nothing)


def without(text: str | None, ranges: list[tuple[int, int]]) -> str | None:
    """``text`` less some word ranges, each up to where the next word begins."""
    if text is None or not ranges:
        return text
    data = text.encode()
    words = words_of(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    starts = np.append(words.starts, len(data))
    out, at = [], 0
    for a, b in _merged(ranges):
        out.append(data[at : starts[a]])
        at = starts[min(b, len(words.starts))]
    return b"".join([*out, data[at:]]).decode()


def rewritten(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs``, its columns as they are, with the repeated passages cut from its texts."""
    schema, place = docs.schema, docs.columns.index(text_col)
    # Under other names, so that no column can clash with what is added.
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = docs.toDF(*names).withColumn("id", F.col(names[docs.columns.index(id_col)]).cast("long"))
    cuts = _by_document(spans(docs, id_col=id_col, text_col=text_col, **how)).select(F.col("doc_id").alias("id"), F.col("removed").alias("cut"))
    joined = own.join(cuts.hint("shuffle_hash"), "id", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [without(t, [(c["start"], c["end"]) for c in cut]) if cut else t for t, cut in zip(batch.column(place).to_pylist(), batch.column(len(schema)).to_pylist(), strict=True)]
            columns = [batch.column(k) if k != place else pa.array(texts, pa.string()) for k in range(len(schema))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return joined.select(*names, "cut").mapInArrow(run, schema)
