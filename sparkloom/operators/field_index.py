"""Text search over several fields of documents, with word positions: phrases, fields, must and must-not, and a top k that leaves out blocks that can't matter.

The index is a folder of tables that grow by committed batches (``batches``). A row of ``postings`` is a block of up to 128 documents of a field's term, in order of their ids: ids,
counts, field lengths and word positions (as steps) in columns of their own, with the largest BM25 gain in the block. Terms lie in buckets. Blocks are made where the documents are
read, so no posting is shuffled to be stored. A search reads the buckets of its terms, and positions only for phrases; its blocks are dealt out, as lists, by ranges of ids, and each range is searched as a whole.

A query is clauses ``[+|-][field:]word`` or ``[+|-][field:]"some words"``: ``+`` must match, ``-`` must not, others add to the score, and without any ``+`` at least one has to match. A
clause without a field may match any field, and scores in each. A word that the tokens rule takes apart is a phrase. An open quote or an unknown field spoils
the whole query, which then finds nothing (``clauses`` says so). Scores are BM25, times the field's weight, added up; a phrase counts as a term whose idf is the sum of its words'.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sparkloom.functions.text import words
from sparkloom.operators import batches, search
from sparkloom.operators.search import K1, B
from sparkloom.sources.tables import tidy, written

#: Buckets of terms, ranges of ids that a compacted batch is spread by, documents of a block, words that are put in order at a time.
BUCKETS, PARTS, BLOCK, STEP_WORDS = 64, 16, 128, 1_000_000
#: Words of the documents of a range that is searched as a whole, and queries that are searched for at a time.
RANGE_WORDS, QUERY_BLOCK = 2_000_000, 16_384
#: Ranges of ids by which bounds are added up, and those of a query that are scored first.
RANGES, FIRST_RANGES = 256, 4
#: Bytes that a task holds of a bucket's file before it writes them.
ROW_GROUP = 2 << 20
LENGTHS = "id long, field string, dl int"
HEADS = "field string, term string, n int, first long, last long, gain double, mean double, bucket int"
POSTINGS = "field string, term string, n int, first long, last long, gain double, mean double, ids array<long>, tfs array<int>, dls array<int>, steps array<array<int>>, bucket int"
_CLAUSE = r'([+-]?)(?:([A-Za-z_]\w*):)?(?:"([^"]*)"|([^\s"]+))'
_COUNTED = POSTINGS.replace(", bucket int", "")


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _counted(batch_iter: Iterable[pa.RecordBatch], means: dict[str, float], low: int, high: int, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks, without buckets, of rows (id, field, words): some documents' words are put in order at once, by field, term and id; steps are the first position and the distances between the next. A block lies in one of the ``PARTS`` ranges between the ids ``low`` and ``high``."""
    for batch in batch_iter:
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        ends, i = np.cumsum(sizes), 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP_WORDS, side="right")))
            part = batch.slice(i, j - i)
            own, i = sizes[i:j], j
            if not own.sum():
                continue
            ids, fields, coded = part.column(0).to_numpy(), part.column(1).dictionary_encode(), part.column(2).flatten().dictionary_encode()
            by_id = np.argsort(ids, kind="stable")
            rank = np.empty(len(ids), np.int64)
            rank[by_id] = np.arange(len(ids))
            n_terms = len(coded.dictionary)
            place = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
            leaf = np.repeat(fields.indices.to_numpy().astype(np.int64), own) * n_terms + coded.indices.to_numpy()
            order = np.argsort(leaf * len(ids) + np.repeat(rank, own), kind="stable")
            leaf, place, row = leaf[order], place[order].astype(np.int32), np.repeat(np.arange(len(ids)), own)[order]
            new = np.concatenate([[True], leaf[1:] != leaf[:-1]])
            starts = np.flatnonzero(new | np.concatenate([[True], row[1:] != row[:-1]]))  # of each document of a term
            tf, row, new, leaf = np.diff(starts, append=len(place)), row[starts], new[starts], leaf[starts]
            parts = _part(ids[row], low, high)
            new[1:] |= parts[1:] != parts[:-1]
            steps = np.diff(place, prepend=np.int32(0))
            steps[starts] = place[starts]
            run = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            heads = np.flatnonzero((np.arange(len(new)) - run) % block == 0)
            at, last = np.append(heads, len(new)), np.append(heads[1:], len(new)) - 1
            mean = np.array([means.get(f, 1.0) for f in fields.dictionary.to_pylist()])[leaf // n_terms]
            dl, found = own[row], ids[row]
            gains = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
            columns = [
                fields.dictionary.take(pa.array(leaf[heads] // n_terms)), coded.dictionary.take(pa.array(leaf[heads] % n_terms)), pa.array(np.diff(at).astype(np.int32)), pa.array(found[heads]), pa.array(found[last]), pa.array(np.maximum.reduceat(gains, heads)), pa.array(mean[heads]),
                _lists(at, pa.array(found)), _lists(at, pa.array(tf.astype(np.int32))), _lists(at, pa.array(dl.astype(np.int32))), _lists(at, _lists(np.append(starts, len(place)), pa.array(steps))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _COUNTED.split(", ")])


def _blocked(batch_iter: Iterable[pa.RecordBatch], means: dict[str, float], block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted rows (bucket, field, term, part, id, tf, dl, steps): up to ``block`` of one term and part. ``means``: mean lengths, by which gains are reckoned."""
    left: pa.Table | None = None

    def sent(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        whole = {c: rows.column(c).chunk(0) for c in rows.column_names}
        at, ends = np.append(starts, rows.num_rows), np.append(starts[1:], rows.num_rows) - 1
        tf, dl = whole["tf"].to_numpy(), whole["dl"].to_numpy()
        heads = {c: whole[c].take(pa.array(starts)) for c in ("field", "term", "bucket")}
        lists = {to: _lists(at, whole[c]) for to, c in (("ids", "id"), ("tfs", "tf"), ("dls", "dl"), ("steps", "steps"))}
        first, last = (whole["id"].take(pa.array(x)) for x in (starts, ends))
        mean = np.array([means[f] for f in heads["field"].to_pylist()])
        gains = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / np.repeat(mean, np.diff(at))))
        columns = [heads["field"], heads["term"], pa.array(np.diff(at).astype(np.int32)), first, last, pa.array(np.maximum.reduceat(gains, starts)), pa.array(mean), *lists.values(), heads["bucket"]]
        return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in POSTINGS.split(", ")])

    for batch in batch_iter:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([left, rows]).combine_chunks() if left is not None else rows
        if not rows.num_rows:
            continue
        n, new = rows.num_rows, np.zeros(rows.num_rows, bool)
        new[0] = True
        for c in ("field", "term", "part"):
            code = rows.column(c).combine_chunks().dictionary_encode()
            code = (code.chunk(0) if isinstance(code, pa.ChunkedArray) else code).indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        run = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        starts = np.flatnonzero((np.arange(n) - run) % block == 0)
        if len(starts) > 1:
            yield sent(rows.slice(0, int(starts[-1])), starts[:-1])
        left = rows.slice(int(starts[-1]))
    if left is not None and left.num_rows:
        yield sent(left, np.zeros(1, np.int64))


def _absolute(batch_iter: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column's steps as positions."""
    for batch in batch_iter:
        steps = batch.columns[-1]
        at, values = steps.offsets.to_numpy(), np.cumsum(steps.values.to_numpy(), dtype=np.int64)
        before = np.append(0, values)[at[:-1]]
        places = (values[at[0] : at[-1]] - np.repeat(before, np.diff(at))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], _lists(at - at[0], pa.array(places))], names=batch.schema.names)


def _bucket(term: str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _part(ids: np.ndarray, low: int, high: int) -> np.ndarray:
    """Which of the ``PARTS`` ranges ids lie in."""
    return (ids - low) // max(1.0, (high - low + 1) / PARTS)


def _batch_sizes(spark: SparkSession, path: str, batch: int) -> tuple[dict[str, float], int, int]:
    """The mean lengths of a batch's fields, and its smallest and largest id; its ``lengths`` are there."""
    sizes = spark.read.schema(LENGTHS).parquet(f"{path}/lengths/batch={batch}").groupBy("field").agg(F.avg("dl").alias("mean"), F.min("id").alias("low"), F.max("id").alias("high")).collect()
    return {r["field"]: r["mean"] for r in sizes}, min((r["low"] for r in sizes), default=0), max((r["high"] for r in sizes), default=0)


def _put_blocks(blocks: DataFrame, path: str, batch: int) -> None:
    """A task writes its buckets side by side, so that blocks aren't put in order, and spilled, before; it holds at most ``ROW_GROUP`` of each, and no dictionaries, as ids, steps and gains hardly repeat. From as many open files as the limit on, Spark sorts, so the limit is one more."""
    conf, name = blocks.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, str(BUCKETS + 1))
    try:
        with tidy(blocks.sparkSession):
            blocks.write.mode("overwrite").options(**{"compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.enable.dictionary": False}).partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
    finally:
        conf.set(name, before)


def _put_postings(rows: DataFrame, path: str, batch: int, block: int) -> None:
    """Writes (id, field, term, tf, dl, steps) in blocks, those of a term and range of ids together."""
    means, low, high = _batch_sizes(rows.sparkSession, path, batch)
    part = F.least(F.lit(PARTS - 1), F.floor((F.col("id") - low) / max(1.0, (high - low + 1) / PARTS))).cast("int")
    placed = rows.withColumns({"bucket": _bucket("term"), "part": part}).repartition("bucket", "part").sortWithinPartitions("bucket", "field", "term", "part", "id")
    _put_blocks(placed.select("bucket", "field", "term", "part", "id", "tf", "dl", "steps").mapInArrow(lambda b: _blocked(b, means, block), POSTINGS), path, batch)


def add(docs: DataFrame, path: str, fields: dict[str, Column | str], *, ident: str = "doc_id", tokens=words, block: int = BLOCK) -> None:
    """Adds documents, in place of those of the same ids. ``fields``: each field's text or its column, null or empty for none. Ids aren't null, and each is in the batch once."""
    spark = docs.sparkSession
    batch = batches.next_batch(spark, path)
    batches.put(docs.select(F.col(ident).cast("long").alias("id")).distinct(), path, "gone", batch)
    each = F.inline(F.array(*[F.struct(F.lit(name).alias("field"), tokens(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))).alias("words")) for name, text in fields.items()]))
    listed = docs.select(F.col(ident).cast("long").alias("id"), each)
    batches.put(listed.select("id", "field", F.size("words").alias("dl")).where("dl > 0"), path, "lengths", batch)
    means, low, high = _batch_sizes(spark, path, batch)
    _put_blocks(listed.mapInArrow(lambda b: _counted(b, means, low, high, block), _COUNTED).withColumn("bucket", _bucket("term")), path, batch)
    batches.commit(spark, path, batch)


def delete(spark: SparkSession, path: str, ids: DataFrame, ident: str = "id") -> None:
    """Ends the documents of some ids."""
    batch = batches.next_batch(spark, path)
    batches.put(ids.select(F.col(ident).cast("long").alias("id")).distinct(), path, "gone", batch)
    batches.commit(spark, path, batch)


def compacted(spark: SparkSession, path: str, to: str, *, block: int = BLOCK) -> None:
    """The live documents of an index as the one batch of a new one."""
    lengths = batches.live(spark, path, batches.read(spark, path, "lengths", LENGTHS)).drop("batch")
    batches.put(lengths, to, "lengths", 1)
    rows = _rows(spark, path, batches.read(spark, path, "postings", POSTINGS), positions=True)
    _put_postings(rows.select("id", "field", "term", "tf", "dl", "steps"), to, 1, block)
    batches.commit(spark, to, 1)


def _rows(spark: SparkSession, path: str, blocks: DataFrame, *, positions: bool) -> DataFrame:
    """The live documents of blocks, a row each, with the blocks' other columns; ``steps`` last."""
    names = {"ids": "id", "tfs": "tf", "dls": "dl"} | ({"steps": "steps"} if positions else {})
    kept = [c for c in blocks.columns if c not in ("ids", "tfs", "dls", "steps", "n", "first", "last", "gain", "mean", "bucket")]
    each = blocks.select(*kept, F.inline(F.arrays_zip(*[F.col(c).alias(to) for c, to in names.items()])))
    return batches.live(spark, path, each.toDF(*kept, *names.values())).select(*kept, *names.values())


def clauses(queries: DataFrame, fields: Iterable[str], *, tokens=words) -> DataFrame:
    """(query, clause, mark, field, terms, error) of ``queries`` (query, text): a row a clause, null field for any; queries with an error have it in each row. Equal clauses count once."""
    found = [F.regexp_extract_all("text", F.lit(_CLAUSE), F.lit(i)) for i in range(1, 5)]
    open_quote = F.size(F.split("text", '"')) % 2 == 0
    listed = queries.select("query", open_quote.alias("open"), F.posexplode_outer(F.arrays_zip(*found)).alias("clause", "parts"))
    parts = listed.select("query", "open", "clause", *[F.col("parts").getField(str(i)).alias(c) for i, c in enumerate(("mark", "field", "phrase", "word"))])
    named = parts.withColumn("field", F.when(F.col("field") != "", F.col("field")))
    unknown = F.col("field").isNotNull() & ~F.col("field").isin(*fields)
    errors = named.groupBy("query").agg(F.when(F.bool_or("open"), F.lit("open quote")).when(F.bool_or(unknown), F.lit("unknown field")).alias("error"))
    rows = named.withColumn("terms", tokens(F.concat("phrase", "word"))).where(F.size("terms") > 0)
    once = rows.groupBy("query", "mark", "field", "terms").agg(F.min("clause").alias("clause"))
    return once.join(errors, "query").select("query", "clause", "mark", "field", "terms", "error")


def _wanted(queries: DataFrame, fields: dict[str, float], tokens) -> DataFrame:
    """(query, clause, mark, field, n_terms, j, term): a row for each field and word of each clause of the queries without an error."""
    sound = clauses(queries, fields, tokens=tokens).where("error is null")
    every = F.explode(F.when(F.col("field").isNull(), F.array(*[F.lit(f) for f in fields])).otherwise(F.array("field")))
    return sound.select("query", "clause", "mark", every.alias("field"), F.size("terms").alias("n_terms"), F.posexplode("terms").alias("j", "term"))


def _blocks(spark: SparkSession, path: str, wanted: DataFrame, schema: str) -> DataFrame:
    """The blocks of the wanted fields' terms; other buckets aren't read."""
    leaves = wanted.select("field", "term").distinct().withColumn("bucket", _bucket("term"))
    needed = [r["bucket"] for r in leaves.select("bucket").distinct().collect()]  # at most all buckets
    return batches.read(spark, path, "postings", schema).where(F.col("bucket").isin(needed)).join(F.broadcast(leaves.drop("bucket")), ["field", "term"])


def _sizes(spark: SparkSession, path: str) -> DataFrame:
    """(field, n_docs, avg_dl) of the live documents."""
    return batches.live(spark, path, batches.read(spark, path, "lengths", LENGTHS)).groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))


def _idf(n_docs: str, df: str) -> Column:
    return F.log(1 + (F.col(n_docs) - F.col(df) + 0.5) / (F.col(df) + 0.5))


def _gain(tf: str, dl: str) -> Column:
    return F.col(tf) * (K1 + 1) / (F.col(tf) + K1 * (1 - B + B * F.col(dl) / F.col("avg_dl")))


def _weights(fields: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for f, w in fields.items() for x in (f, float(w))]), F.col("field"))


def _pieces(batch_iter: Iterable[pa.RecordBatch], bounds: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    """(range, field, term, batch, ids, and, where the blocks have them, tfs and steps) of blocks, cut where a range of ids ends; ids are the first and the distances between the next, steps those of all documents."""
    for batch in batch_iter:
        listed = batch.column(3)
        if not len(listed):
            continue
        sizes, ids = np.diff(listed.offsets.to_numpy()), listed.flatten().to_numpy()
        block, ranges = np.repeat(np.arange(len(sizes)), sizes), np.searchsorted(bounds, ids, side="right").astype(np.int32)
        starts = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (ranges[1:] != ranges[:-1])]))
        at, heads = np.append(starts, len(ids)), pa.array(block[starts])
        gaps = np.diff(ids, prepend=0)
        gaps[starts] = ids[starts]
        columns = [pa.array(ranges[starts]), *(batch.column(i).take(heads) for i in range(3)), _lists(at, pa.array(gaps))]
        if "tfs" in names:
            tfs = batch.column(4).flatten()
            columns.append(_lists(at, tfs))
        if "steps" in names:
            columns.append(_lists(np.append(0, np.cumsum(tfs.to_numpy()))[at], batch.column(5).flatten().flatten()))
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _ranged(batch_iter: Iterable[pa.RecordBatch], bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batch_iter:
        at = np.searchsorted(bounds, batch.column(0).to_numpy(), side="right").astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), *batch.columns], names=["range", *batch.schema.names])


class _Range:
    """The live postings of a range of ids: documents are numbered from 0, in order of their ids."""

    def __init__(self, pieces: pa.Table, live: pa.Table) -> None:
        ids, batch, dl = (live.column(c).to_numpy() for c in ("id", "batch", "dl"))
        self.ids, first = np.unique(ids, return_index=True)
        self.lengths, fields = {}, live.column("field").to_numpy()
        for f in set(fields):
            self.lengths[f] = np.zeros(len(self.ids), np.int64)
            self.lengths[f][np.searchsorted(self.ids, ids[fields == f])] = dl[fields == f]
        whole = pieces.combine_chunks()
        self.columns = {c: whole.column(c).chunk(0) for c in whole.column_names} if whole.num_rows else {}
        if not whole.num_rows or not len(self.ids):
            self.columns, self.at, self.alive, self.rows = {}, np.zeros(1, np.int64), np.zeros(0, bool), {}
            return
        listed = self.columns["ids"]
        self.at = listed.offsets.to_numpy().astype(np.int64)
        sizes, flat = np.diff(self.at), np.cumsum(listed.flatten().to_numpy())
        own = flat - np.repeat(np.append(0, flat)[self.at[:-1] - self.at[0]], sizes)
        self.at = self.at - self.at[0]
        self.doc = np.minimum(np.searchsorted(self.ids, own), len(self.ids) - 1)
        self.alive = (self.ids[self.doc] == own) & (batch[first][self.doc] == np.repeat(self.columns["batch"].to_numpy(), sizes))
        self.rows = {}
        if "tfs" in self.columns:
            self.tf = self.columns["tfs"].flatten().to_numpy()
            for i, leaf in enumerate(zip(self.columns["field"].to_pylist(), self.columns["term"].to_pylist(), strict=True)):
                self.rows.setdefault(leaf, []).append(i)
        if "steps" in self.columns:
            self.steps, self.step_at = self.columns["steps"].flatten().to_numpy(), np.append(0, np.cumsum(self.tf, dtype=np.int64))

    def counts(self) -> pa.Table:
        """(field, term, df) of each piece."""
        found = np.append(0, np.cumsum(self.alive))[self.at]
        columns = [self.columns[c] for c in ("field", "term")] if self.columns else [pa.array([], pa.string())] * 2
        return pa.table([*columns, pa.array(np.diff(found))], names=["field", "term", "df"])

    def word(self, field: str, term: str) -> tuple[np.ndarray, np.ndarray]:
        """(documents, counts) of a word, in order."""
        at = np.concatenate([np.arange(self.at[i], self.at[i + 1]) for i in self.rows.get((field, term), ())] or [np.zeros(0, np.int64)])
        at = at[self.alive[at]]
        at = at[np.argsort(self.doc[at], kind="stable")]
        return self.doc[at], self.tf[at] if len(at) else np.zeros(0, np.int32)

    def places(self, field: str, term: str, width: int) -> np.ndarray:
        """document * width + position of all occurrences of a word, in order."""
        out = [np.zeros(0, np.int64)]
        for i in self.rows.get((field, term), ()):
            one, end = self.at[i], self.at[i + 1]
            tf, at = self.tf[one:end], self.step_at[one : end + 1]
            flat = np.cumsum(self.steps[at[0] : at[-1]], dtype=np.int64)
            found = np.repeat(self.doc[one:end], tf) * width + flat - np.repeat(np.append(0, flat)[at[:-1] - at[0]], tf)
            out.append(found[np.repeat(self.alive[one:end], tf)])
        return np.sort(np.concatenate(out))

    def phrase(self, field: str, terms: tuple[str, ...], kept: dict) -> tuple[np.ndarray, np.ndarray]:
        """(documents, counts) of words in a row."""
        width = int(self.lengths[field].max()) + len(terms) if field in self.lengths else 1
        lists = []
        for j, term in enumerate(terms):
            if (key := (field, term, width)) not in kept:
                kept[key] = self.places(field, term, width)
            lists.append(kept[key] - j)
        lists.sort(key=len)
        common = lists[0]
        for other in lists[1:]:
            if len(common):
                at = np.minimum(np.searchsorted(other, common), max(0, len(other) - 1))
                common = common[other[at] == common] if len(other) else other
        return np.unique(common // width, return_counts=True)


def _union(parts: list[np.ndarray]) -> np.ndarray:
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts or [np.zeros(0, np.int64)]))


def _held(some: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether the ordered ``rest`` has each of ``some``, and where."""
    if not len(rest):
        return np.zeros(len(some), bool), np.zeros(len(some), np.int64)
    at = np.minimum(np.searchsorted(rest, some), len(rest) - 1)
    return rest[at] == some, at


def _matches(own: _Range, asked: list[tuple], idfs: dict[tuple[str, str], float], means: dict[str, float], weights: dict[str, float], k: int) -> pa.Table:
    """(query, id, score) of the range's k best of each query; ``asked``: clauses (mark, terms, fields) of each. What a word or phrase adds to a document's score is reckoned once for all queries."""
    parts: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    kept: dict[tuple, np.ndarray] = {}

    def part(field: str, terms: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        if (key := (field, terms)) not in parts:
            known = all((field, t) in idfs for t in terms) and field in own.lengths
            docs, tf = (own.phrase(field, terms, kept) if len(terms) > 1 else own.word(field, terms[0])) if known else (np.zeros(0, np.int64),) * 2
            dl = own.lengths[field][docs] if known else docs
            gain = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / means.get(field, 1.0)))
            parts[key] = docs, weights[field] * sum(idfs.get((field, t), 0.0) for t in terms) * gain
        return parts[key]

    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for query, clauses_ in enumerate(asked):
        hits = [(mark, [part(f, terms) for f in fields]) for mark, terms, fields in clauses_]
        musts = sorted(([d for d, _ in x] for mark, x in hits if mark == "+"), key=lambda x: sum(map(len, x)))
        docs = _union(musts[0] if musts else [d for mark, x in hits if mark != "-" for d, _ in x])
        for other in musts[1:]:
            docs = docs[np.logical_or.reduce([_held(docs, d)[0] for d in other])]
        for mark, x in hits:
            if mark == "-" and len(docs):
                docs = docs[~np.logical_or.reduce([_held(docs, d)[0] for d, _ in x])]
        if not len(docs):
            continue
        scores = np.zeros(len(docs))
        for mark, x in hits:
            for d, s in x if mark != "-" else ():
                has, at = _held(docs, d)
                scores[has] += s[at[has]]
        scores = np.round(scores, 6)
        if len(docs) > k:
            best = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
            docs, scores = docs[best], scores[best]
        best = np.lexsort((docs, -scores))[:k]
        found.append((query, docs[best], scores[best]))
    n = [len(d) for _, d, _ in found]
    docs, scores = (np.concatenate([x[i] for x in found]) if found else np.zeros(0, kind) for i, kind in ((1, np.int64), (2, float)))
    return pa.table([pa.array(np.repeat(np.array([q for q, _, _ in found], np.int32), n)), pa.array(own.ids[docs]), pa.array(scores)], names=["asked", "id", "score"])


def find(spark: SparkSession, path: str, queries: DataFrame, k: int, fields: dict[str, float], *, tokens=words) -> DataFrame:
    """(query, id, score, rank) of the k best documents of each of ``queries`` (query, text); ``fields``: the weight of each field that may be searched."""
    return search.in_blocks(queries, lambda block: _find(spark, path, _wanted(block, fields, tokens), k, fields), QUERY_BLOCK)


def _find(spark: SparkSession, path: str, wanted: DataFrame, k: int, fields: dict[str, float]) -> DataFrame:
    """Ranges of ids are searched by a task each, with all of the block's queries; only a range's k best of each different query leave it, so no pair of a query and a document that isn't among them is ever a row."""
    wanted = written(wanted, "wanted")
    by_clause: dict[tuple, dict[str, list]] = {}
    for r in wanted.orderBy("j").collect():  # a block of queries
        by_clause.setdefault((r["query"], r["clause"], r["mark"]), {}).setdefault(r["field"], []).append(r["term"])
    by_query: dict[object, list] = {}
    for (query, _, mark), of in by_clause.items():
        by_query.setdefault(query, []).append((mark, tuple(next(iter(of.values()))), tuple(sorted(of))))
    different: dict[tuple, int] = {}
    names = [(query, different.setdefault(tuple(sorted(c)), len(different))) for query, c in by_query.items()]
    named = spark.createDataFrame(names, StructType([wanted.schema["query"], StructField("asked", IntegerType())]))
    live = written(batches.live(spark, path, batches.read(spark, path, "lengths", LENGTHS)).select("id", "field", "dl", "batch"), "live")
    sizes = live.groupBy("field").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"), F.sum("dl").alias("n")).collect()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(r["n"] for r in sizes) // RANGE_WORDS))
    cuts = live.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10_000).alias("c")).head()["c"] if n > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))
    docs = live.mapInArrow(lambda b: _ranged(b, bounds), "range int, id long, field string, dl int, batch long").groupBy("range")

    def together(columns: str, lists: str):
        """Pieces of the blocks' ``columns`` beside the live documents of their range."""
        head = "field string, term string"
        blocks = _blocks(spark, path, wanted, f"{head}, {columns}, bucket int").select("field", "term", "batch", *[c.split()[0] for c in columns.split(", ")])
        schema = f"range int, {head}, batch long, {lists}"
        cut = blocks.mapInArrow(lambda b: _pieces(b, bounds, [c.split()[0] for c in schema.split(", ")]), schema)
        return cut.groupBy("range").cogroup(docs)

    counted = together("ids array<long>", "ids array<long>").applyInArrow(lambda p, d: _Range(p, d).counts(), "field string, term string, df long")
    known = written(counted.groupBy("field", "term").agg(F.sum("df").alias("df")).where("df > 0"), "counted").collect()  # of a block's words
    totals, means = {r["field"]: r["n_docs"] for r in sizes}, {r["field"]: r["avg_dl"] for r in sizes}
    idfs = {(r["field"], r["term"]): math.log(1 + (totals[r["field"]] - r["df"] + 0.5) / (r["df"] + 0.5)) for r in known}
    shared = spark.sparkContext.broadcast((list(different), idfs))
    positions = any(len(terms) > 1 for c in different for _, terms, _ in c)
    both = together("ids array<long>, tfs array<int>" + (", steps array<array<int>>" if positions else ""), "ids array<long>, tfs array<int>" + (", steps array<int>" if positions else ""))
    found = both.applyInArrow(lambda p, d: _matches(_Range(p, d), *shared.value, means, fields, k), "asked int, id long, score double")
    best = written(search.top(found, k, by="asked"), "best")
    return best.join(named, "asked").select("query", "id", "score", "rank")


# The k best without all blocks


def needed_blocks(spark: SparkSession, path: str, wanted: DataFrame, k: int, fields: dict[str, float]) -> DataFrame:
    """(query, field, term, times, batch, first, n, idf, avg_dl, needed): all blocks of each query's terms, and whether they can hold one of its k best.

    A block's bound is its largest gain, which was reckoned by the batch's mean length: where that has become larger by a factor, gains grow by that factor at most. Ids are cut into ranges; a range's bound is the sum over the query's terms of
    their largest bound there. The documents of each query's best ranges are scored first: their kth score is at most that of the whole. A document that beats it lies, with all
    of its blocks, where the block's bound and the other terms' largest ones together reach it, so the blocks that don't reach it anywhere are not read.
    """
    heads = written(_blocks(spark, path, wanted, HEADS), "heads")
    ids = batches.live(spark, path, _blocks(spark, path, wanted, "field string, term string, ids array<long>, bucket int").select("field", "term", "batch", F.explode("ids").alias("id")))
    known = written(ids.groupBy("field", "term").agg(F.count("*").alias("df")).join(_sizes(spark, path), "field").withColumn("idf", _idf("n_docs", "df")).select("field", "term", "idf", "avg_dl"), "known")
    bounded = heads.join(known, ["field", "term"]).withColumn("bound", _weights(fields) * F.col("idf") * F.col("gain") * F.greatest(F.lit(1.0), F.col("avg_dl") / F.col("mean")))
    span = heads.agg(F.min("first").alias("low"), F.max("last").alias("high")).head()
    low, width = span["low"] or 0, max(1, -(-((span["high"] or 0) - (span["low"] or 0) + 1) // RANGES))
    place = [F.floor((F.col(c) - low) / width) for c in ("first", "last")]
    spread = bounded.select("field", "term", "batch", "first", "n", "bound", F.explode(F.sequence(*place)).alias("range"))
    leaves = wanted.groupBy("query", "field", "term").agg(F.count("*").alias("times"))
    most = spread.groupBy("field", "term", "range").agg(F.max("bound").alias("most"))
    by_range = written(most.join(leaves, ["field", "term"]).withColumn("most", F.col("times") * F.col("most")), "ranges")
    sums = by_range.groupBy("query", "range").agg(F.sum("most").alias("sum"))
    best = search.top(sums, FIRST_RANGES, score="sum", ident="range").select("query", "range")
    asked = written(spread.join(by_range, ["field", "term", "range"]).withColumn("bound", F.col("times") * F.col("bound")).join(sums, ["query", "range"]), "asked")
    early = asked.join(best, ["query", "range"]).select("query", "field", "term", "times", "batch", "first").distinct()
    scored = _scores(spark, path, early.join(known, ["field", "term"]), fields)
    inside = scored.withColumn("range", F.floor((F.col("id") - low) / width)).join(best, ["query", "range"])
    kth = search.top(inside.select("query", "id", "score"), k).where(F.col("rank") == k).select("query", F.col("score").alias("kth"))
    reach = asked.join(kth, "query", "left").groupBy("query", "field", "term", "times", "batch", "first", "n").agg(F.max(F.col("sum") - F.col("most") + F.col("bound") - F.coalesce("kth", F.lit(0.0))).alias("over"))
    return reach.join(known, ["field", "term"]).select("query", "field", "term", "times", "batch", "first", "n", "idf", "avg_dl", (F.col("over") >= -1e-5).alias("needed"))


def _scores(spark: SparkSession, path: str, chosen: DataFrame, fields: dict[str, float]) -> DataFrame:
    """(query, id, score) over the ``chosen`` blocks (query, field, term, times, batch, first, idf, avg_dl)."""
    chosen = written(chosen, "chosen")
    blocks = _blocks(spark, path, chosen, POSTINGS.replace("steps array<array<int>>, ", "")).join(chosen.select("field", "term", "batch", "first").distinct(), ["field", "term", "batch", "first"], "left_semi")
    rows = _rows(spark, path, blocks.withColumn("block", F.col("first")), positions=False)
    each = rows.join(chosen.withColumnRenamed("first", "block"), ["field", "term", "block"]).withColumn("part", F.col("times") * _weights(fields) * F.col("idf") * _gain("tf", "dl"))
    return each.groupBy("query", "id").agg(F.round(F.sum("part"), 6).alias("score"))


def find_best(spark: SparkSession, path: str, queries: DataFrame, k: int, fields: dict[str, float], *, tokens=words) -> DataFrame:
    """As ``find``, for queries of plain words (no marks or phrases), reading only blocks that can hold one of the k best."""

    def run(block: DataFrame) -> DataFrame:
        wanted = written(_wanted(block, fields, tokens).where("mark = '' and n_terms = 1"), "wanted")
        blocks = written(needed_blocks(spark, path, wanted, k, fields), "needed-blocks")
        return search.top(_scores(spark, path, blocks.where("needed").drop("needed", "n"), fields), k)

    return search.in_blocks(queries, run)
