"""N-gram Jaccard join by MinHash banding.

Documents of equal word sequences are one class. The classes are shuffled by their band hashes, those that share a band are verified on their full n-gram
sets (``similar``), and verified links hang together in components. Bands and rows are the longest rows that reach the stated recall at the similarity.

Defined cases: a null text is empty; a text without words is linked to nothing; one of fewer than n words, but not none, has them all as its
single n-gram; repeated rows are documents of their own and copies of each other; a row with a null id has null class_id and copy_of and no links; other columns
aren't read unless they are to be carried along.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import WORD_STEP_BYTES, steps, stored, text_bytes
from sparkloom.llm.similar import SETS, links
from sparkloom.llm.words import GRAM_WORDS, Bands, band_keys, bands_for, grams_of, span_pairs, words_of

SIMILARITY, RECALL, MOST_HASHES = 0.8, 0.9999, 128


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _signatures(docs: DataFrame, n: int, bands: Bands, text_col: str) -> DataFrame:
    """The columns of ``docs`` but for the text, h1, h2 (hashes of all words), n_words, n_grams, bands."""
    kept = [c for c in docs.columns if c != text_col]
    place = docs.columns.index(text_col)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(place))
            for i, j in steps(offsets, WORD_STEP_BYTES):
                words = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                grams = grams_of(words, n=n)
                keys = band_keys(grams, bands)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1) * bands.bands, pa.int32()), _signed(keys.reshape(-1)))
                h1, h2 = span_pairs(words, words.first[:-1], words.first[1:])
                own = [batch.column(c).slice(i, j - i) for c in kept]
                yield pa.RecordBatch.from_arrays([*own, _signed(h1), _signed(h2), pa.array(np.diff(words.first)), pa.array(np.diff(grams.first)), listed], names=[*kept, "h1", "h2", "n_words", "n_grams", "bands"])

    types = dict(docs.dtypes)
    return docs.mapInArrow(run, ", ".join(f"`{c}` {types[c]}" for c in kept) + ", h1 long, h2 long, n_words long, n_grams long, bands array<long>")


def _sets(texts: DataFrame, n: int) -> DataFrame:
    """Texts of classes' first documents to their n-gram sets; a row whose words are others than its class's (repeated ids) goes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            h1, h2 = (batch.column(c).to_numpy() for c in ("h1", "h2"))
            for i, j in steps(offsets, WORD_STEP_BYTES):
                words = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                grams = grams_of(words, n=n)
                own = span_pairs(words, words.first[:-1], words.first[1:])
                same = (own[0].view(np.int64) == h1[i:j]) & (own[1].view(np.int64) == h2[i:j])
                sets = [np.unique(grams.values[a:b]).tobytes() if keep else b"" for a, b, keep in zip(grams.first[:-1], grams.first[1:], same, strict=True)]
                rest = [batch.column(c).slice(i, j - i) for c in ("node", "weight", "bands", "work")]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(sets, pa.binary())], names=["node", "weight", "bands", "work", "grams"]).filter(pa.array(same))

    return texts.mapInArrow(run, SETS)


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = GRAM_WORDS, similarity: float = SIMILARITY, recall: float = RECALL, most_hashes: int = MOST_HASHES, carry: Sequence[str] = ()) -> DataFrame:
    """A row per document: doc_id, class_id (the smallest doc_id that it is linked to through any chain of links, or its own), n_links (documents
    of Jaccard similarity ``similarity`` or more with it, copies included), copy_of (the smallest doc_id with its very words), n_words, class_key (a number of the
    class, null without words or id, which tells classes of one class_id apart where ids repeat), and the columns to ``carry``."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(f"`{c}`") for c in carry], F.col(text_col).alias("__text"))
    signed = stored(_signatures(docs, n, bands_for(similarity, recall, most_hashes), "__text"), "signatures")
    worded = signed.where("n_words > 0 and doc_id is not null")
    # Numbered when written, once for all.
    classes = stored(worded.groupBy("h1", "h2").agg(F.min("doc_id").alias("copy_of"), F.count("*").alias("weight"), F.first("n_grams").alias("n_grams"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()), "classes")

    def sets(members: DataFrame) -> DataFrame:
        wanted = members.join(classes.select("node", "h1", "h2", "weight", "bands", F.col("copy_of").alias("doc_id")), "node")
        return _sets(docs.select("doc_id", F.col("__text").alias("text")).join(wanted, "doc_id").select("text", "node", "h1", "h2", "weight", "bands", "work"), n)

    found = links(classes, sets, similarity, "links")
    linked = found.join(classes.select("node", "copy_of"), "node").withColumnRenamed("weight", "linked")
    names = linked.groupBy("label").agg(F.min("copy_of").alias("class_id"))
    linked = linked.join(names, "label").select("node", F.col("label").alias("class_key"), "class_id", "linked")
    # Written, so that the join below has a shuffle on both sides, whose hot classes Spark can split.
    by_class = stored(classes.select("node", "h1", "h2", "copy_of", "weight").join(linked, "node", "left").withColumn("class_key", F.coalesce("class_key", "node")).drop("node"), "by-class")
    known = signed.drop("bands", "n_grams").withColumn("k", F.when(F.col("doc_id").isNotNull(), F.col("h1")))
    out = known.drop("h1").join(by_class.withColumnRenamed("h1", "k"), ["k", "h2"], "left")
    return out.select(
        "doc_id",
        F.coalesce("class_id", "copy_of", "doc_id").alias("class_id"),
        (F.coalesce(F.col("weight") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("copy_of", "doc_id").alias("copy_of"),
        "n_words",
        "class_key",
        *[F.col(f"`{c}`") for c in carry],
    )
