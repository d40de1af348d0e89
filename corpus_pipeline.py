"""The corpus pipeline: documents through language ID, near-duplicate removal, substring dedup, decontamination and packing.

Each stage takes what its predecessor kept, written as Parquet and read again; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, jaccard, language, packing, passages
from sparkloom.llm.common import small_batches, stored
from sparkloom.llm.queries import tokenizer_file


def _whole(docs: DataFrame) -> Column:
    """All columns as one, so that none can clash with what a stage adds."""
    return F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language of ``lang``; rows without text or letters go, those between two languages stay."""
    small_batches(spark)
    model = language.train(docs, docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("label")))
    # Under other names, so that none can clash with what is added and the text goes to Python once.
    names = [f"c{i}" for i in range(len(docs.columns))]
    found = language.predict(docs.toDF(*names), model, text_col=names[docs.columns.index("text")])
    return found.where(F.col("lang_pred") != language.UNKNOWN).select(*names).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest id; rows without an id or words stay, and rows of one id and text are one document."""
    small_batches(spark)
    # Under other names, so that no column can clash with what is added.
    names = [f"c{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("digest"))
    joined = stored(jaccard.join(texts, carry=["digest"]).where("class_key is not null").select("class_key", F.struct("doc_id", "digest").alias("row")), "near-duplicates")
    # Written, so that the join below has a shuffle on both sides, whose hot classes Spark can split.
    first = stored(joined.groupBy("class_key").agg(F.min("row").alias("first")), "first-rows")
    gone = joined.join(first, "class_key").where("row <> first").select(F.col("row.doc_id").alias("id"), F.col("row.digest").alias("gone")).distinct()
    rows = docs.toDF(*names).withColumn("digest", F.xxhash64(text))
    same = (F.col(key) == F.col("id")) & (F.col("digest") == F.col("gone"))
    kept = rows.join(gone, same, "left_anti")
    again = stored(joined.groupBy("row").count().where("count > 1").select(F.col("row.doc_id").alias("id"), F.col("row.digest").alias("gone")), "repeated-rows")
    if not again.isEmpty():
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([key, "digest"]))
    return kept.select(*names).toDF(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document of smaller id keeps; n_chars follows the text."""
    small_batches(spark)
    cut = passages.rewritten(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    small_batches(spark)
    found = decontaminate.scan(docs.select(_whole(docs), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="row")
    return found.where("not contaminated").select("doc_id.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens."""
    small_batches(spark)
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("decontamination", benchmark_decontamination),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs


#: Language models, MinHash and bin packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None
