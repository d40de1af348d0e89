"""Stored indexes that grow by batches: postings by term bucket for BM25, int8 vectors by cell for vector search.

An index is a folder of tables that grow by committed batches (``batches``). Documents are replaced or deleted by their ids. Searches read the buckets or cells that
their queries need, by partition pruning.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import vectors
from sparkloom.functions.text import words
from sparkloom.operators import batches, search
from sparkloom.sources.tables import written

#: Buckets of terms; documents of a batch for each task that writes one bucket or cell.
BUCKETS, ROWS_A_PART = 64, 500_000


def _bucket(term: str, n: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(n)).cast("int")


def _part(spark: SparkSession, path: str, name: str, batch: int) -> Column:
    """By which the rows of one bucket or cell are spread: a task for each ``ROWS_A_PART`` documents of the batch, whose ids table ``name`` has."""
    n = spark.read.parquet(f"{path}/{name}/batch={batch}").count()
    return F.pmod(F.xxhash64("id"), F.lit(-(-n // ROWS_A_PART) or 1))


def delete(spark: SparkSession, path: str, ids: DataFrame, ident: str = "id") -> None:
    """Ends all rows of some ids, of either kind of index."""
    batch = batches.next_batch(spark, path)
    batches.put(ids.select(F.col(ident).cast("long").alias("id")).distinct(), path, "gone", batch)
    batches.commit(spark, path, batch)


# Full text


def add_texts(docs: DataFrame, path: str, *, ident: str = "doc_id", text: str = "text", tokens=words, buckets: int = BUCKETS) -> None:
    """Adds documents, in place of those of the same ids; their words are counted once, where they're read, and only the counts are shuffled, by bucket. Documents that share an id are one, by a shuffle of theirs."""
    spark = docs.sparkSession
    batch = batches.next_batch(spark, path)
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"))
    ids = written(rows.groupBy("id").agg(F.count("*").alias("n")), "ids")
    batches.put(ids.select("id"), path, "gone", batch)
    batches.put(rows.select("id", F.size(tokens(F.coalesce("text", F.lit("")))).alias("dl")), path, "lengths", batch)
    shared = ids.where("n > 1").select(F.col("id").alias("shared"))
    if shared.isEmpty():
        found = search.counted(rows, "id", F.col("text"), tokens)
    else:
        same = F.col("id").eqNullSafe(F.col("shared"))
        found = search.counted(rows.join(shared, same, "left_anti"), "id", F.col("text"), tokens).unionByName(search.postings(rows.join(shared, same, "left_semi"), "id", F.col("text"), tokens))
    found = found.withColumn("bucket", _bucket("term", buckets))
    batches.put(found.withColumn("part", _part(spark, path, "lengths", batch)), path, "postings", batch, "bucket", "part")
    batches.commit(spark, path, batch)


def find_texts(spark: SparkSession, path: str, queries: DataFrame, k: int, *, tokens=words, buckets: int = BUCKETS) -> DataFrame:
    """(query, id, score, rank) of BM25 for ``queries`` (query, text)."""
    size = batches.live(spark, path, batches.read(spark, path, "lengths", "id long, dl int")).where("dl > 0").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))

    def run(block: DataFrame) -> DataFrame:
        wanted = block.select("query", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
        terms = wanted.select("term").distinct().withColumn("bucket", _bucket("term", buckets))
        needed = [r["bucket"] for r in terms.select("bucket").distinct().collect()]  # at most all buckets
        read = batches.read(spark, path, "postings", "term string, id long, tf long, dl int, bucket int").where(F.col("bucket").isin(needed))
        found = search.written(batches.live(spark, path, read.join(F.broadcast(terms.select("term")), "term")).select("term", "id", "tf", "dl"), "found")
        return search.scored(found, size, wanted, k)

    return search.in_blocks(queries, run)


def terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, df, cf) of the live documents; a bucket's terms are its own."""
    live = batches.live(spark, path, batches.read(spark, path, "postings", "term string, id long, tf long, dl int, bucket int"))
    return live.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


# Vectors


def start_cells(centroids: DataFrame, path: str) -> None:
    """A new vector index around ``centroids`` (cell, c), as ``search.cells`` gives them."""
    centroids.select(F.col("cell").cast("int"), F.col("c").cast("array<double>")).write.mode("overwrite").parquet(f"{path}/centroids")


def add_vectors(rows: DataFrame, path: str, *, ident: str = "vec_id", vector: str = "embedding") -> None:
    """Adds vectors, in place of those of the same ids: each goes to the cell of its nearest centroid, as int8 with a scale."""
    spark = rows.sparkSession
    batch = batches.next_batch(spark, path)
    own = rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("vector"))
    batches.put(own.select("id").distinct(), path, "gone", batch)
    placed = search.assigned(own, spark.read.parquet(f"{path}/centroids")).select("id", "cell", vectors.quantized(F.col("vector")).alias("z"))
    members = placed.select("id", F.col("z.q").alias("q"), "z.scale", "cell")
    batches.put(members.withColumn("part", _part(spark, path, "gone", batch)), path, "members", batch, "cell", "part")
    batches.commit(spark, path, batch)


def find_vectors(spark: SparkSession, path: str, queries: DataFrame, k: int, *, probes: int = search.PROBES) -> DataFrame:
    """(query, id, score, rank) of a quantized search in the ``probes`` nearest cells of each query (query, vector); other cells aren't read."""
    centroids = spark.read.parquet(f"{path}/centroids")

    def run(block: DataFrame) -> DataFrame:
        probed = search.written(search.probed(block, centroids, probes), "probed")
        needed = [r["cell"] for r in probed.select("cell").distinct().collect()]  # at most all cells
        read = batches.read(spark, path, "members", "id long, q array<tinyint>, scale double, cell int").where(F.col("cell").isin(needed))
        live = batches.live(spark, path, read)
        return search.top(search.in_cells(live.select("id", F.col("q").alias("v"), "scale", "cell"), probed, k), k)

    return search.in_blocks(queries, run)


def compacted(spark: SparkSession, path: str, to: str, names: Iterable[str] = ("postings", "lengths", "members")) -> None:
    """The live rows of an index as the one batch of a new one."""
    schemas = {"postings": "term string, id long, tf long, dl int, bucket int", "lengths": "id long, dl int", "members": "id long, q array<tinyint>, scale double, cell int"}
    for name in names:
        if any(batches.exists(spark, f"{path}/{name}/batch={b}") for b in batches.committed(spark, path)):
            batches.put(batches.live(spark, path, batches.read(spark, path, name, schemas[name])).drop("batch"), to, name, 1, {"postings": "bucket", "members": "cell"}.get(name))
    if batches.exists(spark, f"{path}/centroids"):
        spark.read.parquet(f"{path}/centroids").write.mode("overwrite").parquet(f"{to}/centroids")
    batches.commit(spark, to, 1)
