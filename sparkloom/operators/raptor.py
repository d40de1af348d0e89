"""Summary trees over documents' chunks: clusters of chunk vectors, a summary for each, clusters of these; and retrieval over all levels."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions import models, vectors
from sparkloom.operators.ordered import with_row_number
from sparkloom.operators.search import top
from sparkloom.sources.tables import beside, written

LEVELS, MOST_CLUSTERS, LEAST_MEMBERS, ROUNDS, UNSURE, CLUSTER_BYTES = 2, 10, 3, 20, -1.5, 4000
#: Items of a document that are one row while they're clustered.
BLOCK = 1_024
ASSIGNED = "doc_id long, id long, cluster int"


def k_means(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Clusters by dot product, from the first k rows; the lower number on a tie; an emptied cluster keeps its centre."""
    centres, now = x[:k].astype(float), np.zeros(len(x), int)
    for _ in range(rounds):
        new = np.argmax(np.round(x @ centres.T, 6), axis=1)
        if (new == now).all():
            break
        now = new
        for c in np.unique(now):
            centres[c] = x[now == c].mean(axis=0)
    return now


def n_clusters(n: int) -> int:
    return min(MOST_CLUSTERS, max(1, n // 3))


def confidence(summary: Column) -> Column:
    """-2 for a short summary that speaks of the document, -0.5 for a long one, else -1."""
    n = F.size(F.regexp_extract_all(summary, F.lit(r"(\S+)"), 1))
    return F.when((n < 15) & summary.contains("document"), -2.0).when(n > 30, -0.5).otherwise(-1.0)


def clusters(items: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(doc_id, id, cluster) of (doc_id, id, vector), each document on its own; documents that give one cluster are left out.

    A document's items go in blocks of up to ``block``, a row each, so one of any size spreads over tasks. A document of one block is clustered where its row is; larger ones take part in a loop
    for all of them at once: each round a block meets its document's centres, is assigned by one matrix product, and gives a sum a cluster; a document leaves the loop when none of its items moves.
    """
    numbered = with_row_number(items.select("doc_id", "id", "vector"), ["doc_id"], ["id"], "row")
    part = F.floor((F.col("row") - 1) / block)
    parts = numbered.groupBy("doc_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("row", "id", F.col("vector").cast("array<double>").alias("vector")))).alias("rows"))
    sizes = items.groupBy("doc_id").agg(F.count("*").alias("n"))  # not by row numbers, which would be made twice
    k = F.least(F.lit(MOST_CLUSTERS), F.greatest(F.lit(1), F.floor(F.col("n") / 3))).cast("int")
    blocks = written(parts.join(sizes.withColumn("k", k).where("k > 1"), "doc_id").select("doc_id", "part", "n", "k", F.transform("rows", lambda r: r["id"]).alias("ids"), F.transform("rows", lambda r: r["vector"]).alias("vectors")), "blocks")
    alone, shared = blocks.where(F.col("n") <= block), blocks.where(F.col("n") > block)
    out = alone.select("doc_id", "ids", "vectors", "k").mapInArrow(_alone, ASSIGNED)
    if shared.isEmpty():
        return out
    placed = shared.select("doc_id", "ids", "vectors").join(_centres(shared), "doc_id").select("doc_id", "ids", "vectors", "centres")
    return out.unionByName(placed.mapInArrow(_placed, ASSIGNED))


def _matrix(lists: pa.Scalar) -> np.ndarray:
    """A list of lists as a matrix."""
    rows = lists.values
    return rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)


def _labelled(batch: pa.RecordBatch, labels: list[np.ndarray]) -> pa.RecordBatch:
    ids = batch.column(1)
    docs = batch.column(0).take(pa.array(np.repeat(np.arange(batch.num_rows), pc.list_value_length(ids).to_numpy())))
    return pa.RecordBatch.from_arrays([docs, ids.flatten(), pa.array(np.concatenate(labels).astype(np.int32))], names=["doc_id", "id", "cluster"])


def _alone(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _labelled(batch, [k_means(_matrix(v), k.as_py()) for v, k in zip(batch.column(2), batch.column(3), strict=True)])


def _assigned(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmax(np.round(x @ centres.T, 6), axis=1)


def _placed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield _labelled(batch, [_assigned(_matrix(v), _matrix(c)) for v, c in zip(batch.column(2), batch.column(3), strict=True)])


def _sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, cluster, n, sums, moved) of blocks (doc_id, vectors, centres, before): what each cluster gets of a block, and whether an item went elsewhere than by the centres before."""
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.bool_())
    for batch in batches:
        rows: list[tuple] = []
        for doc, vectors_of, centres, before in zip(*batch.columns, strict=True):
            x = _matrix(vectors_of)
            now = _assigned(x, _matrix(centres))
            moved = bool((now != (_assigned(x, _matrix(before)) if before.is_valid else 0)).any())
            rows += [(doc.as_py(), c, int((now == c).sum()), x[now == c].sum(axis=0).tolist(), moved) for c in np.unique(now).tolist()]
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True) if rows else [()] * 5, kinds, strict=True)], names=["doc_id", "cluster", "n", "sums", "moved"])


def _centres(blocks: DataFrame) -> DataFrame:
    """(doc_id, centres) by which the documents' items are assigned in the end: from the first k items, at most ``ROUNDS`` times moved to their clusters' means."""
    now = written(blocks.where("part = 0").select("doc_id", F.slice("vectors", 1, F.col("k")).alias("centres"), F.lit(None).cast("array<array<double>>").alias("before")), "centres")
    done = now.select("doc_id", "centres").limit(0)
    for n in range(ROUNDS):
        sums = written(blocks.join(now, "doc_id").select("doc_id", "vectors", "centres", "before").mapInArrow(_sums, "doc_id long, cluster int, n long, sums array<double>, moved boolean"), "sums")
        moved = sums.groupBy("doc_id").agg(F.bool_or("moved").alias("moved"))
        state = now.join(moved, "doc_id")
        done = done.unionByName(state.where(~F.col("moved") | F.lit(n == ROUNDS - 1)).select("doc_id", "centres"))
        going = state.where(F.col("moved") & F.lit(n < ROUNDS - 1)).select("doc_id", "centres")
        flat = sums.select("doc_id", "cluster", "n", F.posexplode("sums").alias("d", "x")).groupBy("doc_id", "cluster", "d").agg((F.sum("x") / F.sum("n")).alias("m"))
        means = flat.groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("d", "m"))).alias("c")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("cluster", F.transform("c", lambda s: s["m"])))).alias("means"))
        moved_on = F.transform("centres", lambda c, i: F.coalesce(F.col("means")[i], c))  # an emptied cluster keeps its centre
        now = written(going.join(means, "doc_id").select("doc_id", moved_on.alias("next"), F.col("centres").alias("before")).withColumnRenamed("next", "centres"), "centres")
        if now.isEmpty():
            break
    return done


def joined_texts(text: str = "text", by: str = "id", most: int | None = CLUSTER_BYTES) -> Column:
    """Members numbered and joined, cut at ``most`` bytes; whole with None."""
    from sparkloom.functions.text import prefix_of_bytes

    parts = F.array_sort(F.collect_list(F.struct(by, text)))
    whole = F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(":\n"), p[text])), "\n\n")
    if most is None:
        return whole
    return F.when(F.octet_length(whole) <= most, whole).otherwise(F.concat(prefix_of_bytes(whole, most), F.lit("\n[truncated...]")))


def tree(chunks: DataFrame) -> DataFrame:
    """Nodes (doc_id, level, id, summary, confidence, child_ids, vector) over (doc_id, id, text, vector). Level 1 stands on chunks, level 2 on level 1."""
    level, out = chunks.select("doc_id", "id", "text", "vector"), None
    for depth in range(1, LEVELS + 1):
        members = clusters(level.select("doc_id", "id", "vector")).join(level, ["doc_id", "id"])
        by = members.groupBy("doc_id", "cluster").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("parts"))
        by = by.where(F.size("parts") >= LEAST_MEMBERS).select("doc_id", "cluster", F.transform("parts", lambda p: p["id"]).alias("child_ids"), F.array_join(F.transform("parts", lambda p: models.run("summarize", p["text"])), " ").alias("summary"))
        nodes = by.select("doc_id", F.lit(depth).alias("level"), (F.lit(depth) * 1_000_000 + F.col("cluster")).cast("long").alias("id"), "summary", confidence(F.col("summary")).alias("confidence"), "child_ids", models.run("embed", F.col("summary")).alias("vector"))
        nodes = written(nodes, "nodes")  # read by the next level, twice, and by the result
        out = nodes if out is None else out.unionByName(nodes)
        level = nodes.select("doc_id", "id", F.col("summary").alias("text"), "vector")
    return out


def retrieve(nodes: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query, doc_id, level, id, score): the k nearest nodes of each query's document (query, doc_id, vector); an unsure one is replaced by its children, which keep its score."""
    near = nodes.join(queries.select("query", "doc_id", F.col("vector").alias("qv")), "doc_id")
    best = top(near.select("query", "doc_id", "level", "id", "confidence", "child_ids", F.round(vectors.dot(F.col("vector"), F.col("qv")), 6).alias("score")), k)
    sure = best.where(F.col("confidence") >= UNSURE).select("query", "doc_id", "level", "id", "score")
    children = best.where(F.col("confidence") < UNSURE).select("query", "doc_id", (F.col("level") - 1).alias("level"), F.explode("child_ids").alias("id"), "score")
    children = beside(children, "children")
    known = chunks.select("doc_id", F.lit(0).alias("level"), "id").unionByName(nodes.select("doc_id", "level", "id"))
    return sure.unionByName(children.join(known, ["doc_id", "level", "id"]).select("query", "doc_id", "level", "id", "score"))
