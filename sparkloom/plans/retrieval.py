"""Registered queries over retrieval operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import vectors
from sparkloom.operators import search
from sparkloom.sources.tables import table

#: The stated query set: every vector, or benchmark item, whose id is divisible by this.
EVERY = 100
K = 5


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings")


def _query_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).where(F.col("vec_id") % EVERY == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").where(F.col("item_id") % EVERY == 0).select(F.col("item_id").alias("query"), "text")


def vector_topk_dot(spark: SparkSession, sf: str) -> DataFrame:
    return search.nearest(_vectors(spark, sf), _query_vectors(spark, sf), K)


def vector_topk_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return search.nearest(_vectors(spark, sf), _query_vectors(spark, sf), K, similarity="cosine")


def vector_topk_int8(spark: SparkSession, sf: str) -> DataFrame:
    return search.nearest_quantized(_vectors(spark, sf), _query_vectors(spark, sf), K)


def vector_threshold(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest, then those of them above the threshold: media search takes its k first and has no more than these."""
    return search.nearest(_vectors(spark, sf), _query_vectors(spark, sf), 10).where("score >= 0.5")


def vector_quantize(spark: SparkSession, sf: str) -> DataFrame:
    z = _vectors(spark, sf).select("vec_id", vectors.quantized(F.col("embedding")).alias("z"))
    return z.select("vec_id", F.array_join(F.transform("z.q", lambda x: x.cast("string")), ",").alias("q"), F.round("z.scale", 9).alias("scale"))


def vector_roundtrip_error(spark: SparkSession, sf: str) -> DataFrame:
    z = _vectors(spark, sf).select("vec_id", "embedding", vectors.quantized(F.col("embedding")).alias("z"))
    back = vectors.dequantized(F.col("z.q"), F.col("z.scale"))
    error = F.array_max(F.zip_with("embedding", back, lambda a, b: F.abs(a.cast("double") - b)))
    return z.select("vec_id", F.round(error, 6).alias("max_error"), (error <= F.col("z.scale") / 2 + 1e-9).alias("within_half_step"))


def index_memory(spark: SparkSession, sf: str) -> DataFrame:
    return _vectors(spark, sf).agg(F.count("*").alias("n"), F.sum(F.size("embedding") * 4).alias("float_bytes"), F.sum(F.size("embedding") + 4).alias("int8_bytes"))


def _label_means(spark: SparkSession, sf: str) -> DataFrame:
    return search.means(_vectors(spark, sf).select(F.col("label").alias("cell"), F.col("embedding").alias("vector")))


def centroid_update_step(spark: SparkSession, sf: str) -> DataFrame:
    return _label_means(spark, sf).select("cell", F.posexplode("c").alias("d", "m"))


def kmeans_assign_step(spark: SparkSession, sf: str) -> DataFrame:
    return search.assigned(_vectors(spark, sf).select("vec_id", F.col("embedding").alias("vector")), _label_means(spark, sf)).select("vec_id", "cell")


def ivf_search(spark: SparkSession, sf: str) -> DataFrame:
    """Cells around the label means; the four nearest are probed."""
    centroids = _label_means(spark, sf)
    members = search.assigned(_vectors(spark, sf).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), centroids)
    return search.search_cells(members, centroids, _query_vectors(spark, sf), K)


def ivf_kmeans(spark: SparkSession, sf: str) -> DataFrame:
    """Cell sizes of a full k-means."""
    members, _ = search.cells(_vectors(spark, sf))
    return members.groupBy("cell").agg(F.count("*").alias("n"))


def ivf_search_wide(spark: SparkSession, sf: str) -> DataFrame:
    """k-means cells, twelve of them probed, the best put in order by full vectors: recall over 0.9."""
    members, centroids = search.cells(_vectors(spark, sf))
    return search.search_cells(members, centroids, _query_vectors(spark, sf), K, probes=12, rescored=4)


def ivf_cell_count(spark: SparkSession, sf: str) -> DataFrame:
    n = _vectors(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return n.select("label", "n", search.n_cells(F.col("n")).cast("long").alias("cells"))


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return search.bm25(_docs(spark, sf), _questions(spark, sf), K)


def bm25_doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    from sparkloom.functions.text import words

    return _docs(spark, sf).select("doc_id", F.size(words(F.col("text"))).cast("long").alias("dl"))


def term_df(spark: SparkSession, sf: str) -> DataFrame:
    return search.term_counts(_docs(spark, sf), F.col("text"))


def _legs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two rankings of the same ids: by dot product and by a label's agreement with it."""
    return vector_topk_dot(spark, sf).select("query", "id", "rank"), vector_topk_int8(spark, sf).select("query", "id", "rank")


def rrf_fuse(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _legs(spark, sf)
    return search.top(search.fused([(a, 1), (b, 1)]), K)


def rrf_weighted(spark: SparkSession, sf: str) -> DataFrame:
    a, b = _legs(spark, sf)
    return search.top(search.fused([(a, 1), (b, 2)]), K)


def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark items as questions; vector ``item_id`` stands for a question's and vector ``doc_id`` for a document's embedding."""
    questions = _questions(spark, sf)
    embedded = _vectors(spark, sf).join(questions.select(F.col("query").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    best = search.hybrid(_docs(spark, sf), questions, _vectors(spark, sf), embedded, K)
    titled = best.join(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id", "left")
    return titled.select("query", "id", "score", "rank", F.coalesce("source", F.lit("Unknown")).alias("title"))


def grade_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return vector_topk_dot(spark, sf).select("query", "id", search.grade(F.col("score")).alias("grade"))


def grade_select(spark: SparkSession, sf: str) -> DataFrame:
    pool = search.nearest(_vectors(spark, sf), _query_vectors(spark, sf), 2 * K)
    return search.graded(pool.select("query", "id", search.grade(F.col("score") - 0.3).alias("grade"), "score"), K)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))


def _selected(spark: SparkSession, sf: str) -> DataFrame:
    """The second and third lines of every hundredth document: a query is a document."""
    return _lines(spark, sf).where((F.col("doc_id") % EVERY == 0) & F.col("chunk_index").isin(1, 2, 5)).select(F.col("doc_id").alias("query"), "doc_id", "chunk_index", F.col("chunk_index").alias("rank"))


def adjacent_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return search.neighbours(_selected(spark, sf), _lines(spark, sf)).select("query", "doc_id", "chunk_index", F.md5("text").alias("text_md5"))


def context_expand(spark: SparkSession, sf: str) -> DataFrame:
    return search.context(_selected(spark, sf), _lines(spark, sf)).select("query", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("context_md5"))


QUERIES = {f.__name__: f for f in (vector_topk_dot, vector_topk_cosine, vector_topk_int8, vector_threshold, vector_quantize, vector_roundtrip_error, index_memory, centroid_update_step, kmeans_assign_step, ivf_search, ivf_search_wide, ivf_kmeans, ivf_cell_count, bm25_topk, bm25_doc_lengths, term_df, rrf_fuse, rrf_weighted, hybrid_search, grade_bucket, grade_select, adjacent_chunks, context_expand)}

_DOT = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"


def _top(score: str, k: int, frm: str = "embeddings e, embeddings q WHERE q.vec_id % 100 = 0", q: str = "q.vec_id", i: str = "e.vec_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT {q} AS query, {i} AS id, round({score}, 6) AS score FROM {frm})) WHERE rank <= {k}"


_Q8 = "(SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN peak < 1e-12 THEN 0 ELSE greatest(least(round(CAST(x AS DOUBLE) / scale), 127), -127) END) AS z, scale FROM (SELECT *, CASE WHEN peak < 1e-12 THEN 1.0 ELSE peak / 127 END AS scale FROM (SELECT vec_id, embedding, list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE)))) AS peak FROM embeddings)))"
_INT8 = _top("list_dot_product(CAST(e.z AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * e.scale", K, f"{_Q8} e, embeddings q WHERE q.vec_id % 100 = 0")
_MEANS = "(SELECT label AS cell, d, round(avg(x), 6) AS m FROM (SELECT label, unnest(range(len(embedding))) AS d, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings) GROUP BY ALL)"
_CENTROIDS = f"(SELECT cell, list(m ORDER BY d) AS c FROM {_MEANS} GROUP BY cell)"
_CELLS = f"(SELECT vec_id, cell FROM (SELECT e.vec_id, c.cell, row_number() OVER (PARTITION BY e.vec_id ORDER BY round(list_dot_product(CAST(e.embedding AS DOUBLE[]), c.c), 6) DESC, c.cell) AS r FROM embeddings e, {_CENTROIDS} c) WHERE r = 1)"
_WORDS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')"


def _bm25(items: str, k: int) -> str:
    return f"""(WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), n AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_dl FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id AS query, unnest({_WORDS}) AS term FROM benchmark WHERE {items}),
p AS (SELECT term, doc_id, dl, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term)
{_top("sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)))", k, "q JOIN p USING (term) JOIN f USING (term), n GROUP BY query, id", "query", "doc_id")})"""


def _rrf(a: str, b: str, w: float, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT query, id, round(sum(part), 8) AS score FROM (SELECT query, id, 1.0::DOUBLE / (60 + rank) AS part FROM ({a}) UNION ALL SELECT query, id, {w}::DOUBLE / (60 + rank) AS part FROM ({b})) GROUP BY ALL)) WHERE rank <= {k}"


_LINES = "(SELECT doc_id, unnest(range(len(l))) AS chunk_index, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_CHOSEN = f"(SELECT doc_id, chunk_index FROM {_LINES} WHERE doc_id % 100 = 0 AND chunk_index IN (1, 2, 5))"
_POOL = _top(_DOT, 2 * K)

SQL = {
    "vector_topk_dot": _top(_DOT, K),
    "vector_topk_cosine": _top(f"{_DOT} / (sqrt(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))))", K),
    "vector_topk_int8": _INT8,
    "vector_threshold": f"SELECT * FROM ({_top(_DOT, 10)}) WHERE score >= 0.5",
    "vector_quantize": f"SELECT vec_id, array_to_string(list_transform(z, lambda x: CAST(x AS INTEGER)), ',') AS q, round(scale, 9) AS scale FROM {_Q8}",
    "vector_roundtrip_error": f"SELECT vec_id, round(err, 6) AS max_error, err <= scale / 2 + 1e-9 AS within_half_step FROM (SELECT e.vec_id, scale, list_max(list_transform(range(1, len(z) + 1), lambda i: abs(CAST(embedding[i] AS DOUBLE) - z[i] * scale))) AS err FROM {_Q8} z JOIN embeddings e USING (vec_id))",
    "index_memory": "SELECT count(*) AS n, CAST(sum(len(embedding) * 4) AS BIGINT) AS float_bytes, CAST(sum(len(embedding) + 4) AS BIGINT) AS int8_bytes FROM embeddings",
    "centroid_update_step": f"SELECT cell, CAST(d AS INTEGER) AS d, m FROM {_MEANS}",
    "kmeans_assign_step": f"SELECT vec_id, cell FROM {_CELLS}",
    "ivf_search": f"WITH probed AS (SELECT query, cell FROM (SELECT q.vec_id AS query, c.cell, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_dot_product(CAST(q.embedding AS DOUBLE[]), c.c), 6) DESC, c.cell) AS r FROM embeddings q, {_CENTROIDS} c WHERE q.vec_id % 100 = 0) WHERE r <= 4) " + _top("list_dot_product(CAST(e.z AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) * e.scale", K, f"{_Q8} e JOIN {_CELLS} m ON m.vec_id = e.vec_id JOIN probed USING (cell) JOIN embeddings q ON q.vec_id = probed.query"),
    "ivf_cell_count": "SELECT label, count(*) AS n, CAST(greatest(2, least(32, count(*) // 4)) AS BIGINT) AS cells FROM embeddings GROUP BY label",
    "bm25_topk": f"SELECT * FROM {_bm25('item_id % 100 = 0', K)}",
    "bm25_doc_lengths": f"SELECT doc_id, CAST(len({_WORDS}) AS BIGINT) AS dl FROM documents",
    "term_df": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM documents) GROUP BY ALL) GROUP BY term",
    "rrf_fuse": _rrf(_top(_DOT, K), _INT8, 1.0, K),
    "rrf_weighted": _rrf(_top(_DOT, K), _INT8, 2.0, K),
    "hybrid_search": f"SELECT query, id, score, rank, coalesce(source, 'Unknown') AS title FROM ({_rrf(f'SELECT * FROM {_bm25("item_id % 100 = 0", K)}', _top(_DOT, K, 'embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 100 = 0)'), 1.0, K)}) LEFT JOIN documents ON doc_id = id",
    "grade_bucket": f"SELECT query, id, CAST(greatest(1, least(5, ceil(score * 5))) AS INTEGER) AS grade FROM ({_top(_DOT, K)})",
    "grade_select": f"SELECT query, id, grade, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, score DESC, id) AS rank FROM (SELECT *, max(grade) OVER (PARTITION BY query) AS best FROM (SELECT query, id, score, CAST(greatest(1, least(5, ceil((score - 0.3) * 5))) AS INTEGER) AS grade FROM ({_POOL}))) WHERE grade >= CASE WHEN best >= 3 THEN 3 WHEN best >= 2 THEN 2 ELSE 0 END) WHERE rank <= {K}",
    "adjacent_chunks": f"SELECT DISTINCT c.doc_id AS query, l.doc_id, CAST(l.chunk_index AS INTEGER) AS chunk_index, md5(l.text) AS text_md5 FROM {_CHOSEN} c JOIN {_LINES} l ON l.doc_id = c.doc_id AND abs(l.chunk_index - c.chunk_index) = 1",
    "context_expand": f"WITH c AS {_CHOSEN}, s AS (SELECT c.doc_id, c.chunk_index AS pos, string_agg(l.text, chr(10) ORDER BY l.chunk_index) AS t FROM c JOIN {_LINES} l ON l.doc_id = c.doc_id AND abs(l.chunk_index - c.chunk_index) <= 1 WHERE l.chunk_index = c.chunk_index OR NOT EXISTS (SELECT 1 FROM c x WHERE x.doc_id = l.doc_id AND x.chunk_index = l.chunk_index) GROUP BY ALL) SELECT doc_id AS query, CAST(length(string_agg(t, chr(10) || chr(10) ORDER BY pos)) AS BIGINT) AS n_chars, md5(string_agg(t, chr(10) || chr(10) ORDER BY pos)) AS context_md5 FROM s GROUP BY doc_id",
}
