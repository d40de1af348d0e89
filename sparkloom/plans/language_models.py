"""Registered queries around models: summary trees, speech text, JSON answers, audio features, gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import audio, jsons, models, speech
from sparkloom.operators import raptor, search
from sparkloom.sources.tables import table, written


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as chunks, with the vector of their words."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "text"))
    return lines.select("doc_id", F.col("i").cast("long").alias("id"), "text", models.run("embed", F.col("text")).alias("vector"))


def raptor_tree(spark: SparkSession, sf: str) -> DataFrame:
    """Summary trees of all documents."""
    nodes = raptor.tree(written(_chunks(spark, sf), "chunks"))
    return nodes.select("doc_id", "level", "id", "confidence", F.array_join(F.transform("child_ids", lambda x: x.cast("string")), ",").alias("children"), F.md5("summary").alias("summary_md5"))


def raptor_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """The trees of all documents; every hundredth is asked its first line."""
    chunks = written(_chunks(spark, sf), "chunks")
    nodes = raptor.tree(chunks)
    asked = chunks.where("id = 0 and doc_id % 100 = 0").select(F.col("doc_id").alias("query"), "doc_id", "vector")
    return raptor.retrieve(nodes, chunks, asked, 5)


def number_words(spark: SparkSession, sf: str) -> DataFrame:
    """Keys and balances of all customers as whole numbers."""
    c = table(spark, sf, "customer")
    n = c.select(F.col("c_custkey").alias("n")).unionByName(c.select(F.floor(F.col("c_acctbal") * 100).cast("long").alias("n"))).distinct()
    return n.select("n", speech.in_words("n").alias("words"))


def speech_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """Documents after a sentence of figures."""
    said = F.concat(F.lit("It's $4.99, 25% of 1200 at 3:05 pm on the 2nd. "), F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.md5(speech.speakable(said)).alias("text_md5"))


def speech_chunks(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(speech.speech_chunks(F.col("text"), 100)).alias("i", "chunk"))
    return d.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.octet_length("chunk")).alias("longest"))


def dialogue_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations as an answer with an array of lines, cut off for every third."""
    t = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.col("role").alias("speaker"), "text"))).alias("turns"))
    raw = F.concat(F.lit("Here it is:\n"), F.to_json(F.transform("turns", lambda x: F.struct(x["speaker"].alias("speaker"), x["text"].alias("text")))))
    cut = F.when(F.col("conv_id") % 3 == 0, F.left(raw, F.length(raw) - 2)).otherwise(raw)
    d = t.select("conv_id", jsons.dialogue(cut, F.lit("user"), F.lit("a"), F.lit("b")).alias("d"))
    return d.select("conv_id", F.posexplode("d").alias("i", "x")).select("conv_id", "i", "x.speaker", "x.voice", F.md5("x.text").alias("text_md5"))


def requirements_mined(spark: SparkSession, sf: str) -> DataFrame:
    """Requirements in texts made of parts."""
    p = F.col("p_size").cast("string")
    text = F.concat(F.lit("Needs "), p, F.lit(" GB of RAM, better 64GB memory. Supports "), p, F.lit("k context or 2048 tokens context."))
    return table(spark, sf, "part").select("p_partkey", jsons.least_ram_gb(text).alias("ram_gb"), jsons.context_length(text).alias("context"))


def query_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Whether benchmark items need retrieval."""
    q = table(spark, sf, "benchmark").select("item_id", F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Hello "), "text")).otherwise(F.col("text")).alias("text"))
    c = q.select("item_id", models.run("classify", F.col("text")).alias("c"))
    return c.select("item_id", "c.label", models.needs_retrieval(F.col("c.label"), F.col("c.confidence"), F.lit(1)).alias("retrieves"))


def lexical_grades(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth benchmark item against all documents: share of words, grade, cut."""
    q = table(spark, sf, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query"), "text")
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")

    return search.graded(search.best_overlaps(d, q, 5, ident="id").withColumn("grade", search.grade(F.col("score"))), 5).select("query", "id", "grade", "score", "rank")


def media_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors as media: the nearest to every hundredth answer (long enough ones), the k best first, then those above the threshold."""
    answers = table(spark, sf, "benchmark").where("item_id % 100 = 0").select(F.col("item_id").alias("query"), "text")
    from sparkloom.operators.conversations import long_enough

    asked = table(spark, sf, "embeddings").join(answers.where(long_enough(F.col("text"))).select(F.col("query").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    return search.nearest(table(spark, sf, "embeddings"), asked, 5).where("score >= 0.5")


def preemphasis(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as signals."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.posexplode(audio.emphasized(F.col("embedding"))).alias("i", "x")).select("vec_id", "i", F.round("x", 6).alias("x"))


def signal_frames(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(audio.frames(F.col("embedding"), 16, 8)).alias("i", "f"))
    return e.select("vec_id", "i", F.round(F.aggregate("f", F.lit(0.0), lambda s, x: s + x * x), 6).alias("energy"))


def log_mel_shape(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings repeated to a tenth of a second of sound."""
    e = table(spark, sf, "embeddings").select("vec_id", F.flatten(F.array_repeat("embedding", 25)).alias("x"))
    m = e.select("vec_id", audio.mel_features(F.col("x")).alias("m"))
    return m.select("vec_id", F.size("m").alias("n_frames"), F.size(F.element_at("m", 1)).alias("n_mels"))


def power_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as signals: the power of each frame of 16 samples at each frequency."""
    e = table(spark, sf, "embeddings").select("vec_id", F.posexplode(audio.power_spectra(F.col("embedding"), 16, 8, 16)).alias("frame", "p"))
    return e.select("vec_id", "frame", F.posexplode("p").alias("bin", "power")).select("vec_id", "frame", "bin", F.round("power", 6).alias("power"))


QUERIES = {f.__name__: f for f in (raptor_tree, raptor_retrieve, number_words, speech_normalize, speech_chunks, dialogue_lines, requirements_mined, query_gate, lexical_grades, media_retrieval, preemphasis, signal_frames, power_spectrum, log_mel_shape)}

_WORDS = "regexp_extract_all(lower({}), '[a-z0-9]+')"

SQL = {
    "dialogue_lines": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INTEGER) AS i, role AS speaker, CASE WHEN role = 'user' THEN 'a' ELSE 'b' END AS voice, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE conv_id % 3 <> 0 OR back > 1",
    "requirements_mined": "SELECT p_partkey, CAST(least(p_size, 64) AS DOUBLE) AS ram_gb, CAST(greatest(p_size * 1024, 2048) AS BIGINT) AS context FROM part",
    "query_gate": "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'no_retrieval' ELSE 'simple_rag' END AS label, item_id % 3 <> 0 AS retrieves FROM benchmark",
    "lexical_grades": f"""WITH p AS (SELECT b.item_id AS query, d.doc_id AS id, round(len(list_intersect(list_distinct({_WORDS.format('b.text')}), {_WORDS.format('d.text')})) / len(list_distinct({_WORDS.format('b.text')})), 6) AS score FROM documents d , benchmark b WHERE b.item_id % 100 = 0),
g AS (SELECT *, CAST(greatest(1, least(5, ceil(score * 5))) AS INTEGER) AS grade FROM p), m AS (SELECT *, max(grade) OVER (PARTITION BY query) AS best FROM g)
SELECT query, id, grade, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, score DESC, id) AS rank FROM m WHERE grade >= CASE WHEN best >= 3 THEN 3 WHEN best >= 2 THEN 2 ELSE 0 END) WHERE rank <= 5""",
    "media_retrieval": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT q.vec_id AS query, e.vec_id AS id, round(list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 100 = 0))) WHERE rank <= 5 AND score >= 0.5",
    "preemphasis": "SELECT vec_id, CAST(i - 1 AS INTEGER) AS i, round(CAST(embedding[i] AS DOUBLE) - 0.97::DOUBLE * CASE WHEN i = 1 THEN 0 ELSE CAST(embedding[i - 1] AS DOUBLE) END, 6) AS x FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings)",
    "signal_frames": "SELECT vec_id, CAST(i AS INTEGER) AS i, round(list_sum(list_transform(embedding[i * 8 + 1:i * 8 + 16], lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS energy FROM (SELECT vec_id, embedding, unnest(range((len(embedding) - 16) // 8 + 1)) AS i FROM embeddings)",
    "power_spectrum": """WITH x AS (SELECT vec_id, unnest(range(len(embedding))) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x, len(embedding) AS n FROM embeddings),
f AS (SELECT vec_id, frame, i - 8 * frame AS j, x * 0.5 * (1 - cos(2 * pi() * (i - 8 * frame) / 15)) AS x FROM x, range(0, 1000) r(frame) WHERE i BETWEEN 8 * frame AND 8 * frame + 15 AND 8 * frame + 16 <= n)
SELECT vec_id, CAST(frame AS INTEGER) AS frame, CAST(bin AS INTEGER) AS bin, round(sum(x * cos(2 * pi() * bin * j / 16)) ** 2 + sum(x * sin(2 * pi() * bin * j / 16)) ** 2, 6) AS power FROM f, range(0, 9) b(bin) GROUP BY ALL""",
    "number_words": """WITH RECURSIVE n AS (SELECT DISTINCT n FROM (SELECT CAST(c_custkey AS BIGINT) AS n FROM customer UNION ALL SELECT CAST(floor(c_acctbal * 100) AS BIGINT) FROM customer)),
w AS (SELECT ['zero', 'one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve', 'thirteen', 'fourteen', 'fifteen', 'sixteen', 'seventeen', 'eighteen', 'nineteen'] AS o,
    ['twenty', 'thirty', 'forty', 'fifty', 'sixty', 'seventy', 'eighty', 'ninety'] AS t),
k AS (SELECT i, CASE WHEN i % 100 < 20 THEN CASE WHEN i % 100 > 0 THEN o[i % 100 + 1] END ELSE t[i % 100 // 10 - 1] || CASE WHEN i % 10 > 0 THEN '-' || o[i % 10 + 1] ELSE '' END END AS low,
    CASE WHEN i >= 100 THEN o[i // 100 + 1] || ' hundred' END AS high FROM range(0, 1000) r(i), w),
h AS (SELECT i, concat_ws(' ', high, low) AS s FROM k)
SELECT n, CASE WHEN n < 0 THEN 'negative ' ELSE '' END || CASE WHEN n = 0 THEN 'zero' WHEN abs(n) BETWEEN 1100 AND 1999 AND abs(n) % 100 = 0 THEN (SELECT o[abs(n) // 100 + 1] FROM w) || ' hundred'
    ELSE concat_ws(' ', nullif(m.s, '') || ' million', nullif(b.s, '') || ' thousand', nullif(a.s, '')) END AS words
FROM n JOIN h m ON m.i = abs(n) // 1000000 JOIN h b ON b.i = abs(n) // 1000 % 1000 JOIN h a ON a.i = abs(n) % 1000""",
}
