"""The operators of this subpackage as registered queries with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, html, jaccard, kdtree, language, media, packing, passages, quality, repair, sample, spelling, sstable, wordpiece
from sparkloom.llm.common import shared_path


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of the benchmark in all documents."""
    return decontaminate.scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("item_ids", "spans")


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents as sorted-string-table shards, read back."""
    shards = sstable.write(_table(spark, sf_dir, "documents"), shared_path(spark, "shards"), tokenizer_file())
    return sstable.read(shards)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as a stored media column, sniffed and described."""
    return media.described(media.sniff(media.stored_texts(_table(spark, sf_dir, "documents"))))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learned from those outside the held-out third."""
    docs = _table(spark, sf_dir, "documents")
    held = sample.remainder("doc_id", 3) == 1
    model = language.train(docs, docs.where(~held).select(F.col("doc_id").alias("id"), F.col("lang").alias("label")))
    found = language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return html.extract(_table(spark, sf_dir, "pages"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of all documents at a Jaccard similarity of 0.8 on five-word n-grams."""
    return jaccard.join(_table(spark, sf_dir, "documents")).drop("class_key")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy piece counts of all documents."""
    return wordpiece.count(_table(spark, sf_dir, "documents"), pieces_file())


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs and passages of all documents that an earlier document has."""
    return passages.repeats(_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of all documents, learned from labels outside the held-out quarter."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held = sample.remainder("doc_id", 4) == 2
    model = quality.train(docs, _table(spark, sf_dir, "labels").where(~held).select(F.col("doc_id").alias("id"), F.col("quality").alias("label")))
    return quality.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_file())


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents and what they're spelling variants of."""
    return spelling.variants(spelling.word_counts(_table(spark, sf_dir, "documents"), damage=97))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    own = _table(spark, sf_dir, "conversations")
    return repair.report(repair.messages(own, damage=True)).withColumn("conv_id", F.col("conv_id").cast(own.schema["conv_id"].dataType))


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 largest inner products of every twentieth vector."""
    return kdtree.topk(_table(spark, sf_dir, "embeddings"), 20, F.col("vec_id") % 20 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontaminate, op2_token_shards, op3_media, op4_language, op5_main_text, op6_ngram_jaccard, op7_token_counts, op8_substring_dedup, op9_quality, op10_packing, op11_spelling_variants, op12_conversation_repair, op13_exact_topk)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: Tables of crc32, and the crc32 of a text by them.
_CRC_TABLE = """crc_of AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""


def _crc(text: str) -> str:
    letters = f"list_transform(range(1, strlen({text}) + 1), lambda p: CAST('0x' || hex(encode({text}))[2 * p - 1:2 * p] AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {letters}), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)"


SQL: dict[str, str] = {
    "op1_decontaminate": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, len(win) AS n, array_to_string(win, ' ') AS win FROM (
    SELECT item_id, w[i:i + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n AS n, item_id FROM dw JOIN bw USING (win, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS item_ids FROM m GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, CAST(coalesce(len(item_ids), 0) AS BIGINT) AS n_items,
    sha256(coalesce(array_to_string(item_ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
s AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN s p ON p.doc_id = x JOIN s q ON q.doc_id = y WHERE n_both >= 0.8 * (p.n + q.n - n_both)),
reach(x, y) AS (SELECT x, y FROM l UNION SELECT reach.x, l.y FROM reach JOIN l ON reach.y = l.x),
k AS (SELECT x, min(y) AS low FROM reach GROUP BY x),
f AS (SELECT array_to_string(w, ' ') AS t, min(doc_id) AS copy_of FROM d WHERE len(w) > 0 GROUP BY ALL)
SELECT d.doc_id, least(d.doc_id, coalesce(k.low, d.doc_id)) AS class_id, (SELECT count(*) FROM l WHERE l.x = d.doc_id) AS n_links,
    coalesce(f.copy_of, d.doc_id) AS copy_of, CAST(len(d.w) AS BIGINT) AS n_words
FROM d LEFT JOIN k ON k.x = d.doc_id LEFT JOIN f ON f.t = array_to_string(d.w, ' ') AND len(d.w) > 0""",
    "op11_spelling_variants": rf"""
WITH RECURSIVE {_CRC_TABLE},
r AS (SELECT doc_id, run, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) GROUP BY ALL),
h AS (SELECT run, n, {_crc("(doc_id || ':' || run)")} AS h FROM r, crc_of),
v AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
    UNION SELECT cut.word, w.word, w.n FROM cut JOIN w ON w.word = rest UNION SELECT w.word, cut.word, cut.n FROM cut JOIN w ON w.word = rest),
best AS (SELECT word, count(*) AS n_near, min((-m, near)) AS best FROM near GROUP BY word),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN -best[1] >= 2 * n THEN best[2] END AS form, CASE WHEN -best[1] >= 2 * n THEN -best[1] END AS form_n FROM w LEFT JOIN best USING (word)),
up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.next)
SELECT f.word, form, up.root, n, n_near, form_n FROM f JOIN up ON up.word = f.word AND up.next IS NULL""",
    "op12_conversation_repair": rf"""
WITH RECURSIVE {_CRC_TABLE},
m AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS how FROM conversations, crc_of),
d AS (SELECT conv_id, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE how WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM m),
n AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS c,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS final FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, lag(c) OVER (PARTITION BY conv_id ORDER BY i) || c AS two FROM n),
e AS (SELECT *, final = '' OR again AS gone, CASE WHEN NOT again AND final NOT IN ('', '.', '!', '?') THEN 3 ELSE 0 END AS cut FROM f),
gap(last, onward, price, letters, made) AS (VALUES (0, 0, 0, '', ''), (0, 2, 3, 'I', 'user:' || chr(10)), (0, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 1, 0, '', ''),
    (1, 2, 3, 'I', 'user:' || chr(10)), (1, 3, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 2, 0, '', ''), (2, 3, 3, 'I', 'assistant:' || chr(10)), (3, 3, 0, '', ''), (3, 2, 3, 'I', 'user:' || chr(10))),
move(last, c, onward) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
walk(conv_id, i, last, b) AS (
    SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, (0, '', '') FROM conversations
    UNION ALL
    SELECT conv_id, i, last, min((cost, audit, lines)) FROM (
        SELECT w.conv_id, e.i, x.last, w.b[1] + gap.price + x.price AS cost, w.b[2] || gap.letters || x.letter AS audit, w.b[3] || gap.made || x.line AS lines
        FROM walk w JOIN e ON e.conv_id IS NOT DISTINCT FROM w.conv_id AND e.i = w.i + 1 JOIN gap ON gap.last = w.last LEFT JOIN move ON move.last = gap.onward AND move.c = e.c,
        LATERAL (SELECT unnest([
            {{'last': gap.onward, 'price': 4, 'letter': 'D', 'line': '', 'can': true}},
            {{'last': move.onward, 'price': cut, 'letter': 'K', 'line': role || ':' || text || chr(10), 'can': NOT gone AND move.onward IS NOT NULL}},
            {{'last': CASE WHEN gap.onward = 2 THEN 3 ELSE 2 END, 'price': 3 + cut, 'letter': 'R', 'line': CASE WHEN gap.onward = 2 THEN 'assistant:' ELSE 'user:' END || text || chr(10), 'can': NOT gone}}], recursive := true)) x
        WHERE x.can) GROUP BY ALL),
total AS (SELECT conv_id, min((w.b[1] + price, w.b[2] || letters, w.b[3] || made)) AS b
    FROM walk w JOIN gap USING (last) WHERE onward IN (0, 3) AND i = (SELECT count(*) FROM e WHERE e.conv_id IS NOT DISTINCT FROM w.conv_id) GROUP BY conv_id),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (final = '') AS blank, count(*) FILTER (again AND final <> '') AS duplicate,
    count(*) FILTER (cut > 0) AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM e GROUP BY conv_id)
SELECT total.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
    CAST(b[1] AS BIGINT) AS cost, b[2] AS audit, sha256(left(b[3], greatest(length(b[3]) - 1, 0))) AS repaired_sha256
FROM total LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM total.conv_id""",
    "op13_exact_topk": """
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE list_bool_and(list_transform(embedding, lambda x: coalesce(isfinite(x), false)))),
s AS (SELECT q.vec_id AS query_id, e.vec_id, CAST(list_inner_product(q.v, e.v) AS BIGINT) AS score FROM e q JOIN e ON e.vec_id <> q.vec_id AND len(e.v) = len(q.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20""",
}
