"""Registered queries over texts: sections, chunks, clean-up, captions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import chunker, text
from sparkloom.sources import documents
from sparkloom.sources.tables import table


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def chunk_documents(spark: SparkSession, sf: str) -> DataFrame:
    whole = _docs(spark, sf).select("doc_id", F.lit(0).alias("section"), "text", F.lit("paragraph:1").alias("metadata"))
    found = chunker.chunk_sections(whole)
    return found.select("doc_id", "chunk_index", F.octet_length("text").alias("n_bytes"), F.md5("text").alias("text_md5"))


def chunk_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Documents by whether one chunk holds them."""
    n = chunk_documents(spark, sf).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))
    return _docs(spark, sf).join(n, "doc_id", "left").select("doc_id", (F.coalesce("n_chunks", F.lit(0)) <= 1).alias("single"), (F.octet_length("text") <= chunker.SIZE).alias("fits"))


def line_split(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "t")).select("doc_id", "line", F.length("t").alias("n_chars"))


def paragraph_split(spark: SparkSession, sf: str) -> DataFrame:
    """Lines doubled, so that each is a paragraph."""
    doubled = _docs(spark, sf).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    return documents.paragraphs(doubled).select("doc_id", "section", "metadata", F.length("text").alias("n_chars"))


def markdown_split(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that begin with "The " made headings."""
    marked = _docs(spark, sf).withColumn("text", F.regexp_replace("text", "(?m)^The ", "# The "))
    return documents.markdown(marked).select("doc_id", "section", "metadata", F.md5("text").alias("text_md5"))


def page_split(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as pages; a text of one line has no form feed then, and is a paragraph."""
    paged = _docs(spark, sf).withColumn("text", F.translate("text", "\n", "\f"))
    return documents.pages_of(paged).select("doc_id", "section", text.page_label(F.col("metadata")).alias("label"), F.length("text").alias("n_chars"))


def pdf_text_normalize(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.replace(F.replace(F.replace("text", F.lit("fi"), F.lit("ﬁ")), F.lit(" an"), F.lit(" – an")), F.lit("."), F.lit("…"))
    return _docs(spark, sf).select("doc_id", F.md5(text.normalized_pdf_text(odd)).alias("text_md5"))


def page_labels(spark: SparkSession, sf: str) -> DataFrame:
    meta = F.concat(F.element_at(F.array(F.lit("page:"), F.lit("slide:"), F.lit("paragraph:"), F.lit("section:")), (F.col("doc_id") % 4 + 1).cast("int")), F.col("doc_id").cast("string"), F.lit(":table:2"))
    return _docs(spark, sf).select("doc_id", text.page_label(meta).alias("label"), text.page_label(meta, whole_paragraph=False).alias("short_label"))


def caption_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(text.prefix_caption(F.col("text"))).alias("caption_md5"))


def context_captions(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.length(text.context_caption(F.col("text"), F.col("doc_id"))).alias("n_chars"))


def byte_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """Prefix and suffix of 301 bytes that cut no character."""
    cut = lambda f: F.md5(f(F.col("text"), 301))
    return _docs(spark, sf).select("doc_id", cut(text.prefix_of_bytes).alias("prefix_md5"), cut(text.suffix_of_bytes).alias("suffix_md5"))


def strip_markup(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.md5(text.without_markup(F.col("html"))).alias("text_md5"))


def collapse_ws(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(text.collapsed(F.col("text"))).alias("text_md5"))


def acronyms(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts behind a few acronyms."""
    return _docs(spark, sf).select("doc_id", F.md5(text.spelled_acronyms(F.concat(F.lit("The PDFs and IBM of "), "text"))).alias("spelled_md5"))


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", F.regexp_extract(u, "://([^/:?#]+)", 1).alias("host"), text.extension(F.regexp_extract(u, "://[^/]+([^?#]*)", 1)).alias("ext"), text.basename(F.regexp_extract(u, "://[^/]+([^?#]*)", 1)).alias("base"))


def file_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """What parser files named after documents would have."""
    ext = F.element_at(F.array(*[F.lit(x) for x in ("TXT", "md", "pdf", "docx", "xyz", "wav")]), (F.col("doc_id") % 6 + 1).cast("int"))
    return _docs(spark, sf).groupBy(documents.parser_of(F.concat(F.lit("f."), ext)).alias("parser")).agg(F.count("*").alias("n"))


def english_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(text.english_tokens(F.col("text"))).alias("tokens_md5"))


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("i", "sentence")).select("doc_id", "i", F.md5("sentence").alias("sentence_md5"))


def data_urls(spark: SparkSession, sf: str) -> DataFrame:
    return _docs(spark, sf).select("doc_id", F.md5(documents.data_url(F.concat(F.col("doc_id").cast("string"), F.lit(".md")), F.encode("text", "utf-8"))).alias("url_md5"))


def duplicate_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that several documents hold, by content hash."""
    return _docs(spark, sf).groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


QUERIES = {f.__name__: f for f in (chunk_documents, chunk_totals, line_split, paragraph_split, markdown_split, page_split, pdf_text_normalize, page_labels, caption_prefix, context_captions, byte_truncate, strip_markup, collapse_ws, acronyms, url_parts, file_kinds, english_tokens, sentence_split, data_urls, duplicate_texts)}

_META = "list_extract(['page:', 'slide:', 'paragraph:', 'section:'], CAST(doc_id % 4 + 1 AS INTEGER)) || doc_id || ':table:2'"
_LINE = "SELECT doc_id, unnest(range(len(l))) AS i, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
_TRIM = r"regexp_replace({}, '^[\s\pZ]+|[\s\pZ]+$', '', 'g')"

_PIECES = [("p1", "p0", "chr(10) || chr(10)"), ("p2", "p1", "chr(10)"), ("p3", "p2", "'. '"), ("p4", "p3", "' '")]
_SPLITS = ",\n".join(f"""{to} AS (SELECT doc_id, list_append(path, i) AS path, CASE WHEN i < n THEN part || {by} ELSE part END AS t FROM (SELECT doc_id, path, unnest(l) AS part, unnest(range(1, len(l) + 1)) AS i, len(l) AS n
    FROM (SELECT doc_id, path, CASE WHEN strlen(t) > 1536 THEN string_split(t, {by}) ELSE [t] END AS l FROM {frm})))""" for to, frm, by in _PIECES)
_BLANK = r"regexp_full_match({}, '[\s\pZ]*')"

SQL = {
    "chunk_documents": f"""WITH RECURSIVE p0 AS (SELECT doc_id, CAST([] AS BIGINT[]) AS path, coalesce(text, '') AS t FROM documents),
{_SPLITS},
p AS (SELECT doc_id, t, strlen(t) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY path) AS i FROM p4),
w(doc_id, i, now, made) AS (
    SELECT doc_id, CAST(0 AS BIGINT), '', CAST(NULL AS VARCHAR) FROM p0
    UNION ALL
    SELECT w.doc_id, p.i, CASE WHEN strlen(now) + n <= 1536 THEN now || t ELSE
        CASE WHEN strlen(now) <= 200 THEN now ELSE right(now, list_max(list_filter(range(0, 201), lambda k: strlen(right(now, k)) <= 200))) END || t END, CASE WHEN strlen(now) + n > 1536 THEN now END
    FROM w JOIN p ON p.doc_id = w.doc_id AND p.i = w.i + 1),
c AS (SELECT doc_id, i, made AS t FROM w WHERE made IS NOT NULL UNION ALL SELECT doc_id, w.i + 1, now FROM w WHERE i = (SELECT count(*) FROM p WHERE p.doc_id = w.doc_id))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS chunk_index, CAST(strlen(t) AS INTEGER) AS n_bytes, md5(t) AS text_md5 FROM c WHERE NOT {_BLANK.format("t")}""",
    "byte_truncate": "SELECT doc_id, md5(left(text, a)) AS prefix_md5, md5(right(text, b)) AS suffix_md5 FROM (SELECT doc_id, text, max(k) FILTER (strlen(left(text, k)) <= 301) AS a, max(k) FILTER (strlen(right(text, k)) <= 301) AS b FROM (SELECT doc_id, text, unnest(range(least(length(text), 301) + 1)) AS k FROM documents) GROUP BY doc_id, text)",
    "chunk_totals": "SELECT doc_id, octet_length(encode(text)) <= 1536 OR text IS NULL AS single, octet_length(encode(text)) <= 1536 AS fits FROM documents",
    "line_split": f"SELECT doc_id, CAST(i AS INTEGER) AS line, CAST(length(t) AS INTEGER) AS n_chars FROM ({_LINE})",
    "paragraph_split": f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS section, 'paragraph:' || row_number() OVER (PARTITION BY doc_id ORDER BY i) AS metadata, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT doc_id, i, {_TRIM.format('t')} AS t FROM ({_LINE})) WHERE t <> ''",
    "markdown_split": f"WITH l AS (SELECT doc_id, i, t, t LIKE 'The %' AS h, sum(CAST(t LIKE 'The %' AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM ({_LINE})), g AS (SELECT doc_id, s, coalesce(max(CASE WHEN h THEN {_TRIM.format('t')} END), 'intro') AS h, {_TRIM.format("coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (NOT h), '')")} AS t FROM l GROUP BY ALL) SELECT doc_id, CAST(s AS INTEGER) AS section, 'section:' || h AS metadata, md5(t) AS text_md5 FROM g WHERE t <> ''",
    "page_split": f"SELECT doc_id, CAST(i AS INTEGER) AS section, CASE WHEN text LIKE '%' || chr(10) || '%' THEN 'Page ' || (i + 1) ELSE 'Paragraph 1' END AS label, CAST(length(t) AS INTEGER) AS n_chars FROM (SELECT doc_id, i, {_TRIM.format('t')} AS t FROM ({_LINE})) JOIN documents USING (doc_id) WHERE t <> ''",
    "pdf_text_normalize": "SELECT doc_id, md5(replace(replace(text, ' an', ' - an'), '.', '...')) AS text_md5 FROM documents",
    "page_labels": f"SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Page ' || doc_id WHEN 1 THEN 'Slide ' || doc_id WHEN 2 THEN 'Paragraph ' || doc_id || ':table:2' ELSE m END AS label, CASE doc_id % 4 WHEN 0 THEN 'Page ' || doc_id WHEN 1 THEN 'Slide ' || doc_id WHEN 2 THEN 'Paragraph ' || doc_id ELSE m END AS short_label FROM (SELECT doc_id, {_META} AS m FROM documents)",
    "caption_prefix": "SELECT doc_id, md5(left(text, 400)) AS caption_md5 FROM documents",
    "context_captions": f"SELECT doc_id, CAST(length({_TRIM.format("substring(text, CAST(greatest(length(text) // 2 - 200, 0) AS INTEGER) + 1, 400)")}) AS INTEGER) AS n_chars FROM documents",
    "collapse_ws": r"SELECT doc_id, md5(trim(regexp_replace(text, '[\s\pZ]+', ' ', 'g'))) AS text_md5 FROM documents",
    "strip_markup": r"SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), 'https?://[^ \t\n\r\f\v]+|www\.[^ \t\n\r\f\v]+', '', 'g'), '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '', 'g'), '[\s\pZ]+', ' ', 'g'))) AS text_md5 FROM pages",
    "acronyms": r"SELECT doc_id, md5(array_to_string(list_transform(regexp_extract_all('The PDFs and IBM of ' || text, '[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+|[\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]+'), lambda t: CASE WHEN regexp_full_match(t, '[A-Z]{2,6}s?') THEN array_to_string(string_split(t, ''), ' ') ELSE t END), '')) AS spelled_md5 FROM documents",
    "url_parts": r"SELECT page_id, regexp_extract(url, '://([^/:?#]+)', 1) AS host, CASE WHEN regexp_extract(p, '\.([^./\\]+)$', 1) = '' THEN 'unknown' ELSE lower(regexp_extract(p, '\.([^./\\]+)$', 1)) END AS ext, list_extract(string_split(lower(p), '/'), -1) AS base FROM (SELECT *, regexp_extract(url, '://[^/]+([^?#]*)', 1) AS p FROM pages)",
    "file_kinds": "SELECT CASE doc_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'markdown' WHEN 2 THEN 'pdf' WHEN 3 THEN 'docx' WHEN 5 THEN 'audio' END AS parser, count(*) AS n FROM documents GROUP BY 1",
    "english_tokens": r"SELECT doc_id, md5(array_to_string(regexp_extract_all(text, '((?:[A-Za-z0-9_]|[^\x00-\x7F])+|[^\s])', 1), ' ')) AS tokens_md5 FROM documents",
    "sentence_split": r"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS i, md5(s) AS sentence_md5 FROM (SELECT doc_id, unnest(range(len(l))) AS i, regexp_replace(unnest(l), '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS s FROM (SELECT doc_id, regexp_extract_all(text, '([^.!?]+[.!?]+|[^.!?]+$)', 1) AS l FROM documents)) WHERE s <> ''",
    "data_urls": "SELECT doc_id, md5('data:text/markdown;base64,' || base64(encode(text))) AS url_md5 FROM documents",
    "duplicate_texts": "SELECT sha256(text) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1",
}
