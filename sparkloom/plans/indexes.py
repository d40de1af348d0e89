"""Registered queries over stored indexes, whole question answering, and the smaller record and text rules."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text
from sparkloom.operators import answers, cells, field_index, lifecycle, search, stored_index, stored_tables
from sparkloom.plans import retrieval
from sparkloom.sources.tables import shared_folder, table, written

K = retrieval.K


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"


def _text_index(spark: SparkSession, sf: str) -> str:
    """Even documents, then the odd ones and every sixth anew with a word more; every tenth is deleted."""
    path, docs = _folder(spark), table(spark, sf, "documents").select("doc_id", "text")
    even = F.col("doc_id") % 2 == 0
    stored_index.add_texts(docs.where(even), path)
    stored_index.add_texts(docs.where(~even | (F.col("doc_id") % 6 == 0)).withColumn("text", F.when(even, F.concat(F.lit("again "), "text")).otherwise(F.col("text"))), path)
    stored_index.delete(spark, path, docs.where("doc_id % 10 = 0"), "doc_id")
    return path


def index_search(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 in a stored index after replacing and deleting."""
    return stored_index.find_texts(spark, _text_index(spark, sf), retrieval._questions(spark, sf), K)


def index_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Term counts of a stored index after replacing, deleting and compacting."""
    path = _folder(spark)
    stored_index.compacted(spark, _text_index(spark, sf), path)
    return stored_index.terms(spark, path)


FIELDS = {"text": 1.0, "source": 0.5}


def _field_index(spark: SparkSession, sf: str) -> str:
    """Texts and sources of the same documents, added, replaced and deleted in the same way."""
    path, docs = _folder(spark), table(spark, sf, "documents").select("doc_id", "text", "source")
    even, fields = F.col("doc_id") % 2 == 0, {"text": F.col("text"), "source": F.col("source")}
    field_index.add(docs.where(even), path, fields)
    field_index.add(docs.where(~even | (F.col("doc_id") % 6 == 0)).withColumn("text", F.when(even, F.concat(F.lit("again "), "text")).otherwise(F.col("text"))), path, fields)
    field_index.delete(spark, path, docs.where("doc_id % 10 = 0"), "doc_id")
    return path


def _asked(spark: SparkSession, sf: str, *parts: str) -> DataFrame:
    """A search made up of the words of each document whose id is divisible by 100; ``w`` are its words, ``s`` those of its source."""
    d = table(spark, sf, "documents").where("doc_id % 100 = 0")
    listed = d.select(F.col("doc_id").alias("query"), text.words(F.coalesce("text", F.lit(""))).alias("w"), text.words(F.coalesce("source", F.lit(""))).alias("s"))
    return listed.where("size(w) >= 9 and size(s) > 0").select("query", F.concat(*[F.expr(p) for p in parts]).alias("text"))


def field_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """Two words in a row, in texts only or in any field."""
    asked = _asked(spark, sf, "IF(query % 200 = 0, 'text:', '')", "'\"'", "w[2]", "' '", "w[3]", "'\"'")
    return field_index.find(spark, _field_index(spark, sf), asked, K, FIELDS)


def field_must_not(spark: SparkSession, sf: str) -> DataFrame:
    """One word that has to be there, one that may, and one that mustn't."""
    return field_index.find(spark, _field_index(spark, sf), _asked(spark, sf, "'+'", "w[0]", "' '", "w[4]", "' -'", "w[8]"), K, FIELDS)


def field_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """A word of the texts that has to be there, and one of the source."""
    return field_index.find(spark, _field_index(spark, sf), _asked(spark, sf, "'source:'", "s[0]", "' +text:'", "w[3]"), K, FIELDS)


def blockmax_topk(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 by blocks of postings, of which those that can't matter aren't read; questions are asked as their words, as other text may be marks, phrases or fields."""
    path = _folder(spark)
    field_index.add(table(spark, sf, "documents"), path, {"text": F.col("text")})
    plain = retrieval._questions(spark, sf).withColumn("text", F.array_join(text.words(F.col("text")), " "))
    return field_index.find_best(spark, path, plain, K, {"text": 1.0})


def index_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Cell search in a stored index: vectors added in two batches, every tenth deleted; each query's four nearest cells."""
    path, rows = _folder(spark), table(spark, sf, "embeddings")
    stored_index.start_cells(retrieval._label_means(spark, sf), path)
    stored_index.add_vectors(rows.where("vec_id % 3 = 0"), path)
    stored_index.add_vectors(rows.where("vec_id % 3 <> 0 or vec_id % 6 = 0"), path)
    stored_index.delete(spark, path, rows.where("vec_id % 10 = 0"), "vec_id")
    return stored_index.find_vectors(spark, path, retrieval._query_vectors(spark, sf), K)


def kept_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors added, replaced and deleted in an index that keeps its cells, and the recall at 10 that its searches then have for every hundredth vector."""
    path, rows = _folder(spark), table(spark, sf, "embeddings")
    cells.add(rows.where("vec_id % 3 = 0"), path)
    cells.upkeep_if_needed(spark, path)
    cells.add(rows.where("vec_id % 3 <> 0 or vec_id % 6 = 0"), path)
    cells.remove(spark, path, rows.where("vec_id % 10 = 1"), "vec_id")
    cells.upkeep_if_needed(spark, path)
    queries = retrieval._query_vectors(spark, sf)
    cells.tuned(spark, path, queries, cells.exact(rows, queries, 10, where=F.col("vec_id") % 10 != 1), 10)
    return cells.report(spark, path)


KINDS = {
    "documents": stored_tables.Kind("doc_id long, title string, n_chars long", ("doc_id",)),
    "chunks": stored_tables.Kind("doc_id long, chunk_index int, text string, enriched string", ("doc_id", "chunk_index")),
    "media": stored_tables.Kind("doc_id long, media_id long, caption string, embedding array<double>", ("doc_id", "media_id")),
}


def _store(spark: SparkSession, sf: str) -> tuple[stored_tables.Store, list[int]]:
    """Documents, their lines as chunks and parts as their media: every third document comes later with a longer title, every seventh loses all but its first line by being replaced,
    chunks of even documents are enriched, every tenth document goes, media get their vectors. The store, and the number of each batch."""
    store = stored_tables.Store(_folder(spark), KINDS)
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("n_chars").cast("long").alias("n_chars"), "text")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "text")).withColumn("enriched", F.lit(None).cast("string"))
    p = table(spark, sf, "part").select((F.col("p_partkey") % 150).alias("doc_id"), F.col("p_partkey").alias("media_id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("caption"), F.when(F.col("p_partkey") % 5 == 0, F.array(F.lit(1.0))).alias("embedding"))
    media = p.join(d.select("doc_id"), "doc_id", "left_semi")
    late = F.col("doc_id") % 3 == 0
    done = [stored_tables.upsert(spark, store, documents=d.where(~late), chunks=lines.where(~late), media=media)]
    done.append(stored_tables.upsert(spark, store, documents=d.where(late | (F.col("doc_id") % 7 == 0)).withColumn("title", F.concat(F.coalesce("title", F.lit("")), F.lit("+"))), chunks=lines.where(late)))
    again = d.where("doc_id % 7 = 0")
    done.append(stored_tables.replace(spark, store, again, documents=again, chunks=lines.where("doc_id % 7 = 0 and chunk_index = 0")))
    done.append(stored_tables.set_values(spark, store, "chunks", lines.where("doc_id % 2 = 0").select("doc_id", "chunk_index", F.upper("text").alias("enriched"))))
    done.append(stored_tables.delete(spark, store, d.where("doc_id % 10 = 0")))
    stored_tables.embed_media(spark, store)
    return store, done


def _by_document(spark: SparkSession, store: stored_tables.Store, at: int | None) -> DataFrame:
    documents, chunks, media = (stored_tables.state(spark, store, name, at) for name in KINDS)
    c = chunks.groupBy("doc_id").agg(F.count("*").alias("n_chunks"), F.count("enriched").alias("n_enriched"))
    m = media.groupBy("doc_id").agg(F.count("*").alias("n_media"), F.count("embedding").alias("n_vectors"))
    both = c.join(m, "doc_id", "full").join(documents, "doc_id", "full")
    return both.select("doc_id", "title", "n_chars", *[F.coalesce(x, F.lit(0)).alias(x) for x in ("n_chunks", "n_enriched", "n_media", "n_vectors")])


def stored_documents(spark: SparkSession, sf: str) -> DataFrame:
    """What is stored in the end, by document."""
    return _by_document(spark, _store(spark, sf)[0], None)


def stored_earlier(spark: SparkSession, sf: str) -> DataFrame:
    """What was stored before anything was replaced, enriched or deleted, read afterwards."""
    store, done = _store(spark, sf)
    return _by_document(spark, store, done[1])


def tree_answers(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth document is asked its own first line; every second of these has a tree, of nodes over four lines each, every other of which is unsure. The rest are answered from all lines."""
    d = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), "text")
    lines = d.select("doc_id", "title", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "text"))
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    chunks = written(lines.withColumns({"id": F.col("doc_id") * 100_000 + F.col("chunk_index"), "vector": F.array().cast("array<double>")}), "lines")
    group = F.floor(F.col("chunk_index") / 4)
    made = chunks.where("doc_id % 200 = 0").groupBy("doc_id", group.alias("g")).agg(F.min_by("text", "chunk_index").alias("summary"), F.array_sort(F.collect_list("id")).alias("child_ids")).where("size(child_ids) >= 3")
    nodes = made.withColumn("vec_id", (F.col("doc_id") + F.col("g")) % 500).join(e, "vec_id").select("doc_id", F.lit(1).alias("level"), (1_000_000 + F.col("g")).alias("id"), "summary", F.when(F.col("g") % 2 == 1, -2.0).otherwise(-1.0).alias("confidence"), "child_ids", "vector")
    asked = chunks.where("doc_id % 100 = 0 and chunk_index = 0").select(F.col("doc_id").alias("query"), "doc_id", "text", (F.col("doc_id") % 500).alias("vec_id")).join(e, "vec_id").drop("vec_id")
    found = answers.answered_from_trees(written(asked, "asked"), written(nodes, "nodes"), chunks, [(answers.word_leg(chunks, 3), 1.0)], 3, least_grade=0)
    named = F.transform("sources", lambda s: F.concat_ws(":", s["level"].cast("string"), s["id"].cast("string"), s["title"]))
    return found.select("query", "from_tree", F.array_join(named, ";").alias("sources"), F.when(F.col("from_tree"), F.md5("context")).alias("context_md5"))


def podcast_scripts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as two speakers' lines."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("query"), F.col("text").alias("context"))
    return answers.podcast_lines(d).select("query", "i", "speaker", "voice", F.md5("text").alias("text_md5"))


def hybrid_query(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth benchmark item from question to prompt: documents are chunks of their own; the vector of a document's number is its embedding, that of an item's number the imagined answer's."""
    d = table(spark, sf, "documents")
    chunks = d.select(F.col("doc_id").alias("id"), "doc_id", F.lit(0).alias("chunk_index"), F.col("source").alias("title"), "text")
    embedded = table(spark, sf, "embeddings").join(d.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")

    def near(questions: DataFrame) -> DataFrame:
        asked = table(spark, sf, "embeddings").join(questions.select(F.col("query").alias("vec_id")), "vec_id").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
        return search.nearest(embedded, asked, K).select("query", "id", "rank")

    found = answers.answered(retrieval._questions(spark, sf), chunks, [(answers.word_leg(chunks, K), 1.0), (near, 1.0)], K, least_grade=0)
    named = F.transform("sources", lambda s: F.concat_ws(":", s["id"].cast("string"), s["grade"].cast("string"), s["title"]))
    return found.select("query", "retrieves", F.array_join(named, ";").alias("sources"), F.md5("context").alias("context_md5"))


def chunks_and_media(spark: SparkSession, sf: str) -> DataFrame:
    """Even vectors as chunks and odd ones as media, searched under one ranking."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    both = answers.of_kinds(("chunk", e.where("id % 2 = 0")), ("media", e.where("id % 2 = 1")))
    return search.nearest(both, retrieval._query_vectors(spark, sf), K, ident="id", vector="vector")


def retried_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources found twice by variants of a query count once, by their best grade and score."""
    e = table(spark, sf, "events")
    rows = e.select(F.col("user_id").alias("query"), (F.col("event_id") % 40).alias("id"), (F.col("event_id") % 5 + 1).cast("int").alias("grade"), F.col("value").alias("score"))
    return answers.once_each(rows).select("query", "id", "grade", "score")


def inserted_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as chunks: the users' first, then the others' behind them."""
    c = table(spark, sf, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), "role", "text")
    first = lifecycle.inserted_chunks(c.select("doc_id", F.lit(0).alias("chunk_index"), "text").limit(0), c.where("role = 'user'"))
    return lifecycle.inserted_chunks(written(first, "chunks"), c.where("role <> 'user'")).select("doc_id", "chunk_index", F.md5("text").alias("text_md5"))


def set_values(spark: SparkSession, sf: str) -> DataFrame:
    """Customers with the balance of their newest order's price set, where they have one over 100,000."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    o = lifecycle.latest(table(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("c_acctbal")), "c_custkey", F.desc("o_orderkey"))
    return lifecycle.with_values(c, o.drop("o_orderkey"), ["c_custkey"])


def waiting_media(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as media: those of even size have no vector, every third no caption; kinds by size."""
    p = F.col("p_size")
    kind = F.when(p % 5 == 0, "Image").when(p % 5 == 1, "table").otherwise("text")
    m = table(spark, sf, "part").select("p_partkey", kind.alias("kind"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).otherwise("").alias("caption"), F.when(p % 2 == 1, F.array(F.lit(1.0))).alias("embedding"))
    return lifecycle.without_vector(lifecycle.of_media(m)).select("p_partkey", "kind")


def newest_orders(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.newest(table(spark, sf, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day")), "day", "o_orderkey", 20)


def unregistered_units(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as found units: some registered by path, base name or repository."""
    k = F.col("s_suppkey")
    s = table(spark, sf, "supplier").select(k, F.concat(F.lit("Models/D"), (k % 5).cast("string"), F.lit("/m"), k.cast("string"), F.lit(".gguf")).alias("rel_path"), F.concat(F.lit("/opt/Models/m"), k.cast("string")).alias("abs_path"), F.concat(F.lit("Org/R"), (k % 50).cast("string")).alias("repo_id"))
    names = F.when(k % 4 == 0, F.replace("rel_path", F.lit("/"), F.lit("\\"))).when(k % 4 == 1, F.concat(F.lit("M"), k.cast("string"), F.lit(".gguf"))).when(k % 20 == 2, F.col("repo_id"))
    found = lifecycle.unregistered(s, s.select(names.alias("token")).where("token is not null"))
    return found.select("s_suppkey", "repo_id")


def text_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in made-up answers: class labels, grade payloads, error lines, lists of numbers, key and value lines."""
    k, n = F.col("p_partkey"), F.col("p_size").cast("string")
    label = F.element_at(F.array(*[F.lit(x) for x in ("SimpleRAG", "MultiDoc", "OTHER", "NoRetrieval")]), (k % 4 + 1).cast("int"))
    payload = F.when(k % 3 == 0, F.concat(F.lit(" Query: size "), n, F.lit("\n\nContext: "), F.col("p_name"), F.lit("\n"))).when(k % 3 == 1, F.concat(F.lit("Query: "), n)).otherwise(F.lit("Query: \nContext: x"))
    log = F.concat(F.lit("\n\nstarting "), n, F.when(k % 3 == 0, F.concat(F.lit("\nmain: error: bad "), n, F.lit("\r\nmore"))).when(k % 3 == 1, F.lit("\nERROR: low")).otherwise(F.lit("\nfine")))
    numbers = F.concat(n, F.lit(", "), k.cast("string"), F.when(k % 2 == 0, F.lit(",-7,x,9")).otherwise(F.lit(" 5")))
    lines = F.concat(F.lit("Name: "), F.col("p_name"), F.lit("\nnothing\n size :  "), n, F.lit(" kB\nName: twice: "), n)
    t = table(spark, sf, "part").select("p_partkey", text.class_label(label).alias("label"), text.grade_payload(payload).alias("p"), text.error_line(log).alias("error"), text.int_list(numbers).alias("numbers"), text.key_values(lines).alias("kv"))
    return t.select("p_partkey", "label", "p.query", F.md5("p.context").alias("context_md5"), "error", F.array_join(F.transform("numbers", lambda x: x.cast("string")), ",").alias("numbers"), F.col("kv")["size"].alias("size"), F.col("kv")["Name"].alias("name"))


QUERIES = {f.__name__: f for f in (index_search, index_terms, field_phrases, field_must_not, field_pairs, blockmax_topk, index_vectors, kept_cells, stored_documents, stored_earlier, tree_answers, podcast_scripts, hybrid_query, chunks_and_media, retried_sources, inserted_chunks, set_values, waiting_media, newest_orders, unregistered_units, text_rules)}

_WORDS = retrieval._WORDS
_LIVE = "(SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'again ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 <> 0)"
_FUSED = retrieval._rrf(f"SELECT * FROM {retrieval._bm25('item_id % 100 = 0', K)}", retrieval._top(retrieval._DOT, K, "embeddings e, embeddings q WHERE q.vec_id IN (SELECT item_id FROM benchmark WHERE item_id % 100 = 0) AND e.vec_id IN (SELECT doc_id FROM documents)"), 1.0, 2 * K)
_FIELD_WORDS = retrieval._WORDS.replace("text", "x")
#: Words of both fields with their places, fields' sizes, terms' idf and the BM25 part of (field, doc_id, term, tf).
_FIELDS = f"""t AS (SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'again ' || text ELSE text END AS text, source FROM documents WHERE doc_id % 10 <> 0),
l AS (SELECT doc_id, field, {_FIELD_WORDS} AS w FROM (SELECT doc_id, 'text' AS field, text AS x FROM t UNION ALL SELECT doc_id, 'source', source FROM t)),
p AS (SELECT doc_id, field, len(w) AS dl, unnest(w) AS term, unnest(range(len(w))) AS i FROM l),
z AS (SELECT field, count(*) AS n_docs, avg(len(w)) AS avg_dl FROM l WHERE len(w) > 0 GROUP BY field),
i AS (SELECT field, term, any_value(avg_dl) AS avg_dl, ln(1 + (any_value(n_docs) - count(DISTINCT doc_id) + 0.5) / (count(DISTINCT doc_id) + 0.5)) AS idf FROM p JOIN z USING (field) GROUP BY field, term),
a AS (SELECT doc_id AS query, {retrieval._WORDS} AS w, {retrieval._WORDS.replace("text", "source")} AS s FROM documents WHERE doc_id % 100 = 0),
q AS (SELECT * FROM a WHERE len(w) >= 9 AND len(s) > 0),
c AS (SELECT doc_id, field, term, dl, count(*) AS tf FROM p GROUP BY ALL)"""
_PART = "CASE field WHEN 'text' THEN 1.0 ELSE 0.5 END * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))"


def _best(score: str, frm: str) -> str:
    return f"SELECT * FROM (SELECT query, id, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (SELECT query, doc_id AS id, round({score}, 6) AS score FROM {frm} GROUP BY query, doc_id)) WHERE rank <= {K}"


SQL = {
    "field_phrases": f"""WITH {_FIELDS}, h AS (SELECT query, x.doc_id, x.field, x.dl, count(*) AS tf, any_value(w[3]) AS one, any_value(w[4]) AS two
    FROM q JOIN p x ON x.term = w[3] AND (query % 200 <> 0 OR x.field = 'text') JOIN p y ON y.term = w[4] AND y.doc_id = x.doc_id AND y.field = x.field AND y.i = x.i + 1 GROUP BY ALL)
{_best("sum(" + _PART + ")", "(SELECT h.*, a.avg_dl, a.idf + b.idf AS idf FROM h JOIN i a ON a.field = h.field AND a.term = one JOIN i b ON b.field = h.field AND b.term = two)")}""",
    "field_must_not": f"""WITH {_FIELDS}, k AS (SELECT query, '+' AS mark, w[1] AS term FROM q UNION SELECT query, '', w[5] FROM q UNION SELECT query, '-', w[9] FROM q),
h AS (SELECT * FROM k JOIN c USING (term) JOIN i USING (field, term))
{_best("sum(CASE WHEN mark = '-' THEN 0 ELSE " + _PART + " END)", "h")[:-len(f") WHERE rank <= {K}")].replace("GROUP BY query, doc_id)", "GROUP BY query, doc_id HAVING bool_or(mark = '+') AND NOT bool_or(mark = '-'))")}) WHERE rank <= {K}""",
    "field_pairs": f"""WITH {_FIELDS}, k AS (SELECT query, s[1] AS term, 'source' AS field FROM q UNION ALL SELECT query, w[4], 'text' FROM q), h AS (SELECT * FROM k JOIN c USING (field, term) JOIN i USING (field, term))
{_best("sum(" + _PART + ")", "h").replace("GROUP BY query, doc_id)", "GROUP BY query, doc_id HAVING bool_or(field = 'text'))")}""",
    "blockmax_topk": f"SELECT * FROM {retrieval._bm25('item_id % 100 = 0', K)}",
    "index_search": retrieval._bm25("item_id % 100 = 0", K).replace("FROM documents)", f"FROM {_LIVE})")[1:-1],
    "index_terms": f"SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM (SELECT term, doc_id, count(*) AS tf FROM (SELECT doc_id, unnest({_WORDS}) AS term FROM {_LIVE}) GROUP BY ALL) GROUP BY term",
    "index_vectors": retrieval.SQL["ivf_search"].replace("JOIN embeddings q ON q.vec_id = probed.query", "JOIN embeddings q ON q.vec_id = probed.query WHERE e.vec_id % 10 <> 0"),
    "hybrid_query": f"""WITH f AS ({_FUSED}), b AS (SELECT item_id AS query, text AS question, {_WORDS} AS qw FROM benchmark WHERE item_id % 100 = 0),
p AS (SELECT f.query, id, source, text, f.score, CASE WHEN len(qw) = 0 THEN 0 ELSE len(list_intersect(list_distinct(qw), {_WORDS})) / len(list_distinct(qw)) END AS s FROM f JOIN documents ON doc_id = id JOIN b ON b.query = f.query),
g AS (SELECT *, CAST(greatest(1, least(5, ceil(s * 5))) AS INTEGER) AS grade FROM p), m AS (SELECT *, max(grade) OVER (PARTITION BY query) AS best FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY grade DESC, score DESC, id) AS rank FROM m WHERE grade >= CASE WHEN best >= 3 THEN 3 WHEN best >= 2 THEN 2 ELSE 0 END)
SELECT query, NOT regexp_matches(lower(question), '^\\s*(hi|hello|thanks)\\b') AS retrieves, coalesce(named, '') AS sources,
    md5(CASE WHEN strlen(t) <= 65536 THEN t ELSE left(t, list_max(list_filter(range(16384, 65537), lambda k: strlen(left(t, k)) <= 65536))) END) AS context_md5 FROM (SELECT b.query, question, string_agg(id || ':' || grade || ':' || coalesce(source, 'Unknown'), ';' ORDER BY rank) AS named, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY rank), '') AS t FROM b LEFT JOIN (SELECT * FROM r WHERE rank <= {K}) r ON r.query = b.query GROUP BY b.query, question)""",
    "chunks_and_media": retrieval._top(retrieval._DOT, K, i="CASE WHEN e.vec_id % 2 = 0 THEN 'chunk:' ELSE 'media:' END || e.vec_id"),
    "retried_sources": "SELECT query, id, grade, score FROM (SELECT *, row_number() OVER (PARTITION BY query, id ORDER BY grade DESC, score DESC) AS n FROM (SELECT user_id AS query, event_id % 40 AS id, CAST(event_id % 5 + 1 AS INTEGER) AS grade, value AS score FROM events)) WHERE n = 1",
    "inserted_chunks": "SELECT conv_id AS doc_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY role <> 'user', turn) - 1 AS INTEGER) AS chunk_index, md5(text) AS text_md5 FROM conversations WHERE role IS NOT NULL",
    "set_values": "SELECT c_custkey, coalesce(price, c_acctbal) AS c_acctbal, c_mktsegment FROM customer LEFT JOIN (SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders WHERE o_totalprice > 100000 GROUP BY o_custkey) ON o_custkey = c_custkey",
    "waiting_media": "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'Image' ELSE 'table' END AS kind FROM part WHERE p_size % 5 < 2 AND p_size % 2 = 0 AND p_partkey % 3 <> 0 AND p_name <> ''",
    "newest_orders": "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day FROM orders ORDER BY day DESC, o_orderkey LIMIT 20",
    "unregistered_units": "WITH s AS (SELECT s_suppkey, 'Org/R' || s_suppkey % 50 AS repo_id FROM supplier) SELECT * FROM s WHERE s_suppkey % 4 > 1 AND repo_id NOT IN (SELECT repo_id FROM s WHERE s_suppkey % 20 = 2)",
    "text_rules": "SELECT p_partkey, list_extract(['simple_rag', 'multi_doc', 'other', 'no_retrieval'], CAST(p_partkey % 4 + 1 AS INTEGER)) AS label, CASE WHEN p_partkey % 3 = 0 THEN 'size ' || p_size END AS query, CASE WHEN p_partkey % 3 = 0 THEN md5(trim(p_name)) END AS context_md5, CASE p_partkey % 3 WHEN 0 THEN 'main: error: bad ' || p_size WHEN 1 THEN 'ERROR: low' ELSE 'starting ' || p_size END AS error, p_size || ',' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN ',-7' ELSE ',5' END AS numbers, p_size || ' kB' AS size, 'twice: ' || p_size AS name FROM part",
    "stored_documents": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 <> 0 AND doc_id % 3 = 0 THEN coalesce(source, '') || '+' ELSE source END AS title, CAST(n_chars AS BIGINT) AS n_chars, string_split(text, chr(10)) AS l FROM documents WHERE doc_id % 10 <> 0),
m AS (SELECT p_partkey % 150 AS doc_id, count(*) AS n_media, count(*) FILTER (p_partkey % 5 = 0 OR p_partkey % 4 <> 0 AND p_name <> '') AS n_vectors FROM part GROUP BY ALL)
SELECT doc_id, title, n_chars, CAST(CASE WHEN text_null THEN 0 WHEN doc_id % 7 = 0 THEN 1 ELSE len(l) END AS BIGINT) AS n_chunks, CAST(CASE WHEN text_null OR doc_id % 2 <> 0 THEN 0 WHEN doc_id % 7 = 0 THEN 1 ELSE len(l) END AS BIGINT) AS n_enriched,
    CASE WHEN doc_id % 7 = 0 THEN 0 ELSE coalesce(n_media, 0) END AS n_media, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE coalesce(n_vectors, 0) END AS n_vectors FROM (SELECT *, l IS NULL AS text_null FROM d) LEFT JOIN m USING (doc_id)""",
    "stored_earlier": """WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 THEN coalesce(source, '') || '+' ELSE source END AS title, CAST(n_chars AS BIGINT) AS n_chars, string_split(text, chr(10)) AS l FROM documents),
m AS (SELECT p_partkey % 150 AS doc_id, count(*) AS n_media, count(*) FILTER (p_partkey % 5 = 0) AS n_vectors FROM part GROUP BY ALL)
SELECT doc_id, title, n_chars, CAST(coalesce(len(l), 0) AS BIGINT) AS n_chunks, CAST(0 AS BIGINT) AS n_enriched, coalesce(n_media, 0) AS n_media, coalesce(n_vectors, 0) AS n_vectors FROM d LEFT JOIN m USING (doc_id)""",
    "podcast_scripts": r"SELECT doc_id AS query, CAST(i - 1 AS INTEGER) AS i, CASE WHEN i % 2 = 1 THEN 'A' ELSE 'B' END AS speaker, CASE WHEN i % 2 = 1 THEN 'a' ELSE 'b' END AS voice, md5(s) AS text_md5 FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS i FROM (SELECT doc_id, unnest(range(len(l))) AS k, regexp_replace(unnest(l), '^[\s\pZ]+|[\s\pZ]+$', '', 'g') AS s FROM (SELECT doc_id, regexp_extract_all(text, '([^.!?]+[.!?]+|[^.!?]+$)', 1) AS l FROM documents)) WHERE s <> '') WHERE i <= 8",
    "tree_answers": f"""WITH ch AS (SELECT doc_id, source AS title, unnest(range(len(l))) AS i, unnest(l) AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents)),
c AS (SELECT *, doc_id * 100000 + i AS id FROM ch), q AS (SELECT doc_id AS query, text AS question, {_WORDS} AS qw FROM c WHERE doc_id % 100 = 0 AND i = 0),
n AS (SELECT doc_id, i // 4 AS g, arg_min(text, i) AS summary, list(id ORDER BY id) AS kids FROM c WHERE doc_id % 200 = 0 GROUP BY ALL HAVING count(*) >= 3),
s AS (SELECT n.*, round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM n JOIN embeddings a ON a.vec_id = (doc_id + g) % 500 JOIN embeddings b ON b.vec_id = doc_id % 500),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, g) AS r FROM s),
u AS (SELECT doc_id AS query, 1 AS level, 1000000 + g AS id, 'RAPTOR Summary' AS title, score, summary AS text FROM t WHERE r <= 3 AND g % 2 = 0
    UNION ALL SELECT t.doc_id, 0, c.id, coalesce(title, 'Unknown'), score, text FROM (SELECT doc_id, score, unnest(kids) AS id FROM t WHERE r <= 3 AND g % 2 = 1) t JOIN c USING (id)),
w AS (SELECT id, title, text, {_WORDS} AS w FROM c), z AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_dl FROM w WHERE len(w) > 0),
p AS (SELECT id, len(w) AS dl, term, count(*) AS tf FROM (SELECT id, w, unnest(w) AS term FROM w) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
b AS (SELECT query, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score FROM (SELECT query, unnest(list_distinct(qw)) AS term FROM q WHERE query IN (SELECT query FROM q WHERE query NOT IN (SELECT doc_id FROM n))) JOIN p USING (term) JOIN f USING (term), z GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM b),
g AS (SELECT k.query, k.id, coalesce(w.title, 'Unknown') AS title, k.r, CAST(greatest(1, least(5, ceil(CASE WHEN len(qw) = 0 THEN 0 ELSE len(list_intersect(list_distinct(qw), w.w)) / len(list_distinct(qw)) END * 5))) AS INTEGER) AS grade FROM k JOIN w ON w.id = k.id JOIN q ON q.query = k.query WHERE k.r <= 3),
m AS (SELECT *, max(grade) OVER (PARTITION BY query) AS best FROM g),
o AS (SELECT query, string_agg('0:' || id || ':' || title, ';' ORDER BY grade DESC, r) AS sources FROM m WHERE grade >= CASE WHEN best >= 3 THEN 3 WHEN best >= 2 THEN 2 ELSE 0 END GROUP BY query)
SELECT query, true AS from_tree, string_agg(level || ':' || id || ':' || title, ';' ORDER BY score DESC, level, id) AS sources, md5(string_agg(text, chr(10) || chr(10) ORDER BY score DESC, level, id)) AS context_md5 FROM u GROUP BY query
UNION ALL SELECT q.query, false, coalesce(sources, ''), NULL FROM q LEFT JOIN o USING (query) WHERE q.query NOT IN (SELECT doc_id FROM n)""",
}
