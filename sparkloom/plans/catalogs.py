"""Registered queries over catalogs, devices and rule-like operators; TPC-H-like tables play models, files, instances and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import sizing, text
from sparkloom.operators import catalogs, trees
from sparkloom.sources.tables import table


def model_discovery(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as files in folders of seven; every fifth is a projector, some are no models."""
    p = F.col("p_partkey")
    name = F.concat(F.when(p % 5 == 0, "mmproj-").otherwise("m-"), p.cast("string"), F.when(p % 11 == 0, ".txt").otherwise(".GGUF"))
    files = table(spark, sf, "part").select(F.concat(F.lit("models/d"), F.floor(p / 7).cast("string"), F.lit("/"), name).alias("path"), F.col("p_size").alias("size"))
    return catalogs.discovered(files)


def _instances(spark: SparkSession, sf: str) -> DataFrame:
    o = F.col("o_orderkey")
    return table(spark, sf, "orders").select((F.col("o_custkey") % 500).alias("model_id"), o.alias("instance_id"), F.when(F.col("o_orderstatus") == "F", "ready").when(o % 50 == 0, "error").otherwise("busy").alias("state"), (o % 9).alias("requests"), (o % 2 == 0).alias("ephemeral"), (o % 1000).cast("double").alias("last_used"))


def status_rollup(spark: SparkSession, sf: str) -> DataFrame:
    models = table(spark, sf, "customer").select(F.col("c_custkey").alias("model_id"), (F.col("c_custkey") % 90 + 10).alias("memory_mb"))
    return catalogs.statuses(_instances(spark, sf), models)


def least_loaded(spark: SparkSession, sf: str) -> DataFrame:
    return catalogs.least_busy(_instances(spark, sf))


def idle_reaper(spark: SparkSession, sf: str) -> DataFrame:
    return catalogs.reapable(_instances(spark, sf), F.lit(1000.0), 300.0).select("instance_id", "state")


def route_candidates(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    found = catalogs.candidates(F.array(n, n + 1), F.array(n + 1, n + 2), F.when(n % 5 == 0, F.lit(99)))
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(F.transform(found, lambda x: x.cast("string")), ",").alias("ids"))


def task_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as requests of tasks: how many there are, by priority, and which are not kept."""
    named = F.element_at(F.array(*[F.lit(t) for t in ("chat", "embed", "grade", "hyde", "tts", "mine", "enrich", "classify")]), (F.col("event_id") % 8 + 1).cast("int"))
    tasks = table(spark, sf, "events").select(named.alias("task"))
    return tasks.groupBy("task", catalogs.task_priority(F.col("task")).alias("priority"), catalogs.is_ephemeral(F.col("task")).alias("ephemeral")).agg(F.count("*").alias("n"))


def alternatives(spark: SparkSession, sf: str) -> DataFrame:
    pick = lambda items, n: F.element_at(F.array(*[F.lit(x) for x in items]), (n % len(items) + 1).cast("int"))
    p = F.col("p_partkey")
    t = table(spark, sf, "part").select("p_partkey", pick(["70B", "30B", "13B", "7B", "3B"], p).alias("a"), pick(["Q4", "Q8", "F16"], F.floor(p / 5)).alias("b"), (F.col("p_size") % 24).cast("double").alias("ram"))
    return t.select("p_partkey", catalogs.alternative(F.col("a"), F.col("b"), F.col("ram")).alias("x")).select("p_partkey", "x.suggestion", "x.reason")


def app_process(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as processes of nations: the best scored, if it's likely enough."""
    k = F.col("s_suppkey")
    name = F.when(k % 4 == 0, "app").when(k % 4 == 1, "node").otherwise("sh")
    command = F.when(k % 6 == 0, F.lit("/x/target/debug/app")).when(k % 6 == 1, F.lit("run suite")).when(k % 6 == 3, F.lit("tauri dev")).otherwise(F.lit("run"))
    s = table(spark, sf, "supplier").select("s_nationkey", "s_suppkey", catalogs.app_score(name, command, k % 10 == 0, product="suite").alias("score"))
    best = s.groupBy("s_nationkey").agg(F.max(F.struct("score", -F.col("s_suppkey"))).alias("b"))
    return best.select("s_nationkey", (-F.col("b.col2")).alias("pid"), F.col("b.score").cast("int").alias("score")).where("score >= 80")


def cold_starts(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    ms, s = F.when(e % 3 != 0, e * 10), F.when(e % 7 != 0, e.cast("double"))
    found = catalogs.cold_start_seconds(ms, ms + F.col("user_id") - 50, s, s + 2.5)
    return table(spark, sf, "events").select("event_id", F.round(found, 3).alias("seconds"))


def table_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as shapes on the page of their supplier."""
    x, y = F.col("l_quantity") * 3, F.col("l_extendedprice") % 3000
    wide = F.when(F.col("l_linenumber") % 3 != 0, 120.0).otherwise(10.0)
    shapes = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("page"), x.alias("x1"), F.round(y, 2).alias("y1"), (x + wide).alias("x2"), (F.round(y, 2) + 1).alias("y2"))
    return catalogs.table_boxes(shapes).select("page", F.round("x1", 4).alias("x1"), F.round("y1", 4).alias("y1"), F.round("x2", 4).alias("x2"), F.round("y2", 4).alias("y2"))


def softmax_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The first four numbers of each vector as logits of three named classes and one without."""
    logits = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double") * 10)
    e = table(spark, sf, "embeddings").select("vec_id", catalogs.labelled(logits, ["simple_rag", "multi_doc", "no_retrieval"]).alias("c"), F.round(catalogs.sigmoid(F.element_at("embedding", 1).cast("double")), 6).alias("first_sigmoid"))
    return e.select("vec_id", "c.label", F.round("c.confidence", 6).alias("confidence"), "first_sigmoid")


def band_zscores(spark: SparkSession, sf: str) -> DataFrame:
    """Dimensions of vectors as mel bands."""
    bands = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("band", "v")).select("vec_id", "band", F.col("v").cast("double").alias("value"))
    return catalogs.standardized_bands(bands).select("vec_id", "band", F.round("z", 4).alias("z"))


def result_page(spark: SparkSession, sf: str) -> DataFrame:
    return catalogs.page_of(table(spark, sf, "part").select("p_partkey", "p_retailprice"), [F.desc("p_retailprice"), "p_partkey"], 3)


def human_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """Squares of parts' numbers as sizes; the largest unit is GB."""
    return table(spark, sf, "part").select("p_partkey", text.human_size(F.col("p_partkey") * F.col("p_partkey") * 97, "GB").alias("size"))


def params_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Defaults under a request's own values; empty ones dropped."""
    n = F.col("n_nationkey").cast("string")
    merged = F.map_concat(F.create_map(F.lit("ctx"), F.lit("4096"), F.lit("stop"), F.lit("")), F.create_map(F.lit("temp"), n))
    kept = F.map_filter(merged, lambda k, v: v != "")
    return table(spark, sf, "nation").select("n_nationkey", F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("params"))


def eta(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_id", F.round(catalogs.eta_seconds(F.col("event_id") % 10, F.lit(10), F.col("value")), 4).alias("left_s"), catalogs.retry_seconds(F.col("event_id") % 7 + 1).cast("long").alias("retry_s"))


def throughput(spark: SparkSession, sf: str) -> DataFrame:
    """Sums of values over each tumbling hour, a second."""
    w = table(spark, sf, "events").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.sum(F.col("value").cast("decimal(18,4)")).alias("total"))
    return w.select(F.col("w.start").cast("long").alias("start_s"), (F.col("total").cast("double") / 3600).alias("a_second"))


def cluster_texts(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in clusters of a language and 16 ids, so that none grows with the table; whole texts numbered and joined."""
    from sparkloom.operators.raptor import joined_texts

    d = table(spark, sf, "documents").select("lang", F.floor(F.col("doc_id") / 16).alias("cluster"), F.col("doc_id").alias("id"), "text")
    return d.groupBy("lang", "cluster").agg(F.count("*").alias("n"), F.md5(joined_texts(most=None)).alias("text_md5"))


def cluster_texts_cut(spark: SparkSession, sf: str) -> DataFrame:
    """The same, cut at 4,000 bytes as a summary's prompt is."""
    from sparkloom.operators.raptor import joined_texts

    d = table(spark, sf, "documents").select("lang", F.floor(F.col("doc_id") / 16).alias("cluster"), F.col("doc_id").alias("id"), "text")
    return d.groupBy("lang", "cluster").agg(F.count("*").alias("n"), F.md5(joined_texts()).alias("text_md5"))


def mind_map(spark: SparkSession, sf: str) -> DataFrame:
    """Nations under regions as graphs, flattened with their layout."""
    n = table(spark, sf, "nation")
    rows = n.select(F.col("n_regionkey").alias("graph_id"), (F.col("n_nationkey") + 1).cast("long").alias("node_id"), F.lit(0).cast("long").alias("parent_id")).unionByName(table(spark, sf, "region").select(F.col("r_regionkey").alias("graph_id"), F.lit(0).cast("long").alias("node_id"), F.lit(None).cast("long").alias("parent_id")))
    return trees.layout(trees.flattened(rows))


def size_classes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").groupBy(sizing.params_of(F.lit("plain"), F.col("p_size").cast("double")).alias("params")).agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (model_discovery, status_rollup, least_loaded, idle_reaper, route_candidates, task_classes, alternatives, app_process, cold_starts, table_regions, softmax_labels, band_zscores, result_page, human_sizes, params_merge, eta, throughput, cluster_texts, cluster_texts_cut, mind_map, size_classes)}

_FILES = "(SELECT p_partkey // 7 AS f, CASE WHEN p_partkey % 5 = 0 THEN 'mmproj-' ELSE 'm-' END || p_partkey || '.GGUF' AS file, p_partkey % 5 = 0 AS proj, p_size AS size FROM part WHERE p_partkey % 11 <> 0)"
_INSTANCES = "(SELECT o_custkey % 500 AS model_id, o_orderkey AS instance_id, CASE WHEN o_orderstatus = 'F' THEN 'ready' WHEN o_orderkey % 50 = 0 THEN 'error' ELSE 'busy' END AS state, o_orderkey % 9 AS requests, o_orderkey % 2 = 0 AS ephemeral, CAST(o_orderkey % 1000 AS DOUBLE) AS last_used FROM orders)"
_SCORE = "CASE s_suppkey % 6 WHEN 0 THEN 200 WHEN 1 THEN 120 ELSE 0 END - CASE WHEN s_suppkey % 6 = 3 AND s_suppkey % 4 = 1 THEN 50 ELSE 0 END + CASE WHEN s_suppkey % 4 = 0 THEN 80 ELSE 0 END - CASE WHEN s_suppkey % 4 = 1 THEN 200 ELSE 0 END + CASE WHEN s_suppkey % 10 = 0 THEN 0 ELSE 10 END"
_RULES = "(SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY page) AS n FROM (SELECT l_suppkey AS page, l_quantity * 3 AS x1, round(l_extendedprice % 3000, 2) AS y1, l_quantity * 3 + 120 AS x2, round(l_extendedprice % 3000, 2) + 1 AS y2 FROM lineitem WHERE l_linenumber % 3 <> 0)) WHERE n >= 4)"

SQL = {
    "model_discovery": f"SELECT 'models/d' || f AS folder, last(file ORDER BY size, file) FILTER (NOT proj) AS model, last(file ORDER BY size, file) FILTER (proj) AS projector FROM {_FILES} GROUP BY f HAVING count(*) FILTER (NOT proj) > 0",
    "status_rollup": f"SELECT c_custkey AS model_id, CASE WHEN n IS NULL THEN 'unloaded' WHEN r THEN 'ready' ELSE 'loading' END AS status, coalesce(n, 0) * (c_custkey % 90 + 10) AS memory_mb FROM customer LEFT JOIN (SELECT model_id, count(*) AS n, bool_or(state = 'ready') AS r FROM {_INSTANCES} GROUP BY model_id) ON model_id = c_custkey",
    "least_loaded": f"SELECT model_id, first(instance_id ORDER BY requests, instance_id) AS instance_id FROM {_INSTANCES} GROUP BY model_id",
    "idle_reaper": f"SELECT instance_id, state FROM {_INSTANCES} WHERE state = 'error' OR (ephemeral AND requests = 0 AND 1000 - last_used >= 300)",
    "route_candidates": "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN '99' ELSE n_nationkey || ',' || (n_nationkey + 1) || ',' || (n_nationkey + 2) END AS ids FROM nation",
    "task_classes": "SELECT task, CASE WHEN task IN ('embed', 'classify', 'enrich', 'grade', 'hyde') THEN 'low' ELSE 'high' END AS priority, task IN ('enrich', 'grade', 'hyde') AS ephemeral, count(*) AS n FROM (SELECT list_extract(['chat', 'embed', 'grade', 'hyde', 'tts', 'mine', 'enrich', 'classify'], CAST(event_id % 8 + 1 AS INTEGER)) AS task FROM events) GROUP BY ALL",
    "alternatives": """SELECT p_partkey, x[1] AS suggestion, x[2] AS reason FROM (SELECT p_partkey, CASE p_partkey % 5
    WHEN 0 THEN CASE WHEN r >= 16 THEN ['13B Q4', 'Similar quality for most tasks, much faster'] ELSE ['7B Q4', 'Good quality, runs well on most systems'] END
    WHEN 1 THEN CASE WHEN r >= 12 THEN ['13B Q4', 'Better performance with similar capability'] ELSE ['7B Q4', 'Good balance of quality and speed'] END
    WHEN 2 THEN CASE WHEN h THEN ['13B Q4', 'Same model, much smaller footprint'] WHEN r < 12 THEN ['7B Q4', 'Lighter model that fits your RAM'] END
    WHEN 3 THEN CASE WHEN h THEN ['7B Q4', 'Same model, better performance'] WHEN r < 8 THEN ['3B Q4', 'Smaller model that fits your RAM'] END END AS x
    FROM (SELECT p_partkey, p_size % 24 AS r, (p_partkey // 5) % 3 > 0 AS h FROM part))""",
    "app_process": f"SELECT s_nationkey, s_suppkey AS pid, CAST(score AS INTEGER) AS score FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY score DESC, s_suppkey) AS r FROM (SELECT s_nationkey, s_suppkey, {_SCORE} AS score FROM supplier)) WHERE r = 1 AND score >= 80",
    "cold_starts": "SELECT event_id, round(CASE WHEN event_id % 3 <> 0 THEN greatest(0, (user_id - 50) / 1000.0::DOUBLE) WHEN event_id % 7 <> 0 THEN 2.5::DOUBLE END, 3) AS seconds FROM events",
    "table_regions": f"SELECT page, round(min(x1), 4) AS x1, round(min(y1), 4) AS y1, round(max(x2), 4) AS x2, round(max(y2), 4) AS y2 FROM (SELECT *, sum(CASE WHEN y1 - before > 100 THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y1) AS run FROM (SELECT *, lag(y1) OVER (PARTITION BY page ORDER BY y1) AS before FROM {_RULES})) GROUP BY page, run HAVING count(*) >= 3",
    "softmax_labels": "SELECT vec_id, CASE k WHEN 1 THEN 'simple_rag' WHEN 2 THEN 'multi_doc' WHEN 3 THEN 'no_retrieval' ELSE 'class_3' END AS label, round(m / s, 6) AS confidence, round(1 / (1 + exp(-CAST(embedding[1] AS DOUBLE))), 6) AS first_sigmoid FROM (SELECT *, list_max(e) AS m, list_sum(e) AS s, 5 - list_position(list_reverse(e), list_max(e)) AS k FROM (SELECT vec_id, embedding, list_transform(embedding[1:4], lambda x: exp(CAST(x AS DOUBLE) * 10)) AS e FROM embeddings))",
    "band_zscores": "SELECT vec_id, CAST(band AS INTEGER) AS band, round((v - avg(v) OVER w) / (sqrt(var_pop(v) OVER w) + 1e-5), 4) AS z FROM (SELECT vec_id, unnest(range(len(embedding))) AS band, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings) WINDOW w AS (PARTITION BY band)",
    "result_page": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 5 OFFSET 15",
    "params_merge": "SELECT n_nationkey, 'ctx=4096;temp=' || n_nationkey AS params FROM nation",
    "eta": "SELECT event_id, CASE WHEN event_id % 10 > 0 THEN round(value / (event_id % 10) * (10 - event_id % 10), 4) END AS left_s, CAST(2 * pow(2, least(event_id % 7, 4)) AS BIGINT) AS retry_s FROM events",
    "throughput": "SELECT CAST(floor(epoch(ts) / 3600) * 3600 AS BIGINT) AS start_s, CAST(sum(CAST(value AS DECIMAL(18, 4))) AS DOUBLE) / 3600 AS a_second FROM events GROUP BY 1",
    "human_sizes": "SELECT p_partkey, CASE WHEN n < 1024 THEN format('{:,.1f} B', n) WHEN n < 1048576 THEN format('{:,.1f} KB', n / 1024) WHEN n < 1073741824 THEN format('{:,.1f} MB', n / 1048576) ELSE format('{:,.1f} GB', n / 1073741824) END AS size FROM (SELECT p_partkey, CAST(p_partkey * p_partkey * 97 AS DOUBLE) AS n FROM part)",
    "cluster_texts": "SELECT lang, doc_id // 16 AS cluster, count(*) AS n, md5(string_agg('Document ' || i || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id)) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY lang, doc_id // 16 ORDER BY doc_id) AS i FROM documents) GROUP BY lang, doc_id // 16",
    "cluster_texts_cut": "WITH c AS (SELECT lang, doc_id // 16 AS cluster, count(*) AS n, string_agg('Document ' || i || ':' || chr(10) || text, chr(10) || chr(10) ORDER BY doc_id) AS t FROM (SELECT *, row_number() OVER (PARTITION BY lang, doc_id // 16 ORDER BY doc_id) AS i FROM documents) GROUP BY ALL) SELECT lang, cluster, n, md5(CASE WHEN strlen(t) <= 4000 THEN t ELSE left(t, list_max(list_filter(range(1000, 4001), lambda k: strlen(left(t, k)) <= 4000))) || chr(10) || '[truncated...]' END) AS text_md5 FROM c",
    "mind_map": "SELECT n_regionkey AS graph_id, CAST(n_nationkey + 1 AS BIGINT) AS node_id, 1 AS depth, p AS path, 260 AS x, CAST((row_number() OVER (PARTITION BY n_regionkey ORDER BY p) - 1) * 92 AS INTEGER) AS y FROM (SELECT *, '0.' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1) AS p FROM nation) UNION ALL SELECT r_regionkey, 0, 0, '0', 0, 0 FROM region",
    "size_classes": "SELECT CASE WHEN g < 4 THEN '1B' WHEN g < 9.5 THEN '3B' WHEN g < 19.5 THEN '7B' WHEN g < 43 THEN '13B' WHEN g < 100 THEN '30B' ELSE '70B' END AS params, count(*) AS n FROM (SELECT p_size / 0.5::DOUBLE AS g FROM part) GROUP BY 1",
}
