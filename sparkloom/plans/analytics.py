"""Registered queries over runs, catalogs, trees, conversations and document lifecycles.

Fixtures: ``events`` are a sampler's rows (user_id a process, value a measurement, event_type a kind), TPC-H-like tables are catalogs and results.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import sizing
from sparkloom.operators import conversations, lifecycle, ordered, runs, search, trees
from sparkloom.sources.tables import shared_folder, table
from sparkloom.streaming import jobs, stateful


def _samples(spark: SparkSession, sf: str) -> DataFrame:
    """Events with seconds since their kind's first."""
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("double").alias("t"), "user_id", "event_type", "value")
    first = e.groupBy("event_type").agg(F.min("t").alias("t0"))
    return e.join(F.broadcast(first), "event_type").withColumn("elapsed", F.round(F.col("t") - F.col("t0"), 3)).drop("t0")


def idle_window_metrics(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.idle_window(_samples(spark, sf), F.lit(3600.0), 86_400.0, by=["event_type"])
    return found.select("event_type", F.round("median_idle", 6).alias("median_idle"), "peak", F.col("n_idle").cast("long").alias("n_idle"))


def idle_window_extended(spark: SparkSession, sf: str) -> DataFrame:
    """Medians and peaks of several measures, some of them missing now and then."""
    k = F.get_json_object("props", "$.k").cast("double")
    e = _samples(spark, sf).join(table(spark, sf, "events").select("event_id", "props"), "event_id").withColumns({"k": F.when(F.col("event_id") % 3 != 0, k), "both": F.col("value") + k})
    found = runs.idle_windows(e, F.lit(3600.0), 86_400.0, by=["event_type"], values=["value", "k", "both"])
    return found.select("event_type", F.col("n_idle").cast("long").alias("n_idle"), *[F.round(c, 6).alias(c) for c in found.columns if c.startswith(("peak_", "median_"))])


def counter_rates(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.rates(_samples(spark, sf), by="user_id", time="t", counter="value")
    return found.select("event_id", F.round("rate", 4).alias("rate"))


def fifo_pairing(spark: SparkSession, sf: str) -> DataFrame:
    kinds = ("click", "purchase")
    found = runs.paired(table(spark, sf, "events"), by="user_id", kind="event_type", opens=kinds[0], closes=kinds[1], at="ts", ident="event_id")
    return found.select("user_id", "n", "open_id", "close_id", F.round("seconds", 3).alias("seconds"), F.round(F.col("close_value") - F.col("open_value"), 4).alias("delta"))


def _streamed(spark: SparkSession, sf: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream of the events' files has made, through to their end."""
    path = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = jobs.events_stream(spark, f"{sf}/events.parquet", spark.read.parquet(f"{sf}/events.parquet").schema, files_a_batch=1_000)
    return stateful.written_through(make(stream), f"{path}/out", f"{path}/checkpoint")


def stream_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Counter rates by a stream that keeps each user's last sample."""
    found = _streamed(spark, sf, lambda s: stateful.rates(s, by="user_id", time="ts", counter="value", ident="event_id"))
    return found.select(F.col("id").alias("event_id"), F.round("rate", 4).alias("rate"))


def stream_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """First-in-first-out pairs by a stream that keeps each user's open clicks."""
    found = _streamed(spark, sf, lambda s: stateful.pairs(s, by="user_id", kind="event_type", opens="click", closes="purchase", at="ts", ident="event_id"))
    return found.select(F.col("key").alias("user_id"), "n", "open_id", "close_id", F.round("seconds", 3).alias("seconds"), F.round("delta", 4).alias("delta"))


def periodic_overhead(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.periodic_overhead(_samples(spark, sf).withColumn("elapsed", F.floor("elapsed")), 60.0, 36_000.0, by="event_type")
    return found.select("event_type", F.round("overhead", 4).alias("overhead"))


def null_poison_sum(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("v", F.when(F.col("event_id") % 97 != 0, F.col("event_id")))
    return e.groupBy("user_id").agg(runs.spoiled_sum("v").alias("spoiled"), F.sum("v").alias("plain"))


def best_config_per_group(spark: SparkSession, sf: str) -> DataFrame:
    found = runs.best(table(spark, sf, "lineitem").where("l_returnflag = 'R'"), by="l_suppkey", metric="l_extendedprice", order=["l_orderkey", "l_linenumber"])
    return found.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")


def metric_pivot(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as bench lines: odd quantities are prompt runs, even ones generate."""
    q = F.col("l_quantity").cast("long")
    r = table(spark, sf, "lineitem").select("l_partkey", q.alias("p"), F.when(q % 2 == 0, q).otherwise(0).alias("g"), F.col("l_extendedprice").alias("ts"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("at"))
    return runs.both_phases(r, by=["l_partkey"], prompt="p", generated="g", speed="ts", order="at")


def config_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Every combination of the flags, statuses and line numbers that the line items have."""
    return runs.grid(table(spark, sf, "lineitem").withColumn("taxed", F.col("l_tax") > 0), ["l_returnflag", "l_linestatus", "l_linenumber", "taxed"])


def gap_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of a user's events at most six hours apart, with their bounds."""
    e = table(spark, sf, "events").select("user_id", F.col("ts").cast("double").alias("t"), "value")
    g = runs.gap_groups(e, by="user_id", at="t", gap=21_600.0)
    return g.groupBy("user_id", "run").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")).select("user_id", F.col("run").cast("long").alias("run"), "n", "low", "high")


def bench_json(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON lines among others, read back."""
    line = F.when(F.col("event_id") % 3 == 0, F.lit("warming up")).otherwise(F.to_json(F.struct(F.lit(128).alias("n_prompt"), (F.col("event_id") % 64).cast("int").alias("n_gen"), F.col("value").alias("avg_ts"))))
    found = runs.bench_lines(table(spark, sf, "events").select(line.alias("value")))
    return found.groupBy("n_gen").agg(F.count("*").alias("n"), F.max("avg_ts").alias("best"))


def log_parse(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a runtime log, parsed into typed events."""
    m = F.concat(F.lit("'m"), (F.col("user_id") % 7).cast("string"), F.lit("'"))
    i = F.concat(F.lit("'i"), F.col("event_id").cast("string"), F.lit("'"))
    kinds = [F.concat(F.lit("INFO Spawning new instance "), i, F.lit(" for model "), m), F.concat(F.lit("INFO Instance "), i, F.lit(" for model "), m, F.lit(" is ready")), F.concat(F.lit("[BENCH] MODEL_START_READY model_id="), F.translate(m, "'", ""), F.lit(" ts_ms="), (F.col("event_id") * 10).cast("string"), F.lit(" elapsed_ms="), (F.col("event_id") % 100).cast("string")), F.lit("nothing of note")]
    lines = table(spark, sf, "events").select(F.element_at(F.array(*kinds), (F.col("event_id") % 4 + 1).cast("int")).alias("value"))
    return runs.log_events(lines).groupBy("kind", "subject").agg(F.count("*").alias("n"), F.sum("elapsed_ms").alias("elapsed_ms"))


def process_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as processes whose parent is a tenth of their number; totals under 1 to 9."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("pid"), F.floor(F.col("c_custkey") / 10).alias("ppid"), "c_acctbal")
    found = trees.descendants(c.select("pid", "ppid"), c.where("pid between 1 and 9").select(F.col("pid").alias("root")))
    return found.join(c, "pid").groupBy("root").agg(F.count("*").alias("n"), F.max("depth").cast("int").alias("depth"), F.round(F.sum(F.col("c_acctbal").cast("decimal(18,2)")), 2).cast("double").alias("total"))


def tree_flatten(spark: SparkSession, sf: str) -> DataFrame:
    """All customers as a tree of tens."""
    k = F.col("c_custkey")
    n = table(spark, sf, "customer").select(F.lit(1).alias("graph_id"), k.alias("node_id"), F.when(k >= 10, F.floor(k / 10)).alias("parent_id"))
    return trees.layout(trees.flattened(n)).select("node_id", "depth", "path", "x", "y")


def conversation_truncate(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.truncated(table(spark, sf, "conversations"), most_tokens=400, last=3).select("conv_id", "turn", "role")


def session_titles(spark: SparkSession, sf: str) -> DataFrame:
    return conversations.titles(table(spark, sf, "conversations"))


def role_filter(spark: SparkSession, sf: str) -> DataFrame:
    t = conversations.known_roles(table(spark, sf, "conversations"))
    return t.groupBy("role").agg(F.count("*").alias("n"), F.count_if(conversations.long_enough(F.col("text"))).alias("n_long"))


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of documents as chunks: with a vector unless it's every seventh, enriched in documents of even id or in their first three lines."""
    lines = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("chunk_index", "text"))
    enriched = F.when(((F.col("doc_id") % 2 == 0) | (F.col("chunk_index") < 3)) & (F.col("doc_id") % 5 != 0), F.upper("text"))
    vector = F.when((F.col("doc_id") + F.col("chunk_index")) % 7 != 0, F.array(F.length("text").cast("float")))
    return lines.withColumns({"enriched_text": enriched, "embedding": vector, "enriched_embedding": F.when(enriched.isNotNull(), F.array(F.lit(1.0).cast("float")))})


def enrichment_queue(spark: SparkSession, sf: str) -> DataFrame:
    return lifecycle.waiting_for_enrichment(_chunks(spark, sf), 50).select("doc_id", "chunk_index")


def document_phase(spark: SparkSession, sf: str) -> DataFrame:
    found = lifecycle.listed(table(spark, sf, "documents").select("doc_id"), _chunks(spark, sf))
    return found.select("doc_id", "chunk_count", "enriched_count", "phase")


def docs_without_tree(spark: SparkSession, sf: str) -> DataFrame:
    listed = lifecycle.listed(table(spark, sf, "documents").select("doc_id"), _chunks(spark, sf))
    return lifecycle.without_tree(listed, table(spark, sf, "labels").select("doc_id")).select("doc_id")


def searchable_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with a vector, by document; the enriched one where there is one."""
    c = lifecycle.best_vector(_chunks(spark, sf))
    return c.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.element_at("vector", 1).cast("double")).alias("total"))


def upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's newest order over the older ones, then every third customer's dearest over it."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").cast("string").alias("day"), "o_totalprice")
    newest = lifecycle.latest(o, "o_custkey", F.desc("day"), F.desc("o_orderkey"))
    dearest = lifecycle.latest(o.where("o_custkey % 3 = 0"), "o_custkey", F.desc("o_totalprice"), "o_orderkey")
    return lifecycle.upserted(newest, dearest, "o_custkey").select("o_custkey", "o_orderkey")


def delete_cascade(spark: SparkSession, sf: str) -> DataFrame:
    """What is left of documents, labels and chunks after every tenth document went."""
    docs = table(spark, sf, "documents")
    left = lifecycle.without_documents({"documents": docs.select("doc_id"), "labels": table(spark, sf, "labels").select("doc_id"), "chunks": _chunks(spark, sf).select("doc_id")}, docs.where("doc_id % 10 = 0"))
    out = None
    for name, df in left.items():
        n = df.agg(F.lit(name).alias("name"), F.count("*").alias("n"))
        out = n if out is None else out.unionByName(n)
    return out


def ordered_fetch(spark: SparkSession, sf: str) -> DataFrame:
    """Rows by a list of ids with repeats and unknown ones, in the list's order."""
    ids = spark.range(20).select((F.col("id") + 1).cast("int").alias("rank"), F.when(F.col("id") % 5 == 4, F.lit(-1)).otherwise(F.pmod(F.col("id") * 37, F.lit(50))).alias("doc_id"))
    return lifecycle.in_order(ids, table(spark, sf, "documents").select("doc_id", "source"), "doc_id").select("rank", "doc_id", "source")


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("p_partkey")
    quants, sizes = ["q4_k_m", "q8_0", "IQ2_XXS", "f16", "Q5_K_S", "plain"], ["7b", "1.5B", "13b", "8x3b", "70b", "instruct"]
    pick = lambda items, n: F.element_at(F.array(*[F.lit(x) for x in items]), (n % len(items) + 1).cast("int"))
    name = F.concat(F.lit("model-"), pick(sizes, p), F.lit("-"), pick(quants, F.floor(p / 7)), F.lit(".gguf"))
    return table(spark, sf, "part").select("p_partkey", name.alias("name"), (F.col("p_size") * 211 + 100).cast("long").alias("size_mb"), F.when(p % 2 == 0, 8192).otherwise(4096).alias("ctx"), (p % 16 + 1).alias("cores"), (p % 3 != 0).alias("avx2"), (F.col("p_size") % 32 + 4).cast("double").alias("ram"), (p % 60).cast("double").alias("disk"))


def quant_from_name(spark: SparkSession, sf: str) -> DataFrame:
    return _parts(spark, sf).select("p_partkey", sizing.quant_of(F.col("name")).alias("quant"), sizing.billions_of(F.col("name")).alias("billions"))


def size_tier(spark: SparkSession, sf: str) -> DataFrame:
    s = F.col("size_mb")
    return _parts(spark, sf).select("p_partkey", sizing.size_tier(s).alias("tier"), sizing.recommended_ram_gb(s).alias("ram_gb"), sizing.memory_mb(s).alias("memory_mb"))


def compat_score(spark: SparkSession, sf: str) -> DataFrame:
    c = sizing.compatibility(F.col("name"), F.col("size_mb"), F.lit(None).cast("long"), F.col("ctx"), F.col("cores"), F.col("avx2"), F.col("ram"), F.col("disk"))
    return _parts(spark, sf).select("p_partkey", c.alias("c")).select("p_partkey", "c.params", F.round("c.required_ram_gb", 4).alias("required_ram_gb"), F.round("c.perf_score", 4).alias("perf_score"), "c.ram_decision", "c.rating")


def catalog_priority(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as models: size is the priority, every fourth has its own for the task."""
    p = F.col("p_partkey")
    m = table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.col("p_size").alias("priority"), F.when(p % 3 == 0, F.array(F.lit("chat"), F.lit("embed"))).otherwise(F.array(F.lit("chat"))).alias("tasks"), F.when(p % 4 == 0, F.create_map(F.lit("embed"), (p % 90).cast("int"))).otherwise(F.create_map().cast("map<string,int>")).alias("task_priorities"))
    order = lifecycle.by_priority(m.withColumn("name", F.concat("name", F.lit("#"), p.cast("string"))), "embed", 100)
    return order.select("p_partkey", "rank")


def catalog_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers known against those found: tens vanished, fives changed, new ones came."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_name")
    found = s.where("s_suppkey % 10 <> 0").withColumn("s_name", F.when(F.col("s_suppkey") % 5 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")))
    return lifecycle.changes(found, s.where("s_suppkey % 7 <> 0"), "s_suppkey", "s_name")


def catalog_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of each origin; 0 where the built-in rows hold all custom keys."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.lit("builtin").alias("origin"))
    custom = spark.range(1, 2000).select(F.col("id").alias("s_suppkey"), F.lit("custom").alias("origin"))
    counts = lifecycle.merged_catalogs(s, custom, "s_suppkey").agg(*[F.count_if(F.col("origin") == x).alias(x) for x in ("builtin", "custom")])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(x).alias("origin"), F.col(x).alias("n")) for x in ("builtin", "custom")])))


def fuzzy_match(spark: SparkSession, sf: str) -> DataFrame:
    """References by id, by path in other letters and slashes, by base name, and to nothing."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("model_id"), F.concat(F.lit("models/Dir"), (F.col("s_suppkey") % 7).cast("string"), F.lit("/M"), F.col("s_suppkey").cast("string"), F.lit(".gguf")).alias("path"), "s_suppkey")
    k = F.col("s_suppkey") % 4
    ref = F.when(k == 0, F.col("model_id")).when(k == 1, F.upper(F.replace("path", F.lit("/"), F.lit("\\")))).when(k == 2, F.concat(F.lit("elsewhere/m"), F.col("s_suppkey").cast("string"), F.lit(".GGUF"))).otherwise(F.lit("none"))
    return lifecycle.matched_by_path(s.select(ref.alias("ref")).distinct(), s.select("model_id", "path"))


def tumbling_windows(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    w = e.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return w.select(F.col("window.start").cast("long").alias("start_s"), "event_type", "n", "peak")


def label_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Members of each cluster, numbered in input order: a row a member, as a cluster may hold most of them."""
    return ordered.with_row_number(table(spark, sf, "embeddings").select("label", "vec_id"), ["label"], ["vec_id"], "place").select("label", "vec_id", F.col("place").cast("long").alias("place"))


QUERIES = {f.__name__: f for f in (idle_window_metrics, idle_window_extended, counter_rates, fifo_pairing, stream_rates, stream_pairs, periodic_overhead, null_poison_sum, best_config_per_group, metric_pivot, config_grid, gap_sessions, bench_json, log_parse, process_closure, tree_flatten, conversation_truncate, session_titles, role_filter, enrichment_queue, document_phase, docs_without_tree, searchable_chunks, upsert_latest, delete_cascade, ordered_fetch, quant_from_name, size_tier, compat_score, catalog_priority, catalog_diff, catalog_merge, fuzzy_match, tumbling_windows, label_groups)}

_SAMPLES = "(SELECT event_id, epoch(ts) AS t, user_id, event_type, value, round(epoch(ts) - min(epoch(ts)) OVER (PARTITION BY event_type), 3) AS elapsed FROM events)"
_LINES = "(SELECT doc_id, unnest(range(len(l))) AS chunk_index, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"
_CHUNKS = f"(SELECT doc_id, chunk_index, text, CASE WHEN (doc_id % 2 = 0 OR chunk_index < 3) AND doc_id % 5 <> 0 THEN 1 END AS enriched, CASE WHEN (doc_id + chunk_index) % 7 <> 0 THEN length(text) END AS v FROM {_LINES})"
_LISTED = f"(SELECT doc_id, chunk_count, enriched_count, CASE WHEN enriched_count >= chunk_count AND chunk_count > 0 THEN 'phase2_complete' WHEN enriched_count > 0 THEN 'phase2_in_progress' ELSE 'phase1_complete' END AS phase FROM (SELECT doc_id, count(*) AS chunk_count, count(enriched) AS enriched_count FROM {_CHUNKS} GROUP BY doc_id))"
_ORDERS = "(SELECT o_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, o_totalprice FROM orders)"
_PARTS = """(SELECT p_partkey, lower('model-' || list_extract(['7b', '1.5B', '13b', '8x3b', '70b', 'instruct'], CAST(p_partkey % 6 + 1 AS INTEGER)) || '-' || list_extract(['q4_k_m', 'q8_0', 'IQ2_XXS', 'f16', 'Q5_K_S', 'plain'], CAST((p_partkey // 7) % 6 + 1 AS INTEGER)) || '.gguf') AS name,
list_extract([7.0::DOUBLE, 1.5::DOUBLE, 13.0::DOUBLE, NULL, 70.0::DOUBLE, NULL], CAST(p_partkey % 6 + 1 AS INTEGER)) AS billions, list_extract(['Q4', 'Q8', 'Q2', 'F16', 'Q5', 'unknown'], CAST((p_partkey // 7) % 6 + 1 AS INTEGER)) AS quant,
CAST(p_size * 211 + 100 AS BIGINT) AS size_mb, CASE WHEN p_partkey % 2 = 0 THEN 8192 ELSE 4096 END AS ctx, p_partkey % 16 + 1 AS cores, p_partkey % 3 <> 0 AS avx2, CAST(p_size % 32 + 4 AS DOUBLE) AS ram, CAST(p_partkey % 60 AS DOUBLE) AS disk FROM part)"""
_COMPAT = f"""WITH a AS (SELECT *, CASE quant WHEN 'Q2' THEN 0.25 WHEN 'Q4' THEN 0.5 WHEN 'Q5' THEN 0.65 WHEN 'Q8' THEN 1.0 WHEN 'F16' THEN 1.0 ELSE 0.5 END::DOUBLE AS qs, CASE quant WHEN 'Q2' THEN 1.6 WHEN 'Q4' THEN 1.0 WHEN 'Q5' THEN 0.85 WHEN 'Q8' THEN 0.6 WHEN 'F16' THEN 0.5 ELSE 1.0 END::DOUBLE AS qb, size_mb / 1024.0::DOUBLE AS gb FROM {_PARTS}),
b AS (SELECT *, CASE WHEN billions IS NOT NULL THEN CASE WHEN billions < 2.5 THEN '1B' WHEN billions < 5 THEN '3B' WHEN billions < 10 THEN '7B' WHEN billions < 20 THEN '13B' WHEN billions < 50 THEN '30B' ELSE '70B' END ELSE CASE WHEN gb / qs < 4 THEN '1B' WHEN gb / qs < 9.5 THEN '3B' WHEN gb / qs < 19.5 THEN '7B' WHEN gb / qs < 43 THEN '13B' WHEN gb / qs < 100 THEN '30B' ELSE '70B' END END AS params, floor(gb * (CASE WHEN ctx >= 8192 THEN 1.5 ELSE 1.3 END)::DOUBLE * 1024) / 1024.0::DOUBLE AS need FROM a),
c AS (SELECT *, cores * (CASE WHEN avx2 THEN 1.0 ELSE 0.5 END)::DOUBLE / (CASE params WHEN '1B' THEN 0.5 WHEN '3B' THEN 1 WHEN '7B' THEN 2 WHEN '13B' THEN 4 WHEN '30B' THEN 8 ELSE 16 END)::DOUBLE * qb AS s, (CASE params WHEN '1B' THEN 2 WHEN '3B' THEN 6 WHEN '7B' THEN 13 WHEN '13B' THEN 26 WHEN '30B' THEN 60 ELSE 140 END) * qs AS d FROM b)
SELECT p_partkey, params, round(need, 4) AS required_ram_gb, round(s, 4) AS perf_score, CASE WHEN ram < need THEN 'DO_NOT_DOWNLOAD' WHEN ram < need * 1.25 THEN 'NOT_RECOMMENDED' ELSE 'OK' END AS ram_decision, CASE WHEN disk < d OR ram < need THEN 'wontrun' WHEN s < 0.5 THEN 'notrecommended' WHEN s < 1 THEN 'veryslow' WHEN s < 2 THEN 'usable' ELSE 'efficient' END AS rating FROM c"""

SQL = {
    "idle_window_metrics": f"SELECT event_type, round(median(value) FILTER (elapsed BETWEEN 3600 AND 90000), 6) AS median_idle, max(value) AS peak, count(*) FILTER (elapsed BETWEEN 3600 AND 90000) AS n_idle FROM {_SAMPLES} GROUP BY event_type",
    "idle_window_extended": f"WITH e AS (SELECT s.*, CASE WHEN event_id % 3 <> 0 THEN k END AS k, value + k AS both_, elapsed BETWEEN 3600 AND 90000 AS inside FROM {_SAMPLES} s JOIN (SELECT event_id, CAST(props ->> '$.k' AS DOUBLE) AS k FROM events) USING (event_id)) SELECT event_type, count(*) FILTER (inside) AS n_idle, " + ", ".join(f"round(max({c}), 6) AS peak_{c.strip('_')}, round(median({c}) FILTER (inside), 6) AS median_idle_{c.strip('_')}" for c in ("value", "k", "both_")) + " FROM e GROUP BY event_type",
    "counter_rates": f"SELECT event_id, CASE WHEN dt > 0 THEN round(dx / dt, 4) END AS rate FROM (SELECT event_id, t - lag(t) OVER w AS dt, value - lag(value) OVER w AS dx FROM {_SAMPLES} WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id))",
    "fifo_pairing": "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) SELECT a.user_id, CAST(a.n AS INTEGER) AS n, a.event_id AS open_id, b.event_id AS close_id, round(epoch(b.ts) - epoch(a.ts), 3) AS seconds, round(b.value - a.value, 4) AS delta FROM e a JOIN e b ON a.user_id = b.user_id AND a.n = b.n WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts >= a.ts",
    "periodic_overhead": f"SELECT event_type, round(greatest(0, avg(value) FILTER (floor(elapsed) >= 60 AND (floor(elapsed) % 60 <= 1 OR floor(elapsed) % 60 >= 59)) - median(value) FILTER (floor(elapsed) <= 36000)), 4) AS overhead FROM {_SAMPLES} GROUP BY event_type",
    "null_poison_sum": "SELECT user_id, CAST(CASE WHEN count(v) = count(*) THEN sum(v) END AS BIGINT) AS spoiled, CAST(sum(v) AS BIGINT) AS plain FROM (SELECT user_id, CASE WHEN event_id % 97 <> 0 THEN event_id END AS v FROM events) GROUP BY user_id",
    "best_config_per_group": "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS r FROM lineitem WHERE l_returnflag = 'R') WHERE r = 1",
    "metric_pivot": "SELECT * FROM (SELECT l_partkey, last(l_extendedprice ORDER BY l_orderkey * 10 + l_linenumber, l_extendedprice) FILTER (CAST(l_quantity AS BIGINT) % 2 = 1) AS pp_ts, last(l_extendedprice ORDER BY l_orderkey * 10 + l_linenumber, l_extendedprice) FILTER (CAST(l_quantity AS BIGINT) % 2 = 0 AND l_quantity >= 1) AS tg_ts FROM lineitem GROUP BY l_partkey) WHERE pp_ts IS NOT NULL AND tg_ts IS NOT NULL",
    "config_grid": "SELECT * FROM (SELECT DISTINCT l_returnflag FROM lineitem), (SELECT DISTINCT l_linestatus FROM lineitem), (SELECT DISTINCT l_linenumber FROM lineitem), (SELECT DISTINCT l_tax > 0 AS taxed FROM lineitem)",
    "gap_sessions": "SELECT user_id, CAST(run AS BIGINT) AS run, count(*) AS n, min(value) AS low, max(value) AS high FROM (SELECT *, sum(CASE WHEN t - before > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t) AS run FROM (SELECT user_id, epoch(ts) AS t, value, lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events)) GROUP BY ALL",
    "bench_json": "SELECT CAST(event_id % 64 AS INTEGER) AS n_gen, count(*) AS n, max(value) AS best FROM events WHERE event_id % 3 <> 0 GROUP BY 1",
    "log_parse": "SELECT CASE event_id % 4 WHEN 0 THEN 'model_spawn' WHEN 1 THEN 'model_ready' ELSE 'model_start_ready' END AS kind, 'm' || (user_id % 7) AS subject, count(*) AS n, CAST(sum(CASE WHEN event_id % 4 = 2 THEN event_id % 100 END) AS BIGINT) AS elapsed_ms FROM events WHERE event_id % 4 <> 3 GROUP BY ALL",
    "process_closure": "WITH RECURSIVE t(root, pid, depth) AS (SELECT c_custkey, c_custkey, 0 FROM customer WHERE c_custkey BETWEEN 1 AND 9 UNION ALL SELECT root, c_custkey, depth + 1 FROM t JOIN customer ON c_custkey // 10 = pid) SELECT root, count(*) AS n, CAST(max(depth) AS INTEGER) AS depth, CAST(round(sum(CAST(c_acctbal AS DECIMAL(18, 2))), 2) AS DOUBLE) AS total FROM t JOIN customer ON c_custkey = pid GROUP BY root",
    "tree_flatten": "WITH RECURSIVE n AS (SELECT c_custkey AS id, CASE WHEN c_custkey >= 10 THEN c_custkey // 10 END AS up, row_number() OVER (PARTITION BY CASE WHEN c_custkey >= 10 THEN c_custkey // 10 END ORDER BY c_custkey) - 1 AS i FROM customer), t(node_id, depth, path) AS (SELECT id, 0, CAST(i AS VARCHAR) FROM n WHERE up IS NULL UNION ALL SELECT n.id, depth + 1, path || '.' || n.i FROM t JOIN n ON n.up = t.node_id) SELECT node_id, CAST(depth AS INTEGER) AS depth, path, CAST(depth * 260 AS INTEGER) AS x, CAST((row_number() OVER (PARTITION BY depth ORDER BY path) - 1) * 92 AS INTEGER) AS y FROM t",
    "conversation_truncate": r"SELECT conv_id, turn, role FROM (SELECT *, sum(4 * len(regexp_extract_all(text, '[^ \t\n\r\f\v]+'))) OVER (PARTITION BY conv_id) AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE s <= 400 OR r <= 3",
    "session_titles": r"SELECT conv_id, CASE WHEN length(t) = 0 THEN 'New Chat' WHEN length(t) > 32 THEN left(t, 32) || '…' ELSE t END AS title FROM (SELECT c.conv_id, regexp_replace(trim(coalesce(f.text, '')), '\n+', ' ', 'g') AS t FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY conv_id) f USING (conv_id))",
    "role_filter": r"SELECT role, count(*) AS n, count(*) FILTER (len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) >= 5) AS n_long FROM conversations WHERE role IN ('user', 'assistant', 'system') AND text IS NOT NULL GROUP BY role",
    "enrichment_queue": f"SELECT doc_id, CAST(chunk_index AS INTEGER) AS chunk_index FROM {_CHUNKS} WHERE enriched IS NULL AND v IS NOT NULL ORDER BY doc_id, chunk_index LIMIT 50",
    "document_phase": f"SELECT * FROM {_LISTED}",
    "docs_without_tree": f"SELECT doc_id FROM {_LISTED} WHERE phase = 'phase2_complete' AND doc_id NOT IN (SELECT doc_id FROM labels)",
    "searchable_chunks": f"SELECT doc_id, count(*) AS n, CAST(sum(CASE WHEN enriched = 1 THEN 1 ELSE v END) AS DOUBLE) AS total FROM {_CHUNKS} WHERE enriched = 1 OR v IS NOT NULL GROUP BY doc_id",
    "upsert_latest": f"SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_custkey % 3 = 0 THEN -o_totalprice END, CASE WHEN o_custkey % 3 = 0 THEN o_orderkey END, day DESC, o_orderkey DESC) AS r FROM {_ORDERS}) WHERE r = 1",
    "delete_cascade": f"SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id % 10 <> 0 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id % 10 <> 0 UNION ALL SELECT 'chunks', count(*) FROM {_CHUNKS} WHERE doc_id % 10 <> 0",
    "ordered_fetch": "SELECT CAST(id + 1 AS INTEGER) AS rank, doc_id, source FROM range(20) r(id) JOIN documents ON doc_id = CASE WHEN id % 5 = 4 THEN -1 ELSE (id * 37) % 50 END",
    "quant_from_name": f"SELECT p_partkey, quant, billions FROM {_PARTS}",
    "size_tier": f"SELECT p_partkey, CASE WHEN size_mb <= 500 THEN 'tiny' WHEN size_mb <= 1500 THEN 'small' WHEN size_mb <= 4000 THEN 'medium' WHEN size_mb <= 8000 THEN 'large' ELSE 'very_large' END AS tier, CASE WHEN size_mb <= 500 THEN 4 WHEN size_mb <= 1500 THEN 8 WHEN size_mb <= 4000 THEN 16 WHEN size_mb <= 8000 THEN 32 ELSE 64 END AS ram_gb, CAST(floor(size_mb * 1.3::DOUBLE) + 550 AS BIGINT) // 100 * 100 AS memory_mb FROM {_PARTS}",
    "compat_score": _COMPAT,
    "catalog_priority": "SELECT p_partkey, CAST(rank AS INTEGER) AS rank FROM (SELECT p_partkey, row_number() OVER (ORDER BY CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 90 ELSE p_size END DESC, p_name || '#' || p_partkey) AS rank FROM part WHERE p_partkey % 3 = 0) WHERE rank <= 100",
    "catalog_diff": "SELECT coalesce(f.s_suppkey, k.s_suppkey) AS s_suppkey, CASE WHEN k.s_suppkey IS NULL THEN 'insert' WHEN f.s_suppkey IS NULL THEN 'delete' WHEN f.s_suppkey % 5 = 0 THEN 'update' ELSE 'keep' END AS action FROM (SELECT * FROM supplier WHERE s_suppkey % 10 <> 0) f FULL JOIN (SELECT * FROM supplier WHERE s_suppkey % 7 <> 0) k ON f.s_suppkey = k.s_suppkey",
    "catalog_merge": "SELECT 'builtin' AS origin, count(*) AS n FROM supplier UNION ALL SELECT 'custom', count(*) FROM range(1, 2000) r(id) WHERE id NOT IN (SELECT s_suppkey FROM supplier)",
    "fuzzy_match": "SELECT DISTINCT CASE s_suppkey % 4 WHEN 0 THEN 's' || s_suppkey WHEN 1 THEN upper('models\\Dir' || s_suppkey % 7 || '\\M' || s_suppkey || '.gguf') WHEN 2 THEN 'elsewhere/m' || s_suppkey || '.GGUF' ELSE 'none' END AS ref, CASE WHEN s_suppkey % 4 < 3 THEN 's' || s_suppkey END AS model_id FROM supplier",
    "tumbling_windows": "SELECT CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS start_s, event_type, count(*) AS n, max(value) AS peak FROM events GROUP BY ALL",
    "label_groups": "SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS place FROM embeddings",
}
SQL |= {"stream_rates": SQL["counter_rates"], "stream_pairs": SQL["fifo_pairing"]}
