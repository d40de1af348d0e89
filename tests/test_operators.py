"""Vectors, fusion, clusters, trees, lifecycle, streams, workspaces."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import vectors
from sparkloom.operators import conversations, lifecycle, ordered, raptor, runs, search, trees
from sparkloom.sources import workspace
from sparkloom.streaming import jobs


def ranking(spark, rows):
    return spark.createDataFrame([(0, i, r) for r, i in enumerate(rows, 1)], "query int, id long, rank int")


def test_fusion(spark):
    a, b = ranking(spark, [1, 2, 3]), ranking(spark, [2, 3, 1])
    rows = search.top(search.fused([(a, 1), (b, 1)]), 10).orderBy("rank").collect()
    assert rows[0]["id"] == 2 and len(rows) == 3 and math.isclose(rows[0]["score"], 1 / 62 + 1 / 61, abs_tol=1e-8)
    assert search.top(search.fused([(ranking(spark, [1]), 1), (ranking(spark, [2]), 2)]), 1).head()["id"] == 2
    assert search.fused([(a.limit(0), 1)]).isEmpty()
    assert {tuple(r) for r in search.fused([(b, 1), (a, 1)]).collect()} == {tuple(r) for r in search.fused([(a, 1), (b, 1)]).collect()}


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [0.0, 1.0, 0.0]), (3, [0.9, 0.1, 0.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0])], "query int, vector array<float>")
    for f in (search.nearest, search.nearest_quantized):
        assert [r["id"] for r in f(df, q, 2).orderBy("rank").collect()] == [1, 3]
    odd = spark.createDataFrame([([1.0], [1.0, 2.0]), ([], []), ([0.0], [0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in odd.select(vectors.dot(F.col("a"), F.col("b"))).collect()] == [0.0] * 3
    assert [r[0] for r in odd.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0] * 3


def test_cells_find_what_is_near(spark):
    rows = [(i, [math.cos(i * math.pi / 100), math.sin(i * math.pi / 100), 0.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    members, centroids = search.cells(df, rounds=5)
    assert members.count() == 200 and centroids.count() == 32
    q = spark.createDataFrame([(0, rows[17][1])], "query int, vector array<float>")
    best = search.search_cells(members, centroids, q, 3).orderBy("rank").collect()
    assert len(best) == 3 and best[0]["score"] > 0.9
    everywhere = search.search_cells(members, centroids, q, 3, probes=32)
    assert [r["id"] for r in everywhere.orderBy("rank").collect()] == [r["id"] for r in search.nearest_quantized(df, q, 3).orderBy("rank").collect()]


def test_grading(spark):
    df = spark.createDataFrame([(0, 1, 2, 0.9), (0, 2, 4, 0.1), (1, 3, 2, 0.5), (1, 4, 1, 0.9), (2, 5, 1, 0.3)], "query int, id long, grade int, score double")
    assert sorted((r["query"], r["id"]) for r in search.graded(df, 3).collect()) == [(0, 2), (1, 3), (2, 5)]
    assert [r[0] for r in spark.createDataFrame([(0.0,), (0.2,), (0.21,), (1.0,), (None,)], "s double").select(search.grade(F.col("s"))).collect()] == [1, 1, 2, 5, 3]


def test_k_means():
    x = np.array([[1, 0], [0.9, 0.1], [0, 1], [0.1, 0.9]])
    c = raptor.k_means(x[[0, 2, 1, 3]], 2)
    assert c[0] == c[2] != c[1] == c[3]


def test_tree(spark):
    rows = [(1, i, f"A line of the document {i}.", [float(i % 3 == k) for k in range(3)]) for i in range(12)] + [(2, 0, "alone", [1.0, 0.0, 0.0])]
    chunks = spark.createDataFrame(rows, "doc_id long, id long, text string, vector array<float>")
    nodes = raptor.tree(chunks).collect()
    assert nodes and {n["doc_id"] for n in nodes} == {1} and all(len(n["child_ids"]) >= 3 for n in nodes)
    level1 = [n for n in nodes if n["level"] == 1]
    assert sorted(c for n in level1 for c in n["child_ids"]) == list(range(12))
    got = [r[0] for r in spark.createDataFrame([("This document is short.",), ("word " * 31,), ("Something else.",)], "s string").select(raptor.confidence(F.col("s"))).collect()]
    assert got == [-2.0, -0.5, -1.0]


def test_unsure_nodes_give_way_to_children(spark):
    nodes = spark.createDataFrame([(1, 1, 1_000_000, "s", -2.0, [0, 1], [1.0]), (1, 1, 1_000_001, "t", -0.5, [2], [0.5])], "doc_id long, level int, id long, summary string, confidence double, child_ids array<long>, vector array<float>")
    chunks = spark.createDataFrame([(1, 0), (1, 1), (1, 2)], "doc_id long, id long")
    q = spark.createDataFrame([(9, 1, [1.0])], "query int, doc_id long, vector array<float>")
    assert sorted((r["level"], r["id"], r["score"]) for r in raptor.retrieve(nodes, chunks, q, 2).collect()) == [(0, 0, 1.0), (0, 1, 1.0), (1, 1_000_001, 0.5)]


def test_trees(spark):
    n = spark.createDataFrame([(1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 3), (1, 9, 8)], "graph_id int, node_id long, parent_id long")
    assert sorted((r["node_id"], r["depth"], r["path"]) for r in trees.flattened(n).collect()) == [(1, 0, "0"), (2, 1, "0.0"), (3, 1, "0.1"), (4, 2, "0.1.0")]
    loop = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "pid long, ppid long")
    assert sorted((r["pid"], r["depth"]) for r in trees.descendants(loop, spark.createDataFrame([(1,)], "root long")).collect()) == [(1, 0), (2, 1), (3, 2)]


def test_runs(spark):
    e = spark.createDataFrame([(1, 1, "a", 5.0, 1.0), (2, 1, "b", 4.0, 1.0), (3, 1, "a", 6.0, 1.0), (4, 1, "b", 9.0, 3.0)], "event_id long, p int, k string, ts double, value double")
    p = runs.paired(e, by="p", kind="k", opens="a", closes="b", at="ts", ident="event_id").collect()
    assert [(r["n"], r["seconds"]) for r in p] == [(2, 3.0)]
    lines = spark.createDataFrame([('{"n_prompt": 1, "n_gen": 0, "avg_ts": 2.5}',), ("warning",), ('{"broken',)], "value string")
    assert [tuple(r) for r in runs.bench_lines(lines).collect()] == [(1, 0, 2.5)]
    r = runs.rates(spark.createDataFrame([(1, 1, 0.0, 10), (2, 1, 2.0, 20), (3, 1, 2.0, 30)], "event_id long, u int, t double, c long"), by="u", time="t", counter="c")
    assert [x["rate"] for x in r.orderBy("event_id").collect()] == [None, 5.0, None]


def test_hot_keys_are_ordered_in_parts(spark):
    rows = [(k, (i * 7919) % 1000, i % 5) for k, n in (("hot", 400), ("b", 3), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, t long, v long").dropDuplicates(["k", "t"])
    for f in (lambda limit: ordered.with_previous(df, ["k"], ["t"], ["v", "t"], limit=limit), lambda limit: ordered.with_running_sum(df, ["k"], ["t"], "v", "s", limit=limit), lambda limit: ordered.with_row_number(df, ["k"], ["t"], "n", limit=limit)):
        plain, parts = f(10_000), f(50)
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, parts.select(*plain.columns).collect()), key=str)
    assert ordered.with_row_number(df.limit(0), ["k"], ["t"], "n").count() == 0


def test_queries_in_blocks(spark):
    df = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "vec_id long, embedding array<float>")
    q = df.selectExpr("vec_id as query", "embedding as vector")
    whole = search.nearest(df, q, 3)
    blocks = search.in_blocks(q, lambda b: search.nearest(df, b, 3), size=9)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, blocks.collect()))


def test_lifecycle(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in lifecycle.upserted(old, new, "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(tuple(r) for r in lifecycle.changes(new, old, "k", "v").collect()) == [(1, "delete"), (2, "update"), (3, "insert")]


def test_conversations(spark):
    t = spark.createDataFrame([(1, i, "user", "word " * 100) for i in range(20)] + [(2, 0, "tool", "x"), (2, 1, "user", None)], "conv_id long, turn long, role string, text string")
    assert conversations.truncated(t).where("conv_id = 1").count() == 10
    assert conversations.known_roles(t).where("conv_id = 2").count() == 0


def test_streams_match_batches(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    stream = jobs.events_stream(spark, str(tmp_path / "events"), events.schema)
    got = jobs.finished(stream.groupBy("event_type").agg(F.count("*").alias("n")), "by_type", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, events.groupBy("event_type").agg(F.count("*").alias("n")).collect()))
    whole = jobs.windowed(events.withColumn("ts", F.col("ts").cast("timestamp"))).collect()
    found = jobs.finished(jobs.windowed(jobs.events_stream(spark, str(tmp_path / "events"), events.schema, files_a_batch=9)), "windows").collect()
    assert found and {tuple(r) for r in found} <= {tuple(r) for r in whole}


def test_enrichment_stream(spark, tmp_path):
    chunks = spark.createDataFrame([(1, i, f"Sentence {i}. Another. Third.") for i in range(5)], "doc_id long, chunk_index int, text string")
    chunks.write.parquet(str(tmp_path / "chunks"))
    for _ in range(2):  # a second run finds nothing new
        jobs.enrich(spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "chunks")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    done = spark.read.parquet(str(tmp_path / "out"))
    assert done.count() == 5 and done.where("enriched_text like 'Sentence%Another.' and size(enriched_embedding) = 64").count() == 5


def test_sse(spark):
    lines = spark.createDataFrame([('data: {"choices":[{"delta":{"content":"a"}}]}',), ("data: [DONE]",), ("data: {bad",), ('data: {"choices":[{"delta":{"reasoning_content":"r"}}]}',), ("",)], "value string")
    assert [tuple(r) for r in jobs.sse_deltas(lines).collect()] == [("a", None), (None, "r")]


def test_workspace(spark, tmp_path):
    df = spark.range(3)
    workspace.save({"numbers": df}, str(tmp_path / "w"))
    assert workspace.load(spark, str(tmp_path / "w"))["numbers"].count() == 3
    for bad in ("/x", "../x", "a/../b", ""):
        assert not workspace.is_safe(bad)
    with pytest.raises(ValueError):
        workspace.save({"../x": df}, str(tmp_path / "v"))
    spark.createDataFrame([(99, ["numbers"])], "version int, tables array<string>").write.mode("overwrite").json(str(tmp_path / "w/manifest"))
    with pytest.raises(ValueError):
        workspace.load(spark, str(tmp_path / "w"))
    workspace.create(spark, "proj")
    workspace.use(spark, "proj")
    assert workspace.listed(spark).where("active").head()["namespace"] == "proj"
    workspace.drop(spark, "proj")
    assert spark.catalog.currentDatabase() == "default"


def test_stems():
    """Examples of the published algorithm."""
    known = "caresses caress ponies poni ties ti cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop falling fall filing file happy happi sky sky relational relat rational ration digitizer digit vietnamization vietnam operator oper decisiveness decis callousness callous triplicate triplic formalize formal electrical electr goodness good revival reviv adjustable adjust replacement replac adoption adopt activate activ bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll naïve naïve a1 a1".split()
    from sparkloom.functions.stemming import stem

    assert [stem(w) for w in known[::2]] == known[1::2]


def test_search_by_stems(spark):
    from sparkloom.functions.stemming import stemmed_words

    docs = spark.createDataFrame([(1, "The runners were running"), (2, "a cat sat"), (3, "he ran"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(0, "runs"), (1, "cats sitting")], "query int, text string")
    found = {(r["query"], r["id"]) for r in search.bm25(docs, q, 3, tokens=stemmed_words).collect()}
    assert found == {(0, 1), (1, 2)} and search.bm25(docs, q, 3).count() == 0


def test_stored_index(spark, tmp_path):
    from sparkloom.operators import stored_index

    path = str(tmp_path / "index")
    q = spark.createDataFrame([(0, "red fox")], "query int, text string")
    of = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert stored_index.find_texts(spark, path, q, 3).count() == 0
    stored_index.add_texts(of([(1, "red fox"), (2, "a red hen"), (3, None), (4, "")]), path)
    stored_index.add_texts(of([(2, "blue hen"), (5, "fox fox red")]), path)
    ids = lambda: [r["id"] for r in stored_index.find_texts(spark, path, q, 3).orderBy("rank").collect()]
    assert set(ids()) == {1, 5}
    stored_index.delete(spark, path, spark.createDataFrame([(1,)], "id long"))
    assert ids() == [5]
    stored_index.add_texts(of([(1, "red fox again")]), path)
    (tmp_path / "index" / "lengths" / "batch=9").mkdir()  # of a job that died: no commit, not read
    same = [tuple(r) for r in search.bm25(of([(1, "red fox again"), (2, "blue hen"), (5, "fox fox red")]), q, 3).orderBy("rank").collect()]
    assert [tuple(r) for r in stored_index.find_texts(spark, path, q, 3).orderBy("rank").collect()] == same
    stored_index.compacted(spark, path, str(tmp_path / "small"))
    assert [tuple(r) for r in stored_index.find_texts(spark, str(tmp_path / "small"), q, 3).orderBy("rank").collect()] == same


def test_vector_index(spark, tmp_path):
    from sparkloom.operators import stored_index

    path = str(tmp_path / "vectors")
    rows = spark.createDataFrame([(i, [math.cos(i / 30), math.sin(i / 30)]) for i in range(180)], "vec_id long, embedding array<double>")
    _, centroids = search.cells(rows, k=6, rounds=3)
    stored_index.start_cells(centroids, path)
    stored_index.add_vectors(rows, path)
    q = spark.createDataFrame([(0, [math.cos(1.0), math.sin(1.0)])], "query int, vector array<double>")
    assert [r["id"] for r in stored_index.find_vectors(spark, path, q, 3, probes=2).orderBy("rank").collect()][0] == 30
    stored_index.delete(spark, path, rows.where("vec_id between 28 and 32"), "vec_id")
    assert {r["id"] for r in stored_index.find_vectors(spark, path, q, 2, probes=2).collect()} == {27, 33}


def test_second_try(spark):
    """A question whose sources grade low is asked again in other words, and keeps what was better."""
    from sparkloom.functions import models
    from sparkloom.operators import answers

    chunks = spark.createDataFrame([(1, 1, 0, "A", "alpha beta"), (2, 2, 0, None, "gamma"), (3, 3, 0, "C", "delta epsilon")], "id long, doc_id long, chunk_index int, title string, text string")
    q = spark.createDataFrame([(0, "alpha beta"), (1, "gamma one two three four five"), (2, "hello there"), (3, "zzz")], "query int, text string")
    before = models.TASKS["rephrase"]
    models.TASKS["rephrase"] = lambda text: F.concat(F.lit("1. gamma\n2. gamma delta\n3. "), text)
    try:
        rows = {r["query"]: r for r in answers.answered(q, chunks, [(answers.word_leg(chunks, 3), 1.0)], 3).collect()}
    finally:
        models.TASKS["rephrase"] = before
    assert [s["id"] for s in rows[0]["sources"]] == [1] and rows[0]["context"] == "alpha beta" and "alpha beta" in rows[0]["prompt"]
    assert [(s["id"], s["title"]) for s in rows[1]["sources"]] == [(2, "Unknown"), (3, "C")] and rows[1]["sources"][0]["grade"] == 5
    assert not rows[2]["retrieves"] and rows[2]["sources"] == [] and rows[2]["context"] == ""


def test_medians(spark):
    from sparkloom.operators import runs

    rows = [("a", v) for v in (3.0, 1.0, 2.0, 2.0)] + [("b", 5.0), ("c", None), ("d", 1.0), ("d", 4.0)]
    df = spark.createDataFrame(rows, "k string, value double")
    assert {r["k"]: r["m"] for r in runs.medians(df, ["k"], "value", "m").collect()} == {"a": 2.0, "b": 5.0, "d": 2.5}
