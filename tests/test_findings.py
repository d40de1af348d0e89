"""Queries against their SQL on tables where they once differed from it."""

import os

import pyarrow as pa
import pytest
from oracle import rows_of, sql_rows
from pyspark.sql import functions as F

from sparkloom.plans import registry


@pytest.fixture
def folder(spark, sf, tmp_path):
    """The smallest tables, of which a test may write its own instead."""

    def made(**own):
        for name in os.listdir(sf):
            if name.removesuffix(".parquet") not in own:
                os.symlink(f"{sf}/{name}", tmp_path / name)
        for name, df in own.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return made


def same(spark, name, folder):
    want = sql_rows(registry.SQL[name], folder)
    assert rows_of(registry.QUERIES[name](spark, folder)) == want
    return want


def test_catalog_merge_when_all_custom_rows_clash(spark, folder):
    suppliers = spark.range(1, 2500).selectExpr("id AS s_suppkey")
    names, rows = same(spark, "catalog_merge", folder(supplier=suppliers))
    assert names == ["n", "origin"] and set(rows) == {(2499, "builtin"), (0, "custom")}


def test_human_sizes_past_a_thousand_gigabytes(spark, folder):
    parts = spark.createDataFrame([(1,), (106_466,), (106_467,), (1_200_000,), (None,)], "p_partkey long")
    assert (106_467, "1,024.0 GB") in same(spark, "human_sizes", folder(part=parts))[1]


def test_blockmax_topk_of_words_apart(spark, folder):
    """Questions of words that the tokens rule takes apart, and of marks, quotes and colons."""
    items = spark.createDataFrame([(0, "ciónñga the thouwh"), (100, '-the "of and in'), (200, "nofield:the +in, the"), (300, None)], "item_id long, text string")
    assert len(same(spark, "blockmax_topk", folder(benchmark=items))[1]) > 5


def test_chunks_of_some_texts_at_a_time():
    """Of one Arrow batch many come out, none of much more than a step's texts; rows stay whole and in order."""
    from sparkloom.functions import chunker

    texts = ["some words. " * 30_000, None, "", *["ab\n" * 5_000] * 100]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([0] * len(texts)), pa.array(["m"] * len(texts)), pa.array(texts)], names=["doc_id", "section", "metadata", "text"])
    out = list(chunker._cut([batch.slice(0, 0), batch], {}))
    assert len(out) > 1 and all(sum(map(len, b.column("text").to_pylist())) < 1.3 * chunker.STEP_BYTES for b in out)
    got = [(r["doc_id"], r["part"], r["text"]) for r in pa.Table.from_batches(out).to_pylist()]
    assert got == [(i, part, c) for i, t in enumerate(texts) for part, (_, c) in enumerate(chunker.chunks(t))]


def test_words_of_many_questions_are_not_stored(spark, monkeypatch):
    """The same scores as by postings, of which none are written, however many questions share frequent words."""
    from pyspark.sql import functions as F

    from sparkloom.functions.text import words
    from sparkloom.operators import search

    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 11}" for j in range(i % 40)) if i % 7 else None) for i in range(500)], "doc_id long, text string").repartition(5)
    queries = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} w1 x{i} w1") for i in range(40)] + [(40, None), (41, "none")], "query int, text string")
    found = search.postings(docs, "doc_id", F.col("text"))
    wanted = queries.select("query", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    want = rows_of(search.scored(found, search.corpus_size(docs, F.col("text")), wanted, 7))
    stored, real = [], search.written
    monkeypatch.setattr(search, "written", lambda df, what: (out := real(df, what), stored.append(out.count()))[0])
    assert rows_of(search.bm25(docs, queries, 7)) == want and len(want[1]) == 280
    assert sum(stored) <= wanted.count()


def _vectors(spark, n, d, seed):
    import numpy as np

    x = np.random.default_rng(seed).normal(0, 1, (n, d)).astype(np.float32)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_upkeep_is_one_batch_and_searches_send_the_best_only(spark, tmp_path):
    """However many passes upkeep has, no version of a member but the last is stored; of all cells a task sends k rows a query."""
    from sparkloom.operators import batches, cells, search

    x, rows = _vectors(spark, 1200, 8, 5)
    path = str(tmp_path / "index")
    cells.add(rows, path)
    assert cells.upkeep(spark, path, most=100, least=10)
    assert len(cells._centroids(spark, path)) > 8 and batches.committed(spark, path) == [1, 2]
    live = cells.members(spark, path).select("id", F.col("q").alias("v"), "scale", "cell").coalesce(1)
    queries = rows.where("vec_id < 20").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    wanted = search.probed(queries, spark.createDataFrame([(c, v.tolist()) for c, v in cells._centroids(spark, path).items()], cells.CENTROIDS), 1000)
    found = search.in_cells(live, wanted, 7)
    assert found.count() == 140
    want = search.nearest_quantized(rows, queries, 7).select("query", "id", "score")
    assert rows_of(found) == rows_of(want)


def test_best_of_many_ties(spark, monkeypatch):
    """Scores that tie over steps and batches go by id, nulls and other lengths score 0."""
    from sparkloom.operators import search

    monkeypatch.setattr(search, "SCORES", 30)
    monkeypatch.setattr(search, "STEP_WORDS", 5)
    rows = [(str(i * 37 % 100), [float(i % 3), 1.0] if i % 10 else [1.0] if i % 20 else None) for i in range(100)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").coalesce(1)
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0])], "query int, vector array<double>")
    want = {}
    for q, sign in ((1, 1.0), (2, -1.0)):
        scored = sorted(((-sign * (v[0] if v and len(v) == 2 else 0.0), i) for i, v in rows))[:12]
        want |= {(q, rank + 1): (i, -s + 0.0) for rank, (s, i) in enumerate(scored)}
    assert {(r["query"], r["rank"]): (r["id"], r["score"]) for r in search.nearest(df, asked, 12).collect()} == want


def test_cells_are_written_once(spark, monkeypatch):
    """k-means writes its rows once and their cells once, whatever its rounds, and gives what a plain k-means does."""
    import numpy as np

    from sparkloom.operators import search

    x, rows = _vectors(spark, 300, 6, 3)
    stored, real = [], search.written
    monkeypatch.setattr(search, "written", lambda df, what: (stored.append(what), real(df, what))[1])
    members, centroids = search.cells(rows.repartition(4), k=5)
    assert len(stored) <= 4
    x, c, was = x.astype(float), x[: 5 * 60 : 60].astype(float), np.zeros(300, int)
    for _ in range(search.ROUNDS):
        now = np.round(x @ c.T, 6).argmax(axis=1)
        stop, was = (now == was).all(), now
        if stop:
            break
        c = np.array([np.round(x[now == i].mean(axis=0), 6) if (now == i).any() else c[i] for i in range(5)])
    assert {r["id"]: r["cell"] for r in members.collect()} == dict(enumerate(was.tolist()))
    assert np.allclose([r["c"] for r in centroids.orderBy("cell").collect()], c, atol=2e-6)


def test_stored_postings_are_counted_where_documents_are_read(spark, tmp_path, monkeypatch):
    """Documents that share an id are one, as by the shuffle of all words, which only these take."""
    from sparkloom.operators import batches, search, stored_index

    rows = [(i, " ".join(f"w{i * j % 13}" for j in range(i % 30))) for i in range(200)] + [(200, None), (201, "a b a"), (201, "a c"), (None, "b"), (None, "b c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    taken, real = [], search.postings
    monkeypatch.setattr(search, "postings", lambda df, *a: (taken.append(df.count()), real(df, *a))[1])
    stored_index.add_texts(docs, str(tmp_path / "a"))
    stored_index.add_texts(docs.where("doc_id < 200"), str(tmp_path / "b"))
    assert taken == [4]
    got = batches.read(spark, str(tmp_path / "a"), "postings", "term string, id long, tf long, dl int, bucket int").select("term", "id", "tf")
    want = real(docs, "doc_id", F.col("text")).select("term", "id", "tf")
    assert rows_of(got) == rows_of(want)
    assert {r["term"]: (r["df"], r["cf"]) for r in stored_index.terms(spark, str(tmp_path / "a")).where("term in ('a', 'b', 'c')").collect()} == {"a": (1, 3), "b": (2, 3), "c": (2, 2)}


def test_trees_are_written_and_numbered_once(spark, monkeypatch, sf):
    """Nodes are written by level and not once more; how many chunks a document has is counted without numbering them again."""
    from sparkloom.operators import raptor
    from sparkloom.plans import language_models

    stored, real = [], language_models.written
    monkeypatch.setattr(language_models, "written", lambda df, what: (stored.append(what), real(df, what))[1])
    plans, put = [], raptor.written
    monkeypatch.setattr(raptor, "written", lambda df, what: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()) if what == "blocks" else None, put(df, what))[1])
    registry.QUERIES["raptor_retrieve"](spark, sf)
    assert stored == ["chunks"] and plans and all(p.count("Window [") == 1 for p in plans)


def test_words_of_many_questions_are_searched_in_one_pass(spark, monkeypatch):
    """However many questions there are, documents are scored once, a task sends k rows a question, and no line of text is shuffled; the k best of some documents bound what is scored of the others."""
    from sparkloom.functions.text import words
    from sparkloom.operators import search

    texts = [" ".join([f"w{i * j % 23}" for j in range(i % 40)] + [f"K{i % 90}", f"rare{i % 17}-x{i % 5}İ"] * (i % 3)) if i % 7 else None for i in range(900)]
    docs = spark.createDataFrame([(i // 2 * 2 if i > 800 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    asked = [(i, f"w{i % 5} w{i % 3} W1 x{i % 7} k{i % 90} rare{i % 17} i") for i in range(5000)] + [(5000, None), (5001, "none"), (5002, "W1 w1 w2"), (5003, " ".join(f"w{i}" for i in range(23))), (5002, "w9")]
    queries = spark.createDataFrame(asked, "query int, text string")
    few = queries.where("query % 50 = 0 or query > 4990")
    found = search.postings(docs.withColumn("doc_id", F.monotonically_increasing_id()), "doc_id", F.col("text"))
    by_row = docs.withColumn("row", F.monotonically_increasing_id())
    wanted = few.select("query", F.explode(F.array_distinct(words(F.col("text")))).alias("term"))
    scores = search.scored(found, search.corpus_size(docs, F.col("text")), wanted, 2000).select("query", F.col("id").alias("row"), "score")
    want = rows_of(search.top(scores.join(by_row, "row").select("query", F.col("doc_id").alias("id"), "score"), 7))
    monkeypatch.setattr(search, "BOUNDED_FROM", 500, raising=False)
    monkeypatch.setattr(search, "BOUNDED_BY", 100, raising=False)
    monkeypatch.setattr(search, "STEP_BYTES", 3_000, raising=False)
    monkeypatch.setattr(search, "SCORED_WORDS", 1_500, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        assert rows_of(search.bm25(docs, few, 7)) == want
        sent, real = [], search.top
        monkeypatch.setattr(search, "top", lambda df, *a, **how: (sent.append(df), real(df, *a, **how))[1])
        found = search.bm25(docs, queries, 7)
        assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
        assert rows_of(found.join(few.select("query"), "query", "left_semi")) == want
        assert sent[-1].count() == found.count()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_words_of_a_batch(spark):
    import re

    from sparkloom.functions.text import words, words_of

    texts = ["The river's K-bank", None, "", "İstanbul ıI", "a", "b", "世1界 ÄÖz", "\n x \n", "9" * 40]
    got = [r["w"] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select(words(F.coalesce("t", F.lit(""))).alias("w"), "i").orderBy("i").collect()]
    for a in range(len(texts)):
        sizes, found = words_of(pa.array(texts, pa.string()).slice(a, 6))
        assert sizes.tolist() == [len(w) for w in got[a : a + 6]] and found.to_pylist() == [x for w in got[a : a + 6] for x in w]
    assert got == [re.findall("[a-z0-9]+", (t or "").lower()) for t in texts]


def test_answers_shuffle_no_lines(spark, monkeypatch, sf):
    """What is looked up of the lines is joined by broadcast; lines lie in no exchange."""
    from sparkloom.operators import answers, search

    chunks = spark.createDataFrame([(i, i // 5, i % 5, "t", f"line {i} of w{i % 9}") for i in range(100)], "id long, doc_id long, chunk_index int, title string, text string")
    monkeypatch.setattr(answers, "written", written := lambda df, what: df)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = answers.sources(spark.createDataFrame([(1, "w1 line")], "query int, text string"), chunks, [(answers.word_leg(chunks, 3), 1.0)], 3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "passage" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning(id" in line)
        assert found.count() == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_vectors_of_queries_are_held_once(spark, tmp_path, monkeypatch):
    """Whatever the number of cells that they probe; and no cell is searched twice for a query as probes are doubled."""
    import pickle

    from pyspark import SparkContext

    from sparkloom.operators import cells, search

    _, rows = _vectors(spark, 1500, 64, 9)
    path = str(tmp_path / "index")
    cells.add(rows, path)
    assert cells.upkeep(spark, path, most=80, least=10)
    known = len(cells._centroids(spark, path))
    queries = rows.where("vec_id < 150").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    exact = cells.exact(rows, queries, 10)
    sent, real = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, x: (sent.append(len(pickle.dumps(x))), real(self, x))[1])
    asked, by_cell = [], getattr(search, "by_cell", None)
    monkeypatch.setattr(search, "by_cell", lambda names, q: (asked.append(len(q)), by_cell(names, q))[1], raising=False)
    probes, recall = cells.tuned(spark, path, queries, exact, 10)
    assert known > 16 and probes > 8 and recall >= 0.9
    assert max(sent) < 150 * 64 * 8 + 150 * known * 8 + 20_000
    assert sum(asked) == 150 * probes
    got = rows_of(cells.find(spark, path, queries, 10, probes=probes).select("query", "id"))
    assert len(set(got[1]) & set(rows_of(exact.select("query", "id"))[1])) / 1500 == pytest.approx(recall)
    assert rows_of(cells.find(spark, path, queries, 10, probes=known).select("query", "id", "score")) == rows_of(exact.select("query", "id", "score"))
