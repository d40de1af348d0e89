"""Second tries in other words, answers from trees, overlaps and BM25 over all benchmark items, against plain versions in memory."""

import math
import re
from collections import Counter, defaultdict

import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from sparkloom.functions import models
from sparkloom.operators import answers, raptor, search
from sparkloom.sources.tables import table


def words(x):
    return re.findall("[a-z0-9]+", (x or "").lower())


def test_all_items_by_bm25(spark, sf):
    folder = sf.replace("0.001", "0.01")
    docs, items = table(spark, folder, "documents"), table(spark, folder, "benchmark")
    got = defaultdict(list)
    for r in sorted(search.bm25(docs, items.select(F.col("item_id").alias("query"), "text"), 5).collect(), key=lambda r: (r["query"], r["rank"])):
        got[r["query"]].append((r["id"], r["score"]))
    counts = {r["doc_id"]: Counter(words(r["text"])) for r in docs.select("doc_id", "text").collect()}
    sizes = {i: sum(c.values()) for i, c in counts.items() if c}
    avg, df = sum(sizes.values()) / len(sizes), Counter(w for c in counts.values() for w in c)
    for r in items.collect():
        scores = defaultdict(float)
        for w in set(words(r["text"])):
            idf = math.log(1 + (len(sizes) - df[w] + 0.5) / (df[w] + 0.5))
            for i, c in counts.items():
                if c[w]:
                    scores[i] += idf * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sizes[i] / avg))
        want = sorted(((i, round(s, 6)) for i, s in scores.items()), key=lambda x: (-x[1], x[0]))[:5]
        assert [i for i, _ in got[r["item_id"]]] == [i for i, _ in want] and [s for _, s in got[r["item_id"]]] == pytest.approx([s for _, s in want], abs=2e-6)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_overlaps(spark, k):
    docs = {1: "a b c", 2: "b b", 3: None, 4: "", 5: "c a d b", 6: "x", 7: "a b c", 12: "d"}
    asked = {1: "a b c d", 2: "zzz", 3: "", 4: "B x", 5: "c"}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string").repartition(3)
    got = defaultdict(list)
    for r in search.best_overlaps(d, spark.createDataFrame(list(asked.items()), "query int, text string"), k).collect():
        got[r["query"]].append((r["id"], r["score"]))
    for q, text in asked.items():
        own = set(words(text))
        want = sorted(((i, round(len(own & set(words(t))) / max(len(own), 1), 6)) for i, t in docs.items()), key=lambda x: (-x[1], x[0]))[:k]
        assert sorted(got[q], key=lambda x: (-x[1], x[0])) == want


def test_few_scores_at_a_time(spark, sf, monkeypatch):
    e = table(spark, sf, "embeddings")
    q = e.where("vec_id < 40").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))
    whole = rows_of(search.nearest(e, q, 7))
    rows = {r["vec_id"]: r["embedding"] for r in e.collect()}
    best = sorted(((round(sum(a * b for a, b in zip(rows[3], v, strict=True)), 6), -i) for i, v in rows.items()), reverse=True)[:7]
    monkeypatch.setattr(search, "SCORES", 40 * 64)
    assert rows_of(search.nearest(e, q, 7)) == whole
    assert [(r["id"]) for r in sorted(search.nearest(e, q, 7).where("query = 3").collect(), key=lambda r: r["rank"])] == [-i for _, i in best]


CHUNKS = [
    (1, 1, 0, "One", "the heron nests by the river in spring"), (2, 1, 1, "One", "reeds hide the nests of the heron and the bittern"), (3, 2, 0, "Two", "a bittern booms in the reeds at dusk"),
    (4, 3, 0, None, "trains run late on sunday"), (5, 4, 0, "Four", "nests by the river in spring"),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, d, n, t, x, models_vector(i)) for i, d, n, t, x in CHUNKS], "id long, doc_id long, chunk_index int, title string, text string, vector array<double>")


def models_vector(i):
    return [float(i == k) for k in range(1, 6)]


def plain_feedback(question, ids):
    weights = Counter()
    for i in ids:
        w = words(next(c[4] for c in CHUNKS if c[0] == i))
        for term, n in Counter(w).items():
            if term not in words(question):
                weights[term] += n / len(w)
    terms = [t for t, _ in sorted(weights.items(), key=lambda x: (-round(x[1], 9), x[0]))[: answers.FEEDBACK]]
    return [" ".join([question, *terms[:3]]), " ".join(terms), " ".join([question, *terms])] if terms else [question]


def test_feedback(spark, chunks):
    q = spark.createDataFrame([(1, "heron qqq"), (2, "nothing like it"), (3, "sunday")], "query int, text string")
    first = spark.createDataFrame([(1, 1), (1, 2), (3, 4), (3, 4)], "query int, id long")
    got = {r["query"]: r["variants"] for r in answers.feedback(q, first, chunks).collect()}
    assert got == {1: plain_feedback("heron qqq", [1, 2]), 2: ["nothing like it"], 3: plain_feedback("sunday", [4])}


def test_a_second_try_finds_more(spark, chunks):
    """A question most of whose words are nowhere: its first answers are poor, and their words find others."""
    q = spark.createDataFrame([(1, "heron qqq rrr sss ttt uuu vvv"), (2, "trains run late on sunday")], "query int, text string")
    legs = [(answers.word_leg(chunks, 5), 1.0)]
    once = {r["query"]: [s["id"] for s in r["sources"]] for r in answers.answered(q, chunks, legs, 3, least_grade=0).collect()}
    again = {r["query"]: (r["sources"], r["context"]) for r in answers.answered(q, chunks, legs, 3).collect()}
    assert once == {1: [1, 2], 2: [4]} and [s["id"] for s in again[2][0]] == [4]
    found = {s["id"]: s["grade"] for s in again[1][0]}
    assert max(found.values()) >= 2 and set(found) - {1, 2} and set(found) <= {1, 2, 3, 5}, found
    first = plain_feedback("heron qqq rrr sss ttt uuu vvv", [1, 2])
    best = max((len(set(words(v)) & set(words(c[4]))) / len(set(words(v))), c[0]) for v in first for c in CHUNKS)
    assert again[1][0][0]["grade"] == max(1, math.ceil(best[0] * 5 - 1e-9)) and again[1][1]


def test_answers_from_trees(spark, chunks):
    nodes = spark.createDataFrame([(1, 1, 1_000_000, "birds of the river", -0.5, [1, 2], [0.9, 0.8, 0.0, 0.0, 0.0]), (1, 1, 1_000_001, "unsure document", -2.0, [2, 1], [0.0, 0.7, 0.0, 0.0, 0.0])], "doc_id long, level int, id long, summary string, confidence double, child_ids array<long>, vector array<double>")
    q = spark.createDataFrame([(10, 1, "heron?", [1.0, 0.0, 0.0, 0.0, 0.0]), (11, 1, "nests", [0.0, 1.0, 0.0, 0.0, 0.0]), (12, 2, "bittern dusk", [0.0, 0.0, 1.0, 0.0, 0.0])], "query int, doc_id long, text string, vector array<double>")
    got = {r["query"]: r for r in answers.answered_from_trees(q, nodes, chunks, [(answers.word_leg(chunks, 5), 1.0)], 2).collect()}
    assert {k: r["from_tree"] for k, r in got.items()} == {10: True, 11: True, 12: False}
    # Of two nodes the unsure one gives way to its children, which keep its score.
    assert [(s["level"], s["id"], s["title"]) for s in got[10]["sources"]] == [(1, 1_000_000, "RAPTOR Summary"), (0, 1, "One"), (0, 2, "One")]
    assert got[10]["context"] == "birds of the river\n\n" + CHUNKS[0][4] + "\n\n" + CHUNKS[1][4] and got[10]["context"] in got[10]["prompt"]
    assert [s["id"] for s in got[11]["sources"]] == [1_000_000, 1, 2]
    usual = answers.answered(q.where("query = 12").select("query", "text"), chunks, [(answers.word_leg(chunks, 5), 1.0)], 2).head()
    assert [s["id"] for s in got[12]["sources"]] == [s["id"] for s in usual["sources"]] and got[12]["context"] == usual["context"]
    short = answers.answered_from_trees(q.where("query = 10"), nodes, chunks, [], 2, most_bytes=9).head()
    assert short["context"] == "birds of "


def test_missing_trees(spark):
    chunks = spark.createDataFrame([(d, i, f"Chunk {i} of document {d} speaks of things. More.", [float((i * 7 + j) % 5) for j in range(4)]) for d in (1, 2, 3) for i in range(12)], "doc_id long, id long, text string, vector array<double>")
    documents = spark.createDataFrame([(1, 12, 12), (2, 12, 5), (3, 12, 12), (4, 0, 0)], "doc_id long, chunk_count long, enriched_count long")
    have = raptor.tree(chunks.where("doc_id = 3"))
    built = answers.build_missing_trees(documents, have, chunks)
    assert {r["doc_id"] for r in built.select("doc_id").distinct().collect()} == {1} and models.TASKS["rephrase"] is models.as_it_is


def test_podcasts(spark):
    from sparkloom.functions import audio

    contexts = spark.createDataFrame([(1, "The heron nests. Reeds hide it! Does it sing? No."), (2, ""), (3, None)], "query int, context string")
    lines = answers.podcast_lines(contexts, turns=3)
    assert [(r["query"], r["i"], r["speaker"], r["voice"], r["text"]) for r in sorted(lines.collect(), key=lambda r: (r["query"], r["i"]))] == [(1, 0, "A", "a", "The heron nests."), (1, 1, "B", "b", "Reeds hide it!"), (1, 2, "A", "a", "Does it sing?")]
    (r,) = answers.podcasts(lines).collect()
    assert (r["query"], r["n_lines"], r["seconds"]) == (1, 3, 0.9) and len(audio.wav_samples(bytes(r["audio"]))) == 9 * audio.RATE // 10
