"""The multi-field index against a plain search in memory: query syntax, phrases, replaced and deleted documents, the block-wise top k."""

import math
import re
from collections import Counter, defaultdict

import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from sparkloom.operators import batches, field_index, search
from sparkloom.sources.tables import table

WEIGHTS = {"text": 1.0, "title": 2.0}
FIELDS = {"text": "text", "title": "title"}


def words(x):
    return re.findall("[a-z0-9]+", (x or "").lower())


def found(docs, query, k, weights=WEIGHTS):
    """[(id, score)] of ``docs`` {id: {field: text}} for one query, by reading all of them."""
    if query.count('"') % 2:
        return []
    clauses = set()
    for mark, field, phrase, word in re.findall(r'([+-]?)(?:([A-Za-z_]\w*):)?(?:"([^"]*)"|([^\s"]+))', query):
        if field and field not in weights:
            return []
        if words(phrase + word):
            clauses.add((mark, field, tuple(words(phrase + word))))
    listed = {f: {i: words(d[f]) for i, d in docs.items() if words(d[f])} for f in weights}
    scores, out, any_, met = defaultdict(float), set(), set(), Counter()
    for mark, field, terms in clauses:
        hit = set()
        for f in [field] if field else weights:
            n, avg = len(listed[f]), sum(map(len, listed[f].values())) / max(1, len(listed[f]))
            idf = sum(math.log(1 + (n - df + 0.5) / (df + 0.5)) for df in (sum(t in w for w in listed[f].values()) for t in terms))
            for i, w in listed[f].items():
                tf = sum(tuple(w[at : at + len(terms)]) == terms for at in range(len(w)))
                if tf:
                    hit.add(i)
                    scores[i] += 0 if mark == "-" else weights[f] * idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / avg))
        if mark == "-":
            out |= hit
        else:
            any_ |= hit
            met.update(hit if mark == "+" else ())
    musts = sum(mark == "+" for mark, _, _ in clauses)
    return sorted(((i, round(scores[i], 6)) for i in any_ - out if met[i] == musts), key=lambda x: (-x[1], x[0]))[:k]


DOCS = {
    1: {"text": "the quick brown fox jumps over the lazy dog", "title": "Fox"},
    2: {"text": "quick quick brown; brown fox", "title": "brown fox tales"},
    3: {"text": "a dog, a fox and the-quick dog", "title": None},
    4: {"text": "", "title": "dog dog dog"},
    5: {"text": None, "title": None},
    6: {"text": "aa aa aa bb aa aa", "title": "aa"},
    7: {"text": "old text of a dog", "title": "gone"},
}
QUERIES = [
    "fox", "quick fox", '"quick brown"', '"brown fox" dog', "+dog -quick", "+fox +title:brown", "title:dog text:dog", "-fox", "+fox -fox", "the-quick", '"aa aa"', "aa aa text:aa", '+"aa aa" bb',
    'open "quote', "nofield:fox", "", "...", '-"quick brown" +brown fox', "title:\"brown fox\"", "+nothing fox", "FOX Fox",
]


def frame(spark, docs):
    return spark.createDataFrame([(i, d["text"], d["title"], 1) for i, d in docs.items()], "doc_id long, text string, title string, field int")


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("fields") / "index")
    field_index.add(frame(spark, {7: {"text": "fox fox fox", "title": "brown"}, 8: DOCS[1], 3: DOCS[2]}), path, FIELDS)
    field_index.add(frame(spark, DOCS), path, FIELDS)
    field_index.delete(spark, path, spark.createDataFrame([(8,), (99,)], "id long"))
    return path


def asked(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query int, text string")


def test_query_syntax(spark, index):
    got = defaultdict(list)
    for r in sorted(field_index.find(spark, index, asked(spark, QUERIES), 4, WEIGHTS).collect(), key=lambda r: (r["query"], r["rank"])):
        got[r["query"]].append((r["id"], r["score"]))
    for n, q in enumerate(QUERIES):
        want = found(DOCS, q, 4)
        assert [i for i, _ in got[n]] == [i for i, _ in want] and [s for _, s in got[n]] == pytest.approx([s for _, s in want], abs=2e-6), q


def test_errors_are_named(spark):
    rows = field_index.clauses(asked(spark, ['a "b', "x:a", "text:a"]), WEIGHTS).collect()
    assert {(r["query"], r["error"]) for r in rows} == {(0, "open quote"), (1, "unknown field"), (2, None)}


def test_compacted_index_finds_the_same(spark, index, tmp_path):
    field_index.compacted(spark, index, str(tmp_path / "small"))
    q = asked(spark, QUERIES)
    assert rows_of(field_index.find(spark, str(tmp_path / "small"), q, 4, WEIGHTS)) == rows_of(field_index.find(spark, index, q, 4, WEIGHTS))


def test_blocks_hold_all_positions(spark, index):
    rows = field_index._rows(spark, index, batches.read(spark, index, "postings", field_index.POSTINGS), positions=True)
    placed = rows.select("id", "field", "term", "steps").mapInArrow(field_index._absolute, "id long, field string, term string, steps array<int>")
    got = {(r["id"], r["field"], r["term"]): r["steps"] for r in placed.collect()}
    want = defaultdict(list)
    for i, d in DOCS.items():
        for f in WEIGHTS:
            for at, w in enumerate(words(d[f])):
                want[i, f, w].append(at)
    assert got == want


def test_lost_writer_leaves_nothing(spark, index):
    before = rows_of(field_index.find(spark, index, asked(spark, QUERIES), 4, WEIGHTS))
    batch = batches.next_batch(spark, index)
    batches.put(spark.createDataFrame([(1,), (2,)], "id long"), index, "gone", batch)  # and no commit
    assert rows_of(field_index.find(spark, index, asked(spark, QUERIES), 4, WEIGHTS)) == before


@pytest.mark.parametrize("block", [128, 8])
def test_best_without_all_blocks(spark, sf, tmp_path, block):
    """All benchmark items over the documents of sf0.01: equal to the scan, with fewer blocks."""
    folder, path = sf.replace("0.001", "0.01"), str(tmp_path / "index")
    docs = table(spark, folder, "documents")
    queries = table(spark, folder, "benchmark").select(F.col("item_id").alias("query"), "text").withColumn("text", F.regexp_replace(F.regexp_replace("text", "[^A-Za-z0-9 ]", " "), " +", " "))
    field_index.add(docs.where("doc_id % 3 = 0"), path, {"text": "text"}, block=block)
    field_index.add(docs.where("doc_id % 3 <> 0"), path, {"text": "text"}, block=block)
    best = field_index.find_best(spark, path, queries, 5, {"text": 1.0})
    assert rows_of(best) == rows_of(search.bm25(docs, queries, 5)) == rows_of(field_index.find(spark, path, queries, 5, {"text": 1.0}))
    wanted = field_index._wanted(queries, {"text": 1.0}, field_index.words)
    blocks = field_index.needed_blocks(spark, path, wanted, 5, {"text": 1.0}).groupBy().agg(F.count("*").alias("n"), F.count_if("needed").alias("read")).head()
    assert 0 < blocks["read"] < blocks["n"]
    print(f"{blocks['read']} of {blocks['n']} blocks")


def test_empty_index_and_no_queries(spark, tmp_path):
    path = str(tmp_path / "index")
    field_index.add(frame(spark, {}), path, FIELDS)
    assert field_index.find(spark, path, asked(spark, ["fox", '"a b"']), 4, WEIGHTS).collect() == []
    assert field_index.find_best(spark, path, asked(spark, ["fox"]), 4, WEIGHTS).collect() == []
    field_index.add(frame(spark, DOCS), path, FIELDS)
    assert field_index.find(spark, path, asked(spark, []), 4, WEIGHTS).collect() == []


def test_search_stores_no_postings(spark, tmp_path, monkeypatch):
    """Many queries of frequent words, alone, as must and must-not and as phrases: right, and what is stored on the way grows with neither postings nor pairs of queries and documents."""
    docs = {i: {"text": " ".join(f"w{(i * j) % 7}" for j in range(1, 60)), "title": f"w{i % 3} t{i}"} for i in range(600)}
    path, stored, real = str(tmp_path / "index"), [], field_index.written
    monkeypatch.setattr(field_index, "written", lambda df, what: (out := real(df, what), stored.append(out.count()))[0])
    field_index.add(frame(spark, docs), path, FIELDS)
    docs = {i: d if i % 4 else {"text": "w1 w2 again", "title": None} for i, d in docs.items() if i % 5}
    field_index.add(frame(spark, {i: d for i, d in docs.items() if i % 4 == 0}), path, FIELDS)
    field_index.delete(spark, path, spark.range(0, 600, 5))
    texts = ["+w1 w2 -t7", '"w1 w2"', "title:w0 +text:w3", "w5 w6"] * 30
    got = defaultdict(list)
    for r in field_index.find(spark, path, asked(spark, texts), 3, WEIGHTS).orderBy("query", "rank").collect():
        got[r["query"]].append((r["id"], r["score"]))
    for n, text in enumerate(texts[:4]):
        want = found(docs, text, 3)
        assert [i for i, _ in got[n]] == [i for i, _ in want] and [s for _, s in got[n]] == pytest.approx([s for _, s in want], abs=2e-6), text
        assert all(got[m] == got[n] for m in range(n, len(texts), 4))
    assert sum(stored) < 2 * len(docs) + 5 * len(texts)


def test_blocks_are_written_without_sorting(spark, tmp_path, monkeypatch):
    """A task has a file open for each bucket and stays below the number of files from which Spark sorts what is left; of each file it holds a row group of bounded size."""
    import pyarrow.parquet as pq

    limits, tidy = [], field_index.tidy
    monkeypatch.setattr(field_index, "tidy", lambda s: (limits.append(int(s.conf.get("spark.sql.maxConcurrentOutputFileWriters"))), tidy(s))[1])
    monkeypatch.setattr(field_index, "ROW_GROUP", 8192)
    docs = spark.range(0, 400, 1, 1).selectExpr("id AS doc_id", "array_join(transform(sequence(1, 100), x -> concat('w', id * 100 + x)), ' ') AS text")
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    field_index.add(docs, str(tmp_path / "index"), {"text": "text"})
    files = list((tmp_path / "index" / "postings" / "batch=1").glob("bucket=*/*.parquet"))
    assert limits == [field_index.BUCKETS + 1] and spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
    assert len(files) == field_index.BUCKETS and all(pq.ParquetFile(f).metadata.num_row_groups > 1 for f in files)
    assert sum(pq.ParquetFile(f).metadata.num_rows for f in files) == 40_000
