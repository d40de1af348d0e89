"""Stored tables that change: states of each batch, cascades, lost writers, compaction."""

import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from sparkloom.operators import batches, stored_tables
from sparkloom.operators.stored_tables import Kind, Store

KINDS = {"documents": Kind("doc_id long, title string", ("doc_id",)), "chunks": Kind("doc_id long, chunk_index int, text string, note string", ("doc_id", "chunk_index")), "media": Kind("doc_id long, media_id long, caption string, embedding array<double>", ("doc_id", "media_id"))}


@pytest.fixture
def store(tmp_path):
    return Store(str(tmp_path / "store"), KINDS)


def documents(spark, *rows):
    return spark.createDataFrame(list(rows), KINDS["documents"].schema)


def chunks(spark, *rows):
    return spark.createDataFrame(list(rows), KINDS["chunks"].schema)


def state(spark, store, name, at=None):
    return rows_of(stored_tables.state(spark, store, name, at))[1]


def test_versions(spark, store):
    assert stored_tables.version(spark, store) == 0 and state(spark, store, "documents") == []
    one = stored_tables.upsert(spark, store, documents=documents(spark, (1, "a"), (2, "b"), (2, "b")), chunks=chunks(spark, (1, 0, "x", None), (1, 1, "y", None), (2, 0, "z", "old")))
    two = stored_tables.upsert(spark, store, documents=documents(spark, (2, "B"), (3, None)))
    three = stored_tables.set_values(spark, store, "chunks", chunks(spark, (1, 1, None, "new"), (2, 0, None, "old"), (9, 9, "none", "none")).drop("text"))
    four = stored_tables.delete(spark, store, documents(spark, (1, None), (77, None)))
    five = stored_tables.upsert(spark, store, documents=documents(spark, (1, "again")))
    assert state(spark, store, "documents", one) == [(1, "a"), (2, "b")]
    assert state(spark, store, "documents", two) == [(1, "a"), (2, "B"), (3, None)]
    assert state(spark, store, "documents", four) == [(2, "B"), (3, None)]
    assert state(spark, store, "documents") == state(spark, store, "documents", five) == [(1, "again"), (2, "B"), (3, None)]
    names = sorted(c for c in ("doc_id", "chunk_index", "text", "note"))
    rows = lambda *r: sorted((tuple(dict(zip(("doc_id", "chunk_index", "text", "note"), x, strict=True))[c] for c in names) for x in r), key=str)
    assert state(spark, store, "chunks", two) == rows((1, 0, "x", None), (1, 1, "y", None), (2, 0, "z", "old"))
    assert state(spark, store, "chunks", three) == rows((1, 0, "x", None), (1, 1, "y", "new"), (2, 0, "z", "old"))
    assert state(spark, store, "chunks") == rows((2, 0, "z", "old"))
    # Only the row that changed was written.
    assert batches.read(spark, store.path, "chunks", KINDS["chunks"].schema).where(F.col("batch") == three).count() == 1


def test_lost_writer(spark, store):
    stored_tables.upsert(spark, store, documents=documents(spark, (1, "a")))
    batch = batches.next_batch(spark, store.path)
    batches.put(documents(spark, (1, "lost"), (2, "lost")), store.path, "documents", batch)  # and no commit
    assert state(spark, store, "documents") == [(1, "a")]
    assert stored_tables.upsert(spark, store, documents=documents(spark, (2, "b"))) == batch  # the number is taken again, and what was left there goes
    assert state(spark, store, "documents") == [(1, "a"), (2, "b")]


def test_replaced_documents_lose_what_hung_on_them(spark, store):
    stored_tables.upsert(spark, store, documents=documents(spark, (1, "a"), (2, "b")), chunks=chunks(spark, (1, 0, "x", None), (1, 1, "y", None), (2, 0, "z", None)))
    stored_tables.replace(spark, store, documents(spark, (1, None)), documents=documents(spark, (1, "A")), chunks=chunks(spark, (1, 0, "new", None)))
    assert state(spark, store, "documents") == [(1, "A"), (2, "b")]
    assert sorted((r["doc_id"], r["text"]) for r in stored_tables.state(spark, store, "chunks").collect()) == [(1, "new"), (2, "z")]


def test_media_get_their_vectors(spark, store):
    media = spark.createDataFrame([(1, 1, "a caption", None), (1, 2, "", None), (1, 3, None, None), (2, 4, "has one", [1.0]), (3, 5, "gone", None)], KINDS["media"].schema)
    stored_tables.upsert(spark, store, media=media)
    stored_tables.delete(spark, store, documents(spark, (3, None)))
    assert stored_tables.embed_media(spark, store) == 1
    assert stored_tables.embed_media(spark, store) == 0
    found = {r["media_id"]: r["embedding"] for r in stored_tables.state(spark, store, "media").collect()}
    assert set(found) == {1, 2, 3, 4} and len(found[1]) == 64 and found[4] == [1.0] and found[2] is None is found[3]


def test_compacted(spark, store, tmp_path):
    stored_tables.upsert(spark, store, documents=documents(spark, (1, "a"), (2, "b")), chunks=chunks(spark, (1, 0, "x", None), (2, 0, "z", None)))
    stored_tables.upsert(spark, store, documents=documents(spark, (2, "B")))
    stored_tables.delete(spark, store, documents(spark, (1, None)))
    new = stored_tables.compacted(spark, store, str(tmp_path / "new"))
    assert all(state(spark, new, name) == state(spark, store, name) for name in KINDS) and stored_tables.version(spark, new) == 1
