"""Cells that split, merge and are probed by a measured recall."""

import numpy as np
import pytest
from oracle import rows_of

from sparkloom.operators import cells, search
from sparkloom.plans import registry


def frame(spark, rows):
    return spark.createDataFrame([(i, np.asarray(v, float).tolist()) for i, v in rows], "vec_id long, embedding array<double>")


def queries(spark, vectors):
    return spark.createDataFrame([(i, np.asarray(v, float).tolist()) for i, v in enumerate(vectors)], "query long, vector array<double>")


def sizes(spark, path):
    return {r["cell"]: r["count"] for r in cells.members(spark, path).groupBy("cell").count().collect()}


def test_upkeep_if_needed(spark, tmp_path):
    path = str(tmp_path / "index")
    cells.add(frame(spark, [(i, [1, 0, 0]) for i in range(50)]), path)
    assert not cells.upkeep_if_needed(spark, path) and not cells._centroids(spark, path)  # too few
    cells.add(frame(spark, [(i, [0, 1, 0]) for i in range(50, 250)]), path)
    assert cells.upkeep_if_needed(spark, path)
    assert sorted(sizes(spark, path).values()) == [50, 200]  # equal vectors can't be split
    assert cells.pending(spark, path) == 0
    cells.add(frame(spark, [(i, [0, 0, 1]) for i in range(250, 300)]), path)
    assert not cells.upkeep_if_needed(spark, path)  # under the threshold
    best = cells.find(spark, path, queries(spark, [[1, 0, 0], [0, 0, 1]]), 60).collect()
    assert sorted(r["id"] for r in best if r["query"] == 0 and r["score"] > 0.5) == list(range(50))
    assert sorted(r["id"] for r in best if r["query"] == 1 and r["score"] > 0.5) == list(range(250, 300))


def test_few_vectors_are_all_read(spark, tmp_path):
    path = str(tmp_path / "index")
    assert cells.find(spark, path, queries(spark, [[1, 0, 0]]), 2).collect() == []
    cells.add(frame(spark, [(1, [1, 0, 0]), (2, [0, 1, 0]), (3, [0.9, 0.1, 0])]), path)
    assert [r["id"] for r in sorted(cells.find(spark, path, queries(spark, [[1, 0, 0]]), 2).collect(), key=lambda r: r["rank"])] == [1, 3]
    cells.remove(spark, path, spark.createDataFrame([(1,)], "id long"))
    assert [r["id"] for r in sorted(cells.find(spark, path, queries(spark, [[1, 0, 0]]), 2).collect(), key=lambda r: r["rank"])] == [3, 2]


@pytest.fixture(scope="module")
def clusters():
    r = np.random.default_rng(7)
    centres = r.normal(0, 1, (12, 16))
    vectors = np.repeat(centres, 100, axis=0) + r.normal(0, 0.15, (1200, 16))
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def test_split_merge_and_recall(spark, tmp_path, clusters):
    path = str(tmp_path / "index")
    rows = list(enumerate(clusters))
    cells.add(frame(spark, rows[::2]), path)
    assert cells.upkeep(spark, path, most=150, least=40)
    cells.add(frame(spark, rows), path)  # half of them in place of their own rows
    assert cells.upkeep(spark, path, most=150, least=40)
    found = sizes(spark, path)
    assert sum(found.values()) == 1200 and max(found.values()) <= 150 and len(found) >= 8
    known = cells._centroids(spark, path)
    placed = {r["id"]: r["cell"] for r in cells.members(spark, path).collect()}
    best = [max(sorted(known), key=lambda c: round(float(known[c] @ v), 6)) for v in clusters]
    assert np.mean([placed[i] == b for i, b in enumerate(best)]) > 0.95  # near their own centroids
    asked = queries(spark, clusters[::25])
    probes, recall = cells.tuned(spark, path, asked, cells.exact(frame(spark, rows), asked, 10), 10)
    assert recall >= 0.9 and probes < len(known)
    exact = {(r["query"], r["id"]) for r in search.nearest(frame(spark, rows), asked, 10).collect()}
    got = {(r["query"], r["id"]) for r in cells.find(spark, path, asked, 10).collect()}
    assert len(exact & got) / len(exact) == pytest.approx(recall) and recall == pytest.approx(cells.report(spark, path).head()["recall"], abs=1e-6)
    # What is left after most has gone is merged.
    cells.remove(spark, path, frame(spark, [x for x in rows if x[0] % 8]), "vec_id")
    assert cells.upkeep(spark, path, most=150, least=30)
    small = sizes(spark, path)
    assert sum(small.values()) == 150 and len(small) < len(found)
    # And with too few, there are no cells.
    cells.remove(spark, path, frame(spark, [x for x in rows if x[0] % 16]), "vec_id")
    assert not cells.upkeep(spark, path) and cells._centroids(spark, path) == {} and set(sizes(spark, path)) == {0}


def test_recall_after_inserts_and_deletes(spark, sf):
    row = registry.QUERIES["kept_cells"](spark, sf).head()
    assert row["recall"] >= 0.9 and row["n"] == spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 10 <> 1").count()
    assert rows_of(registry.QUERIES["kept_cells"](spark, sf)) == rows_of(registry.QUERIES["kept_cells"](spark, sf))
