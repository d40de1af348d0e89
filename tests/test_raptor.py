"""Clusters of many documents at once: small ones where they are, large ones in a loop over blocks; both as one document's k-means alone."""

import numpy as np
import pytest

from sparkloom.operators import raptor


@pytest.mark.parametrize("block", [raptor.BLOCK, 16])
def test_clusters(spark, block):
    r = np.random.default_rng(3)
    items, want = [], set()
    for doc, n in enumerate([1, 2, 5, 6, 16, 17, 40, 200, 64, 7]):
        x = r.normal(0, 1, (n, 8)) if doc != 8 else np.repeat(r.normal(0, 1, (2, 8)), 32, axis=0)
        ids = r.permutation(n * 3)[:n]
        x = x[np.argsort(np.argsort(ids))]
        k = raptor.n_clusters(n)
        order = np.argsort(ids)
        if k > 1:
            want |= {(doc, int(i), int(c)) for i, c in zip(ids[order], raptor.k_means(x[order], k), strict=True)}
        items += [(doc, int(i), v.tolist()) for i, v in zip(ids, x, strict=True)]
    df = spark.createDataFrame(items, "doc_id long, id long, vector array<double>").repartition(3)
    got = {(r["doc_id"], r["id"], r["cluster"]) for r in raptor.clusters(df, block=block).collect()}
    assert got == want


def test_no_items(spark):
    assert raptor.clusters(spark.createDataFrame([], "doc_id long, id long, vector array<double>")).collect() == []
