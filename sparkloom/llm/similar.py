"""Links between items that share a MinHash band, verified on full n-gram sets, without a row a pair.

Items that collide in some band hang together in components; a component isn't what is compared, but says what a plan costs. Items are dealt over blocks of
bounded size by their hash, and each pair of blocks is a task's group, in one of two ways, whichever sends fewer sets:

* by component: all its blocks against each other, for components of a block and those whose items mostly collide with each other;
* by band: the blocks of each band's group of colliding items, for components that hang together by chance only. A pair counts in its first common band.

Both ways compare the sets of exactly the pairs that share a band, so the links are the same. A group gives a row an item: how much it is linked to there, and the
smallest item that it hangs together with there by links; components are then of verified links.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import parallelism, stored
from sparkloom.llm.components import components

BLOCK_GRAMS, BLOCK_ITEMS, COLUMNS = 400_000, 120, 4_096
WORK = "struct<grp: long, banded: boolean, blk: int, n_blk: int>"
#: What ``links`` wants of the sets of its members.
SETS = f"node long, weight long, bands array<long>, work array<{WORK}>, grams binary"


def links_in(sets: list[np.ndarray], compared: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the ``compared`` pairs of sets (sorted, unique) have a Jaccard similarity of at least ``similarity``."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    _, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(m), sizes)
    shared = counts[column] > 1
    number = np.cumsum(counts > 1) - 1
    owner, column = owner[shared], number[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((m, m), np.float32)
    last = int(column[-1]) + 1 if len(column) else 0
    for at in range(0, last, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        has = np.zeros((m, min(COLUMNS, last - at)), np.float32)
        has[owner[i:j], column[i:j] - at] = 1
        common += has @ has.T
    return compared & (common > 0) & (common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6)


def compared_in(bands: np.ndarray, half: np.ndarray, within: bool, key: int | None) -> np.ndarray:
    """Which pairs of items to compare: those that share a band (or, with ``key``, the band of that key and none before), of different ``half`` unless ``within``."""
    m = len(bands)
    out, upto = np.zeros((m, m), bool), bands.shape[1]
    if key is not None:
        upto = int(np.flatnonzero(bands[0] == key)[0])
    for b in range(upto):
        out |= bands[:, b, None] == bands[None, :, b]
    if key is not None:
        out = ~out
    np.fill_diagonal(out, False)
    return out if within else out & (half[:, None] != half[None, :])


def roots_in(linked: np.ndarray) -> np.ndarray:
    """The lowest number of each item's component."""
    label = np.arange(len(linked))
    while True:
        near = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _blocks(items: str, grams: str) -> Column:
    return F.greatest(F.ceil(F.col(grams) / BLOCK_GRAMS), F.ceil(F.col(items) / BLOCK_ITEMS)).cast("int")


def _block() -> Column:
    return F.pmod(F.xxhash64("node"), F.col("n_blk")).cast("int")


def members(classes: DataFrame, what: str) -> DataFrame:
    """(node, work) of every item of ``classes`` (node, n_grams, bands) that collides with another in some band; work says in which groups it is compared."""
    keyed = classes.select("node", "n_grams", F.explode("bands").alias("key"))
    hubs = stored(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("top")).where("hub < top").drop("top"), f"{what}-bands")
    # All keys are dealt twice, to find those that collide and their items; the rest is of these alone.
    pairs = stored(keyed.join(hubs.hint("shuffle_hash"), "key"), f"{what}-pairs")
    groups = pairs.groupBy("key").agg(F.min("hub").alias("hub"), F.count("*").alias("items"), F.sum("n_grams").alias("grams"))
    labels = components(pairs.where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")))
    sized = labels.join(pairs.groupBy("node").agg(F.min("n_grams").alias("n_grams")), "node")
    sizes = sized.groupBy("label").agg(F.count("*").alias("items"), F.sum("n_grams").alias("grams")).withColumn("n_blk", _blocks("items", "grams"))
    many = sizes.where("n_blk > 1").withColumn("sent", F.col("items") * F.col("n_blk")).select("label", "sent")
    # What all bands' groups of such a component would send.
    in_bands = groups.select(F.col("hub").alias("node"), (F.col("items") * _blocks("items", "grams")).alias("by_band")).join(labels, "node").join(many, "label").groupBy("label").agg(F.first("sent").alias("sent"), F.sum("by_band").alias("by_band"))
    loose = stored(in_bands.where("by_band < sent").select("label"), f"{what}-loose")
    work = lambda grp, banded: F.array(F.struct(grp.alias("grp"), F.lit(banded).alias("banded"), _block().alias("blk"), F.col("n_blk")).cast(WORK)).alias("work")
    whole = labels.join(sizes.select("label", "n_blk"), "label")
    if loose.isEmpty():
        return whole.select("node", work(F.col("label"), False))
    ours = labels.join(loose, "label").select("node")
    # Written, so that the join has a shuffle on both sides, whose hot keys Spark can split.
    blocks = stored(groups.select("key", _blocks("items", "grams").alias("n_blk")), f"{what}-blocks")
    banded = pairs.join(blocks.hint("shuffle_hash"), "key").join(ours, "node").select("node", work(F.col("key"), True))
    by_band = banded.groupBy("node").agg(F.flatten(F.collect_list("work")).alias("work"))
    return whole.join(loose, "label", "left_anti").select("node", work(F.col("label"), False)).unionByName(by_band)


def links(classes: DataFrame, sets: Callable[[DataFrame], DataFrame], similarity: float, what: str) -> DataFrame:
    """(node, label, weight) of the items that have a link: the smallest node of the links' component, and the weight of what the node is linked to.

    ``classes``: node (long, unique), n_grams, bands (array<long>), and what ``sets`` needs to make ``SETS`` of the rows of (node, work).
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}

        def done() -> list[tuple[int, int, int, bool]]:
            if len(rows) < 2:
                return []
            nodes = sorted(rows)
            grp, banded, i, j, n_blk = key
            half, weight = np.array([rows[n][1] for n in nodes]), np.array([rows[n][2] for n in nodes])
            compared = compared_in(np.stack([rows[n][3] for n in nodes]), half, i == j, grp if banded else None)
            linked = links_in([np.frombuffer(rows[n][0], np.uint64) for n in nodes], compared, similarity)
            root, most = roots_in(linked), linked @ weight
            return [(nodes[k], nodes[root[k]], int(most[k]), banded or n_blk > 1) for k in range(len(nodes)) if most[k]]

        def out(found: list) -> pa.RecordBatch:
            columns = list(zip(*found, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (*[pa.int64()] * 3, pa.bool_()), strict=True)], names=["node", "root", "weight", "spread"])

        for batch in batches:
            found = []
            keys = zip(*(batch.column(n).to_pylist() for n in ("grp", "banded", "i", "j", "n_blk")), strict=True)
            listed = batch.column("bands")
            at, bands = listed.offsets.to_numpy(), listed.values.to_numpy()
            columns = [batch.column(n).to_pylist() for n in ("node", "grams", "blk", "weight")]
            for k, (new, node, grams, blk, weight) in enumerate(zip(keys, *columns, strict=True)):
                if new != key:
                    found += done()
                    key, rows = new, {}
                rows[node] = (grams, blk, weight, bands[at[k] : at[k + 1]])
            if found:
                yield out(found)
        yield out(done())

    dealt = sets(members(classes, what)).withColumn("w", F.explode("work")).select("node", "weight", "bands", "grams", "w.*")
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blk") - 1)))
    dealt = dealt.withColumns({"i": F.least("blk", "other"), "j": F.greatest("blk", "other")}).drop("other")
    order = ("grp", "banded", "i", "j")
    dealt = dealt.repartition(parallelism(classes.sparkSession), *order).sortWithinPartitions(*order)
    found = stored(dealt.mapInArrow(run, "node long, root long, weight long, spread boolean"), what)
    # A component in one block is whole there; those over many groups are joined here.
    whole = found.where("not spread").select("node", F.col("root").alias("label"), "weight")
    spread = found.where("spread")
    if spread.isEmpty():
        return whole
    parts = spread.groupBy("node").agg(F.sum("weight").alias("weight"))
    edges = spread.where("root <> node").select(F.col("node").alias("u"), F.col("root").alias("v"))
    return whole.union(components(edges).join(parts, "node").select("node", "label", "weight"))
