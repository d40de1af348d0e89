"""Exact search of the largest inner products by KD-trees, one a shard.

Rows are cut into shards as they're read, without a shuffle. A shard's tree splits at the median of its widest dimension down to leaves of ``LEAF`` vectors; each node has the tight
box of what it holds. No vector of a box scores more with a query q than the sum of max(q_i * low_i, q_i * high_i), so a node is left out as soon as that is below the query's kth
score. A block of queries goes through a tree best first: a node stands in the queue by how far its bound tops the kth scores of the block's queries, a query goes on to
its children only if they can still better it, and a leaf's scores are one matrix product.

The queries of a shard search their own shard first. Their kth scores then go with them, in blocks, to groups of the other shards, and rise from shard to shard in a
group; so a stated query set meets all rows in blocks, and what comes back are the few rows that reach the kth score known by then. Both sides of a meeting have a bounded size.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import parallelism, stored

#: Vectors of a shard and of a leaf, queries that go through a tree together.
SHARD, LEAF, TOGETHER = 8_192, 128, 512
#: Numbers (vectors x dimensions) of a shard, of the queries that meet a group of shards, of such a group, and of a group that is worth a task.
SHARD_NUMBERS, BLOCK_NUMBERS, GROUP_NUMBERS, LEAST_NUMBERS = 1_000_000, 4_000_000, 16_000_000, 250_000
#: Up to here sums of products of integers are exact in a double.
EXACT = 2.0**53
LARGEST = (1 << 63) - 1
_KINDS = ((1 << 15, "<i2"), (1 << 31, "<i4"), (float("inf"), "<f8"))


class Tree(NamedTuple):
    """Nodes in preorder: their boxes, the first row that they hold and the one after the last, the left and right child (0: a leaf)."""

    low: np.ndarray
    high: np.ndarray
    spans: np.ndarray


def build(vectors: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
    """The tree of the vectors, and their order in it."""
    order, lows, highs, spans = np.arange(len(vectors)), [], [], []

    def node(first: int, last: int) -> int:
        own, at = vectors[order[first:last]], len(spans)
        low, high = own.min(axis=0), own.max(axis=0)
        lows.append(low)
        highs.append(high)
        spans.append([first, last, 0, 0])
        if last - first > leaf and (high > low).any():
            middle = (last - first) // 2
            order[first:last] = order[first:last][np.argpartition(own[:, int(np.argmax(high - low))], middle)]
            spans[at][2:] = [node(first, first + middle), node(first + middle, last)]
        return at

    node(0, len(vectors))
    return Tree(np.array(lows), np.array(highs), np.array(spans, np.int32)), order


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integers as longs; beyond a long they are its limits."""
    if a.shape[-1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < EXACT:
        return (a @ b).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(a) @ whole(b), -LARGEST, LARGEST).astype(np.int64)


def bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest inner product that each query can have with a vector of the box."""
    return _product(np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1), np.concatenate([high, low]))


class Best:
    """The k best rows of each of a block's queries: scores falling, ties by id, rows without an id after those. No row below a query's ``floor`` is taken."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.floor = np.full(n, -LARGEST - 1) if floor is None else floor
        self.scores = np.full((n, k), -LARGEST - 1)
        self.ids = np.zeros((n, k), np.int64)
        self.named = np.zeros((n, k), np.int8)  # 0: a free place, 1: a row without an id, 2: with one

    def kth(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[rows, -1], self.floor[rows])

    def take(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray, named: np.ndarray) -> None:
        """Adds a leaf's ``scores``: a row for each of ``rows``, a column for each id; ``named`` is 0 where a score doesn't count."""
        fit = (scores >= self.kth(rows)[:, None]) & (named > 0)
        some, columns = fit.any(axis=1), fit.any(axis=0)
        if not some.any():
            return
        rows, shape = rows[some], (int(some.sum()), int(columns.sum()))
        every = [
            np.concatenate([self.scores[rows], scores[np.ix_(some, columns)]], axis=1),
            np.concatenate([self.ids[rows], np.broadcast_to(ids[columns], shape)], axis=1),
            np.concatenate([self.named[rows], np.where(fit, named, 0)[np.ix_(some, columns)]], axis=1, dtype=np.int8),
        ]
        order = np.lexsort((every[1], -every[2], -every[0], every[2] == 0), axis=-1)[:, : self.scores.shape[1]]
        self.scores[rows], self.ids[rows], self.named[rows] = (np.take_along_axis(x, order, axis=1) for x in every)
        self.scores[rows] = np.where(self.named[rows] > 0, self.scores[rows], -LARGEST - 1)


def search(tree: Tree, vectors: np.ndarray, ids: np.ndarray, named: np.ndarray, queries: np.ndarray, best: Best, rows: np.ndarray, own: np.ndarray | None = None) -> int:
    """Improves the ``rows`` of ``best``, one for each query, by the tree's vectors, and returns how many leaves were compared. ``own``: the row that each query is itself, which doesn't count."""
    compared, queue = 0, [(0, 0, np.arange(len(queries)), np.full(len(queries), LARGEST))]
    while queue:
        _, at, active, most = heapq.heappop(queue)
        active = active[most >= best.kth(rows[active])]
        if not len(active):
            continue
        first, last, left, right = tree.spans[at]
        if not left:
            compared += 1
            known = np.broadcast_to(named[first:last], (len(active), last - first))
            if own is not None:
                known = known.copy()
                inside = np.flatnonzero((own[active] >= first) & (own[active] < last))
                known[inside, own[active[inside]] - first] = 0
            best.take(rows[active], _product(queries[active], vectors[first:last].T), ids[first:last], known)
            continue
        for child in (left, right):
            most = bounds(queries[active], tree.low[child], tree.high[child])
            slack = most - np.maximum(best.kth(rows[active]), -LARGEST // 2)
            if (slack >= 0).any():
                heapq.heappush(queue, (-int(slack.max()), int(child), active, most))
    return compared


_SHARD = "dim int, shard long, n long, n_queries long, kind string, vectors binary, low binary, high binary, spans binary, ids binary, named binary, queries binary, q_ids binary, q_places binary, scores binary, best_ids binary, best_named binary"


def _kind(numbers: np.ndarray) -> str:
    most = np.abs(numbers).max(initial=0)
    return next(kind for limit, kind in _KINDS if most < limit)


def _matrix(data: bytes, kind: str, dim: int, n: int) -> np.ndarray:
    return np.frombuffer(data, kind).reshape(n, dim).astype(np.float64)


def _made(dim: int, shard: int, vectors: np.ndarray, ids: np.ndarray, named: np.ndarray, asked: np.ndarray, k: int) -> tuple:
    """A shard's row: its tree, and what its own queries find in it."""
    tree, order = build(vectors)
    vectors, ids, named, asked = vectors[order], ids[order], named[order], asked[order]
    own = np.flatnonzero(asked)
    best = Best(len(own), k)
    for at in range(0, len(own), TOGETHER):
        some = own[at : at + TOGETHER]
        search(tree, vectors, ids, named, vectors[some], best, np.arange(at, at + len(some)), some)
    kind = _kind(vectors)
    blobs = (vectors.astype(kind), tree.low.astype(kind), tree.high.astype(kind), tree.spans, ids, named, vectors[own].astype(kind), ids[own], own, best.scores, best.ids, best.named)
    return (dim, shard, len(vectors), len(own), kind, *(np.ascontiguousarray(b).tobytes() for b in blobs))


def _shards(rows: DataFrame, k: int, size: int) -> DataFrame:
    """Shards of (id, vector, asked), each with its own queries' first results."""
    schema = pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("n", pa.int64()), ("n_queries", pa.int64()), ("kind", pa.string()), *[(c.split()[0], pa.binary()) for c in _SHARD.split(", ")[5:]]])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple]] = {}
        count, number = {}, TaskContext.get().partitionId() << 32

        def sent(dim: int, all_of_it: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            most = max(1, min(size, SHARD_NUMBERS // max(dim, 1)))
            parts = [np.concatenate(x) for x in zip(*waiting.pop(dim), strict=True)]
            at = 0
            while len(parts[0]) - at >= (1 if all_of_it else most):
                row = _made(dim, number, *(p[at : at + most] for p in parts), k)
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)
                number, at = number + 1, at + most
            waiting[dim], count[dim] = [tuple(p[at:] for p in parts)], len(parts[0]) - at

        for batch in batches:
            vectors = batch.column(1)
            lengths = np.diff(vectors.offsets.to_numpy())
            flat = vectors.values.slice(vectors.offsets[0].as_py(), int(lengths.sum()))
            with np.errstate(over="ignore"):
                numbers = np.floor(64 * flat.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False))
            ends = np.cumsum(lengths)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(numbers))])
            fine = (bad[ends] == bad[ends - lengths]) & vectors.is_valid().to_numpy(zero_copy_only=False)
            ids, named = batch.column(0).fill_null(0).to_numpy(), np.where(batch.column(0).is_valid().to_numpy(zero_copy_only=False), 2, 1).astype(np.int8)
            asked = batch.column(2).to_numpy(zero_copy_only=False)
            for dim in np.unique(lengths[fine]).tolist():
                own = np.flatnonzero(fine & (lengths == dim))
                waiting.setdefault(dim, []).append((numbers[(ends - lengths)[own, None] + np.arange(dim)].reshape(len(own), dim), ids[own], named[own], asked[own]))
                count[dim] = count.get(dim, 0) + len(own)
                if count[dim] >= min(size, SHARD_NUMBERS // max(dim, 1)):
                    yield from sent(dim, False)
        for dim in list(waiting):
            yield from sent(dim, True)

    return rows.mapInArrow(run, _SHARD)


_FOUND = "shard long, place int, query_id long, score long, vec_id long, named byte"


def _found(rows: list[tuple[int, np.ndarray, np.ndarray]], best: Best) -> pa.Table:
    """What is in ``best``, a row each, for blocks (shard, places, ids) of queries one after the other."""
    shards = np.concatenate([np.full(len(p), s) for s, p, _ in rows]) if rows else np.zeros(0, np.int64)
    places, ids = (np.concatenate([r[i] for r in rows]) if rows else np.zeros(0, np.int64) for i in (1, 2))
    at, column = np.nonzero(best.named)
    named = best.named[at, column]
    arrays = [pa.array(shards[at]), pa.array(places[at].astype(np.int32)), pa.array(ids[at]), pa.array(best.scores[at, column]), pa.array(best.ids[at, column], mask=named == 1), pa.array(named)]
    return pa.Table.from_arrays(arrays, names=["shard", "place", "query_id", "score", "vec_id", "named"])


def _best_of(row: dict, k: int) -> Best:
    best = Best(row["n_queries"], k)
    best.scores, best.ids = (np.frombuffer(row[c], np.int64).reshape(-1, k) for c in ("scores", "best_ids"))
    best.named = np.frombuffer(row["best_named"], np.int8).reshape(-1, k)
    return best


def topk(df: DataFrame, k: int, asked: Column, *, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of ``df`` that ``asked`` holds for, the ``k`` other rows of the largest inner products.

    A vector's components are floor(64 * x), x as a double; scores are their integer inner products (beyond a long: its limits). Ties go to the smaller id; rows without
    one come after those and are named null. Vectors that are null, or hold a null or a component whose 64-fold isn't finite, take no part; a query meets vectors of its
    own length only. Each row is a row of its own, also where ids or vectors repeat. Fewer other rows than ``k`` are all returned; no rows give no rows.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"), F.coalesce(asked, F.lit(False)).alias("asked"))
    shards = stored(_shards(rows, k, shard), "kd-shards")
    sizes = shards.groupBy("dim").agg(F.count("*").alias("shards"), F.sum(F.col("n") * F.col("dim")).alias("numbers"), F.sum(F.col("n_queries") * F.col("dim")).alias("query_numbers"))
    tasks = parallelism(df.sparkSession)
    groups = F.greatest(F.ceil(F.col("numbers") / GROUP_NUMBERS), F.least(F.ceil(F.col("numbers") / LEAST_NUMBERS), F.lit(tasks)), F.lit(1))
    plan = sizes.select("dim", groups.alias("groups"), F.greatest(F.ceil(F.col("query_numbers") / BLOCK_NUMBERS), F.lit(1)).alias("blocks")).where("shards > 1")
    there = F.sequence(F.lit(0), F.col("groups") - 1), F.sequence(F.lit(0), F.col("blocks") - 1)
    place = F.xxhash64("shard")
    asking = shards.join(plan, "dim").where("n_queries > 0").select("dim", "shard", "kind", "n_queries", "queries", "q_ids", "q_places", "scores", "best_named", F.pmod(place, "blocks").alias("block"), F.explode(there[0]).alias("grp"))
    # Under new names, as one table on both sides of a meeting is ambiguous.
    renamed = shards.select(*[F.col(c).alias(f"of_{c}") for c in shards.columns]).select(*[F.col(f"of_{c}").alias(c) for c in shards.columns])
    asked_of = renamed.join(plan, "dim").select("dim", "shard", "kind", "n", "vectors", "low", "high", "spans", "ids", "named", F.pmod(place, "groups").alias("grp"), F.explode(there[1]).alias("block"))

    def meet(queries: pa.Table, trees: pa.Table) -> pa.Table:
        """A block of queries against a group of shards, with the kth scores that each query has from its own shard."""
        own = queries.sort_by("shard").to_pylist() if trees.num_rows else []
        vectors = [_matrix(q["queries"], q["kind"], q["dim"], q["n_queries"]) for q in own]
        home = np.concatenate([np.full(q["n_queries"], q["shard"]) for q in own]) if own else np.zeros(0, np.int64)
        floor = [np.where(np.frombuffer(q["best_named"], np.int8).reshape(-1, k)[:, -1] > 0, np.frombuffer(q["scores"], np.int64).reshape(-1, k)[:, -1], -LARGEST - 1) for q in own]
        best = Best(len(home), k, np.concatenate(floor) if own else None)
        if own:
            asking = np.concatenate(vectors)
            for batch in trees.sort_by("shard").to_batches(max_chunksize=1):
                t = batch.to_pylist()[0]
                boxes = [np.frombuffer(t[c], t["kind"]).astype(np.float64).reshape(-1, t["dim"]) for c in ("low", "high")] if t["dim"] else [np.zeros((1, 0))] * 2
                tree = Tree(*boxes, np.frombuffer(t["spans"], np.int32).reshape(-1, 4))
                held = (_matrix(t["vectors"], t["kind"], t["dim"], t["n"]), np.frombuffer(t["ids"], np.int64), np.frombuffer(t["named"], np.int8))
                others = np.flatnonzero(home != t["shard"])
                for at in range(0, len(others), TOGETHER):
                    some = others[at : at + TOGETHER]
                    search(tree, *held, asking[some], best, some)
        return _found([(q["shard"], np.frombuffer(q["q_places"], np.int64), np.frombuffer(q["q_ids"], np.int64)) for q in own], best)

    def at_home(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q in batch.to_pylist():
                yield from _found([(q["shard"], np.frombuffer(q["q_places"], np.int64), np.frombuffer(q["q_ids"], np.int64))], _best_of(q, k)).to_batches()

    keys = ["dim", "block", "grp"]
    first = shards.where("n_queries > 0").select("shard", "n_queries", "q_ids", "q_places", "scores", "best_ids", "best_named").mapInArrow(at_home, _FOUND)
    rest = asking.groupBy(*keys).cogroup(asked_of.groupBy(*keys)).applyInArrow(meet, _FOUND)
    order = Window.partitionBy("shard", "place").orderBy(F.desc("score"), F.desc("named"), "vec_id")
    ranked = first.unionByName(stored(rest, "kd-found")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
