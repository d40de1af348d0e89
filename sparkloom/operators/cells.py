"""A vector index whose cells keep themselves: large ones split, small ones merge, members move to where they belong, and searches probe as many as a measured recall wants.

The index is a folder of tables that grow by committed batches (``batches``): int8 ``members`` by cell, ``centroids`` (each batch that has them has all), ``probes``. What
upkeep changes is one batch of its own: the members that have moved in the end and the new centroids. Its passes work on a table of the live members that is read from the batches once.

There are at most ``CELLS_MOST`` cells, as the size from which a cell splits grows with the number of vectors; so centroids, cell sizes and the sums of a split are small tables
that the driver may hold. Vectors never pass through it.
"""

from __future__ import annotations

from collections.abc import Collection, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import vectors
from sparkloom.operators import batches, search
from sparkloom.sources.tables import written

#: Fixed values of the reference's upkeep: vectors from which there are cells, inserts after which upkeep runs.
LEAST_FOR_CELLS, PENDING = 128, 100
#: A cell splits beyond ``MOST`` members, or a quarter of few, and merges under ``LEAST``; rounds of a split; neighbours whose members may move to a new cell; cells that there may be; vectors a task that writes a cell; times k that are scored by full vectors.
MOST, LEAST, ROUNDS, NEAR, CELLS_MOST, ROWS_A_PART, RESCORED = 2_000, 200, 6, 4, 4_096, 500_000, 4
MEMBERS = "id long, q array<tinyint>, scale double, vector array<float>, cell int"
CENTROIDS = "cell int, c array<double>"


def _latest(spark: SparkSession, path: str, name: str) -> str | None:
    """The folder of the last committed batch that has the table."""
    return next((f for b in reversed(batches.committed(spark, path)) if batches.exists(spark, f := f"{path}/{name}/batch={b}")), None)


def _centroids(spark: SparkSession, path: str) -> dict[int, np.ndarray]:
    found = _latest(spark, path, "centroids")
    return {r["cell"]: np.array(r["c"]) for r in spark.read.schema(CENTROIDS).parquet(found).collect()} if found else {}


def members(spark: SparkSession, path: str) -> DataFrame:
    """(id, q, scale, vector, cell, batch) of the live vectors."""
    return batches.live(spark, path, batches.read(spark, path, "members", MEMBERS))


def _matrix(column: pa.Array) -> np.ndarray:
    at = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].reshape(len(column), -1).astype(float)


def placed(rows: DataFrame, centroids: dict[int, np.ndarray], *, vector: str = "vector", among: set[int] | None = None) -> DataFrame:
    """``rows`` with ``cell``: the centroid of the largest dot product, the smaller number on a tie; cell 0 where there is none. Vectors meet the centroids in matrix products of ``search.SCORES`` numbers.

    With ``among``, only rows that have one of these as their ``cell`` are placed, the others keep theirs.
    """
    own = [c for c in rows.columns if c != "cell"]
    if not centroids:
        return rows.select(*own, F.lit(0).alias("cell") if among is None else F.when(F.col("cell").isin(list(among)), 0).otherwise(F.col("cell")).alias("cell"))
    names = np.array(sorted(centroids), np.int32)
    shared = rows.sparkSession.sparkContext.broadcast(np.array([centroids[c] for c in names]))
    place, step = own.index(vector), max(1, search.SCORES // len(names))

    def run(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            if not batch.num_rows:
                continue
            cell = np.zeros(batch.num_rows, np.int32) if among is None else batch.column(len(own)).to_numpy().copy()
            at = np.flatnonzero(np.isin(cell, list(among))) if among is not None else np.arange(batch.num_rows)
            for part in np.split(at, range(step, len(at), step)):
                if len(part):
                    cell[part] = names[np.round(_matrix(batch.column(place).take(pa.array(part))) @ shared.value.T, 6).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(own)], pa.array(cell)], names=[*own, "cell"])

    kinds = ", ".join(f"`{c}` {kind}" for c, kind in rows.dtypes if c != "cell")
    return rows.select(*own, *(["cell"] if among is not None else [])).mapInArrow(run, f"{kinds}, cell int")


def _put_members(spark: SparkSession, path: str, batch: int, rows: DataFrame) -> None:
    """Writes (id, q, scale, vector, cell) in place of what earlier batches have of the ids."""
    batches.put(rows.select("id").distinct(), path, "gone", batch)
    n = spark.read.parquet(f"{path}/gone/batch={batch}").count()
    part = F.pmod(F.xxhash64("id"), F.lit(max(1, -(-n // ROWS_A_PART))))
    batches.put(rows.select("id", "q", "scale", "vector", F.col("cell").cast("int").alias("cell")).withColumn("part", part), path, "members", batch, "cell", "part")


def add(rows: DataFrame, path: str, *, ident: str = "vec_id", vector: str = "embedding") -> None:
    """Adds vectors of one length, in place of those of the same ids, to the cells of their nearest centroids, as int8 with a scale and as 32-bit numbers. Null vectors are left out."""
    spark = rows.sparkSession
    own = rows.select(F.col(ident).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector")).where(F.col("vector").isNotNull() & F.col("id").isNotNull())
    batch = batches.next_batch(spark, path)
    small = placed(own, _centroids(spark, path)).select("id", vectors.quantized(F.col("vector")).alias("z"), "vector", "cell")
    _put_members(spark, path, batch, small.select("id", F.col("z.q").alias("q"), "z.scale", "vector", "cell"))
    batches.commit(spark, path, batch)


def remove(spark: SparkSession, path: str, ids: DataFrame, ident: str = "id") -> None:
    batch = batches.next_batch(spark, path)
    batches.put(ids.select(F.col(ident).cast("long").alias("id")).distinct(), path, "gone", batch)
    batches.commit(spark, path, batch)


def pending(spark: SparkSession, path: str) -> int:
    """Vectors added since the last upkeep."""
    last = _latest(spark, path, "centroids")
    since = int(last.rpartition("=")[2]) if last else 0
    return batches.read(spark, path, "members", MEMBERS).where(F.col("batch") > since).count()


def upkeep_if_needed(spark: SparkSession, path: str, **how: int) -> bool:
    """Upkeep after ``PENDING`` inserts or where there are no cells yet and enough vectors; whether it ran."""
    new, none = pending(spark, path), _latest(spark, path, "centroids") is None
    if new < PENDING and not (new == 0 and none and members(spark, path).count() >= LEAST_FOR_CELLS):
        return False
    return upkeep(spark, path, **how)


def upkeep(spark: SparkSession, path: str, *, most: int = MOST, least: int = LEAST) -> bool:
    """Splits and merges until every cell has its size; whether there are cells. With fewer than ``LEAST_FOR_CELLS`` vectors there are none, and searches read all.

    Each pass halves all cells that are too large at once, drops the centroids of those that are too small, and places the members of the cells concerned, and of the neighbours of the new ones,
    anew. All passes are one batch in the end. A cell of equal vectors can't be split and stays.
    """
    had = known = _centroids(spark, path)
    work = written(members(spark, path).select("id", "q", "scale", "vector", F.col("cell").alias("was"), "cell"), "live")
    stuck: set[int] = set()
    changed = False
    while True:
        sizes = {r["cell"]: r["count"] for r in work.groupBy("cell").count().collect()}
        n = sum(sizes.values())
        if n < LEAST_FOR_CELLS:
            if had:
                _change(spark, path, {}, work.where("cell <> 0").withColumn("cell", F.lit(0)))
            return False
        limit = max(min(most, n // 4), 2 * n // CELLS_MOST)
        now = known or {0: _means(work.select(F.lit(0).alias("cell"), "vector"))[0]}
        # Only the first pass merges, as alternating splits and merges need not end; the smaller half goes, the rest may grow by that.
        small = sorted((c for c in now if sizes.get(c, 0) < min(least, limit // 2)) if not changed and known else (), key=lambda c: (sizes.get(c, 0), -c))
        small = set(small[: (len(small) + 1) // 2 if len(small) > 1 or len(now) > 1 else 0])
        halves = _halves(work, sizes, {c: now[c] for c, size in sizes.items() if size > limit and c in now and c not in stuck})
        stuck |= {c for c, (_, other) in halves.items() if other is None}
        after = {c: v for c, v in now.items() if c not in small}
        fresh: set[int] = set()
        for cell, (one, other) in sorted(halves.items()):
            if other is not None:
                new = max(after) + 1
                after[cell], after[new] = one, other
                fresh |= {cell, new}
        concerned = small | fresh | _neighbours(after, fresh) | (set(sizes) - set(known) if known else set(sizes))
        if not small and not fresh:
            if changed:
                _change(spark, path, after, work.where("cell <> was"))
            elif not had or pending(spark, path):
                _change(spark, path, after, None)  # so that upkeep is known to have run
            return True
        work = written(placed(work, after, among={c for c in concerned if c in sizes}), "placed")
        known, changed = after, True


def _change(spark: SparkSession, path: str, centroids: dict[int, np.ndarray], moved: DataFrame | None) -> None:
    """A batch of new centroids, and of the members that have ``moved``."""
    batch = batches.next_batch(spark, path)
    if moved is not None:
        _put_members(spark, path, batch, moved)
    rows = [(int(c), v.tolist()) for c, v in sorted(centroids.items())]
    batches.put(spark.createDataFrame(rows, CENTROIDS).coalesce(1), path, "centroids", batch)
    batches.commit(spark, path, batch)


def _means(rows: DataFrame, sides: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    """The mean vector of each cell of (cell, vector), or, with two centroids a cell in ``sides``, of each side: then by 2 * cell + side. Sums are a row a task and cell before they're added up."""
    shared = rows.sparkSession.sparkContext.broadcast(sides)

    def run(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in given:
            if not batch.num_rows:
                continue
            cell, x = batch.column(0).to_numpy().astype(np.int64), _matrix(batch.column(1))
            order = np.argsort(cell, kind="stable")
            cell, x = cell[order], x[order]
            group = cell if shared.value is None else 2 * cell
            if shared.value is not None:
                names, first = np.unique(cell, return_index=True)
                for c, a, b in zip(names.tolist(), first, [*first[1:], len(cell)], strict=True):
                    group[a:b] += np.round(x[a:b] @ shared.value[c].T, 6).argmax(axis=1)
                order = np.argsort(group, kind="stable")
                group, x = group[order], x[order]
            names, first = np.unique(group, return_index=True)
            for name, n, s in zip(names.tolist(), np.diff([*first, len(group)]).tolist(), np.add.reduceat(x, first, axis=0), strict=True):
                own = total.setdefault(name, [0, 0.0])
                own[0] += n
                own[1] = own[1] + s
        names = sorted(total)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([total[c][0] for c in names], pa.int64()), pa.array([total[c][1].tolist() for c in names], pa.list_(pa.float64()))], names=["name", "n", "sums"])

    parts = rows.select("cell", "vector").mapInArrow(run, "name long, n long, sums array<double>").groupBy("name").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("sums")).alias("sums"))  # a part a task
    whole = F.aggregate(F.slice("sums", 2, F.size("sums")), F.col("sums")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    found = parts.select("name", F.transform(whole, lambda x: F.round(x / F.col("n"), 9)).alias("c"))
    return {r["name"]: np.array(r["c"]) for r in found.collect()}  # at most two a cell


def _farthest(rows: DataFrame, of: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Of each cell the member of the smallest dot product with its vector in ``of``; the smallest id on a tie."""
    shared = rows.sparkSession.sparkContext.broadcast(of)

    def run(given: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in given:
            if not batch.num_rows:
                continue
            ids, cell, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            dots = np.round(np.einsum("ij,ij->i", x, np.array([shared.value[c] for c in cell.tolist()])), 6)
            order = np.lexsort((ids, dots, cell))
            first = order[np.unique(cell[order], return_index=True)[1]]
            yield pa.RecordBatch.from_arrays([pa.array(cell[first]), pa.array(dots[first]), batch.column(0).take(pa.array(first)), batch.column(2).take(pa.array(first))], names=["cell", "dot", "id", "vector"])

    found = rows.select("id", "cell", "vector").mapInArrow(run, "cell int, dot double, id long, vector array<float>").groupBy("cell").agg(F.min(F.struct("dot", "id", "vector")).alias("m"))
    return {r["cell"]: np.array(r["m"]["vector"]) for r in found.collect()}  # one a cell


def _halves(work: DataFrame, sizes: dict[int, int], large: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray | None]]:
    """Two centroids for each of the large cells by a 2-means of its own members, all cells at once; None for the second where they can't be told apart."""
    if not large:
        return {}
    rows = work.select("id", "cell", "vector")
    if len(large) < len(sizes):
        rows = written(rows.where(F.col("cell").isin(list(large))), "large-cells")
    one = _farthest(rows, large)
    other = _farthest(rows, one)
    sides = {c: np.array([one[c], other[c]]) for c in one}
    for _ in range(ROUNDS):
        means = _means(rows, sides)
        new = {c: np.array([means.get(2 * c, s[0]), means.get(2 * c + 1, s[1])]) for c, s in sides.items()}
        same = all(np.array_equal(new[c], s) for c, s in sides.items())
        sides = new
        if same:
            break
    else:
        means = _means(rows, sides)
    alone = means
    return {c: (s[0], s[1] if 2 * c in alone and 2 * c + 1 in alone else None) for c, s in sides.items()}


def _neighbours(centroids: dict[int, np.ndarray], fresh: set[int]) -> set[int]:
    """The cells nearest to the new ones."""
    if not fresh:
        return set()
    names = sorted(centroids)
    near = np.array([centroids[c] for c in sorted(fresh)]) @ np.array([centroids[c] for c in names]).T
    return {names[i] for row in near for i in np.argsort(-row, kind="stable")[: NEAR + 1].tolist()}


# Searches


def _near(matrix: np.ndarray, centroids: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The cells, and for each row of a matrix of queries the places of all of them from the nearest on; the smaller number on a tie. Without centroids there is cell 0."""
    if not centroids:
        return np.zeros(1, np.int32), np.zeros((len(matrix), 1), np.uint16)
    names = np.array(sorted(centroids), np.int32)
    c = np.array([centroids[x] for x in names])
    order, step = np.zeros((len(matrix), len(names)), np.uint16), max(1, search.SCORES // len(names))
    for i in range(0, len(matrix), step):
        part = matrix[i : i + step]
        scores = np.round(part @ c.T, 6) if part.shape[1] == c.shape[1] else np.zeros((len(part), len(c)))
        order[i : i + step] = np.argsort(-scores, axis=1, kind="stable")
    return names, order


class _Search:
    """The rough best, by int8 vectors, of a block of queries in more and more of their nearest cells. The driver holds the block's vectors once and a number for each query and cell, rows of both never."""

    def __init__(self, block: DataFrame, centroids: dict[int, np.ndarray], k: int) -> None:
        self.block, self.k, self.kind = block, k, dict(block.dtypes)["query"]
        self.names, self.matrix, _ = search.query_matrix(block)
        self.cells, self.order = _near(self.matrix, centroids)
        self.probes, self.rough, self.read = 0, None, set()

    def _within(self, live: DataFrame, cells: Collection[int]) -> DataFrame:
        return live if len(cells) == len(self.cells) else live.where(F.col("cell").isin(list(cells)))

    def found(self, live: DataFrame, probes: int) -> DataFrame:
        """(query, id, score, rank) in the ``probes`` nearest cells; only those that weren't probed before are read for it."""
        new = self.order[:, self.probes : probes]
        asked = search.by_cell(self.cells[new.ravel()], np.repeat(np.arange(len(new)), new.shape[1]))
        self.read |= set(asked)
        if asked:
            rough = search.of_cells(self._within(live, asked).select("id", F.col("q").alias("v"), "scale", "cell"), self.names, self.matrix, asked, RESCORED * self.k, self.kind)
            rough = rough if self.rough is None else rough.unionByName(self.rough)
            self.rough = written(search.top(rough, RESCORED * self.k).select("query", "id", "score"), "rough")
        self.probes = probes
        if self.rough is None:
            return search.top(live.sparkSession.createDataFrame([], f"query {self.kind}, id long, score double"), self.k)
        full = self._within(live, self.read).select("id", F.col("vector").alias("v")).join(F.broadcast(self.rough.drop("score")), "id").join(F.broadcast(self.block.select("query", "vector")), "query")  # a block
        return search.top(full.select("query", "id", F.round(vectors.dot(F.col("v"), F.col("vector")), 6).alias("score")), self.k)


def find(spark: SparkSession, path: str, queries: DataFrame, k: int, *, probes: int | None = None) -> DataFrame:
    """(query, id, score, rank) in the ``probes`` nearest cells of each query (query, vector), by default as many as were tuned, or else all: the best ``RESCORED`` x k by int8 vectors, put in order by full ones."""
    if probes is None:
        tuned = _latest(spark, path, "probes")
        probes = spark.read.parquet(tuned).head()["probes"] if tuned else CELLS_MOST
    known, live = _centroids(spark, path), members(spark, path)
    return search.in_blocks(queries, lambda block: _Search(block, known, k).found(live, probes))


def tuned(spark: SparkSession, path: str, queries: DataFrame, exact: DataFrame, k: int, recall: float = 0.9) -> tuple[int, float]:
    """Measures (probes, recall at k) of ``queries`` against their ``exact`` results (query, id), for twice as many cells at a time until ``recall`` is reached, and keeps it for searches. A round searches the cells that the last one didn't."""
    centroids, probes = _centroids(spark, path), 1
    known = max(1, len(centroids))
    exact = written(exact.select("query", "id"), "exact")
    total = exact.count()
    kept = written(members(spark, path).drop("batch"), "live")  # for all rounds
    searches = [_Search(block, centroids, k) for block in search.blocks(queries)]
    while True:
        got = sum(s.found(kept, probes).select("query", "id").join(exact, ["query", "id"]).count() for s in searches) / max(1, total)
        if got >= recall or probes >= known or not total:
            break
        probes = min(known, 2 * probes)
    batch = batches.next_batch(spark, path)
    batches.put(spark.createDataFrame([(probes, got)], "probes int, recall double").coalesce(1), path, "probes", batch)
    batches.commit(spark, path, batch)
    return probes, got


def report(spark: SparkSession, path: str) -> DataFrame:
    """One row: vectors, cells, the largest cell, probes and the recall that was measured with them."""
    sizes = members(spark, path).groupBy("cell").count()
    latest = _latest(spark, path, "probes")
    measured = spark.read.parquet(latest) if latest else spark.createDataFrame([(None, None)], "probes int, recall double")
    return sizes.agg(F.sum("count").alias("n"), F.count("*").alias("cells"), F.max("count").alias("largest")).crossJoin(measured.select("probes", F.round("recall", 6).alias("recall")))


def exact(rows: DataFrame, queries: DataFrame, k: int, *, ident: str = "vec_id", vector: str = "embedding", where: Column | None = None) -> DataFrame:
    """What ``tuned`` compares with: the exact k by full vectors."""
    return search.nearest(rows if where is None else rows.where(where), queries, k, ident=ident, vector=vector)
