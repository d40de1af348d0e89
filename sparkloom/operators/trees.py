"""Trees as (graph_id, node_id, parent_id) rows: paths, layout, closures. Levels are joined one at a time; the loop ends with the deepest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.ordered import with_row_number
from sparkloom.sources.tables import written


def flattened(nodes: DataFrame, most_depth: int = 64) -> DataFrame:
    """(graph_id, node_id, parent_id, depth, path): path "0.i.j" by the order of siblings' ids; nodes that no root reaches are left out."""
    placed = with_row_number(nodes.select("graph_id", "node_id", "parent_id", F.coalesce("parent_id", F.lit(-(1 << 62))).alias("__under")), ["graph_id", "__under"], ["node_id"], "i")
    numbered = written(placed.select("graph_id", "node_id", "parent_id", (F.col("i") - 1).cast("string").alias("i")), "tree")
    level = numbered.where("parent_id is null").select("graph_id", "node_id", "parent_id", F.lit(0).alias("depth"), F.col("i").alias("path"))
    out = level
    children = numbered.where("parent_id is not null")
    for depth in range(1, most_depth + 1):
        above = level.select("graph_id", F.col("node_id").alias("parent_id"), F.col("path").alias("up"))
        level = written(children.join(above, ["graph_id", "parent_id"]).select("graph_id", "node_id", "parent_id", F.lit(depth).alias("depth"), F.concat_ws(".", "up", "i").alias("path")), "level")
        if level.isEmpty():
            return out
        out = out.unionByName(level)
    raise ValueError(f"deeper than {most_depth}")


def layout(flat: DataFrame, dx: int = 260, dy: int = 92) -> DataFrame:
    """x by depth, y by the order of paths, as strings, on a level; a level may hold most of a graph."""
    placed = with_row_number(flat.select("graph_id", "node_id", "depth", "path"), ["graph_id", "depth"], ["path"], "place")
    return placed.select("graph_id", "node_id", "depth", "path", (F.col("depth") * dx).alias("x"), ((F.col("place") - 1) * dy).cast("int").alias("y"))


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, pid, depth) of (pid, ppid) edges: everything under each root, the root too; a pid is listed once at its least depth, so loops end."""
    seen = written(roots.select("root", F.col("root").alias("pid"), F.lit(0).alias("depth")), "closure")
    front, depth = seen, 0
    while True:
        depth += 1
        new = edges.join(front.select("root", F.col("pid").alias("ppid")), "ppid").select("root", "pid").distinct()
        front = written(new.join(seen.select("root", "pid"), ["root", "pid"], "left_anti").withColumn("depth", F.lit(depth)), "closure")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
