"""Previous rows, row numbers and running sums by key, also where one key holds a large share of all rows.

A key of up to ``ROWS_A_TASK`` rows is ordered by a plain window. With a larger one about, rows are range-partitioned by key and order, so that a key spreads over
neighbouring partitions; windows work inside each, and what a part needs from the parts before it (their last row, count or sum) comes from a table of a row
a key and partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.sources.tables import written

ROWS_A_TASK = 2_000_000


def _is_hot(df: DataFrame, by: list[str], limit: int) -> bool:
    largest = df.groupBy(*by).count().agg(F.max("count").alias("m")).head()["m"]
    return (largest or 0) > limit


def _parts(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return written(df.repartitionByRange(*[F.col(c) for c in (*by, *order)]).withColumn("__part", F.spark_partition_id()), "parts")


def with_previous(df: DataFrame, by: list[str], order: list[str], columns: list[str], *, limit: int = ROWS_A_TASK) -> DataFrame:
    """Adds previous_<column> of the row before in a key's order; null for its first."""
    if not _is_hot(df, by, limit):
        w = Window.partitionBy(*by).orderBy(*order)
        return df.withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})
    parts = _parts(df, by, order)
    w = Window.partitionBy(*by, "__part").orderBy(*order)
    inside = parts.withColumn("__row", F.row_number().over(w)).withColumns({f"previous_{c}": F.lag(c).over(w) for c in columns})
    last = parts.groupBy(*by, "__part").agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("__last"))
    before = last.withColumn("__before", F.lag("__last").over(Window.partitionBy(*by).orderBy("__part"))).drop("__last")
    both = inside.join(before, [*by, "__part"], "left")
    return both.withColumns({f"previous_{c}": F.when(F.col("__row") == 1, F.col(f"__before.{c}")).otherwise(F.col(f"previous_{c}")) for c in columns}).drop("__part", "__row", "__before")


def with_running_sum(df: DataFrame, by: list[str], order: list[str], value: str, name: str, *, limit: int = ROWS_A_TASK) -> DataFrame:
    """Adds the sum of ``value`` (long) up to each row in a key's order; rows of equal order share theirs in no particular way, so the order should be total."""
    rows = lambda w: w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    if not _is_hot(df, by, limit):
        return df.withColumn(name, F.sum(value).over(rows(Window.partitionBy(*by))))
    parts = _parts(df, by, order)
    inside = parts.withColumn(name, F.sum(value).over(rows(Window.partitionBy(*by, "__part"))))
    sums = parts.groupBy(*by, "__part").agg(F.sum(value).alias("__sum"))
    before = sums.withColumn("__before", F.sum("__sum").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))).drop("__sum")
    both = inside.join(before, [*by, "__part"], "left")
    return both.withColumn(name, F.col(name) + F.coalesce("__before", F.lit(0))).drop("__part", "__before")


def with_row_number(df: DataFrame, by: list[str], order: list[str], name: str, *, limit: int = ROWS_A_TASK) -> DataFrame:
    """Adds the row's number in its key's order, from 1."""
    return with_running_sum(df.withColumn("__one", F.lit(1)), by, order, "__one", name, limit=limit).drop("__one")
