"""Parquet tables of a folder, and written intermediate results."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that are broadcast at most.
BESIDE = 300_000
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table, its time-zone-less times as timestamps (streams and watermarks want these)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    times = {c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"}
    return df.withColumns(times) if times else df


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; where it's unset, a temporary folder on a single machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it's done."""
    before = spark.conf.get(TIDY, None)
    spark.conf.set(TIDY, "true")
    try:
        yield
    finally:
        spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read again: the lineage ends there, and its shuffle files go."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def beside(df: DataFrame, what: str) -> DataFrame:
    """``df``, some keys of a larger table's rows, written. If they're few they go to the larger table, which isn't shuffled then."""
    out = written(df, what)
    return F.broadcast(out) if out.count() <= BESIDE else out
