"""Tables that grow by committed batches.

A table is a folder with a folder a batch. A batch counts once its row in ``commits`` is written, which is last; so a job that dies leaves nothing behind that is read.
Ids in a batch's ``gone`` end what earlier batches have of them. One program writes at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.tables import tidy

COMMITS = "batch long"


def committed(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the committed batches."""
    try:
        return sorted(r["batch"] for r in spark.read.schema(COMMITS).parquet(f"{path}/commits").collect())
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):  # nothing yet
            return []
        raise


def next_batch(spark: SparkSession, path: str) -> int:
    return max(committed(spark, path), default=0) + 1


def commit(spark: SparkSession, path: str, batch: int) -> None:
    spark.createDataFrame([(batch,)], COMMITS).coalesce(1).write.mode("append").parquet(f"{path}/commits")


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read(spark: SparkSession, path: str, name: str, schema: str, upto: int | None = None) -> DataFrame:
    """A table's committed batches (those up to ``upto``), with ``batch``."""
    folders = [f"{path}/{name}/batch={b}" for b in committed(spark, path) if upto is None or b <= upto]
    have = [f for f in folders if exists(spark, f)]
    if not have:
        return spark.createDataFrame([], f"{schema}, batch long")
    return spark.read.option("basePath", f"{path}/{name}").schema(f"{schema}, batch long").parquet(*have)


def put(df: DataFrame, path: str, name: str, batch: int, by: str | None = None, spread: str | None = None) -> None:
    """Writes a batch, in a folder for each ``by``; the rows of one ``by`` go to as many tasks as there are values of ``spread``."""
    rows = df if by is None else df.repartition(by) if spread is None else df.repartition(by, spread).drop(spread)
    writer = rows.write.mode("overwrite").option("compression", "zstd")
    with tidy(df.sparkSession):
        (writer.partitionBy(by) if by else writer).parquet(f"{path}/{name}/batch={batch}")


def live(spark: SparkSession, path: str, rows: DataFrame, upto: int | None = None, *, by: str = "id", gone: str = "gone") -> DataFrame:
    """``rows`` (``by``, batch, ...) that no later batch replaces or deletes. What the first batch has in ``gone`` ends nothing, so only later changes are joined."""
    known = committed(spark, path)
    ends = read(spark, path, gone, f"{by} long", upto).where(F.col("batch") > (known[0] if known else 0)).groupBy(by).agg(F.max("batch").alias("until"))
    out = rows.join(ends, by, "left").where(F.col("until").isNull() | (F.col("batch") >= F.col("until")))
    return out.drop("until")
