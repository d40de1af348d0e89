"""Workspaces: named databases of tables, saved as a folder of Parquet with a manifest, and read back."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def is_safe(path: str) -> bool:
    """Relative, and never upwards."""
    return bool(path) and not path.startswith(("/", "\\")) and ".." not in re.split(r"[/\\]", path) and ":" not in path


def save(tables: dict[str, DataFrame], folder: str, *, mode: str = "errorifexists") -> None:
    """Each table as Parquet, then a manifest of their names, so that a half-saved workspace can't be opened."""
    for name, df in tables.items():
        if not is_safe(name):
            raise ValueError(f"no name for a table: {name!r}")
        df.write.mode(mode).parquet(f"{folder}/tables/{name}")
    if tables:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame([(VERSION, sorted(tables))], "version int, tables array<string>").coalesce(1).write.mode(mode).json(f"{folder}/manifest")


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a saved workspace; another version is an error."""
    manifest = spark.read.schema("version int, tables array<string>").json(f"{folder}/manifest").head()
    if manifest is None or manifest["version"] != VERSION:
        raise ValueError(f"not a workspace of version {VERSION}: {folder}")
    if bad := [t for t in manifest["tables"] if not is_safe(t)]:
        raise ValueError(f"unsafe names: {bad}")
    return {t: spark.read.parquet(f"{folder}/tables/{t}") for t in manifest["tables"]}


def create(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def use(spark: SparkSession, name: str) -> None:
    spark.catalog.setCurrentDatabase(name)


def drop(spark: SparkSession, name: str) -> None:
    """Drops a workspace; the current one gives way to the default."""
    if spark.catalog.currentDatabase() == name:
        spark.catalog.setCurrentDatabase("default")
    spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")


def listed(spark: SparkSession) -> DataFrame:
    return spark.sql("SHOW DATABASES").withColumn("active", F.col("namespace") == spark.catalog.currentDatabase())
