"""Documents and what hangs on them as stored tables that change: upserts, values set by key, cascading deletes, media that get their vectors, and reads of an earlier state.

A store is a folder of tables that grow by committed batches (``batches``). A change writes the rows that it changes and nothing else: rows by key in ``<table>``, the document's
ids of a delete in ``gone``. A table's state at a batch is, of each key, the row of the last batch up to it, less those of documents deleted since; keys that only the first
batch has are never shuffled, as only later changes are joined. A reader names a batch and sees that state, whatever is written meanwhile; a writer that dies before its commit has written nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import models
from sparkloom.operators import batches
from sparkloom.sources.tables import written


class Kind(NamedTuple):
    schema: str
    keys: tuple[str, ...]  # of which the first is the document


class Store(NamedTuple):
    path: str
    kinds: dict[str, Kind]


def state(spark: SparkSession, store: Store, name: str, at: int | None = None) -> DataFrame:
    """A table as it was after batch ``at``, or as it is."""
    schema, keys = store.kinds[name]
    rows = batches.read(spark, store.path, name, schema, at)
    first = batches.committed(spark, store.path)[:1]
    later = rows.where(F.col("batch") > (first[0] if first else 0)).groupBy(*keys).agg(F.max("batch").alias("last"))
    newest = rows.join(later, list(keys), "left").where(F.col("last").isNull() | (F.col("batch") == F.col("last"))).drop("last")
    fields = [c for c in newest.columns if c != "batch"]
    return batches.live(spark, store.path, newest.withColumnRenamed(keys[0], "id"), at).withColumnRenamed("id", keys[0]).select(*fields)


def version(spark: SparkSession, store: Store) -> int:
    """The number of the last batch; 0 before any."""
    return max(batches.committed(spark, store.path), default=0)


def upsert(spark: SparkSession, store: Store, **tables: DataFrame) -> int:
    """Rows of some tables in place of those of the same keys, as one batch, whose number it returns. Keys aren't null; of rows of one key, one counts."""
    batch = batches.next_batch(spark, store.path)
    for name, rows in tables.items():
        kind = store.kinds[name]
        fields = spark.createDataFrame([], kind.schema).schema
        own = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in fields]).dropDuplicates(list(kind.keys))
        batches.put(own, store.path, name, batch)
    batches.commit(spark, store.path, batch)
    return batch


def set_values(spark: SparkSession, store: Store, name: str, values: DataFrame) -> int:
    """Sets the columns of ``values`` in the rows of its keys; a null there sets nothing, and keys that aren't there are passed over. Only rows that change are written."""
    keys = list(store.kinds[name].keys)
    new = values.dropDuplicates(keys).select(*keys, *[F.col(c).alias(f"__{c}") for c in values.columns if c not in keys])
    own = [c for c in values.columns if c not in keys]
    rows = state(spark, store, name).join(new, keys)
    differs = F.lit(False)
    for c in own:
        differs = differs | (F.col(f"__{c}").isNotNull() & ~F.col(f"__{c}").eqNullSafe(F.col(c)))
    changed = rows.where(differs).withColumns({c: F.coalesce(f"__{c}", c) for c in own}).drop(*[f"__{c}" for c in own])
    return upsert(spark, store, **{name: written(changed, "changed")})


def delete(spark: SparkSession, store: Store, ids: DataFrame, key: str = "doc_id") -> int:
    """Ends documents, and in the same batch all that hangs on them in any table."""
    batch = batches.next_batch(spark, store.path)
    batches.put(ids.select(F.col(key).cast("long").alias("id")).distinct(), store.path, "gone", batch)
    batches.commit(spark, store.path, batch)
    return batch


def embed_media(spark: SparkSession, store: Store, name: str = "media", *, embed: Callable[[Column], Column] = lambda x: models.run("embed", x)) -> int:
    """Gives media that have a caption and no vector theirs; returns how many there were."""
    waiting = state(spark, store, name).where("embedding is null and caption <> ''")
    done = written(waiting.withColumn("embedding", embed(F.col("caption"))), "embedded")
    n = done.count()
    if n:
        upsert(spark, store, **{name: done})
    return n


def replace(spark: SparkSession, store: Store, ids: DataFrame, key: str = "doc_id", **tables: DataFrame) -> int:
    """Documents anew: what hung on them goes, and ``tables`` have what hangs on them now; one batch, so that no reader sees a half."""
    batch = batches.next_batch(spark, store.path)
    batches.put(ids.select(F.col(key).cast("long").alias("id")).distinct(), store.path, "gone", batch)
    return upsert(spark, store, **tables)


def compacted(spark: SparkSession, store: Store, to: str) -> Store:
    """The present state as the one batch of a new store."""
    new = Store(to, store.kinds)
    upsert(spark, new, **{name: state(spark, store, name) for name in store.kinds})
    return new
