"""What the operators share: the cluster's shared folder, written intermediate tables, Arrow batches cut by size."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of text that one vectorised step handles at a time; a longer single text is its own step.
STEP_BYTES = 2_000_000
#: The same where arrays of words, n-grams and bands stand beside the text.
WORD_STEP_BYTES = 1_000_000
#: Bytes of an Arrow batch where several stages share the workers.
BATCH_BYTES = 8_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where that is unset, a temporary one on a single machine, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it's done, not when the driver's memory happens to be cleaned."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def small_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """From now on the session's Arrow batches have ``most`` bytes at most, unless its limit is lower: workers hold a batch several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.match(r"(-?\d+)\s*([kmg]?)", spark.conf.get(name).lower()).groups()
    now = int(number) << {"": 0, "k": 10, "m": 20, "g": 30}[unit]
    if not 0 < now <= most:
        spark.conf.set(name, str(most))


def stored(df: DataFrame, what: str, hashes: bool = False) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read again: cuts the lineage, survives lost executors. ``hashes``: no dictionaries are tried, as hardly a value comes twice."""
    path = shared_path(df.sparkSession, what)
    with tidy(df.sparkSession):
        df.write.option("compression", "zstd").option("parquet.enable.dictionary", str(not hashes).lower()).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def widened(df: DataFrame, added: str) -> StructType:
    """The schema of ``df`` with the columns of a DDL string after its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the n + 1 offsets between them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) of at most ``most`` bytes each, or of a single row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, j
        i = j
