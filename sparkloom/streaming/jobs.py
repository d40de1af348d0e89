"""Structured Streaming jobs: windowed samples, log tailing, incremental enrichment, token streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.functions import models
from sparkloom.operators.runs import log_events
from sparkloom.streaming import growing


def events_stream(spark: SparkSession, folder: str, schema, *, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of events as they arrive in a folder, or a single file; times as timestamps, which watermarks want."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isFile():  # a stream reads folders only
        reader, folder = reader.option("pathGlobFilter", path.getName()), path.getParent().toString()
    df = reader.parquet(folder)
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, *, size: str = "6 hours", late: str = "1 day") -> DataFrame:
    """Counts and peaks by window and kind; a window is final once the watermark has passed it."""
    found = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.max("value").alias("peak"))
    return found.select(F.col("window.start").cast("long").alias("start_s"), "event_type", "n", "peak")


def tailed(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Typed events of log files as these grow (``growing``): file, offset, value, kind, subject, ts_ms, elapsed_ms, each event once."""
    return log_events(growing.lines(spark, folder, **options))


def enrich(chunks: DataFrame, out: str, checkpoint: str, *, enrich_text: Callable = models.first_sentences) -> StreamingQuery:
    """Chunks (doc_id, chunk_index, text) get an enriched text and its vector; each micro-batch is written under its own number, so a repeated one overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        done = batch.withColumn("enriched_text", enrich_text(F.col("text")))
        done.withColumn("enriched_embedding", models.run("embed", F.col("enriched_text"))).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return chunks.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sse_deltas(lines: DataFrame) -> DataFrame:
    """(content, reasoning) of server-sent "data:" lines; the end mark and what isn't JSON are passed over."""
    body = F.trim(F.regexp_extract("value", r"^data:\s*(.*)$", 1))
    schema = "choices array<struct<delta: struct<content: string, reasoning_content: string>>>"
    parsed = lines.withColumn("body", body).where("body <> '' and body <> '[DONE]'").withColumn("m", F.from_json("body", schema)).where("m.choices is not null")
    delta = F.element_at("m.choices", 1)["delta"]
    return parsed.select(delta["content"].alias("content"), delta["reasoning_content"].alias("reasoning")).where("content is not null or reasoning is not null")


def finished(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, through to the end, as a table in memory: for tests and small runs."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
