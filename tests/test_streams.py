"""Growing files and streams with state, over several micro-batches and restarts, against the batch operators."""

import json

import pytest
from oracle import rows_of
from pyspark.sql import functions as F

from sparkloom.operators import runs
from sparkloom.streaming import growing, jobs, stateful

LINES = ["INFO Spawning new instance 'i1' for model 'llama'", "[BENCH] APP_PID 42", "nothing", "Instance 'i1' for model 'llama' is ready", "[BENCH] MODEL_START_READY model_id=m ts_ms=7 elapsed_ms=9"]


def test_log_events(spark):
    lines = [
        *LINES, "x [BENCH]   MARK ui_ready 12", "[BENCH] MARK ui_ready", "[BENCH] SHUTDOWN_END 5 elapsed_ms=6", "[BENCH] SHUTDOWN_END 5", "[BENCH] APP_PID x1", "Lifecycle manager started (interval=30s)",
        "Lifecycle manager started (interval=s)", "Instance 'i' for model 'm' was ready", "Spawning new instance 'i' for model 'm", "[BENCH] MODEL_START_BEGIN model_id=a=b ts_ms=1", None, "",
        "Lifecycle manager started (interval=5s) [BENCH] APP_START_MS 99",
    ]
    got = [(r["kind"], r["subject"], r["ts_ms"], r["elapsed_ms"]) for r in runs.log_events(spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)).collect()]
    assert sorted(got, key=str) == sorted(
        [("model_spawn", "llama", None, None), ("app_pid", "42", None, None), ("model_ready", "llama", None, None), ("model_start_ready", "m", 7, 9), ("mark", "ui_ready", None, None), ("shutdown_end", "5", None, 6),
         ("lifecycle", "30", None, None), ("model_start_begin", "a=b", 1, None), ("lifecycle", "5", None, None), ("app_start_ms", "99", None, None)],
        key=str,
    )


def collected(spark, stream, folder):
    query = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/check").trigger(availableNow=True).start()
    query.awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").select("file", "offset", "value").collect())


@pytest.mark.parametrize("part_bytes", ["5", "1000000"])
def test_lines_come_once_however_they_are_cut(spark, tmp_path, part_bytes):
    logs = tmp_path / "logs"
    logs.mkdir()
    text = "\n".join(["first", "", "zweite Zeile mit ü", "x" * 40, "windows\r", "last"]) + "\n"
    whole = text.encode() + b"bad \xff byte\n"
    for upto in (3, 9, 9, 27, 30, 70, len(whole) - 1, len(whole)):  # half lines, half letters, nothing new
        (logs / "a.log").write_bytes(whole[:upto])
        found = collected(spark, growing.lines(spark, str(logs), part_bytes=part_bytes, suffix=".log"), tmp_path)
        want, at = [], 0
        for line in whole[:upto].split(b"\n")[:-1]:
            want.append((str(logs / "a.log"), at, line.removesuffix(b"\r").decode("utf-8", "replace")))
            at += len(line) + 1
        assert found == want
    (logs / "b.log").write_bytes(b"new file\nhalf")
    (logs / "c.txt").write_bytes(b"other kind\n")
    found = collected(spark, growing.lines(spark, str(logs), part_bytes=part_bytes, suffix=".log"), tmp_path)
    assert [v for f, _, v in found if f.endswith("b.log")] == ["new file"] and len(found) == len(whole.split(b"\n")[:-1]) + 1


def test_only_what_is_added(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "a.log").write_text("old\nha")
    stream = growing.lines(spark, str(logs), begin="latest")
    assert collected(spark, stream, tmp_path) == []
    with (logs / "a.log").open("a") as f:
        f.write("lf\nnew\n")
    assert [v for _, _, v in collected(spark, stream, tmp_path)] == ["half", "new"]
    (logs / "a.log").write_text("again\n")  # shorter: from its start
    assert sorted(v for _, _, v in collected(spark, stream, tmp_path)) == ["again", "half", "new"]


def test_tailed_events(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    text = "\n".join(LINES) + "\n"
    kinds = []
    for upto in (20, 60, 200, len(text)):
        (logs / "app.log").write_text(text[:upto])
        query = jobs.tailed(spark, str(logs)).writeStream.format("parquet").option("path", f"{tmp_path}/events").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        query.awaitTermination()
        kinds = sorted((r["kind"], r["subject"]) for r in spark.read.parquet(f"{tmp_path}/events").collect())
    assert kinds == [("app_pid", "42"), ("model_ready", "llama"), ("model_spawn", "llama"), ("model_start_ready", "m")]


@pytest.fixture(scope="module")
def events(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").where("event_id < 2000").withColumn("ts", F.col("ts").cast("timestamp")).cache()


def in_parts(spark, events, folder, make, n=3):
    """What a stream has made after each of n parts of the events, with a restart before each."""
    out, schema = None, events.schema
    size = events.count()
    for part in range(n):
        events.where(f"event_id >= {part * size // n} and event_id < {(part + 1) * size // n}").coalesce(2 if part else 1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        out = stateful.written_through(make(stream), f"{folder}/out", f"{folder}/check")
    return out


def test_rates(spark, events, tmp_path):
    got = in_parts(spark, events, tmp_path, lambda s: stateful.rates(s, by="user_id", time="ts", counter="value", ident="event_id"))
    want = runs.rates(events.withColumn("t", F.col("ts").cast("double")), by="user_id", time="t", counter="value").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "rate")
    rounded = lambda df: df.withColumn("rate", F.round("rate", 4))
    assert rows_of(rounded(got)) == rows_of(rounded(want))


def test_pairs(spark, events, tmp_path):
    kinds = {"by": "user_id", "kind": "event_type", "opens": "click", "closes": "purchase", "at": "ts", "ident": "event_id"}
    got = in_parts(spark, events, tmp_path, lambda s: stateful.pairs(s, **kinds))
    want = runs.paired(events, **kinds).select(F.col("user_id").alias("key"), "n", "open_id", "close_id", "seconds", (F.col("close_value") - F.col("open_value")).alias("delta"))
    rounded = lambda df: df.withColumns({c: F.round(c, 3) for c in ("seconds", "delta")})
    assert rows_of(rounded(got)) == rows_of(rounded(want)) and got.count() > 20


def test_pairs_that_never_close(spark, tmp_path):
    rows = [(1, "open", 0), (2, "open", 10), (3, "close", 12), (4, "open", 100), (5, "open", 500), (6, "close", 501), (7, "close", 502)]
    t = spark.createDataFrame([(i, 2 if i == 5 else 1, k, s, 0.0) for i, k, s in rows], "event_id long, user_id long, event_type string, s long, value double").withColumn("ts", (F.col("s") + 1000).cast("timestamp"))
    for part in ([1, 2, 3], [4], [5], [6], [7]):
        t.where(F.col("event_id").isin(part)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(t.schema).parquet(f"{tmp_path}/in")
        out = stateful.written_through(stateful.pairs(stream, by="user_id", kind="event_type", opens="open", closes="close", at="ts", ident="event_id", patience=60.0), f"{tmp_path}/out", f"{tmp_path}/check")
    got = sorted((r["n"], r["open_id"], r["close_id"]) for r in out.where("key = 1").select("n", "open_id", "close_id").na.fill(0).collect())
    assert got == [(1, 1, 3), (2, 2, 0), (3, 4, 0)]


def test_token_streams(spark, tmp_path):
    def data(content=None, reasoning=None):
        return "data: " + json.dumps({"choices": [{"delta": {"content": content, "reasoning_content": reasoning}}]}, ensure_ascii=False) + "\n"

    text = data(reasoning="think") + ": comment\n\n" + data("Hel") + "data: {bad\n" + 'data: {"choices": []}\n' + data("lo ü", "more") + "data: [DONE]\n" + data("after")
    cut = [text[i : i + 7] for i in range(0, len(text), 7)]
    rows = [("a", i, p) for i, p in enumerate(cut)] + [("b", i, p) for i, p in enumerate([data("one")[:9], data("one")[9:]])]
    order = [rows[i] for i in range(len(rows)) if i % 3 == 1] + [rows[i] for i in range(len(rows)) if i % 3 == 0] + [rows[i] for i in range(len(rows)) if i % 3 == 2]
    schema = "request string, seq long, piece string, at timestamp"
    for part in range(3):
        own = spark.createDataFrame([(*r, None) for r in order[part * len(order) // 3 : (part + 1) * len(order) // 3]], schema).withColumn("at", F.lit(100 + part).cast("timestamp"))
        own.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = stateful.written_through(stateful.tokens(spark.readStream.schema(own.schema).parquet(f"{tmp_path}/in"), at="at", patience=50.0), f"{tmp_path}/out", f"{tmp_path}/check")
    got = {k: [(r["kind"], r["text"]) for r in sorted(out.where(F.col("key") == k).collect(), key=lambda r: r["n"])] for k in "ab"}
    assert got["a"] == [("reasoning", "think"), ("content", "Hel"), ("reasoning", "more"), ("content", "lo ü"), ("end", None)] and got["b"] == [("content", "one")]
    for at, row in ((500, ("c", 0, "x", None)), (501, ("b", 2, data("late"), None))):  # the watermark passes: b is lost, and what comes for it then is passed over
        late = spark.createDataFrame([row], schema).withColumn("at", F.lit(at).cast("timestamp"))
        late.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = stateful.written_through(stateful.tokens(spark.readStream.schema(late.schema).parquet(f"{tmp_path}/in"), at="at", patience=50.0), f"{tmp_path}/out", f"{tmp_path}/check")
    assert [(r["kind"], r["text"]) for r in sorted(out.where("key = 'b'").collect(), key=lambda r: r["n"])] == [("content", "one"), ("lost", None)]
    assert out.where("key = 'a'").count() == 5


def test_rates_ask_the_state_once_a_key():
    """A key's rows come in any order and in parts; where time, counter or id is null they stand last and have no rate. State is read by one request and written by one."""
    import pandas as pd

    class State:
        value, asked = None, []

        def exists(self):
            self.asked.append("exists")
            return self.value is not None

        def get(self):
            self.asked.append("get")
            return self.value

        def update(self, value):
            self.asked.append("update")
            self.value = value

    own, nan = stateful._Rates(), float("nan")
    own.last = State()
    frame = lambda *rows: pd.DataFrame(rows, columns=["t", "x", "id"])
    rows = lambda *frames: [tuple(None if pd.isna(v) else v for v in r) for f in own.handleInputRows((7,), iter(frames), None) for r in f.itertuples(index=False)]
    assert rows(frame((4.0, 9.0, 3), (1.0, 2.0, 2)), frame((1.0, 1.0, 1))) == [(7, 1, None), (7, 2, None), (7, 3, 7 / 3)]
    assert own.last.value == (4.0, 9.0) and own.last.asked == ["get", "update"]
    assert rows(frame((6.0, 5.0, 4))) == [(7, 4, -2.0)]
    assert rows(frame((nan, 8.0, 9.0), (8.0, nan, 5.0), (9.0, 3.0, nan), (9.0, 4.0, 6.0), (11.0, 5.0, 7.0))) == [(7, 5, None), (7, 6, None), (7, None, None), (7, 7, 1.0), (7, 9, None)]
    assert own.last.asked == ["get", "update"] * 3
