"""Streams with state by key: counter rates, pairs of opening and closing events, token streams put together from pieces.

A key's rows of a micro-batch are handled in order of time and id; micro-batches are taken to arrive in order. State is in RocksDB, by key, and outlives a restart from the checkpoint.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_NEVER = 1 << 62


class _Rates(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "t double, x double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frames = list(rows)
        t, x, ident = (np.concatenate([f[c].to_numpy() for f in frames]) for c in ("t", "x", "id"))
        order = np.lexsort((ident, t))
        t, x, ident = t[order], x[order], ident[order]
        before = self.last.get() or (np.nan, np.nan)  # one request to the state, which has None for a new key
        dt, dx = np.diff(t, prepend=before[0]), np.diff(x, prepend=before[1])
        self.last.update((float(t[-1]), float(x[-1])))
        yield pd.DataFrame({"key": key[0], "id": ident, "rate": np.divide(dx, dt, out=np.full(len(t), np.nan), where=dt > 0)})

    def close(self) -> None:
        pass


def rates(samples: DataFrame, *, by: str, time: str, counter: str, ident: str) -> DataFrame:
    """(key, id, rate): a counter's growth a second since the row before, as ``runs.rates`` has it; null for a key's first row and where time stands still. Time and counter aren't null."""
    own = samples.select(F.col(by).cast("long").alias("key"), F.col(time).cast("double").alias("t"), F.col(counter).cast("double").alias("x"), F.col(ident).cast("long").alias("id"))
    return own.groupBy("key").transformWithStateInPandas(_Rates(), "key long, id long, rate double", "Append", "None")


class _Pairs(StatefulProcessor):
    """The queue holds opening events that wait, or closing ones; never both."""

    def __init__(self, patience: float | None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "opens boolean, at double, id long, value double")
        self.count = handle.getValueState("count", "n int")

    def _row(self, key, n: int, a: tuple | None, b: tuple | None) -> tuple:
        return (key[0], n, a[2] if a else None, b[2] if b else None, b[1] - a[1] if a and b else None, b[3] - a[3] if a and b else None)

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=["key", "n", "open_id", "close_id", "seconds", "delta"])
        return frame.astype({"open_id": "Int64", "close_id": "Int64", "seconds": "Float64", "delta": "Float64"})

    def _keep(self, queue: list[tuple], n: int) -> None:
        self.queue.put(queue) if queue else self.queue.clear()
        self.count.update((n,))
        if self.patience is not None:
            for expiry in list(self.handle.listTimers()):
                self.handle.deleteTimer(expiry)
            if queue:
                self.handle.registerTimer(int((queue[0][1] + self.patience) * 1000) + 1)

    def _known(self, key, timerValues) -> tuple[list[tuple], int, list[tuple]]:
        """The queue, the count, and rows for those whose patience has ended by the watermark, which leave the queue."""
        queue = [tuple(r) for r in self.queue.get()] if self.queue.exists() else []
        n, out = self.count.get()[0] if self.count.exists() else 0, []
        if self.patience is not None:
            until = timerValues.getCurrentWatermarkInMs() / 1000
            while queue and queue[0][1] + self.patience < until:
                n, event = n + 1, queue.pop(0)
                out.append(self._row(key, n, event if event[0] else None, None if event[0] else event))
        return queue, n, out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        queue, n, out = self._known(key, timerValues)
        own = pd.concat(list(rows)).sort_values(["at", "id"], kind="stable")
        for event in zip(own["opens"].tolist(), own["at"].tolist(), own["id"].tolist(), own["value"].tolist(), strict=True):
            if queue and queue[0][0] != event[0]:
                n, other = n + 1, queue.pop(0)
                a, b = (event, other) if event[0] else (other, event)
                if b[1] >= a[1]:
                    out.append(self._row(key, n, a, b))
            else:
                queue.append(event)
        self._keep(queue, n)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        queue, n, out = self._known(key, timerValues)
        self._keep(queue, n)
        yield self._frame(out)

    def close(self) -> None:
        pass


def pairs(events: DataFrame, *, by: str, kind: str, opens: str, closes: str, at: str, ident: str, value: str = "value", patience: float | None = None, late: str = "0 seconds") -> DataFrame:
    """(key, n, open_id, close_id, seconds, delta): the n-th opening event of a key with its n-th closing one, as ``runs.paired`` has it; pairs that close before they open count, but are dropped.

    With ``patience`` seconds, an event whose partner hasn't come by then, by the watermark (``late`` behind the latest of these events, of any key), is let go: a row without the partner.
    """
    if patience is not None:
        events = events.withWatermark(at, late)
    time = [F.col(at).alias("ts")] if patience is not None else []
    own = events.where(F.col(kind).isin(opens, closes)).select(F.col(by).cast("long").alias("key"), (F.col(kind) == opens).alias("opens"), F.col(at).cast("double").alias("at"), F.col(ident).cast("long").alias("id"), F.col(value).cast("double").alias("value"), *time)
    return own.groupBy("key").transformWithStateInPandas(_Pairs(patience), "key long, n int, open_id long, close_id long, seconds double, delta double", "Append", "None" if patience is None else "EventTime")


class _Tokens(StatefulProcessor):
    def __init__(self, patience: float | None):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "next long, n long, rest string, ended boolean, until long")
        self.early = handle.getMapState("early", "seq long", "piece string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        upto, n, rest, ended, until = self.state.get() if self.state.exists() else (0, 0, "", False, _NEVER)
        own, out = pd.concat(list(rows)), []
        if self.patience is not None and not ended and timerValues.getCurrentWatermarkInMs() > until:
            out.append((key[0], n, "lost", None))
            ended = True
        pieces = dict(zip(own["seq"].tolist(), own["piece"].tolist(), strict=True))
        while not ended:
            if upto in pieces:
                piece = pieces.pop(upto)
            elif self.early.containsKey((upto,)):
                piece = self.early.getValue((upto,))[0]
                self.early.removeKey((upto,))
            else:
                break
            upto += 1
            *lines, rest = (rest + (piece or "")).split("\n")
            for line in lines:
                found = _delta(line)
                for kind, text in found:
                    out.append((key[0], n, kind, text))
                    n += 1
                ended = any(kind == "end" for kind, _ in found)
                if ended:
                    break
        for seq, piece in pieces.items():
            if seq > upto and not ended:
                self.early.updateValue((seq,), (piece or "",))
        if ended:
            self.early.clear()
            rest = ""
        if self.patience is not None:
            for expiry in list(self.handle.listTimers()):
                self.handle.deleteTimer(expiry)
            until = int((own["at"].max() + self.patience) * 1000)
            if not ended:
                self.handle.registerTimer(until + 1)
        self.state.update((upto, n, rest, ended, until))
        yield pd.DataFrame(out, columns=["key", "n", "kind", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, n, _, ended, until = self.state.get()
        self.early.clear()
        self.state.update((upto, n, "", True, until))
        yield pd.DataFrame([] if ended else [(key[0], n, "lost", None)], columns=["key", "n", "kind", "text"])

    def close(self) -> None:
        pass


def _delta(line: str) -> list[tuple[str, str | None]]:
    """What a line of a token stream says: (reasoning, text), (content, text), the end, or nothing."""
    if not line.startswith("data:"):
        return []
    body = line[5:].strip()
    if body == "[DONE]":
        return [("end", None)]
    try:
        choices = json.loads(body).get("choices")
        delta = (choices[0].get("delta") if choices else None) or {}
        return [(kind, text) for kind, name in (("reasoning", "reasoning_content"), ("content", "content")) if isinstance(text := delta.get(name), str) and text]
    except (ValueError, AttributeError, KeyError, TypeError):
        return []


def tokens(pieces: DataFrame, *, by: str = "request", seq: str = "seq", piece: str = "piece", at: str | None = None, patience: float | None = None, late: str = "0 seconds") -> DataFrame:
    """(key, n, kind, text) of token streams that come in numbered pieces (from 0), cut anywhere: kind is content, reasoning or end.

    Pieces that come early wait for those before them; lines other than ``data:`` with JSON are passed over, and what comes after the end. With ``patience`` seconds and the time
    ``at``, a request that gets nothing for so long, by the watermark, is lost: a row of that kind, and nothing after it.
    """
    if patience is not None:
        pieces = pieces.withWatermark(at, late)
    time = [F.col(at).alias("ts"), F.col(at).cast("double").alias("at")] if patience is not None else []
    own = pieces.select(F.col(by).cast("string").alias("key"), F.col(seq).cast("long").alias("seq"), F.col(piece).alias("piece"), *time)
    return own.groupBy("key").transformWithStateInPandas(_Tokens(patience), "key string, n long, kind string, text string", "Append", "None" if patience is None else "EventTime")


def written_through(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """All that a stream has by now, through to the end, appended to Parquet; a later call with the same checkpoint goes on where this one ended. The table so far."""
    spark: SparkSession = stream.sparkSession
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)
    return spark.read.schema(stream.schema).parquet(path)
