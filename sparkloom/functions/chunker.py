"""Recursive text chunking with overlap. Sizes are bytes of UTF-8.

A text is split at the first separator (kept at the pieces' ends); pieces that are still too long are split at the next one. Pieces are then joined up to
the chunk size; each chunk after the first starts with the end of the one before.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZE, OVERLAP = 1536, 200
SEPARATORS = ("\n\n", "\n", ". ", " ")
CHUNKS = "array<struct<offset: int, text: string>>"
#: Bytes of text whose chunks are held at a time.
STEP_BYTES = 1_000_000


def _n(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode())


def pieces(text: str, separators: tuple[str, ...], size: int) -> list[str]:
    """A last piece may be empty, one without separators too long."""
    if not separators or _n(text) <= size:
        return [text]
    parts = text.split(separators[0])
    parts = [p + separators[0] for p in parts[:-1]] + parts[-1:]
    return [q for p in parts for q in (pieces(p, separators[1:], size) if _n(p) > size and len(separators) > 1 else [p])]


def overlap(text: str, most: int) -> str:
    """Its last bytes, from a whole character on."""
    data = text.encode()
    return text if len(data) <= most else data[len(data) - most :].decode(errors="ignore") if most else ""


def chunks(text: str | None, size: int = SIZE, most_overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[tuple[int, str]]:
    """(byte offset, text) of each chunk; blank ones are left out, none is trimmed."""
    out: list[tuple[int, str]] = []
    now, now_bytes, start, at = "", 0, 0, 0
    for piece in pieces(text or "", separators, size):
        n = _n(piece)
        if not now:
            start = at
        if now_bytes + n <= size:
            now, now_bytes = now + piece, now_bytes + n
        else:
            if now.strip():
                out.append((start, now))
            tail = overlap(now, most_overlap)
            kept = _n(tail)
            start = max(0, at - kept)
            now, now_bytes = tail + piece, kept + n
        at += n
    if now.strip():
        out.append((start, now))
    return out


def chunked(text: Column, size: int = SIZE, most_overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> Column:
    """The chunks of each text as an array, in Arrow batches."""

    @F.pandas_udf(CHUNKS)
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"offset": a, "text": c} for a, c in chunks(t, size, most_overlap, separators)])

    return of(text)


def _cut(batches: Iterable[pa.RecordBatch], how: dict) -> Iterator[pa.RecordBatch]:
    """(doc_id, section, metadata, part, text): a row a chunk of (doc_id, section, metadata, text); the chunks of ``STEP_BYTES`` of texts, or of one text, at a time."""
    for batch in batches:
        ends, i = np.cumsum(pc.fill_null(pc.binary_length(batch.column(3)), 0).to_numpy().astype(np.int64)), 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP_BYTES, side="right")))
            found = [[c for _, c in chunks(t, **how)] for t in batch.column(3).slice(i, j - i).to_pylist()]
            n = np.array([len(x) for x in found], np.int64)
            at, part = pa.array(np.repeat(np.arange(i, j), n)), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(part.astype(np.int32)), pa.array([c for x in found for c in x], pa.string())], names=["doc_id", "section", "metadata", "part", "text"])
            i = j


def chunk_sections(sections: DataFrame, **how) -> DataFrame:
    """Chunks of (doc_id, section, text, metadata), numbered from 0 over each document: doc_id, chunk_index, text, metadata. An overlap never leaves its section."""
    own = sections.select("doc_id", "section", "metadata", "text")
    kinds = ", ".join(f"{c} {kind}" for c, kind in own.dtypes[:3])
    found = own.mapInArrow(lambda b: _cut(b, how), f"{kinds}, part int, text string")
    order = Window.partitionBy("doc_id").orderBy("section", "part")
    return found.select("doc_id", (F.row_number().over(order) - 1).alias("chunk_index"), "text", "metadata")
