"""Vector bin packing of token sequences by the dot-product heuristic.

Each piece of a document asks for (tokens, segments, loss-bearing tokens); each open sequence has so much of each left.
A piece goes to the open sequence that can take it whole and whose remaining room, scaled by the limits, has the largest
dot product with what the piece asks for. Documents of a full sequence or more are first cut into full sequences. When no open
sequence takes a piece and no more may be opened, the fullest is topped up with a part of it. Packing is local to a partition:
no shuffle, no state beyond ``open_sequences`` sequences; what is left over at its end is cut together into full sequences and, last,
into lengths that are powers of two, which need no padding.

Defined cases: a null text is empty (only its end id); repeated rows are documents of their own; an empty table gives no rows; other
columns aren't read; a limit below 1 is an error. ``loss_col`` (instruction data) holds how many of a document's last ids bear loss; null or none: all of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import tokens

SEQUENCE_TOKENS, MAX_SEGMENTS, OPEN_SEQUENCES = 2048, 256, 48
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


@dataclass
class Piece:
    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int
    loss_from: int  # the document's first loss-bearing id

    def __len__(self) -> int:
        return len(self.ids)

    @property
    def loss(self) -> int:
        return max(0, self.start + len(self) - max(self.start, self.loss_from))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.doc_id, self.start, self.ids[:n], self.doc_tokens, self.loss_from), Piece(self.doc_id, self.start + n, self.ids[n:], self.doc_tokens, self.loss_from)

    def fits(self, tokens_left: int, loss_left: int) -> int:
        """How many of its first ids go into that room."""
        n = min(len(self), tokens_left)
        free = max(0, min(n, self.loss_from - self.start))
        return min(n, free + loss_left)


@dataclass
class Packer:
    """Pieces in, closed sequences (lists of pieces) out."""

    limits: tuple[int, int, int]
    most_open: int
    bins: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.room = np.zeros((0, 3))

    def _drop(self, k: int) -> list[Piece]:
        self.room = np.delete(self.room, k, axis=0)
        return self.bins.pop(k)

    def _put(self, k: int, piece: Piece) -> Iterator[list[Piece]]:
        self.bins[k].append(piece)
        self.room[k] -= (len(piece), 1, piece.loss)
        if self.room[k].min() <= 0:
            yield self._drop(k)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        scale = np.array(self.limits, float)
        while n := len(piece):
            most = piece.fits(self.limits[0], self.limits[2])
            if most < n or n == self.limits[0]:  # more than one sequence can hold
                head, piece = piece.cut(most)
                yield [head]
                continue
            need = np.array((n, 1, piece.loss), float)
            can = (self.room >= need).all(axis=1)
            if can.any():
                yield from self._put(int(np.argmax(np.where(can, (self.room / scale) @ (need / scale), -1.0))), piece)
                return
            if len(self.bins) < self.most_open:
                self.bins.append([])
                self.room = np.vstack([self.room, scale])
                yield from self._put(len(self.bins) - 1, piece)
                return
            k = int(np.argmin(self.room[:, 0]))
            part = piece.fits(int(self.room[k, 0]), int(self.room[k, 2]))
            if part:
                head, piece = piece.cut(part)
                self.bins[k].append(head)
            yield self._drop(k)

    def close(self) -> Iterator[list[Piece]]:
        """What is open, cut together: full sequences, then powers of two."""
        rest = [p for b in self.bins for p in b][::-1]
        self.bins, self.room = [], np.zeros((0, 3))
        left = sum(map(len, rest))
        while rest:
            size = self.limits[0] if left >= self.limits[0] else 1 << (left.bit_length() - 1)
            out, room, loss = [], size, self.limits[2]
            while rest and room and len(out) < self.limits[1]:
                part = rest[-1].fits(room, loss)
                if not part:
                    break
                head, tail = rest.pop().cut(part)
                if len(tail):
                    rest.append(tail)
                out.append(head)
                room, loss = room - part, loss - head.loss
            left -= size - room
            yield out


def pack(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", loss_col: str | None = None, sequence_tokens: int = SEQUENCE_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss_tokens: int | None = None, open_sequences: int = OPEN_SEQUENCES, end_id: int = tokens.END_ID) -> DataFrame:
    """A row for each piece of each document; see ``SCHEMA``."""
    limits = (sequence_tokens, max_segments, sequence_tokens if max_loss_tokens is None else max_loss_tokens)
    if min(limits) < 1:
        raise ValueError("a sequence must have room for a token, a segment and a loss-bearing token")
    types = [pa.int64()] * 8
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = tokens.encoder(tokenizer).encode, Packer(limits, open_sequences)
        next_id = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []

        def ended(sequences: Iterable[list[Piece]]) -> None:
            nonlocal next_id
            for sequence in sequences:
                offset = 0
                for p in sequence:
                    rows.append((p.doc_id, p.start, len(p), tokens.crc(p.ids), p.doc_tokens, next_id, offset, p.loss))
                    offset += len(p)
                next_id += 1

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, ids, loss in zip(batch.column(0).to_pylist(), encode(batch.column(1).to_pylist()), batch.column(2).to_pylist(), strict=True):
                ids = np.append(ids, np.uint32(end_id))
                n = len(ids)
                ended(packer.add(Piece(doc_id, 0, ids, n, 0 if loss is None else n - min(max(loss, 0), n))))
                if len(rows) >= 20_000:
                    yield out()
        ended(packer.close())
        yield out()

    loss = F.col(loss_col).cast("long") if loss_col else F.lit(None).cast("long")
    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"), loss.alias("l")).mapInArrow(run, SCHEMA)
