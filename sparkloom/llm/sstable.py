"""Token-id output as sorted-string-table shards: write in key order, read back, look keys up.

A shard holds blocks, a Bloom filter, a sparse index and a footer, all integers little-endian:

* block: entries of (shared key prefix, key suffix length, value bytes: one unsigned varint each, key suffix, value),
  then the crc32 of what precedes. The first entry of a block shares nothing.
* Bloom filter: ``hashes`` probes a key, double hashing of its two 32-bit halves of blake2b.
* sparse index: for each block its last key, offset and length.
* footer: see ``FOOTER``; the file ends with ``MAGIC``.

A key is the identifier's 8 bytes, big-endian with the sign bit turned, so that bytes sort as integers do; a null identifier's key is
empty and sorts before all. A value is the document's ids, 2 bytes each while ids stay under 65,536 (else 4), as the footer says.

Repeated identifiers stand next to each other, in the order of their rows' texts' hashes; a lookup returns each. Documents with a null identifier stand
first and are read back as such; a lookup has no null keys. A null text is an empty one and has only the end id.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import tokens
from sparkloom.llm.common import parallelism

MAGIC = b"LOOMSST1"
FOOTER = struct.Struct("<QQQQQQQHHI8s")  # index at, bytes; Bloom at, bytes; documents; ids; blocks; id bytes; hashes; spare; magic
BLOCK_BYTES = 64 * 1024
BLOOM_BITS_A_KEY, BLOOM_HASHES = 10, 7
MANIFEST = "shard int, path string, n_docs long, n_tokens long, first_id long, last_id long"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that executors can reach, and the path in it."""
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, hashes: int, bits: int) -> list[int]:
    a, b = struct.unpack("<II", hashlib.blake2b(key, digest_size=8).digest())
    return [(a + i * (b | 1)) % bits for i in range(hashes)]


class Writer:
    """Entries in key order to one shard; holds a block, the index and the keys' hashes, not the values."""

    def __init__(self, out, id_bytes: int):
        self.out, self.id_bytes, self.at = out, id_bytes, 0
        self.block, self.last, self.index, self.keys, self.n_ids = bytearray(), b"", [], [], 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        value = ids.astype(f"<u{self.id_bytes}").tobytes()
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n_ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._end_block()

    def _end_block(self) -> None:
        if self.block:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.index.append((self.last, self.at, len(data)))
            self.out.write(data)
            self.at += len(data)
            self.block = bytearray()

    def close(self) -> None:
        self._end_block()
        bits = max(64, -(-len(self.keys) * BLOOM_BITS_A_KEY // 8) * 8)
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[_probes(key, BLOOM_HASHES, bits)] = True
        bloom_data = np.packbits(bloom, bitorder="little").tobytes()
        index_data = b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        bloom_at, index_at = self.at, self.at + len(bloom_data)
        self.out.write(bloom_data + index_data)
        self.out.write(FOOTER.pack(index_at, len(index_data), bloom_at, len(bloom_data), len(self.keys), self.n_ids, len(self.index), self.id_bytes, BLOOM_HASHES, 0, MAGIC))
        self.out.close()


class Reader:
    """A shard opened by its footer; blocks are read one at a time."""

    def __init__(self, uri: str):
        system, path = open_fs(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        (index_at, index_n, self.bloom_at, self.bloom_n, self.n_docs, self.n_ids, _, self.id_bytes, self.hashes, _, magic) = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a shard: {uri}")
        data, at, self.index = self.file.read_at(index_n, index_at), 0, []
        while at < len(data):
            (n,) = struct.unpack_from("<H", data, at)
            self.index.append((data[at + 2 : at + 2 + n], *struct.unpack_from("<QQ", data, at + 2 + n)))
            at += 18 + n
        self.bloom = None

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, at, n = self.index[k]
        data = self.file.read_at(n, at)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("damaged block")
        at, key = 0, b""
        while at < n - 4:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{self.id_bytes}", size // self.id_bytes, at)
            at += size

    def scan(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            for key, ids in self.block(k):
                yield id_of(key), ids

    def may_hold(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = self.file.read_at(self.bloom_n, self.bloom_at)
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.hashes, self.bloom_n * 8))

    def get(self, doc_id: int) -> list[np.ndarray]:
        """The ids of each document stored under ``doc_id``: Bloom filter, then binary search for the first block that may hold it."""
        key, found = key_of(doc_id), []
        if not self.may_hold(key):
            return found
        for k in range(bisect_left(self.index, key, key=lambda x: x[0]), len(self.index)):
            for have, ids in self.block(k):
                if have > key:
                    return found
                if have == key:
                    found.append(ids)
        return found

    def close(self) -> None:
        self.file.close()


class Shards(NamedTuple):
    """A written table: one row a shard (``MANIFEST``), in key order."""

    spark: SparkSession
    rows: list

    def manifest(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, MANIFEST)


def write(docs: DataFrame, out: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = tokens.END_ID) -> Shards:
    """Range-partition ``docs`` by identifier, then encode and write one shard a partition under ``out``.

    Each attempt of a task writes a file of its own name, and the row that it returns says which; so a repeated task is harmless. The driver gets a row a
    shard and removes what other attempts left behind.
    """
    spark = docs.sparkSession

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        known = tokens.encoder(tokenizer)
        id_bytes = 2 if max(known.whole.get_vocab_size(with_added_tokens=True), end_id + 1) <= 1 << 16 else 4
        system, folder = open_fs(out)
        name = f"shard-{shard:05d}-{uuid.uuid4().hex}.sst"
        writer = first = last = None
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), known.encode(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    system.create_dir(folder, recursive=True)
                    writer, first = Writer(system.open_output_stream(f"{folder}/{name}"), id_bytes), doc_id
                writer.add(key_of(doc_id), np.append(ids, np.uint32(end_id)))
                last = doc_id
        if writer is not None:
            writer.close()
            row = [shard, f"{out}/{name}", len(writer.keys), writer.n_ids, first, last]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.string(), *[pa.int64()] * 4), strict=True)], names=["shard", "path", "n_docs", "n_tokens", "first_id", "last_id"])

    placed = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    placed = placed.repartitionByRange(parallelism(spark), "k").sortWithinPartitions("k", F.xxhash64("t"))
    rows = sorted(placed.mapInArrow(run, MANIFEST).collect(), key=lambda r: r["shard"])
    system, folder = open_fs(out)
    names = {r["path"].rsplit("/", 1)[1] for r in rows}
    for left in system.get_file_info(pafs.FileSelector(folder, allow_not_found=True)):
        if left.base_name.startswith("shard-") and left.base_name not in names:
            system.delete_file(left.path)
    return Shards(spark, rows)


def read(shards: Shards) -> DataFrame:
    """Every document of every shard, read from the files: doc_id, start (ids before it), n_tokens, ids_crc32, shard."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, shard int"
    rows, before = [], 0
    for r in shards.rows:
        rows.append((r["shard"], r["path"], before))
        before += r["n_tokens"]
    if not rows:
        return shards.spark.createDataFrame([], schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, path, start in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                reader = Reader(path)
                for k in range(len(reader.index)):
                    out = []
                    for key, ids in reader.block(k):
                        out.append((id_of(key), start, len(ids), tokens.crc(ids), shard))
                        start += len(ids)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 4, pa.int32()), strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])
                reader.close()

    return shards.spark.createDataFrame(rows, "shard int, path string, start long").repartition(len(rows)).mapInArrow(run, schema)


def lookup(shards: Shards, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """The ids (array<long>) of each of ``keys`` that is stored, one row for each stored document; keys are grouped by shard first."""
    schema = "doc_id long, ids array<long>"
    if not shards.rows:
        return shards.spark.createDataFrame([], schema)
    stored = [r for r in shards.rows if r["last_id"] is not None]
    paths, lasts = [r["path"] for r in stored], [r["last_id"] for r in stored]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, reader = -1, None
        for batch in batches:
            found = []
            for doc_id in batch.column(0).to_pylist():
                k = bisect_left(lasts, doc_id)
                if k == len(paths):
                    continue
                if k != shard:
                    shard, reader = k, Reader(paths[k])
                found += [(doc_id, ids.tolist()) for ids in reader.get(doc_id)]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))], names=["doc_id", "ids"])

    want = keys.select(F.col(key_col).cast("long").alias("k")).where("k is not null").distinct()
    return want.repartitionByRange(parallelism(shards.spark), "k").sortWithinPartitions("k").mapInArrow(run, schema)
