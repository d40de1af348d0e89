"""Media columns: what a byte column really holds, by signature sniffing.

One Aho-Corasick automaton finds the magic bytes of all known formats anywhere in a value; each find goes to its format's validator, which walks the structure and
gives the length, or turns it down. A find at the start that is valid corrects the declared type; valid ones further in are embedded media, which ``carve`` cuts out.
Parts (chunks, segments, pages, boxes) that many finds of a value have in common are walked once, so that time stays in proportion to a value's length; RIFF and gzip files
nested in one another on purpose are walked once each.

Defined cases: a null or empty value has type null and nothing embedded; a declared type of null is corrected as any other; a value of no known
format keeps its declared type; repeated rows are rows of their own; columns named otherwise aren't read.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import stored, text_bytes, widened

SAMPLE_RATE, PAYLOAD_UNIT = 8000, 64


class Found(NamedTuple):
    offset: int
    length: int
    mime: str


def _walk(memo: dict, start: object, step: Callable[[object], tuple[bool, object]]) -> object:
    """What the chain of parts from ``start`` comes to. ``step`` gives (True, what it comes to) or (False, the next part); parts in ``memo`` aren't walked again."""
    path, at = [], start
    while at not in memo:
        path.append(at)
        ended, value = step(at)
        if ended:
            memo[at] = value
        else:
            at = value
    for p in path:
        memo[p] = memo[at]
    return memo[at]


def _png(d: bytes, at: int, memo: dict) -> int | None:
    """Chunks with right checksums, IHDR first, to IEND."""

    def step(p: int) -> tuple[bool, int | None]:
        if p + 12 > len(d):
            return True, None
        n, kind = struct.unpack_from(">I4s", d, p)
        if p + 12 + n > len(d) or kind == b"IHDR" or zlib.crc32(memoryview(d)[p + 4 : p + 8 + n]) != struct.unpack_from(">I", d, p + 8 + n)[0]:
            return True, None
        return kind == b"IEND", p + 12 + n

    if d[at + 8 : at + 16] != b"\0\0\0\x0dIHDR" or at + 33 > len(d) or zlib.crc32(d[at + 12 : at + 29]) != struct.unpack_from(">I", d, at + 29)[0]:
        return None
    end = _walk(memo, at + 33, step)
    return end - at if end else None


_MARKER = re.compile(rb"\xff[^\x00\xd0-\xd7]", re.S)


def _jpeg(d: bytes, at: int, memo: dict) -> int | None:
    """Segments by their lengths, entropy-coded data to the next marker, to EOI."""
    if "markers" not in memo:
        memo["markers"] = [m.start() for m in _MARKER.finditer(d)]

    def step(state: tuple[int, bool]) -> tuple[bool, object]:
        p, scanned = state
        if p + 2 > len(d) or d[p] != 0xFF:
            return True, None
        m = d[p + 1]
        if m == 0xD9:
            return True, p + 2 if scanned else None
        if m == 0xFF:
            return False, (p + 1, scanned)
        if m < 0xC0 or p + 4 > len(d):
            return True, None
        p += 2 + struct.unpack_from(">H", d, p + 2)[0]
        if m == 0xDA:
            k = bisect_left(memo["markers"], p)
            return (True, None) if k == len(memo["markers"]) else (False, (memo["markers"][k], True))
        return False, (p, scanned)

    end = _walk(memo, (at + 2, False), step)
    return end - at if end else None


def _gif(d: bytes, at: int, memo: dict) -> int | None:
    """Colour tables and blocks to the trailer."""

    def step(state: tuple[int, bool]) -> tuple[bool, object]:
        p, inside = state
        if p >= len(d):
            return True, None
        if inside:  # data blocks
            return False, (p + d[p] + 1, True) if d[p] else (p + 1, False)
        if d[p] == 0x3B:
            return True, p + 1
        if d[p] == 0x21:
            return False, (p + 2, True)
        if d[p] == 0x2C and p + 10 <= len(d):
            return False, (p + 11 + (3 << (d[p + 9] & 7) + 1 if d[p + 9] & 128 else 0), True)
        return True, None

    if at + 13 > len(d):
        return None
    flags = d[at + 10]
    end = _walk(memo, (at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), False), step)
    return end - at if end else None


def riff_chunks(d: bytes, at: int = 0) -> dict[bytes, tuple[int, int]] | None:
    """Place and length of each chunk of a RIFF file that fills its declared size exactly, or None."""
    if at + 12 > len(d):
        return None
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    if end > len(d):
        return None
    p, found = at + 12, {}
    while p + 8 <= end:
        kind, n = struct.unpack_from("<4sI", d, p)
        if p + 8 + n > end:
            return None
        found.setdefault(kind, (p + 8, n))
        p += 8 + n + (n & 1)
    return found if p in (end, end + 1) and found else None


class _Chunks:
    """Where the chunks from every RIFF header on lead: each place has one next place, so all walks are a forest, whose places are looked at once.

    A walk passes a place if that is an ancestor of its start; of each kind the first chunk on a walk is the nearest ancestor of that kind.
    """

    KINDS = (b"fmt ", b"data", b"VP8 ", b"VP8L", b"VP8X", b"LIST")

    def __init__(self, d: bytes):
        self.onward: dict[int, int | None] = {}
        for m in re.finditer(b"RIFF", d):
            p = m.start() + 12
            while p not in self.onward:
                n = struct.unpack_from("<I", d, p + 4)[0] if p + 8 <= len(d) else len(d)
                self.onward[p] = p + 8 + n + (n & 1) if p + 8 + n <= len(d) else None
                if self.onward[p] is None:
                    break
                p = self.onward[p]
        self.before: dict[int, list[int]] = {}
        self.near: dict[bytes, dict[int, int | None]] = {kind: {} for kind in self.KINDS}
        for p in sorted(self.onward, reverse=True):
            q = self.onward[p]
            if q is not None:
                self.before.setdefault(q, []).append(p)
            for kind, near in self.near.items():
                near[p] = p if q is not None and d.startswith(kind, p) else near.get(q)
        self.first: dict[int, int] = {}
        self.last: dict[int, int] = {}
        waiting = [(p, False) for p, q in self.onward.items() if q is None]
        while waiting:
            p, done = waiting.pop()
            if done:
                self.last[p] = len(self.first)
                continue
            self.first[p] = len(self.first)
            waiting += [(p, True), *((q, False) for q in reversed(self.before.get(p, ())))]

    def passes(self, p: int, q: int) -> bool:
        return q in self.first and self.first[q] <= self.first[p] < self.last[q]

    def fills(self, d: bytes, start: int, end: int) -> bool:
        """Whether the chunks from ``start`` end at ``end``, or at the byte that fills an odd one up."""
        if start != end and self.passes(start, end):
            return True
        if start == end + 1 or not self.passes(start, end + 1):
            return False
        own = self.before[end + 1]
        last = own[bisect_right(own, self.first[start], key=self.first.__getitem__) - 1]
        return bool(struct.unpack_from("<I", d, last + 4)[0] & 1)


def _riff(d: bytes, at: int, memo: dict) -> int | None:
    """Chunks that fill the declared size; WAVE needs a sane fmt and data, WEBP and AVI their own first chunks."""
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0] if at + 12 <= len(d) else len(d) + 1
    if end > len(d):
        return None
    if "chunks" not in memo:
        memo["chunks"] = _Chunks(d)
    known = memo["chunks"]
    if not known.fills(d, at + 12, end):
        return None

    def there(kind: bytes) -> int | None:
        place = known.near[kind][at + 12]
        return place if place is not None and place < end else None

    form = d[at + 8 : at + 12]
    if form == b"WAVE":
        fmt = there(b"fmt ")
        if there(b"data") is None or fmt is None or struct.unpack_from("<I", d, fmt + 4)[0] < 16:
            return None
        _, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", d, fmt + 8)
        if not channels or not rate or align != channels * ((bits + 7) // 8):
            return None
    elif all(there(k) is None for k in ((b"VP8 ", b"VP8L", b"VP8X") if form == b"WEBP" else (b"LIST",))):
        return None
    return end - at


def _bmp(d: bytes, at: int, memo: dict) -> int | None:
    if at + 54 > len(d):
        return None
    size, spare, pixels, header, _, _, planes, bits = struct.unpack_from("<IIIIiiHH", d, at + 2)
    return size if spare == 0 and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 54 <= pixels <= size <= len(d) - at else None


def _pdf(d: bytes, at: int, memo: dict) -> int | None:
    """A version, a cross-reference and the last end mark before another file's start."""
    if not d[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    after = d.find(b"%PDF-", at + 5)
    end = d.rfind(b"%%EOF", at, after if after >= 0 else len(d))
    return end + 5 - at if end >= 0 and d.rfind(b"startxref", at, end) >= 0 else None


def _zip(d: bytes, at: int, memo: dict) -> int | None:
    """An end record whose central directory lies where it says; end records are looked up once for a value."""
    if "zips" not in memo:
        memo["zips"], p = {}, 0
        while (p := d.find(b"PK\x05\x06", p + 1)) >= 0 and p + 22 <= len(d):
            n, size, start, comment = struct.unpack_from("<HIIH", d, p + 10)
            if n and start + size <= p and p + 22 + comment <= len(d) and d[p - size : p - size + 4] == b"PK\x01\x02":
                memo["zips"].setdefault(p - size - start, p + 22 + comment)
    end = memo["zips"].get(at)
    return end - at if end else None


def _gzip(d: bytes, at: int, memo: dict) -> int | None:
    """A header, then data that inflates in bounded pieces to a right checksum and length."""

    def text_end(p: int) -> int:
        """After the next zero byte, which is looked for once for all finds before it."""
        if memo.get("zero", -1) < p:
            zero = d.find(b"\0", p)
            memo["zero"] = len(d) if zero < 0 else zero
        return memo["zero"] + 1

    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return None
    flags, p = d[at + 3], at + 10
    if flags & 4:
        p += 2 + struct.unpack_from("<H", d, p)[0]
    for flag in (8, 16):
        if flags & flag:
            p = text_end(p)
    p += 2 if flags & 2 else 0
    stream, crc, size = zlib.decompressobj(-15), 0, 0
    try:
        while not stream.eof:
            fed = stream.unconsumed_tail or d[p : p + 65_536]
            if not fed:
                return None
            if not stream.unconsumed_tail:
                p += len(fed)
            out = stream.decompress(fed, 1 << 20)
            crc, size = zlib.crc32(out, crc), size + len(out)
    except zlib.error:
        return None
    p -= len(stream.unused_data)
    return p + 8 - at if d[p : p + 8] == struct.pack("<II", crc, size & 0xFFFFFFFF) else None


def _ogg(d: bytes, at: int, memo: dict) -> int | None:
    """Pages to the one that ends the stream."""

    def step(p: int) -> tuple[bool, int | None]:
        if p + 27 > len(d) or d[p : p + 5] != b"OggS\0" or p + 27 + d[p + 26] > len(d):
            return True, None
        end = p + 27 + d[p + 26] + sum(d[p + 27 : p + 27 + d[p + 26]])
        return (True, None) if end > len(d) else (bool(d[p + 5] & 4), end)

    end = _walk(memo, at, step)
    return end - at if end else None


def _mp4(d: bytes, at: int, memo: dict) -> int | None:
    """Boxes that follow one another, a moov or moof among them."""
    path, p = [], at
    while p not in memo:
        n, kind = struct.unpack_from(">I4s", d, p) if p + 8 <= len(d) else (0, b"")
        if n == 1 and p + 16 <= len(d):
            n = struct.unpack_from(">Q", d, p + 8)[0]
        if n < 8 or p + n > len(d) or not kind.isalnum():
            memo[p] = (p, False)
        else:
            path.append((p, kind in (b"moov", b"moof")))
            p += n
    end, film = memo[p]
    for q, its_film in reversed(path):
        film = film or its_film
        memo[q] = (end, film)
    return end - at if film else None


#: Magic bytes, where they stand in the file, the type, its validator.
FORMATS: list[tuple[bytes, int, str, Callable[[bytes, int, dict], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"WAVE", 8, "audio/wav", _riff),
    (b"WEBP", 8, "image/webp", _riff),
    (b"AVI ", 8, "video/x-msvideo", _riff),
    (b"BM", 0, "image/bmp", _bmp),
    (b"%PDF-", 0, "application/pdf", _pdf),
    (b"PK\x03\x04", 0, "application/zip", _zip),
    (b"\x1f\x8b\x08", 0, "application/gzip", _gzip),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
]


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for k, (magic, _, _, _) in enumerate(FORMATS):
        found.add_word(magic.decode("latin-1"), k)
    found.make_automaton()
    return found


_MAGIC: list[ahocorasick.Automaton] = []


def find_media(data: bytes) -> list[Found]:
    """Every valid file in ``data``, in order; one inside another counts too."""
    if not _MAGIC:
        _MAGIC.append(_automaton())
    out: list[Found] = []
    memos: dict[str, dict] = {}
    for end, k in _MAGIC[0].iter(data.decode("latin-1")):
        magic, place, mime, length_at = FORMATS[k]
        at = end + 1 - len(magic) - place
        if at >= 0 and (mime not in ("audio/wav", "image/webp", "video/x-msvideo") or data[at : at + 4] == b"RIFF"):
            length = length_at(data, at, memos.setdefault(mime, {}))
            if length:
                out.append(Found(at, length, mime))
    return sorted(out)


SNIFFED = "media_type string, media_length long, corrected boolean, embedded array<struct<offset: long, length: long, type: string>>"


def sniff(media: DataFrame, *, bytes_col: str = "media", declared_col: str = "declared_type") -> DataFrame:
    """``media``, all its columns, with the found type (or the declared one), the length of the file at the start, whether the type was corrected, and what is embedded."""
    place, declared, names = media.columns.index(bytes_col), media.columns.index(declared_col), [*media.columns, "media_type", "media_length", "corrected", "embedded"]
    kinds = (pa.string(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data, said in zip(batch.column(place).to_pylist(), batch.column(declared).to_pylist(), strict=True):
                found = find_media(data) if data else []
                whole = next((f for f in found if f.offset == 0), None)
                kind = whole.mime if whole else said if data else None
                rows.append((kind, whole.length if whole else None, whole is not None and kind != said, [{"offset": f.offset, "length": f.length, "type": f.mime} for f in found if f.offset]))
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=names)

    return media.mapInArrow(run, widened(media, SNIFFED))


def carve(sniffed: DataFrame, *, bytes_col: str = "media") -> DataFrame:
    """A row for each embedded file: the other columns, offset, type, and its bytes under ``bytes_col``."""
    keep = [c for c in sniffed.columns if c not in ("embedded", bytes_col, "media_type", "media_length", "corrected")]
    rows = sniffed.select(*keep, F.col(bytes_col).alias("__whole"), F.explode("embedded").alias("__e"))
    cut = F.expr("substring(__whole, cast(__e.offset + 1 as int), cast(__e.length as int))")
    return rows.select(*keep, F.col("__e.offset").alias("offset"), F.col("__e.type").alias("media_type"), cut.alias(bytes_col))


def wav(payload: bytes, rate: int = SAMPLE_RATE) -> bytes:
    """The payload as the samples of an 8-bit, one-channel PCM file."""
    pad = b"\0" * (len(payload) & 1)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def samples(data: bytes) -> bytes:
    """The samples of a valid WAV file."""
    at, n = riff_chunks(data)[b"data"]
    return data[at : at + n]


#: What the query's own media are said to be.
DECLARED = ("audio/wav", "image/png", "application/octet-stream")


def stored_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as a written media column: doc_id, n_bytes, media (WAV; samples are the UTF-8 bytes, zero bytes up to a positive multiple of 64), declared_type (by the length, right for a third, wrong for another, unknown for the last)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            whole, sizes = data.tobytes(), np.diff(offsets)
            padded = np.maximum(-(-sizes // PAYLOAD_UNIT), 1) * PAYLOAD_UNIT
            media = [wav(whole[a : a + n].ljust(p, b"\0")) for a, n, p in zip(offsets[:-1].tolist(), sizes.tolist(), padded.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), pa.array(media, pa.binary()), pa.array([DECLARED[n % 3] for n in sizes.tolist()], pa.string())], names=["doc_id", "n_bytes", "media", "declared_type"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return stored(texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, n_bytes long, media binary, declared_type string"), "media")


def described(sniffed: DataFrame) -> DataFrame:
    """Digests and a feature of each sniffed WAV: what was found, and its samples' mean, deviation and sign changes about the mean; whether the declared type was corrected, and how many files are embedded."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "corrected", "n_embedded"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media, kind, embedded in zip(*(batch.column(c).to_pylist() for c in ("media", "media_type", "embedded")), strict=True):
                if kind != "audio/wav":
                    raise ValueError(f"stored as WAV, found {kind}")
                payload = samples(media)
                x = np.frombuffer(payload, np.uint8)
                high = x > x.mean()
                feature = f"{kind};samples={len(x)};mean={x.mean():.6f};deviation={x.std():.6f};crossings={int((high[1:] != high[:-1]).sum())};embedded={len(embedded)}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAYLOAD_UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            found = [batch.column("corrected"), pc.list_value_length(batch.column("embedded")).cast(pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True)), *found], names=names)

    return sniffed.mapInArrow(run, f"doc_id {dict(sniffed.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, corrected boolean, n_embedded long")
