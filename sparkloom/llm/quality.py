"""Compression classifier: how much better a dictionary of good text compresses a text than one of bad text does.

Two zstandard dictionaries are trained on a bounded sample of labelled texts. A text is cut into pieces of ``piece_bytes``, so that a long text can't become its
own dictionary, and every piece is compressed with both. The difference of the two sizes, divided by a power of the text's size (between the size, by which a long text's
sure difference counts no more than a short one's chance, and its root, by which a long text is always extreme), goes through a logistic curve: a probability of the good
label. The curve is fitted on texts measured with dictionaries of the sample's
other half, each half in turn, and weighs the two labels as all labelled rows have them.

Defined cases: a null text is an empty one; an empty text has the score of no difference; with one label only, or none, every score is
the labelled share of good, or 0.5; repeated rows are rows of their own; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import text_bytes
from sparkloom.llm.sample import label_counts, labelled_sample

PER_LABEL, SAMPLE_CHARS, DICTIONARY_BYTES, PIECE_BYTES, LEVEL, GOOD_FROM = 1500, 20_000, 112 * 1024, 2_000, 3, 0.7
#: The size difference is divided by (bytes + SHORT_BYTES) ** POWER.
POWER, SHORT_BYTES = 0.8, 60


def pieces(data: bytes, size: int) -> list[bytes]:
    return [data[i : i + size] for i in range(0, len(data), size)]


def dictionary(texts: list[bytes], size: int, piece: int) -> bytes:
    """A trained dictionary, or the texts' end as it is where there's too little to train on."""
    parts = [p for t in texts for p in pieces(t, piece)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:
        return (b" " * 8 + b"".join(parts))[-size:]


class Sizes:
    """Compressed sizes of a text with the good and the bad dictionary."""

    def __init__(self, good: bytes, bad: bytes, piece: int, level: int):
        self.piece = piece
        self.by = []
        for data in (good, bad):
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=level)
            self.by.append(zstandard.ZstdCompressor(dict_data=known, level=level, write_content_size=False, write_checksum=False, write_dict_id=False))

    def of(self, data: bytes) -> tuple[int, int, int]:
        parts = pieces(data, self.piece)
        return (*(sum(len(c.compress(p)) for p in parts) for c in self.by), len(data))


def features(sizes: np.ndarray) -> np.ndarray:
    """The normalised size difference, of rows (good size, bad size, bytes)."""
    return ((sizes[:, 1] - sizes[:, 0]) / (sizes[:, 2] + SHORT_BYTES) ** POWER)[:, None]


class Logistic:
    """A ridge logistic regression of weighted rows by Newton's method."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 50):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z, self.weight = self._design(x), np.zeros(x.shape[1] + 1)
        for _ in range(rounds):
            p = self._curve(z @ self.weight)
            slope = z.T @ (weight * (p - y)) + ridge * len(y) * self.weight
            self.weight -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + (ridge * len(y) + 1e-6) * np.eye(z.shape[1]), slope)

    def _design(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))])

    @staticmethod
    def _curve(v: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(v, -30, 30)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._curve(self._design(x) @ self.weight)


class Model:
    """What scoring needs: dictionaries and curve, or a constant. ``shares``: how many labelled rows there are of each label; unset: as in the sample."""

    def __init__(self, sample: list[tuple[str, str]], shares: dict[str, int] | None = None, *, dictionary_bytes: int = DICTIONARY_BYTES, piece_bytes: int = PIECE_BYTES, level: int = LEVEL):
        by = {y: [t.encode() for label, t in sample if label == y] for y in ("1", "0")}
        self.constant = None
        if not by["1"] or not by["0"]:
            self.constant = 0.5 if not sample else float(bool(by["1"]))
            return
        trained = lambda of: (dictionary(of("1"), dictionary_bytes, piece_bytes), dictionary(of("0"), dictionary_bytes, piece_bytes), piece_bytes, level)
        sizes, truth = [], []
        for half in (0, 1):
            known = Sizes(*trained(lambda y, half=half: by[y][1 - half :: 2] or by[y]))
            for y in by:
                sizes += [known.of(t) for t in by[y][half::2]]
                truth += [float(y)] * len(by[y][half::2])
        shares = shares or {y: len(by[y]) for y in by}
        each = {float(y): shares[y] / len(by[y]) for y in by}
        weight = np.array([each[y] for y in truth])
        self.curve = Logistic(features(np.array(sizes, float)), np.array(truth), weight / weight.mean())
        self.how = trained(by.__getitem__)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_label: int = PER_LABEL, sample_chars: int = SAMPLE_CHARS, **how) -> Model:
    """``labels``: id, label (1 good, 0 bad; null rows aren't learned from). Labels are counted and ids chosen without texts."""
    labels = labels.select("id", F.col("label").cast("string").alias("label")).where("label in ('0', '1')")
    counts = label_counts(labels)
    return Model(labelled_sample(docs, labels, counts, id_col=id_col, text_col=text_col, per_label=per_label, most_chars=sample_chars), counts, **how)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", good_from: float = GOOD_FROM) -> DataFrame:
    """A row per document: doc_id, score, predicted."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        sizes = Sizes(*known.how) if known.constant is None else None
        for batch in batches:
            if sizes is None:
                scores = np.full(batch.num_rows, known.constant)
            else:
                data, offsets = text_bytes(batch.column(1))
                whole = data.tobytes()
                found = [sizes.of(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                scores = known.curve.score(features(np.array(found, float).reshape(-1, 3)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores), pa.array((scores >= good_from).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return texts.mapInArrow(run, f"doc_id {dict(texts.dtypes)['doc_id']}, score double, predicted int")
