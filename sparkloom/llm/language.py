"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1; for each bit a binary n-gram classifier tells the languages of +1 from those of -1: the mean, over a text's byte 2- and
3-grams, of the log ratio of their frequencies on both sides, set to a common scale by a logistic fit. Decoding takes the codeword of the smallest
logistic loss, each bit weighted for each language by how often it was right on that language's training texts. Where the two nearest codewords
are close, the answer is flagged as ambiguous.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled row everything is; with one language it has all texts
with letters, score 1; repeated rows are rows of their own; other columns aren't read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import widened
from sparkloom.llm.sample import label_counts, labelled_sample

PER_LANGUAGE, SAMPLE_CHARS = 400, 20_000
UNKNOWN = "und"
#: Characters that are taken apart at a time.
STEP_CHARS = 400_000
_CELLS = 1 << 17
_LETTER = re.compile(r"[^\W\d_]")
_BLANK = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else 32 for b in range(256))
#: Languages up to which all columns are used; beyond, random ones.
_EXHAUSTIVE = 6


def code(k: int, seed: int = 3) -> np.ndarray:
    """k codewords: every split of the languages into two sides for few of them, else the best of random codes of about 10 log2(k) bits."""
    if k <= _EXHAUSTIVE:
        n = max(2 ** (k - 1) - 1, 0)
        return np.array([[1 if i == k - 1 or not (b + 1) >> i & 1 else -1 for b in range(n)] for i in range(k)], np.int8).reshape(k, n)
    random, best, far = np.random.default_rng(seed), None, -1
    for _ in range(50):
        words = random.choice(np.array([-1, 1], np.int8), (k, math.ceil(10 * math.log2(k))))
        words = words[:, (words.min(axis=0) < 0) & (words.max(axis=0) > 0)]
        apart = (words.shape[1] - words.astype(int) @ words.T.astype(int) + 2 * words.shape[1] * np.eye(k, dtype=int)).min()
        if apart > far:
            best, far = words, apart
    return best


def letters(text: str | None) -> bytes:
    """Lower-cased words between single spaces, in UTF-8."""
    return b" ".join([b"", *(text or "").lower().encode().translate(_BLANK).split(), b""])


def grams(data: np.ndarray) -> np.ndarray:
    """Cells of all byte 2-grams, then of all 3-grams, that end at each byte from the third."""
    wide = data.astype(np.uint32)
    two = wide[1:-1] << np.uint32(8) | wide[2:]
    three = wide[:-2] << np.uint32(16) | two
    return np.concatenate([two * np.uint32(2654435761) >> np.uint32(15), (three | np.uint32(1 << 24)) * np.uint32(2654435761) >> np.uint32(15)])


class Model:
    """Languages, their codewords, and each bit's weight of each n-gram cell."""

    def __init__(self, sample: list[tuple[str, str]]):
        sample = [(lang, letters(t)) for lang, t in sample if _LETTER.search(t)]
        self.languages = sorted({lang for lang, _ in sample})
        self.code = code(len(self.languages))
        if len(self.languages) < 2:
            return
        cells = [(self.languages.index(lang), grams(np.frombuffer(t, np.uint8))) for lang, t in sample if len(t) > 2]
        share, texts = np.zeros((len(self.languages), _CELLS)), np.zeros(len(self.languages))
        for k, c in cells:
            share[k] += np.bincount(c, minlength=_CELLS) / len(c)
            texts[k] += 1
        share /= texts[:, None]
        floor = 1e-7
        self.weights = np.stack([np.log((share[bit > 0].mean(axis=0) + floor) / (share[bit < 0].mean(axis=0) + floor)) for bit in self.code.T], axis=1).astype(np.float32)
        margins, truth = np.stack([self.weights[c].mean(axis=0) for _, c in cells]), np.array([k for k, _ in cells])
        wanted = self.code[truth]
        self.scale, self.shift = np.ones(self.code.shape[1]), np.zeros(self.code.shape[1])
        for b in range(self.code.shape[1]):
            self.scale[b], self.shift[b] = self._fit(margins[:, b], wanted[:, b] > 0)
        right = np.sign(margins * self.scale + self.shift) == wanted
        self.trust = np.stack([right[truth == k].mean(axis=0) + 1e-3 for k in range(len(self.languages))])
        self.trust /= self.trust.sum(axis=1, keepdims=True)

    @staticmethod
    def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> tuple[float, float]:
        """Scale and shift that bring margins to log odds."""
        unit = np.abs(x).mean() + 1e-9
        z, w = np.column_stack([x / unit, np.ones(len(x))]), np.zeros(2)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * len(x) * np.eye(2), z.T @ (p - y) + ridge * len(x) * w)
        return w[0] / unit, w[1]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest language, its score, and how far ahead of the second it is, of rows of margins."""
        odds = margins * self.scale + self.shift
        loss = np.einsum("kb,nkb->nk", self.trust, np.logaddexp(0, -self.code[None] * odds[:, None, :]))
        near = np.exp(-self.code.shape[1] * (loss - loss.min(axis=1, keepdims=True)))
        near /= near.sum(axis=1, keepdims=True)
        top = np.sort(near, axis=1)
        return near.argmax(axis=1), top[:, -1], top[:, -1] - top[:, -2]


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS) -> Model:
    """``labels``: id, label (the language; null rows aren't learned from). Languages are counted and ids chosen without texts."""
    labels = labels.select("id", F.col("label").cast("string").alias("label"))
    return Model(labelled_sample(docs, labels, label_counts(labels), id_col=id_col, text_col=text_col, per_label=per_language, most_chars=sample_chars))


def _answers(texts: list[str | None], model: Model, ambiguous_within: float) -> tuple[list, list, list]:
    """Languages, scores and flags of texts, of which no more than ``STEP_CHARS`` characters (or one text) are taken apart at a time."""
    whole: tuple[list, list, list] = ([], [], [])
    step: list[str | None] = []
    size = 0
    for text in texts:
        if step and size + len(text or "") > STEP_CHARS:
            for out, part in zip(whole, _step(step, model, ambiguous_within), strict=True):
                out += part
            step, size = [], 0
        step.append(text)
        size += len(text or "")
    for out, part in zip(whole, _step(step, model, ambiguous_within), strict=True):
        out += part
    return whole


def _step(texts: list[str | None], model: Model, ambiguous_within: float) -> tuple[list, list, list]:
    lettered = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
    named, scores, close = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
    if not model.languages:
        return named, scores, close
    if len(model.languages) == 1:
        for k in lettered:
            named[k], scores[k], close[k] = model.languages[0], 1.0, False
        return named, scores, close
    if not lettered:
        return named, scores, close
    plain = [letters(texts[k]) for k in lettered]
    length = np.array([len(p) for p in plain]) - 2
    first = np.concatenate([[0], np.cumsum(length + 2)[:-1]]).astype(np.int64)
    cells = grams(np.frombuffer(b"".join(plain), np.uint8))
    half = len(cells) // 2
    # A gram belongs to the text that it begins in; those that run over into the next are left out.
    known = model.weights[cells[:half]]
    known += model.weights[cells[half:]]
    for over in (first[1:] - 2, first[1:] - 1):
        known[over[(over >= 0) & (over < half)]] = 0
    have = np.flatnonzero(length > 0)
    margins = np.zeros((len(lettered), model.code.shape[1]))
    margins[have] = np.add.reduceat(known, first[have], axis=0, dtype=np.float64) / (2 * length[have])[:, None]
    best, score, lead = model.decode(margins)
    for k, b, s, a in zip(lettered, best.tolist(), score.tolist(), lead.tolist(), strict=True):
        named[k], scores[k], close[k] = model.languages[b], s, a < ambiguous_within
    return named, scores, close


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", ambiguous_within: float = 0.1) -> DataFrame:
    """``docs``, all its columns, with lang_pred, lang_score and lang_ambiguous."""
    place, shared = docs.columns.index(text_col), docs.sparkSession.sparkContext.broadcast(model)
    names = [*docs.columns, "lang_pred", "lang_score", "lang_ambiguous"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named, scores, close = _answers(batch.column(place).to_pylist(), shared.value, ambiguous_within)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(named, pa.string()), pa.array(scores, pa.float64()), pa.array(close, pa.bool_())], names=names)

    return docs.mapInArrow(run, widened(docs, "lang_pred string, lang_score double, lang_ambiguous boolean"))
