"""Audio features: resampling, dither, pre-emphasis, log-mel spectra, WAV bytes. Signals are array<float> columns.

Spectra are made for all signals of an Arrow batch at once: their frames are one matrix, in parts of bounded size, which is windowed, transformed and multiplied by the mel filters; statistics by signal and band
are sums over its rows.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RATE, FFT, WINDOW, HOP, MELS, EMPHASIS, FLOOR = 16_000, 512, 400, 160, 128, 0.97, 5.960_464_478e-8
#: Frames that are transformed at a time.
FRAMES = 4_096


def emphasized(x: Column, coefficient: float = EMPHASIS) -> Column:
    """Each sample less a part of the one before; the first stays. In the JVM."""
    before = F.concat(F.array(F.lit(0.0)), F.slice(x, 1, F.greatest(F.size(x) - 1, F.lit(0))).cast("array<double>"))
    return F.when(F.size(x) == 0, F.array().cast("array<double>")).otherwise(F.zip_with(x, before, lambda a, b: a.cast("double") - coefficient * b))


def frames(x: Column, window: int, hop: int) -> Column:
    """Whole windows at each hop. In the JVM."""
    n = F.floor((F.size(x) - window) / hop).cast("int")
    return F.when(F.size(x) < window, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(x, i * hop + 1, F.lit(window)).cast("array<double>")))


def resampled(x: np.ndarray, have: int, want: int) -> np.ndarray:
    """Linear interpolation, ceil(n * want / have) samples."""
    if have == want or not len(x):
        return np.asarray(x, np.float32)
    at = np.arange(int(np.ceil(len(x) * want / have))) * (have / want)
    return np.interp(at, np.arange(len(x)), x).astype(np.float32)


def mel_filters(mels: int = MELS, fft: int = FFT, rate: int = RATE) -> np.ndarray:
    """Triangles between points even in mels (2595 log10(1 + f / 700)), over fractional bins."""
    to_mel, to_hz = lambda f: 2595 * np.log10(1 + f / 700), lambda m: 700 * (10 ** (m / 2595) - 1)
    points = to_hz(np.linspace(to_mel(0), to_mel(rate / 2), mels + 2)) * fft / rate
    bins = np.arange(fft // 2 + 1)
    up = (bins[None] - points[:-2, None]) / np.maximum(points[1:-1] - points[:-2], 1e-9)[:, None]
    down = (points[2:, None] - bins[None]) / np.maximum(points[2:] - points[1:-1], 1e-9)[:, None]
    return np.maximum(0, np.minimum(up, down))


#: Fixed values of the dither: the factor and step of a linear congruential generator, and which of its bits count.
DITHER_FACTOR, DITHER_STEP, DITHER_SHIFT = 6_364_136_223_846_793_005, 1, 33


def dithered(x: np.ndarray, magnitude: float) -> np.ndarray:
    """``x`` with a little noise, the same at each place in every run."""
    raw = (np.arange(len(x), dtype=np.uint64) * np.uint64(DITHER_FACTOR) + np.uint64(DITHER_STEP)) >> np.uint64(DITHER_SHIFT)
    return np.asarray(x, float) + (raw.astype(float) / 0xFFFFFFFF * 2 - 1) * magnitude


def _ends(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return offsets[:-1], np.diff(offsets)


def spectra(values: np.ndarray, offsets: np.ndarray, *, window: int, hop: int, fft: int, pad: int = 0) -> Iterator[np.ndarray]:
    """Power spectra (fft / 2 + 1 bins) of the Hann-windowed frames of signals that lie end to end, ``FRAMES`` rows at a time. A signal is mirrored at its ends by ``pad`` samples, or all but one."""
    starts, sizes = _ends(offsets)
    pads = np.minimum(pad, np.maximum(sizes - 1, 0))
    counts = frame_counts(sizes, window, hop, pad)
    signal = np.repeat(np.arange(len(sizes)), counts)
    first = (np.arange(len(signal)) - np.repeat(np.cumsum(counts) - counts, counts)) * hop - pads[signal]
    hann = np.hanning(window)
    for at in range(0, len(signal), FRAMES):
        own = signal[at : at + FRAMES]
        place = np.abs(first[at : at + FRAMES, None] + np.arange(window))
        last = sizes[own, None] - 1
        place = np.where(place > last, 2 * last - place, place)
        yield np.abs(np.fft.rfft(values[starts[own, None] + place] * hann, fft)) ** 2


def frame_counts(sizes: np.ndarray, window: int, hop: int, pad: int = 0) -> np.ndarray:
    """Whole frames of signals of some sizes."""
    padded = sizes + 2 * np.minimum(pad, np.maximum(sizes - 1, 0))
    return np.where(padded >= window, (padded - window) // hop + 1, 0)


def log_mels(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all signals' frames by mels, where each signal's begin): pre-emphasis, mirrored ends, power spectra through mel triangles, natural log."""
    starts, sizes = _ends(offsets)
    plain = np.asarray(values, float)
    x = plain - EMPHASIS * np.concatenate([[0.0], plain[:-1]])
    x[starts[sizes > 0]] = plain[starts[sizes > 0]]
    pad = (FFT - HOP) // 2
    filters = mel_filters().T
    parts = [np.log(power @ filters + FLOOR) for power in spectra(x, offsets, window=WINDOW, hop=HOP, fft=FFT, pad=pad)]
    return np.concatenate([np.zeros((0, MELS)), *parts]), np.concatenate([[0], np.cumsum(frame_counts(sizes, WINDOW, HOP, pad))])


def log_mel(x: np.ndarray) -> np.ndarray:
    """(frames, mels) of one signal."""
    return log_mels(np.asarray(x, float), np.array([0, len(x)]))[0]


def standardized(m: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Each band of each signal (whose frames begin at ``at``) to mean 0 and deviation 1."""
    at = np.array([0, len(m)]) if at is None else at
    counts = np.diff(at)
    if not len(m):
        return m
    begin, n = at[:-1][counts > 0], counts[counts > 0][:, None]
    mean = np.repeat(np.add.reduceat(m, begin, axis=0) / n, n[:, 0], axis=0)
    deviation = np.sqrt(np.add.reduceat((m - mean) ** 2, begin, axis=0) / n)
    return (m - mean) / (np.repeat(deviation, n[:, 0], axis=0) + 1e-5)


def _signals(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All samples end to end, and the offsets between them; a null has none."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _matrices(m: np.ndarray, at: np.ndarray) -> pa.Array:
    """Rows of a matrix as lists of lists, cut at ``at``."""
    rows = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * m.shape[1], pa.int32()), pa.array(np.ascontiguousarray(m).reshape(-1)))
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), rows)


@F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def mel_features(signals: pa.Array) -> pa.Array:
    m, at = log_mels(*_signals(signals))
    return _matrices(standardized(m, at), at)


def power_spectra(x: Column, window: int, hop: int, fft: int) -> Column:
    """Power spectra of a signal's whole Hann-windowed frames, as an array of arrays."""

    @F.arrow_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
    def of(signals: pa.Array) -> pa.Array:
        values, offsets = _signals(signals)
        parts = [np.zeros((0, fft // 2 + 1)), *spectra(values.astype(float), offsets, window=window, hop=hop, fft=fft)]
        return _matrices(np.concatenate(parts), np.concatenate([[0], np.cumsum(frame_counts(np.diff(offsets), window, hop))]))

    return of(x)


def wav_bytes(x: np.ndarray, rate: int = RATE) -> bytes:
    """16-bit mono; samples beyond -1..1 are clipped."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setparams((1, 2, rate, len(x), "NONE", ""))
        w.writeframes((np.clip(x, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


@F.arrow_udf(T.BinaryType())
def wav_of(signals: pa.Array) -> pa.Array:
    """Each signal as a file."""
    values, at = _signals(signals)
    return pa.array([wav_bytes(values[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary())


def wav_samples(data: bytes, rate: int = RATE) -> np.ndarray:
    """Any PCM WAV as mono at ``rate``: channels averaged, integers over their range."""
    with wave.open(io.BytesIO(data)) as w:
        width, channels, have, raw = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
    if width == 3:
        wide = np.zeros((len(raw) // 3, 4), np.uint8)
        wide[:, 1:] = np.frombuffer(raw, np.uint8).reshape(-1, 3)
        x = wide.view("<i4")[:, 0] / 2.0**31
    else:
        x = np.frombuffer(raw, {1: np.uint8, 2: "<i2", 4: "<i4"}[width]).astype(float)
        x = (x - 128) / 128 if width == 1 else x / 2.0 ** (8 * width - 1)
    return resampled(x.reshape(-1, channels).mean(axis=1), have, rate)


@F.pandas_udf(T.ArrayType(T.FloatType()))
def signal_of(files: pd.Series) -> pd.Series:
    return files.map(lambda d: wav_samples(bytes(d)))


def merged_wavs(files: list[bytes], rate: int = RATE) -> bytes:
    """One file after another."""
    return wav_bytes(np.concatenate([wav_samples(f, rate) for f in files]) if files else np.zeros(0), rate)
