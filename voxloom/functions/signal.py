"""Framed signal metrics and waveform edits, as Arrow UDFs over sample arrays.

Real clips have hundreds of thousands of samples, where higher-order functions
evaluate a lambda per sample; numpy runs the same arithmetic vectorized. Null
samples count as 0. A null array gives a null result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

SILENCE, CLIP, SPEECH = 0.01, 0.99, 0.01
PAUSE_MS, TAIL_MS = 350, 150


def samples(a) -> np.ndarray:
    return np.nan_to_num(np.asarray(a, np.float64))


def frame_rms(x: np.ndarray, frame: int, hop: int) -> np.ndarray:
    """RMS of the frames that start before ``len - frame`` (exclusive)."""
    if frame <= 0 or hop <= 0 or len(x) <= frame:
        return np.zeros(0)
    windows = np.lib.stride_tricks.sliding_window_view(x, frame)[0 : len(x) - frame : hop]
    return np.sqrt((windows * windows).mean(axis=1))


def _levels(rms: np.ndarray) -> tuple[float, float]:
    """Mean of the quietest tenth, and of the upper half."""
    s = np.sort(rms)
    return s[: max(1, len(s) // 10)].mean(), s[len(s) // 2 :].mean()


def snr_gate(x: np.ndarray, rate: int) -> float:
    """0 without frames, 100 for no noise."""
    frame = int(rate * 0.025)
    rms = frame_rms(x, frame, frame // 2)
    if not len(rms):
        return 0.0
    noise, signal = _levels(rms)
    return 100.0 if noise < 1e-10 else 20 * math.log10(signal / noise)


def snr_evaluation(x: np.ndarray, rate: int) -> float | None:
    """Noise floored at 1e-10; none without frames."""
    frame = int(rate * 0.025)
    rms = frame_rms(x, frame, frame // 2)
    if not len(rms):
        return None
    noise, signal = _levels(rms)
    return 20 * math.log10(signal / max(noise, 1e-10)) if signal > 0 else None


def snr_baseline(x: np.ndarray, rate: int) -> float | None:
    """Global RMS over the quietest tenth of the frames that don't overlap."""
    frame = int(rate * 0.025)
    rms = frame_rms(x, frame, frame)
    if not len(rms):
        return None
    whole = math.sqrt((x * x).mean())
    noise = np.sort(rms)[: max(1, len(rms) // 10)].mean()
    return 20 * math.log10(whole / max(noise, 1e-10)) if whole > 0 else None


METRIC_NAMES = ("samples", "duration_s", "rms", "peak", "snr_gate", "snr_eval", "snr_base", "silence_ratio", "clipping_ratio", "speaking_s", "frames")
_COUNTS = ("samples", "frames")
METRICS = StructType([StructField(n, IntegerType() if n in _COUNTS else DoubleType()) for n in METRIC_NAMES])


@F.pandas_udf(METRICS)
def wave_metrics(arrays: pd.Series, rates: pd.Series) -> pd.DataFrame:
    """All metrics of a waveform in one pass; all null for a null array or rate, or an empty array."""
    rows = []
    for a, r in zip(arrays, rates):
        if a is None or pd.isna(r) or r <= 0 or len(a) == 0:
            rows.append((None,) * len(METRIC_NAMES))
            continue
        x, r = samples(a), int(r)
        level = np.abs(x)
        frame = int(r * 0.025)
        rms = frame_rms(x, frame, frame // 2)
        rows.append((len(x), len(x) / r, math.sqrt((x * x).mean()), level.max(), snr_gate(x, r), snr_evaluation(x, r), snr_baseline(x, r), (level < SILENCE).mean(), (level >= CLIP).mean(), (rms > SPEECH).sum() * (frame // 2) / r, len(rms)))
    out = pd.DataFrame(rows, columns=list(METRIC_NAMES))
    return out.astype({n: "Int32" if n in _COUNTS else "float64" for n in METRIC_NAMES})


def compress_pauses(x: np.ndarray, rate: int, most_ms: int = PAUSE_MS, threshold: float = SILENCE) -> np.ndarray:
    """Keeps the first ``most_ms`` of every silent run."""
    quiet = np.abs(x) < threshold
    at = np.arange(len(x))
    begun = np.maximum.accumulate(np.where(quiet & ~np.concatenate([[False], quiet[:-1]]), at, -1)) if len(x) else at
    return x[~quiet | (at - begun < int(rate * most_ms / 1000))]


def trim_tail(x: np.ndarray, rate: int, keep_ms: int = TAIL_MS, threshold: float = SILENCE) -> np.ndarray:
    """Cuts ``keep_ms`` after the last sample that isn't silent; of an all-silent wave only that much is left."""
    loud = np.flatnonzero(np.abs(x) >= threshold)
    return x[: (loud[-1] + 1 if len(loud) else 0) + int(rate * keep_ms / 1000)]


def trim_overrun(x: np.ndarray, rate: int, expected_s: float | None) -> np.ndarray:
    """Cuts a wave more than 1.5 times as long as expected, at its quietest 25 ms within 0.5 s of 1.2 times, with a 50 ms fade."""
    if not expected_s or len(x) / rate <= 1.5 * expected_s:
        return x
    goal, frame = int(expected_s * 1.2 * rate), int(rate * 0.025)
    lo, hi = max(0, goal - rate // 2), min(len(x), goal + rate // 2)
    starts = np.arange(lo, hi - frame, max(1, frame // 2))
    level = [np.abs(x[s : s + frame]).mean() for s in starts]
    cut = starts[int(np.argmin(level))] if len(starts) else goal
    fade = int(rate * 0.05)
    out = x[: cut + fade].copy()
    fade = min(fade, len(out))
    if fade:
        out[-fade:] *= np.linspace(1, 0, fade)
    return out


def taper(x: np.ndarray, rate: int, ms: int = 400) -> np.ndarray:
    """Quadratic fade over the last ``ms``, a quarter of the wave at most."""
    n = min(int(rate * ms / 1000), len(x) // 4)
    out = x.copy()
    if n:
        out[-n:] *= np.linspace(1, 0, n) ** 2
    return out


def resample(x: np.ndarray, rate: int, to: int, taps: int = 16) -> np.ndarray:
    """Windowed-sinc resampling; equal rates change nothing."""
    if rate == to or not len(x):
        return x
    n = int(round(len(x) * to / rate))
    cutoff = min(1.0, to / rate)
    at = np.arange(n) * rate / to
    near = np.floor(at).astype(int)[:, None] + np.arange(-taps + 1, taps + 1)
    d = at[:, None] - near
    w = cutoff * np.sinc(cutoff * d) * np.cos(np.pi * d / (2 * taps)).clip(0) ** 2
    ok = (near >= 0) & (near < len(x))
    w = np.where(ok, w, 0)
    return (w * x[np.clip(near, 0, len(x) - 1)]).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-12)


def spectrogram(x: np.ndarray, size: int = 1024, overlap: int = 512) -> np.ndarray:
    """Hann-windowed power per frame and frequency; a wave shorter than a frame is padded to one."""
    x = np.pad(x, (0, max(0, size - len(x))))
    frames = np.lib.stride_tricks.sliding_window_view(x, size)[:: size - overlap]
    return np.abs(np.fft.rfft(frames * np.hanning(size), axis=1)) ** 2


def edit(fn, **kw):
    """An Arrow UDF (samples, rate) -> samples of a wave edit."""

    @F.pandas_udf(ArrayType(DoubleType()))
    def run(arrays: pd.Series, rates: pd.Series) -> pd.Series:
        return pd.Series([None if a is None or pd.isna(r) or r <= 0 else fn(samples(a), int(r), **kw) for a, r in zip(arrays, rates)])

    return run


def post_process(x: np.ndarray, rate: int) -> np.ndarray:
    """Pauses compressed, then the tail trimmed."""
    return trim_tail(compress_pauses(x, rate), rate)


def mono(channels: np.ndarray) -> np.ndarray:
    """The mean of the channels of samples by channels; one channel stays as it is."""
    x = np.asarray(channels, np.float64)
    return x if x.ndim == 1 else x.mean(axis=1)


def clamp(x: np.ndarray, rate: int = 0, bound: float = 1.0) -> np.ndarray:
    """Samples cut to [-bound, bound]."""
    return np.clip(x, -bound, bound)
