"""Vectors and samples as arrays. Sums run in array order, so results repeat."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from colloquy.functions.assignment import best_assignment

EPS = 1e-8
SAMPLES = ArrayType(DoubleType())


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + EPS)


def unit(a: Column) -> Column:
    n = norm(a)
    return F.transform(a.cast("array<double>"), lambda x: x / (n + EPS))


def rms(samples: Column) -> Column:
    s = samples.cast("array<double>")
    return F.when(F.size(s) == 0, 0.0).otherwise(F.sqrt(dot(s, s) / F.size(s)))


def normalize_rms(samples: Column, target: float = 0.05, most: float = 50.0) -> Column:
    """Scaled towards a target level by a capped gain, clipped to 0.99; silence stays."""
    gain = F.least(F.lit(most), target / F.greatest(rms(samples), F.lit(EPS)))
    return F.transform(samples.cast("array<double>"), lambda x: F.greatest(F.lit(-0.99), F.least(F.lit(0.99), x * F.when(rms(samples) < EPS, 1.0).otherwise(gain))))


def to_int16(samples: Column) -> Column:
    return F.transform(samples, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("short"))


def from_int16(samples: Column) -> Column:
    return F.transform(samples, lambda x: x.cast("double") / 32768)


def si_sdr_db(estimate: np.ndarray, reference: np.ndarray) -> float:
    n = min(len(estimate), len(reference))
    e, r = estimate[:n] - estimate[:n].mean(), reference[:n] - reference[:n].mean()
    target = (e @ r) / (r @ r + EPS) * r
    return float(10 * np.log10((target @ target + EPS) / ((e - target) @ (e - target) + EPS)))


@F.pandas_udf(DoubleType())
def si_sdr(estimate: pd.Series, reference: pd.Series) -> pd.Series:
    """Scale-invariant signal-to-distortion ratio in dB; null without samples."""
    pairs = [(np.asarray(e, float), np.asarray(r, float)) if e is not None and r is not None else (np.empty(0),) * 2 for e, r in zip(estimate, reference, strict=True)]
    return pd.Series([si_sdr_db(e, r) if min(len(e), len(r)) else None for e, r in pairs], dtype="float64")


@F.pandas_udf(SAMPLES)
def pit_si_sdr(estimates: pd.Series, references: pd.Series) -> pd.Series:
    """Scores of the references under the best assignment of estimates; a reference without one is null."""
    out = []
    for es, rs in zip(estimates, references, strict=True):
        es, rs = [np.asarray(e, float) for e in es], [np.asarray(r, float) for r in rs]
        table = np.array([[si_sdr_db(e, r) for e in es] for r in rs]).reshape(len(rs), len(es))
        out.append([float(table[i, j]) if j >= 0 else None for i, j in enumerate(best_assignment(table))])
    return pd.Series(out)


def resampled(x: np.ndarray, source: int, target: int) -> np.ndarray:
    """Polyphase resampling with a windowed sinc of 10 zero crossings."""
    ratio = Fraction(target, source)
    up, down = ratio.numerator, ratio.denominator
    if up == down or not len(x):
        return x
    wide = max(up, down)
    half = 10 * wide
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / wide) * np.kaiser(2 * half + 1, 5.0)
    taps *= up / taps.sum()
    n = -(-len(x) * up // down)
    at = np.arange(n) * down
    out = np.zeros(n)
    first = -(-(at - half) // up)
    for k in range(2 * half // up + 1):
        i = first + k
        tap = at - i * up + half
        fine = (i >= 0) & (i < len(x)) & (tap >= 0) & (tap <= 2 * half)
        out[fine] += x[i[fine]] * taps[tap[fine]]
    return out


def resample(source: int, target: int):
    """A column function from samples at one rate to samples at another."""

    @F.pandas_udf(SAMPLES)
    def run(samples: pd.Series) -> pd.Series:
        return pd.Series([None if s is None else resampled(np.asarray(s, float), source, target).tolist() for s in samples])

    return run


def trim_silence(samples: Column, rate: int, frame_us: int = 20_000, down_db: float = 40.0) -> Column:
    """(samples, trimmed_us): from the first to the last whole frame within down_db of the loudest, and the time
    cut from the start. A clip of silence, or shorter than a frame, stays as it is."""
    size = max(1, rate * frame_us // 1_000_000)
    frames = F.floor(F.size(samples) / size).cast("int")
    level = lambda i: rms(F.slice(samples, i * size + 1, F.lit(size)))
    levels = F.when(frames > 0, F.transform(F.sequence(F.lit(0), frames - 1), level)).otherwise(F.array().cast("array<double>"))
    loud = F.filter(F.transform(levels, lambda x, i: F.when(x >= F.array_max(levels) * 10 ** (-down_db / 20), i)), lambda i: i.isNotNull())
    first = F.array_min(loud) * size
    cut = F.slice(samples, first + 1, (F.array_max(loud) + 1) * size - first)
    whole = F.struct(samples.alias("samples"), F.lit(0).cast("long").alias("trimmed_us"))
    return F.when(F.coalesce(F.array_max(levels), F.lit(0.0)) <= 0, whole).otherwise(F.struct(cut.alias("samples"), F.floor(first * 1_000_000 / rate).cast("long").alias("trimmed_us")))


@F.pandas_udf(StructType([StructField(n, SAMPLES) for n in ("samples", "first", "second")] + [StructField(n, LongType()) for n in ("overlap_start", "overlap_end")]))
def mix(first: pd.Series, second: pd.Series, offset: pd.Series, snr_db: pd.Series) -> pd.DataFrame:
    """Two signals summed, the second from sample offset on at snr_db below the first, peak 0.9; and the two as
    they are in the sum, each as long as it, and the samples that both cover (null: none)."""
    rows = []
    for a, b, k, snr in zip(first, second, offset, snr_db, strict=True):
        a, b, k = np.asarray(a, float), np.asarray(b, float), int(k)
        power = lambda x: float(np.sqrt((x @ x) / max(1, len(x))))
        parts = np.zeros((2, max(len(a), k + len(b))))
        parts[0, : len(a)] = a
        parts[1, k : k + len(b)] = b * (power(a) / max(power(b), EPS)) / 10 ** (snr / 20)
        out = parts.sum(axis=0)
        peak = np.abs(out).max(initial=0.0)
        scale = 0.9 / peak if peak else 1.0
        low, high = k, min(len(a), k + len(b))
        rows.append((*(x * scale for x in (out, *parts)), low if low < high else None, high if low < high else None))
    return pd.DataFrame({n: [list(r[i]) for r in rows] for i, n in enumerate(("samples", "first", "second"))} | {n: pd.array([r[i] for r in rows], "Int64") for i, n in ((3, "overlap_start"), (4, "overlap_end"))})
