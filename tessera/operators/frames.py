"""Ordered sequences: deltas over frames, and framing and spectra of arrays, as column expressions."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import halo

WINDOWS = ("hamming_symmetric", "hamming", "hann", "rectangular")


def frame_sizes(rate: int, frame_ms: float = 30.0, hop_ms: float = 15.0) -> tuple[int, int, int]:
    """Frame and hop in samples, and the power of two that holds a frame."""
    frame, hop = (math.floor(ms * rate / 1000 + 1e-9) for ms in (frame_ms, hop_ms))
    if frame < 2 or hop < 1:
        raise ValueError("a frame needs two samples and a hop one")
    return frame, hop, 1 << (frame - 1).bit_length()


def window_weights(name: str, n: int) -> list[float]:
    """Weights of an analysis window."""
    if name == "rectangular":
        return [1.0] * n
    if name not in WINDOWS:
        raise ValueError(f"window must be one of {', '.join(WINDOWS)}, got {name!r}")
    a, b = (0.5, 0.5) if name == "hann" else (0.54, 0.46)
    below = n - 1 if name == "hamming_symmetric" else n
    return [a - b * math.cos(2 * math.pi * k / below) for k in range(n)]


def lifter_weights(count: int, lifter: int) -> list[float]:
    """Sinusoidal lifter for coefficients 1..count; all ones without one."""
    return [1 + lifter / 2 * math.sin(math.pi * m / lifter) if lifter else 1.0 for m in range(1, count + 1)]


def mel(f: float) -> float:
    return 1127 * math.log(1 + f / 700)


def mel_edges(count: int, low: float, high: float) -> list[float]:
    """Edges in Hz of ``count`` triangles, equally spaced on the mel scale."""
    a, b = mel(low), mel(high)
    return [700 * (math.exp((a + (b - a) * k / (count + 1)) / 1127) - 1) for k in range(count + 2)]


def mel_matrix(count: int, n_fft: int, rate: int, low: float, high: float) -> list[list[float]]:
    """Triangles of unit peak over the bins of a power spectrum."""
    e = mel_edges(count, low, high)
    bins = [k * rate / n_fft for k in range(n_fft // 2 + 1)]
    return [[max(0.0, min((f - e[m]) / (e[m + 1] - e[m]), (e[m + 2] - f) / (e[m + 2] - e[m + 1]))) for f in bins] for m in range(count)]


def dct_matrix(count: int, n: int) -> list[list[float]]:
    """Rows 0..count-1 of the DCT-II with the factor sqrt(2/n)."""
    return [[math.sqrt(2 / n) * math.cos(math.pi * m * (k + 0.5) / n) for k in range(n)] for m in range(count)]


def weights(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def pre_emphasis(signal: Column, factor: float = 0.97) -> Column:
    """y[0] = x[0], y[n] = x[n] - factor * x[n-1] over the whole signal."""
    return F.transform(signal, lambda x, i: F.when(i == 0, x.cast("double")).otherwise(x - F.lit(factor) * F.get(signal, i - 1)))


def frames_of(signal: Column, length: int, hop: int) -> Column:
    """Array of the frames that fit whole; none if the signal is shorter than one."""
    n = F.floor((F.size(signal) - length) / hop).cast("int")
    cut = lambda k: F.slice(signal, k * hop + 1, length)
    return F.when(F.size(signal) >= length, F.transform(F.sequence(F.lit(0), n), cut)).otherwise(F.slice(F.array(signal), 1, 0))


def log_energy(frame: Column, floor: float = 1e-10) -> Column:
    return F.ln(F.greatest(F.aggregate(frame, F.lit(0.0), lambda s, x: s + x.cast("double") * x), F.lit(floor)))


def power_spectrum(frame: Column, n_fft: int, length: int | None = None) -> Column:
    """|DFT|^2 at bins 0..n_fft/2 of a frame padded with zeros; ``length`` is its number of samples (n_fft without).

    The cosines and sines are constants of the plan; see ``audio.cepstra`` for a transform of long frames.
    """
    turn, n = 2 * math.pi / n_fft, length or n_fft
    waves = [[[f(turn * k * i) for i in range(n)] for f in (math.cos, math.sin)] for k in range(n_fft // 2 + 1)]
    table = F.from_json(F.lit(json.dumps(waves)), "array<array<array<double>>>")  # folded to one constant
    part = lambda w, k: F.pow(dot(frame, F.get(w, F.lit(k))), F.lit(2.0))
    return F.transform(table, lambda w: part(w, 0) + part(w, 1))


def deltas(frames: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], half: int = 3, prefix: str = "d_", rows: int = halo.RANGE_ROWS) -> DataFrame:
    """Adds regression deltas over ``half`` frames to each side; the first and the last frame are repeated past the ends.

    An entity of any length is cut into ranges of about ``rows`` frames with a halo of ``half`` frames on each side.
    """
    d = halo.with_halo(frames, keys, order, columns, half, half, rows)
    w = Window.partitionBy(*keys, halo.RANGE).orderBy(*order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    below = 2 * sum(n * n for n in range(1, half + 1))
    made = {}
    for c in columns:  # where a range has no frame so far ahead or back, the entity has none: its first or last one is in range
        steps = [
            n * (F.coalesce(F.lead(c, n).over(w), F.last(c).over(whole)) - F.coalesce(F.lag(c, n).over(w), F.first(c).over(whole))) for n in range(1, half + 1)
        ]
        made[f"{prefix}{c}"] = sum(steps[1:], steps[0]) / F.lit(float(below))
    return d.withColumns(made).where(~F.col(halo.HALO)).drop(halo.RANGE, halo.HALO)
