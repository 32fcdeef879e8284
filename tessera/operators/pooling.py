"""Grouped statistics of frame columns: one row per entity, columns named ``<statistic>_<column>``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import quantiles
from tessera.functions.shared import same
from tessera.functions.stats import constant

STATISTICS = ("mean", "std", "min", "max", "skew", "kurtosis")
NORMALIZATIONS = ("none", "cmn", "cmvn")


def _statistic(name: str, c: str) -> Column:
    x = F.col(c)
    spread = lambda value: F.when(constant(x), 0.0).otherwise(value)
    return {
        "mean": lambda: F.avg(x),
        "std": lambda: spread(F.stddev_pop(x)),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
        "skew": lambda: spread(F.coalesce(F.skewness(x), F.lit(0.0))),  # a constant column has none: 0 by definition
        "kurtosis": lambda: spread(F.coalesce(F.kurtosis(x), F.lit(0.0))),
    }[name]()


def percent_label(q: float) -> str:
    return f"p{q:g}"


def constant_statistics(statistics: Sequence[str], normalization: str) -> list[str]:
    """Statistics that are the same number for every entity after a normalisation."""
    return [s for s in statistics if (normalization in ("cmn", "cmvn") and s == "mean") or (normalization == "cmvn" and s == "std")]


def normalize(frames: DataFrame, keys: Sequence[str], columns: Sequence[str], how: str = "cmn") -> DataFrame:
    """Removes each entity's mean (cmn), and scales by its population deviation (cmvn; a constant column stays 0).

    An aggregate and a join, which Spark splits where an entity is large; no entity is one task.
    """
    if how not in NORMALIZATIONS:
        raise ValueError(f"normalization must be one of {', '.join(NORMALIZATIONS)}, got {how!r}")
    if how == "none":
        return frames
    sizes = frames.groupBy(*keys).agg(*[f(c).alias(f"_{n}{i}") for i, c in enumerate(columns) for n, f in (("mean", F.avg), ("sd", lambda c: _statistic("std", c)))])
    sizes = sizes.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], *[f"_{n}{i}" for i in range(len(columns)) for n in ("mean", "sd")])
    made = {}
    for i, c in enumerate(columns):
        x = F.col(c) - F.col(f"_mean{i}")
        made[c] = x if how == "cmn" else F.coalesce(F.try_divide(x, F.col(f"_sd{i}")), x)
    return frames.join(sizes, same(keys, [f"_key{i}" for i in range(len(keys))])).withColumns(made).select(*frames.columns)


def pool(
    frames: DataFrame, keys: Sequence[str], columns: Sequence[str], statistics: Sequence[str] = STATISTICS, percentiles: Sequence[float] = (), normalization: str = "none", accuracy: int | None = None,
    held: int = quantiles.HELD,
) -> DataFrame:
    """A row per entity: every statistic of every column, statistic-major; percentiles interpolate linearly.

    Statistics take one pass. Percentiles are exact for entities of any size: those of more than ``held`` rows by refining
    histograms. With ``accuracy`` they are values whose rank is off by a 1/accuracy of the entity's rows at most, from sketches.
    """
    if fixed := constant_statistics(statistics, normalization):
        raise ValueError(f"{', '.join(fixed)} is the same for every entity after {normalization}")
    frames = normalize(frames, keys, columns, normalization)
    label = lambda c, q: f"{percent_label(q)}_{c}"
    made = [_statistic(s, c).alias(f"{s}_{c}") for s in statistics for c in columns]
    if accuracy:
        made += [F.percentile_approx(c, F.lit(q / 100), F.lit(accuracy)).alias(label(c, q)) for q in percentiles for c in columns]
    if accuracy or not percentiles:
        return frames.groupBy(*keys).agg(*made)
    exact = quantiles.percentiles(frames, keys, columns, percentiles, label, held)
    if not made:
        return exact
    names = [f"_q{i}" for i in range(len(keys))]
    exact = exact.withColumnsRenamed(dict(zip(keys, names, strict=True)))
    return frames.groupBy(*keys).agg(*made).join(exact, same(keys, names)).drop(*names)
