"""Comparison of settings over shared folds: grids, summaries, corrected tests against a baseline."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.special import normal_sf, normal_tail, t_two_sided
from tessera.operators.association import adjust


def expand_grid(axes: Mapping[str, Sequence]) -> list[dict]:
    """All combinations in row-major order, the baseline (every axis's first value) first; ids name the varying axes."""
    varying = [k for k, v in axes.items() if len(v) > 1]
    out = []
    for values in itertools.product(*axes.values()):
        point = dict(zip(axes, values, strict=True))
        out.append({"config_id": "|".join(f"{k}={label(point[k])}" for k in varying) or "baseline", **point})
    return out


def summarize(folds: DataFrame, metric: str, settings: Sequence[str] = (), lower_is_better: bool = True) -> DataFrame:
    """Mean and deviation of the metric per setting with its rank (ties share the smallest)."""
    d = folds.groupBy("config_id").agg(*[F.first(s).alias(s) for s in settings], F.avg(metric).alias(f"{metric}_mean"), F.stddev_samp(metric).alias(f"{metric}_std"))
    best = F.col(f"{metric}_mean").asc_nulls_last() if lower_is_better else F.col(f"{metric}_mean").desc_nulls_last()
    return d.withColumn("rank", F.rank().over(Window.orderBy(best))).orderBy("rank", "config_id")


def corrected_t(folds: DataFrame, difference: str, train: str, test: str, by: Sequence[str]) -> DataFrame:
    """Mean difference, corrected resampled t and its two-sided p-value per setting."""
    d = folds.where(F.col(difference).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("j"), F.avg(difference).alias("mean_diff"), F.var_samp(difference).alias("_v"), F.avg(F.col(test) / F.col(train)).alias("_rho")
    )
    t = F.try_divide(F.col("mean_diff"), F.sqrt((1 / F.col("j") + F.col("_rho")) * F.col("_v")))
    flat = F.when(F.col("mean_diff") == 0, 0.0).otherwise(F.signum("mean_diff") * F.lit(math.inf))
    t = F.when(F.col("j") >= 2, F.when(F.col("_v") == 0, flat).otherwise(t))
    d = d.withColumn("t", t).drop("_v", "_rho")
    sure = F.when(F.col("t") == 0, 1.0).when(F.abs("t") == math.inf, 0.0)
    return d.withColumn("p_value", F.coalesce(sure, t_two_sided(F.col("t"), (F.col("j") - 1).cast("double"))))


#: Untied differences up to which a signed-rank p-value is exact, and the largest smaller rank sum of so many.
EXACT = 50
_MOST_W = EXACT * (EXACT + 1) // 4


def _exact_tail(n: Column, w: Column) -> Column:
    """Share of the signs of ranks 1 to n whose rank sum is w at most: subsets counted by sum, a rank at a time."""
    empty = F.transform(F.sequence(F.lit(0), F.lit(_MOST_W)), lambda i: F.when(i == 0, 1.0).otherwise(0.0))
    add = lambda ways, k: F.transform(ways, lambda v, i: v + F.when(i >= k, F.get(ways, i - k)).otherwise(0.0))
    ways = F.aggregate(F.sequence(F.lit(1), F.least(n, F.lit(EXACT)).cast("int")), empty, add)
    return F.aggregate(F.slice(ways, F.lit(1), F.floor(w).cast("int") + 1), F.lit(0.0), lambda a, v: a + v) / F.pow(F.lit(2.0), n.cast("double"))


def signed_rank(folds: DataFrame, difference: str, by: Sequence[str]) -> DataFrame:
    """Signed-rank test per setting: non-zero differences n, rank sum w_plus of the positive ones, two-sided p_value.

    Exact for 50 untied differences or fewer, else by the normal approximation with the correction for ties; a setting whose
    differences are all 0 or null has n = 0, w_plus = 0 and a p-value of 1. Null differences don't count.
    """
    d = folds.where(f"{difference} <> 0").select(*by, F.col(difference).alias("_d"), F.abs(difference).alias("_a"))
    sizes = d.groupBy(*by, "_a").agg(F.count(F.lit(1)).cast("double").alias("_c"), F.count_if(F.col("_d") > 0).alias("_up"))
    before = F.coalesce(F.sum("_c").over(Window.partitionBy(*by).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sizes = sizes.withColumn("_r", before + (F.col("_c") + 1) / 2)
    c, n = F.col("_c"), F.col("n")
    w = sizes.groupBy(*by).agg(F.sum("_c").cast("bigint").alias("n"), F.sum(F.col("_up") * F.col("_r")).alias("w_plus"), F.sum(c * c * c - c).alias("_ties"))
    least = F.least(F.col("w_plus"), n * (n + 1) / 2 - F.col("w_plus"))
    z = F.abs(F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(n.cast("double") * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48)
    tail = F.when((n <= EXACT) & (F.col("_ties") == 0), _exact_tail(n, least)).otherwise(normal_tail(z))
    w = w.select(*[F.col(b).alias(f"_{b}") for b in by], "n", "w_plus", F.least(F.lit(1.0), 2 * tail).alias("p_value"))
    on = [F.col(b).eqNullSafe(F.col(f"_{b}")) for b in by]
    every = folds.select(*by).distinct().join(w, on, "left")
    return every.select(*by, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("p_value", F.lit(1.0)).alias("p_value"))


def wilcoxon_w(folds: DataFrame, difference: str, by: Sequence[str]) -> DataFrame:
    """Number of non-zero differences and the sum of the ranks of the positive ones."""
    d = folds.where(f"{difference} <> 0").select(*by, F.col(difference).alias("_d"), F.abs(difference).alias("_a"))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*by, "_a"))
    d = d.withColumn("_r", F.rank().over(Window.partitionBy(*by).orderBy("_a")) + (ties - 1) / 2)
    return d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("_d") > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"))


def wilcoxon_p(differences: Sequence[float]) -> float:
    """Two-sided p-value: exact for 50 untied differences or fewer, else the normal approximation; 1 if all are 0."""
    x = np.asarray([d for d in differences if d != 0], float)
    n = len(x)
    if not n:
        return 1.0
    order = np.argsort(np.abs(x), kind="stable")
    size = np.abs(x)[order]
    _, code, count = np.unique(size, return_inverse=True, return_counts=True)
    ends = np.cumsum(count)
    ranks = (ends - (count - 1) / 2)[code]
    w = min(ranks[x[order] > 0].sum(), ranks[x[order] < 0].sum())
    if n <= 50 and (count == 1).all():
        ways = np.zeros(n * (n + 1) // 2 + 1)
        ways[0] = 1
        for k in range(1, n + 1):
            ways[k:] = ways[k:] + np.concatenate([ways[: len(ways) - k]])
        return float(min(1.0, 2 * ways[: int(w) + 1].sum() / 2.0**n))
    variance = n * (n + 1) * (2 * n + 1) / 24 - (count**3 - count).sum() / 48
    return float(min(1.0, 2 * normal_sf(abs(w - n * (n + 1) / 4) / math.sqrt(variance))))


def compare_to_baseline(folds: DataFrame, metric: str, baseline: str, lower_is_better: bool = True, method: str = "holm") -> DataFrame:
    """Every setting against the baseline on the same repeats and folds: paired differences, corrected t and signed-rank tests.

    The p-values of each test are a family, adjusted by itself.
    """
    base = folds.where(F.col("config_id") == baseline).groupBy("repeat", "fold").agg(F.avg(metric).alias("_base"))
    own = folds.where(F.col("config_id") != baseline).groupBy("config_id", "repeat", "fold").agg(
        F.avg(metric).alias("_own"), F.first("n_train").alias("n_train"), F.first("n_test").alias("n_test")
    )
    d = own.join(base, ["repeat", "fold"]).withColumn("diff", F.col("_own") - F.col("_base"))
    t = corrected_t(d, "diff", "n_train", "n_test", ["config_id"])
    better = F.col("mean_diff") < 0 if lower_is_better else F.col("mean_diff") > 0
    out = adjust(t.withColumn("better", better), "p_value", ["config_id"], method)
    ranks = signed_rank(d, "diff", ["config_id"]).select("config_id", F.col("p_value").alias("p_wilcoxon"))
    return adjust(out.join(ranks, "config_id"), "p_wilcoxon", ["config_id"], method, out="p_wilcoxon_adjusted")


def label(value) -> str:
    """A setting's value in an id: numbers in short, texts joined by +, numbers of a tuple by /."""
    if isinstance(value, (tuple, list)):
        texts = bool(value) and all(isinstance(v, str) for v in value)
        return ("+" if texts else "/").join(v if isinstance(v, str) else label(v) for v in value)
    return f"{value:g}" if isinstance(value, float) else str(value)


#: Axes of a grid in their order.
AXES = ("n_ceps", "n_mels", "delta_order", "energy_term", "frame_hop_ms", "lifter", "statistics", "reducer", "model")


def problems(axes: Mapping[str, Sequence], task: str = "regression", metric: str | None = None, normalization: str = "none", n_ceps: int = 12, n_mels: int = 23) -> list[str]:
    """What is wrong with a grid: a message per problem, none if every point can be run."""
    from tessera.operators import metrics, models
    from tessera.operators.pooling import constant_statistics

    out = [f"unknown axis {a!r}; known: {', '.join(AXES)}" for a in axes if a not in AXES]
    out += [f"model {m!r} doesn't fit {task}; choose from {', '.join(models.MODELS[task])}" for m in axes.get("model", ()) if m not in models.MODELS[task]]
    if task == "regression" and "lda" in axes.get("reducer", ()):
        out.append("the reducer lda needs classes")
    if metric is not None and metric not in metrics.METRICS[task]:
        out.append(f"metric {metric!r} doesn't fit {task}; choose from {', '.join(metrics.METRICS[task])}")
    for s in axes.get("statistics", ()):
        if fixed := constant_statistics(s, normalization):
            out.append(f"statistics {label(s)}: {', '.join(fixed)} would be the same for all after {normalization}")
    most, fewest = max(axes.get("n_ceps") or (n_ceps,)), min(axes.get("n_mels") or (n_mels,))
    if most >= fewest:
        out.append(f"n_ceps up to {most} needs more filters than n_mels down to {fewest}")
    return out


def recording_features(spark, root: str, index, store: str, base=None, delta_order: int = 2, statistics: Sequence[str] = ("mean", "std"), normalization: str = "none"):
    """``features`` for ``run``: pooled features of the recordings below ``root`` for a setting's front end, joined to ``index`` by path.

    Static frames come from the store, which computes those of a front end once for all settings, repeats and runs that share it.
    """
    from dataclasses import replace

    from pyspark.sql import functions as F

    from tessera.operators.pooling import pool
    from tessera.sources import audio, recordings

    base = base or audio.FrontEnd()
    names = {"n_ceps": "coefficients", "n_mels": "mels", "energy_term": "energy", "frame_hop_ms": None, "lifter": "lifter"}

    def features(point: Mapping):
        own = {field: point[axis] for axis, field in names.items() if field and axis in point}
        if "frame_hop_ms" in point:
            own["frame_ms"], own["hop_ms"] = point["frame_hop_ms"]
        f, order, wanted = replace(base, **own), point.get("delta_order", delta_order), point.get("statistics", statistics)
        static = audio.frame_columns(f, 0)
        frames = recordings.stored_frames(spark, root, store, f).select("path", "frame", *[F.get("v", k).alias(c) for k, c in enumerate(static)])
        columns = audio.frame_columns(f, order)
        pooled = pool(audio.with_deltas(frames, static, order), ["path"], columns, wanted, (), point.get("normalization", normalization))
        return index.join(pooled, "path"), [f"{s}_{c}" for s in wanted for c in columns]

    return features


def run(points: Sequence[Mapping], features, y: str, repeats: Sequence[str], task: str = "regression", positive=None, score: str | None = None, tune: bool = False, inner: int = 3, group: str | None = None) -> DataFrame:
    """Metrics of every setting, repeat and fold: config_id, repeat, fold, n_train, n_test and the task's metrics.

    ``features(point)`` gives a setting's table and predictor columns; all tables hold the same fold columns (``repeats``), so
    settings are compared on the same rows. Tables that settings share are made once, settings after each other, and let go
    when the next one begins; a setting's rows are written, so the result reads a few small tables.
    """
    from tessera.functions.shared import written
    from tessera.operators import metrics, models

    of = lambda point: tuple((k, label(v)) for k, v in point.items() if k not in ("config_id", "model", "reducer"))
    out, now, d, x = None, None, None, None
    for point in sorted(points, key=of):
        if of(point) != now:
            if d is not None:
                d.unpersist()
            now = of(point)
            d, x = features(point)
            d = d.persist()
        part = None
        for r, fold in enumerate(repeats):
            p = models.cross_validate(d, x, y, point.get("model", "ridge"), task, fold=fold, reducer=point.get("reducer", "none"), tune=tune, inner=inner, group=group)
            table = models.evaluated(p, y, task, fold, positive, score).where(F.col(fold).isNotNull())
            columns = [F.col(m) for m in metrics.METRICS[task] if m in table.columns]
            rows = table.select(F.lit(point["config_id"]).alias("config_id"), F.lit(r).alias("repeat"), F.col(fold).alias("fold"), "n_train", F.col("n").alias("n_test"), *columns)
            part = rows if part is None else part.unionByName(rows)
        part = written(part.coalesce(1), "ablation")
        out = part if out is None else out.unionByName(part)
    if d is not None:
        d.unpersist()
    return out
