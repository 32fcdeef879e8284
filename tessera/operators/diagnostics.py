"""Residual, influence and collinearity diagnostics of least-squares fits."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import halo, ranks
from tessera.functions.special import chi2_sf, normal_quantile, normal_sf, normal_tail
from tessera.functions.stats import ratio
from tessera.operators.linear import LeastSquares, Moments, fit_ols


def jarque_bera(x: Column | str) -> tuple[Column, Column]:
    """Statistic and p-value as aggregates; NULL for a constant column."""
    n = F.count(x)
    jb = n / 6 * (F.pow(F.skewness(x), F.lit(2.0)) + F.pow(F.kurtosis(x), F.lit(2.0)) / 4)
    return jb, F.exp(-jb / 2)


def durbin_watson(df: DataFrame, residual: str, order: Sequence[str], by: Sequence[str], rows: int = halo.RANGE_ROWS) -> DataFrame:
    """Per group, over the stated order of rows; NULL where all residuals are 0. A group of any length is cut into ranges."""
    d = halo.with_halo(df.select(*by, *[c for c in order if c not in by], F.col(residual).alias("_e")), by, order, ["_e"], 1, 0, rows)
    step = F.col("_e") - F.lag("_e").over(Window.partitionBy(*by, halo.RANGE).orderBy(*order))
    d = d.withColumn("_step", step).where(~F.col(halo.HALO))
    return d.groupBy(*by).agg(ratio(F.sum(F.col("_step") * F.col("_step")), F.sum(F.col("_e") * F.col("_e"))).alias("durbin_watson"))


def influence(df: DataFrame, fit: LeastSquares, y: str) -> DataFrame:
    """Adds fitted, residual, leverage, studentized residual and Cook's distance to every row."""
    n, p = fit.stats["n"], fit.stats["p"]
    s2 = F.lit(fit.stats["sigma2"] if n > p else None).cast("double")
    d = df.withColumns({"fitted": fit.predicted(), "leverage": fit.leverage()}).withColumn("residual", F.col(y) - F.col("fitted"))
    e, h = F.col("residual"), F.col("leverage")
    cooks = ratio(e * e, p * s2) * ratio(h, F.pow(1 - h, F.lit(2.0)))
    return d.withColumns({"studentized": ratio(e, F.sqrt(F.greatest(s2 * (1 - h), F.lit(0.0)))), "cooks": cooks})


def normal_scores(df: DataFrame, residual: str, tiebreak: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Adds the normal quantile of every residual's rank in its group; ranks are numbered by ranges."""
    d = ranks.numbered(df, [residual, *tiebreak], list(by), ranks.numeric_range(df, residual))
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).select(*[F.col(b).alias(f"_g{k}") for k, b in enumerate(by)], "_n")
    same = F.lit(True)
    for k, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_g{k}"))
    score = normal_quantile((F.col("_number") + 1 - 0.375) / (F.col("_n") + 0.25))
    return d.join(sizes, same).withColumn("normal_quantile", score).drop("_number", "_n", *[f"_g{k}" for k in range(len(by))])


def breusch_pagan(df: DataFrame, fit: LeastSquares, y: str) -> tuple[float, float]:
    """Koenker's n R^2 of the squared residuals on the predictors, and its p-value."""
    square = df.withColumn("_e2", F.pow(F.col(y) - fit.predicted(), F.lit(2.0)))
    second = fit_ols(square, fit.terms[1:], "_e2")
    lm = float(second.stats["n"] * second.stats["r2"])
    return lm, float(chi2_sf(lm, len(fit.terms) - 1))


def variance_inflation(m: Moments) -> list[tuple[str, float, float]]:
    """Term, R^2 on the other predictors, and inflation: the diagonal of the inverse correlation matrix."""
    p, g = len(m.names), m.total
    if p < 2:
        raise ValueError("two predictors at least")
    mean = g[0, 1 : p + 1] / g[0, 0]
    c = g[1 : p + 1, 1 : p + 1] / g[0, 0] - np.outer(mean, mean)
    size = np.sqrt(np.diag(c))
    r = c / np.outer(size, size)
    out = []
    for k, name in enumerate(m.names):  # only terms that the others give are infinite
        others = [j for j in range(p) if j != k]
        r2 = float(min(1.0, r[k, others] @ np.linalg.lstsq(r[np.ix_(others, others)], r[others, k], rcond=1e-12)[0]))
        out.append((name, r2, math.inf if r2 >= 1 - 1e-12 else 1 / (1 - r2)))
    return out


def condition_number(fit: LeastSquares) -> float:
    """Ratio of the largest to the least singular value of the original design, with its intercept if it has one."""
    return fit.stats["condition_number"]


def _royston(n: int, mm: float, last: float, before: float) -> tuple[float, float, float]:
    """Weights of the largest and second largest value, and what the other normal scores are divided by; mm is the scores' sum of squares."""
    u, c = 1 / math.sqrt(n), 1 / math.sqrt(mm)
    # The published polynomials.
    top = last * c + 0.221157 * u - 0.147981 * u**2 - 2.071190 * u**3 + 4.434685 * u**4 - 2.706056 * u**5
    if n <= 5:
        return top, math.nan, math.sqrt((mm - 2 * last**2) / (1 - 2 * top**2))
    second = before * c + 0.042981 * u - 0.293762 * u**2 - 1.752461 * u**3 + 5.682633 * u**4 - 3.582633 * u**5
    return top, second, math.sqrt((mm - 2 * last**2 - 2 * before**2) / (1 - 2 * top**2 - 2 * second**2))


def _royston_p(w: float, n: int) -> float:
    """p-value of W."""
    if n == 3:
        return max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    if w >= 1:
        return 1.0
    y, k = math.log(1 - w), math.log(n)
    # The published approximations of mean and deviation.
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if y >= gamma:
            return 0.0
        y = -math.log(gamma - y)
        mu = 0.5440 - 0.39978 * n + 0.025054 * n**2 - 0.0006714 * n**3
        sigma = math.exp(1.3822 - 0.77857 * n + 0.062767 * n**2 - 0.0020322 * n**3)
    else:
        mu = -1.5861 - 0.31082 * k - 0.083751 * k**2 + 0.0038915 * k**3
        sigma = math.exp(-0.4803 - 0.082676 * k + 0.0030302 * k**2)
    return float(normal_sf((y - mu) / sigma))


def shapiro_wilk_table(df: DataFrame, value: str, by: Sequence[str], tiebreak: Sequence[str]) -> DataFrame:
    """Per group: n, Royston's W and p, for any number of values (NULL below three and for constant ones).

    Values are ranked in ranges and weighted by the normal score of their rank in two sums, so that no group is one task.
    """
    by = list(by)
    d = df.where(F.col(value).isNotNull()).select(*by, *[c for c in tiebreak if c not in by], F.col(value).cast("double").alias("_x"))
    d = ranks.numbered(d, ["_x", *tiebreak], by, ranks.numeric_range(d, "_x")).withColumn("_i", F.col("_number") + 1)
    spread = d.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.avg("_x").alias("_m")).select(*[F.col(b).alias(f"_g{k}") for k, b in enumerate(by)], "_n", "_m")
    same = F.lit(True)
    for k, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_g{k}"))
    d = d.join(spread, same)
    score = normal_quantile((F.col("_i") - 0.375) / (F.col("_n") + 0.25))
    d = d.withColumn("_s", score).withColumn("_e", F.col("_x") - F.col("_m"))
    i, n, s, e = F.col("_i"), F.col("_n"), F.col("_s"), F.col("_e")
    inner = F.when((i > 1) & (i < n), s * e)
    inmost = F.when((i > 2) & (i < n - 1), s * e)
    at = lambda k: F.max(F.when(i == k, e))
    sums = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(s * s).alias("mm"), F.sum(e * e).alias("ss"), F.max(F.when(i == n, s)).alias("s1"), F.max(F.when(i == n - 1, s)).alias("s2"),
        F.sum(inner).alias("inner"), F.sum(inmost).alias("inmost"), at(1).alias("e1"), at(2).alias("e2"), at(n - 1).alias("f2"), at(n).alias("f1"),
    )

    w = _royston_w(*map(F.col, ("n", "mm", "ss", "s1", "s2")), F.coalesce("inner", F.lit(0.0)), F.coalesce("inmost", F.lit(0.0)), *map(F.col, ("e1", "e2", "f2", "f1")))
    return sums.withColumn("w", w).select(*by, "n", "w", _royston_tail(F.col("w"), F.col("n")).alias("p_value"))


def _power_sum(x: Column, coefficients: Sequence[float]) -> Column:
    """A polynomial by rising power."""
    out = F.lit(float(coefficients[-1]))
    for c in coefficients[-2::-1]:
        out = out * x + float(c)
    return out


# The published polynomials of the two outer weights, and of the mean and deviation of ln(1 - W), by rising power.
_TOP, _SECOND = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056), (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_FEW_MEAN, _FEW_LOG_SD = (0.5440, -0.39978, 0.025054, -0.0006714), (1.3822, -0.77857, 0.062767, -0.0020322)
_MANY_MEAN, _MANY_LOG_SD = (-1.5861, -0.31082, -0.083751, 0.0038915), (-0.4803, -0.082676, 0.0030302)


def _royston_w(n, mm, ss, s1, s2, inner, inmost, e1, e2, f2, f1) -> Column:
    """W from a group's sums: squares of scores and values, outer scores and values, and products of the inner ones."""
    u, c = 1 / F.sqrt(n.cast("double")), 1 / F.sqrt(mm)
    top, second = s1 * c + _power_sum(u, _TOP), s2 * c + _power_sum(u, _SECOND)
    phi_few = F.sqrt((mm - 2 * s1 * s1) / (1 - 2 * top * top))
    phi = F.sqrt((mm - 2 * s1 * s1 - 2 * s2 * s2) / (1 - 2 * top * top - 2 * second * second))
    b = F.when(n == 3, math.sqrt(0.5) * (f1 - e1)).when(n <= 5, top * (f1 - e1) + inner / phi_few).otherwise(top * (f1 - e1) + second * (f2 - e2) + inmost / phi)
    return F.when((n >= 3) & (ss > 0), F.least(F.lit(1.0), b * b / ss))


def _royston_tail(w: Column, n: Column) -> Column:
    """p-value of W."""
    y, size, log_n = F.ln(1 - w), n.cast("double"), F.ln(n.cast("double"))
    gamma = 0.459 * size - 2.273
    few = normal_tail((-F.ln(gamma - y) - _power_sum(size, _FEW_MEAN)) / F.exp(_power_sum(size, _FEW_LOG_SD)))
    many = normal_tail((y - _power_sum(log_n, _MANY_MEAN)) / F.exp(_power_sum(log_n, _MANY_LOG_SD)))
    three = F.greatest(F.lit(0.0), 6 / math.pi * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))))
    return F.when(w.isNull(), None).when(n == 3, three).when(w >= 1, 1.0).when((n <= 11) & (y >= gamma), 0.0).when(n <= 11, few).otherwise(many)


def residual_report(df: DataFrame, fit: LeastSquares, y: str, order: Sequence[str], rows: int = halo.RANGE_ROWS) -> DataFrame:
    """One row of the tests of a fit's residuals; NULL where undefined.

    n, mean and deviation of the residuals, Shapiro-Wilk, Jarque-Bera, Durbin-Watson in the stated ``order`` of rows,
    Breusch-Pagan, the largest leverage and Cook's distance, and the design's condition number.
    """
    d = influence(df, fit, y).withColumnRenamed("residual", "_residual")
    e = F.col("_residual")
    jb, jb_p = jarque_bera("_residual")
    spread = d.agg(
        F.count(e).alias("n"), F.avg(e).alias("residual_mean"), F.stddev_samp(e).alias("residual_sd"), jb.alias("jarque_bera"), jb_p.alias("jarque_bera_p"),
        F.max("leverage").alias("max_leverage"), F.max("cooks").alias("max_cooks_distance"),
    )
    try:
        lm, lm_p = breusch_pagan(df, fit, y)
    except ValueError:
        lm = lm_p = math.nan
    clean = lambda v: F.lit(None if math.isnan(v) else v).cast("double")
    out = spread.join(shapiro_wilk_table(d, "_residual", [], list(order)).select(F.col("w").alias("shapiro_w"), F.col("p_value").alias("shapiro_p")), how="left")  # one row and one row
    out = out.join(durbin_watson(d, "_residual", list(order), [], rows), how="left")
    return out.withColumns({"breusch_pagan": clean(lm), "breusch_pagan_p": clean(lm_p), "condition_number": clean(condition_number(fit))})


def influence_table(df: DataFrame, fit: LeastSquares, y: str, tiebreak: Sequence[str]) -> DataFrame:
    """Of every row: observed, fitted, residual, studentized, leverage, cooks, normal_quantile (of the residual's rank)."""
    d = influence(df, fit, y).withColumnRenamed(y, "observed")
    d = ranks.numbered(d, ["residual", *tiebreak], [], ranks.numeric_range(d, "residual")).withColumn("_n", F.lit(fit.stats["n"]))
    d = d.withColumn("normal_quantile", normal_quantile((F.col("_number") + 1 - 0.375) / (F.col("_n") + 0.25)))
    return d.select(*tiebreak, "observed", "fitted", "residual", "studentized", "leverage", "cooks", "normal_quantile")


def shapiro_wilk(values: Sequence[float]) -> tuple[float, float]:
    """W and p-value of a few values at hand, as the table's; NaN for constant ones."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3:
        raise ValueError("three values at least")
    if x[0] == x[-1]:
        return math.nan, math.nan
    if n == 3:
        b = math.sqrt(0.5) * (x[2] - x[0])
    else:
        from statistics import NormalDist

        m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
        top, second, phi = _royston(n, float(m @ m), m[-1], m[-2])
        a = m / phi
        a[-1], a[0] = top, -top
        if n > 5:
            a[-2], a[1] = second, -second
        b = float(a @ x)
    w = min(1.0, b * b / float(((x - x.mean()) ** 2).sum()))
    return w, _royston_p(w, n)
