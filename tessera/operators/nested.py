"""Tuning inside the training rows of each fold: folds within folds, so that no test row reaches a choice.

A row has a fold and an inner fold, dealt within its fold. The model of (k, j) learns from the rows outside of fold k and of
inner fold j, and is judged by those of inner fold j outside of fold k. For least squares and ridge one pass gives the sums of
every pair of folds; all that is trained or judged is a difference of them, for any number of settings. The kernels train all
pairs of folds in the same passes and judge all settings in one; the others need a fit each.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import product
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import folds, kernels, models
from tessera.operators.linear import Moments, moments, scaled_ridge, squared_error

INNER = "_inner"


def settings_of(name: str, task: str, grid: Mapping[str, Sequence] | None, fixed: Mapping | None = None) -> list[dict]:
    """The settings of a grid in order; the fixed ones alone for a model that has nothing to tune."""
    grid = models.SEARCH.get((task, name), {}) if grid is None else grid
    return [dict(fixed or {}) | dict(zip(grid, values, strict=True)) for values in product(*grid.values())]


def _best(scores: np.ndarray) -> int:
    """The first of the least scores; undefined ones lose."""
    return int(np.argmin(np.where(np.isnan(scores), math.inf, scores)))


def _of_sums(m: Moments, keys: Sequence, inner: int, tried: Sequence[Mapping]) -> dict[Any, np.ndarray]:
    """Mean inner RMSE of every ridge setting per fold, from the sums by fold and inner fold."""
    size = len(m.names) + 2
    of = lambda keep: sum((g for key, g in m.gram.items() if keep(*key)), np.zeros((size, size)))
    found = {}
    for k in keys:
        scores = []
        for j in range(inner):
            train, test = of(lambda f, i, j=j, k=k: f != k and i != j), of(lambda f, i, j=j, k=k: f != k and i == j)
            scores.append([math.sqrt(squared_error(test, m, *scaled_ridge(train, m, s.get("alpha", 0.0)))) for s in tried])
        found[k] = np.mean(scores, 0)
    return found


def _of_kernels(df: DataFrame, x: Sequence[str], y: str, name: str, keys: Sequence[int], fold: str, inner: int, tried: Sequence[Mapping]) -> dict[Any, np.ndarray]:
    d = df.withColumn("_code", F.col(fold) * inner + F.col(INNER))
    codes = [k * inner + j for k in keys for j in range(inner)]
    made: dict[int, list] = {c: [] for c in codes}
    for s in tried:
        kernel = kernels.KERNELS[name](**s)
        for c, state in kernel.fit(d, x, y, "_code", codes, inner).items():
            made[c].append((kernel, state))
    errors = kernels.squared_errors(d, x, y, "_code", made, inner)
    return {k: np.mean(np.sqrt([errors[k * inner + j] for j in range(inner)]), 0) for k in keys}


def _of_fits(df: DataFrame, x: Sequence[str], y: str, name: str, task: str, keys: Sequence, fold: str, inner: int, tried: Sequence[Mapping], reducer: str, components, seed: int) -> dict[Any, np.ndarray]:
    found = {}
    for k in keys:
        rest, scores = df.where(F.col(fold) != k), []
        for s in tried:
            p = models.with_settings(rest, x, y, name, task, dict.fromkeys(range(inner), s), INNER, reducer, components, seed)
            if task == "regression":
                e = F.col(y) - F.col("predicted")
                scores.append(p.groupBy(INNER).agg(F.sqrt(F.avg(e * e)).alias("e")).agg(F.avg("e")).first()[0])
            else:  # recall by class, averaged per inner fold
                by = p.groupBy(INNER, F.col(y).alias("_class")).agg(F.avg((F.col(y) == F.col("predicted")).cast("double")).alias("r")).groupBy(INNER).agg(F.avg("r").alias("r"))
                scores.append(1 - by.agg(F.avg("r")).first()[0])
        found[k] = np.array([math.nan if v is None else v for v in scores], float)
    return found


def choose(
    df: DataFrame, x: Sequence[str], y: str, name: str, task: str = "regression", fold: str = "fold", inner: int = 3, grid: Mapping[str, Sequence] | None = None, reducer: str = "none", components=None,
    seed: int = 0, fixed: Mapping | None = None,
) -> tuple[list[dict], Moments | None]:
    """Per fold (``df`` has inner folds in INNER): fold, settings, score of the chosen settings, and all that were tried with their scores.

    The score is the mean over the inner folds of RMSE, or of one less UAR; the first of equals wins. Also the sums of ridge.
    """
    tried, sums, x = settings_of(name, task, grid, fixed), None, list(x)
    if reducer == "none" and name in ("linear", "ridge"):
        sums = moments(df, x, y, [fold, INNER])
        keys = sorted({k for k, _ in sums.gram})
        scores = _of_sums(sums, keys, inner, [s if name == "ridge" else {"alpha": 0.0} for s in tried])
    else:
        keys = models.folds_of(df, fold)
        if len(tried) == 1:
            scores = {k: np.full(1, math.nan) for k in keys}
        elif reducer == "none" and task == "regression" and name in kernels.KERNELS:
            scores = _of_kernels(df, x, y, name, keys, fold, inner, tried)
        else:
            scores = _of_fits(df, x, y, name, task, keys, fold, inner, tried, reducer, components, seed)
    chosen = []
    for k in keys:
        at = _best(scores[k])
        chosen.append({"fold": k, "settings": tried[at], "score": float(scores[k][at]), "tried": [{"settings": s, "score": float(v)} for s, v in zip(tried, scores[k], strict=True)]})
    return chosen, sums


def cross_validate(
    df: DataFrame, x: Sequence[str], y: str, name: str, task: str = "regression", fold: str = "fold", inner: int = 3, group: str | None = None, grid: Mapping[str, Sequence] | None = None,
    reducer: str = "none", components=None, seed: int = 0, fixed: Mapping | None = None, ids: Sequence[str] | None = None,
) -> tuple[DataFrame, list[dict]]:
    """Predictions of every fold by a model tuned inside its training rows, and what was chosen for each.

    Inner folds are dealt by ``ids`` (by default predictors and target), keep whole groups, and balance the classes.
    """
    models.check(name, task, reducer)
    if inner < 2:
        raise ValueError(f"two inner folds at least, got {inner}")
    d = folds.inner(df, inner, list(ids or [*x, y]), seed, fold, group, y if task == "classification" else None, INNER).persist()
    chosen, sums = choose(d, x, y, name, task, fold, inner, grid, reducer, components, seed, fixed)
    out = models.with_settings(d, x, y, name, task, {c["fold"]: c["settings"] for c in chosen}, fold, reducer, components, seed, sums)
    return out.drop(INNER), chosen
