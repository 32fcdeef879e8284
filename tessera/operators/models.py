"""Estimators with their scaling and reduction: fitted, applied, saved, cross-validated and tuned over fold columns."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from itertools import product
from typing import Any

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import ModelFileError
from tessera.operators import kernels, metrics
from tessera.operators.linear import moments, ridge, scaled_ridge

MODELS = {"regression": ("linear", "ridge", "random_forest", "svr", "mlp"), "classification": ("logistic", "svc", "random_forest", "mlp")}
REDUCERS = ("none", "pca", "lda")
#: Settings that tuning tries.
SEARCH = {
    ("regression", "ridge"): {"alpha": (0.01, 0.1, 1.0, 10.0, 100.0)},
    ("regression", "svr"): {"c": (0.1, 1.0, 10.0), "epsilon": (0.05, 0.1, 0.5)},
    ("regression", "random_forest"): {"depth": (4, 8, 20), "leaf": (1, 3)},
    ("regression", "mlp"): {"ridge": (1e-4, 1e-2, 1.0)},
    ("classification", "logistic"): {"c": (0.01, 0.1, 1.0, 10.0)},
    ("classification", "svc"): {"c": (0.1, 1.0, 10.0)},
    ("classification", "random_forest"): {"depth": (4, 8, 20), "leaf": (1, 3)},
    ("classification", "mlp"): {"rate": (0.01, 0.03, 0.1)},
}
_FORMAT = "tessera/model-v1"


def check(name: str, task: str, reducer: str = "none") -> None:
    if task not in MODELS:
        raise ValueError(f"task must be one of {', '.join(MODELS)}, got {task!r}")
    if name not in MODELS[task]:
        raise ValueError(f"{task} has the models {', '.join(MODELS[task])}, not {name!r}")
    if reducer not in REDUCERS or reducer == "lda" and task == "regression":
        raise ValueError(f"the reducer {reducer!r} doesn't fit {task}")


def _quoted(c: str):
    return F.col(f"`{c}`").cast("double")


def linear_cv(df: DataFrame, x: Sequence[str], y: str, fold: str = "fold", alpha: float = 0.0) -> DataFrame:
    """Adds the held-out prediction of every row: one pass of moments per fold, the training sums are the total less the fold's."""
    m = moments(df, x, y, [fold])
    fitted = []
    for key in m.gram:
        b0, b = ridge(m.without(key), m, alpha)
        fitted.append((*key, b0, *map(float, b)))
    kind = df.schema[fold].dataType.simpleString()
    names = ", ".join(f"_b{i} double" for i in range(len(x) + 1))
    table = df.sparkSession.createDataFrame(fitted, f"_fold {kind}, {names}")  # one row a fold
    d = df.join(F.broadcast(table), F.col(fold) == F.col("_fold"))
    value = F.col("_b0")
    for i, c in enumerate(x):
        value = value + F.col(f"_b{i + 1}") * F.col(c)
    return d.withColumn("predicted", value).drop("_fold", *[f"_b{i}" for i in range(len(x) + 1)])


def principal_directions(m, components: int | float | None = None) -> np.ndarray:
    """Directions (columns) of standardised predictors with the most variance: so many, or as many as hold a share of it (95 % without)."""
    p, g = len(m.names), m.total
    mean = g[0, 1 : p + 1] / g[0, 0]
    values, vectors = np.linalg.eigh(g[1 : p + 1, 1 : p + 1] / g[0, 0] - np.outer(mean, mean))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    share = 0.95 if components is None else components
    k = int(share) if share >= 1 else int(np.searchsorted(np.cumsum(values) / values.sum(), share - 1e-12) + 1)
    if k > p:
        raise ValueError(f"{p} predictors have no {k} components")
    vectors = vectors[:, :k]
    return vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(k)])


def lda_directions(df: DataFrame, x: Sequence[str], label: str, components: int) -> np.ndarray:
    """Discriminant directions (columns) of the predictors from grouped moments; at most classes - 1 of them."""
    m = moments(df, list(x), x[0], [label])
    p = len(x)
    total = m.total
    mean = total[0, 1 : p + 1] / total[0, 0]
    within, between = np.zeros((p, p)), np.zeros((p, p))
    for g in m.gram.values():
        n, mu = g[0, 0], g[0, 1 : p + 1] / g[0, 0]
        within += g[1 : p + 1, 1 : p + 1] - n * np.outer(mu, mu)
        between += n * np.outer(mu - mean, mu - mean)
    if components > min(len(m.gram) - 1, p):
        raise ValueError(f"{len(m.gram)} classes and {p} features allow {min(len(m.gram) - 1, p)} components")
    values, vectors = np.linalg.eigh(within + 1e-12 * np.eye(p))
    white = vectors / np.sqrt(values)
    v, u = np.linalg.eigh(white.T @ between @ white)
    return (white @ u[:, np.argsort(-v)[:components]]) / m.scale[:p, None]


@dataclass
class Model:
    """A fitted estimator: what it was asked for, the scaling and projection before it, and its parameters."""

    task: str
    name: str
    x: list[str]
    y: str
    settings: dict[str, Any]
    center: list[float]
    scale: list[float]
    projection: list[list[float]] | None
    classes: list | None
    state: dict[str, Any] = field(default_factory=dict)
    stages: PipelineModel | None = None

    @property
    def inputs(self) -> list[str]:
        return [f"_f{i}" for i in range(len(self.projection[0]) if self.projection else len(self.x))]

    def prepared(self, df: DataFrame) -> DataFrame:
        """Adds the estimator's inputs: standardised predictors, or their projections."""
        z = [(_quoted(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(self.x, self.center, self.scale, strict=True)]
        if self.projection:
            z = [sum((F.lit(row[k]) * v for row, v in zip(self.projection, z, strict=True)), F.lit(0.0)) for k in range(len(self.inputs))]
        return df.withColumns(dict(zip(self.inputs, z, strict=True)))

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds predicted, and for classes score_<class>."""
        if missing := [c for c in self.x if c not in df.columns]:
            raise ValueError(f"columns are missing: {', '.join(missing)}")
        d = self.prepared(df)
        if self.name in ("linear", "ridge"):
            value = F.lit(self.state["intercept"])
            for b, c in zip(self.state["beta"], self.inputs, strict=True):
                value = value + F.lit(b) * F.col(c)
            return d.withColumn("predicted", value).drop(*self.inputs)
        if self.name == "svc":
            d = kernels.class_probabilities(d, self.inputs, kernels.SupportVectorClassifier(**self.settings), self.state, "_scores")
            best = F.array_position("_scores", F.array_max("_scores")).cast("int")
            d = d.withColumn("predicted", F.element_at(F.array(*[F.lit(c) for c in self.classes]), best))
            return metrics.class_scores(d, "_scores", self.classes, self.classes).drop(*self.inputs, "_scores")
        if self.stages is None:
            kernel = kernels.KERNELS[self.name](**self.settings)
            return kernels.predicted(d, self.inputs, kernel, {0: self.state}).drop(*self.inputs)
        d = self.stages.transform(d)
        if self.task == "regression":
            return d.withColumn("predicted", F.col("prediction")).drop(*self.inputs, "_x", "prediction")
        names = F.array(*[F.lit(c) for c in self.classes])
        d = d.withColumn("predicted", F.get(names, F.col("prediction").cast("int"))).withColumn("_scores", vector_to_array("probability"))
        return metrics.class_scores(d, "_scores", self.classes, self.classes).drop(*self.inputs, "_x", "_y", "_scores", "prediction", "rawPrediction", "probability")

    def save(self, path: str, spark: SparkSession) -> None:
        """A one-row text table, and the stages of pyspark.ml beside it."""
        named = {k: v for k, v in self.__dict__.items() if k != "stages"}
        text = json.dumps({"format": _FORMAT, "stages": self.stages is not None, **named}, sort_keys=True)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/model")
        if self.stages is not None:
            self.stages.write().overwrite().save(f"{path}/stages")


def load(path: str, spark: SparkSession) -> Model:
    try:
        found = json.loads(spark.read.text(f"{path}/model").first().value)
    except Exception as e:
        raise ModelFileError(f"{path} isn't a model: {type(e).__name__}") from e
    if not isinstance(found, dict) or found.pop("format", None) != _FORMAT:
        raise ModelFileError(f"{path} isn't a {_FORMAT} file")
    stages = found.pop("stages", False)
    if missing := {"task", "name", "x", "y", "settings", "center", "scale", "projection", "classes", "state"} - set(found):
        raise ModelFileError(f"{path} lacks {', '.join(sorted(missing))}")
    if found["task"] == "classification" and not found["classes"]:
        raise ModelFileError(f"{path} has no classes")
    return Model(**found, stages=PipelineModel.load(f"{path}/stages") if stages else None)


def _staged(task: str, name: str, settings: Mapping, p: int, classes: int, n: int, seed: int):
    if name == "random_forest":
        kind = RandomForestRegressor if task == "regression" else RandomForestClassifier
        trees, depth, leaf = settings.get("trees", 200), min(30, settings.get("depth") or 30), settings.get("leaf", 1)
        return kind(numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, featureSubsetStrategy="all" if task == "regression" else "sqrt", seed=seed)
    if name == "logistic":
        return LogisticRegression(regParam=1 / (settings.get("c", 1.0) * max(1, n)), standardization=False, maxIter=200, tol=1e-9)
    return MultilayerPerceptronClassifier(layers=[p, settings.get("hidden", 16), classes], maxIter=200, stepSize=settings.get("rate", 0.03), seed=seed)


def fit(df: DataFrame, x: Sequence[str], y: str, name: str, task: str = "regression", settings: Mapping | None = None, reducer: str = "none", components=None, seed: int = 0) -> Model:
    """Fit an estimator with its scaling, and reduction, on all rows of ``df``."""
    check(name, task, reducer)
    x, settings = list(x), dict(settings or {})
    classes = [r[0] for r in df.select(y).distinct().orderBy(y).collect()] if task == "classification" else None
    m = moments(df, x, y if task == "regression" else x[0])
    p = len(x)
    projection = None
    if reducer == "pca":
        projection = principal_directions(m, components)
    elif reducer == "lda":
        projection = lda_directions(df, x, y, int(components or len(classes) - 1)) * m.scale[:p, None]
    model = Model(task, name, x, y, settings, m.center[:p].tolist(), m.scale[:p].tolist(), None if projection is None else projection.tolist(), classes)
    d = model.prepared(df)
    if name in ("linear", "ridge"):
        inner = moments(d, model.inputs, y)
        b0, b = ridge(inner.total, inner, settings.get("alpha", 1.0) if name == "ridge" else 0.0)
        model.state = {"intercept": b0, "beta": b.tolist()}
    elif task == "regression" and name in kernels.KERNELS:
        kernel = kernels.KERNELS[name](**settings)
        model.state = kernel.fit(d.withColumn("_none", F.lit(-1)), model.inputs, y, "_none", [0])[0]
    elif name == "svc":
        number = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(y)) - 1).cast("double")
        d = d.withColumns({"_y": number, "_part": F.pmod(F.xxhash64(*model.inputs), F.lit(kernels.SupportVectorClassifier.PARTS))})
        model.state = kernels.SupportVectorClassifier(**settings).fit_classes(d, model.inputs, "_y", "_part", len(classes))
    else:
        target = y
        if classes is not None:
            d, target = d.withColumn("_y", (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(y)) - 1).cast("double")), "_y"
        estimator = _staged(task, name, settings, len(model.inputs), len(classes or ()), int(m.total[0, 0]), seed)
        estimator.setFeaturesCol("_x").setLabelCol(target)
        assembler = VectorAssembler(inputCols=model.inputs, outputCol="_x")
        model.stages = PipelineModel([assembler, estimator.fit(assembler.transform(d))])
    return model


def folds_of(df: DataFrame, fold: str) -> list[int]:
    return [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]  # one row a fold


def _by_fold(df: DataFrame, x: Sequence[str], fitted: Mapping[Any, tuple[float, np.ndarray]], fold: str) -> DataFrame:
    """Adds predicted: by the line of the row's fold."""
    names = ", ".join(f"_b{i} double" for i in range(len(x) + 1))
    table = df.sparkSession.createDataFrame([(k, b0, *map(float, b)) for k, (b0, b) in fitted.items()], f"_fold {df.schema[fold].dataType.simpleString()}, {names}")  # one row a fold
    value = F.col("_b0")
    for i, c in enumerate(x):
        value = value + F.col(f"_b{i + 1}") * _quoted(c)
    return df.join(F.broadcast(table), F.col(fold) == F.col("_fold")).withColumn("predicted", value).drop("_fold", *[f"_b{i}" for i in range(len(x) + 1)])


def cross_validate(
    df: DataFrame, x: Sequence[str], y: str, name: str, task: str = "regression", settings: Mapping | None = None, fold: str = "fold", reducer: str = "none", components=None, seed: int = 0,
    tune: bool = False, inner: int = 3, group: str | None = None, grid: Mapping[str, Sequence] | None = None,
) -> DataFrame:
    """``df`` with predicted (and score_<class>): every row by a model of the other folds, scaling and reduction included.

    Least squares and ridge take one pass for all folds, the kernels the same passes for all folds, the others a fit a fold.
    With ``tune`` the settings of each fold are those that do best on ``inner`` folds of its training rows (see ``nested``).
    """
    check(name, task, reducer)
    if tune:
        from tessera.operators import nested

        return nested.cross_validate(df, x, y, name, task, fold, inner, group, grid, reducer, components, seed, dict(settings or {}))[0]
    return with_settings(df, x, y, name, task, dict.fromkeys(folds_of(df, fold), dict(settings or {})), fold, reducer, components, seed)


def with_settings(
    df: DataFrame, x: Sequence[str], y: str, name: str, task: str, settings: Mapping[Any, Mapping], fold: str = "fold", reducer: str = "none", components=None, seed: int = 0, sums=None
) -> DataFrame:
    """As ``cross_validate``, with settings of its own for every fold."""
    keys, x = list(settings), list(x)
    if reducer == "none" and name in ("linear", "ridge"):
        m = sums or moments(df, x, y, [fold])
        alpha = lambda k: settings[k].get("alpha", 1.0) if name == "ridge" else 0.0
        return _by_fold(df, x, {k: scaled_ridge(m.total - sum(g for key, g in m.gram.items() if key[0] == k), m, alpha(k)) for k in keys}, fold)
    if reducer == "none" and task == "regression" and name in kernels.KERNELS:
        states: dict = {}
        for chosen in {json.dumps(s, sort_keys=True): s for s in settings.values()}.values():
            kernel = kernels.KERNELS[name](**chosen)
            states |= kernel.fit(df, x, y, fold, [k for k in keys if settings[k] == chosen])
        return kernels.predicted(df, x, kernels.KERNELS[name](**settings[keys[0]]), states, fold)  # what is tuned doesn't change how a state predicts
    out = None
    classes = [r[0] for r in df.select(y).distinct().orderBy(y).collect()] if task == "classification" else []
    for k in keys:
        model = fit(df.where(F.col(fold) != k), x, y, name, task, settings[k], reducer, components, seed)
        part = model.predict(df.where(F.col(fold) == k))
        part = part.withColumns({f"score_{c}": F.lit(0.0) for c in classes if c not in model.classes})
        part = part.select(*[F.col(f"`{c}`") for c in df.columns], "predicted", *[f"`score_{c}`" for c in classes])
        out = part if out is None else out.unionByName(part)
    return out


def evaluated(predictions: DataFrame, y: str, task: str = "regression", fold: str = "fold", positive=None, score: str | None = None) -> DataFrame:
    """All metrics per fold and pooled over all rows (fold NULL), with the rows that were learned from and tested on."""
    sizes = predictions.groupBy(fold).agg(F.count(F.lit(1)).alias("n_test")).collect()
    total = sum(r.n_test for r in sizes)
    if task == "regression":
        out = metrics.with_pooled(predictions, lambda d, by: metrics.regression(d, y, "predicted", by), fold)
    else:
        out = metrics.classification(predictions, y, "predicted", positive, score).withColumn(fold, F.lit(None).cast(predictions.schema[fold].dataType))
        for r in sizes:
            part = metrics.classification(predictions.where(F.col(fold) == r[fold]), y, "predicted", positive, score)
            out = out.unionByName(part.withColumn(fold, F.lit(r[fold]).cast(predictions.schema[fold].dataType)))
    return out.withColumn("n_train", F.when(F.col(fold).isNotNull(), F.lit(total) - F.col("n")))


def tune(df: DataFrame, x: Sequence[str], y: str, name: str, task: str = "regression", fold: str = "fold", grid: Mapping[str, Sequence] | None = None, **other) -> tuple[Model, list[dict]]:
    """The model of the best settings on all rows, and the score of every setting over the folds: RMSE, or one less UAR; the first of equals."""
    grid = SEARCH.get((task, name), {}) if grid is None else grid
    tried = []
    for values in product(*grid.values()):
        settings = dict(zip(grid, values, strict=True))
        table = evaluated(cross_validate(df, x, y, name, task, settings, fold, **other), y, task, fold).where(F.col(fold).isNotNull())
        score = table.agg(F.avg("rmse") if task == "regression" else 1 - F.avg("uar")).first()[0]
        tried.append({"settings": settings, "score": math.inf if score is None else float(score)})
    best = min(tried, key=lambda t: t["score"])
    return fit(df, x, y, name, task, best["settings"], **other), tried
