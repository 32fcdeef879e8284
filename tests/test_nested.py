"""Inner folds: choices by hand, and proof that no test row reaches a choice."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import folds, models, nested


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 3)) * [1, 20, 0.1]
    y = x @ [1.0, -0.02, 2.0] + rng.normal(size=90) * 2
    rows = [(i, i % 18, i % 3, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "i int, g int, fold int, a double, b double, c double, y double").repartition(4)


X = ["a", "b", "c"]


def rows_of(d):
    return np.array(d.select("fold", "_inner", *X, "y").collect(), float)


def ridge(train, alpha):
    m, s, t = train[:, :-1].mean(0), train[:, :-1].std(0), train[:, -1].mean()
    z = (train[:, :-1] - m) / s
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (train[:, -1] - t)) / s
    return lambda v: t + (v - m) @ beta


def test_inner_folds_are_even_within_every_fold(table):
    d = folds.inner(table, 3, ["i"], 7, out="_inner")
    counts = {(r.fold, r._inner): r["count"] for r in d.groupBy("fold", "_inner").count().collect()}
    assert len(counts) == 9 and set(counts.values()) == {10}
    whole = folds.inner(table.withColumn("fold", F.col("g") % 3), 3, ["i"], 7, group="g", out="_inner")
    assert whole.groupBy("g").agg(F.countDistinct("_inner").alias("n")).where("n > 1").isEmpty()
    assert whole.groupBy("fold").agg(F.countDistinct("_inner").alias("n")).where("n < 3").isEmpty() and whole.count() == 90


def test_ridge_choices_equal_those_by_hand(table):
    alphas = (0.01, 1.0, 30.0, 300.0)
    p, chosen = nested.cross_validate(table, X, "y", "ridge", inner=3, grid={"alpha": alphas}, ids=["i"], seed=7)
    v = rows_of(folds.inner(table, 3, ["i"], 7, out="_inner"))
    want = {}
    for k in range(3):
        scores = []
        for alpha in alphas:
            errors = []
            for j in range(3):
                out, own = v[:, 0] != k, v[:, 1] == j
                test = v[out & own, 2:]
                errors.append(np.sqrt(np.mean((ridge(v[out & ~own, 2:], alpha)(test[:, :-1]) - test[:, -1]) ** 2)))
            scores.append(np.mean(errors))
        assert [t["score"] for t in chosen[k]["tried"]] == pytest.approx(scores)
        assert chosen[k]["settings"]["alpha"] == alphas[int(np.argmin(scores))]
        f = ridge(v[v[:, 0] != k, 2:], chosen[k]["settings"]["alpha"])
        want |= {tuple(r[2:]): f(r[2:5]) for r in v[v[:, 0] == k]}
    assert {(r.a, r.b, r.c, r.y): r.predicted for r in p.collect()} == pytest.approx(want)


@pytest.mark.parametrize(("name", "grid"), [("ridge", None), ("svr", {"c": (0.1, 10.0)}), ("random_forest", {"depth": (1, 4)})])
def test_no_test_row_reaches_a_choice(table, name, grid):
    """Targets of fold 0 are turned to nonsense: what is chosen for fold 0 stays, with its scores."""
    fixed = {"trees": 5} if name == "random_forest" else {"features": 20} if name == "svr" else {}
    d = folds.inner(table, 2, ["i"], 7, out="_inner")
    spoilt = d.withColumn("y", F.when(F.col("fold") == 0, F.col("y") * -50 + F.col("i")).otherwise(F.col("y")))
    a, b = (nested.choose(t, X, "y", name, inner=2, grid=grid, fixed=fixed)[0] for t in (d, spoilt))
    assert a[0]["settings"] == b[0]["settings"] and [t["score"] for t in a[0]["tried"]] == pytest.approx([t["score"] for t in b[0]["tried"]], rel=1e-6)
    assert a[1]["score"] != pytest.approx(b[1]["score"])


def test_tuned_cross_validation_of_every_kind(table):
    p = models.cross_validate(table, X, "y", "ridge", tune=True, group="g")
    assert p.count() == 90 and p.where("predicted IS NULL").isEmpty()
    plain = models.cross_validate(table, X, "y", "linear", tune=True)
    assert sorted(r.predicted for r in plain.collect()) == pytest.approx(sorted(r.predicted for r in models.cross_validate(table, X, "y", "linear").collect()))
    d = table.withColumn("label", (F.col("y") > 0).cast("int"))
    q = models.cross_validate(d, X, "label", "logistic", "classification", tune=True, inner=2, grid={"c": (0.01, 1.0)})
    assert q.count() == 90 and {"score_0", "score_1"} <= set(q.columns)
    with pytest.raises(ValueError, match="inner"):
        nested.cross_validate(table, X, "y", "ridge", inner=1)
