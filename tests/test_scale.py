"""Operators that cut rows into ranges or triangles give what the whole table at once gives."""

import math

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.errors import DesignMatrixError
from tessera.functions import halo, ranks, shared, stats
from tessera.operators import association, diagnostics, frames, linear, metrics, pooling, qr
from tessera.plans import catalogue

# Least squares by QR


def random_table(spark, n, spread, seed=0):
    """Two nearly equal predictors; their difference is ``spread`` of their size."""
    u = lambda k: (F.pmod(F.xxhash64("id", F.lit(k + seed)), F.lit(1_000_003)) / 1_000_003 - 0.5)
    d = spark.range(0, n, 1, 4).select("id", u(1).alias("a"), (u(1) + spread * u(2)).alias("b"), (0.01 * u(3)).alias("e"))
    return d.withColumn("y", 3 + 2 * F.col("a") - F.col("b") + F.col("e"))


@pytest.mark.parametrize("spread", [1e-4, 1e-6])
def test_acceptance_does_not_depend_on_the_number_of_rows(spark, spread):
    """Conditions of about 1e5 and 1e7 fit at every size."""
    for n in (1_000, 100_000, 2_000_000):
        fit = linear.fit_ols(random_table(spark, n, spread), ["a", "b"], "y")
        assert fit.stats["condition_number"] == pytest.approx(4.9 / spread, rel=0.1)
        assert fit.predicted() is not None and fit.stats["r2"] > 0.99


def test_doubled_rows_are_accepted_as_single_ones(spark):
    for spread in (1e-9, 1e-11, 1e-13, 1e-16):
        d, found = random_table(spark, 2_000, spread), []
        for _ in range(3):
            try:
                linear.fit_ols(d, ["a", "b"], "y")
                found.append(True)
            except DesignMatrixError:
                found.append(False)
            d = d.unionAll(d)
        assert len(set(found)) == 1 and (found[0] or spread < 1e-12)


def test_a_condition_of_1e10_keeps_its_digits(spark):
    rng = np.random.default_rng(1)
    a, c = rng.normal(size=(2, 500))
    b = a + 1e-10 * c
    d = spark.createDataFrame([(float(p), float(q), float(5 + p + (q - p) * 2)) for p, q in zip(a, b, strict=True)], "a double, b double, y double").repartition(3)
    fit = linear.fit_ols(d, ["a", "b"], "y")
    assert fit.stats["condition_number"] > 1e10
    assert fit.beta == pytest.approx([5, -1, 2], rel=1e-5)
    x = np.column_stack([np.ones(500), a, b])
    assert fit.stats["condition_number"] == pytest.approx(np.linalg.cond(x), rel=1e-4)


def test_statistics_equal_a_qr_of_the_whole_matrix(spark):
    rng = np.random.default_rng(2)
    x, e = rng.normal(size=(300, 3)) * [1, 50, 1e-3] + [0, 1e4, 0], rng.normal(size=300)
    y = 1 + x @ [1.0, -0.2, 30.0] + e
    d = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double").repartition(5)
    for intercept in (True, False):
        m = np.column_stack([np.ones(300), x]) if intercept else x
        beta = np.linalg.lstsq(m, y, rcond=None)[0]
        rss = ((y - m @ beta) ** 2).sum()
        fit = linear.fit_ols(d, ["a", "b", "c"], "y", intercept=intercept)
        se = np.sqrt(np.diag(np.linalg.inv(m.T @ m)) * rss / (300 - m.shape[1]))
        assert fit.beta[1 - intercept :] == pytest.approx(beta, rel=1e-7) and fit.se[1 - intercept :] == pytest.approx(se, rel=1e-6)
        assert fit.stats["rss"] == pytest.approx(rss) and fit.stats["ess"] == pytest.approx(fit.stats["tss"] - rss) and fit.stats["condition_number"] == pytest.approx(np.linalg.cond(m), rel=1e-6)
        h = np.einsum("ij,jk,ik->i", m, np.linalg.inv(m.T @ m), m)
        assert sorted(r[0] for r in d.select(fit.leverage()).collect()) == pytest.approx(sorted(h), rel=1e-6)
    assert fit.as_dict()["estimable"] and set(fit.as_dict()["coefficients"]) == {"intercept", "a", "b", "c"}


def test_triangles_of_empty_partitions_and_few_rows(spark):
    d = spark.range(3).repartition(8)
    r = qr.triangle(d, [F.lit(1.0), F.col("id")])
    assert r.T @ r == pytest.approx(np.array([[3, 3], [3, 5]]))
    with pytest.raises(DesignMatrixError, match="cannot be estimated"):
        linear.fit_ols(d.withColumn("y", F.col("id") * 2), ["id", "y"], "id") if d.count() < 3 else linear.fit_ols(d.limit(1).withColumn("y", F.lit(1)), ["id"], "y")
    with pytest.raises(DesignMatrixError, match="rank deficient"):
        linear.fit_ols(spark.range(10).selectExpr("id", "2 * id AS twice", "id % 3 AS y"), ["id", "twice"], "y")


# Halo exchange


def ordered(spark, n=900):
    """One entity with most rows, many with few, ties in the first order column, a null key and null order values."""
    rows = [(None if i % 50 == 7 else 1 if i % 5 < 3 else i % 90, None if i % 97 == 0 else i // 4, i, float((i * 7919) % 101)) for i in range(n)]
    return spark.createDataFrame(rows, "k int, t int, i int, v double").repartition(4)


@pytest.mark.parametrize("rows", [7, 60, 10**6])
def test_deltas_by_ranges_equal_those_over_whole_entities(spark, rows):
    d, half = ordered(spark), 3
    w = Window.partitionBy("k").orderBy("t", "i")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    plain = sum(n * (F.coalesce(F.lead("v", n).over(w), F.last("v").over(whole)) - F.coalesce(F.lag("v", n).over(w), F.first("v").over(whole))) for n in range(1, half + 1)) / 28.0
    want = {r.i: r.p for r in d.withColumn("p", plain).collect()}
    got = {r.i: r.d_v for r in frames.deltas(d, ["k"], ["t", "i"], ["v"], half, rows=rows).collect()}
    assert got == pytest.approx(want) and len(got) == 900


@pytest.mark.parametrize("by", [[], ["k"]])
@pytest.mark.parametrize("rows", [5, 100])
def test_durbin_watson_by_ranges(spark, by, rows):
    d = ordered(spark)
    groups = {}
    for r in sorted(d.collect(), key=lambda r: (r.t is not None, r.t or 0, r.i)):
        groups.setdefault(tuple(r[b] for b in by), []).append(r.v)
    want = {k: float((np.diff(v) ** 2).sum() / (np.array(v) ** 2).sum()) for k, v in groups.items() if any(v)}
    got = {tuple(r[b] for b in by): r.durbin_watson for r in diagnostics.durbin_watson(d, "v", ["t", "i"], by, rows).collect()}
    assert {k: v for k, v in got.items() if v is not None} == pytest.approx(want)


def test_a_hot_entity_is_many_window_partitions(spark):
    d = spark.range(5000).selectExpr("1 AS k", "id AS t", "id * 1.0 AS v")
    found = halo.with_halo(d, ["k"], ["t"], ["v"], 2, 2, 500)
    sizes = [r["count"] for r in found.groupBy(halo.RANGE).count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 1500
    copies = found.where(halo.HALO).count()
    assert copies == 4 * (len(sizes) - 1)


def test_residual_report_has_no_window_over_the_whole_table(spark):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(i, float(a), float(2 * a + e)) for i, (a, e) in enumerate(rng.normal(size=(400, 2)))], "k int, x double, y double")
    fit = linear.fit_ols(d, ["x"], "y")
    report = diagnostics.residual_report(d, fit, "y", ["k"], rows=50)
    plan = report._jdf.queryExecution().executedPlan().toString()
    r, e = report.first(), np.array([x[0] for x in d.orderBy("k").select(F.col("y") - fit.predicted()).collect()])
    assert r.durbin_watson == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum()) and r.condition_number == fit.stats["condition_number"] and 0 < r.max_leverage < 1
    assert "range" in plan


def test_normal_scores_and_normalisation_of_groups(spark):
    d = ordered(spark).where("t IS NOT NULL")
    w = Window.partitionBy("k")
    place = (F.row_number().over(w.orderBy("v", "i")) - 0.375) / (F.count(F.lit(1)).over(w) + 0.25)
    want = {r.i: r.p for r in d.withColumn("p", place).collect()}
    from tessera.functions.special import normal_ppf

    got = {r.i: r.normal_quantile for r in diagnostics.normal_scores(d, "v", ["i"], ["k"]).collect()}
    assert got == pytest.approx({k: float(normal_ppf(p)) for k, p in want.items()}, abs=1e-8)
    z = pooling.normalize(d, ["k"], ["v"], "cmvn")
    plain = d.withColumn("z", F.coalesce(F.try_divide(F.col("v") - F.avg("v").over(w), F.stddev_pop("v").over(w)), F.col("v") - F.avg("v").over(w)))
    assert {r.i: r.v for r in z.collect()} == pytest.approx({r.i: r.z for r in plain.collect()})
    assert z.columns == d.columns and not math.isnan(z.first().v)


# Exact percentiles


@pytest.mark.parametrize("held", [5, 10**6])
def test_percentiles_of_large_groups_equal_spark_s(spark, held, monkeypatch):
    from tessera.functions import quantiles

    monkeypatch.setattr(quantiles, "CELLS", 8)
    rng = np.random.default_rng(5)
    rows = [(None if i % 11 == 0 else 1 if i % 11 < 8 else i % 5, float(rng.lognormal(0, 9)) if i % 3 else float(i % 4), None if i % 7 < 3 or i % 11 == 9 else float(rng.integers(3))) for i in range(700)]
    d = spark.createDataFrame(rows, "k int, a double, b double").repartition(3)
    percents = (0, 10, 25, 50, 99.5, 100)
    want = d.groupBy("k").agg(*[F.percentile(c, F.lit(q / 100)).alias(f"p{q:g}_{c}") for q in percents for c in "ab"], F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"))
    got = pooling.pool(d, ["k"], ["a", "b"], ("mean",), percents, held=held)
    assert set(got.columns) == set(want.columns)
    plain = lambda df: {r.k: [r[c] for c in sorted(want.columns) if c != "k"] for r in df.collect()}
    a, b = plain(got), plain(want)
    assert a.keys() == b.keys()
    for k in b:
        for x, y in zip(a[k], b[k], strict=True):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, rel=1e-12))


def test_one_group_with_all_rows(spark):
    """A million rows in one entity: nothing holds more than a hundredth of them."""
    d = spark.range(0, 1_000_001, 1, 8).select(F.lit("x").alias("k"), (F.pmod(F.col("id") * 7919, F.lit(1_000_001)) / 4).alias("v"))
    r = pooling.pool(d, ["k"], ["v"], (), (1, 50, 90), held=10_000).first()
    assert (r.p1_v, r.p50_v, r.p90_v) == (2500.0, 125000.0, 225000.0)


# Polynomials


def test_polynomials_of_degree_8_on_a_skewed_column(spark):
    rng = np.random.default_rng(6)
    x = rng.lognormal(0, 0.7, 3000)
    d = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(4)
    p = np.array(linear.PolynomialBasis.fit(d, "x", 8).transform(d, "x").select(*[f"p{k}" for k in range(1, 9)]).collect())
    assert np.abs(p.T @ p - np.eye(8)).max() < 1e-12 and np.abs(p.sum(0)).max() < 1e-10


def test_order_sweep_equals_fits_degree_by_degree(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-2, 5, 120)
    y = 1 + x - 0.3 * x**2 + rng.normal(size=120)
    fold = np.arange(120) % 4
    d = spark.createDataFrame([(float(a), float(b), int(f)) for a, b, f in zip(x, y, fold, strict=True)], "x double, y double, fold int").repartition(3)
    for row in linear.order_sweep(d, "x", "y", 6, "fold"):
        k = row["degree"]
        v = np.polynomial.chebyshev.chebvander((2 * x - x.min() - x.max()) / (x.max() - x.min()), k)
        q = np.linalg.qr(v)[0]
        e, h = y - q @ (q.T @ y), (q**2).sum(1)
        errors = [np.sqrt(np.mean((y[fold == f] - v[fold == f] @ np.linalg.lstsq(v[fold != f], y[fold != f], rcond=None)[0]) ** 2)) for f in range(4)]
        n = len(x)
        want = {"rss": (e**2).sum(), "loocv_rmse": np.sqrt(np.mean((e / (1 - h)) ** 2)), "kfold_rmse": np.mean(errors), "aic": n * (np.log(2 * np.pi * (e**2).sum() / n) + 1) + 2 * (k + 1)}
        assert {c: row[c] for c in want} == pytest.approx(want, rel=1e-9)


def test_ranks_in_ranges_equal_ranks_in_a_window(spark, monkeypatch):
    from tessera.functions import ranks

    d = ordered(spark)
    plain = lambda: sorted(map(tuple, ranks.value_ranks(d, "v", by=["k"]).collect()), key=str)
    few = plain()
    monkeypatch.setattr(ranks, "BROADCAST_VALUES", 3)
    assert [r for r in plain() if r[0] is not None] == [r for r in few if r[0] is not None]


def test_constant_columns_have_no_spread_however_moments_are_merged(spark):
    """Moments of sevens merged over partitions were off 0 by rounding, and so a skewness came of them."""
    d = spark.range(0, 3000, 1, 7).select((F.col("id") % 10).alias("k"), F.lit(7.0).alias("flat"), F.col("id").cast("double").alias("x"))
    rows = pooling.pool(d, ["k"], ["flat"], ("skew", "kurtosis", "std")).drop("k").distinct().collect()
    assert [tuple(r) for r in rows] == [(0.0, 0.0, 0.0)]
    assert {r.r for r in d.groupBy("k").agg(stats.pearson("flat", "x").alias("r")).collect()} == {None}


@pytest.mark.parametrize("method", ["holm", "fdr_bh"])
def test_adjusted_p_values_of_families_in_ranges(spark, monkeypatch, method):
    """Two families with ties and undefined ones, in ranges, and at once: no window looks at the rest of a family for every row."""
    rng = np.random.default_rng(8)
    p = [None, math.nan, 0.0, 0.0, 1.0, *(np.round(rng.random(400) ** 3, 2)).tolist()]
    rows = [(g, k, x) for g in ("a", None) for k, x in enumerate(p)]
    d = spark.createDataFrame(rows, "g string, k int, p double")
    want = {}
    known = sorted((x, k) for k, x in enumerate(p) if x is not None and not math.isnan(x))
    m = len(known)
    steps = [x * (m - i) if method == "holm" else x * (m / (i + 1)) for i, (x, _) in enumerate(known)]
    for i, (_, k) in enumerate(known):
        want[k] = min(1.0, max(steps[: i + 1]) if method == "holm" else min(steps[i:]))
    for most in (100_000, 0):
        monkeypatch.setattr(ranks, "BROADCAST_VALUES", most)
        out = association.adjust(d, "p", ["k"], method, ["g"])
        assert "currentrow$(), unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower()
        got = out.collect()
        assert len(got) == len(rows) and all(r.p_adjusted == (pytest.approx(want[r.k], abs=1e-12) if r.k in want else None) for r in got)


def plain_rho(x, y):
    both = ~(np.isnan(x) | np.isnan(y))
    ranks_of = lambda v: np.array([(v < a).sum() + ((v == a).sum() + 1) / 2 for a in v])
    return int(both.sum()), np.corrcoef(ranks_of(x[both]), ranks_of(y[both]))[0, 1]


@pytest.mark.parametrize("most", [100_000, 60, 0])
def test_rank_correlations_form_no_pairs_of_columns_with_few_values(spark, monkeypatch, most):
    """Features with few values, with other nulls, and one with many; at the last bound all go by their pairs."""
    rng = np.random.default_rng(6)
    table = np.stack([rng.integers(0, 5, 300), rng.integers(0, 20, 300), rng.integers(0, 3, 300), rng.normal(0, 1, 300), rng.integers(0, 90, 300)], 1).astype(float)
    table[:, 4] += table[:, 1]
    table[::7, 1], table[::11, 4] = np.nan, np.nan
    names = ["a", "b", "c", "d", "y"]
    d = spark.createDataFrame([[None if math.isnan(v) else float(v) for v in r] for r in table], ", ".join(f"{n} double" for n in names))
    monkeypatch.setattr(ranks, "BROADCAST_VALUES", most)
    tables = []
    monkeypatch.setattr(association, "written", lambda df, name: tables.append(name) or shared.written(df, name))
    got = {r.feature: (r.n, r.rho) for r in association.feature_correlations(d, names[:4], "y").collect()}
    for k, c in enumerate(names[:4]):
        n, rho = plain_rho(table[:, k], table[:, 4])
        assert got[c] == (n, pytest.approx(rho, abs=1e-12))
    assert tables.count("pairs") == (most < 300)


def test_metrics_of_few_predictions_form_no_pairs(spark, monkeypatch):
    rng = np.random.default_rng(7)
    rows = [(int(g), float(t), float(p)) for g, t, p in zip(rng.integers(0, 3, 400), rng.normal(0, 1, 400), rng.integers(0, 12, 400), strict=True)]
    tables = []
    monkeypatch.setattr(association, "written", lambda df, name: tables.append(name) or shared.written(df, name))
    out = {r.g: r for r in metrics.with_pooled(spark.createDataFrame(rows, "g int, t double, p double"), lambda x, by: metrics.regression(x, "t", "p", by), "g").collect()}
    assert "pairs" not in tables and set(out) == {0, 1, 2, None}
    for g, r in out.items():
        own = np.array([(t, p) for k, t, p in rows if g is None or k == g])
        assert (r.n, r.rho) == (len(own), pytest.approx(plain_rho(own[:, 0], own[:, 1])[1], abs=1e-12))


def test_features_of_kernels_are_pooled_once(spark, sf_dir):
    files = catalogue._features(spark, sf_dir).inputFiles()
    assert files and not any("lineitem" in f for f in files)
