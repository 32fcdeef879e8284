"""Published and hand-computed values, and identities, of the statistics."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.errors import DatasetError, ModelFileError
from tessera.functions import special
from tessera.operators import ablation, association, diagnostics, folds, frames, linear, metrics, models, pooling
from tessera.sources import audio, tables


def test_tails():
    assert special.f_sf(4.0, 1, 20) == pytest.approx(0.0593, abs=1e-4)
    assert special.chi2_sf(5.0, 2) == pytest.approx(math.exp(-2.5))
    assert 2 * special.t_sf(2.228, 10) == pytest.approx(0.05, abs=1e-4)
    assert special.t_ppf(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert special.normal_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert math.isnan(special.t_sf(1.0, 0)) and special.t_sf(-1.0, 5) == pytest.approx(1 - special.t_sf(1.0, 5))


def test_frames_and_windows():
    assert [frames.frame_sizes(r) for r in (44100, 16000, 8000)] == [(1323, 661, 2048), (480, 240, 512), (240, 120, 256)]
    assert frames.window_weights("hamming_symmetric", 5) == pytest.approx([0.08, 0.54, 1, 0.54, 0.08])
    assert frames.lifter_weights(12, 22)[0] == pytest.approx(2.5655, abs=1e-4) and frames.lifter_weights(12, 22)[10] == pytest.approx(12)
    assert audio.cepstra(np.sin(np.arange(16000) * 0.05), 16000).shape == (65, 13)
    assert audio.cepstra(np.zeros(16000), 16000)[0, -1] == pytest.approx(math.sqrt(2 / 23) * 23 * math.log(1e-10))
    assert audio.cepstra(np.zeros(10), 16000).shape == (0, 13)
    assert (audio.htk_kind(), audio.htk_kind(delta_order=0)) == (8966, 8198)
    period, kind, v = audio.decode_htk(audio.encode_htk(np.arange(6.0).reshape(2, 3), 160, 16000, 6))
    assert (period, kind) == (100000, 6) and (v == np.arange(6.0).reshape(2, 3)).all()


def test_wav_source(spark, tmp_path):
    import wave

    (tmp_path / "a").mkdir()
    with wave.open(str(tmp_path / "a" / "x.WAV"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(16000)
        w.writeframes((np.sin(np.arange(32000) * 0.1) * 9000).astype("<i2").tobytes())
    (tmp_path / "broken.wav").write_bytes(b"none")
    (tmp_path / "notes.txt").write_text("no")
    d = audio.read_wav(spark, str(tmp_path)).persist()
    rows = {r.path.rsplit("/", 1)[1]: r for r in d.collect()}
    assert set(rows) == {"x.WAV", "broken.wav"} and rows["broken.wav"].error and len(rows["x.WAV"].signal) == 16000
    assert audio.cepstral_frames(d.where("error IS NULL")).count() == 65
    assert audio.list_audio(spark, str(tmp_path)).count() == 2


def test_pooling(spark):
    d = spark.createDataFrame([(1, 1.0, 10.0), (1, 2.0, 20.0), (1, 3.0, 60.0)], "k int, a double, b double")
    assert tuple(pooling.pool(d, ["k"], ["a", "b"], ["mean", "max"]).first()) == (1, 2.0, 30.0, 3.0, 60.0)
    flat = pooling.pool(spark.createDataFrame([(1, 5.0)] * 3, "k int, a double"), ["k"], ["a"], ["skew", "kurtosis"])
    assert tuple(flat.first()) == (1, 0.0, 0.0)
    with pytest.raises(ValueError, match="mean"):
        pooling.pool(d, ["k"], ["a"], ["mean"], normalization="cmn")


def test_cement(spark):
    d = tables.cement(spark)
    fit = linear.fit_ols(d, ["x1", "x2", "x3", "x4"], "heat")
    assert fit.beta == pytest.approx([62.4054, 1.5511, 0.5102, 0.1019, -0.1441], abs=1e-4)
    assert fit.stats["r2"] == pytest.approx(0.9824, abs=1e-4)
    m = linear.moments(d, ["x1", "x2", "x3", "x4"], "heat")
    assert linear.stepwise(m)[0] == ["x1", "x4"]
    assert [(s["action"], s["term"]) for s in linear.stepwise(m, 0.15, 0.15)[1]] == [("start", ""), ("enter", "x4"), ("enter", "x1"), ("enter", "x2"), ("remove", "x4")]
    assert linear.stepwise(m, start="full")[0] == ["x1", "x2"]
    beta, costs, status = linear.gradient_descent(linear.moments(d, ["x1", "x2"], "heat"), 0.5)
    assert status == "converged" and beta == pytest.approx(linear.fit_ols(d, ["x1", "x2"], "heat").beta, abs=1e-4)
    rows = np.array(d.select("x1", "x2", "x3", "x4").collect())
    inverse = np.linalg.inv(np.corrcoef(rows.T))
    assert [v for _, _, v in diagnostics.variance_inflation(m)] == pytest.approx(np.diag(inverse), rel=1e-6)
    assert diagnostics.condition_number(fit) == pytest.approx(np.linalg.cond(np.column_stack([np.ones(13), rows])), rel=1e-9)
    with pytest.raises(linear.DesignMatrixError):
        linear.fit_ols(d.withColumn("copy", d.x1 * 2), ["x1", "copy"], "heat")
    x = np.column_stack([np.ones(13), rows[:, :2]])
    h = np.diag(x @ np.linalg.inv(x.T @ x) @ x.T)
    two = linear.fit_ols(d, ["x1", "x2"], "heat")
    assert [r.leverage for r in diagnostics.influence(d, two, "heat").collect()] == pytest.approx(h, rel=1e-8)


def test_partial_f():
    f, p = linear.partial_f(120, 100, 20)
    assert (f, p) == (pytest.approx(4.0), pytest.approx(0.0593, abs=1e-4))
    assert linear.partial_f(1, 0, 5) == (math.inf, 0.0)


def test_press_equals_refits(spark):
    rng = np.random.default_rng(0)
    x = np.linspace(-2, 2, 20)
    y = x**2 + rng.normal(0, 0.3, 20)
    d = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    sweep = linear.order_sweep(d, "x", "y", 3)
    for row in sweep:
        e = [y[i] - np.polyval(np.polyfit(np.delete(x, i), np.delete(y, i), row["degree"]), x[i]) for i in range(20)]
        assert row["loocv_rmse"] == pytest.approx(math.sqrt(np.mean(np.square(e))), rel=1e-6)
    assert sweep[1]["bic"] < sweep[0]["bic"]


def test_agreement_and_correlation(spark):
    d = spark.createDataFrame([(float(v), float(v + 10)) for v in range(0, 101, 10)], "a double, b double")
    assert association.agreement(d, "a", "b").first().ccc == pytest.approx(0.9524, abs=1e-4)
    r = association.pearson_ci(d, "a", "b").first()
    assert (r.r, r.ci_low, r.ci_high, r.p_value) == (pytest.approx(1), pytest.approx(1), pytest.approx(1), pytest.approx(0, abs=1e-9))
    flat = spark.createDataFrame([(1.0, float(k)) for k in range(5)], "a double, b double")
    assert association.pearson_ci(flat, "a", "b").first().r is None


def test_adjustments(spark):
    d = spark.createDataFrame([(0, 0.01), (1, 0.04), (2, 0.03), (3, None)], "k int, p double")
    holm = association.adjust(d, "p", ["k"]).orderBy("k").collect()
    bh = association.adjust(d, "p", ["k"], "fdr_bh").orderBy("k").collect()
    assert [r.p_adjusted for r in holm] == [pytest.approx(0.03), pytest.approx(0.06), pytest.approx(0.06), None]
    assert [r.p_adjusted for r in bh] == [pytest.approx(0.03), pytest.approx(0.04), pytest.approx(0.04), None]


def test_diagnostics(spark):
    d = spark.createDataFrame([(float(v),) for v in (-2, -1, 0, 1, 2, 7)], "x double")
    jb, p = diagnostics.jarque_bera("x")
    assert tuple(d.agg(jb, p).first()) == (pytest.approx(1.1054, abs=1e-4), pytest.approx(0.5754, abs=1e-4))
    for values, want in (([1, -1, 1, -1], 3.0), ([1, 1, -1, -1], 1.0), ([0, 0], None)):
        e = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(values)], "g int, k int, e double")
        assert diagnostics.durbin_watson(e, "e", ["k"], ["g"]).first().durbin_watson == want
    w, p = diagnostics.shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert (w, p) == (pytest.approx(0.79, abs=0.01), pytest.approx(0.0067, abs=0.001))
    assert math.isnan(diagnostics.shapiro_wilk([1, 1, 1])[0])


def test_regression_metrics(spark):
    d = spark.createDataFrame(list(zip((10.0, 20.0, 30.0, 40.0), (12.0, 18.0, 33.0, 41.0), strict=True)), "t double, p double")
    r = metrics.regression(d, "t", "p").first()
    assert (r.mae, r.rmse, r.r2, r.r, r.rho, r.ccc) == tuple(pytest.approx(v, abs=1e-3) for v in (2.0, 2.121, 0.964, 0.987, 1.0, 0.983))
    assert metrics.regression(d.limit(1), "t", "p").first().r2 is None


def test_classification_metrics(spark):
    d = spark.createDataFrame([("a", "a", 0.1), ("a", "b", 0.6), ("b", "b", 0.9), ("b", "b", 0.8)], "t string, p string, s double")
    r = metrics.classification(d, "t", "p", "b", "s").first()
    assert (r.accuracy, r.uar, r.sensitivity, r.specificity, r.auc) == (0.75, 0.75, 1.0, 0.5, 1.0) and r.macro_f1 == pytest.approx(0.733, abs=1e-3)
    one = metrics.classification(d.where("t = 'a'"), "t", "p", "b", "s").first()
    assert one.sensitivity is None and one.auc is None
    assert {r["class"]: r.precision for r in metrics.per_class(spark.createDataFrame([("a", "c")], "t string, p string"), "t", "p").collect()} == {"a": 0.0, "c": 0.0}


def test_ablation(spark):
    grid = ablation.expand_grid({"model": ["ridge", "svr"], "n": [6, 12], "fixed": [1]})
    assert [g["config_id"] for g in grid] == ["model=ridge|n=6", "model=ridge|n=12", "model=svr|n=6", "model=svr|n=12"]
    assert ablation.expand_grid({"a": [1]})[0]["config_id"] == "baseline"
    assert ablation.wilcoxon_p(range(1, 9)) == pytest.approx(0.0078, abs=1e-4) and ablation.wilcoxon_p([0, 0]) == 1.0
    rows = [(c, r, f, 80, 20, 10.0 + f + (0 if c == "base" else d)) for r in (1, 2) for f in range(2) for c, d in (("base", 0), ("b", 1 + f + r))]
    d = spark.createDataFrame(rows, "config_id string, repeat int, fold int, n_train int, n_test int, rmse double")
    r = ablation.compare_to_baseline(d, "rmse", "base").first()
    assert (r.config_id, r.mean_diff, r.better, r.j) == ("b", 3.0, False, 4)
    zero = spark.createDataFrame([("c", 0.0, 80, 20)] * 3, "config_id string, diff double, n_train int, n_test int")
    t = ablation.corrected_t(zero, "diff", "n_train", "n_test", ["config_id"]).first()
    assert (t.t, t.p_value) == (0.0, 1.0)


def test_folds(spark):
    d = spark.range(103).withColumnRenamed("id", "k").selectExpr("k", "k % 7 AS g", "k % 2 AS y")
    sizes = [r["count"] for r in folds.shuffled(d, 5, ["k"]).groupBy("fold").count().collect()]
    assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1
    strat = folds.stratified(d, 5, "y", ["k"]).groupBy("fold", "y").count().collect()
    assert max(r["count"] for r in strat) - min(r["count"] for r in strat) <= 1
    g = folds.grouped(spark.createDataFrame([(f"g{i}",) for i, n in enumerate((5, 1, 3, 3, 2, 4, 1)) for _ in range(n)], "g string"), 3, "g").collect()
    loads = {}
    for r in g:
        loads[r.fold] = loads.get(r.fold, 0) + r.n
    assert len(g) == 7 and max(loads.values()) - min(loads.values()) <= 1
    assert {r.fold for r in folds.stratified_groups(d, 3, "g", "y").collect()} == {0, 1, 2}
    with pytest.raises(ValueError):
        folds.check(d, 9, group="g")


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 3)) * [1, 10, 0.1] + 3
    y = x @ [1, 2, 3] + rng.normal(size=50)
    d = spark.createDataFrame([(*map(float, r), float(v)) for r, v in zip(x, y, strict=True)], "a double, b double, c double, y double")
    m = linear.moments(d, ["a", "b", "c"], "y")
    b0, b = linear.ridge(m.total, m, 2.0)
    z = x - x.mean(0)
    want = np.linalg.solve(z.T @ z + 2 * np.eye(3), z.T @ (y - y.mean()))
    assert b == pytest.approx(want) and b0 == pytest.approx(y.mean() - want @ x.mean(0))


@pytest.fixture(scope="module")
def curved(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(-2, 2, (240, 2))
    y = np.sin(x[:, 0]) + x[:, 1] ** 2
    rows = [(i, *map(float, r), float(v), "high" if v > 1.2 else "low", i % 3) for i, (r, v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "k int, a double, b double, y double, label string, fold int").repartition(3, "k").persist()


def test_kernels_learn(curved):
    for name in ("svr", "mlp"):
        r = models.evaluated(models.cross_validate(curved, ["a", "b"], "y", name), "y").collect()
        pooled = next(x for x in r if x.fold is None)
        assert len(r) == 4 and pooled.n == 240 and pooled.r > 0.95, name


@pytest.mark.parametrize(("name", "task", "y"), [("linear", "regression", "y"), ("ridge", "regression", "y"), ("svr", "regression", "y"), ("random_forest", "regression", "y"), ("logistic", "classification", "label"), ("mlp", "classification", "label")])
def test_models_round_trip(curved, spark, tmp_path, name, task, y):
    settings = {"trees": 10, "depth": 6} if name == "random_forest" else {}
    model = models.fit(curved, ["a", "b"], y, name, task, settings)
    model.save(str(tmp_path / "m"), spark)
    again = models.load(str(tmp_path / "m"), spark)
    both = model.predict(curved).select("k", F.col("predicted").alias("p")).join(again.predict(curved), "k").where("p = predicted")
    assert both.count() == 240
    if task == "classification":
        r = again.predict(curved).first()
        assert r.score_high + r.score_low == pytest.approx(1)
    with pytest.raises(ValueError, match="missing"):
        model.predict(curved.drop("a"))


def test_models_refuse(curved, spark, tmp_path):
    with pytest.raises(ModelFileError):
        models.load(str(tmp_path / "nothing"), spark)
    for name, task, reducer in (("logistic", "regression", "none"), ("ridge", "nothing", "none"), ("ridge", "regression", "lda")):
        with pytest.raises(ValueError):
            models.check(name, task, reducer)


def test_reducers(curved):
    rows = np.array(curved.select("a", "b").collect())
    z = (rows - rows.mean(0)) / rows.std(0)
    p = models.principal_directions(linear.moments(curved, ["a", "b"], "y"), 1)
    want = np.linalg.svd(z - z.mean(0), full_matrices=False)[2][0]
    assert abs(float(p[:, 0] @ want)) == pytest.approx(1, abs=1e-6)
    assert models.principal_directions(linear.moments(curved, ["a", "b"], "y")).shape == (2, 2)
    r = models.evaluated(models.cross_validate(curved, ["a", "b"], "label", "logistic", "classification", reducer="lda", components=1), "label", "classification", positive="high", score="score_high")
    assert r.where("fold IS NULL").first().auc > 0.5 and r.count() == 4


def test_ridge_cv_equals_refits(curved):
    a = models.cross_validate(curved, ["a", "b"], "y", "linear").orderBy("k").collect()
    rows = np.array([(r.a, r.b, r.y, r.fold) for r in a])
    for f in range(3):
        train, test = rows[rows[:, 3] != f], rows[rows[:, 3] == f]
        b = np.linalg.lstsq(np.column_stack([np.ones(len(train)), train[:, :2]]), train[:, 2], rcond=None)[0]
        assert [r.predicted for r in a if r.fold == f] == pytest.approx(b[0] + test[:, :2] @ b[1:])


def test_tuning_takes_the_best(curved):
    model, tried = models.tune(curved, ["a", "b"], "y", "ridge", grid={"alpha": (0.1, 1e6)})
    assert model.settings == {"alpha": 0.1} and len(tried) == 2 and tried[0]["score"] < tried[1]["score"]


def test_ablation_run(curved, spark):
    points = ablation.expand_grid({"model": ["linear", "ridge"], "statistics": [("mean",)]})
    assert ablation.problems({"model": ["ridge"]}) == [] and len(ablation.problems({"model": ["nope"], "reducer": ["lda"], "n_ceps": [23], "statistics": [("mean",)]}, metric="uar", normalization="cmn")) == 5
    d = folds.repeated(curved.drop("fold"), 3, 2, ["k"])
    table = ablation.run(points, lambda p: (d, ["a", "b"]), "y", ["fold_r0", "fold_r1"]).persist()
    assert table.count() == 12 and {r.n_train + r.n_test for r in table.collect()} == {240}
    r = ablation.compare_to_baseline(table, "rmse", "model=linear").first()
    assert r.j == 6 and 0 <= r.p_wilcoxon <= r.p_wilcoxon_adjusted <= 1


def test_tables(spark):
    d = spark.createDataFrame([("a.wav", "1.5", None), ("b.wav", "x", "g")], "path string, y string, group string")
    with pytest.raises(DatasetError, match="b.wav"):
        tables.load_index(d, "y")
    assert tables.load_index(d.where("y <> 'x'"), "y").first().group == ""
    with pytest.raises(DatasetError, match="repeated"):
        tables.load_index(d.where("y <> 'x'").unionAll(d.where("y <> 'x'")), "y")
    files = spark.createDataFrame([("s/a.wav",), ("t/a.wav",), ("t/c.wav",)], "path string")
    ids = spark.createDataFrame([("s/a",), ("a",), ("c",), ("d",)], "id string")
    assert {r.id: r.status for r in tables.match_ids(ids, files).collect()} == {"s/a": "matched", "a": "ambiguous", "c": "matched", "d": "unmatched"}
    raw = spark.createDataFrame([("1", "x", "2"), ("2", "y", "4"), ("3", "z", "6"), ("4", "w", None)], "a string, label string, y string")
    out, names = tables.analysis_table(raw, "y")
    assert names == ["a"] and out.count() == 3


def test_dealt_equals_a_plain_loop():
    rng = np.random.default_rng(0)
    for _ in range(300):
        k = int(rng.integers(2, 6))
        loads = [int(v) for v in rng.integers(0, 40, k)]
        size, n = int(rng.integers(1, 12)), int(rng.integers(1, 60))
        want, plain = [], list(loads)
        for _ in range(n):
            f = min(range(k), key=lambda f: (plain[f], f))
            plain[f] += size
            want.append(f)
        runs = folds.dealt(loads, size, n)
        got = []
        for i in range(n):
            start, turn = [r for r in runs if r[0] <= i][-1]
            got.append(turn[(i - start) % len(turn)])
        assert got == want and loads == plain


def test_seeds_and_groups(spark):
    assert folds.repeat_seeds(0, 3) == folds.repeat_seeds(0, 3) and len(set(folds.repeat_seeds(0, 3))) == 3
    assert not folds.has_groups(spark.createDataFrame([(" ",), (None,)], "g string"), "g") and folds.has_groups(spark.createDataFrame([("a",)], "g string"), "g")
    with pytest.raises(ValueError):
        folds.shuffled(spark.range(3), 5, ["id"])


def test_ranks_equal_plain(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, 500) / 4
    d = spark.createDataFrame([(int(i % 3), float(v), float(rng.normal() + v)) for i, v in enumerate(x)], "g int, x double, y double")
    pdf = d.toPandas()
    for by in ([], ["g"]):
        groups = [pdf] if not by else [g for _, g in pdf.groupby("g")]
        want = sorted(g.x.rank().corr(g.y.rank()) for g in groups)
        assert sorted(r.rho for r in association.spearman(d, "x", "y", by, p_value=False).collect()) == pytest.approx(want)


def test_pairs_and_approximate_percentiles(spark):
    d = spark.createDataFrame([(1, float(k), float(-k)) for k in range(101)], "g int, x double, y double")
    assert association.check_pairs(d, "x", "y") == 101
    for bad in (d.limit(2), d.withColumn("x", F.lit(float("nan"))), d.withColumn("y", F.lit(None).cast("double"))):
        with pytest.raises(ValueError):
            association.check_pairs(bad, "x", "y")
    r = pooling.pool(d, ["g"], ["x"], (), (10, 50), accuracy=1000).first()
    assert (r.p10_x, r.p50_x) == (10, 50)


def test_stepwise_rules(spark):
    m = linear.moments(tables.cement(spark), ["x1", "x2", "x3", "x4"], "heat")
    _, steps = linear.stepwise(m)
    assert steps[0]["action"] == "start" and math.isnan(steps[0]["f"]) and [s["n_terms"] for s in steps] == [0, 1, 2] and steps[-1]["r2"] == pytest.approx(0.9725, abs=1e-4)
    for bad in ((0.5, 0.05), (0.0, 0.1), (0.1, 1.0)):
        with pytest.raises(ValueError):
            linear.stepwise(m, *bad)
    assert linear.stepwise(m, max_steps=1)[0] == ["x4"]


def test_no_intercept(spark):
    d = spark.createDataFrame([(1.0, 2.0, 3.1), (2.0, 1.0, 3.9), (3.0, 5.0, 9.2), (4.0, 1.0, 6.1)], "a double, b double, y double")
    fit = linear.fit_ols(d, ["a", "b"], "y", intercept=False)
    x, y = np.array([(1, 2), (2, 1), (3, 5), (4, 1)], float), np.array([3.1, 3.9, 9.2, 6.1])
    b = np.linalg.lstsq(x, y, rcond=None)[0]
    assert fit.beta == pytest.approx([0, *b]) and fit.stats["tss"] == pytest.approx((y**2).sum()) and fit.stats["rss"] == pytest.approx(((y - x @ b) ** 2).sum())
    assert [r[0] for r in d.select(fit.predicted()).collect()] == pytest.approx(x @ b) and "no degrees" not in fit.summary()
    with pytest.raises(ValueError, match="columns"):
        fit.predicted(["a"])


def test_descent_without_standardising(spark):
    d = spark.createDataFrame([(float(k), 2.0 * k + 1) for k in range(5)], "x double, y double")
    m = linear.moments(d, ["x"], "y")
    got = linear.gradient_descent(m, 0.1, 1e-16, 50_000, standardize=False)
    assert got.beta == pytest.approx([1, 2], abs=1e-4) and [r[0] for r in d.select(got.predicted()).collect()] == pytest.approx([1, 3, 5, 7, 9], abs=1e-3)
    assert linear.gradient_descent(m, 0.1, 1e-15, intercept=False).beta[0] == 0 and linear.gradient_descent(m, 5.0).status == "diverged"


def test_variance_inflation_of_one_collinear_pair(spark):
    rng = np.random.default_rng(0)
    d = spark.createDataFrame([(float(a), float(2 * a + 1), float(b), float(c)) for a, b, c in rng.normal(size=(40, 3))], "a double, b double, c double, y double")
    v = {n: x for n, _, x in diagnostics.variance_inflation(linear.moments(d, ["a", "b", "c"], "y"))}
    assert v["a"] == v["b"] == math.inf and v["c"] < 2


def test_reports(spark):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(i, float(a), float(2 * a + e)) for i, (a, e) in enumerate(rng.normal(size=(60, 2)))], "k int, x double, y double")
    fit = linear.fit_ols(d, ["x"], "y")
    r = diagnostics.residual_report(d, fit, "y", ["k"]).first()
    residuals = [x[0] for x in d.orderBy("k").select(F.col("y") - fit.predicted()).collect()]
    w, p = diagnostics.shapiro_wilk(residuals)
    assert (r.n, r.shapiro_w, r.shapiro_p) == (60, pytest.approx(w), pytest.approx(p)) and r.residual_mean == pytest.approx(0, abs=1e-9) and 0 <= r.breusch_pagan_p <= 1
    table = diagnostics.influence_table(d, fit, "y", ["k"]).orderBy("residual").collect()
    q = [x.normal_quantile for x in table]
    assert q == sorted(q) and q[0] == pytest.approx(special.normal_ppf(0.625 / 60.25))
    roc = metrics.roc_curve(d.selectExpr("x > 0 AS pos", "y"), F.col("pos"), "y", cap=1.0).orderBy("fpr", "tpr").collect()
    assert (roc[0].fpr, roc[0].tpr, roc[-1].fpr, roc[-1].tpr) == (0, 0, 1, 1) and len(roc) == 61
    three = spark.createDataFrame([("a", "a"), ("b", "b"), ("c", "a")], "t string, p string")
    assert metrics.classification(three, "t", "p", "a").first().sensitivity is None


def test_shapiro_wilk_of_a_large_user(spark, tmp_path):
    from tessera.plans import catalogue

    d = spark.range(6002).selectExpr("if(id < 2, 2, 1) AS user_id", "id AS event_id", "-ln((id + 1) / 6003.0) AS value")
    d.write.parquet(str(tmp_path / "events.parquet"))
    out = {r.user_id: r for r in catalogue.queries()["shapiro_wilk_by_user"](spark, str(tmp_path)).collect()}
    assert out[1].n == 6000 and 0.7 < out[1].w < 0.9 and out[1].p_value < 1e-6 and out[2].w is None
