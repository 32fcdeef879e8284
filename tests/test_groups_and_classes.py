"""Stratified groups, support vectors for classes, and ablations of recordings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.config import Config
from tessera.errors import ConfigError
from tessera.operators import ablation, folds, kernels, models
from tessera.sources import audio, recordings
from tests.test_recordings import write_wav


def plain_groups(rows, k, seed, spark):
    """The greedy loop over all groups, one by one."""
    classes = sorted({y for _, y in rows})
    table = {}
    for g, y in rows:
        table.setdefault(g, np.zeros(len(classes)))[classes.index(y)] += 1
    keys = {r.g: r.key for r in spark.createDataFrame([(g,) for g in table], "g int").withColumn("key", folds.shuffle_key(seed, "g")).collect()}
    share, loads, out = sum(table.values()), np.zeros((k, len(classes))), {}
    for g in sorted(table, key=lambda g: (-round(float(np.std(table[g])), 9), tuple(-table[g]), keys[g], g)):
        costs = []
        for f in range(k):
            trial = loads.copy()
            trial[f] += table[g]
            costs.append((round(float((trial / share).std(0).mean()), 9), loads[f].sum(), f))
        out[g] = min(costs)[2]
        loads[out[g]] += table[g]
    return out


def test_stratified_groups_equal_the_greedy_loop(spark):
    rng = np.random.default_rng(0)
    rows = [(int(g), int(rng.random() < g / 40)) for g in rng.integers(0, 40, 600)] + [(100 + i, i % 2) for i in range(90)]
    d = spark.createDataFrame(rows, "g int, y int").repartition(3)
    assert {r.g: r.fold for r in folds.stratified_groups(d, 4, "g", "y", 3).collect()} == plain_groups(rows, 4, 3, spark)


def test_a_million_groups(spark, monkeypatch):
    d = spark.range(1_000_000).select((F.col("id") % 999_983).alias("g"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("y"))
    out = d.join(folds.stratified_groups(d, 5, "g", "y"), "g").groupBy("fold", "y").count().collect()
    counts = np.zeros((5, 3))
    for r in out:
        counts[r.fold, r.y] = r["count"]
    assert counts.sum() == 1_000_000 and (counts.std(0) / counts.mean(0)).max() < 0.002


def test_too_many_vectors_are_rounded(spark, monkeypatch):
    monkeypatch.setattr(folds, "VECTORS", 60)
    rng = np.random.default_rng(1)
    rows = [(g, y) for g in range(150) for y in (0, 1) for _ in range(int(rng.integers(1, 60)))]
    d = spark.createDataFrame(rows, "g int, y int")
    out = folds.stratified_groups(d, 3, "g", "y")
    assert out.count() == 150
    sizes = [r["count"] for r in d.join(out, "g").groupBy("fold", "y").count().collect()]
    assert len(sizes) == 6 and max(sizes) < 1.25 * min(sizes)


def rings(spark, n=600, classes=2):
    rng = np.random.default_rng(2)
    r, a = rng.integers(0, classes, n), rng.uniform(0, 2 * np.pi, n)
    x = (1 + 1.2 * r + rng.normal(0, 0.25, n))[:, None] * np.stack([np.cos(a), np.sin(a)], 1)
    return spark.createDataFrame([(float(p), float(q), "abc"[c]) for (p, q), c in zip(x, r, strict=True)], "p double, q double, c string").repartition(3)


@pytest.mark.parametrize("classes", [2, 3])
def test_support_vector_classes_with_probabilities(spark, tmp_path, classes):
    d = rings(spark, classes=classes)
    train, test = d.where("pmod(xxhash64(p), 3) > 0"), d.where("pmod(xxhash64(p), 3) = 0")
    model = models.fit(train, ["p", "q"], "c", "svc", "classification", {"features": 120, "gamma": 2.0, "c": 10.0})
    model.save(str(tmp_path / "m"), spark)
    rows = models.load(str(tmp_path / "m"), spark).predict(test).collect()
    p = np.array([[r[f"score_{c}"] for c in "abc"[:classes]] for r in rows])
    hit = np.array([r.c == r.predicted for r in rows])
    assert hit.mean() > 0.9 and np.allclose(p.sum(1), 1) and (p >= 0).all()
    truth = np.array([["abc".index(r.c) == k for k in range(classes)] for r in rows], float)
    brier = ((p - truth) ** 2).sum(1).mean()
    assert brier < 0.2 < ((truth.mean(0) - truth) ** 2).sum(1).mean()
    sure = p.max(1) > 0.9  # calibrated: the sure ones are right about as often as they say
    assert abs(hit[sure].mean() - p.max(1)[sure].mean()) < 0.06
    if classes == 2:
        line = models.fit(train, ["p", "q"], "c", "logistic", "classification").predict(test)
        assert np.mean([r.c == r.predicted for r in line.collect()]) < 0.7


def test_networks_do_not_depend_on_arrow_batches(spark):
    rng = np.random.default_rng(3)
    d = spark.createDataFrame([(*map(float, v), float(v[0] ** 2)) for v in rng.normal(size=(300, 2))], "a double, b double, y double").repartition(2).withColumn("k", F.lit(-1)).persist()
    key, found = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    before = spark.conf.get(key)
    for size in ("10000", "37"):
        spark.conf.set(key, size)
        found.append(kernels.Network(hidden=5).fit(d, ["a", "b"], "y", "k", [0])[0]["weights"])
    spark.conf.set(key, before)
    assert found[0] == found[1]


def test_ablation_of_recordings_keeps_its_frames(spark, tmp_path, monkeypatch, capsys):
    rng, rows = np.random.default_rng(4), []
    for i in range(12):
        t = np.arange(4000) / 8000
        write_wav(tmp_path / "w" / f"s{i % 4}" / f"{i}.wav", 0.3 * np.sin(2 * np.pi * (150 + 60 * i) * t) + 0.01 * rng.normal(size=4000))
        rows.append((str(tmp_path / "w" / f"s{i % 4}" / f"{i}.wav"), float(i) + rng.normal() / 4, f"s{i % 4}"))
    index = spark.createDataFrame(rows, "path string, target double, group string")
    d = folds.repeated(index, 3, 2, ["path"], 1)
    calls, plain = [], recordings.read_parts
    monkeypatch.setattr(recordings, "read_parts", lambda *a, **k: calls.append(a) or plain(*a, **k))
    features = ablation.recording_features(spark, str(tmp_path / "w"), d, str(tmp_path / "store"), audio.FrontEnd(mels=12, coefficients=6))
    points = ablation.expand_grid({"delta_order": [0, 2], "model": ["ridge", "linear"]})
    first = ablation.run(points, features, "target", ["fold_r0", "fold_r1"])
    assert first.count() == 4 * 2 * 3 and len(calls) == 1  # both delta orders share one front end
    again = ablation.run(points, features, "target", ["fold_r0", "fold_r1"])
    rows = lambda t: [r.rmse for r in t.orderBy("config_id", "repeat", "fold").collect()]
    assert rows(again) == pytest.approx(rows(first)) and len(calls) == 1
    index.write.parquet(str(tmp_path / "index"))
    (tmp_path / "c.yaml").write_text("ablation: {axes: {n_ceps: [4, 6]}}\nfrontend: {mels: 12}\ndata: {folds: 3}\n")
    pytest.importorskip("yaml")
    args = ["ablate", "--table", str(tmp_path / "index"), "--recordings", str(tmp_path / "w"), "--target", "target", "--config", str(tmp_path / "c.yaml"), "--out", str(tmp_path / "o")]
    assert cli.main(args) == 0
    assert spark.read.option("header", True).csv(str(tmp_path / "o" / "summary")).count() == 2


def test_configuration_of_models_and_front_ends():
    c = Config.from_dict({"model": {"name": "svc", "settings": {"c": 3.0}}, "frontend": {"preset": "compact", "low": 10.0}, "ablation": {"axes": {"n_ceps": [4, 8]}}})
    assert c.model_settings() == {"c": 3.0} and cli._front_end(c) == audio.PRESETS["compact"] and c.ablation.axes == {"n_ceps": [4, 8]}
    assert cli._front_end(Config.from_dict({"frontend": {"lifter": 0, "high": 3000.0}})) == audio.FrontEnd(lifter=0, high=3000.0)
    with pytest.raises(ConfigError):
        Config.from_dict({"model": {"inner": 1}})
