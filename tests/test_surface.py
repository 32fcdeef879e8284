"""Configuration, sinks, command line and streams."""

import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import cli
from tessera.config import Config, coerce
from tessera.errors import ConfigError, DatasetError
from tessera.operators import linear
from tessera.sources import audio, sinks, tables
from tessera.streaming import windows


def test_config():
    assert Config.from_yaml("") == Config()
    assert Config.from_dict({"pooling": {"statistics": ["mean"]}}).pooling.statistics == ("mean",)
    for bad in ({"pooling": {"normalization": "x"}}, {"nope": 1}, {"data": {"nope": 1}}, {"data": {"folds": 1}}):
        with pytest.raises(ConfigError):
            Config.from_dict(bad)
    assert [coerce(t) for t in ("true", "None", "3", "[1]", "word")] == [True, None, 3, [1], "word"]


def test_sinks(spark, tmp_path):
    sinks.write_json(tmp_path / "a.json", {"x": math.nan, "y": (1, 2.5)})
    assert (tmp_path / "a.json").read_text() == '{\n  "x": null,\n  "y": [\n    1,\n    2.5\n  ]\n}\n'
    d = spark.range(3)
    sinks.save_features(d, str(tmp_path / "f"), Config().to_dict())
    back, config = sinks.load_features(spark, str(tmp_path / "f"), Config().to_dict(), ["frontend", "pooling"])
    assert back.count() == 3 and config["model"]["name"] == "ridge"
    with pytest.raises(DatasetError, match="pooling"):
        sinks.load_features(spark, str(tmp_path / "f"), Config().override({"pooling": {"normalization": "cmn", "statistics": ["std"]}}).to_dict(), ["pooling"])
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "abc").write_text("abc")
    assert sinks.manifest(spark, {}, [str(tmp_path / "in")])["inputs"][0]["sha256"].startswith("ba7816bf")
    folder = sinks.run_folder(tmp_path, "run")
    assert folder.exists()
    sinks.save_run(spark, folder, Config().to_dict(), [str(tmp_path / "in")], {"note": 1})
    assert Config.from_yaml((folder / "config.yaml").read_text()) == Config() and json.loads((folder / "manifest.json").read_text())["details"] == {"note": 1}
    assert spark.read.parquet(str(folder / "inputs")).first().sha256.startswith("ba7816bf")


def test_command_line(spark, tmp_path, capsys):
    table = str(tmp_path / "t")
    tables.cement(spark).write.parquet(table)
    assert cli.main(["regress", "--table", table, "--target", "heat", "--out", str(tmp_path / "o")]) == 0
    assert json.loads(capsys.readouterr().out)["stats"]["r2"] == pytest.approx(0.9824, abs=1e-4)
    assert cli.main(["stepwise", "--table", table, "--target", "heat"]) == 0
    assert json.loads(capsys.readouterr().out)["selected"] == ["x1", "x4"]
    assert cli.main(["evaluate", "--table", table, "--target", "heat", "--set", "data.folds=3", "--out", str(tmp_path / "e")]) == 0
    capsys.readouterr()
    assert cli.main(["train", "--table", table, "--target", "heat", "--set", "model.name=ridge", "--set", "model.tune=true", "--set", "data.folds=3", "--out", str(tmp_path / "m")]) == 0
    assert len(json.loads(capsys.readouterr().out)["tried"]) == 5
    assert cli.main(["predict", "--table", table, "--model", str(tmp_path / "m"), "--out", str(tmp_path / "p")]) == 0
    assert spark.read.parquet(str(tmp_path / "p")).where("predicted IS NOT NULL").count() == 13
    assert cli.main(["diagnose", "--table", table, "--target", "heat", "--out", str(tmp_path / "d")]) == 0
    capsys.readouterr()
    ordered = str(tmp_path / "s.csv")
    rows = [r.asDict() for r in tables.cement(spark).collect()]
    (tmp_path / "s.csv").write_text("\n".join([",".join(rows[0]), *[",".join(map(str, r.values())) for r in rows]]))
    assert cli.main(["diagnose", "--table", ordered, "--target", "heat", "--columns", "x1,x2", "--out", str(tmp_path / "d2")]) == 0
    report = json.loads(capsys.readouterr().out)
    fit = linear.fit_ols(tables.cement(spark), ["x1", "x2"], "heat")
    e = np.array([r["heat"] - fit.beta[0] - fit.beta[1] * r["x1"] - fit.beta[2] * r["x2"] for r in rows])
    assert report["residuals"]["durbin_watson"] == pytest.approx((np.diff(e) ** 2).sum() / (e**2).sum()) and report["condition_number"] == pytest.approx(fit.stats["condition_number"])
    influence = sorted(spark.read.option("header", True).csv(str(tmp_path / "d2")).collect(), key=lambda r: int(r.row))
    assert [float(r.residual) for r in influence] == pytest.approx(list(e))
    assert cli.main(["evaluate", "--table", table, "--target", "heat", "--set", "data.folds=3", "--set", "model.tune=true", "--set", "model.inner=2", "--out", str(tmp_path / "e2")]) == 0
    assert len(json.loads(capsys.readouterr().out)["tuned"]) == 3
    assert cli.main(["descend", "--table", table, "--target", "heat"]) == 0
    assert cli.main(["ablate", "--table", table, "--target", "heat", "--set", "data.folds=3", "--out", str(tmp_path / "a")]) == 0
    assert cli.main(["predict", "--table", table, "--model", str(tmp_path / "nothing")]) == 2
    assert cli.main(["synthesize", "--table", "collinear", "--out", str(tmp_path / "c")]) == 0 and cli.main(["synthesize", "--table", "nope"]) == 2
    assert cli.main(["evaluate", "--table", table, "--target", "heat", "--set", "model.name=logistic"]) == 2
    assert cli.main(["regress", "--table", table, "--target", "nope"]) == 2
    assert cli.main(["regress", "--table", table, "--target", "heat", "--set", "analysis.nope=1"]) == 2


def test_recordings(spark, tmp_path, capsys):
    """Float and 24-bit files, deltas of every recording, exports and their readers."""
    tone = np.sin(np.arange(16000) * 0.1)
    (tmp_path / "w").mkdir()
    for name, kind, bits, data in (("f.wav", 3, 32, tone.astype("<f4").tobytes()), ("i.wav", 1, 24, (tone * 2**22).astype("<i4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()), ("s.wav", 1, 16, b"\0" * 40), ("n.wav", 3, 32, np.full(9, np.nan, "<f4").tobytes())):
        head = struct.pack("<HHIIHH", kind, 1, 16000, 16000 * bits // 8, bits // 8, bits)
        (tmp_path / "w" / name).write_bytes(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(data)) + data)
    d = audio.read_wav(spark, str(tmp_path / "w")).persist()
    assert {r.path.rsplit("/", 1)[1]: r.status for r in audio.extraction_status(d).collect()} == {"f.wav": "ok", "i.wav": "ok", "s.wav": "too_short", "n.wav": "error"}
    assert np.allclose(next(r.signal for r in d.collect() if r.path.endswith("i.wav")), tone / 2, atol=1e-6)
    names = audio.frame_columns(audio.FrontEnd(), 2)
    frames = audio.frame_features(d.where("error IS NULL")).persist()
    assert frames.columns == ["path", "frame", *names] and len(names) == 39 and frames.count() == 130
    with pytest.raises(DatasetError, match="s.wav"):
        audio.utterance_features(d.where("error IS NULL"))
    one = d.where("path LIKE '%f.wav'")
    assert len(audio.utterance_features(one).columns) == 79
    assert one.select(F.size(audio.trimmed(F.col("signal"), F.col("sample_rate"), 0.1)).alias("n")).first().n == 12800
    audio.export_frames(frames, names, str(tmp_path / "htk"), "htk")
    (tmp_path / "h").mkdir()
    for k, r in enumerate(spark.read.parquet(str(tmp_path / "htk")).collect()):
        (tmp_path / "h" / f"{k}.htk").write_bytes(r.content)
    assert audio.read_htk(spark, str(tmp_path / "h")).count() == 130
    audio.export_frames(frames, names, str(tmp_path / "lines"), "text")
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("\n".join(r.line for r in spark.read.parquet(str(tmp_path / "lines")).orderBy("path", "frame").collect()))
    text = {r.frame: r.v for r in audio.read_text_frames(spark, str(tmp_path / "t"), 40).collect()}
    assert {len(v) for v in text.values()} == {39} and sorted(text) == list(range(130))
    (tmp_path / "t" / "b.htk").write_bytes(next((tmp_path / "h").iterdir()).read_bytes())
    both = audio.load_frames(spark, str(tmp_path / "t")).groupBy("path").count().collect()
    assert sorted(r["count"] for r in both) == [65, 130]
    assert audio.PRESETS["htk_c0"] == audio.FrontEnd() and audio.cepstra(tone, 16000, audio.PRESETS["compact"]).shape[1] == 13
    assert cli.main(["extract", "--table", str(tmp_path / "w"), "--out", str(tmp_path / "x")]) == 0
    assert json.loads(capsys.readouterr().out) == {"ok": 2, "too_short": 1, "error": 1}


def test_toy_tables(spark):
    assert linear.fit_ols(tables.quadratic_surface_table(spark, 40, 0.0), ["x1", "x2"], "y").stats["n"] == 40
    basis = linear.PolynomialBasis.fit(tables.polynomial_table(spark, noise=0.0), "x", 3)
    raw = linear.fit_ols(basis.transform(tables.polynomial_table(spark, noise=0.0), "x", "raw"), ["p1", "p2", "p3"], "y")
    assert raw.beta == pytest.approx([1, -2, 0, 0.5], abs=1e-8)
    shares = tables.collinear_table(spark)
    assert shares.where("p1 + p2 + p3 + p4 BETWEEN 98 AND 100").count() == 40
    d = spark.createDataFrame([(2, "b"), (1, "c"), (3, "b"), (4, "a")], "k int, v string")
    assert [r.v for r in tables.first_appearance(d, "v", ["k"]).collect()] == ["c", "b", "a"]
    assert tables.tagged_union({"x": d, "y": d}).groupBy("run").count().count() == 2
    files = spark.createDataFrame([("a/x.wav",), ("a/y.wav",), ("b/z.wav",)], "path string")
    of = lambda *ids: tables.match_ids(spark.createDataFrame([(i,) for i in ids], "id string"), files)
    assert [r.path for r in tables.check_matches(of("x", "z"), files).collect()] == ["a/y.wav"]
    for ids, what in ((("x", "a/x"), "several ids"), (("x", "x"), "repeated ids: x"), (("x", "q"), "unmatched ids: q")):
        with pytest.raises(DatasetError, match=what):
            tables.check_matches(of(*ids), files)
    grid = linear.evaluation_grid(spark, (0, 1), (1, 3), 3).collect()
    assert sorted(map(tuple, grid)) == [(a, b) for a in (0.0, 0.5, 1.0) for b in (1.0, 2.0, 3.0)]
    surface, fit = linear.response_surface(tables.quadratic_surface_table(spark, 60, 0.0), ["x1", "x2"], "y", 4)
    b = tables.SURFACE
    for r in surface.collect():
        assert r.fitted == pytest.approx(b[0] + b[1] * r.x1 + b[2] * r.x2 + b[3] * r.x1**2 + b[4] * r.x2**2 + b[5] * r.x1 * r.x2, abs=1e-8)
    assert surface.count() == 16 and fit.stats["r2"] == pytest.approx(1)
    assert linear.recommended([{"degree": 1, "bic": 2.0}, {"degree": 2, "bic": 2.0}, {"degree": 3, "bic": math.nan}]) == 1


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", events_time()).select("ts", "event_type", "value")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = windows.pooled_windows(stream, "ts", ["value"], "1 day", "12 hours", "60 days", ["event_type"]).writeStream.format("memory").queryName("pooled").outputMode("complete")
    q.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    want = windows.pooled_windows(events, "ts", ["value"], "1 day", "12 hours", keys=["event_type"])
    assert spark.table("pooled").select("window_start", "event_type", "n").exceptAll(want.select("window_start", "event_type", "n")).count() == 0
    assert spark.table("pooled").count() == want.count()


def events_time():
    from pyspark.sql import functions as F

    return F.col("ts").cast("timestamp")
