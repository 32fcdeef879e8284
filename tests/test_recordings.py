"""Data sources by byte ranges, the mirrored tree of frame files, and the store of frames."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.sources import audio, recordings

RATE = 8000


def write_wav(path, x, rate=RATE, channels=1, extra=b""):
    path.parent.mkdir(parents=True, exist_ok=True)
    data = np.repeat((x * 32767).astype("<i2")[:, None], channels, 1).tobytes()
    head = struct.pack("<HHIIHH", 1, channels, rate, rate * 2 * channels, 2 * channels, 16)
    path.write_bytes(b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<I", 16) + head + extra + b"data" + struct.pack("<I", len(data)) + data)


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    rng = np.random.default_rng(0)
    write_wav(root / "one" / "a.wav", rng.uniform(-0.5, 0.5, 9000), extra=b"LIST" + struct.pack("<I", 3) + b"abc\0")
    write_wav(root / "two" / "deep" / "b.WAV", rng.uniform(-0.5, 0.5, 5000), channels=2)
    write_wav(root / "tiny.wav", np.zeros(50))
    (root / "broken.wav").write_bytes(b"RIFF....garbage")
    (root / "one" / "notes.txt").write_text("no")
    return root


@pytest.mark.parametrize("size", [1000, 7001, 1 << 20])
def test_parts_are_the_whole_file(spark, corpus, size):
    whole = {r.path.removeprefix("file:"): r for r in audio.read_wav(spark, str(corpus)).collect()}
    parts = recordings.register(spark).read.format("wav").option("partbytes", size).load(str(corpus)).collect()
    assert {p.path for p in parts} == set(whole)
    for path, r in whole.items():
        own = sorted((p for p in parts if p.path == path), key=lambda p: p.start or 0)
        if r.error:
            assert {bool(p.error) for p in own} == {True}
            continue
        assert np.concatenate([p.signal for p in own]).tolist() == r.signal and {(p.sample_rate, p.n_samples) for p in own} == {(r.sample_rate, len(r.signal))}
        assert [p.previous for p in own] == [r.signal[p.start - 1] if p.start else None for p in own]
    if size == 1000:
        assert recordings.register(spark).read.format("wav").option("partbytes", size).load(str(corpus)).rdd.getNumPartitions() > 20


@pytest.mark.parametrize("size", [1500, 1 << 20])
def test_frames_of_parts_equal_those_of_whole_files(spark, corpus, size):
    plain = {(r.path.removeprefix("file:"), r.frame): r.v for r in audio.cepstral_frames(audio.read_wav(spark, str(corpus)).where("error IS NULL")).collect()}
    got = {(r.path, r.frame): r.v for r in recordings.part_frames(recordings.read_parts(spark, str(corpus), part_bytes=size)).collect()}
    assert got.keys() == plain.keys() and len(got) > 50
    assert np.allclose([got[k] for k in plain], list(plain.values()), atol=1e-12)


def test_trimmed_signals(spark, corpus):
    rows = recordings.register(spark).read.format("wav").option("trim", 0.1).option("partbytes", 2000).load(str(corpus / "one")).orderBy("start").collect()
    whole = audio.read_wav(spark, str(corpus / "one")).first().signal
    assert np.concatenate([r.signal for r in rows]).tolist() == whole[800:-800] and rows[0].n_samples == 9000 - 1600
    (row,) = recordings.register(spark).read.format("wav").option("trim", 0.1).load(str(corpus / "tiny.wav")).collect()
    assert "0.1 s" in row.error


@pytest.mark.parametrize("kind", ["htk", "text"])
def test_outputs_mirror_the_tree(spark, corpus, tmp_path, kind):
    out = tmp_path / "out"
    table = {r.path: r for r in recordings.extract_tree(spark, str(corpus), str(out), kind=kind, part_bytes=3000).collect()}
    assert {p: r.status for p, r in table.items()} == {"broken.wav": "error", "one/a.wav": "ok", "two/deep/b.WAV": "ok", "tiny.wav": "too_short"}
    assert table["broken.wav"].message and table["broken.wav"].output == "" and table["tiny.wav"].message == "shorter than one frame"
    frames = audio.frame_features(audio.read_wav(spark, str(corpus)).where("error IS NULL")).orderBy("path", "frame").collect()
    for path in ("one/a.wav", "two/deep/b.WAV"):
        want = np.array([list(r)[2:] for r in frames if r.path.endswith(path)])
        file = out / table[path].output
        assert file.parent == (out / path).parent and table[path].n_frames == len(want) and table[path].n_dims == 39
        if kind == "text":
            assert np.allclose(np.loadtxt(file), want, rtol=1e-7)
        else:
            period, htk, v = audio.decode_htk(file.read_bytes())
            assert (period, htk) == (150_000, 8966) and np.allclose(v, want, rtol=1e-4, atol=1e-4)
    assert sorted(p.name for p in out.iterdir() if not p.name.startswith(("_status", "."))) == ["one", "two"]
    if kind == "htk":
        back = recordings.register(spark).read.format("htk").option("partbytes", 700).load(str(out))
        assert back.rdd.getNumPartitions() > 5 and back.count() == len(frames)
        read = {(r.path, r.frame): r.v for r in back.collect()}
        assert np.allclose([read[(str(out / table["one/a.wav"].output), k)] for k in range(table["one/a.wav"].n_frames)], [list(r)[2:] for r in frames if r.path.endswith("one/a.wav")], rtol=1e-4, atol=1e-4)


def test_a_failed_task_leaves_nothing_behind(spark, tmp_path):
    recordings.register(spark)
    rows = [(f"d/{k}.htk", 1, RATE, 0, [1.0, 2.0]) for k in range(6)] + [("d/bad.htk", 1, RATE, 0, None)]
    d = spark.createDataFrame(rows, "output string, frames int, rate int, frame int, v array<double>").repartition("output").sortWithinPartitions("output", "frame")
    out = tmp_path / "out"
    with pytest.raises(Exception, match="."):
        d.write.format("framefiles").mode("append").save(str(out))
    assert not out.exists() or not [p for p in out.rglob("*") if p.is_file()]
    d.where("v IS NOT NULL").write.format("framefiles").mode("append").save(str(out))
    assert sorted(p.name for p in out.rglob("*") if p.is_file()) == [f"{k}.htk" for k in range(6)]


def test_the_store_computes_a_frame_once(spark, corpus, tmp_path, monkeypatch):
    import shutil

    root, store = tmp_path / "in", str(tmp_path / "store")
    shutil.copytree(corpus, root)
    frames = lambda f=audio.FrontEnd(): {(r.path, r.frame): r.v for r in recordings.stored_frames(spark, str(root), store, f).collect()}
    first = frames()
    assert first == {(r.path, r.frame): r.v for r in recordings.part_frames(recordings.read_parts(spark, str(root))).collect()}
    calls = []
    plain = recordings.read_parts
    monkeypatch.setattr(recordings, "read_parts", lambda *a, **k: calls.append(a) or plain(*a, **k))
    assert frames() == first and not calls  # nothing is read or computed again
    (root / "new").mkdir()
    shutil.copy(root / "one" / "a.wav", root / "new" / "c.wav")
    more = frames()
    assert len(calls) == 1 and len(more) == len(first) + sum(k[0].endswith("a.wav") for k in first)
    other = frames(audio.FrontEnd(coefficients=8))
    assert len(calls) == 2 and {len(v) for v in other.values()} == {9}
    spark.createDataFrame([("x", 0, [1.0])], "file string, frame int, v array<double>").write.parquet(f"{store}/data/half/frames")  # a run that failed before its index row
    assert frames() == more
    assert recordings.front_end_key(audio.FrontEnd()) != recordings.front_end_key(audio.FrontEnd(lifter=0))
    assert recordings.file_facts(spark, str(root)).select(F.countDistinct("file")).first()[0] == 5
