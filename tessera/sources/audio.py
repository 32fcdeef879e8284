"""Recordings: WAV and HTK files to rows, cepstral frames of every recording, and HTK headers."""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import DatasetError
from tessera.functions import halo, ranks
from tessera.operators.frames import dct_matrix, deltas, frame_sizes, lifter_weights, mel_matrix, window_weights
from tessera.operators.pooling import pool
from tessera.sources import tables

# Bits of an HTK parameter kind.
HTK_MFCC, HTK_ENERGY, HTK_C0, HTK_DELTA, HTK_ACCELERATION = 6, 0o100, 0o20000, 0o400, 0o1000


@dataclass(frozen=True)
class FrontEnd:
    frame_ms: float = 30.0
    hop_ms: float = 15.0
    mels: int = 23
    coefficients: int = 12
    low: float = 64.0
    high: float | None = None
    emphasis: float = 0.97
    lifter: int = 22
    window: str = "hamming_symmetric"
    energy: str = "c0"
    floor: float = 1e-10


#: Named front ends: the default, and one of shorter frames and log energy.
PRESETS = {"htk_c0": FrontEnd(), "compact": FrontEnd(frame_ms=25.0, hop_ms=10.0, mels=26, low=0.0, window="hamming", energy="log_energy")}


def list_audio(spark: SparkSession, root: str) -> DataFrame:
    """path and length of every WAV file below a folder, in path order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(root)
    return files.select("path", "length").orderBy("path")


def _chunks(content: bytes) -> dict[bytes, bytes]:
    """The named parts of a RIFF file."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    found, at = {}, 12
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        found.setdefault(name, content[at + 8 : at + 8 + size])
        at += 8 + size + size % 2
    return found


def decode_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and mono samples of a file of 8, 16, 24 or 32 bits (in [-1, 1]) or of 32- or 64-bit floats; NaN and infinities are errors."""
    parts = _chunks(content)
    if b"fmt " not in parts or b"data" not in parts:
        raise ValueError("the file has no format or no samples")
    kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", parts[b"fmt "][:16])
    if kind == 0xFFFE and len(parts[b"fmt "]) >= 26:  # the extensible form names its kind further on
        kind = struct.unpack("<H", parts[b"fmt "][24:26])[0]
    if not channels or not bits // 8:
        raise ValueError("the file has no channels or no bits")
    return rate, decoded(parts[b"data"], kind, bits, channels)


def decoded(data: bytes, kind: int, bits: int, channels: int) -> np.ndarray:
    """Mono samples of the bytes of whole blocks; what is left over of a block is dropped."""
    width = bits // 8
    data = data[: len(data) // (width * channels) * width * channels]
    if kind == 3 and bits in (32, 64):
        x = np.frombuffer(data, f"<f{width}").astype(float)
    elif kind == 1 and bits == 8:
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif kind == 1 and bits in (16, 32):
        x = np.frombuffer(data, f"<i{width}").astype(float) / 2.0 ** (bits - 1)
    elif kind == 1 and bits == 24:
        three = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((three[:, 0] | three[:, 1] << 8 | three[:, 2] << 16) << 8 >> 8) / 2.0**23
    else:
        raise ValueError(f"samples of kind {kind} with {bits} bits can't be read")
    if not np.isfinite(x).all():
        raise ValueError("the samples have NaN or infinite values")
    return x.reshape(-1, channels).mean(1)


def trimmed(signal: Column, rate: Column, seconds: float) -> Column:
    """A signal without so many seconds at either end; an error if nothing would be left."""
    cut = F.round(rate * F.lit(seconds)).cast("int")
    return F.when(F.size(signal) > 2 * cut, F.slice(signal, cut + 1, F.size(signal) - 2 * cut)).otherwise(F.raise_error(F.lit(f"nothing is left of a signal after {seconds} s are cut from both ends")).cast("array<double>"))


def read_wav(spark: SparkSession, root: str) -> DataFrame:
    """path, sample_rate, signal and error; a file that can't be read has a message and no signal."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.path, batch.content, strict=True):
                try:
                    rate, x = decode_wav(bytes(content))
                    rows.append((path, rate, x, None))
                except (struct.error, ValueError) as e:
                    rows.append((path, None, None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "signal", "error"])

    return files.mapInPandas(run, "path string, sample_rate int, signal array<double>, error string")


def cepstra(signal: np.ndarray, rate: int, f: FrontEnd = FrontEnd(), previous: float | None = None) -> np.ndarray:
    """Static cepstra of a signal, a row per frame that fits whole; all frames in one transform and two products.

    ``previous`` is the sample before a part of a longer signal, from which its pre-emphasis goes on.
    """
    length, hop, n_fft = frame_sizes(rate, f.frame_ms, f.hop_ms)
    high = f.high or rate / 2
    if high > rate / 2:
        raise ValueError(f"{high} Hz is above half the sample rate {rate}")
    columns = f.coefficients + (f.energy != "none")
    if len(signal) < length:
        return np.zeros((0, columns))
    at = np.arange((len(signal) - length) // hop + 1)[:, None] * hop + np.arange(length)
    emphasised = np.append(signal[:1] - f.emphasis * (previous or 0.0), signal[1:] - f.emphasis * signal[:-1])
    power = np.abs(np.fft.rfft(emphasised[at] * np.array(window_weights(f.window, length)), n_fft)) ** 2
    logs = np.log(np.maximum(power @ np.array(mel_matrix(f.mels, n_fft, rate, f.low, high)).T, f.floor))
    c = logs @ np.array(dct_matrix(f.coefficients + 1, f.mels)).T
    out = c[:, 1:] * np.array(lifter_weights(f.coefficients, f.lifter))
    if f.energy == "c0":
        return np.hstack([out, c[:, :1]])
    if f.energy == "log_energy":
        return np.hstack([out, np.log(np.maximum((signal[at] ** 2).sum(1), f.floor))[:, None]])
    return out


def cepstral_frames(recordings: DataFrame, f: FrontEnd = FrontEnd()) -> DataFrame:
    """A row per frame of every recording (path, sample_rate, signal): path, frame, v. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, rate, signal in zip(batch.path, batch.sample_rate, batch.signal, strict=True):
                if signal is not None:
                    v = cepstra(np.asarray(signal, float), int(rate), f)
                    if not len(v):
                        continue
                    yield pd.DataFrame({"path": path, "frame": np.arange(len(v), dtype=np.int32), "v": list(v)})

    return recordings.select("path", "sample_rate", "signal").mapInPandas(run, "path string, frame int, v array<double>")


def frame_columns(f: FrontEnd = FrontEnd(), delta_order: int = 0) -> list[str]:
    static = [f"c{k}" for k in range(1, f.coefficients + 1)] + {"c0": ["c0"], "log_energy": ["log_e"], "none": []}[f.energy]
    return [p + c for p in ("", "d_", "dd_")[: delta_order + 1] for c in static]


def frame_features(recordings: DataFrame, f: FrontEnd = FrontEnd(), delta_order: int = 2) -> DataFrame:
    """A row per frame of every recording: path, frame, and a column per coefficient, delta and delta of deltas."""
    names = frame_columns(f)
    return with_deltas(cepstral_frames(recordings, f).select("path", "frame", *[F.get("v", k).alias(c) for k, c in enumerate(names)]), names, delta_order)


def with_deltas(frames: DataFrame, names: Sequence[str], delta_order: int = 2) -> DataFrame:
    """Adds deltas, and deltas of deltas, of the static columns: path, frame, then the columns by order."""
    d = frames
    if delta_order >= 1:
        d = deltas(d, ["path"], ["frame"], names, 3)
    if delta_order >= 2:
        d = deltas(d, ["path"], ["frame"], [f"d_{c}" for c in names], 2, "_")
        d = d.withColumnsRenamed({f"_d_{c}": f"dd_{c}" for c in names})
    return d.select("path", "frame", *[f"{p}{c}" for p in ("", "d_", "dd_")[: delta_order + 1] for c in names])


def utterance_features(recordings: DataFrame, f: FrontEnd = FrontEnd(), delta_order: int = 2, statistics: Sequence[str] = ("mean", "std"), percentiles: Sequence[float] = (), normalization: str = "none") -> DataFrame:
    """A row of pooled features per recording; an error names a recording without a whole frame."""
    pooled = pool(frame_features(recordings, f, delta_order), ["path"], frame_columns(f, delta_order), statistics, percentiles, normalization)
    short = recordings.select("path").join(pooled.select("path"), "path", "left_anti").limit(1).collect()
    if short:
        raise DatasetError(f"{short[0].path} is shorter than a frame")
    return pooled


def extraction_status(recordings: DataFrame, f: FrontEnd = FrontEnd()) -> DataFrame:
    """path, frames and status (ok, too_short or error) of every recording of ``read_wav``."""
    frames = cepstral_frames(recordings.where("error IS NULL"), f).groupBy("path").agg(F.count(F.lit(1)).alias("frames"))
    d = recordings.select("path", "error").join(frames, "path", "left")
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("frames").isNull(), "too_short").otherwise("ok")
    return d.select("path", F.coalesce("frames", F.lit(0)).alias("frames"), status.alias("status"), "error")


def export_frames(frames: DataFrame, columns: Sequence[str], path: str, kind: str = "parquet", hop: int = 240, rate: int = 16000, htk: int = 8966) -> None:
    """Frame features as Parquet, as text lines (``%.8e``), or as HTK files' bytes (path, content), a row per recording."""
    if kind == "parquet":
        frames.write.mode("overwrite").parquet(path)
    elif kind == "text":
        line = F.concat_ws(" ", *[F.format_string("%.8e", F.col(f"`{c}`").cast("double")) for c in columns])
        frames.select("path", "frame", line.alias("line")).write.mode("overwrite").parquet(path)
    elif kind == "htk":

        def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            v = pdf.sort_values("frame")[list(columns)].to_numpy(float)
            return pd.DataFrame({"path": [key[0]], "content": [encode_htk(v, hop, rate, htk)]})

        frames.groupBy("path").applyInPandas(encode, "path string, content binary").write.mode("overwrite").parquet(path)
    else:
        raise ValueError(f"kind must be parquet, text or htk, got {kind!r}")


def read_htk(spark: SparkSession, root: str) -> DataFrame:
    """A row per frame of every HTK file below a folder: path, frame, v."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.htk").load(root).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch.path, batch.content, strict=True):
                v = decode_htk(bytes(content))[2]
                if not len(v):
                    continue
                yield pd.DataFrame({"path": path, "frame": np.arange(len(v), dtype=np.int32), "v": list(v)})

    return files.mapInPandas(run, "path string, frame int, v array<double>")


def read_text_frames(spark: SparkSession, root: str, rows: int = halo.RANGE_ROWS) -> DataFrame:
    """A row per line of numbers of every text file below a folder: path, frame (its number in the file), v; other lines are errors.

    Lines are numbered in ranges, so a file of any length is many tasks.
    """
    lines = tables.with_place(spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").text(root)).where(F.trim("value") != "")
    d, _ = halo.in_ranges(lines, list(tables.PLACE), rows)
    d = ranks.numbered(d, list(tables.PLACE), [tables.PLACE[0]], F.col(halo.RANGE), "frame")
    v = text_matrix(F.col("value"))
    bad = F.raise_error(F.concat(F.lit("not numbers: "), F.col(tables.PLACE[0]))).cast("array<double>")
    return d.select(F.col(tables.PLACE[0]).alias("path"), F.col("frame").cast("int").alias("frame"), F.when(F.exists(v, lambda x: x.isNull()), bad).otherwise(v).alias("v"))


def load_frames(spark: SparkSession, root: str) -> DataFrame:
    """path, frame and v of frame files of any kind below a folder: HTK, lines of numbers, and Parquet tables of that layout."""
    from tessera.sources import recordings

    found = None
    for suffix, read in ((".htk", lambda: recordings.register(spark).read.format("htk").load(root).select("path", "frame", "v")), (".txt", lambda: read_text_frames(spark, root)), (".parquet", lambda: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(root).select("path", "frame", "v"))):
        if recordings.listing(root, suffix):
            found = read() if found is None else found.unionByName(read())
    if found is None:
        raise DatasetError(f"no frame files below {root}")
    return found


def htk_kind(energy: str = "c0", delta_order: int = 2) -> int:
    return HTK_MFCC | {"c0": HTK_C0, "log_energy": HTK_ENERGY, "none": 0}[energy] | (HTK_DELTA if delta_order >= 1 else 0) | (HTK_ACCELERATION if delta_order >= 2 else 0)


def encode_htk(v: np.ndarray, hop: int, rate: int, kind: int) -> bytes:
    """A 12-byte big-endian header and big-endian single-precision rows."""
    return struct.pack(">iihh", len(v), round(hop * 1e7 / rate), 4 * v.shape[1], kind) + v.astype(">f4").tobytes()


def decode_htk(content: bytes) -> tuple[int, int, np.ndarray]:
    """Frame period in 100 ns, kind, rows."""
    n, period, size, kind = struct.unpack(">iihh", content[:12])
    return period, kind, np.frombuffer(content[12:], ">f4").reshape(n, size // 4).astype(float)


def text_matrix(value: Column) -> Column:
    """Numbers of a line of text separated by white space."""
    return F.transform(F.split(F.trim(value), r"\s+"), lambda x: x.try_cast("double"))


def rosenberg_pulse(phase: Column) -> Column:
    """Glottal pulse by phase in [0, 1): rising to 0.4, falling to 0.56, closed after."""
    rise, fall = F.lit(math.pi) * phase / 0.4, F.lit(math.pi / 2) * (phase - 0.4) / 0.16
    return F.when(phase < 0.4, 0.5 * (1 - F.cos(rise))).when(phase < 0.56, F.cos(fall)).otherwise(0.0)
