"""Recordings and frame files as Spark data sources: ``format("wav")``, ``format("htk")``, ``format("framefiles")`` for writing.

A file is read by ranges of bytes: one long recording is many tasks, many short ones share a task. A WAV part holds the
samples of the frames that begin in its range, with the overlap into the next range and the one sample before them, so
pre-emphasis and framing of the parts give the frames of the whole. Files are found and read through pyarrow's file systems,
so a path may be a local folder or the address of a store.

The writer makes one file per recording in a tree that mirrors the input's. Tasks write beneath a folder of their own; only a
commit of all tasks moves their files to where they belong, and a failed task leaves nothing behind.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from tessera.operators.frames import frame_sizes
from tessera.sources import audio

#: Bytes of a part, and rows of a part of an HTK file per record batch.
PART_BYTES = 64 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listing(path: str, suffix: str) -> list[tuple[str, int]]:
    """Paths below a folder (or the one file) with the suffix in any case, and their sizes, in order."""
    fs, base = opened(path)
    info = fs.get_file_info(base)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else fs.get_file_info(pafs.FileSelector(base, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.lower().endswith(suffix))


@dataclass
class Ranges(InputPartition):
    """Byte ranges of files: path, first byte, byte after the last."""

    ranges: list[tuple[str, int, int]]


def parts_of(files: list[tuple[str, int]], size: int) -> list[Ranges]:
    """Long files cut, short ones packed together, about ``size`` bytes a part."""
    out, now, filled = [], [], 0
    for path, n in files:
        if n > size:
            out += [Ranges([(path, lo, min(n, lo + size))]) for lo in range(0, n, size)]
            continue
        if filled + n > size and now:
            out.append(Ranges(now))
            now, filled = [], 0
        now.append((path, 0, n))
        filled += n
    return [*out, Ranges(now)] if now else out


@dataclass
class Header:
    """What a WAV file says of its samples."""

    kind: int
    channels: int
    rate: int
    bits: int
    start: int
    samples: int

    @property
    def block(self) -> int:
        return self.bits // 8 * self.channels


def header(f, size: int) -> Header:
    """The header of an open WAV file, chunk by chunk: the samples aren't read."""
    if size < 12 or (head := f.read_at(12, 0))[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form, data = 12, None, None
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", f.read_at(8, at))
        if name == b"fmt " and form is None:
            form = f.read_at(min(n, 64), at + 8)
        elif name == b"data" and data is None:
            data = (at + 8, min(n, size - at - 8))
        at += 8 + n + n % 2
    if form is None or data is None or len(form) < 16:
        raise ValueError("the file has no format or no samples")
    kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", form[:16])
    if kind == 0xFFFE and len(form) >= 26:
        kind = struct.unpack("<H", form[24:26])[0]
    if not channels or not bits // 8:
        raise ValueError("the file has no channels or no bits")
    return Header(kind, channels, rate, bits, data[0], data[1] // (bits // 8 * channels))


def samples(f, h: Header, lo: int, hi: int) -> np.ndarray:
    """Mono samples lo to hi of an open file."""
    data = f.read_at((hi - lo) * h.block, h.start + lo * h.block)
    return audio.decoded(data, h.kind, h.bits, h.channels)


_WAV = "path string, sample_rate int, n_samples bigint, part bigint, first_frame bigint, start bigint, previous double, signal array<double>, error string"


class WavReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partbytes", PART_BYTES))
        self.frame_ms, self.hop_ms = (float(options[k]) if k in options else None for k in ("frame_ms", "hop_ms"))
        self.trim = float(options.get("trim", 0))

    def partitions(self) -> list[InputPartition]:
        return parts_of(listing(self.path, ".wav"), self.size)

    def read(self, partition: Ranges) -> Iterator[tuple]:
        fs, _ = opened(self.path)
        for path, lo, hi in partition.ranges:
            try:
                with fs.open_input_file(path) as f:
                    yield from self.part(f, path, lo, hi)
            except (struct.error, ValueError, OSError) as e:
                yield (path, None, None, lo // self.size, None, None, None, None, str(e) or type(e).__name__)

    def part(self, f, path: str, lo: int, hi: int) -> Iterator[tuple]:
        h = header(f, f.size())
        cut = round(h.rate * self.trim)
        n = h.samples - 2 * cut
        if cut and n <= 0:
            raise ValueError(f"nothing is left of a signal after {self.trim:g} s are cut from both ends")
        begin, number = h.start + cut * h.block, lo // self.size
        at = lambda byte: -(-(byte - begin) // h.block)  # noqa: E731  the first sample that begins at a byte or behind it
        if self.frame_ms is None or self.hop_ms is None:
            a, b = max(0, at(lo)), min(n, at(hi))
            if a < b or lo == 0:
                a, b = (a, b) if a < b else (0, 0)
                yield (path, h.rate, n, number, None, a, self.before(f, h, cut, a), samples(f, h, cut + a, cut + b).tolist(), None)
            return
        length, hop, _ = frame_sizes(h.rate, self.frame_ms, self.hop_ms)
        frames = max(0, (n - length) // hop + 1)
        first, last = max(0, -(-at(lo) // hop)), min(frames, -(-at(hi) // hop))
        if first < last:
            a, b = first * hop, (last - 1) * hop + length
            yield (path, h.rate, n, number, first, a, self.before(f, h, cut, a), samples(f, h, cut + a, cut + b).tolist(), None)
        elif lo == 0 and not frames:  # too short for a frame: still a row
            yield (path, h.rate, n, number, 0, 0, None, samples(f, h, cut, cut + n).tolist(), None)

    def before(self, f, h: Header, cut: int, a: int) -> float | None:
        return float(samples(f, h, cut + a - 1, cut + a)[0]) if a else None


class WavSource(DataSource):
    """Parts of WAV files. Options: partbytes; frame_ms and hop_ms for parts of whole frames; trim, seconds cut from both ends."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> str:
        return _WAV

    def reader(self, schema) -> DataSourceReader:
        return WavReader(dict(self.options))


class HtkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.size = options["path"], int(options.get("partbytes", PART_BYTES))

    def partitions(self) -> list[InputPartition]:
        return parts_of(listing(self.path, ".htk"), self.size)

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(self.path)
        for path, lo, hi in partition.ranges:
            with fs.open_input_file(path) as f:
                n, period, width, kind = struct.unpack(">iihh", f.read_at(12, 0))
                first, last = (min(n, max(0, -(-(byte - 12) // width))) for byte in (lo, hi))
                if first >= last:
                    continue
                v = np.frombuffer(f.read_at((last - first) * width, 12 + first * width), ">f4").astype(float)
            if len(v) != (last - first) * (width // 4):
                raise ValueError(f"{path} has fewer frames than its header says")
            m = last - first
            rows = pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * (width // 4), pa.int32()), pa.array(v))
            columns = [pa.array([path] * m), pa.array(np.arange(first, last), pa.int32()), pa.array([period] * m, pa.int32()), pa.array([kind] * m, pa.int32()), rows]
            yield pa.RecordBatch.from_arrays(columns, ["path", "frame", "period", "kind", "v"])


class HtkSource(DataSource):
    """Frames of HTK files, by ranges of bytes. Option: partbytes."""

    @classmethod
    def name(cls) -> str:
        return "htk"

    def schema(self) -> str:
        return "path string, frame int, period int, kind int, v array<double>"

    def reader(self, schema) -> DataSourceReader:
        return HtkReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    """A task's folder, and the files in it."""

    folder: str
    outputs: list[str]


class FrameFileWriter(DataSourceWriter):
    """Rows output, frames, rate, frame, v: sorted by output and frame, all frames of an output in one partition."""

    def __init__(self, options: dict):
        self.path, self.kind = options["path"], options.get("kind", "htk")
        if self.kind not in ("htk", "text"):
            raise ValueError(f"kind must be htk or text, got {self.kind!r}")
        self.htk, self.hop_ms = int(options.get("parameter_kind", audio.htk_kind())), float(options.get("hop_ms", 15.0))
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, rows: Iterator) -> Written:
        fs, base = opened(self.path)
        folder, outputs, out, now = f"{base.rstrip('/')}/{self.job}/{uuid.uuid4().hex}", [], None, None
        try:
            for row in rows:
                if row.output != now:
                    if out is not None:
                        out.close()
                    now = row.output
                    outputs.append(now)
                    fs.create_dir(f"{folder}/{now}".rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(f"{folder}/{now}", compression=None)
                    if self.kind == "htk":
                        hop = frame_sizes(row.rate, max(self.hop_ms, 1000 * 2 / row.rate), self.hop_ms)[1]
                        out.write(struct.pack(">iihh", row.frames, round(hop * 10_000_000 / row.rate), 4 * len(row.v), self.htk))
                out.write(np.asarray(row.v, ">f4").tobytes() if self.kind == "htk" else (" ".join(f"{x:.8e}" for x in row.v) + "\n").encode())
            if out is not None:
                out.close()
        except BaseException:
            if fs.get_file_info(folder).type != pafs.FileType.NotFound:
                fs.delete_dir(folder)
            raise
        return Written(folder, outputs)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = opened(self.path)
        made = set()
        for m in filter(None, messages):
            for output in m.outputs:
                target = f"{base.rstrip('/')}/{output}"
                if (parent := target.rpartition("/")[0]) not in made:
                    fs.create_dir(parent, recursive=True)
                    made.add(parent)
                fs.move(f"{m.folder}/{output}", target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, base = opened(self.path)
        if fs.get_file_info(f"{base.rstrip('/')}/{self.job}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{base.rstrip('/')}/{self.job}")


class FrameFiles(DataSource):
    """One file per recording: HTK, or lines of numbers. Options: kind, hop_ms, parameter_kind."""

    @classmethod
    def name(cls) -> str:
        return "framefiles"

    def schema(self) -> str:
        return "output string, frames int, rate int, frame int, v array<double>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FrameFileWriter(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    for source in (WavSource, HtkSource, FrameFiles):
        spark.dataSource.register(source)
    return spark


def read_parts(spark: SparkSession, root: str, f: audio.FrontEnd = audio.FrontEnd(), trim: float = 0.0, part_bytes: int = PART_BYTES) -> DataFrame:
    """Parts of whole frames of every WAV file below a folder."""
    r = register(spark).read.format("wav").option("partbytes", part_bytes).option("frame_ms", f.frame_ms).option("hop_ms", f.hop_ms)
    return r.option("trim", trim).load(root)


def part_frames(parts: DataFrame, f: audio.FrontEnd = audio.FrontEnd()) -> DataFrame:
    """Static cepstra of parts: path, frame (of the whole file), v. No shuffle."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            for path, rate, first, previous, signal in zip(batch.path, batch.sample_rate, batch.first_frame, batch.previous, batch.signal, strict=True):
                if signal is None:
                    continue
                v = audio.cepstra(np.asarray(signal, float), int(rate), f, None if previous is None or np.isnan(previous) else float(previous))
                if len(v):
                    yield pd.DataFrame({"path": path, "frame": np.arange(int(first), int(first) + len(v), dtype=np.int32), "v": list(v)})

    return parts.select("path", "sample_rate", "first_frame", "previous", "signal").mapInPandas(run, "path string, frame int, v array<double>")


_SUFFIX = {"htk": ".htk", "text": ".txt"}


def extract_tree(spark: SparkSession, root: str, out: str, f: audio.FrontEnd = audio.FrontEnd(), delta_order: int = 2, kind: str = "htk", trim: float = 0.0, part_bytes: int = PART_BYTES) -> DataFrame:
    """Frame features of every recording below ``root`` as files of a mirrored tree; a status row per recording.

    path and output (relative), sample_rate, n_samples, n_frames, n_dims, status (ok, too_short, error), message. A file with
    an error in any part has no output. The status is also written, as ``_status`` beside the files.
    """
    _, base = opened(root)
    relative = F.expr(f"substring(path, {len(base.rstrip('/')) + 2})")
    parts = read_parts(spark, root, f, trim, part_bytes)
    names, dims = audio.frame_columns(f, 0), len(audio.frame_columns(f, delta_order))
    facts = parts.groupBy("path").agg(F.max("sample_rate").alias("sample_rate"), F.max("n_samples").alias("n_samples"), F.min("error").alias("message"))
    frames = part_frames(parts, f).join(facts.where("message IS NOT NULL").select("path"), "path", "left_anti")
    frames = audio.with_deltas(frames.select("path", "frame", *[F.get("v", k).alias(c) for k, c in enumerate(names)]), names, delta_order)
    counts = frames.groupBy("path").agg(F.count(F.lit(1)).cast("int").alias("n_frames"))
    d = facts.join(counts, "path", "left")
    status = F.when(F.col("message").isNotNull(), "error").when(F.col("n_frames").isNull(), "too_short").otherwise("ok")
    output = F.concat(F.regexp_replace(relative, r"\.[^./]*$", ""), F.lit(_SUFFIX.get(kind, "")))
    d = d.select("path", "sample_rate", "n_samples", F.coalesce("n_frames", F.lit(0)).alias("n_frames"), status.alias("status"), "message", F.when(status == "ok", output).otherwise("").alias("output"))
    v = F.array(*[F.col(f"`{c}`") for c in audio.frame_columns(f, delta_order)])
    rows = frames.join(d.where("status = 'ok'").select("path", "output", F.col("n_frames").alias("frames"), F.col("sample_rate").alias("rate")), "path").select("output", "frames", "rate", "frame", v.alias("v"))
    writer = rows.repartition("output").sortWithinPartitions("output", "frame").write.format("framefiles").mode("append").option("kind", kind).option("hop_ms", f.hop_ms)
    writer.option("parameter_kind", audio.htk_kind(f.energy, delta_order)).save(out)
    message = F.when(F.col("status") == "too_short", "shorter than one frame").otherwise(F.coalesce("message", F.lit("")))
    table = d.select(relative.alias("path"), "output", F.coalesce("sample_rate", F.lit(0)).alias("sample_rate"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"), "n_frames", F.lit(dims).alias("n_dims"), "status", message.alias("message"))
    table.write.mode("overwrite").parquet(f"{out}/_status")
    return spark.read.parquet(f"{out}/_status")


# A store of static frames by what they are made of.


def front_end_key(f: audio.FrontEnd, trim: float = 0.0) -> str:
    """A digest of all that static frames depend on besides the file; delta settings aren't part of it."""
    from dataclasses import asdict
    from hashlib import sha256

    return sha256(json.dumps({**asdict(f), "trim": trim}, sort_keys=True).encode()).hexdigest()


def file_facts(spark: SparkSession, root: str) -> DataFrame:
    """path and a digest of path, length and modification time of every WAV file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    return files.select(path.alias("path"), F.sha2(F.concat_ws("|", path, "length", F.unix_micros("modificationTime")), 256).alias("file"))


def stored_frames(spark: SparkSession, root: str, store: str, f: audio.FrontEnd = audio.FrontEnd(), trim: float = 0.0, part_bytes: int = PART_BYTES) -> DataFrame:
    """Static frames (path, frame, v) of every recording below ``root``, computed only for files that the store doesn't hold.

    New frames are written to a folder of their own and count once a row of the index names it: what is left of a failed run
    is never read. Files that have changed have another digest. Recordings with errors are stored without frames.
    """
    key = front_end_key(f, trim)
    now = file_facts(spark, root)
    try:
        index = spark.read.parquet(f"{store}/index").where(F.col("front_end") == key)
        folders = [r.folder for r in index.select("folder").distinct().collect()]  # a row a run
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        index, folders = None, []
    absent = now
    if folders:
        absent = now.join(spark.read.parquet(*[f"{store}/{x}/files" for x in folders]).select("file"), "file", "left_anti")
    if not absent.isEmpty():
        folder = f"data/{uuid.uuid4().hex}"
        absent.write.parquet(f"{store}/{folder}/files")
        new = spark.read.parquet(f"{store}/{folder}/files")
        parts = read_parts(spark, root, f, trim, part_bytes).join(new, "path")
        bad = parts.where("error IS NOT NULL").select("file").distinct()
        frames = part_frames(parts, f).join(new, "path").join(bad, "file", "left_anti")
        frames.select("file", "frame", "v").write.parquet(f"{store}/{folder}/frames")
        spark.createDataFrame([(key, folder)], "front_end string, folder string").coalesce(1).write.mode("append").parquet(f"{store}/index")
        folders.append(folder)
    held = spark.read.schema("file string, frame int, v array<double>").parquet(*[f"{store}/{x}/frames" for x in folders]) if folders else spark.createDataFrame([], "file string, frame int, v array<double>")
    return held.join(now, "file").select("path", "frame", "v")
