"""Operator 11: SentencePiece encoding through a table of distinct chunks, and decoding.

Where no piece of the model has a whitespace marker after another letter, a text falls into chunks (a run of markers and
the letters up to the next run; line breaks stand alone if no piece holds one with something else) whose segmentations
don't depend on each other. Documents are read in units of bounded size, written as a table that is
bucketed by unit: a unit keeps the code of every chunk in order and the unit's distinct chunks. These are dealt out by hash in slices; in a slice every distinct chunk is segmented once by the
library, whatever the number of units that hold it, and its ids return to the units, where they are put in order by
position. For a model without that property a whole text is one chunk, so ids are always those of the library.

Null and empty texts have no ids and decode to the empty text. Rows that repeat an id, or have none, are encoded as rows of
their own. Texts are encoded whole, whatever their length. An empty table gives an empty result. Columns other than doc_id
and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

from tessera.llm.common import shared_folder, small_batches, span_hash, span_sums, string_bytes

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Letters of text of a unit (a longer text is a unit by itself), and bytes of text whose distinct chunks are one slice on average.
UNIT_BYTES, SLICE_BYTES = 8 << 20, 24 << 20


class Model:
    """A SentencePiece model, and how texts may be cut for it."""

    _kept: dict[str, Model] = {}

    def __init__(self, path: str):
        self.library = SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        kind = sentencepiece_model_pb2.ModelProto.SentencePiece
        known = [p.piece for p in spec.pieces if p.type in (kind.NORMAL, kind.USER_DEFINED, kind.UNUSED)]
        rule, trained = spec.normalizer_spec, spec.trainer_spec
        plain = rule.name == "identity" and rule.add_dummy_prefix and rule.escape_whitespaces and not rule.remove_extra_whitespaces and not trained.treat_whitespace_as_suffix
        bytes_known = trained.byte_fallback and sum(p.type == kind.BYTE for p in spec.pieces) == 256
        free = bytes_known and not any(p.type == kind.USER_DEFINED for p in spec.pieces) and not any(re.search(f"[^{MARK}]{MARK}", p) for p in known)
        self.cuts = None
        if plain and free and MARK in known:
            line = not any("\n" in p and len(p) > 1 for p in known)
            self.cuts = re.compile(f"[ {MARK}]*[^ {MARK}\n]+|[ {MARK}]+|\n+" if line else f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")
        self.mark = self.library.piece_to_id(MARK)

    @classmethod
    def at(cls, path: str) -> Model:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def chunks(self, text: str) -> list[str]:
        """The chunks of a text; spaces stand for markers, and the marker that every text begins with is one of them."""
        if not text:
            return []
        return self.cuts.findall(" " + text) if self.cuts else [text]

    def segment(self, chunks: list[str]) -> list[list[int]]:
        """The ids of each chunk as they stand within a text."""
        if not self.cuts:
            return self.library.encode(chunks, num_threads=1)
        # the library sets a marker before what it encodes: it takes the place of a first space, or is left off with a line break
        inner = [c[0] not in (" ", MARK) for c in chunks]
        found = self.library.encode(["\n" + c if new else c[1:] for c, new in zip(chunks, inner, strict=True)], num_threads=1)
        return [[self.mark] if c in (" ", MARK) else ids[2:] if new else ids for c, new, ids in zip(chunks, inner, found, strict=True)]


def pack(values: np.ndarray, data: bytes = b"") -> bytes:
    """32-bit numbers, and bytes, compressed; the numbers' first bytes stand together, then their second ones, and so on."""
    planes = np.ascontiguousarray(np.asarray(values, "<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return zstandard.ZstdCompressor(level=3).compress(len(values).to_bytes(8, "little") + planes + data)


def unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    end = 8 + 4 * int.from_bytes(raw[:8], "little")
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, end - 8, 8).reshape(4, -1).T).view("<i4").ravel(), raw[end:]


def pack_texts(texts: pa.Array) -> bytes:
    data, offsets = string_bytes(texts)
    return pack(np.diff(offsets), data.tobytes())


def unpack_texts(packed: bytes) -> pa.Array:
    sizes, data = unpack(packed)
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])), pa.py_buffer(data))


def slice_of(chunks: pa.Array, slices: int) -> np.ndarray:
    """The slice of each chunk, by hash."""
    data, offsets = string_bytes(chunks)
    hashed = span_hash(span_sums(data), offsets[:-1], offsets[1:])
    return ((hashed >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)).astype(np.int32)


_UNIT = "unit bigint, doc_ids array<bigint>, sizes array<int>, codes binary, chunks binary, slices binary"
_UNIT_ARROW = pa.schema([("unit", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), *((c, pa.binary()) for c in ("codes", "chunks", "slices"))])


def _units(path: str, most: int, slices: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part, n = Model.at(path), TaskContext.get().partitionId(), 0
        code: defaultdict[str, int] = defaultdict()
        code.default_factory = code.__len__
        ids, found, size = [], [], 0

        def unit() -> pa.RecordBatch:
            """Frequent chunks get small codes, which compress well."""
            codes = np.concatenate(found)
            order = np.argsort(-np.bincount(codes, minlength=len(code)), kind="stable")
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            chunks = pa.array(list(code), pa.large_string()).take(pa.array(order))
            row = [(part << 32) + n, ids, [len(x) for x in found], pack(rank[codes]), pack_texts(chunks), pack(slice_of(chunks, slices))]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _UNIT_ARROW, strict=True)], schema=_UNIT_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                words = model.chunks(text)
                ids.append(doc_id.as_py())
                found.append(np.fromiter(map(code.__getitem__, words), np.int32, len(words)))
                size += len(text)
                if size >= most:
                    yield unit()
                    code.clear()
                    ids, found, size, n = [], [], 0, n + 1
        if ids:
            yield unit()

    return run


_ASKED = "unit bigint, slice int, chunks binary"


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chunks of each unit by slice."""
    for batch in batches:
        for unit, data, where in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            chunks, at = unpack_texts(data), unpack(where)[0]
            order = np.argsort(at, kind="stable")
            number, first = np.unique(at[order], return_index=True)
            parts = [pack_texts(chunks.take(pa.array(x))) for x in np.split(order, first[1:])] if len(number) else []
            yield pa.RecordBatch.from_arrays([pa.array([unit] * len(parts), pa.int64()), pa.array(number, pa.int32()), pa.array(parts, pa.binary())], ["unit", "slice", "chunks"])


_ANSWERED = "unit bigint, slice int, counts binary, ids binary"


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of runs that begin at ``starts`` and are ``counts`` long, one run after the other."""
    ends = np.cumsum(counts)
    out = np.repeat(starts - (ends - counts), counts)
    out += np.arange(len(out), dtype=out.dtype)
    return out


def _segmented(path: str, step: int = 20_000):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Segments the distinct chunks of a slice once and answers every unit that asked for them."""
        model = Model.at(path)
        asked = [unpack_texts(x.as_py()) for x in table.column("chunks")]
        every = pa.concat_arrays(asked).dictionary_encode()
        counts, flat = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        for at in range(0, len(every.dictionary), step):
            found = model.segment(every.dictionary.slice(at, step).to_pylist())
            counts.append(np.fromiter(map(len, found), np.int32, len(found)))
            flat.append(np.fromiter((i for ids in found for i in ids), np.int32, int(counts[-1].sum())))
        counts, flat = np.concatenate(counts), np.concatenate(flat)
        starts, codes, at, rows = np.cumsum(counts) - counts, every.indices.to_numpy(), 0, []
        for chunks in asked:
            own = codes[at : at + len(chunks)]
            at += len(chunks)
            rows.append((pack(counts[own]), pack(flat[spread(starts[own], counts[own])])))
        c, i = zip(*rows, strict=True)
        pa.default_memory_pool().release_unused()
        return pa.table({"unit": table.column("unit"), "slice": table.column("slice"), "counts": pa.array(c, pa.binary()), "ids": pa.array(i, pa.binary())})

    return run


#: Chunks of the documents that one batch of results holds at most, a longer one aside.
BATCH_CHUNKS = 1 << 16


def _joined(path: str, decoded: bool):
    kinds = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), *[("decoded", pa.string())] * decoded]

    def run(key: tuple, units: pa.Table, answers: pa.Table) -> pa.Table:
        """The ids of a unit's documents, its chunks' ids put in order by position, in batches of bounded size."""
        answers = answers.sort_by("slice")
        parts = lambda name: np.concatenate([np.zeros(0, np.int32), *(unpack(x.as_py())[0] for x in answers.column(name))])
        answered, flat = parts("counts"), parts("ids")
        codes, where = (unpack(units.column(c)[0].as_py())[0] for c in ("codes", "slices"))
        if len(answered) != len(where):
            raise RuntimeError(f"{len(answered)} of {len(where)} chunks of unit {key[0].as_py()} were answered")
        order = np.argsort(where, kind="stable")
        counts, starts = np.empty_like(answered), np.empty_like(answered)
        counts[order], starts[order] = answered, np.cumsum(answered) - answered
        doc_ids, sizes = units.column("doc_ids")[0].values, units.column("sizes")[0].values.to_numpy()
        ends, lo, batches = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), 0, []
        library = Model.at(path).library
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BATCH_CHUNKS, "right")) - 1)
            own = codes[ends[lo] : ends[hi]]
            each = counts[own]
            ids = flat[spread(starts[own], each)]
            cuts = np.concatenate([[0], np.cumsum(each)])[ends[lo : hi + 1] - ends[lo]]
            columns = [doc_ids.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))]
            if decoded:
                columns.append(pa.array([library.decode(ids[a:b].tolist()) if b > a else "" for a, b in zip(cuts, cuts[1:], strict=False)], pa.string()))
            batches.append(pa.RecordBatch.from_arrays(columns, schema=pa.schema(kinds)))
            lo = hi
        pa.default_memory_pool().release_unused()
        return pa.Table.from_batches(batches, pa.schema(kinds))

    return run


def _bucketed(units: DataFrame) -> DataFrame:
    """Units as a table in the shared folder, bucketed by unit: what is joined to it later is shuffled, the units aren't."""
    spark = units.sparkSession
    name = f"units_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    units.write.bucketBy(parts, "unit").option("path", f"{shared_folder(spark).rstrip('/')}/tables/{name}").format("parquet").saveAsTable(name)
    return spark.table(name)


def encode(docs: DataFrame, model: str = "", unit_bytes: int = UNIT_BYTES, slice_bytes: int = SLICE_BYTES, decoded: bool = False) -> DataFrame:
    """doc_id and ids of every row of ``docs`` (doc_id, text), as the library's ``encode`` gives them without begin or end ids.

    With ``decoded`` also the text that its ``decode`` makes of them.
    """
    small_batches(docs.sparkSession)
    path = model or public_tokenizers.path(MODEL)
    slices = max(1, round((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / slice_bytes))
    units = _bucketed(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_units(path, unit_bytes, slices), _UNIT))
    answers = units.select("unit", "chunks", "slices").mapInArrow(_asked, _ASKED).groupBy("slice").applyInArrow(_segmented(path), _ANSWERED)
    return units.drop("chunks").groupBy("unit").cogroup(answers.groupBy("unit")).applyInArrow(_joined(path, decoded), "doc_id bigint, ids array<int>" + ", decoded string" * decoded)


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model.at(path)
        for batch in batches:
            ids = [x or [] for x in batch.column(batch.num_columns - 1).to_pylist()]
            texts = [model.library.decode(x) if x else "" for x in ids]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, model: str = "") -> DataFrame:
    """Adds the text that the library's ``decode`` gives for the ids; null ids count as none."""
    small_batches(encoded.sparkSession)
    path = model or public_tokenizers.path(MODEL)
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id bigint, ids array<int>, decoded string")


def piece_codec(docs: DataFrame, model: str = "") -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text of every document."""
    found = encode(docs, model, decoded=True)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
