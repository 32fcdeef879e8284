"""Operator 8: documents packed into few sequences by a grouping genetic algorithm.

Documents become token ids with an end id; longer ones are cut. Pieces of full length are sequences of their own. The
others are dealt by hash into blocks of bounded size, and every block is packed on several islands. An island holds a
few packings; a child takes whole well-filled bins of one parent into the other, drops the bins that hold duplicates and
best-fits the displaced pieces. Elites migrate to the next island between rounds, in Spark, and the best packing of a
block counts. Last, the poorly filled bins of many blocks are packed anew together.

Null and empty texts have the end id alone. Texts are encoded whole. Rows that repeat an id, or have none, are packed as
documents of their own. Every piece is placed exactly once; an empty table gives an empty result. Columns other than
doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm.common import small_batches, stash

TOKENIZER = "byte_bpe_50k.json"
END, CAPACITY = 2, 1024
#: Pieces of a block, islands of a block, packings of an island, children of a round, rounds.
BLOCK, ISLANDS, POPULATION, CHILDREN, ROUNDS = 2_000, 3, 4, 16, 2
#: Blocks whose poorly filled bins are packed anew together, and the fill below which a bin is one.
MERGED_BLOCKS, POOR = 64, 0.97


def _bytes_of_letters() -> dict[str, int]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones as they are, the rest from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids of whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` of a tokenizers file gives them.

    The same vocabulary as ranks gives the same ids several times faster; texts with an added token's string, with letters
    that the two libraries may class differently, and texts that the faster one gives up on, are left to tokenizers itself.
    """

    _kept: dict[str, Encoder] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        self.tokenizer = Tokenizer.from_file(path)
        added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        letters = _bytes_of_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if set(token) <= letters.keys() and not token.startswith("<|")}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.unusual = re.compile("|".join(["[^\x00-\u024f]", *map(re.escape, added)]))

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._kept:
            cls._kept[path] = cls(path)
        return cls._kept[path]

    def __call__(self, text: str) -> np.ndarray:
        if not self.unusual.search(text):
            try:
                return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")
            except (ValueError, RuntimeError):
                pass  # a run of white space too long for its pattern matcher
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Starts and lengths of a document's pieces: the first may be shorter."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return [(0, first)] * (first > 0) + [(s, capacity) for s in range(first, length, capacity)]


_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def _pieces(path: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder.at(path)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.array([end], "<u4"))
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n])) for k, (s, n) in enumerate(cut(len(ids), capacity))]
            if rows:
                a, b, c, d, e = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int32()), pa.array(c), pa.array(d), pa.array(e)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


class Packing:
    """Bins of pieces (a bin number per piece) and what is free in each bin."""

    def __init__(self, bins: np.ndarray, lengths: np.ndarray, capacity: int):
        used = np.unique(bins, return_inverse=True)[1]
        self.bins = used.astype(np.int32)
        self.free = capacity - np.bincount(used, lengths).astype(np.int64)
        self.capacity = capacity

    @property
    def cost(self) -> tuple[int, float]:
        return len(self.free), -float(((self.capacity - self.free) ** 2.0).sum())


def best_fit(bins: np.ndarray, free: np.ndarray, loose: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Puts each loose piece into the open bin that it fills best, else into a new one."""
    room = sorted((int(f), b) for b, f in enumerate(free) if f > 0)
    n = len(free)
    for i in loose:
        size = int(lengths[i])
        k = bisect.bisect_left(room, (size, -1))
        if k < len(room):
            f, b = room.pop(k)
        else:
            f, b, n = capacity, n, n + 1
        bins[i] = b
        if f > size:
            bisect.insort(room, (f - size, b))
    return bins


def child(a: Packing, b: Packing, lengths: np.ndarray, rng: np.random.Generator) -> Packing:
    """Whole well-filled bins of ``b`` go into ``a``; bins of ``a`` that hold their pieces go, and what they held besides is best-fitted."""
    chance = (1 - b.free / b.capacity) ** 8 * rng.uniform(0.15, 0.6)
    taken = rng.random(len(b.free)) < chance
    inject = taken[b.bins]
    struck = np.zeros(len(a.free), bool)
    struck[a.bins[inject]] = True
    worst = np.argsort(-a.free, kind="stable")[: max(2, len(a.free) // 50)]
    struck[rng.choice(worst, max(1, len(worst) // 2), replace=False)] = True  # mutation: poorly filled bins are emptied
    loose = np.flatnonzero(struck[a.bins] & ~inject)
    loose = loose[np.argsort(-lengths[loose] + rng.uniform(0, 6, len(loose)), kind="stable")]
    bins = np.where(inject, len(a.free) + b.bins, np.where(struck[a.bins], -1, a.bins)).astype(np.int64)
    held = bins >= 0
    names, code = np.unique(bins[held], return_inverse=True)
    out = np.full(len(lengths), -1, np.int64)
    out[held] = code
    free = a.capacity - np.bincount(code, lengths[held], len(names)).astype(np.int64)
    return Packing(best_fit(out, free, loose, lengths, a.capacity), lengths, a.capacity)


def seed_packing(lengths: np.ndarray, capacity: int, rng: np.random.Generator, noise: float) -> Packing:
    order = np.argsort(-lengths + rng.uniform(0, noise, len(lengths)), kind="stable")
    return Packing(best_fit(np.full(len(lengths), -1, np.int64), np.zeros(0, np.int64), order, lengths, capacity), lengths, capacity)


def evolve(population: list[Packing], lengths: np.ndarray, children: int, rng: np.random.Generator) -> list[Packing]:
    """Children replace the worst; nothing is done once the least possible number of bins is reached."""
    population = sorted(population, key=lambda p: p.cost)
    least = -(-int(lengths.sum()) // population[0].capacity)
    for _ in range(children):
        if population[0].cost[0] <= least:
            break
        i, j = rng.choice(len(population), 2, replace=len(population) < 2)
        new = child(population[min(i, j)], population[max(i, j)], lengths, rng)
        population = sorted([*population, new], key=lambda p: p.cost)[: len(population)]
    return population


_ISLAND = "block bigint, island int, uids binary, lengths binary, packings array<binary>"


def _founded(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """The islands of a block with their first packings."""
        table = table.sort_by("uid")
        uids, lengths = table.column("uid").to_numpy(), table.column("length").to_numpy()
        block, rows = key[0].as_py(), []
        for island in range(ISLANDS):
            rng = np.random.default_rng([block, island])
            start = [seed_packing(lengths, capacity, rng, 40.0 * (k + island)) for k in range(POPULATION)]
            rows.append([p.bins.tobytes() for p in start])
        n = len(rows)
        return pa.table({
            "block": pa.array([block] * n), "island": pa.array(range(n), pa.int32()), "uids": [uids.tobytes()] * n, "lengths": [lengths.tobytes()] * n,
            "packings": pa.array(rows, pa.list_(pa.binary())),
        })

    return run


def _evolved(capacity: int, turn: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lengths = np.frombuffer(row["lengths"], np.int64)
                start = [Packing(np.frombuffer(p, np.int32), lengths, capacity) for p in row["packings"]]
                rng = np.random.default_rng([row["block"], row["island"], turn])
                out.append([p.bins.tobytes() for p in evolve(start, lengths, CHILDREN, rng)[:POPULATION]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.list_(pa.binary()))], batch.schema.names)

    return run


def _placed(uids: np.ndarray, lengths: np.ndarray, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces in bin order: uid, length, sequence (the bin's first uid), offset."""
    order = np.lexsort((uids, bins))
    u, n, b = uids[order], lengths[order], bins[order]
    head = np.concatenate([[True], b[1:] != b[:-1]])
    at = np.maximum.accumulate(np.where(head, np.arange(len(b)), 0))
    ends = np.cumsum(n)
    return u, n, u[at], ends - n - (ends - n)[at]


_PLACED = "uid bigint, length bigint, sequence_id bigint, offset bigint, block bigint, fill bigint"


def _best(key: tuple, table: pa.Table) -> pa.Table:
    """The pieces of a block as its best island packs them."""
    best = None
    for row in table.to_pylist():
        lengths = np.frombuffer(row["lengths"], np.int64)
        p = Packing(np.frombuffer(row["packings"][0], np.int32), lengths, CAPACITY)
        if best is None or (*p.cost, row["island"]) < best[0]:
            best = ((*p.cost, row["island"]), np.frombuffer(row["uids"], np.int64), lengths, p.bins)
    return _table(key[0].as_py(), *_placed(*best[1:]))


def _table(block: int, u: np.ndarray, n: np.ndarray, sequence: np.ndarray, offset: np.ndarray) -> pa.Table:
    _, code = np.unique(sequence, return_inverse=True)
    fill = np.bincount(code, n).astype(np.int64)[code] if len(u) else n
    return pa.table({"uid": u, "length": n, "sequence_id": sequence, "offset": offset, "block": pa.array([block] * len(u), pa.int64()), "fill": fill})


def _merged(capacity: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Packs the pieces of poorly filled bins anew if that saves a bin."""
        table = table.sort_by("uid")
        u, n, old = (table.column(c).to_numpy() for c in ("uid", "length", "sequence_id"))
        rng = np.random.default_rng(0)
        tried = evolve([seed_packing(n, capacity, rng, 20.0 * k) for k in range(POPULATION)], n, CHILDREN, rng)[0]
        if len(tried.free) < len(np.unique(old)):
            return _table(key[0].as_py(), *_placed(u, n, tried.bins))
        return table.select(["uid", "length", "sequence_id", "offset", "block", "fill"])

    return run


def pack(docs: DataFrame, tokenizer: str = "", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece of every document of ``docs`` (doc_id, text) with its sequence and its offset there."""
    small_batches(docs.sparkSession)
    path = tokenizer or public_tokenizers.path(TOKENIZER)
    pieces = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(_pieces(path, capacity, end), _PIECES)
    pieces = stash(pieces.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    loose = pieces.where(F.col("length") < capacity)
    blocks = max(1, round(loose.count() / BLOCK))
    items = loose.select("uid", "length", F.pmod(F.xxhash64("uid"), F.lit(blocks)).alias("block"))
    islands = stash(items.groupBy("block").applyInArrow(_founded(capacity), _ISLAND).repartition("block", "island"), "islands")
    for turn in range(ROUNDS):
        islands = stash(islands.repartition("block", "island").mapInArrow(_evolved(capacity, turn), _ISLAND), "islands")
        if turn + 1 < ROUNDS:  # each island's elite also goes to the next island of its block
            elite = islands.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.slice("packings", 1, 1).alias("elite"))
            islands = islands.join(elite, ["block", "island"]).select("block", "island", "uids", "lengths", F.concat("packings", "elite").alias("packings"))
    placed = stash(islands.groupBy("block").applyInArrow(_best, _PLACED), "placed")
    poor = F.col("fill") < POOR * capacity
    again = placed.where(poor).groupBy((F.col("block") / MERGED_BLOCKS).cast("bigint").alias("merge")).applyInArrow(_merged(capacity), _PLACED)
    spot = placed.where(~poor).unionByName(again).select("uid", "sequence_id", "offset")
    out = loose.join(spot, "uid").unionByName(pieces.where(F.col("length") == capacity).select("*", F.col("uid").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
