"""Operator 6: log-probabilities of texts by a log-bilinear neural model.

Words of the training documents are counted over the whole corpus. The most frequent words are symbols of their own,
every other word belongs to a class by its ending. A log-bilinear model over the two symbols before predicts the next;
it is trained in numpy by noise-contrastive estimation on every position of every training document: in a round each
partition of a share of the documents goes on from the common parameters, and the parameters are averaged, each row by how
often the partitions used it, in Spark. The number of symbols is the root of the number of distinct words, however many.
Scores are normalised: matrix products over batches of contexts give the normaliser of every context, and a word of a class
has the class's probability times its smoothed share of the class (words never seen share one count's part).

Counts of the most frequent words are broadcast; rarer words are joined with their counts by a shuffle. Words are told
apart by 64-bit hashes. Null and empty texts have the end token alone. Rows that repeat are scored, and counted, as
often as they stand; without training documents every token has the same probability in the base, and in the model. Texts
are scored whole, whatever their length; an empty table gives an empty result. Columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import crc_of_id, lowered, mix, row_chunks, small_batches, span_hash, span_sums, spans, stash, string_bytes

#: Words that are symbols at least (see ``symbols_for``), classes of the others, size of the vectors.
SYMBOLS, CLASSES, SIZE = 768, 128, 24
#: Rounds that share out the documents, noise words of a position and those that a batch draws, positions of a batch.
ROUNDS, NOISE, DRAWN, BATCH = 4, 12, 64, 2048
#: Positions that are shuffled together, and passes over them, whatever the size of the corpus.
BUFFER, PASSES = 1 << 17, 1
#: Contexts whose normalisers a worker holds at most; others are computed again.
HELD = 1 << 21
#: Bytes of a piece of the parameters, the unit that Spark sums.
PIECE = 1 << 14
#: Words whose counts are broadcast at most.
HEAD = 200_000
ADDED = 0.1
_U = np.uint64
_END = int(mix(np.array([1], _U))[0])
_LOG10 = math.log(10)


class Tokens:
    """Hash and class of every token of a run of rows: the words in order, then one end per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        s, e, rows = spans(data, offsets)
        n = len(offsets) - 1
        sums = span_sums(lowered(data))
        ends = np.searchsorted(rows, np.arange(n), "right")
        self.hash = np.insert(span_hash(sums, s, e), ends, _U(_END))
        self.kind = np.insert((span_hash(sums, np.maximum(e - 2, s), e) >> _U(40)).astype(np.int64) % CLASSES, ends, 0)
        self.row = np.insert(rows, ends, np.arange(n))
        self.first = np.concatenate([[0], ends[:-1] + np.arange(1, n)]) if n else np.zeros(0, np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of a partition with their class and count."""
    held = (np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64))
    new: list[tuple[np.ndarray, ...]] = []

    def folded() -> tuple[np.ndarray, ...]:
        h, k, c = (np.concatenate(x) for x in zip(held, *new, strict=True))
        order = np.argsort(h, kind="stable")
        h, k, c = h[order], k[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        return h[at], k[at], np.add.reduceat(c, at) if len(h) else c

    for batch in batches:
        for _, _, data, offsets in row_chunks(*string_bytes(batch.column(0))):
            t = Tokens(data, offsets)
            h, at, c = np.unique(t.hash, return_index=True, return_counts=True)
            new.append((h, t.kind[at], c))
            if sum(len(x[0]) for x in new) > 500_000:
                held, new = folded(), []
    held, new = folded(), []
    for i in range(0, len(held[0]), 100_000):
        h, k, c = (x[i : i + 100_000] for x in held)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(k), pa.array(c)], ["h", "kind", "c"])


def symbols_for(distinct: int) -> int:
    """Symbols for so many distinct words: the root, without an upper bound (a billion words: 31,622 symbols, 19 MB of parameters and sums)."""
    return max(SYMBOLS, math.isqrt(distinct))


class Lexicon:
    """Counts of the frequent words, symbol numbers, and sizes of the classes."""

    def __init__(self, head: np.ndarray, total: int, distinct: int, classes: dict[int, tuple[int, int]], symbols: int | None = None):
        """head: rows (hash, class, count), most frequent first; classes: tokens and words of each over all words; symbols: by default ``symbols_for``."""
        self.total, self.distinct, self.symbols = total, distinct, symbols_for(distinct) if symbols is None else symbols
        names, kinds, counts = head.T if len(head) else np.zeros((3, 0), np.int64)
        top = names[: self.symbols]
        order = np.argsort(names.view(_U))
        self.names, self.counts, self.kinds = names.view(_U)[order], counts[order], kinds[order]
        self.symbol = np.full(len(names), -1, np.int64)
        self.symbol[np.searchsorted(self.names, top.view(_U))] = np.arange(len(top))
        tokens, kinds_of = np.zeros(CLASSES), np.zeros(CLASSES)
        for k, (t, w) in classes.items():
            tokens[k], kinds_of[k] = t, w
        np.subtract.at(tokens, kinds[: len(top)], counts[: len(top)])
        np.subtract.at(kinds_of, kinds[: len(top)], 1)
        self.class_norm = np.log10(tokens + ADDED * (kinds_of + 1))
        self.frequency = np.concatenate([counts[: self.symbols], np.zeros(self.symbols - len(top)), tokens]).astype(float)

    def look(self, t: Tokens) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol of every token, its count (0 if not broadcast), and whether it is broadcast."""
        if not len(self.names):
            return self.symbols + t.kind, np.zeros(len(t.hash), np.int64), np.zeros(len(t.hash), bool)
        at = np.minimum(np.searchsorted(self.names, t.hash), len(self.names) - 1)
        known = self.names[at] == t.hash
        symbol = np.where(known, self.symbol[at], -1)
        return np.where(symbol >= 0, symbol, self.symbols + t.kind), np.where(known, self.counts[at], 0), known


#: Symbols and classes of the smallest model.
_N = SYMBOLS + CLASSES


def contexts(symbol: np.ndarray, first: np.ndarray, start: int = _N) -> tuple[np.ndarray, np.ndarray]:
    """The symbol before each token and the one before that; ``start`` before the start."""
    one, two = np.empty_like(symbol), np.empty_like(symbol)
    one[1:], two[2:] = symbol[:-1], symbol[:-2]
    one[first] = two[first] = start
    second = first + 1
    second = second[second < len(symbol)]
    two[second] = np.where(np.isin(second, first), two[second], start)
    return one, two


def contrast(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, w: np.ndarray, drawn: np.ndarray, log_noise: np.ndarray) -> tuple[float, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The noise-contrastive objective of positions (contexts x and y, word w) against drawn noise words, and its gradients: rows of a table, and theirs.

    log_noise is the log of NOISE times a word's noise probability; each position has NOISE noise words in expectation.
    """
    q, r, noise = p["a"][x] + p["b"][y], p["r"][w], p["r"][drawn]
    s = np.clip(np.einsum("ij,ij->i", q, r) + p["bias"][w] - log_noise[w], -30, 30)
    z = np.clip(q @ noise.T + p["bias"][drawn] - log_noise[drawn], -30, 30)
    share = np.float32(NOISE / len(drawn))
    up, down = 1 / (1 + np.exp(s)), -share / (1 + np.exp(-z))
    gq, both = up[:, None] * r + down @ noise, np.concatenate([w, drawn])
    gradient = {"r": (both, np.concatenate([up[:, None] * q, down.T @ q])), "bias": (both, np.concatenate([up, down.sum(0)])), "a": (x, gq), "b": (y, gq)}
    return float(-np.log1p(np.exp(-s)).sum() - share * np.log1p(np.exp(z)).sum()), gradient


class Learner:
    """Noise-contrastive estimation with AdaGrad: context vectors by position, word vectors, biases; goes on from a state."""

    def __init__(self, state: dict[str, np.ndarray], frequency: np.ndarray, seed: Sequence[int]):
        self.rng = np.random.default_rng(seed)
        self.noise = (frequency + 0.5) / (frequency + 0.5).sum()
        self.log_noise, self.bins = (np.log(self.noise) + math.log(NOISE)).astype(np.float32), np.cumsum(self.noise)
        self.state = {k: v.copy() for k, v in state.items()}
        self.used = {k: np.zeros(len(state[k]), np.float32) for k in _TABLES}
        self.seen = 0

    def _step(self, k: str, at: np.ndarray, g: np.ndarray, rate: float) -> None:
        order = np.argsort(at, kind="stable")
        rows = at[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        total, times, rows = np.add.reduceat(g[order], first), np.diff(np.append(first, len(rows))), rows[first]
        past = self.state["past_" + k]
        past[rows] += total**2
        self.state[k][rows] += np.float32(rate) * total / np.sqrt(past[rows])
        self.used[k][rows] += times

    def learn(self, one: np.ndarray, two: np.ndarray, word: np.ndarray, passes: int = 1) -> None:
        p, n = self.state, len(word)
        batch = min(BATCH, max(64, n // 32))
        for _ in range(passes if n else 0):
            order = self.rng.permutation(n)
            for i in range(0, n, batch):
                at = order[i : i + batch]
                drawn = np.minimum(np.searchsorted(self.bins, self.rng.random(DRAWN)), len(self.bins) - 1)  # noise words shared by the batch: one matrix product
                _, up = contrast(p, one[at], two[at], word[at], drawn, self.log_noise)
                for k, (rows, g) in up.items():
                    self._step(k, rows, g, 0.05 if k == "bias" else 0.1)
        self.seen += n


_TABLES = ("a", "b", "r", "bias")


def start(frequency: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    """The parameters before the first round, and AdaGrad's sums of squares."""
    rng, n = np.random.default_rng(seed), len(frequency)
    p = {k: rng.normal(0, 0.1, (m, SIZE)).astype(np.float32) for k, m in (("a", n + 1), ("b", n + 1), ("r", n))}
    p["bias"] = np.log((frequency + 0.5) / (frequency + 0.5).sum()).astype(np.float32)
    return p | {"past_" + k: np.full(v.shape, 1e-2, np.float32) for k, v in p.items()}


def _weighed(learner: Learner) -> np.ndarray:
    """A partition's state, every row times its uses, then the uses and the positions, in one run of numbers."""
    times = lambda k, v: v * (learner.used[k] if v.ndim == 1 else learner.used[k][:, None])
    tables = [times(k.removeprefix("past_"), v).ravel() for k, v in learner.state.items()]
    return np.concatenate([*tables, *(learner.used[k] for k in _TABLES), [learner.seen]]).astype(float)


def _averaged(sums: np.ndarray, state: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], int]:
    """The common state after a round and the positions of the round; rows that no partition used stay."""
    parts, at = {}, 0
    for k, v in [*state.items(), *(("used_" + k, np.zeros(len(state[k]))) for k in _TABLES)]:
        parts[k], at = sums[at : at + v.size].reshape(v.shape), at + v.size
    out = {}
    for k, v in state.items():
        used = parts["used_" + k.removeprefix("past_")]
        used = used if v.ndim == 1 else used[:, None]
        out[k] = np.where(used > 0, parts[k] / np.maximum(used, 1), v).astype(np.float32)
    return out, round(sums[at])


def _round(box, number: int, passes: int):
    """Trains on all positions of a partition and yields its weighed state in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, state = box.value
        learner = Learner(state, lexicon.frequency, (5, number, TaskContext.get().partitionId()))
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> None:
            if held:
                learner.learn(*(np.concatenate(x) for x in zip(*held, strict=True)), passes)
                held.clear()

        for batch in batches:
            for _, _, data, offsets in row_chunks(*string_bytes(batch.column(0))):
                t = Tokens(data, offsets)
                symbol, _, _ = lexicon.look(t)
                held.append((*contexts(symbol, t.first, len(lexicon.frequency)), symbol))
                if sum(len(x[2]) for x in held) >= BUFFER:
                    flush()
        flush()
        if learner.seen:
            numbers = _weighed(learner)
            pieces = [numbers[i : i + PIECE // 8].tobytes() for i in range(0, len(numbers), PIECE // 8)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], ["piece", "numbers"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for piece, numbers in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(numbers.as_buffer(), float)
            sums[piece] = sums[piece] + x if piece in sums else x.copy()
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], ["piece", "numbers"])


def fit(learn: DataFrame, lexicon: Lexicon, passes: int = PASSES) -> tuple[dict[str, np.ndarray], int]:
    """The model of all positions of ``learn`` (id, text), and how many they were. Every document is in one round."""
    spark, state, seen = learn.sparkSession, start(lexicon.frequency), 0
    for number in range(ROUNDS if lexicon.total else 0):
        box = spark.sparkContext.broadcast((lexicon, state))
        share = learn.where(F.pmod(F.xxhash64("id"), F.lit(ROUNDS)) == number).select("text")
        pieces = share.mapInArrow(_round(box, number, passes), "piece int, numbers binary")
        rows = pieces.repartition(8, "piece").mapInArrow(_summed, "piece int, numbers binary").collect()  # the size of one state
        box.destroy()
        if rows:
            state, n = _averaged(np.concatenate([np.frombuffer(r.numbers, float) for r in sorted(rows)]), state)
            seen += n
    return {k: state[k] for k in _TABLES}, seen


class Scorer:
    """Normalised log-probabilities of symbols; normalisers of up to about ``held`` contexts are kept once computed."""

    def __init__(self, model: dict[str, np.ndarray], held: int = HELD):
        self.m, self.side, self.held = model, len(model["bias"]) + 1, held
        self.codes, self.norms = np.zeros(0, np.int64), np.zeros(0, np.float32)

    def _normalisers(self, codes: np.ndarray) -> np.ndarray:
        m, out = self.m, np.empty(len(codes), np.float32)
        step = max(1, (1 << 21) // len(m["bias"]))
        for i in range(0, len(codes), step):
            c = codes[i : i + step]
            z = (m["a"][c // self.side] + m["b"][c % self.side]) @ m["r"].T + m["bias"]
            top = z.max(1)
            out[i : i + step] = top + np.log(np.exp(z - top[:, None]).sum(1))
        return out

    def __call__(self, one: np.ndarray, two: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        m = self.m
        codes, at = np.unique(one * self.side + two, return_inverse=True)
        place = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        inside = place < len(self.codes)
        known[inside] = self.codes[place[inside]] == codes[inside]
        norms = np.empty(len(codes), np.float32)
        norms[known], norms[~known] = self.norms[place[known]], self._normalisers(codes[~known])
        if len(self.codes) + int((~known).sum()) > self.held:  # only those of these positions stay
            self.codes, self.norms = codes, norms
        elif not known.all():
            self.codes, self.norms = np.insert(self.codes, place[~known], codes[~known]), np.insert(self.norms, place[~known], norms[~known])
        logit = np.einsum("ij,ij->i", m["a"][one] + m["b"][two], m["r"][symbol]) + m["bias"][symbol]
        return (logit - norms[at]).astype(float)


_HALF = "id bigint, held_out boolean, n_tokens bigint, n_known bigint, base double, score double, rare array<struct<h:bigint,n:bigint>>"
_workers: dict[str, Scorer] = {}


def _scored(box, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, model = box.value
        if key not in _workers:
            _workers.clear()
            _workers[key] = Scorer(model)
        scorer = _workers[key]
        for batch in batches:
            for lo, hi, data, offsets in row_chunks(*string_bytes(batch.column(2))):
                t = Tokens(data, offsets)
                symbol, count, known = lexicon.look(t)
                own = scorer(*contexts(symbol, t.first, len(lexicon.frequency)), symbol) / _LOG10
                log_count = np.where(known, np.log10(count + ADDED), 0)
                own += np.where(symbol >= lexicon.symbols, log_count - lexicon.class_norm[np.maximum(symbol - lexicon.symbols, 0)], 0)
                n = hi - lo
                total = lambda x: np.bincount(t.row, x, n)
                h, row = t.hash[~known], t.row[~known]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                at = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (row[1:] != row[:-1])])) if len(h) else np.zeros(0, np.int64)
                times = np.diff(np.append(at, len(h)))
                items = pa.StructArray.from_arrays([pa.array(h[at].view(np.int64)), pa.array(times)], names=["h", "n"])
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[at], np.arange(n + 1)), pa.int32()), items)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(np.bincount(t.row, minlength=n)), pa.array(total(count > 0).astype(np.int64)), pa.array(total(log_count)), pa.array(total(own)), lists],
                    ["id", "held_out", "n_tokens", "n_known", "base", "score", "rare"],
                )

    return run


def _head(counts: DataFrame, most: int = HEAD) -> np.ndarray:
    """The most frequent words, about ``most``: all above a count that a small histogram of log counts gives, and some at it. Rows (hash, class, count), falling."""
    step = F.floor(F.log2("c") * 16).cast("int")
    above, limit, part = 0, None, None
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):  # 16 rows a doubling
        if above + r.n > most:  # of this step a share, by hash
            part = (r.step, int(0.98 * (1 << 20) * (most - above) / r.n))
            break
        above, limit = above + r.n, r.step
    wanted = F.lit(False) if limit is None else step >= limit
    if part:
        wanted |= (step == part[0]) & (F.col("h").bitwiseAND(F.lit((1 << 20) - 1)) < part[1])
    head = counts.where(wanted).select("h", "kind", "c").toPandas().to_numpy(np.int64).reshape(-1, 3)
    return head[np.lexsort((head[:, 0], -head[:, 2]))]


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return crc_of_id(doc_id) % 10 == 0


def log_bilinear(docs: DataFrame, symbols: int | None = None, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs`` (doc_id, text).

    ``symbols`` most frequent words have vectors of their own (by default ``symbols_for``, HEAD at most); every position is
    trained on ``passes`` times.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("id"), held_out().alias("held_out"), "text")
    learn = docs.where(~F.col("held_out"))
    counts = learn.select("text").mapInArrow(_counted, "h bigint, kind bigint, c bigint").groupBy("h").agg(F.first("kind").alias("kind"), F.sum("c").alias("c"))
    counts = stash(counts, "counts")
    sums = counts.groupBy("kind").agg(F.sum("c").alias("t"), F.count(F.lit(1)).alias("w")).collect()  # CLASSES rows at most
    total, distinct = sum(r.t for r in sums), sum(r.w for r in sums)
    head = _head(counts)
    lexicon = Lexicon(head, total, distinct, {r.kind: (r.t, r.w) for r in sums}, symbols)
    model, _ = fit(learn, lexicon, passes)
    both = spark.sparkContext.broadcast((lexicon, model))
    half = stash(docs.mapInArrow(_scored(both, uuid.uuid4().hex), _HALF).withColumn("row", F.monotonically_increasing_id()), "half")
    rare = half.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.n").join(counts.select("h", "c"), "h", "left")
    c = F.coalesce("c", F.lit(0))
    rare = rare.groupBy("row").agg(F.sum(F.col("n") * F.log10(c + F.lit(ADDED))).alias("extra"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("found"))
    out = half.drop("rare").join(rare, "row", "left")
    extra, norm = F.coalesce("extra", F.lit(0.0)), math.log10(total + ADDED * (distinct + 1))
    return out.select(
        F.col("id").alias("doc_id"), "held_out", "n_tokens", (F.col("n_known") + F.coalesce("found", F.lit(0))).alias("n_known"), F.lit(total).cast("bigint").alias("train_tokens"),
        (F.col("base") + extra - F.col("n_tokens") * F.lit(norm)).alias("base_score"), (F.col("score") + extra).alias("score"),
    )
