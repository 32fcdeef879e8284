"""Operator 1: toxic spans by a linear-chain conditional random field.

Documents are labelled, tokens are not, so token labels are derived first: Spark counts word and prefix features over
the labelled training documents, and a token of a toxic document is toxic if one of its features is bound to toxic
documents beyond chance (log-likelihood ratio, in enough different contexts that copies of one text don't count).
A two-state linear chain is then trained in numpy on segments of these tokens. Every document is scored by
forward-backward over its whole text: marginals of one half or more give the offending spans, and their sum,
the largest marginal and the length give the document's score by a logistic fit on the training documents, each of which
is tagged for it by a chain that was learned from the other half of them.

Null, empty and blank texts have no tokens and get the score of a document without toxic tokens. Texts are processed
whole, whatever their length. Rows are scored one by one, so repeated rows get equal scores; documents without a label are
only scored, and where labels are absent or of one class every score is the share of toxic labels (0 without labels). An
empty table gives an empty result. Columns of the input named score, predicted or toxic_spans give way to the operator's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import chained, crc_of_id, lowered, mix, row_chunks, small_batches, span_hash, span_sums, spans, string_bytes

#: Labelled documents, in hash order, from which features are counted and the field is trained.
TRAIN_DOCS = 8_000
#: Segments on which the chain is trained at most, and the tokens of a segment.
TRAIN_SEGMENTS, SEGMENT = 6_000, 32
#: Features bound to toxic documents that are kept at most.
SEEDS = 4_000
#: Least log-likelihood ratio and least number of contexts of such a feature.
LEAST_G2, LEAST_CONTEXTS = 30.0, 4
THRESHOLD = 0.3
_BITS = 18
_PREFIXES = (4, 5, 6, 7, 8)
_U = np.uint64
#: One number for each kind of feature, so that kinds don't share cells.
_SALT = mix(np.arange(1, 33, dtype=np.uint64))


class Words:
    """Hashes of the words of a run of rows and of their prefixes and suffixes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.rows = spans(data, offsets)
        sums = span_sums(lowered(data))
        s, e = self.starts, self.ends
        self.word = span_hash(sums, s, e)
        self.parts = [span_hash(sums, s, np.minimum(s + k, e)) + _U(k) for k in _PREFIXES]
        self.suffix = span_hash(sums, np.maximum(e - 3, s), e)
        capital = np.cumsum(np.concatenate([[0], (data >= 65) & (data <= 90)]))
        self.shape = np.minimum(capital[e] - capital[s], 2).astype(np.uint64) * _U(4) + np.minimum(e - s, 3).astype(np.uint64)
        self.previous, self.following = self._beside()

    def _beside(self) -> tuple[np.ndarray, np.ndarray]:
        before, after = np.zeros_like(self.word), np.zeros_like(self.word)
        same = self.rows[1:] == self.rows[:-1]
        before[1:], after[:-1] = np.where(same, self.word[:-1], 0), np.where(same, self.word[1:], 0)
        return before, after

    def own(self) -> list[np.ndarray]:
        """Features that can mark a token as toxic: the word and its prefixes."""
        return [self.word, *self.parts]

    def features(self) -> np.ndarray:
        """Cells of all features of the chain, a column each."""
        every = [*self.own(), self.suffix, self.previous, self.following, self.shape]
        return np.stack([(mix(x + salt) >> _U(64 - _BITS)).astype(np.int32) for salt, x in zip(_SALT, every, strict=False)], 1)


def _segments(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and lengths of runs of SEGMENT tokens at most within a row."""
    if not len(rows):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    inside = np.arange(len(rows)) - np.repeat(new, np.diff(np.append(new, len(rows))))
    firsts = np.flatnonzero(inside % SEGMENT == 0)
    return firsts, np.diff(np.append(firsts, len(rows)))


def _blocks(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of SEGMENT tokens at most of rows of such lengths: row, number within the row, length."""
    n = -(-lengths // SEGMENT)
    row = np.repeat(np.arange(len(lengths)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return row, k, np.minimum(lengths[row] - k * SEGMENT, SEGMENT)


def _messages(emission: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, row: np.ndarray, k: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every block (longest first) the log odds that come into its first token and, from behind, into its last one."""
    m, e = np.exp(move), np.exp(np.clip(emission, -60, 60))
    g = np.zeros((len(firsts), 2, 2))  # what a block makes of either state before its first token: (state after, state before)
    g[:, 0, 0], g[:, 1, 1] = 1, e[firsts]
    for t in range(1, int(lengths[0])):
        n = int(np.searchsorted(-lengths, -t, "left"))
        clean, toxic = g[:n, 0].copy(), g[:n, 1]
        g[:n, 0] = clean * m[0, 0] + toxic * m[1, 0]
        g[:n, 1] = (clean * m[0, 1] + toxic * m[1, 1]) * e[firsts[:n] + t, None]
        if t % 4 == 0:
            g[:n] /= g[:n].max((1, 2), keepdims=True)
    by = np.lexsort((row, k))  # first blocks of all rows, then second ones
    counts = np.bincount(k)
    ends, n_rows = np.cumsum(counts), int(row.max()) + 1
    into, back = np.zeros((len(firsts), 2)), np.zeros((len(firsts), 2))
    forward, backward = np.tile(np.exp(start - start.max()), (n_rows, 1)), np.ones((n_rows, 2))
    for hi, n in zip(ends, counts, strict=True):
        at = by[hi - n : hi]
        into[at] = forward[row[at]]
        a = np.einsum("bij,bj->bi", g[at], into[at]) @ m
        forward[row[at]] = a / a.max(1, keepdims=True)
    for hi, n in zip(ends[::-1], counts[::-1], strict=True):
        at = by[hi - n : hi]
        back[at] = backward[row[at]]
        b = np.einsum("bij,bi->bj", g[at], back[at]) @ m.T
        backward[row[at]] = b / b.max(1, keepdims=True)
    odds = lambda x: np.log(np.maximum(x[:, 1], 1e-300)) - np.log(np.maximum(x[:, 0], 1e-300))
    return odds(into), odds(back)


def marginals(emission: np.ndarray, firsts: np.ndarray, lengths: np.ndarray, start: np.ndarray, move: np.ndarray) -> np.ndarray:
    """Probability of the toxic state for every token: forward-backward over whole rows of any length.

    emission is the toxic state's score less the clean one's; start and move are log potentials. Rows are worked on in
    blocks side by side; what reaches a block from the tokens before and behind it is found first, so nothing is cut.
    """
    out = np.zeros(len(emission))
    firsts, lengths = firsts[lengths > 0], lengths[lengths > 0]
    if not len(firsts):
        return out
    row, k, n = _blocks(lengths)
    order = np.argsort(-n, kind="stable")
    row, k, lengths = row[order], k[order], n[order]
    firsts = firsts[row] + k * SEGMENT
    into, back = _messages(emission, firsts, lengths, row, k, start, move)
    alive = [int(np.searchsorted(-lengths, -t, "left")) for t in range(int(lengths[0]))]  # blocks longer than t
    forward = [emission[firsts] + into]  # log odds of the toxic state given the tokens so far
    for t in range(1, len(alive)):
        a = forward[-1][: alive[t]]
        forward.append(emission[firsts[: alive[t]] + t] + np.logaddexp(move[0, 1], move[1, 1] + a) - np.logaddexp(move[0, 0], move[1, 0] + a))
    backward = back
    for t in range(len(alive) - 1, -1, -1):
        n = alive[t]
        out[firsts[:n] + t] = 1 / (1 + np.exp(-np.clip(forward[t] + backward[:n], -60, 60)))
        b = backward[:n] + emission[firsts[:n] + t]
        backward[:n] = np.logaddexp(move[1, 0], move[1, 1] + b) - np.logaddexp(move[0, 0], move[0, 1] + b)
    return out


def chain_gradient(cells: np.ndarray, toxic: np.ndarray, lengths: np.ndarray, w: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Conditional log-likelihood of chains of SEGMENT tokens at most, and its gradient by weights, start and transitions."""
    firsts = np.cumsum(lengths) - lengths
    pad = firsts[:, None] + np.arange(SEGMENT)
    mask = np.arange(SEGMENT) < lengths[:, None]
    at = np.where(mask, pad, 0)
    y = np.where(mask, toxic[at], 0).astype(np.int64)
    e = np.where(mask, w[cells].sum(1)[at], 0)
    emit = np.stack([np.zeros_like(e), e], 2)
    alpha, beta = np.zeros((len(lengths), SEGMENT, 2)), np.zeros((len(lengths), SEGMENT, 2))
    alpha[:, 0] = start + emit[:, 0]
    for t in range(1, SEGMENT):
        alpha[:, t] = np.where(mask[:, t, None], emit[:, t] + np.logaddexp(alpha[:, t - 1, :1] + move[0], alpha[:, t - 1, 1:] + move[1]), alpha[:, t - 1])
    z = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])
    for t in range(SEGMENT - 2, -1, -1):
        nxt = emit[:, t + 1] + beta[:, t + 1]
        beta[:, t] = np.where(mask[:, t + 1, None], np.logaddexp(nxt[:, :1] + move[:, 0], nxt[:, 1:] + move[:, 1]), 0)
    p = np.exp(alpha + beta - z[:, None, None])
    steps = mask[:, 1:] & mask[:, :-1]
    before, after = y[:, :-1][steps], y[:, 1:][steps]
    pairs, seen = np.zeros((2, 2)), np.zeros((2, 2))
    np.add.at(seen, (before, after), 1.0)
    for i in range(2):
        for j in range(2):
            x = alpha[:, :-1, i] + move[i, j] + emit[:, 1:, j] + beta[:, 1:, j] - z[:, None]
            pairs[i, j] = np.exp(x[steps]).sum()
    wrong = np.zeros(len(toxic))
    wrong[pad[mask]] = (y - p[:, :, 1])[mask]
    score = start[y[:, 0]].sum() + (e * y).sum() + move[before, after].sum() - z.sum()
    up = np.bincount(cells.ravel(), np.repeat(wrong, cells.shape[1]), len(w))
    return float(score), [up, np.bincount(y[:, 0], minlength=2) - p[:, 0].sum(0), seen - pairs]


def train_chain(cells: np.ndarray, toxic: np.ndarray, lengths: np.ndarray, rounds: int = 60, ridge: float = 0.02) -> dict:
    """Fit weights, start and transition potentials by AdaGrad on the exact gradient of the conditional likelihood."""
    used, cells = np.unique(cells, return_inverse=True)
    cells = cells.reshape(len(toxic), -1)
    known = [np.zeros(len(used)), np.zeros(2), np.zeros((2, 2))]
    squares = [np.full_like(x, 1e-3) for x in known]
    for _ in range(rounds):
        _, up = chain_gradient(cells, toxic, lengths, *known)
        for x, g, s in zip(known, up, squares, strict=True):
            g = g - ridge * x
            s += g * g
            x += 0.3 * g / np.sqrt(s)
    weights = np.zeros(1 << _BITS, np.float32)
    weights[used] = known[0]
    return {"weights": weights, "start": known[1], "move": known[2]}


def sampled_labels(labels: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """At most ``bound`` labelled ids outside the held-out quarter, in hash order; a repeated id is toxic if any row is."""
    rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(crc_of_id() % 4 != 2)
    rows = rows.groupBy(F.col("doc_id").alias("_label_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    return rows.orderBy(F.xxhash64("_label_id"), "_label_id").limit(bound)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per feature of a partition: contexts in toxic texts as a bit set, tokens in toxic and in clean texts."""
    held: list[tuple[np.ndarray, ...]] = []

    def folded() -> tuple[np.ndarray, ...]:
        f, bits, t, c = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.argsort(f, kind="stable")
        f, bits, t, c = f[order], bits[order], t[order], c[order]
        at = np.flatnonzero(np.concatenate([[True], f[1:] != f[:-1]]))
        return f[at], np.bitwise_or.reduceat(bits, at), np.add.reduceat(t, at), np.add.reduceat(c, at)

    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in row_chunks(*string_bytes(batch.column(0))):
            x = Words(data, offsets)
            if not len(x.word):
                continue
            t = toxic[lo:hi][x.rows].astype(np.int64)
            bit = _U(1) << (chained(x.previous, x.following) >> _U(58))
            for own in x.own():
                held.append((own, np.where(t == 1, bit, _U(0)), t, 1 - t))
            held[:] = [folded()]
    if held:
        f, bits, t, c = held[0]
        for i in range(0, len(f), 50_000):
            s = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(f[s].view(np.int64)), pa.array(bits[s].view(np.int64)), pa.array(t[s]), pa.array(c[s])], ["f", "bits", "t", "c"])


def _distinct_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """Different texts of the sampled documents with their label (TRAIN_DOCS rows at most are broadcast)."""
    d = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_label_id")).select("text", "_toxic")
    return d.groupBy(F.xxhash64("text").alias("_h")).agg(F.first("text", True).alias("text"), F.max("_toxic").alias("toxic")).select("text", "toxic", F.pmod("_h", F.lit(2)).cast("int").alias("half"))


def seed_features(texts: DataFrame) -> np.ndarray:
    """Hashes of the word and prefix features bound to toxic texts, sorted; SEEDS at most, the strongest."""
    counts = texts.select("text", "toxic").mapInArrow(_counted, "f bigint, bits bigint, t bigint, c bigint")
    total = counts.groupBy("f").agg(F.expr("bit_or(bits)").alias("bits"), F.sum("t").alias("t"), F.sum("c").alias("c"))
    total = total.where(f"bit_count(bits) >= {LEAST_CONTEXTS}").where("t >= 8 * c")
    share = texts.select(F.size(F.split(F.coalesce("text", F.lit("")), " ")).alias("n"), "toxic").agg(
        F.sum(F.when(F.col("toxic") == 1, F.col("n"))).alias("t"), F.sum("n").alias("n")
    ).first()
    if not share.t or share.t == share.n:
        return np.zeros(0, _U)
    p = share.t / share.n
    k, c = F.least(F.expr("bit_count(bits)").cast("double"), F.col("t").cast("double")), F.col("c").cast("double")
    term = lambda x, q: F.when(x > 0, x * F.ln(x / ((k + c) * F.lit(q)))).otherwise(0.0)
    g2 = 2 * (term(k, p) + term(c, 1 - p))
    rows = total.withColumn("g2", g2).where(F.col("g2") >= LEAST_G2).orderBy(F.desc("g2"), "f").limit(SEEDS).select("f").collect()
    return np.sort(np.array([r.f for r in rows], np.int64).view(_U))


def _segment_rows(seeds: np.ndarray, keep: float):
    """Segments of the training texts: all with a toxic token, and a share of the others."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in row_chunks(*string_bytes(batch.column(0))):
                x = Words(data, offsets)
                if not len(x.word):
                    continue
                marked = np.isin(np.stack(x.own(), 1), seeds).any(1) & (toxic[lo:hi][x.rows] == 1)
                cells = x.features()
                firsts, lengths = _segments(x.rows)
                rank = chained(x.word[firsts], x.word[firsts + lengths - 1], lengths.astype(_U))
                has = np.add.reduceat(marked, firsts) > 0
                for i in np.flatnonzero(has | (rank.astype(np.float64) < keep * 2.0**64)):
                    s = slice(firsts[i], firsts[i] + lengths[i])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(rank[i].view(np.int64))]), pa.array([bool(has[i])]), pa.array([marked[s].tobytes()]), pa.array([cells[s].tobytes()])],
                        ["rank", "has", "marked", "cells"],
                    )

    return emit


def tag(model: dict, data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray]:
    """The words of a run of rows and their probabilities of being toxic."""
    x = Words(data, offsets)
    w = model["weights"]
    e = np.zeros(len(x.word))
    if len(x.word):
        cells = x.features()
        for k in range(cells.shape[1]):
            e += w[cells[:, k]]
    firsts = np.flatnonzero(np.concatenate([[True], x.rows[1:] != x.rows[:-1]])) if len(x.rows) else np.zeros(0, np.int64)
    return x, marginals(e, firsts, np.diff(np.append(firsts, len(x.rows))), model["start"], model["move"])


def _evidence(x: Words, p: np.ndarray, n: int) -> np.ndarray:
    """Per row: sum of the marginals of one half or more, largest marginal, number of words."""
    strong = np.where(p >= 0.5, p, 0)
    most = np.zeros(n)
    np.maximum.at(most, x.rows, p)
    return np.stack([np.bincount(x.rows, strong, n), most, np.bincount(x.rows, minlength=n)], 1)


def _inputs(evidence: np.ndarray) -> np.ndarray:
    total, most, n = evidence.T
    return np.stack([np.ones(len(total)), np.log1p(total), most, total > 1.5, np.log1p(total) * np.log1p(n) / 8], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if abs(step).max() < 1e-8:
            break
    return b


def _chain(texts: DataFrame, n: int) -> dict:
    """The chain learned from ``texts`` (text, toxic), of which there are n."""
    seeds = seed_features(texts)
    rows = texts.select("text", "toxic").mapInArrow(_segment_rows(seeds, min(1.0, TRAIN_SEGMENTS / n / 8)), "rank bigint, has boolean, marked binary, cells binary")
    rows = [r for part in (True, False) for r in rows.where(F.col("has") == part).orderBy("rank", "cells").limit(TRAIN_SEGMENTS // 2).collect()]
    toxic = np.concatenate([np.zeros(0, bool), *(np.frombuffer(r.marked, bool) for r in rows)])
    cells = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(r.cells, np.int32) for r in rows)]).reshape(len(toxic), -1) if len(toxic) else np.zeros((0, 1), np.int32)
    return train_chain(cells, toxic.astype(np.int64), np.array([len(r.marked) for r in rows], np.int64))


def _seen(texts: DataFrame, model: dict) -> np.ndarray:
    """Evidence and label of every one of ``texts`` (TRAIN_DOCS rows at most)."""
    box = texts.sparkSession.sparkContext.broadcast(model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_evidence(*tag(box.value, data, offsets), hi - lo) for lo, hi, data, offsets in row_chunks(*string_bytes(batch.column(0)))]
            if out:
                yield pa.RecordBatch.from_arrays([*map(pa.array, np.concatenate(out).T), batch.column(1)], ["a", "b", "c", "toxic"])

    rows = texts.select("text", "toxic").mapInArrow(evidence, "a double, b double, c double, toxic int").collect()
    box.destroy()
    return np.array([tuple(r) for r in rows], float).reshape(-1, 4)


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Learn token labels, the chain and the document score from the labelled training documents."""
    small_batches(docs.sparkSession)
    sample = sampled_labels(labels)
    texts = _distinct_texts(docs, sample).persist()
    try:
        sizes = {(r.toxic, r.half): r.n for r in texts.groupBy("toxic", "half").agg(F.count(F.lit(1)).alias("n")).collect()}
        n, bad = sum(sizes.values()), sum(k for (toxic, _), k in sizes.items() if toxic)
        if not n or bad in (0, n):
            return {"constant": bad / n if n else 0.0}
        parts = [sum(sizes.get((t, half), 0) for t in (0, 1)) for half in (0, 1)]
        if all(sizes.get((t, half)) for t in (0, 1) for half in (0, 1)):  # each half is tagged by the chain of the other
            halves = [(texts.where(F.col("half") == h), _chain(texts.where(F.col("half") == 1 - h), parts[1 - h])) for h in (0, 1)]
            seen = np.concatenate([_seen(*x) for x in halves])
            model = _chain(texts, n)
        else:
            model = _chain(texts, n)
            seen = _seen(texts, model)
        return model | {"logistic": fit_logistic(_inputs(seen[:, :3]), seen[:, 3])}
    finally:
        texts.unpersist()


_SPANS = "array<struct<start:bigint,end:bigint,score:double>>"


def score(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Adds score, predicted and toxic_spans (code-point offsets of runs of toxic words) to every row."""
    spark, schema = docs.sparkSession, docs.schema
    small_batches(spark)
    names = [c for c in docs.columns if c not in ("score", "predicted", "toxic_spans")]
    docs = docs.select(*[F.col(f"`{c}`") for c in names])
    if "constant" in model:
        return docs.withColumns({"score": F.lit(model["constant"]), "predicted": F.lit(int(model["constant"] >= THRESHOLD)), "toxic_spans": F.array().cast(_SPANS)})
    box = spark.sparkContext.broadcast(model)
    text_at = names.index(text_col)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = box.value
        for batch in batches:
            scores, counts, found = [np.zeros(0)], [np.zeros(0, np.int64)], [np.zeros((0, 3))]
            for lo, hi, data, offsets in row_chunks(*string_bytes(batch.column(text_at))):
                x, p = tag(model, data, offsets)
                z = _inputs(_evidence(x, p, hi - lo)) @ model["logistic"]
                scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
                on = np.flatnonzero(p >= 0.5)
                head = np.concatenate([[True], (np.diff(on) > 1) | (np.diff(x.rows[on]) != 0)]) if len(on) else np.zeros(0, bool)
                first, last = on[head], on[np.concatenate([head[1:], [True]])] if len(on) else on
                chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                base = chars[offsets[x.rows[first]]]
                mean = np.add.reduceat(p[on], np.flatnonzero(head)) / np.diff(np.append(np.flatnonzero(head), len(on))) if len(on) else np.zeros(0)
                found.append(np.stack([chars[x.starts[first]] - base, chars[x.ends[last]] - base, mean], 1))
                counts.append(np.bincount(x.rows[first], minlength=hi - lo))
            s, at = np.concatenate(scores), np.concatenate([[0], np.cumsum(np.concatenate(counts))])
            a, b, c = np.concatenate(found).T
            items = pa.StructArray.from_arrays([pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(c)], fields=list(kind.value_type))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), items)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32)), lists], [*batch.schema.names, "score", "predicted", "toxic_spans"])

    added = T.StructType.fromDDL(f"score double, predicted int, toxic_spans {_SPANS}")
    return docs.mapInArrow(run, T.StructType([schema[c] for c in names] + added.fields))


def held_out(doc_id: Column | str = "doc_id") -> Column:
    return crc_of_id(doc_id) % 4 == 2


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from ``labels`` and score every row of ``docs`` (doc_id, text)."""
    return score(docs, fit(docs.select("doc_id", "text"), labels))
