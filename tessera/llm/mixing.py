"""Operator 3: mixing sources to target weights by temperature.

Token shares of the sources are raised to an exponent and normalised; the exponent is bisected until the mixture has a
target entropy, and again until no source is repeated more often than allowed. A token budget then gives every source a
number of whole epochs and a part of one more. An epoch is a permutation of the source's documents in blocks (hash
ranges); the part takes whole blocks, then whole sub-blocks of the next block, then documents in order until the next
one would exceed the budget. What is chosen is one threshold on the hash per source, so texts are never shuffled. Every
copy has its epoch, its block and its place in the epoch's permutation, and a point in [0, 1) of the whole mixture at which
it is read: epochs follow each other, and the sources' rows alternate so that every stretch holds the target weights.

Exponents beyond HIGHEST are not tried: a lower entropy than the one at HIGHEST stays unmet (shares of 2 to 1 have by then
weights of 256 to 1).

Tokens are words of whole texts. A null source is a source of its own. Documents without words are never chosen, and a
source without words has no weight. Rows that repeat an id, or have none, are chosen together within their source. An empty
table gives an empty result. Of columns named as the operator's own (copies, weight, places; epoch, block, place, point) the
operator's stay; other names can't clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stash, words

#: Entropy of the mixture as a share of the largest possible one (equal weights).
ENTROPY_SHARE = 0.97
#: Times a source may be read at most.
REPEATS = 2.0
#: Tokens of the mixture as a share of the tokens of the input.
BUDGET_SHARE = 1.0
SEED = 17
#: Exponents that one pass over the sources tries: 15 are four steps of bisection.
_TRIES = 15
_BLOCK_BITS = 12
#: Places of an epoch.
_WHOLE = float(1 << 63)
#: Sources whose figures are broadcast at most; beyond that the rows of a source are dealt to so many tasks.
BROADCAST_SOURCES, SALTS = 100_000, 32
#: Largest exponent that is tried; equal shares have no higher entropy at any.
HIGHEST = 8.0


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s:"), source.cast("string")), F.lit("null"))


def _place(epoch: Column, doc_id: Column, seed: int) -> Column:
    """Place of a document in the permutation of an epoch, from 0 to 2**63 - 1."""
    return F.shiftrightunsigned(F.xxhash64(F.coalesce(doc_id, F.lit(0)), F.lit(seed), epoch.cast("int")), 1)


def _bisect(low: float, high: float, values: Callable[[list[float]], list[float]], at_least: float, rounds: int = 10) -> float:
    """Largest exponent of [low, high] at which a falling function is still at least ``at_least``; low if none is."""
    for _ in range(rounds):
        tries = [low + (high - low) * k / (_TRIES + 1) for k in range(1, _TRIES + 1)]
        kept = [t for t, v in zip(tries, values(tries), strict=True) if v >= at_least]
        step = (high - low) / (_TRIES + 1)
        low = max(kept, default=low)
        high = low + step
    return low


def exponent(sources: DataFrame, entropy_share: float | None, repeats: float | None, budget_share: float) -> tuple[float, float]:
    """The exponent and the sum of the raised shares, from one row (share) per source.

    It is the largest one, up to HIGHEST, that leaves the entropy; where a source would then be repeated too often, the nearest
    to it that doesn't. A limit that no mixture can meet is an error.
    """
    if entropy_share is not None and not 0 < entropy_share <= 1 or repeats is not None and repeats < budget_share:
        raise ValueError("the entropy's share must lie in (0, 1], and the budget's share can't exceed the repeats")

    def sums(tries: list[float]) -> list[tuple[float, float, float]]:
        p = F.col("share")
        cells = [x for t in tries for x in (F.sum(F.pow(p, F.lit(t))), F.sum(F.pow(p, F.lit(t)) * F.ln(p)), F.max(F.pow(p, F.lit(t - 1))))]
        row = sources.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).first()
        return [tuple(row[3 * i : 3 * i + 3]) for i in range(len(tries))]

    def entropies(tries: list[float]) -> list[float]:
        return [math.log(z) - t * d / z for t, (z, d, _) in zip(tries, sums(tries), strict=True)]

    def fewest(tries: list[float]) -> list[float]:
        """Largest repetition at 1 - t, negated: it grows as the exponent leaves 1."""
        return [-budget_share * m / z for z, _, m in sums([1 - t for t in tries])]

    def most(tries: list[float]) -> list[float]:
        return [-budget_share * m / z for z, _, m in sums(tries)]

    n = sources.count()
    tau = 1.0
    if entropy_share is not None and n > 1:
        tau = _bisect(0.0, HIGHEST, entropies, entropy_share * math.log(n))
    if repeats is not None and tau < 1:
        tau = max(tau, 1 - _bisect(0.0, 1.0, fewest, -repeats))
    elif repeats is not None and tau > 1:
        tau = min(tau, _bisect(1.0, HIGHEST, most, -repeats))
    return tau, sums([tau])[0][0]


def _beside(rows: DataFrame, figures: DataFrame, sources: int, salt: Column) -> DataFrame:
    """``rows`` with the figures of their source (both have the column key): broadcast, or the rows of a source dealt out."""
    figures = figures.withColumnRenamed("key", "_key")
    if sources <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(figures), F.col("key") == F.col("_key"), "left").drop("_key")
    figures = figures.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    rows = rows.withColumn("_salt", F.pmod(salt, F.lit(SALTS)))
    return rows.join(figures, (F.col("key") == F.col("_key")) & (F.col("_salt") == F.col("_part")), "left").drop("_key", "_salt", "_part")


def _boundary(rows: DataFrame, level: Column) -> DataFrame:
    """Per source the first block that doesn't fit whole into what is left of the budget, and what is left before it."""
    blocks = rows.withColumn("block", level).groupBy("key", "left", "block").agg(F.sum("n").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("block")) - F.col("n")
    blocks = blocks.withColumn("before", before).where(F.col("before") + F.col("n") > F.col("left"))
    return blocks.groupBy("key").agg(F.min_by(F.struct("block", (F.col("left") - F.col("before")).alias("left")), "block").alias("at")).select("key", "at.block", F.col("at.left").alias("rest"))


def plan(
    docs: DataFrame, entropy_share: float | None = ENTROPY_SHARE, repeats: float | None = REPEATS, budget_share: float = BUDGET_SHARE, seed: int = SEED
) -> DataFrame:
    """One row per source: key, n_docs, tokens, weight, epochs (whole), budget (tokens), threshold of the last epoch."""
    light = docs.select(_key(F.col("source")).alias("key"), F.col("doc_id").alias("id"), F.size(words(F.col("text"))).cast("long").alias("n")).where("n > 0")
    light = stash(light, "light")
    sources = stash(light.groupBy("key").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("n_docs")), "sources")
    total = sources.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return sources.select("key", "n_docs", "tokens", F.lit(0.0).alias("weight"), F.lit(0).alias("epochs"), F.lit(0).cast("long").alias("budget"), F.lit(0).cast("long").alias("threshold"))
    shares = sources.withColumn("share", F.col("tokens") / F.lit(float(total)))
    tau, z = exponent(shares, entropy_share, repeats, budget_share)
    budget = F.floor(F.col("weight") * F.lit(float(total) * budget_share) + 1e-6)
    mixed = shares.withColumn("weight", F.pow("share", F.lit(tau)) / F.lit(z)).withColumn("budget", budget)
    mixed = mixed.withColumn("epochs", F.floor(F.col("budget") / F.col("tokens")).cast("int")).withColumn("left", F.col("budget") - F.col("epochs") * F.col("tokens"))
    mixed = stash(mixed.drop("share"), "mixed")
    shift, n_sources = 63 - _BLOCK_BITS, mixed.count()
    rows = _beside(light, mixed.select("key", "left", "epochs"), n_sources, F.xxhash64("id", "n"))
    rows = rows.groupBy("key", "left", _place(F.col("epochs"), F.col("id"), seed).alias("u")).agg(F.sum("n").alias("n"))  # one row a place, however many share it
    rows = stash(rows, "places")
    for name in ("first", "second"):  # the block, then the sub-block, where the budget ends
        b = _boundary(rows, F.shiftright("u", shift)).withColumnRenamed("key", "_key")
        side = F.broadcast(b) if n_sources <= BROADCAST_SOURCES else b
        rows = rows.join(side, (F.col("key") == F.col("_key")) & (F.shiftright("u", shift) == F.col("block"))).select("key", F.col("rest").alias("left"), "n", "u")
        rows = stash(rows, name)
        shift -= _BLOCK_BITS
    w = Window.partitionBy("key").orderBy("u")  # places of one sub-block: a 2**24th of a source
    last = rows.withColumn("over", F.sum("n").over(w)).where(F.col("over") > F.col("left")).groupBy("key").agg(F.min("u").alias("threshold"))
    return mixed.join(last, "key", "left").select("key", "n_docs", "tokens", "weight", "epochs", "budget", F.coalesce("threshold", F.lit(0)).alias("threshold"))


def _copied(docs: DataFrame, mixture: DataFrame, seed: int) -> DataFrame:
    """Every row of ``docs`` as a struct, its number of copies and its weight."""
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(F.col("source")).alias("key"), F.col("doc_id").alias("id"), (F.size(words(F.col("text"))) > 0).alias("some"))
    mixture = stash(mixture, "mixture")
    d = _beside(d, mixture.select("key", "epochs", "threshold", "weight"), mixture.count(), F.xxhash64("id"))
    part = (_place(F.col("epochs"), F.col("id"), seed) < F.col("threshold")).cast("int")
    n = F.when(F.col("some"), F.coalesce(F.col("epochs") + part, F.lit(0))).otherwise(0)
    return d.select("row", "id", n.alias("copies"), F.coalesce("weight", F.lit(0.0)).alias("weight"), (F.col("epochs") + F.col("threshold") / F.lit(_WHOLE)).alias("length"))


def _places(seed: int) -> Column:
    """Epoch, block, place and point of every copy of a row; the point is the place among all that its source gives."""

    def of(epoch: Column) -> Column:
        place = _place(epoch, F.col("id"), seed)
        point = (epoch + place / F.lit(_WHOLE)) / F.col("length")
        return F.struct(epoch.alias("epoch"), F.shiftright(place, 63 - _BLOCK_BITS).cast("int").alias("block"), place.alias("place"), point.alias("point"))

    return F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), of)).otherwise(F.array())


def copies(docs: DataFrame, mixture: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds the number of times that every row of ``docs`` is in the mixture (int), its source's weight, and its places (see ``ordered``)."""
    names = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("copies", "weight", "places")]
    return _copied(docs, mixture, seed).select(*names, "copies", "weight", _places(seed).alias("places"))


def mix_sources(docs: DataFrame, **targets) -> DataFrame:
    """``docs`` with copies, weight and places."""
    return copies(docs, plan(docs, **targets), targets.get("seed", SEED))


def realise(docs: DataFrame, **targets) -> DataFrame:
    """The mixture itself: the rows of ``docs``, each as often as it is in it."""
    d = _copied(docs, plan(docs, **targets), targets.get("seed", SEED)).where("copies > 0")
    return d.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def ordered(docs: DataFrame, **targets) -> DataFrame:
    """The mixture with the order in which it is read: a row per copy with epoch, block (hash range of the epoch's permutation), place and point.

    Sorted by (epoch, place) the rows of a source are its permutations one after the other; sorted by point all sources are read side by side.
    """
    seed = targets.get("seed", SEED)
    d = _copied(docs, plan(docs, **targets), seed).where("copies > 0").select("row", F.explode(_places(seed)).alias("at"))
    names = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("epoch", "block", "place", "point")]
    return d.select(*names, "at.*")
