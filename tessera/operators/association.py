"""Correlation, agreement, and adjustment of families of p-values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ranks
from tessera.functions.ranks import value_ranks
from tessera.functions.shared import same, written
from tessera.functions.special import normal_ppf, t_two_sided
from tessera.functions.stats import concordance, fisher_bounds, pearson, ratio

CORRECTIONS = ("holm", "fdr_bh")


def quantile(confidence: float) -> float:
    return float(normal_ppf(0.5 + confidence / 2))


def _p_value(r, n):
    """Two-sided p-value of a correlation by the t distribution; 0 at |r| = 1, NULL for two pairs or fewer."""
    free = F.when(n > 2, (n - 2).cast("double"))
    t = r * F.sqrt(F.try_divide(free, 1 - r * r))
    return F.when((F.abs(r) >= 1) & (n > 2), 0.0).otherwise(t_two_sided(t, free))


def check_pairs(df: DataFrame, x: str, y: str) -> int:
    """Number of pairs; an error if they are fewer than three, or if any value is null, NaN or infinite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf"))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(bad(x) | bad(y)).alias("bad")).first()
    if row.bad or row.n < 3:
        raise ValueError(f"{row.n} pairs, {row.bad} of them without two finite values; three finite ones are needed")
    return row.n


def pearson_ci(df: DataFrame, x: str, y: str, by: Sequence[str] = (), confidence: float = 0.95, p_value: bool = True) -> DataFrame:
    """Per group: n, Pearson's r, its Fisher interval and p-value. Rows with a null on either side don't count."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson(x, y).alias("r"))
    d = d.withColumn("r", F.when(F.col("r").isNotNull(), F.greatest(F.least(F.col("r"), F.lit(1.0)), F.lit(-1.0))))
    low, high = fisher_bounds(F.col("r"), F.col("n"), quantile(confidence))
    d = d.withColumns({"ci_low": low, "ci_high": high})
    return d.withColumn("p_value", _p_value(F.col("r"), F.col("n"))) if p_value else d


def _few_values(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> list[bool]:
    """Whether each column has few enough values (within ``by``) that figures of them can be broadcast; the choice changes no result."""
    kinds = [F.struct(*by, F.col(c).cast("double")) for c in columns]
    row = df.agg(*[F.approx_count_distinct(k).alias(f"n{i}") for i, k in enumerate(kinds)]).first()
    return [n <= 0.9 * ranks.BROADCAST_VALUES for n in row]


def _by_values(df: DataFrame, features: Sequence[str], target: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group and feature (its number k): n and rho with the target over the rows that have both; features have few values.

    The features' ranks are broadcast to the rows, and their sums are taken by different targets, which alone are shuffled
    and put in order: with all features together, whatever the number of pairs.
    """
    by, x = list(by), [f"_x{k}" for k in range(len(features))]
    d = df.select(*by, F.col(target).cast("double").alias("_y"), *[F.col(c).cast("double").alias(n) for c, n in zip(features, x, strict=True)]).where("_y IS NOT NULL")
    values = None
    for k, c in enumerate(x):
        part = d.where(F.col(c).isNotNull()).groupBy(*by, F.col(c).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", F.lit(k))
        values = part if values is None else values.unionByName(part)
    own = Window.partitionBy(*by, "_k")
    below = F.coalesce(F.sum("_n").over(own.orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    values = written(written(values, "values").withColumn("_all", F.sum("_n").over(own)).withColumn("_a", below + (F.col("_n") + 1) / 2 - (F.col("_all") + 1) / 2), "centred")
    names = [f"_g{i}" for i in range(len(by))]
    for k, c in enumerate(x):
        of = values.where(F.col("_k") == k).select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], "_v", F.col("_a").alias(f"_a{k}"))
        d = d.join(F.broadcast(of), (F.col(c) == F.col("_v")) & same(by, names), "left").drop("_v", *names)  # BROADCAST_VALUES rows or so
    sums = [f(F.col(f"_a{k}")).alias(f"_{n}{k}") for k in range(len(x)) for n, f in (("n", F.count), ("s", F.sum))]
    d = written(d.groupBy(*by, "_y").agg(*sums), "targets")
    # Features that have the same rows as the first share its ranks of the target.
    others = [k for k in range(1, len(x)) if not d.where(F.col(f"_n{k}") != F.col("_n0")).isEmpty()]
    part = ranks.numeric_range(d, "_y")
    for k in (0, *others):
        d = ranks.before(d, f"_n{k}", ["_y"], by, part, f"_r{k}")
    totals = values.groupBy(*by, F.col("_k")).agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") * F.col("_a") * F.col("_a")).alias("_aa"))
    rows = [F.struct(F.lit(k).alias("k"), F.col(f"_n{k}").alias("m"), F.coalesce(f"_s{k}", F.lit(0.0)).alias("s"), F.col(f"_r{k if k in others else 0}").alias("r")) for k in range(len(x))]
    d = d.select(*by, F.explode(F.array(*rows)).alias("f")).select(*by, "f.*").where("m > 0")
    d = d.join(F.broadcast(totals.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], "_k", "_all", "_aa")), (F.col("k") == F.col("_k")) & same(by, names)).drop(*names)  # a row a group and feature
    b = F.col("r") + (F.col("m") + 1) / 2 - (F.col("_all") + 1) / 2
    out = d.groupBy(*by, "k").agg(F.sum("m").alias("n"), F.sum(F.col("s") * b).alias("_ab"), F.sum(F.col("m") * b * b).alias("_bb"), F.first("_aa").alias("_aa"))
    return out.select(*by, "k", "n", ratio("_ab", F.sqrt(F.col("_aa") * F.col("_bb"))).alias("rho"))


def rank_correlation(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: n and Pearson's r of the average ranks (rho).

    Where a side has few values, its ranks are broadcast (see ``_by_values``). Else equal pairs are counted first; ranks are
    those of different values, so ties cost nothing and no group is one task.
    """
    by = list(by)
    for few, a, b in zip(_few_values(df, [x, y], by), (x, y), (y, x), strict=True):
        if few:
            return _by_values(df, [a], b, by).drop("k")
    pairs = written(df.groupBy(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).agg(F.count(F.lit(1)).alias("_w")), "pairs")
    d = pairs.join(pairs.groupBy(*by).agg(F.sum("_w").alias("_n")), by) if by else pairs.join(F.broadcast(pairs.agg(F.sum("_w").alias("_n"))))  # one row
    for c in ("_x", "_y"):
        placed = value_ranks(pairs, c, "_w", by).select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], F.col(c).alias("_v"), F.col("rank").alias(f"_r{c}"))
        met = F.col(c) == F.col("_v")
        for i, b in enumerate(by):
            met &= F.col(b) == F.col(f"_g{i}")
        d = d.join(placed, met).drop("_v", *[f"_g{i}" for i in range(len(by))])
    a, b, w = F.col("_r_x") - (F.col("_n") + 1) / 2, F.col("_r_y") - (F.col("_n") + 1) / 2, F.col("_w")
    return d.groupBy(*by).agg(F.sum(w).alias("n"), ratio(F.sum(w * a * b), F.sqrt(F.sum(w * a * a) * F.sum(w * b * b))).alias("rho"))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), p_value: bool = True) -> DataFrame:
    """Per group: n, Pearson's r of the average ranks, p-value."""
    d = rank_correlation(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y, by)
    return d.withColumn("p_value", _p_value(F.col("rho"), F.col("n"))) if p_value else d


def agreement(df: DataFrame, a: str, b: str, by: Sequence[str] = (), confidence: float = 0.95) -> DataFrame:
    """Per group: n, Lin's concordance, Bland-Altman bias and limits."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    gap, z = F.col(a) - F.col(b), F.lit(quantile(confidence))
    d = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), concordance(a, b).alias("ccc"), F.avg(gap).alias("bias"), F.stddev_samp(gap).alias("sd"))
    return d.withColumns({"lower": F.col("bias") - z * F.col("sd"), "upper": F.col("bias") + z * F.col("sd")})


def bland_altman_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adds mean and difference of every pair."""
    return df.withColumns({"pair_mean": (F.col(a) + F.col(b)) / 2, "pair_diff": F.col(a) - F.col(b)})


def adjust(df: DataFrame, p: str, tiebreak: Sequence[str], method: str = "holm", by: Sequence[str] = (), out: str = "p_adjusted") -> DataFrame:
    """Adds adjusted p-values; NULL ones stay NULL and aren't part of the family.

    Up to BROADCAST_VALUES rows a family is one window partition; more are cut into ranges of p-values (equal ones share a range).
    """
    if method not in CORRECTIONS:
        raise ValueError(f"method must be one of {', '.join(CORRECTIONS)}, got {method!r}")
    df = written(df, "family")
    columns, by = [c for c in df.columns if c != out], [*by, "_known"]
    d = df.withColumn("_known", F.coalesce(F.col(p).isNotNull() & ~F.isnan(p), F.lit(False)))
    order, m = [F.col(p), *tiebreak], F.count(F.lit(1))
    few = df.limit(ranks.BROADCAST_VALUES + 1).count() <= ranks.BROADCAST_VALUES
    if few:
        d = d.withColumn("_i", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).withColumn("_m", m.over(Window.partitionBy(*by)))
    else:
        own = ranks.numeric_range(d.where("_known"), p)
        d = written(ranks.numbered(d, order, by, own, "_i").withColumn("_i", F.col("_i") + 1), "numbered")
        sizes = d.groupBy(*by).agg(m.alias("_m")).withColumnsRenamed({b: f"_size{i}" for i, b in enumerate(by)})
        d = d.join(sizes, same(by, [f"_size{i}" for i in range(len(by))])).drop(*[f"_size{i}" for i in range(len(by))])
    # The smaller of the steps from a row on are found from the largest p-value down, so that every row is looked at once.
    step, best, choose, sign = (F.col("_m") - F.col("_i") + 1, F.max, F.greatest, 1) if method == "holm" else (F.col("_m") / F.col("_i"), F.min, F.least, -1)
    d = d.withColumn("_step", F.col(p) * step).withColumn("_order", sign * F.col("_i"))
    if few:
        d = d.withColumn("_stepped", best("_step").over(Window.partitionBy(*by).orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    else:
        d = ranks.running(d, "_step", best, choose, ["_order"], by, F.lit(sign) * own, "_stepped")
    return d.select(*columns, F.when(F.col("_known"), F.least("_stepped", F.lit(1.0))).alias(out))


def feature_correlations(df: DataFrame, features: Sequence[str], target: str, confidence: float = 0.95, method: str = "holm", p_values: bool = True) -> DataFrame:
    """One row per feature: Pearson and Spearman with the target, each family of p-values adjusted by itself; constants last."""
    long = lambda which: df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("ordinal"), F.lit(features[k]).alias("feature"), F.col(features[k]).cast("double").alias("x")) for k in which])).alias("f"), F.col(target).cast("double").alias("y")).select("f.*", "y")
    d = pearson_ci(long(range(len(features))), "x", "y", ["ordinal", "feature"], confidence, p_values)
    few = _few_values(df, features, [])
    shared, many = [k for k, yes in enumerate(few) if yes], [k for k, yes in enumerate(few) if not yes]
    rho = None
    if shared:  # the target is put in order once for all of these
        rho = _by_values(df, [features[k] for k in shared], target)
        rho = rho.select(F.element_at(F.array(*map(F.lit, shared)), F.col("k") + 1).alias("ordinal"), "n", "rho")
    if many:
        more = spearman(long(many), "x", "y", ["ordinal", "feature"], False).select("ordinal", "n", "rho")
        rho = more if rho is None else rho.unionByName(more)
    if p_values:
        rho = rho.withColumn("rho_p_value", _p_value(F.col("rho"), F.col("n")))
    d = d.join(rho.drop("n"), "ordinal")
    if p_values:
        d = adjust(adjust(d, "p_value", ["ordinal"], method), "rho_p_value", ["ordinal"], method, out="rho_p_adjusted")
    return d.orderBy(F.abs("r").desc_nulls_last(), "ordinal")


__all__ = ["adjust", "agreement", "bland_altman_pairs", "check_pairs", "feature_correlations", "pearson_ci", "quantile", "rank_correlation", "ratio", "spearman"]
