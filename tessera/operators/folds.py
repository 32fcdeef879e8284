"""Fold assignment as a column: replayable, and whole groups stay together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ranks


def shuffle_key(seed: int, *ids: str) -> Column:
    """A text that orders rows at random but always alike."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def check(df: DataFrame, k: int, group: str | None = None, label: str | None = None) -> None:
    """An error if there are too few rows, groups, or rows of a class."""
    n = F.countDistinct(group) if group else F.count(F.lit(1))
    found = df.agg(n).first()[0]
    if found < k:
        raise ValueError(f"{k} folds need {k} {'groups' if group else 'rows'}, there are {found}")
    if label and not group:
        least = df.groupBy(label).count().agg(F.min("count")).first()[0]
        if least < k:
            raise ValueError(f"the smallest class has {least} rows, fewer than {k} folds")


def hashed(k: int, seed: int, *ids: str) -> Column:
    """Fold of a row by its hash alone: no sort and no shuffle, sizes equal only on average. For tables of any size."""
    return F.pmod(F.conv(F.substring(shuffle_key(seed, *ids), 1, 8), 16, 10).cast("bigint"), F.lit(k)).cast("int")


def shuffled(df: DataFrame, k: int, ids: list[str], seed: int = 0) -> DataFrame:
    """Adds fold; sizes differ by one at most. Rows are numbered in ranges of their shuffle key."""
    check(df, k)
    d = df.withColumn("_key", shuffle_key(seed, *ids))
    d = ranks.numbered(d, ["_key", *ids], [], ranks.hex_range(F.col("_key")))
    return d.withColumn("fold", (F.col("_number") % k).cast("int")).drop("_key", "_number")


def within(df: DataFrame, k: int, by: list[str], ids: list[str], seed: int = 0, out: str = "fold") -> DataFrame:
    """Adds a fold of k: the rows of each class of ``by`` (few classes) are dealt out by themselves, starting where the class before ended."""
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))  # a row a class
    start = F.coalesce(F.sum("_n").over(Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(b).alias(f"_class{i}") for i, b in enumerate(by)], start.alias("_first"))
    same = F.lit(True)
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_class{i}"))
    d = df.withColumn("_key", shuffle_key(seed, *ids)).join(F.broadcast(starts), same)
    d = ranks.numbered(d, ["_key", *ids], by, ranks.hex_range(F.col("_key")))
    return d.withColumn(out, ((F.col("_first") + F.col("_number")) % k).cast("int")).drop("_first", "_key", "_number", *[f"_class{i}" for i in range(len(by))])


def stratified(df: DataFrame, k: int, label: str, ids: list[str], seed: int = 0) -> DataFrame:
    """Adds fold; each class is dealt out by itself, starting where the class before it ended."""
    check(df, k, label=label)
    return within(df, k, [label], ids, seed)


def inner(df: DataFrame, k: int, ids: list[str], seed: int = 0, fold: str = "fold", group: str | None = None, label: str | None = None, out: str = "inner") -> DataFrame:
    """Adds a second fold of k within each fold, so that the training rows of every fold hold all inner folds in equal shares.

    Whole groups stay together; classes of ``label`` are balanced where there are no groups.
    """
    if not group:
        return within(df, k, [fold, *([label] if label else [])], ids, seed, out)
    groups = within(df.groupBy(group).agg(F.min(fold).alias(fold)), k, [fold], [group], seed, out)
    return df.join(groups.select(F.col(group).alias("_group"), out), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def dealt(loads: list[int], size: int, n: int) -> list[tuple[int, list[int]]]:
    """Folds of n groups of one size, each to the least loaded (the first of equals): runs of (first group, folds in turn). Adds to ``loads``.

    The least loaded folds, those within one group of the least, take turns until they reach the next one's load.
    """
    runs, i = [], 0
    while i < n:
        order = sorted(range(len(loads)), key=lambda f: (loads[f], f))
        turn = [f for f in order if loads[f] < loads[order[0]] + size]
        rounds = -(-n // len(turn)) if len(turn) == len(order) else (loads[order[len(turn)]] - loads[turn[-1]] - 1) // size + 1
        runs.append((i, turn))
        given = min(n - i, rounds * len(turn))
        for place, f in enumerate(turn):
            loads[f] += size * (given // len(turn) + (place < given % len(turn)))
        i += given
    return runs


def grouped(df: DataFrame, k: int, group: str, seed: int = 0) -> DataFrame:
    """One row per group with its fold: largest groups first, each to the fold with the fewest rows so far (the first of equals).

    Only the numbers of groups of every size come to the driver (for a billion rows some 45,000 sizes at most); a group's fold
    follows from its size and its number among the groups of that size.
    """
    check(df, k, group)
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).withColumn("_key", shuffle_key(seed, group))
    loads, rows = [0] * k, []
    for r in groups.groupBy("n").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("n")).collect():
        rows.append((r.n, [(start, turn) for start, turn in dealt(loads, r.n, r.c)]))
    runs = df.sparkSession.createDataFrame(rows, "_size bigint, _runs array<struct<start:bigint,turn:array<int>>>")
    d = ranks.numbered(groups, ["_key", group], ["n"], ranks.hex_range(F.col("_key"))).join(F.broadcast(runs), F.col("n") == F.col("_size"))
    run = F.element_at(F.filter("_runs", lambda r: r["start"] <= F.col("_number")), -1)
    fold = F.element_at(run["turn"], ((F.col("_number") - run["start"]) % F.size(run["turn"]) + 1).cast("int"))
    return d.select(group, "n", fold.alias("fold"))


def repeat_seeds(seed: int, repeats: int) -> list[int]:
    """Independent seeds of repeats, from one seed."""
    import numpy as np

    return [int(s.generate_state(1)[0]) & 0x7FFFFFFF for s in np.random.SeedSequence(seed).spawn(repeats)]


def has_groups(df: DataFrame, group: str) -> bool:
    """Whether any row has a group that isn't null or blank."""
    return bool(df.agg(F.max(F.trim(F.coalesce(F.col(group).cast("string"), F.lit(""))) != "")).first()[0])


def repeated(df: DataFrame, k: int, repeats: int, ids: list[str], seed: int = 0, group: str | None = None, label: str | None = None) -> DataFrame:
    """Adds fold_r0, fold_r1, ...: shuffled, stratified by ``label``, or with whole groups; every setting shares them."""
    for r, s in enumerate(repeat_seeds(seed, repeats)):
        if group:
            fold = grouped(df, k, group, s).select(F.col(group).alias("_group"), F.col("fold").alias(f"fold_r{r}"))
            df = df.join(fold, F.col(group) == F.col("_group")).drop("_group")
        else:
            made = stratified(df, k, label, ids, s) if label else shuffled(df, k, ids, s)
            df = made.withColumnRenamed("fold", f"fold_r{r}")
    return df


#: Different class counts that come to the driver at most, and groups of equal counts that are placed one by one.
VECTORS, SINGLE = 20_000, 64


def greedy(vectors: list[tuple[tuple[float, ...], int]], k: int) -> list[list[int]]:
    """Folds of groups given by class counts and how many groups have them, in order: per vector the folds of its first groups.

    A group goes where the classes' shares then differ least between folds (to nine digits), then where the fewest rows are, then
    to the first fold. Of many equal groups the first ones are placed like that; the rest are a multiple of k and take turns.
    """
    import numpy as np

    share = sum(np.array(v) * n for v, n in vectors)
    share = np.where(share > 0, share, 1)
    loads, out = np.zeros((k, len(share))), []
    for vector, n in vectors:
        v, placed = np.array(vector), []
        for _ in range(n if n <= SINGLE * k else SINGLE * k + (n - SINGLE * k) % k):
            trial = loads[None] + np.eye(k)[:, :, None] * v
            costs = np.round((trial / share).std(1).mean(1), 9)
            f = min(range(k), key=lambda f: (costs[f], loads[f].sum(), f))  # noqa: B023
            loads[f] += v
            placed.append(f)
        loads += v * ((n - len(placed)) // k)
        out.append(placed)
    return out


def stratified_groups(df: DataFrame, k: int, group: str, label: str, seed: int = 0) -> DataFrame:
    """One row per group with its fold: whole groups, class counts balanced, groups of the most uneven counts first.

    Groups are reduced to vectors of class counts. Only the different vectors and their numbers come to the driver; where they
    are too many, counts are rounded to ever fewer binary digits, which changes the balance a little and nothing else. A
    group's fold follows from its vector and its number among the groups of that vector.
    """
    check(df, k, group)
    classes = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]  # few
    counts = F.array(*[F.count_if(F.col(label).eqNullSafe(F.lit(c))).cast("double") for c in classes])
    groups = df.groupBy(group).agg(counts.alias("_exact")).withColumn("_key", shuffle_key(seed, group))
    digits = 0
    while True:
        size = lambda v: F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(v, F.lit(1.0)))) - digits + 1)  # noqa: E731, B023
        vector = F.transform("_exact", lambda v: F.round(v / size(v)) * size(v)) if digits else F.col("_exact")
        rounded = groups.withColumn("_vector", vector)
        vectors = rounded.groupBy("_vector").agg(F.count(F.lit(1)).alias("n"))
        if digits == 1 or vectors.limit(VECTORS + 1).count() <= VECTORS:
            break
        digits = digits - 1 if digits else 8
    import numpy as np

    rows = sorted(((tuple(r["_vector"]), r["n"]) for r in vectors.collect()), key=lambda r: (-round(float(np.std(r[0])), 9), tuple(-v for v in r[0])))
    table = df.sparkSession.createDataFrame([(list(v), folds) for (v, _), folds in zip(rows, greedy(rows, k), strict=True)], "_v array<double>, _folds array<int>")
    d = ranks.numbered(rounded, ["_key", group], ["_vector"], ranks.hex_range(F.col("_key"))).join(F.broadcast(table), F.col("_vector") == F.col("_v"))
    number = F.col("_number").cast("int")
    return d.select(group, F.coalesce(F.get("_folds", number), (F.col("_number") % k).cast("int")).alias("fold"))
