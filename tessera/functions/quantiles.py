"""Exact percentiles of groups of any size, by refining histograms.

Small groups are left to Spark's own percentile, which holds a group's different values. For a large group the wanted ranks
are looked for: its values are counted in cells of about equal depth, the cell that holds a rank becomes the set to look in,
and so on until that set has one value, or is small enough to be sorted. A pass divides the rows to look at by the number of
cells (ties aside, which end the search), so a few passes are enough for any number of rows; what a group holds in memory is
a sketch and a histogram of fixed size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import same, written

#: Rows of a group, or of what is left of it, that are held at once; cells of a histogram; accuracy of the cuts.
HELD, CELLS, ACCURACY = 100_000, 256, 2_000


def _cell(cuts: Column, v: Column) -> Column:
    """The cell of a value: between two ascending cuts, or at one, so that a set of two values always falls apart."""
    steps = F.array(*[F.lit(1 << k) for k in range(CELLS.bit_length() - 1, -1, -1)])
    less = lambda k: (k <= F.size(cuts)) & (F.element_at(cuts, F.least(k, F.size(cuts))) < v)
    below = F.aggregate(steps, F.lit(0), lambda at, step: F.when(less(at + step), at + step).otherwise(at))  # bisection
    return 2 * below + F.coalesce(F.get(cuts, below) == v, F.lit(False)).cast("int")


def _selected(values: DataFrame, targets: DataFrame, keys: Sequence[str], held: int) -> DataFrame:
    """Adds the value of every target: rank ``r`` (from 0) among the ``values`` (keys, v) of its keys that lie in [a, b], m of them."""
    renamed = [f"_t{i}" for i in range(len(keys))]
    of_target = lambda d: d.withColumnsRenamed(dict(zip(keys, renamed, strict=True)))
    done, open_ = targets.where("a = b").withColumn("value", F.col("a")), targets.where("a < b")
    found = [done]
    while not (large := open_.where(F.col("m") > held)).isEmpty():
        found.append(written(open_.where(F.col("m") <= held).withColumn("value", F.lit(None).cast("double")), "targets"))
        sets = of_target(large.select(*keys, "a", "b").distinct())
        inside = values.join(sets, same(keys, renamed)).where(F.col("v").between(F.col("a"), F.col("b"))).select(*keys, "a", "b", "v")
        cuts = inside.groupBy(*keys, "a", "b").agg(F.array_distinct(F.percentile_approx("v", F.array(*[F.lit(k / CELLS) for k in range(1, CELLS)]), F.lit(ACCURACY))).alias("_cuts"))
        cuts = written(cuts, "cuts")
        more = of_target(cuts.withColumnsRenamed({"a": "_a", "b": "_b"}))
        placed = inside.join(more, same(keys, renamed) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")))
        cells = placed.groupBy(*keys, "a", "b", _cell(F.col("_cuts"), F.col("v")).alias("cell")).agg(F.count(F.lit(1)).alias("_n"), F.min("v").alias("_low"), F.max("v").alias("_high"))
        before = Window.partitionBy(*keys, "a", "b").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # CELLS rows at most
        cells = of_target(cells.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumnsRenamed({"a": "_a", "b": "_b"}))
        met = same(keys, renamed) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("r") >= F.col("_before")) & (F.col("r") < F.col("_before") + F.col("_n"))
        now = large.join(cells, met).select(*keys, "id", (F.col("r") - F.col("_before")).alias("r"), F.col("_n").alias("m"), F.col("_low").alias("a"), F.col("_high").alias("b"))
        now = written(now, "targets")
        found.append(now.where("a = b").withColumn("value", F.col("a")))
        open_ = now.where("a < b")
    found.append(open_.withColumn("value", F.lit(None).cast("double")))
    every = found[0]
    for d in found[1:]:
        every = every.unionByName(d)
    every = written(every, "targets")
    left = every.where("value IS NULL")
    sets = of_target(left.select(*keys, "a", "b").distinct())
    lists = values.join(sets, same(keys, renamed)).where(F.col("v").between(F.col("a"), F.col("b"))).groupBy(*keys, "a", "b").agg(F.sort_array(F.collect_list("v")).alias("_values"))  # HELD at most
    lists = of_target(lists.withColumnsRenamed({"a": "_a", "b": "_b"}))
    rest = left.drop("value").join(lists, same(keys, renamed) & (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b"))).select(*keys, "id", F.get("_values", F.col("r").cast("int")).alias("value"))
    return every.where("value IS NOT NULL").select(*keys, "id", "value").unionByName(rest)


def percentiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], percents: Sequence[float], name, held: int = HELD) -> DataFrame:
    """A row per group with ``name(column, percent)`` for each: linear between the nearest ranks, nulls aside; NULL without values."""
    keys, columns = list(keys), list(columns)
    plain = [F.percentile(F.col(c), F.lit(q / 100)).alias(name(c, q)) for q in percents for c in columns]
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > held)
    if large.isEmpty():
        return df.groupBy(*keys).agg(*plain)
    renamed = [f"_l{i}" for i in range(len(keys))]
    large = written(large.select(*[F.col(k).alias(n) for k, n in zip(keys, renamed, strict=True)], "_n"), "large")
    small = df.join(large, same(keys, renamed), "left_anti").groupBy(*keys).agg(*plain)
    own = df.join(large, same(keys, renamed), "left_semi")
    column = F.explode(F.array(*[F.struct(F.lit(i).alias("_column"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)]))
    values = written(own.select(*keys, column.alias("_c")).select(*keys, "_c.*").where("v IS NOT NULL"), "values")
    by = [*keys, "_column"]
    sizes = values.groupBy(*by).agg(F.count(F.lit(1)).alias("m"), F.min("v").alias("a"), F.max("v").alias("b"))
    position = lambda q: F.lit(q / 100) * (F.col("m") - 1)
    wanted = [F.struct(F.lit(2 * i + k).alias("id"), (F.ceil(position(q)) if k else F.floor(position(q))).cast("bigint").alias("r")) for i, q in enumerate(percents) for k in (0, 1)]
    targets = written(sizes.select(*by, "m", "a", "b", F.explode(F.array(*wanted)).alias("_w")).select(*by, "_w.id", "_w.r", "m", "a", "b"), "targets")
    found = _selected(values, targets, by, held)
    where = lambda i, c, k: F.max(F.when((F.col("id") == 2 * i + k) & (F.col("_column") == c), F.col("value")))
    counts = lambda c: F.max(F.when(F.col("_column") == c, F.col("m")))
    names = [f"_s{i}" for i in range(len(by))]
    sized = found.join(sizes.select(*[F.col(b).alias(n) for b, n in zip(by, names, strict=True)], "m"), same(by, names)).drop(*names)
    made = []
    for i, q in enumerate(percents):
        for c, column_name in enumerate(columns):
            p = F.lit(q / 100) * (counts(c) - 1)
            low, high = where(i, c, 0), where(i, c, 1)
            made.append(F.when(F.ceil(p) == F.floor(p), low).otherwise((F.ceil(p) - p) * low + (p - F.floor(p)) * high).alias(name(column_name, q)))
    part = sized.groupBy(*keys).agg(*made)
    every = large.select(*[F.col(n).alias(k) for k, n in zip(keys, renamed, strict=True)])  # a group without values stays
    part = every.join(part.withColumnsRenamed(dict(zip(keys, names, strict=False))), same(keys, names[: len(keys)]), "left").drop(*names[: len(keys)])
    return small.unionByName(part)
