"""Numbers, running sums and ranks over tables of any size: rows are cut into ranges, and what lies before a range is added.

A range is one window partition, so no task sees a whole table or a whole group. Cuts of numbers come from approximate
quantiles, those of shuffle keys (hexadecimal texts) from their first digits; both only set the work's size, never a result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.shared import written

#: Ranges that a column is cut into, and distinct values up to which figures of them are broadcast.
RANGES, BROADCAST_VALUES = 256, 100_000


def numeric_range(df: DataFrame, x: str, ranges: int = RANGES) -> Column:
    """Number of the range that a value of ``x`` falls into, from 0."""
    cuts = sorted(set(df.where(F.col(x).isNotNull()).approxQuantile(x, [k / ranges for k in range(1, ranges)], 1 / (2 * ranges))))
    if not cuts:
        return F.lit(0)
    n, values = len(cuts), F.array(*[F.lit(float(c)) for c in cuts])
    steps = F.array(*[F.lit(1 << k) for k in range(n.bit_length() - 1, -1, -1)])
    less = lambda k: (k <= n) & (F.element_at(values, F.least(k, F.lit(n))) < F.col(x))
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(less(at + step), at + step).otherwise(at))  # bisection: how many cuts are less


def hex_range(key: Column) -> Column:
    """Range of a hexadecimal text by its first two digits."""
    return F.conv(F.substring(key, 1, 2), 16, 10).cast("int")


def before(df: DataFrame, value: str, order: Sequence[str | Column], by: Sequence[str], part: Column, out: str = "_before") -> DataFrame:
    """Adds the sum of ``value`` over the rows that stand earlier in ``order`` within ``by``; ``part`` grows with the first of ``order``."""
    d = df.withColumn("_part", part)
    sums = d.groupBy(*by, "_part").agg(F.sum(value).alias("_sum"))
    run = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    starts = sums.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_part").alias("_at"), F.coalesce(F.sum("_sum").over(run), F.lit(0)).alias("_start"))
    same = F.col("_part") == F.col("_at")
    for i, b in enumerate(by):
        same &= F.col(b).eqNullSafe(F.col(f"_by{i}"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(starts, same)
    return d.withColumn(out, F.col("_start") + F.col("_inside")).drop("_part", "_at", "_start", "_inside", *[f"_by{i}" for i in range(len(by))])


def numbered(df: DataFrame, order: Sequence[str | Column], by: Sequence[str], part: Column, out: str = "_number") -> DataFrame:
    """Adds the number of every row in ``order`` within ``by``, from 0."""
    return before(df.withColumn("_one", F.lit(1)), "_one", order, by, part, out).drop("_one")


def running(df: DataFrame, value: str, best, choose, order: Sequence[str | Column], by: Sequence[str], part: Column, out: str) -> DataFrame:
    """Adds the ``best`` (F.min or F.max, and ``choose`` F.least or F.greatest) of ``value`` over the rows up to each one in ``order`` within ``by``; ``part`` grows with the first of ``order``."""
    d = df.withColumn("_part", part)
    run = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ends = d.groupBy(*by, "_part").agg(best(value).alias("_best"))
    ends = ends.select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], F.col("_part").alias("_at"), best("_best").over(run).alias("_past"))
    met = F.col("_part") == F.col("_at")
    for i, b in enumerate(by):
        met &= F.col(b).eqNullSafe(F.col(f"_by{i}"))
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_inside", best(value).over(inside)).join(ends, met)
    return d.withColumn(out, choose("_inside", "_past")).drop("_part", "_at", "_past", "_inside", *[f"_by{i}" for i in range(len(by))])


def value_ranks(df: DataFrame, x: str, weight: str | None = None, by: Sequence[str] = (), ranges: int = RANGES) -> DataFrame:
    """One row per different value of ``x`` within ``by``: n, and its average rank (from 1) among all rows.

    Up to BROADCAST_VALUES values are ranked in a window per group, and marked for a broadcast; more are cut into ranges.
    """
    n = F.sum(weight) if weight else F.count(F.lit(1))
    values = written(df.groupBy(*by, x).agg(n.cast("bigint").alias("n")), "values")
    few = values.limit(BROADCAST_VALUES + 1).count() <= BROADCAST_VALUES
    if few:
        less = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(x).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = values.withColumn("_less", less)
    else:
        placed = before(values, "n", [x], by, numeric_range(values, x, ranges), "_less")
    out = placed.select(*by, x, "n", (F.col("_less") + (F.col("n") + 1) / 2).alias("rank"))
    return F.broadcast(out) if few else out
