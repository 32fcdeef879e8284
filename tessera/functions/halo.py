"""Halo exchange: ordered rows in ranges, each with copies of the few rows that stand next to it in other ranges.

Rows in order of some keys and then of order columns are cut into ranges of about equal size at sampled rows; the cuts are
literals, so every plan puts a row in the same range, and they never change a result. Only entities that cross a border have
rows copied, and at most as many per border as the caller looks back and ahead. Lags, deltas and running differences then
need a window per range and entity, never one per entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a range, ranges at most, and sampled rows for each cut.
RANGE_ROWS, RANGES, SAMPLED = 1_000_000, 4_096, 24

RANGE, HALO = "_range", "_halo"


def _cuts(df: DataFrame, columns: Sequence[str], rows: int) -> list:
    """Rows (of ``columns``) that begin a range; none for a table of one range."""
    n = df.count()
    ranges = min(RANGES, -(-n // rows))
    if ranges < 2:
        return []
    share = min(1.0, ranges * SAMPLED / n)
    row = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    found = [r.row for r in df.sample(share, 0).select(row.alias("row")).orderBy("row").collect()]  # RANGES * SAMPLED rows or so
    cuts = [found[len(found) * k // ranges] for k in range(1, ranges)] if found else []
    return [c for i, c in enumerate(cuts) if not i or c != cuts[i - 1]]


def in_ranges(df: DataFrame, columns: Sequence[str], rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """Adds the number of each row's range (ranges ascend with ``columns``, nulls first), and the number of cuts."""
    cuts = _cuts(df, columns, rows)
    if not cuts:
        return df.withColumn(RANGE, F.lit(0)), 0
    kinds = [df.schema[c].dataType for c in columns]
    typed = lambda values: F.struct(*[F.lit(v).cast(k).alias(f"c{i}") for i, (v, k) in enumerate(zip(values, kinds, strict=True))])
    at, row = F.array(*map(typed, cuts)), F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])
    n, steps = len(cuts), F.array(*[F.lit(1 << k) for k in range(len(cuts).bit_length() - 1, -1, -1)])
    reached = lambda k: (k <= n) & (F.element_at(at, F.least(k, F.lit(n))) <= row)
    return df.withColumn(RANGE, F.aggregate(steps, F.lit(0), lambda k, step: F.when(reached(k + step), k + step).otherwise(k))), n  # bisection


def _same(keys: Sequence[str], other: Sequence[str]) -> Column:
    same = F.lit(True)
    for a, b in zip(keys, other, strict=True):
        same &= F.col(a).eqNullSafe(F.col(b))
    return same


def with_halo(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], back: int, ahead: int, rows: int = RANGE_ROWS) -> DataFrame:
    """``df`` with the range of every row, and copies (marked) of up to ``back`` earlier and ``ahead`` later rows of its entity.

    A copy has keys, order and ``columns``; everything else of it is NULL. Windows over keys and range see in their
    neighbourhood what they would see over the whole entity, wherever fewer rows than asked for are in range at its ends.
    """
    keys, order = list(keys), list(order)
    d, cuts = in_ranges(df, [*keys, *order], rows)
    d = d.withColumn(HALO, F.lit(False))
    if not cuts:
        return d
    crossing = d
    if keys:  # at most one entity crosses each border
        names = [f"_key{i}" for i in range(len(keys))]
        ends = d.groupBy(*keys).agg(F.min(RANGE).alias("_a"), F.max(RANGE).alias("_b")).where("_a < _b").select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
        crossing = d.join(F.broadcast(ends), _same(keys, names), "left_semi")
    kept = list(dict.fromkeys([*order, *columns]))
    inside = Window.partitionBy(*keys, RANGE)
    first, last = F.row_number().over(inside.orderBy(*order)), F.row_number().over(inside.orderBy(*[F.col(c).desc_nulls_last() for c in order]))
    near = crossing.select(*keys, RANGE, *[c for c in kept if c not in keys]).withColumns({"_first": first, "_last": last}).where((F.col("_first") <= ahead) | (F.col("_last") <= back))
    row = F.struct("_first", *[F.col(c).alias(f"v{i}") for i, c in enumerate(kept)])
    pick = lambda which, most: F.array_sort(F.collect_list(F.when(F.col(which) <= most, row)))
    borders = near.groupBy(*keys, RANGE).agg(pick("_first", ahead).alias("_heads"), pick("_last", back).alias("_tails"))  # so many rows a range
    over = Window.partitionBy(*keys).orderBy(RANGE)  # a row a range
    before = F.flatten(F.collect_list("_tails").over(over.rowsBetween(-back, -1))) if back else F.slice("_tails", 1, 0)
    after = F.flatten(F.collect_list("_heads").over(over.rowsBetween(1, ahead))) if ahead else F.slice("_heads", 1, 0)
    some = borders.withColumns({"_before": before, "_after": after})
    tail = F.when(F.size("_before") > back, F.slice("_before", F.size("_before") - back + 1, back)).otherwise(F.col("_before"))
    copies = some.select(*keys, RANGE, F.explode(F.concat(tail, F.slice("_after", 1, max(1, ahead)) if ahead else F.col("_after"))).alias("_row"))
    copies = copies.select(*keys, RANGE, F.lit(True).alias(HALO), *[F.col(f"_row.v{i}").alias(c) for i, c in enumerate(kept) if c not in keys])
    return d.unionByName(copies, allowMissingColumns=True)
