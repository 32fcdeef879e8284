"""Column expressions for statistics whose undefined values are NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rounded(x: Column | str, digits: int = 6) -> Column:
    """Rounded, without a negative zero."""
    return F.round(col(x), digits) + F.lit(0.0)


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL where b is 0."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def constant(x: Column | str) -> Column:
    """Whether all values are the same finite number, as an aggregate. Merged moments of such a column can be off 0 by rounding."""
    x = col(x)
    return (F.min(x) == F.max(x)) & (F.abs(F.max(x)) < float("inf"))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Pearson's r as an aggregate; NULL if a side is constant."""
    r = ratio(F.covar_pop(col(x), col(y)), F.stddev_pop(col(x)) * F.stddev_pop(col(y)))
    return F.when(~(F.coalesce(constant(x), F.lit(False)) | F.coalesce(constant(y), F.lit(False))), r)


def concordance(x: Column | str, y: Column | str) -> Column:
    """Lin's concordance as an aggregate; 1 if both sides are the same constant."""
    x, y = col(x), col(y)
    gap = F.avg(x) - F.avg(y)
    below = F.var_pop(x) + F.var_pop(y) + gap * gap
    return F.when(below == 0, F.when(F.count(F.lit(1)) > 0, F.lit(1.0))).otherwise(ratio(2 * F.covar_pop(x, y), below))


def fisher_bounds(r: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Fisher interval of a correlation; r itself if |r| is 1, NULL for three pairs or fewer."""
    half = F.lit(z) / F.sqrt(F.when(n > 3, n - 3).cast("double"))
    bound = lambda s: F.when(F.abs(r) >= 1, r).otherwise(F.tanh(F.atanh(r) + s * half))
    return bound(-1), bound(1)
