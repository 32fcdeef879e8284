"""Tails and quantiles of the normal, t, F and chi-squared distributions, vectorised in numpy, and as column expressions.

The regularised incomplete beta and gamma functions are evaluated by continued fractions (modified Lentz) and series.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def beta_inc(a, b, x) -> np.ndarray:
    """Regularised incomplete beta function I_x(a, b)."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        c, d = np.ones_like(z), 1 / _safe(1 - (p + q) * z / (p + 1))
        h = d.copy()
        for m in range(1, 400):
            for k in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 / _safe(1 + k * d)
                c = _safe(1 + k / c)
                h = h * c * d
            if np.nanmax(np.abs(c * d - 1), initial=0) < 1e-15:
                break
        out = np.where(z <= 0, 0.0, front * h)
    out = np.where(swap, 1 - out, out)
    return np.where(x <= 0, 0.0, np.where(x >= 1, 1.0, out))


def _safe(x: np.ndarray) -> np.ndarray:
    return np.where(np.abs(x) < _TINY, _TINY, x)


def gamma_sf(a, x) -> np.ndarray:
    """Upper regularised incomplete gamma function Q(a, x)."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.empty(x.shape)
    for at in np.ndindex(x.shape):
        out[at] = _gamma_sf(float(a[at]), float(x[at]))
    return out


def _gamma_sf(a: float, x: float) -> float:
    if math.isnan(a) or math.isnan(x):
        return math.nan
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return 1 - front * total
    b = x + 1 - a
    c, d = 1 / _TINY, 1 / b
    h = d
    for i in range(1, 1000):
        k = -i * (i - a)
        b += 2
        d = 1 / (k * d + b or _TINY)
        c = b + k / c or _TINY
        h *= c * d
        if abs(c * d - 1) < 1e-16:
            break
    return front * h


def t_sf(t, df) -> np.ndarray:
    """P(T > t) of Student's t; NaN where df <= 0."""
    t, df = np.broadcast_arrays(np.asarray(t, float), np.asarray(df, float))
    ok = df > 0
    d = np.where(ok, df, 1.0)
    with np.errstate(all="ignore"):
        half = 0.5 * beta_inc(d / 2, 0.5, np.where(np.isinf(t), 0.0, d / (d + t * t)))
    return np.where(ok & ~np.isnan(t), np.where(t >= 0, half, 1 - half), np.nan)


def t_ppf(p: float, df: float) -> float:
    """Quantile of Student's t by bisection."""
    if not 0 < p < 1 or not df > 0:
        return math.nan
    low, high = -1.0, 1.0
    while 1 - float(t_sf(low, df)) > p:
        low *= 2
    while 1 - float(t_sf(high, df)) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if 1 - float(t_sf(mid, df)) < p else (low, mid)
    return (low + high) / 2


def f_sf(f, df1, df2) -> np.ndarray:
    """P(F > f); NaN where a degree of freedom isn't positive."""
    f, d1, d2 = np.broadcast_arrays(*(np.asarray(v, float) for v in (f, df1, df2)))
    ok = (d1 > 0) & (d2 > 0) & ~np.isnan(f)
    a, b = np.where(ok, d1, 1.0), np.where(ok, d2, 1.0)
    x = np.where(np.isinf(f), 0.0, b / (b + a * np.where(np.isinf(f) | np.isnan(f), 1.0, np.maximum(f, 0))))
    return np.where(ok, beta_inc(b / 2, a / 2, x), np.nan)


def chi2_sf(x, df) -> np.ndarray:
    return gamma_sf(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def normal_ppf(p) -> np.ndarray:
    inverse = NormalDist().inv_cdf
    return np.array([inverse(v) if 0 < v < 1 else math.nan for v in np.ravel(np.asarray(p, float))]).reshape(np.shape(p))


def normal_sf(x) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc, otypes=[float])(np.asarray(x, float) / math.sqrt(2))


# Column functions: expressions of fixed length without a Python worker. NULL, NaN and degrees of freedom that aren't positive give NULL.

#: Steps of a continued fraction or series; enough where the smaller parameter is up to some tens of thousands.
STEPS = 600
_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def _correction(y: Column) -> Column:
    """Stirling's series for y of 8 and more."""
    z = 1 / (y * y)
    return (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y


def _log_rise(x: Column, s: Column) -> Column:
    """ln(Gamma(x + s) / Gamma(x)), without the loss of digits of a difference of large numbers."""
    y = x + 8
    small = sum((F.log1p(s / (x + i)) for i in range(1, 8)), F.log1p(s / x))
    return s * F.ln(y + s) + (y - 0.5) * F.log1p(s / y) - s + _correction(y + s) - _correction(y) - small


def log_gamma(x: Column) -> Column:
    """ln Gamma of a positive number."""
    y = x + 8
    small = sum((F.ln(x + i) for i in range(1, 8)), F.ln(x))
    return (y - 0.5) * F.ln(y) - y + _HALF_LOG_2PI + _correction(y) - small


def _named(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.aggregate(F.array(F.lit(0)), value, lambda v, _: v, then)


def _kept_off_zero(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _fraction(coefficient, start_c: Column, start_d: Column) -> Column:
    """A continued fraction by Lentz's recurrence: the product of its steps' ratios."""
    start = F.struct(start_c.alias("c"), start_d.alias("d"), start_d.alias("h"))

    def step(s: Column, j: Column) -> Column:
        k = coefficient(j.cast("double"))
        c, d = _kept_off_zero(1 + k / s["c"]), 1 / _kept_off_zero(1 + k * s["d"])
        return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])


def beta_tail(a: Column, b: Column, x: Column, rest: Column) -> Column:
    """I_x(a, b) where ``rest`` is 1 - x with all its digits."""
    swap = x > (a + 1) / (a + b + 2)
    known = F.struct(F.when(swap, b).otherwise(a).alias("p"), F.when(swap, a).otherwise(b).alias("q"), F.when(swap, rest).otherwise(x).alias("z"), F.when(swap, x).otherwise(rest).alias("w"), swap.alias("swap"))

    def value(v: Column) -> Column:
        p, q, z, w = (v[n] for n in "pqzw")

        def coefficient(j: Column) -> Column:
            m = F.floor((j + 1) / 2)
            even = m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))
            return F.when(j % 2 == 1, even).otherwise(odd)

        low, high = F.least(p, q), F.greatest(p, q)
        log_of = lambda u, other: F.when(u < 0.5, F.ln(u)).otherwise(F.log1p(-other))
        front = F.exp(p * log_of(z, w) + q * log_of(w, z) + _log_rise(high, low) - log_gamma(low)) / p
        got = F.when(z <= 0, 0.0).otherwise(front * _fraction(coefficient, F.lit(1.0), 1 / _kept_off_zero(1 - (p + q) * z / (p + 1))))
        return F.when(v["swap"], 1 - got).otherwise(got)

    return _named(known, value)


def _number(x: Column) -> Column:
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def _positive(x: Column) -> Column:
    x = _number(x)
    return F.when(x > 0, x)


def t_two_sided(t: Column, df: Column) -> Column:
    """Two-sided p-value of a t statistic."""
    t, df = _number(t), _positive(df)
    square = t * t
    return F.when(F.abs(t) == math.inf, F.when(df.isNotNull(), 0.0)).otherwise(beta_tail(df / 2, F.lit(0.5), df / (df + square), square / (df + square)))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f)."""
    a, b, f = _positive(df1), _positive(df2), _number(f)
    f = F.when(f <= 0, 0.0).otherwise(f)
    return F.when(f == math.inf, F.when(a.isNotNull() & b.isNotNull(), 0.0)).otherwise(beta_tail(b / 2, a / 2, b / (b + a * f), a * f / (b + a * f)))


def gamma_tail(a: Column, x: Column) -> Column:
    """Q(a, x): a series below a + 1, a continued fraction beyond."""
    a, x = _positive(a), _number(x)

    def value(v: Column) -> Column:
        a, x = v["a"], v["x"]
        front = F.exp(a * F.ln(x) - x - log_gamma(a))
        series = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), F.struct((1 / a).alias("term"), (1 / a).alias("total")),
                             lambda s, j: F.struct((s["term"] * x / (a + j)).alias("term"), (s["total"] + s["term"] * x / (a + j)).alias("total")), lambda s: s["total"])
        start = F.struct(F.lit(1 / _TINY).alias("c"), (1 / (x + 1 - a)).alias("d"), (1 / (x + 1 - a)).alias("h"))

        def step(s: Column, j: Column) -> Column:
            k, b = -j * (j - a), x + 1 - a + 2 * j
            c, d = _kept_off_zero(b + k / s["c"]), 1 / _kept_off_zero(b + k * s["d"])
            return F.struct(c.alias("c"), d.alias("d"), (s["h"] * c * d).alias("h"))

        fraction = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, lambda s: s["h"])
        return F.when(x == math.inf, 0.0).when(x < a + 1, 1 - front * series).otherwise(front * fraction)

    return F.when(x <= 0, F.when(a.isNotNull(), 1.0)).otherwise(_named(F.struct(a.alias("a"), x.alias("x")), value))


def chi2_tail(x: Column, df: Column) -> Column:
    return gamma_tail(df / 2, x.cast("double") / 2)


def normal_tail(x: Column) -> Column:
    """P(Z > x)."""
    half = gamma_tail(F.lit(0.5), x * x / 2) / 2
    return F.when(_number(x) >= 0, half).otherwise(1 - half)


# The published rational approximations of the normal quantile (Wichura's AS 241), by rising power: near the middle, in the tails, far out.
_MIDDLE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
_TAIL = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 0.000774545014278341407640),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 0.000547593808499534494600, 1.05075007164441684324e-9),
)
_FAR = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 0.000786869131145613259100, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _rational(pair: tuple, r: Column) -> Column:
    def power_sum(coefficients: tuple) -> Column:
        out = F.lit(coefficients[-1])
        for c in coefficients[-2::-1]:
            out = out * r + c
        return out

    return power_sum(pair[0]) / power_sum(pair[1])


def normal_quantile(p: Column) -> Column:
    """The normal quantile by three rational functions; NULL outside of (0, 1)."""
    p = _number(p)
    p = F.when((p > 0) & (p < 1), p)
    q = p - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    outer = F.when(r <= 5, _rational(_TAIL, r - 1.6)).otherwise(_rational(_FAR, r - 5))
    return F.when(F.abs(q) <= 0.425, q * _rational(_MIDDLE, 0.180625 - q * q)).otherwise(F.signum(q) * outer)
