"""Column expressions of tails and quantiles against the scalar versions and known values."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.operators import diagnostics


def column(spark, f, rows):
    d = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], "i int, " + ", ".join(f"a{k} double" for k in range(len(rows[0]))))
    return [r.v for r in d.select("i", f(*[F.col(f"a{k}") for k in range(len(rows[0]))]).alias("v")).orderBy("i").collect()]


def test_t_and_f_tails(spark):
    rows = [(t, df) for t in (0.0, 0.3, -1.0, 2.228, 7.0, 40.0) for df in (1, 2, 3.5, 10, 300, 59_996, 5e8)]
    assert column(spark, special.t_two_sided, rows) == pytest.approx([float(2 * special.t_sf(abs(t), df)) if df < 1e6 else math.erfc(abs(t) / math.sqrt(2)) for t, df in rows], rel=1e-7, abs=1e-12)
    rows = [(f, a, b) for f in (0.0, 0.2, 1.0, 4.0, 30.0) for a in (1, 3, 12) for b in (1, 20, 6000)]
    assert column(spark, special.f_tail, rows) == pytest.approx([float(special.f_sf(*r)) for r in rows], rel=1e-8, abs=1e-13)


def test_chi_squared_and_normal(spark):
    rows = [(x, k) for x in (0.0, 0.01, 1.0, 5.0, 60.0) for k in (1, 2, 7, 200)]
    assert column(spark, special.chi2_tail, rows) == pytest.approx([float(special.chi2_sf(*r)) for r in rows], rel=1e-9, abs=1e-14)
    xs = [(x,) for x in (-8.0, -1.5, 0.0, 0.2, 1.96, 6.0, 12.0)]
    assert column(spark, special.normal_tail, xs) == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for (x,) in xs], rel=1e-9)
    ps = [(p,) for p in (1e-300, 1e-20, 1e-9, 0.01, 0.0749, 0.075, 0.3, 0.5, 0.9, 0.925, 0.999999, 1 - 1e-15)]
    assert column(spark, special.normal_quantile, ps) == pytest.approx([NormalDist().inv_cdf(p) for (p,) in ps], rel=1e-13, abs=1e-15)


def test_undefined_values_are_null(spark):
    nan, inf = math.nan, math.inf
    assert column(spark, special.t_two_sided, [(nan, 3), (1, 0), (1, nan), (inf, 3), (-inf, 3)]) == [None, None, None, 0.0, 0.0]
    assert column(spark, special.f_tail, [(nan, 1, 1), (1, 0, 1), (inf, 1, 1), (-1, 1, 1)])[:3] == [None, None, 0.0]
    assert column(spark, special.normal_quantile, [(0,), (1,), (nan,), (0.5,)]) == [None, None, None, 0.0]
    assert column(spark, special.chi2_tail, [(nan, 1), (1, -1), (-1, 2)]) == [None, None, 1.0]
    plan = spark.range(3).select(special.t_two_sided(F.col("id"), F.col("id")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("n", [3, 4, 5, 6, 11, 12, 40])
def test_shapiro_wilk_in_columns(spark, n):
    v = np.random.default_rng(n).normal(size=n) ** 3
    d = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double")
    r = diagnostics.shapiro_wilk_table(d, "v", [], ["i"]).first()
    assert (r.w, r.p_value) == pytest.approx(diagnostics.shapiro_wilk(v), rel=1e-9)
