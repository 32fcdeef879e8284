"""The engine's registered queries over the given tables, and DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import special
from tessera.functions.shared import written
from tessera.functions.stats import pearson, ratio, rounded
from tessera.operators import ablation, association, diagnostics, folds, frames, kernels, linear, metrics, models, nested, pooling
from tessera.sources import audio, tables
from tessera.streaming import windows

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: rounded(c, digits) for c in columns})


#: SQL of distribution tails, by the recurrences of ``functions.special``.
_COEFFICIENT = """CASE WHEN e.j % 2 = 1 THEN ((e.j + 1) // 2) * (q_ - (e.j + 1) // 2) * z_ / ((p_ + 2 * ((e.j + 1) // 2) - 1) * (p_ + 2 * ((e.j + 1) // 2)))
  ELSE -(p_ + (e.j + 1) // 2) * (p_ + q_ + (e.j + 1) // 2) * z_ / ((p_ + 2 * ((e.j + 1) // 2)) * (p_ + 2 * ((e.j + 1) // 2) + 1)) END"""


def _t_tail(source: str, t: str, df: str, out: str) -> str:
    """A relation with the two-sided p-value of a column of t statistics."""
    fraction = f"""list_reduce(list_transform(range(1, 401), lambda j: {{'j': j, 'c': 1.0::double, 'd': 0.0::double, 'h': 0.0::double}}), lambda s, e: {{'j': e.j, 'c': 1 + ({_COEFFICIENT}) / s.c, 'd': 1 / (1 + ({_COEFFICIENT}) * s.d),
      'h': s.h * (1 + ({_COEFFICIENT}) / s.c) / (1 + ({_COEFFICIENT}) * s.d)}}, {{'j': 0::bigint, 'c': 1.0::double, 'd': 1 / (1 - (p_ + q_) * z_ / (p_ + 1)), 'h': 1 / (1 - (p_ + q_) * z_ / (p_ + 1))}}).h"""
    return f"""(SELECT * EXCLUDE (v_, x_, y_, s_, p_, q_, z_, w_, g_), CASE WHEN s_ THEN 1 - g_ ELSE g_ END AS {out} FROM (SELECT *, CASE WHEN z_ <= 0 THEN 0 ELSE exp(p_ * ln(z_) + q_ * ln(w_) + lgamma(p_ + q_) - lgamma(p_) - lgamma(q_)) / p_ * {fraction} END AS g_
      FROM (SELECT *, CASE WHEN s_ THEN 0.5::double ELSE v_ / 2 END AS p_, CASE WHEN s_ THEN v_ / 2 ELSE 0.5::double END AS q_, CASE WHEN s_ THEN y_ ELSE x_ END AS z_, CASE WHEN s_ THEN x_ ELSE y_ END AS w_
        FROM (SELECT *, x_ > (v_ / 2 + 1) / (v_ / 2 + 2.5) AS s_ FROM (SELECT *, ({df})::double AS v_, ({df}) / (({df}) + ({t}) * ({t})) AS x_, ({t}) * ({t}) / (({df}) + ({t}) * ({t})) AS y_ FROM {source})))))"""


def _horner(coefficients, r: str) -> str:
    out = f"{coefficients[-1]!r}::double"
    for c in coefficients[-2::-1]:
        out = f"({out} * {r} + {c!r}::double)"
    return out


def _normal_quantile(p: str) -> str:
    part = lambda pair, r: f"({_horner(pair[0], r)} / {_horner(pair[1], r)})"
    r = f"sqrt(-ln(least({p}, 1 - {p})))"
    return f"""CASE WHEN abs({p} - 0.5) <= 0.425 THEN ({p} - 0.5) * {part(special._MIDDLE, f'(0.180625::double - power({p} - 0.5, 2))')} WHEN {r} <= 5 THEN sign({p} - 0.5) * {part(special._TAIL, f'({r} - 1.6)')} ELSE sign({p} - 0.5) * {part(special._FAR, f'({r} - 5)')} END"""


def _normal_tail(x: str) -> str:
    """P(Z > x) by the series of the distribution function, to about 1e-16 of absolute size."""
    z = f"greatest(-9.0, least(9.0, {x}))"
    series = f"list_reduce(list_transform(range(1, 251), lambda j: {{'j': j, 't': 0.0::double, 's': 0.0::double}}), lambda a, e: {{'j': e.j, 't': a.t * power({z}, 2) / (2 * e.j + 1), 's': a.s + a.t * power({z}, 2) / (2 * e.j + 1)}}, {{'j': 0::bigint, 't': {z}, 's': {z}}}).s"
    return f"(0.5 - exp(-power({z}, 2) / 2) / sqrt(2 * pi()) * {series})"


def _md5(*parts: str) -> str:
    return f"md5(concat_ws(':', {', '.join(parts)}))"


def _hash_fold(seed: int, key: str, k: int) -> str:
    return f"(('0x' || substr({_md5(chr(39) + str(seed) + chr(39), key + '::varchar')}, 1, 8))::bigint % {k})::int"


LINE = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
_MOMENTS = """WITH m AS (SELECT l_suppkey AS k, avg({c}) AS a, stddev_pop({c}) AS s FROM lineitem GROUP BY 1)
  SELECT k, coalesce(avg(power(({c} - a) / nullif(s, 0), 3)), 0) AS skew, coalesce(avg(power(({c} - a) / nullif(s, 0), 4)) - 3, 0) AS kurt
  FROM lineitem JOIN m ON l_suppkey = k GROUP BY k"""


def _pool_sql() -> str:
    simple = ", ".join(f"round({f}({c}), 6) + 0.0 AS {s}_{c}" for s, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")) for c in LINE)
    higher = ", ".join(f"round(any_value(h_{c}.{s}), 4) + 0.0 AS {n}_{c}" for s, n in (("skew", "skew"), ("kurt", "kurtosis")) for c in LINE)
    joins = " ".join(f"JOIN ({_MOMENTS.format(c=c)}) h_{c} ON h_{c}.k = l_suppkey" for c in LINE)
    return f"SELECT l_suppkey, {simple}, {higher} FROM lineitem {joins} GROUP BY l_suppkey"


@query(_pool_sql())
def pool_statistics(spark, sf_dir):
    d = pooling.pool(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], LINE)
    d = _round(d, *[f"{s}_{c}" for s in ("mean", "std", "min", "max") for c in LINE])
    return _round(d, *[f"{s}_{c}" for s in ("skew", "kurtosis") for c in LINE], digits=4)


@query("""SELECT l_suppkey, round(quantile_cont(l_extendedprice, 0.1), 6) + 0.0 AS p10_l_extendedprice, round(quantile_cont(l_extendedprice, 0.5), 6) + 0.0 AS p50_l_extendedprice,
  round(quantile_cont(l_extendedprice, 0.9), 6) + 0.0 AS p90_l_extendedprice FROM lineitem GROUP BY l_suppkey""")
def pool_percentiles(spark, sf_dir):
    d = pooling.pool(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], ["l_extendedprice"], (), (10, 50, 90))
    return _round(d, "p10_l_extendedprice", "p50_l_extendedprice", "p90_l_extendedprice")


@query("SELECT l_suppkey, 0.0::double AS skew_flat, 0.0::double AS kurtosis_flat, 0.0::double AS std_flat FROM lineitem GROUP BY l_suppkey")
def pool_constant_column(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").select("l_suppkey", F.lit(7.0).alias("flat"))
    return pooling.pool(d, ["l_suppkey"], ["flat"], ("skew", "kurtosis", "std"))


@query("""WITH z AS (SELECT user_id, value - avg(value) OVER (PARTITION BY user_id) AS v FROM events)
  SELECT user_id, round(stddev_pop(v), 6) + 0.0 AS std_value, round(min(v), 6) + 0.0 AS min_value, round(max(v), 6) + 0.0 AS max_value FROM z GROUP BY user_id""")
def pool_mean_normalized(spark, sf_dir):
    d = pooling.pool(_t(spark, sf_dir, "events"), ["user_id"], ["value"], ("std", "min", "max"), normalization="cmn")
    return _round(d, "std_value", "min_value", "max_value")


@query("""WITH z AS (SELECT user_id, (value - avg(value) OVER (PARTITION BY user_id)) / stddev_pop(value) OVER (PARTITION BY user_id) AS v FROM events)
  SELECT user_id, round(min(v), 6) + 0.0 AS min_value, round(max(v), 6) + 0.0 AS max_value FROM z GROUP BY user_id""")
def pool_variance_normalized(spark, sf_dir):
    return _round(pooling.pool(_t(spark, sf_dir, "events"), ["user_id"], ["value"], ("min", "max"), normalization="cmvn"), "min_value", "max_value")


def _delta_sql(source: str, column: str, half: int, out: str) -> str:
    steps = " + ".join(
        f"{n} * (coalesce(lead({column}, {n}) OVER w, last_value({column}) OVER f) - coalesce(lag({column}, {n}) OVER w, first_value({column}) OVER f))" for n in range(1, half + 1)
    )
    below = 2 * sum(n * n for n in range(1, half + 1))
    return f"""SELECT *, ({steps}) / {below}.0::double AS {out} FROM {source} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id),
      f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""


@query(f"SELECT event_id, round(d_value, 6) + 0.0 AS d_value FROM ({_delta_sql('events', 'value', 3, 'd_value')})")
def delta_frames(spark, sf_dir):
    d = frames.deltas(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["value"])
    return _round(d.select("event_id", "d_value"), "d_value")


@query(f"SELECT event_id, round(dd_value, 6) + 0.0 AS dd_value FROM ({_delta_sql('(' + _delta_sql('events', 'value', 3, 'd_value') + ')', 'd_value', 2, 'dd_value')})")
def delta_delta_frames(spark, sf_dir):
    d = frames.deltas(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], ["value"])
    d = frames.deltas(d.withColumnRenamed("d_value", "d"), ["user_id"], ["ts", "event_id"], ["d"], 2, "d")
    return _round(d.select("event_id", F.col("dd").alias("dd_value")), "dd_value")


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda v, i: CASE WHEN i = 1 THEN v::double ELSE v - 0.97::double * embedding[i - 1] END)), 5) + 0.0 AS total,
  round(embedding[2] - 0.97::double * embedding[1], 5) + 0.0 AS second FROM embeddings""")
def pre_emphasis(spark, sf_dir):
    d = _t(spark, sf_dir, "embeddings").select("vec_id", frames.pre_emphasis(F.col("embedding")).alias("y"))
    total = F.aggregate("y", F.lit(0.0), lambda a, x: a + x)
    return d.select("vec_id", rounded(total, 5).alias("total"), rounded(F.get("y", 1), 5).alias("second"))


_FRAMES = "(SELECT vec_id, k::int AS frame, embedding[k * 8 + 1 : k * 8 + 16] AS f FROM embeddings, range(0, 7) t(k))"


@query(f"""SELECT vec_id, frame, round(list_sum(list_transform(f, lambda v, i: v::double * (0.54::double - 0.46::double * cos(2 * pi() * (i - 1) / 15)))), 5) + 0.0 AS weighted,
  round(ln(greatest(list_sum(list_transform(f, lambda v: v::double * v)), 1e-10)), 5) + 0.0 AS log_energy FROM {_FRAMES}""")
def frame_energies(spark, sf_dir):
    cut = frames.frames_of(F.col("embedding"), 16, 8)
    d = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(cut).alias("frame", "f"))
    weights = frames.weights(frames.window_weights("hamming_symmetric", 16))
    return d.select("vec_id", "frame", rounded(frames.dot(F.col("f").cast("array<double>"), weights), 5).alias("weighted"), rounded(frames.log_energy(F.col("f")), 5).alias("log_energy"))


@query("""WITH x AS (SELECT vec_id, i - 1 AS i, embedding[i]::double AS v FROM embeddings, range(1, 65) t(i)), p AS (
  SELECT vec_id, k::int AS bin, power(sum(v * cos(2 * pi() * k * i / 64)), 2) + power(sum(v * sin(2 * pi() * k * i / 64)), 2) AS power FROM x, range(0, 33) b(k) GROUP BY 1, 2)
  SELECT vec_id, bin, round(power, 4) + 0.0 AS power FROM p""")
def power_spectrum(spark, sf_dir):
    d = _t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(frames.power_spectrum(F.col("embedding"), 64)).alias("bin", "power"))
    return _round(d, "power", digits=4)


@query("""WITH l AS (SELECT vec_id, i, ln(greatest(embedding[i]::double * embedding[i], 1e-10)) AS v FROM embeddings, range(1, 65) t(i))
  SELECT vec_id, m::int AS m, round(sqrt(2.0::double / 64) * sum(v * cos(pi() * m * (i - 0.5) / 64)), 5) + 0.0 AS c FROM l, range(0, 13) q(m) GROUP BY vec_id, m""")
def cepstral_coefficients(spark, sf_dir):
    logs = F.transform("embedding", lambda v: F.ln(F.greatest(v.cast("double") * v, F.lit(1e-10))))
    rows = F.array(*[frames.dot(F.col("l"), frames.weights(r)) for r in frames.dct_matrix(13, 64)])
    d = _t(spark, sf_dir, "embeddings").select("vec_id", logs.alias("l")).select("vec_id", F.posexplode(rows).alias("m", "c"))
    return _round(d, "c", digits=5)


_PAIRS = "(SELECT o_custkey, o_totalprice AS a, sum(l_extendedprice) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_custkey, o_totalprice)"


def _pairs(spark, sf_dir) -> DataFrame:
    """Per order its price and the sum of its lines; lines are summed before they are joined."""
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("b"))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_totalprice").alias("a"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


_Z = 1.959963984540054
_FISHER = f"CASE WHEN n > 3 THEN tanh(atanh(r) {{s}} {_Z}::double / sqrt(n - 3)) END"


@query(f"""WITH p AS (SELECT l_returnflag, count(*) AS n, covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0) AS r FROM lineitem GROUP BY 1)
  SELECT l_returnflag, n, round(r, 6) + 0.0 AS r, round({_FISHER.format(s='-')}, 6) + 0.0 AS ci_low, round({_FISHER.format(s='+')}, 6) + 0.0 AS ci_high FROM p""")
def pearson_interval(spark, sf_dir):
    d = association.pearson_ci(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"], p_value=False)
    return _round(d, "r", "ci_low", "ci_high")


def _ranked(x: str, by: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0::double"


@query(f"""WITH r AS (SELECT l_suppkey, {_ranked('l_quantity', 'l_suppkey')} AS a, {_ranked('l_discount', 'l_suppkey')} AS b FROM lineitem)
  SELECT l_suppkey, count(*) AS n, round(covar_pop(a, b) / nullif(stddev_pop(a) * stddev_pop(b), 0), 6) + 0.0 AS rho FROM r GROUP BY l_suppkey""")
def spearman_by_supplier(spark, sf_dir):
    return _round(association.spearman(_t(spark, sf_dir, "lineitem"), "l_quantity", "l_discount", ["l_suppkey"], p_value=False), "rho")


@query(f"""SELECT count(*) AS n, round(2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + power(avg(a) - avg(b), 2)), 6) + 0.0 AS ccc, round(avg(a - b), 2) + 0.0 AS bias, round(stddev_samp(a - b), 2) + 0.0 AS sd,
  round(avg(a - b) - {_Z}::double * stddev_samp(a - b), 2) + 0.0 AS lower, round(avg(a - b) + {_Z}::double * stddev_samp(a - b), 2) + 0.0 AS upper FROM {_PAIRS}""")
def agreement_orders(spark, sf_dir):
    d = association.agreement(_pairs(spark, sf_dir), "a", "b")
    return _round(_round(d, "ccc"), "bias", "sd", "lower", "upper", digits=2)


@query("SELECT o_orderkey, round((a + b) / 2, 4) + 0.0 AS pair_mean, round(a - b, 4) + 0.0 AS pair_diff FROM (SELECT o_orderkey, o_totalprice AS a, sum(l_extendedprice) AS b FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)")
def bland_altman_pairs(spark, sf_dir):
    d = association.bland_altman_pairs(_pairs(spark, sf_dir), "a", "b").select("o_orderkey", "pair_mean", "pair_diff")
    return _round(d, "pair_mean", "pair_diff", digits=4)


_JB = """(WITH m AS (SELECT l_suppkey AS k, avg(l_extendedprice) AS a, stddev_pop(l_extendedprice) AS s, count(*) AS n FROM lineitem GROUP BY 1),
  h AS (SELECT k, any_value(n) AS n, avg(power((l_extendedprice - a) / s, 3)) AS g, avg(power((l_extendedprice - a) / s, 4)) - 3 AS q FROM lineitem JOIN m ON k = l_suppkey GROUP BY k)
  SELECT k AS l_suppkey, n, n / 6.0::double * (g * g + q * q / 4) AS jb, exp(-n / 12.0::double * (g * g + q * q / 4)) AS p_value FROM h)"""


def _jarque_bera(spark, sf_dir) -> DataFrame:
    jb, p = diagnostics.jarque_bera("l_extendedprice")
    return _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), jb.alias("jb"), p.alias("p_value"))


@query(f"SELECT l_suppkey, n, round(jb, 5) + 0.0 AS jb, round(p_value, 6) + 0.0 AS p_value FROM {_JB}")
def jarque_bera_by_supplier(spark, sf_dir):
    return _round(_round(_jarque_bera(spark, sf_dir), "jb", digits=5), "p_value")


@query(f"""SELECT l_suppkey, round(least(1, max((m - i + 1) * p_value) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS p_adjusted
  FROM (SELECT *, row_number() OVER (ORDER BY p_value, l_suppkey) AS i, count(*) OVER () AS m FROM {_JB})""")
def holm_adjustment(spark, sf_dir):
    return _round(association.adjust(_jarque_bera(spark, sf_dir), "p_value", ["l_suppkey"]).select("l_suppkey", "p_adjusted"), "p_adjusted")


@query(f"""SELECT l_suppkey, round(least(1, min(m * p_value / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) + 0.0 AS p_adjusted
  FROM (SELECT *, row_number() OVER (ORDER BY p_value, l_suppkey) AS i, count(*) OVER () AS m FROM {_JB})""")
def benjamini_hochberg_adjustment(spark, sf_dir):
    return _round(association.adjust(_jarque_bera(spark, sf_dir), "p_value", ["l_suppkey"], "fdr_bh").select("l_suppkey", "p_adjusted"), "p_adjusted")


_X = ("l_quantity", "l_discount", "l_tax")


@query("WITH u AS (UNPIVOT (SELECT l_extendedprice AS y, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME feature VALUE x), k AS (SELECT feature, x, y, "
       f"{_ranked('x', 'feature')} AS rx, {_ranked('y', 'feature')} AS ry FROM u) "
       "SELECT feature, count(*) AS n, round(covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)), 6) + 0.0 AS r, round(covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)), 6) + 0.0 AS rho FROM k GROUP BY feature")  # fmt: skip
def correlation_table(spark, sf_dir):
    d = association.feature_correlations(_t(spark, sf_dir, "lineitem"), _X, "l_extendedprice", p_values=False)
    return _round(d.select("feature", "n", "r", "rho"), "r", "rho")


_CORRELATIONS = ("(WITH u AS (UNPIVOT (SELECT l_extendedprice AS y, l_quantity, l_discount, l_tax FROM lineitem) ON l_quantity, l_discount, l_tax INTO NAME feature VALUE x), k AS (SELECT feature, x, y, "
       f"{_ranked('x', 'feature')} AS rx, {_ranked('y', 'feature')} AS ry FROM u) "
       "SELECT feature, list_position(['l_quantity', 'l_discount', 'l_tax'], feature) - 1 AS ordinal, count(*) AS n, covar_pop(x, y) / (stddev_pop(x) * stddev_pop(y)) AS r, covar_pop(rx, ry) / (stddev_pop(rx) * stddev_pop(ry)) AS rho FROM k GROUP BY feature)")  # fmt: skip


def _holm(p: str) -> str:
    return f"least(1, max((3 - i_{p} + 1) * {p}) OVER (ORDER BY i_{p} ROWS UNBOUNDED PRECEDING))"


@query(f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY p_value, ordinal) AS i_p_value, row_number() OVER (ORDER BY rho_p_value, ordinal) AS i_rho_p_value
    FROM {_t_tail(_t_tail(_CORRELATIONS, 'r * sqrt((n - 2) / (1 - r * r))', 'n - 2', 'p_value'), 'rho * sqrt((n - 2) / (1 - rho * rho))', 'n - 2', 'rho_p_value')})
  SELECT ordinal::int AS ordinal, feature, n, round(r, 6) + 0.0 AS r, round({_FISHER.format(s='-')}, 6) + 0.0 AS ci_low, round({_FISHER.format(s='+')}, 6) + 0.0 AS ci_high, round(p_value, 6) + 0.0 AS p_value, round(rho, 6) + 0.0 AS rho,
    round(rho_p_value, 6) + 0.0 AS rho_p_value, round({_holm('p_value')}, 6) + 0.0 AS p_adjusted, round({_holm('rho_p_value')}, 6) + 0.0 AS rho_p_adjusted FROM p""")
def correlation_p_values(spark, sf_dir):
    """p-values by the t distribution, both families adjusted."""
    d = association.feature_correlations(_t(spark, sf_dir, "lineitem"), _X, "l_extendedprice")
    return _round(d, "r", "ci_low", "ci_high", "p_value", "rho", "rho_p_value", "p_adjusted", "rho_p_adjusted")


@query("""SELECT l_suppkey, feature, round(r, 6) + 0.0 AS r FROM (SELECT l_suppkey, 'l_quantity' AS feature, covar_pop(l_quantity, l_extendedprice) / nullif(stddev_pop(l_quantity) * stddev_pop(l_extendedprice), 0) AS r
  FROM lineitem GROUP BY 1) WHERE r IS NOT NULL ORDER BY abs(r) DESC, l_suppkey LIMIT 10""")
def strongest_correlations(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(pearson("l_quantity", "l_extendedprice").alias("r")).where("r IS NOT NULL")
    d = d.orderBy(F.abs("r").desc(), "l_suppkey").limit(10)
    return d.select("l_suppkey", F.lit("l_quantity").alias("feature"), rounded("r").alias("r"))


@query("""SELECT l_returnflag, round(regr_slope(l_extendedprice, l_quantity), 4) + 0.0 AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) + 0.0 AS intercept,
  round(regr_r2(l_extendedprice, l_quantity), 6) + 0.0 AS r2 FROM lineitem GROUP BY 1""")
def simple_regression(spark, sf_dir):
    y, x = "l_extendedprice", "l_quantity"
    return _t(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(
        rounded(F.regr_slope(y, x), 4).alias("slope"), rounded(F.regr_intercept(y, x), 3).alias("intercept"), rounded(F.regr_r2(y, x)).alias("r2")
    )


_NORMAL = """(WITH c AS (SELECT l_extendedprice - avg(l_extendedprice) OVER () AS y, l_quantity - avg(l_quantity) OVER () AS a, (l_discount - avg(l_discount) OVER ()) * 100 AS b, (l_tax - avg(l_tax) OVER ()) * 100 AS d FROM lineitem),
  s AS (SELECT count(*) AS n, sum(a*a) AS aa, sum(a*b) AS ab, sum(a*d) AS ad, sum(b*b) AS bb, sum(b*d) AS bd, sum(d*d) AS dd, sum(a*y) AS ay, sum(b*y) AS by_, sum(d*y) AS dy, sum(y*y) AS yy FROM c),
  e AS (SELECT *, aa*(bb*dd-bd*bd) - ab*(ab*dd-bd*ad) + ad*(ab*bd-bb*ad) AS det FROM s),
  v AS (SELECT *, (ay*(bb*dd-bd*bd) - ab*(by_*dd-bd*dy) + ad*(by_*bd-bb*dy)) / det AS b1, (aa*(by_*dd-bd*dy) - ay*(ab*dd-bd*ad) + ad*(ab*dy-by_*ad)) / det AS b2,
    (aa*(bb*dy-by_*bd) - ab*(ab*dy-by_*ad) + ay*(ab*bd-bb*ad)) / det AS b3 FROM e)
  SELECT *, yy - b1*ay - b2*by_ - b3*dy AS rss FROM v)"""


@query(f"""SELECT n, round(b1, 3) + 0.0 AS b_quantity, round(b2 * 100, 1) + 0.0 AS b_discount, round(b3 * 100, 1) + 0.0 AS b_tax, round(1 - rss / yy, 6) + 0.0 AS r2, round(1 - (rss / yy) * (n - 1) / (n - 4), 6) + 0.0 AS adj_r2,
  round(n * (ln(2 * pi() * rss / n) + 1) + 8, 2) + 0.0 AS aic, round(n * (ln(2 * pi() * rss / n) + 1) + 4 * ln(n), 2) + 0.0 AS bic, round((yy - rss) / 3 / (rss / (n - 4)) / 1000, 4) + 0.0 AS f_thousands FROM {_NORMAL}""")
def least_squares(spark, sf_dir):
    fit = linear.fit_ols(_t(spark, sf_dir, "lineitem"), _X, "l_extendedprice")
    s, b = fit.stats, fit.beta
    row = (s["n"], float(b[1]), float(b[2]), float(b[3]), s["r2"], s["adj_r2"], s["aic"], s["bic"], s["f"] / 1000)
    d = spark.createDataFrame([row], "n bigint, b_quantity double, b_discount double, b_tax double, r2 double, adj_r2 double, aic double, bic double, f_thousands double")
    for columns, digits in ((("b_quantity",), 3), (("b_discount", "b_tax"), 1), (("r2", "adj_r2"), 6), (("aic", "bic"), 2), (("f_thousands",), 4)):
        d = _round(d, *columns, digits=digits)
    return d


_T95 = f"({_Z}::double + (power({_Z}, 3) + {_Z}) / (4 * df) + (5 * power({_Z}, 5) + 16 * power({_Z}, 3) + 3 * {_Z}) / (96 * df * df) + (3 * power({_Z}, 7) + 19 * power({_Z}, 5) + 17 * power({_Z}, 3) - 15 * {_Z}) / (384 * power(df, 3)))"
_ALL_TERMS = f"""(WITH v AS {_NORMAL}, m AS (SELECT avg(l_extendedprice) AS y, avg(l_quantity) AS a, avg(l_discount) * 100 AS b, avg(l_tax) * 100 AS d FROM lineitem),
  s AS (SELECT v.*, n - 4 AS df, rss / (n - 4) AS s2, m.y AS my, m.a AS ma, m.b AS mb, m.d AS md, (bb*dd-bd*bd)/det AS i11, (aa*dd-ad*ad)/det AS i22, (aa*bb-ab*ab)/det AS i33, -(ab*dd-bd*ad)/det AS i12, (ab*bd-bb*ad)/det AS i13, -(aa*bd-ab*ad)/det AS i23 FROM v, m)
  SELECT 'intercept' AS term, df, my - b1*ma - b2*mb - b3*md AS estimate, sqrt(s2 * (1.0::double / n + ma*ma*i11 + mb*mb*i22 + md*md*i33 + 2*ma*mb*i12 + 2*ma*md*i13 + 2*mb*md*i23)) AS std_error FROM s
  UNION ALL SELECT 'l_quantity', df, b1, sqrt(s2 * i11) FROM s UNION ALL SELECT 'l_discount', df, b2 * 100, 100 * sqrt(s2 * i22) FROM s UNION ALL SELECT 'l_tax', df, b3 * 100, 100 * sqrt(s2 * i33) FROM s)"""


@query(f"""SELECT term, round(estimate, 3) + 0.0 AS estimate, round(std_error, 4) + 0.0 AS std_error, round(estimate / std_error, 4) + 0.0 AS t, round(p_value, 6) + 0.0 AS p_value, round(estimate - {_T95} * std_error, 2) + 0.0 AS ci_low,
  round(estimate + {_T95} * std_error, 2) + 0.0 AS ci_high FROM {_t_tail(_ALL_TERMS, 'estimate / std_error', 'df', 'p_value')}""")
def coefficient_table(spark, sf_dir):
    """Estimates, standard errors, t, p-values and intervals."""
    d = linear.fit_ols(_t(spark, sf_dir, "lineitem"), _X, "l_extendedprice").coefficients(spark)
    return _round(_round(_round(_round(d, "estimate", digits=3), "std_error", "t", digits=4), "p_value"), "ci_low", "ci_high", digits=2)


@query(f"""WITH v AS {_NORMAL}, s AS (SELECT *, rss / (n - 4) AS s2 FROM v)
  SELECT 'l_quantity' AS term, round(b1, 3) + 0.0 AS estimate, round(sqrt(s2 * (bb*dd-bd*bd) / det), 4) + 0.0 AS std_error, round(b1 / sqrt(s2 * (bb*dd-bd*bd) / det), 4) + 0.0 AS t FROM s
  UNION ALL SELECT 'l_discount', round(b2 * 100, 3) + 0.0, round(100 * sqrt(s2 * (aa*dd-ad*ad) / det), 4) + 0.0, round(b2 / sqrt(s2 * (aa*dd-ad*ad) / det), 4) + 0.0 FROM s
  UNION ALL SELECT 'l_tax', round(b3 * 100, 3) + 0.0, round(100 * sqrt(s2 * (aa*bb-ab*ab) / det), 4) + 0.0, round(b3 / sqrt(s2 * (aa*bb-ab*ab) / det), 4) + 0.0 FROM s""")
def coefficient_estimates(spark, sf_dir):
    """Estimates, standard errors and t of the slopes."""
    d = linear.fit_ols(_t(spark, sf_dir, "lineitem"), _X, "l_extendedprice").coefficients(spark).where("term <> 'intercept'").select("term", "estimate", "std_error", "t")
    return _round(_round(d, "estimate", digits=3), "std_error", "t", digits=4)


@query("""WITH s AS (SELECT sum(l_quantity * l_quantity) AS xx, sum(l_quantity * l_extendedprice) AS xy, sum(l_extendedprice * l_extendedprice) AS yy, count(*) AS n FROM lineitem)
  SELECT n, round(xy / xx, 4) + 0.0 AS slope, round(xy * xy / xx / yy, 6) + 0.0 AS r2, round(1 - (1 - xy * xy / xx / yy) * n / (n - 1), 6) + 0.0 AS adj_r2, round(sqrt((yy - xy * xy / xx) / (n - 1)), 3) + 0.0 AS residual_std_error FROM s""")
def regression_through_origin(spark, sf_dir):
    fit = linear.fit_ols(_t(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice", intercept=False)
    s = fit.stats
    d = spark.createDataFrame([(s["n"], float(fit.beta[1]), s["r2"], s["adj_r2"], s["residual_std_error"])], "n bigint, slope double, r2 double, adj_r2 double, residual_std_error double")
    return _round(_round(_round(d, "slope", digits=4), "r2", "adj_r2"), "residual_std_error", digits=3)


@query("""WITH p AS (SELECT o_orderkey, o_totalprice, sum(l_extendedprice) AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
  s AS (SELECT count(*) AS n, avg(o_totalprice) AS mx, regr_sxx(y, o_totalprice) AS sxx, regr_slope(y, o_totalprice) AS b, regr_intercept(y, o_totalprice) AS a, regr_syy(y, o_totalprice) - power(regr_sxy(y, o_totalprice), 2) / regr_sxx(y, o_totalprice) AS rss FROM p),
  r AS (SELECT o_orderkey, y - a - b * o_totalprice AS e, 1.0::double / n + power(o_totalprice - mx, 2) / sxx AS h, rss / (n - 2) AS s2 FROM p, s)
  SELECT o_orderkey, round(e, 2) + 0.0 AS residual, round(h * 1e4, 5) + 0.0 AS leverage_e4, round(e / sqrt(s2 * (1 - h)), 5) + 0.0 AS studentized, round(e * e / (2 * s2) * h / power(1 - h, 2) * 1e4, 4) + 0.0 AS cooks_e4 FROM r""")
def influence_rows(spark, sf_dir):
    d = _pairs(spark, sf_dir)
    fit = linear.fit_ols(d, ["a"], "b")
    d = diagnostics.influence(d, fit, "b")
    return d.select("o_orderkey", rounded("residual", 2).alias("residual"), rounded(F.col("leverage") * 1e4, 5).alias("leverage_e4"), rounded("studentized", 5).alias("studentized"), rounded(F.col("cooks") * 1e4, 4).alias("cooks_e4"))


@query("""WITH c AS (SELECT user_id, ts, event_id, value - avg(value) OVER (PARTITION BY user_id) AS e FROM events), s AS (SELECT user_id, e, e - lag(e) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM c)
  SELECT user_id, round(sum(d * d) / nullif(sum(e * e), 0), 6) + 0.0 AS durbin_watson FROM s GROUP BY user_id""")
def durbin_watson_by_user(spark, sf_dir):
    d = _t(spark, sf_dir, "events").withColumn("e", F.col("value") - F.avg("value").over(Window.partitionBy("user_id")))
    return _round(diagnostics.durbin_watson(d, "e", ["ts", "event_id"], ["user_id"]), "durbin_watson")


_LINE_OF_ORDERS = """p AS (SELECT o_orderkey, o_totalprice AS x, sum(l_extendedprice) AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2),
  s AS (SELECT count(*)::double AS n, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_syy(y, x) - power(regr_sxy(y, x), 2) / regr_sxx(y, x) AS rss, sum(x) AS sx, sum(x * x) AS sx2 FROM p),
  r AS (SELECT o_orderkey, x, y, y - a - b * x AS e, 1 / n + power(x - mx, 2) / sxx AS h, rss / (n - 2) AS s2, n FROM p, s)"""


@query(f"""WITH {_LINE_OF_ORDERS}, k AS (SELECT avg(e) AS m, stddev_pop(e) AS sd, avg(power(e, 2)) AS m2 FROM r),
  j AS (SELECT any_value(n) AS n, avg(power((e - m) / sd, 3)) AS g, avg(power((e - m) / sd, 4)) - 3 AS q FROM r, k), w AS (SELECT e, e - lag(e) OVER (ORDER BY o_orderkey) AS d FROM r)
  SELECT (SELECT n FROM j)::bigint AS n, round((SELECT stddev_samp(e) FROM r), 2) + 0.0 AS residual_sd, round((SELECT n / 6 * (g * g + q * q / 4) FROM j), 3) + 0.0 AS jarque_bera, round((SELECT sum(d * d) / sum(e * e) FROM w), 6) + 0.0 AS durbin_watson,
    round((SELECT count(*) * power(corr(e * e, x), 2) FROM r), 3) + 0.0 AS breusch_pagan, round((SELECT max(h) * 1e3 FROM r), 5) + 0.0 AS max_leverage_e3, round((SELECT max(e * e / (2 * s2) * h / power(1 - h, 2)) * 1e3 FROM r), 4) + 0.0 AS max_cooks_e3,
    round((SELECT sqrt(((n + sx2) / 2 + sqrt(power((n - sx2) / 2, 2) + sx * sx)) * ((n + sx2) / 2 + sqrt(power((n - sx2) / 2, 2) + sx * sx)) / (n * sxx)) FROM s), 1) + 0.0 AS condition_number""")
def residual_tests(spark, sf_dir):
    """The tests of a fit's residuals, in the order of the orders' keys."""
    d = _pairs(spark, sf_dir)
    out = diagnostics.residual_report(d, linear.fit_ols(d, ["a"], "b"), "b", ["o_orderkey"], rows=5_000)
    out = out.select("n", rounded("residual_sd", 2).alias("residual_sd"), rounded("jarque_bera", 3).alias("jarque_bera"), rounded("durbin_watson").alias("durbin_watson"), rounded("breusch_pagan", 3).alias("breusch_pagan"),
        rounded(F.col("max_leverage") * 1e3, 5).alias("max_leverage_e3"), rounded(F.col("max_cooks_distance") * 1e3, 4).alias("max_cooks_e3"), rounded("condition_number", 1).alias("condition_number"))
    return out


@query("""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b, regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem), r AS (SELECT l_quantity AS x, power(l_extendedprice - a - b * l_quantity, 2) AS e2 FROM lineitem, f)
  SELECT round(count(*) * regr_r2(e2, x), 3) + 0.0 AS lm FROM r""")
def breusch_pagan_test(spark, sf_dir):
    d = _t(spark, sf_dir, "lineitem")
    lm, _ = diagnostics.breusch_pagan(d, linear.fit_ols(d, ["l_quantity"], "l_extendedprice"), "l_extendedprice")
    return _round(spark.createDataFrame([(lm,)], "lm double"), "lm", digits=3)


@query("""WITH q AS (SELECT l_quantity AS a, l_extendedprice AS b FROM lineitem) SELECT term, round(1 / (1 - r2), 6) + 0.0 AS vif FROM (SELECT power(corr(a, b), 2) AS r2 FROM q), (VALUES ('l_quantity'), ('l_extendedprice')) t(term)""")
def variance_inflation(spark, sf_dir):
    m = linear.moments(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"], "l_tax")
    return _round(spark.createDataFrame([(n, v) for n, _, v in diagnostics.variance_inflation(m)], "term string, vif double"), "vif")


@query("""WITH c AS (SELECT l_quantity - avg(l_quantity) OVER () AS q, l_discount - avg(l_discount) OVER () AS d FROM lineitem)
  SELECT round(sum(q * q), 2) + 0.0 AS q2, round(sum(d * d), 6) + 0.0 AS d2, round(sum(q * d), 4) + 0.0 AS qd FROM c""")
def quadratic_surface_terms(spark, sf_dir):
    d, names = linear.quadratic_surface(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"])
    return d.agg(rounded(F.sum(F.col("`l_quantity^2`")), 2).alias("q2"), rounded(F.sum(F.col("`l_discount^2`"))).alias("d2"), rounded(F.sum(F.col("`l_quantity*l_discount`")), 4).alias("qd"))


def _surface_sql(steps: int) -> str:
    """Second-order terms made orthogonal one by one over the rows of the table; nodes of the grid go along without counting."""
    w, terms = "FILTER (WHERE tr) OVER ()", ("a", "b", "a * a", "b * b", "a * b")
    rows = f"""r AS (SELECT l_quantity::double AS x1, l_discount::double AS x2, l_extendedprice::double AS y, true AS tr FROM lineitem UNION ALL
      SELECT a1 + (b1 - a1) * i / {steps - 1}, a2 + (b2 - a2) * j / {steps - 1}, NULL, false FROM (SELECT min(l_quantity)::double AS a1, max(l_quantity)::double AS b1, min(l_discount)::double AS a2, max(l_discount)::double AS b2 FROM lineitem), range(0, {steps}) s(i), range(0, {steps}) t(j)),
      c AS (SELECT *, x1 - avg(x1) {w} AS a, (x2 - avg(x2) {w}) * 100 AS b, avg(y) {w} AS p0 FROM r)"""
    ctes, last = [rows], "c"
    for k, term in enumerate(terms, 1):
        ctes.append(f"z{k} AS (SELECT *, {term} - avg({term}) {w} AS z{k} FROM {last})")
        away = "".join(f" - sum(z{k} * u{j}) {w} / n{j} * u{j}" for j in range(1, k))
        ctes.append(f"v{k} AS (SELECT *, z{k}{away} AS u{k} FROM z{k})")
        ctes.append(f"w{k} AS (SELECT *, sum(u{k} * u{k}) {w} AS n{k}, p{k - 1} + sum(y * u{k}) {w} / (sum(u{k} * u{k}) {w}) * u{k} AS p{k} FROM v{k})")
        last = f"w{k}"
    return f"WITH {', '.join(ctes)} SELECT round(x1, 6) + 0.0 AS l_quantity, round(x2, 6) + 0.0 AS l_discount, round(p{len(terms)}, 3) + 0.0 AS fitted FROM {last} WHERE NOT tr"


@query(_surface_sql(6))
def response_surface(spark, sf_dir):
    """A second-order surface of prices over quantity and discount, at the nodes of a grid."""
    return _round(_round(linear.response_surface(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", 6)[0], "l_quantity", "l_discount"), "fitted", digits=3)


@query("""WITH z AS (SELECT o_orderkey, (o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER () AS z FROM orders), s AS (SELECT count(*)::double AS n, avg(power(z, 3)) AS m3, avg(power(z, 4)) AS m4 FROM z)
  SELECT o_orderkey, round(z / sqrt(n) * 1000, 5) + 0.0 AS p1, round((z * z - m3 * z - 1) / sqrt(n * (m4 - m3 * m3 - 1)) * 1000, 5) + 0.0 AS p2 FROM z, s""")
def orthogonal_polynomials(spark, sf_dir):
    d = _t(spark, sf_dir, "orders")
    d = linear.PolynomialBasis.fit(d, "o_totalprice", 2).transform(d, "o_totalprice")
    return d.select("o_orderkey", rounded(F.col("p1") * 1000, 5).alias("p1"), rounded(F.col("p2") * 1000, 5).alias("p2"))


def _sweep_sql(degrees: int) -> str:
    """Orthogonal polynomials of the rows outside of every fold (-1: of all rows), degree by degree, and what they predict."""
    w = "FILTER (WHERE tr) OVER (PARTITION BY f)"
    ctes = [f"""d AS (SELECT c_acctbal AS x, avg(o_totalprice) AS y, {_hash_fold(3, 'c_custkey', 5)} AS fold FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey, c_acctbal),
      g AS (SELECT DISTINCT fold AS f FROM d UNION ALL SELECT -1), s0 AS (SELECT f, fold, x, y, fold <> f AS tr FROM d, g),
      s1 AS (SELECT *, (x - avg(x) {w}) / stddev_pop(x) {w} AS z, avg(y) {w} AS e0, (count(*) {w})::double AS n0, 1.0::double AS p0 FROM s0), s2 AS (SELECT *, z AS p1 FROM s1)"""]
    for k in range(1, degrees + 1):
        ctes.append(f"t{k} AS (SELECT *, sum(p{k} * p{k}) {w} AS n{k}, sum(z * p{k} * p{k}) {w} AS m{k}, sum(y * p{k}) {w} AS c{k} FROM s{k + 1})")
        ctes.append(f"s{k + 2} AS (SELECT *, e{k - 1} + c{k} / n{k} * p{k} AS e{k}, (z - m{k} / n{k}) * p{k} - n{k} / n{k - 1} * p{k - 1} AS p{k + 1} FROM t{k})")
    last, rows = f"s{degrees + 2}", []
    for k in range(1, degrees + 1):
        h = " + ".join(f"p{i} * p{i} / n{i}" for i in range(k + 1))
        rows.append(f"""SELECT {k} AS degree, count(*) AS n, sum(power(y - e{k}, 2)) AS rss, 1 - sum(power(y - e{k}, 2)) / sum(power(y - e0, 2)) AS r2, sqrt(avg(power((y - e{k}) / (1 - ({h})), 2))) AS loocv_rmse,
      (SELECT avg(r) FROM (SELECT sqrt(avg(power(y - e{k}, 2))) AS r FROM {last} WHERE f = fold GROUP BY f)) AS kfold_rmse FROM {last} WHERE f = -1""")
    return f"""WITH {", ".join(ctes)}, a AS ({" UNION ALL ".join(rows)})
      SELECT degree, n::int AS n, round(rss / 1e9, 4) + 0.0 AS rss_billions, round(r2, 6) + 0.0 AS r2, round(n * (ln(2 * pi() * rss / n) + 1) + 2 * (degree + 1), 4) + 0.0 AS aic, round(n * (ln(2 * pi() * rss / n) + 1) + (degree + 1) * ln(n), 4) + 0.0 AS bic,
        round(loocv_rmse, 4) + 0.0 AS loocv_rmse, round(kfold_rmse, 4) + 0.0 AS kfold_rmse FROM a"""


@query(_sweep_sql(4))
def polynomial_order_sweep(spark, sf_dir):
    """Degrees 1 to 4: information criteria, PRESS and 5-fold errors."""
    d = _t(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x")).join(
        _t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.avg("o_totalprice").alias("y")), "c_custkey"
    ).withColumn("fold", folds.hashed(5, 3, "c_custkey"))
    d = d.persist()
    rows = linear.order_sweep(d, "x", "y", 4, "fold")
    d.unpersist()
    names = ("degree", "n", "r2", "aic", "bic", "loocv_rmse", "kfold_rmse")
    out = spark.createDataFrame([(*(r[c] for c in names), r["rss"] / 1e9) for r in rows], "degree int, n int, r2 double, aic double, bic double, loocv_rmse double, kfold_rmse double, rss_billions double")
    return _round(_round(out, "r2"), "aic", "bic", "loocv_rmse", "kfold_rmse", "rss_billions", digits=4)


@query("""WITH z AS (SELECT c_custkey, (c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER () AS z, count(*) OVER ()::double AS n0 FROM customer),
  a AS (SELECT *, z AS p1, sum(z * z) OVER () AS n1, sum(z * z * z) OVER () AS m1 FROM z), b AS (SELECT *, (z - m1 / n1) * p1 - n1 / n0 AS p2 FROM a), c AS (SELECT *, sum(p2 * p2) OVER () AS n2, sum(z * p2 * p2) OVER () AS m2 FROM b),
  d AS (SELECT *, (z - m2 / n2) * p2 - n2 / n1 * p1 AS p3 FROM c)
  SELECT c_custkey, round(p2 / sqrt(n2) * 1000, 5) + 0.0 AS p2, round(p3 / sqrt(sum(p3 * p3) OVER ()) * 1000, 5) + 0.0 AS p3 FROM d""")
def orthogonal_cubics(spark, sf_dir):
    d = _t(spark, sf_dir, "customer")
    d = linear.PolynomialBasis.fit(d, "c_acctbal", 3).transform(d, "c_acctbal")
    return d.select("c_custkey", rounded(F.col("p2") * 1000, 5).alias("p2"), rounded(F.col("p3") * 1000, 5).alias("p3"))


def _orders_of_lines(spark, sf_dir) -> DataFrame:
    """Per order the sum of its lines' prices, and what may predict it."""
    lines = _t(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_extendedprice").alias("y"), F.count(F.lit(1)).cast("double").alias("n_lines"), F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax")
    )
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return o.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).drop("l_orderkey")


_ORDER_X = ("n_lines", "quantity", "discount", "tax", "price")


@query()
def stepwise_selection(spark, sf_dir):
    """The log of a selection among what may predict the sum of an order's lines."""
    _, steps = linear.stepwise(linear.moments(_orders_of_lines(spark, sf_dir), _ORDER_X, "y"))
    clean = lambda v: None if v is None or v != v else float(v)
    rows = [(s["step"], s["action"], s["term"], clean(s["f"]), clean(s["p_value"]), s["n_terms"], clean(s["r2"]), clean(s["adj_r2"])) for s in steps]
    return spark.createDataFrame(rows, "step int, action string, term string, f double, p_value double, n_terms int, r2 double, adj_r2 double")


_ORDER_LINES = "(SELECT o_orderkey, o_totalprice AS price, sum(l_extendedprice) AS y, count(*)::double AS n_lines, sum(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)"


@query(f"""WITH o AS {_ORDER_LINES}, r AS (SELECT term, r2, n FROM (SELECT count(*) AS n, power(corr(y, n_lines), 2) AS n_lines, power(corr(y, quantity), 2) AS quantity, power(corr(y, discount), 2) AS discount,
  power(corr(y, tax), 2) AS tax, power(corr(y, price), 2) AS price FROM o) UNPIVOT (r2 FOR term IN (n_lines, quantity, discount, tax, price)))
  SELECT term, round(r2, 6) + 0.0 AS r2, round(r2 / ((1 - r2) / (n - 2)) / 1000, 5) + 0.0 AS f_thousands FROM r""")
def entry_tests(spark, sf_dir):
    """Partial F tests of the first step of a selection: every candidate against the empty model."""
    m = linear.moments(_orders_of_lines(spark, sf_dir), _ORDER_X, "y")
    empty, n = linear.residual_sum(m, []), int(round(m.total[0, 0]))
    rows = []
    for k, name in enumerate(m.names):
        rss = linear.residual_sum(m, [k])
        rows.append((name, 1 - rss / empty, linear.partial_f(empty, rss, n - 2)[0] / 1000))
    return _round(_round(spark.createDataFrame(rows, "term string, r2 double, f_thousands double"), "r2"), "f_thousands", digits=5)


_DESCENT_COST = "0.5::double * (b0*b0 + b1*b1 + b2*b2 + b3*b3 + 2*b1*b2*r12 + 2*b1*b3*r13 + 2*b2*b3*r23 - 2*(b0*my + b1*c1 + b2*c2 + b3*c3) + yy)"


@query(f"""WITH RECURSIVE s AS (SELECT corr(l_quantity, l_discount) AS r12, corr(l_quantity, l_tax) AS r13, corr(l_discount, l_tax) AS r23, covar_pop(l_extendedprice, l_quantity) / stddev_pop(l_quantity) AS c1, covar_pop(l_extendedprice, l_discount) / stddev_pop(l_discount) AS c2,
    covar_pop(l_extendedprice, l_tax) / stddev_pop(l_tax) AS c3, avg(l_extendedprice) AS my, var_pop(l_extendedprice) + power(avg(l_extendedprice), 2) AS yy FROM lineitem),
  g AS (SELECT 0 AS iteration, 0.0::double AS b0, 0.0::double AS b1, 0.0::double AS b2, 0.0::double AS b3, yy / 2 AS cost, false AS ended FROM s
    UNION ALL SELECT iteration + 1, b0, b1, b2, b3, now, cost - now <= 1e-12 * abs(cost) FROM (SELECT *, {_DESCENT_COST} AS now FROM (SELECT iteration, cost, b0 - 0.1 * (b0 - my) AS b0, b1 - 0.1 * (b1 + r12*b2 + r13*b3 - c1) AS b1, b2 - 0.1 * (r12*b1 + b2 + r23*b3 - c2) AS b2,
      b3 - 0.1 * (r13*b1 + r23*b2 + b3 - c3) AS b3, s.* FROM g, s WHERE NOT ended)))
  SELECT iteration, round(cost / 1e6, 5) + 0.0 AS cost_millions, 'converged' AS status FROM g""")
def gradient_descent_costs(spark, sf_dir):
    """Cost of every iteration of gradient descent from one pass of moments."""
    found = linear.gradient_descent(linear.moments(_t(spark, sf_dir, "lineitem"), _X, "l_extendedprice"))
    return _round(spark.createDataFrame([(k, c / 1e6, found.status) for k, c in enumerate(found.costs)], "iteration int, cost_millions double, status string"), "cost_millions", digits=5)


@query("""WITH s AS (SELECT avg(l_extendedprice) AS m, var_pop(l_extendedprice) AS v, covar_pop(l_extendedprice, l_quantity) / stddev_pop(l_quantity) AS c FROM lineitem)
  SELECT k::int AS iteration, round(0.5::double * (power(m, 2) * power(0.8::double, 2 * k) + v - power(c, 2) * (1 - power(0.8::double, 2 * k))) / 1e6, 4) + 0.0 AS cost_millions FROM s, range(0, 21) t(k)""")
def gradient_descent_of_one(spark, sf_dir):
    """Twenty iterations with one predictor, whose costs have a closed form."""
    found = linear.gradient_descent(linear.moments(_t(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice"), rate=0.2, tol=0.0, max_iter=20)
    return _round(spark.createDataFrame([(k, c / 1e6) for k, c in enumerate(found.costs)], "iteration int, cost_millions double"), "cost_millions", digits=4)


@query("""WITH s AS (SELECT count(*)::double AS n, avg(o_totalprice) AS mx, regr_sxx(y, o_totalprice) AS sxx, regr_slope(y, o_totalprice) AS b, regr_intercept(y, o_totalprice) AS a FROM
    (SELECT o_totalprice, sum(l_extendedprice) AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice)),
  p AS (SELECT o_totalprice AS x, sum(l_extendedprice) AS y FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_totalprice)
  SELECT round(sqrt(avg(power((y - a - b * x) / (1 - 1 / n - power(x - mx, 2) / sxx), 2))), 3) + 0.0 AS loocv_rmse FROM p, s""")
def leave_one_out_line(spark, sf_dir):
    """Error of leaving out one row at a time, from leverages instead of refits."""
    row = linear.order_sweep(_pairs(spark, sf_dir), "a", "b", 1)[0]
    return _round(spark.createDataFrame([(row["loocv_rmse"],)], "loocv_rmse double"), "loocv_rmse", digits=3)


@query(f"SELECT o_orderkey, ((row_number() OVER (ORDER BY {_md5(chr(39) + '7' + chr(39), 'o_orderkey::varchar')}, o_orderkey) - 1) % 5)::int AS fold FROM orders")
def folds_shuffled(spark, sf_dir):
    return folds.shuffled(_t(spark, sf_dir, "orders"), 5, ["o_orderkey"], 7).select("o_orderkey", "fold")


@query(f"""WITH s AS (SELECT o_orderstatus AS c, coalesce(sum(count(*)) OVER (ORDER BY o_orderstatus ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM orders GROUP BY 1)
  SELECT o_orderkey, ((start + row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_md5(chr(39) + '7' + chr(39), 'o_orderkey::varchar')}, o_orderkey) - 1) % 4)::int AS fold FROM orders JOIN s ON c = o_orderstatus""")
def folds_stratified(spark, sf_dir):
    return folds.stratified(_t(spark, sf_dir, "orders"), 4, "o_orderstatus", ["o_orderkey"], 7).select("o_orderkey", "fold")


@query(f"""WITH RECURSIVE g AS (SELECT c_nationkey, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {_md5(chr(39) + '3' + chr(39), 'c_nationkey::varchar')}) AS i FROM customer GROUP BY 1),
  f AS (SELECT 0::bigint AS i, [0, 0, 0]::bigint[] AS loads, NULL::int AS k, 0::bigint AS n, 0::int AS fold UNION ALL
    SELECT g.i, list_transform(f.loads, lambda v, j: CASE WHEN j = list_position(f.loads, list_min(f.loads)) THEN v + g.n ELSE v END), g.c_nationkey, g.n, (list_position(f.loads, list_min(f.loads)) - 1)::int FROM f JOIN g ON g.i = f.i + 1)
  SELECT k AS c_nationkey, n, fold FROM f WHERE i > 0""")
def folds_grouped(spark, sf_dir):
    return folds.grouped(_t(spark, sf_dir, "customer"), 3, "c_nationkey", 3)


_TRIALS = "list_transform([1, 2, 3], lambda f: list_transform(loads, lambda row, j: CASE WHEN j = f THEN list_transform(row, lambda v, c: v + g.v[c]) ELSE row END))"
_COSTS = f"list_transform({_TRIALS}, lambda t: round(list_avg(list_transform(range(1, len(share) + 1), lambda c: list_stddev_pop([t[1][c] / share[c], t[2][c] / share[c], t[3][c] / share[c]]))), 9))"


@query(f"""WITH RECURSIVE s AS (SELECT list(c_mktsegment ORDER BY c_mktsegment) AS classes FROM (SELECT DISTINCT c_mktsegment FROM customer)),
  a AS (SELECT c_nationkey, list_transform(any_value(classes), lambda c: len(list_filter(list(c_mktsegment), lambda x: x = c))::double) AS v FROM customer, s GROUP BY 1),
  o AS MATERIALIZED (SELECT c_nationkey, v, row_number() OVER (ORDER BY round(list_stddev_pop(v), 9) DESC, v DESC, {_md5("'5'", 'c_nationkey::varchar')}, c_nationkey) AS i FROM a),
  h AS (SELECT list(greatest(t, 1) ORDER BY c) AS share FROM (SELECT c, sum(v[c]) AS t FROM o, range(1, (SELECT len(classes) FROM s) + 1) r(c) GROUP BY c)),
  f AS (SELECT 0::bigint AS i, list_transform([1, 2, 3], lambda k: list_transform(share, lambda x: 0.0::double)) AS loads, share, NULL::int AS k, 0::int AS fold FROM h UNION ALL
    SELECT i, list_transform(loads, lambda row, j: CASE WHEN j = fold + 1 THEN list_transform(row, lambda x, c: x + v[c]) ELSE row END), share, k, fold FROM (
      SELECT g.i, loads, share, g.v, g.c_nationkey AS k, (list_sort(list_transform([1, 2, 3], lambda f: {{'c': ({_COSTS})[f], 'n': list_sum(loads[f]), 'f': f}}))[1].f - 1)::int AS fold FROM f JOIN o g ON g.i = f.i + 1))
  SELECT k AS c_nationkey, fold FROM f WHERE i > 0""")
def folds_stratified_groups(spark, sf_dir):
    """Whole nations, with the market segments balanced between three folds."""
    return folds.stratified_groups(_t(spark, sf_dir, "customer"), 3, "c_nationkey", "c_mktsegment", 5)


@query(f"""WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, {_hash_fold(5, 'l_suppkey', 4)} AS fold FROM lineitem), t AS (SELECT DISTINCT fold AS k FROM d),
  b AS (SELECT k, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM d JOIN t ON fold <> k GROUP BY k)
  SELECT fold, count(*) AS n, round(avg(abs(y - a - b * x)), 3) + 0.0 AS mae, round(sqrt(avg(power(y - a - b * x, 2))), 3) + 0.0 AS rmse, round(1 - avg(power(y - a - b * x, 2)) / var_pop(y), 6) + 0.0 AS r2 FROM d JOIN b ON k = fold GROUP BY fold""")
def cross_validated_regression(spark, sf_dir):
    """Whole suppliers stay in a fold; the training sums of all folds come from one pass."""
    d = _t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", folds.hashed(4, 5, "l_suppkey").alias("fold"))
    p = models.linear_cv(d, ["l_quantity"], "l_extendedprice")
    e = F.col("l_extendedprice") - F.col("predicted")
    return p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.abs(e)), 3).alias("mae"), rounded(F.sqrt(F.avg(e * e)), 3).alias("rmse"), rounded(1 - ratio(F.avg(e * e), F.var_pop("l_extendedprice"))).alias("r2"))


@query()
def cross_validated_ridge(spark, sf_dir):
    """Ridge per fold, all metrics per fold and pooled (fold NULL)."""
    d = _t(spark, sf_dir, "lineitem").select(*_X, "l_extendedprice", folds.hashed(4, 5, "l_suppkey").alias("fold"))
    p = written(models.linear_cv(d, _X, "l_extendedprice", alpha=1.0).select("fold", "l_extendedprice", "predicted"), "predicted")  # predicted once for all metrics
    return metrics.with_pooled(p, lambda x, by: metrics.regression(x, "l_extendedprice", "predicted", by), "fold")


@query(f"""WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, {_hash_fold(5, 'l_suppkey', 4)} AS fold FROM lineitem), t AS (SELECT DISTINCT fold AS k FROM d),
  b AS (SELECT k, regr_sxy(y, x) / (regr_sxx(y, x) + 1e6) AS b, avg(y) - regr_sxy(y, x) / (regr_sxx(y, x) + 1e6) * avg(x) AS a FROM d JOIN t ON fold <> k GROUP BY k)
  SELECT fold, count(*) AS n, round(avg(abs(y - a - b * x)), 3) + 0.0 AS mae, round(sqrt(avg(power(y - a - b * x, 2))), 3) + 0.0 AS rmse, round(1 - avg(power(y - a - b * x, 2)) / var_pop(y), 6) + 0.0 AS r2 FROM d JOIN b ON k = fold GROUP BY fold""")
def cross_validated_ridge_of_one(spark, sf_dir):
    """Ridge with one predictor and a penalty that is felt."""
    d = _t(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", folds.hashed(4, 5, "l_suppkey").alias("fold"))
    p = written(models.linear_cv(d, ["l_quantity"], "l_extendedprice", alpha=1e6).select("fold", "l_extendedprice", "predicted"), "predicted")
    out = metrics.regression(p, "l_extendedprice", "predicted", ["fold"])
    return _round(_round(out.select("fold", "n", "mae", "rmse", "r2"), "mae", "rmse", digits=3), "r2")


def _features(spark, sf_dir) -> DataFrame:
    """One pooled vector per supplier with its balance as target."""
    pooled = pooling.pool(_t(spark, sf_dir, "lineitem"), ["l_suppkey"], LINE, ("mean", "std"))
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("y"))
    d = s.join(pooled, F.col("s_suppkey") == F.col("l_suppkey")).drop("l_suppkey").withColumn("fold", folds.hashed(3, 2, "s_suppkey"))
    parts = 1 + s.count() // kernels.BLOCK
    return written(d.repartition(parts, "s_suppkey"), "features")  # pooled once for all passes of the models, in as many parts as they have blocks


_POOLED = [f"{s}_{c}" for s in ("mean", "std") for c in LINE]


_POOLED_X = "(SELECT s_suppkey, s_acctbal AS y, avg(l_extendedprice) AS x FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2)"


@query(f"""WITH a AS (SELECT *, {_hash_fold(2, 's_suppkey', 3)} AS fold FROM {_POOLED_X}), s AS (SELECT fold AS f, coalesce(sum(count(*)) OVER (ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM a GROUP BY 1),
  d AS (SELECT x, y, fold, (first + row_number() OVER (PARTITION BY fold ORDER BY {_md5("'4'", 's_suppkey::varchar')}, s_suppkey) - 1) % 2 AS inner_fold FROM a JOIN s ON f = fold),
  g AS (SELECT DISTINCT fold AS k FROM d), l AS (SELECT alpha::double AS alpha FROM (VALUES (1), (10), (100), (1000)) t(alpha)), j AS (SELECT * FROM (VALUES (0), (1)) t(j)),
  t AS (SELECT k, j, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM d, g, j WHERE fold <> k AND inner_fold <> j GROUP BY k, j),
  e AS (SELECT t.k, t.j, alpha, sqrt(avg(power(y - my - sxy * n / sxx / (n + alpha) * (x - mx), 2))) AS rmse FROM t, l, d WHERE fold <> t.k AND inner_fold = t.j GROUP BY 1, 2, 3),
  c AS (SELECT k, arg_min(alpha, score) AS alpha, min(score) AS score FROM (SELECT k, alpha, avg(rmse) AS score FROM e GROUP BY 1, 2) GROUP BY k),
  o AS (SELECT k, count(*) AS n, avg(x) AS mx, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy FROM d, g WHERE fold <> k GROUP BY k)
  SELECT fold, alpha, round(any_value(score), 4) + 0.0 AS inner_rmse, count(*) AS n, round(sqrt(avg(power(y - my - sxy * o.n / sxx / (o.n + alpha) * (x - mx), 2))), 4) + 0.0 AS rmse FROM d JOIN c ON c.k = fold JOIN o ON o.k = fold GROUP BY fold, alpha""")
def nested_ridge(spark, sf_dir):
    """Ridge whose penalty is chosen on inner folds of each fold's training rows."""
    pooled = _t(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.avg("l_extendedprice").alias("x"))
    s = _t(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("y"), folds.hashed(3, 2, "s_suppkey").alias("fold"))
    d = s.join(pooled, F.col("s_suppkey") == F.col("l_suppkey")).drop("l_suppkey")
    p, chosen = nested.cross_validate(d, ["x"], "y", "ridge", inner=2, grid={"alpha": (1.0, 10.0, 100.0, 1000.0)}, ids=["s_suppkey"], seed=4)
    table = spark.createDataFrame([(c["fold"], c["settings"]["alpha"], c["score"]) for c in chosen], "_fold int, alpha double, inner_rmse double")
    e = F.col("y") - F.col("predicted")
    out = p.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse")).join(F.broadcast(table), F.col("fold") == F.col("_fold")).drop("_fold")
    return _round(out, "inner_rmse", "rmse", digits=4)


@query()
def cross_validated_kernels(spark, sf_dir):
    """Support vectors and a network on the feature table, trained for all folds in the same passes."""
    d, out = _features(spark, sf_dir), None
    for name in ("svr", "mlp"):
        p = metrics.regression(models.cross_validate(d, _POOLED, "y", name), "y", "predicted").withColumn("model", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


@query()
def cross_validated_forest(spark, sf_dir):
    return metrics.regression(models.cross_validate(_features(spark, sf_dir), _POOLED, "y", "random_forest", settings={"trees": 50, "depth": 10}), "y", "predicted")


def _labelled(spark, sf_dir) -> DataFrame:
    d = _t(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return _t(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", "quality", F.col("n_chars").cast("double").alias("score"), (F.col("n_chars") > 1000).cast("int").alias("called"))


_LABELLED = "(SELECT doc_id, quality, n_chars::double AS score, (n_chars > 1000)::int AS called FROM labels JOIN documents USING (doc_id))"


@query()
def cross_validated_logistic(spark, sf_dir):
    """Quality by length, a logistic regression per fold."""
    d = _labelled(spark, sf_dir).withColumn("x", F.ln("score")).withColumn("fold", folds.hashed(3, 1, "doc_id"))
    return metrics.classification(models.cross_validate(d.drop("score"), ["x"], "quality", "logistic", "classification"), "quality", "predicted", 1, "score_1")


@query()
def cross_validated_classifiers(spark, sf_dir):
    """AUC and Brier score of support vectors and of a logistic regression on the same folds: quality by length and by how the text is spread over lines."""
    d = _t(spark, sf_dir, "documents").select("doc_id", F.ln(F.length("text") + 1.0).alias("a"), F.ln(F.length("text") / F.size(F.split("text", "\n"))).alias("b")).where("text IS NOT NULL AND length(text) > 0")
    d = _t(spark, sf_dir, "labels").select("doc_id", "quality").join(d, "doc_id").withColumn("fold", folds.hashed(3, 1, "doc_id")).persist()
    out = None
    for name in ("svc", "logistic"):
        p = models.cross_validate(d, ["a", "b"], "quality", name, "classification", {"features": 100} if name == "svc" else None)
        brier = p.agg(F.avg(F.pow(F.col("score_1") - F.col("quality"), F.lit(2.0))).alias("brier"))
        row = metrics.classification(p, "quality", "predicted", 1, "score_1").select("n", "auc").join(brier).withColumn("model", F.lit(name))  # one row and one row
        out = row if out is None else out.unionByName(row)
    return out


@query(f"SELECT quality AS truth, count(*) FILTER (called = 0) AS as_0, count(*) FILTER (called = 1) AS as_1 FROM {_LABELLED} GROUP BY 1")
def confusion_matrix(spark, sf_dir):
    return metrics.confusion(_labelled(spark, sf_dir), "quality", "called", [0, 1])


_PER_CLASS = f"""(SELECT class, count(*) FILTER (quality = class AND called = class) AS hit, count(*) FILTER (quality = class) AS support, count(*) FILTER (called = class) AS called_n FROM {_LABELLED}, (VALUES (0), (1)) c(class) GROUP BY class)"""


@query(f"""SELECT class, round(coalesce(hit / nullif(support, 0), 0), 6) + 0.0 AS recall, round(coalesce(hit / nullif(called_n, 0), 0), 6) + 0.0 AS precision, round(coalesce(2 * hit / nullif(support + called_n, 0), 0), 6) + 0.0 AS f1, support FROM {_PER_CLASS}""")
def class_table(spark, sf_dir):
    return _round(metrics.per_class(_labelled(spark, sf_dir), "quality", "called"), "recall", "precision", "f1")


@query(f"""WITH k AS (SELECT avg(hit / support) AS uar, avg(coalesce(2 * hit / nullif(support + called_n, 0), 0)) AS macro_f1 FROM {_PER_CLASS} WHERE support > 0), a AS (SELECT count(*) AS n, avg((quality = called)::int) AS accuracy,
  avg((called = 1)::int) FILTER (quality = 1) AS sensitivity, avg((called = 0)::int) FILTER (quality = 0) AS specificity FROM {_LABELLED}),
  r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::double AS rk FROM {_LABELLED}),
  u AS (SELECT (sum(rk) FILTER (quality = 1) - sum(quality) * (sum(quality) + 1) / 2) / (sum(quality) * sum(1 - quality)) AS auc FROM r)
  SELECT n, round(accuracy, 6) + 0.0 AS accuracy, round(sensitivity, 6) + 0.0 AS sensitivity, round(specificity, 6) + 0.0 AS specificity, round(uar, 6) + 0.0 AS uar, round(macro_f1, 6) + 0.0 AS macro_f1, round(auc, 6) + 0.0 AS auc FROM k, a, u""")
def classification_metrics(spark, sf_dir):
    d = metrics.classification(_labelled(spark, sf_dir), "quality", "called", 1, "score")
    return _round(d, "accuracy", "sensitivity", "specificity", "uar", "macro_f1", "auc")


@query(f"""WITH s AS (SELECT score AS threshold, sum(quality) AS p, sum(1 - quality) AS n FROM {_LABELLED} GROUP BY 1)
  SELECT threshold, round(sum(n) OVER w / sum(n) OVER (), 6) + 0.0 AS fpr, round(sum(p) OVER w / sum(p) OVER (), 6) + 0.0 AS tpr FROM s WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT 1e12::double, 0.0::double, 0.0::double""")
def roc_curve(spark, sf_dir):
    return _round(metrics.roc_curve(_labelled(spark, sf_dir), F.col("quality") == 1, "score", cap=1e12), "fpr", "tpr")


def _settings(spark, sf_dir) -> DataFrame:
    """Errors of three trivial predictors of order prices over the same repeats and folds."""
    d = _t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    every = None
    for r in (1, 2):
        x = d.withColumn("fold", folds.hashed(3, r, "o_orderkey"))
        sums = x.groupBy("fold").agg(F.sum("o_totalprice").alias("s"), F.count(F.lit(1)).alias("n"))
        every_fold = Window.partitionBy()
        train = sums.select("fold", ((F.sum("s").over(every_fold) - F.col("s")) / (F.sum("n").over(every_fold) - F.col("n"))).alias("mean"), (F.sum("n").over(every_fold) - F.col("n")).alias("n_train"))
        e = x.join(F.broadcast(train), "fold").groupBy("fold", "n_train")  # one row a fold
        error = lambda shift: F.sqrt(F.avg(F.pow(F.col("o_totalprice") - F.col("mean") * F.lit(shift), F.lit(2.0))))
        rows = e.agg(F.count(F.lit(1)).alias("n_test"), F.array(*[F.struct(F.lit(c).alias("config_id"), error(s).alias("rmse")) for c, s in (("mean", 1.0), ("low", 0.9), ("high", 1.05))]).alias("m"))
        rows = rows.select(F.lit(r).alias("repeat"), "fold", "n_train", "n_test", F.explode("m").alias("m")).select("repeat", "fold", "n_train", "n_test", "m.config_id", "m.rmse")
        every = rows if every is None else every.unionByName(rows)
    return every


_ABLATION = f"""(WITH x AS (SELECT r::int AS repeat, o_totalprice AS y, CASE r WHEN 1 THEN {_hash_fold(1, 'o_orderkey', 3)} ELSE {_hash_fold(2, 'o_orderkey', 3)} END AS fold FROM orders, (VALUES (1), (2)) t(r)),
  s AS (SELECT repeat, fold, sum(y) AS s, count(*) AS n FROM x GROUP BY 1, 2),
  t AS (SELECT repeat, fold, (sum(s) OVER (PARTITION BY repeat) - s) / (sum(n) OVER (PARTITION BY repeat) - n) AS mean, (sum(n) OVER (PARTITION BY repeat) - n)::bigint AS n_train FROM s)
  SELECT config_id, repeat, fold, any_value(n_train) AS n_train, count(*) AS n_test, sqrt(avg(power(y - mean * f, 2))) AS rmse FROM x JOIN t USING (repeat, fold), (VALUES ('mean', 1.0::double), ('low', 0.9::double), ('high', 1.05::double)) c(config_id, f) GROUP BY 1, 2, 3)"""


@query(f"""SELECT config_id, round(avg(rmse), 4) + 0.0 AS rmse_mean, round(stddev_samp(rmse), 4) + 0.0 AS rmse_std, (rank() OVER (ORDER BY avg(rmse)))::int AS rank FROM {_ABLATION} GROUP BY config_id""")
def ablation_summary(spark, sf_dir):
    return _round(ablation.summarize(_settings(spark, sf_dir), "rmse"), "rmse_mean", "rmse_std", digits=4)


@query(f"""WITH d AS (SELECT o.config_id, o.rmse - b.rmse AS d, o.n_test / o.n_train AS rho FROM {_ABLATION} o JOIN {_ABLATION} b ON b.repeat = o.repeat AND b.fold = o.fold AND b.config_id = 'mean' WHERE o.config_id <> 'mean')
  SELECT config_id, count(*) AS j, round(avg(d), 4) + 0.0 AS mean_diff, round(avg(d) / sqrt((1.0::double / count(*) + avg(rho)) * var_samp(d)), 4) + 0.0 AS t, avg(d) < 0 AS better FROM d GROUP BY config_id""")
def baseline_comparison(spark, sf_dir):
    d = ablation.compare_to_baseline(_settings(spark, sf_dir), "rmse", "mean")
    return _round(d.select("config_id", "j", "mean_diff", "t", "better"), "mean_diff", "t", digits=4)


@query(f"""WITH d AS (SELECT o.config_id, o.rmse - b.rmse AS d FROM {_ABLATION} o JOIN {_ABLATION} b ON b.repeat = o.repeat AND b.fold = o.fold AND b.config_id = 'mean' WHERE o.config_id <> 'mean' AND o.rmse <> b.rmse),
  r AS (SELECT config_id, d, rank() OVER (PARTITION BY config_id ORDER BY abs(d)) + (count(*) OVER (PARTITION BY config_id, abs(d)) - 1) / 2.0::double AS r FROM d)
  SELECT config_id, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0.0::double) AS w_plus FROM r GROUP BY config_id""")
def wilcoxon_statistic(spark, sf_dir):
    d = _settings(spark, sf_dir)
    base = d.where("config_id = 'mean'").select("repeat", "fold", F.col("rmse").alias("base"))
    d = d.where("config_id <> 'mean'").join(base, ["repeat", "fold"]).withColumn("diff", F.col("rmse") - F.col("base"))
    return ablation.wilcoxon_w(d, "diff", ["config_id"])


# Subsets of the ranks 1 to k by their sum; the normal tail by its series of odd powers.
_SIGNED = """ways(k, w) AS (SELECT 0, list_transform(range(0, 638), lambda i: CASE WHEN i = 0 THEN 1.0::double ELSE 0.0::double END)
    UNION ALL SELECT k + 1, list_transform(range(0, 638), lambda i: w[i + 1] + CASE WHEN i > k THEN w[i - k] ELSE 0.0::double END) FROM ways WHERE k < 50),
  t AS (SELECT family, abs(d) AS a, count(*) AS c, count(*) FILTER (d > 0) AS up FROM d WHERE d <> 0 GROUP BY 1, 2),
  r AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY family ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (c + 1) / 2.0::double AS r FROM t),
  s AS (SELECT family, sum(c)::bigint AS n, sum(up * r)::double AS w_plus, sum(c * c * c - c)::double AS ties FROM r GROUP BY 1),
  z AS (SELECT *, greatest(1e-12, abs(w_plus - n * (n + 1) / 4.0::double) / sqrt(n::double * (n + 1) * (2 * n + 1) / 24 - ties / 48)) AS z, least(w_plus, n * (n + 1) / 2.0::double - w_plus) AS least_w FROM s),
  p AS (SELECT family, n, w_plus, CASE WHEN n <= 50 AND ties = 0 THEN list_sum(list_slice(w, 1, floor(least_w)::int + 1)) / power(2.0::double, n)
    ELSE 0.5 - exp(-z * z / 2) / sqrt(2 * pi()) * list_sum(list_transform(range(0, 200), lambda j: exp((2 * j + 1) * ln(z) - lgamma(2 * j + 2) + j * ln(2) + lgamma(j + 1)))) END AS tail FROM z LEFT JOIN ways ON k = n)"""


@query(f"""WITH RECURSIVE c AS (SELECT c_nationkey, c_mktsegment, round(c_acctbal * 100)::bigint - 450000 AS d FROM customer),
  d AS (SELECT c_nationkey::varchar AS family, d FROM c UNION ALL SELECT c_nationkey || ' ' || c_mktsegment, d FROM c UNION ALL SELECT 'rounded ' || c_nationkey, floor(d / 100000.0::double)::bigint FROM c),
  {_SIGNED} SELECT f.family, coalesce(n, 0)::bigint AS n, coalesce(w_plus, 0.0::double) AS w_plus, round(coalesce(least(1.0::double, 2 * tail), 1.0::double), 6) + 0.0 AS p_value FROM (SELECT DISTINCT family FROM d) f LEFT JOIN p USING (family)""")
def signed_rank_tests(spark, sf_dir):
    """Balances against 4,500 by nation, by nation and segment (exact where untied and few), and in whole thousands (tied)."""
    c = _t(spark, sf_dir, "customer").select("c_nationkey", "c_mktsegment", (F.round(F.col("c_acctbal") * 100).cast("bigint") - 450000).alias("d"))
    nation = F.col("c_nationkey").cast("string")
    d = c.select(F.explode(F.array(F.struct(nation.alias("family"), F.col("d").alias("d")), F.struct(F.concat_ws(" ", nation, "c_mktsegment").alias("family"), F.col("d").alias("d")),
                                   F.struct(F.concat(F.lit("rounded "), nation).alias("family"), F.floor(F.col("d") / 100000).alias("d")))).alias("x")).select("x.*")
    return _round(ablation.signed_rank(d, "d", ["family"]), "p_value")


@query(f"""SELECT repeat, fold, round(any_value(rmse) FILTER (config_id = 'mean'), 4) + 0.0 AS mean, round(any_value(rmse) FILTER (config_id = 'low'), 4) + 0.0 AS low FROM {_ABLATION} GROUP BY 1, 2""")
def ablation_pivot(spark, sf_dir):
    d = _settings(spark, sf_dir).groupBy("repeat", "fold").pivot("config_id", ["mean", "low"]).avg("rmse")
    return _round(d, "mean", "low", digits=4)


@query("SELECT count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def index_missing(spark, sf_dir):
    return tables.missing_files(_t(spark, sf_dir, "documents").select("doc_id"), _t(spark, sf_dir, "labels"), "doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def index_duplicates(spark, sf_dir):
    return tables.duplicates(_t(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


_IDS = "(SELECT CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '/' || c_custkey ELSE c_custkey::varchar END AS id FROM customer)"


@query(f"""WITH f AS (SELECT c_mktsegment || '/' || c_custkey || '.wav' AS path, c_mktsegment || '/' || c_custkey AS rel, c_custkey::varchar AS stem FROM customer), s AS (SELECT stem, min(path) AS path, count(*) AS n FROM f GROUP BY stem)
  SELECT id, coalesce(f.path, CASE WHEN s.n = 1 THEN s.path END) AS path, CASE WHEN coalesce(f.path, CASE WHEN s.n = 1 THEN s.path END) IS NOT NULL THEN 'matched' WHEN s.n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status
  FROM {_IDS} i LEFT JOIN f ON f.rel = id LEFT JOIN s ON s.stem = id""")
def index_match(spark, sf_dir):
    """An id of every customer, its file's relative path or its stem, matched by the path first."""
    c = _t(spark, sf_dir, "customer")
    files = c.select(F.concat("c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string"), F.lit(".wav")).alias("path"))
    rel = F.concat("c_mktsegment", F.lit("/"), F.col("c_custkey").cast("string"))
    ids = c.select(F.when(F.col("c_custkey") % 2 == 0, rel).otherwise(F.col("c_custkey").cast("string")).alias("id"))
    return tables.match_ids(ids, files)


@query("SELECT count(*) AS n, count(v) AS numeric_n, round(sum(v), 2) + 0.0 AS total FROM (SELECT try_cast(json_extract_string(props, '$.k') AS double) AS v FROM events)")
def numeric_coercion(spark, sf_dir):
    d = _t(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("k")).select(tables.numeric("k").alias("v"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("numeric_n"), rounded(F.sum("v"), 2).alias("total"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice >= 150000 THEN 'high' ELSE 'low' END AS label FROM orders")
def label_threshold(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") >= 150000, "high").otherwise("low").alias("label"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def value_counts(spark, sf_dir):
    return _t(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query("""SELECT event_id, round(CASE WHEN p < 0.4 THEN 0.5 * (1 - cos(pi() * p / 0.4)) WHEN p < 0.56 THEN cos(pi() / 2 * (p - 0.4) / 0.16) ELSE 0 END, 6) + 0.0 AS pulse FROM (SELECT event_id, (event_id % 100) / 100.0::double AS p FROM events)""")
def glottal_pulse(spark, sf_dir):
    d = _t(spark, sf_dir, "events").select("event_id", ((F.col("event_id") % 100) / 100.0).alias("p"))
    return d.select("event_id", rounded(audio.rosenberg_pulse(F.col("p"))).alias("pulse"))


@query("""WITH w AS (SELECT ts, value, event_type, to_timestamp(floor(epoch(ts) / 43200) * 43200 - h * 43200) AT TIME ZONE 'UTC' AS s FROM events, (VALUES (0), (1)) x(h))
  SELECT s AS window_start, event_type, count(*) AS n, round(avg(value), 6) + 0.0 AS mean_value, round(stddev_pop(value), 6) + 0.0 AS std_value FROM w GROUP BY 1, 2""")
def sliding_windows(spark, sf_dir):
    """A day's frame every half day: the same function pools a stream."""
    d = windows.pooled_windows(_t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["value"], "1 day", "12 hours", keys=["event_type"], statistics=("mean", "std"))
    d = _round(d.drop("window_end"), "mean_value", "std_value")
    return d.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


_U, _LN = "(1 / sqrt(n::double))", "ln(n::double)"
_FEW_TAIL = _normal_tail(f"((-ln(0.459 * n - 2.273 - ln(1 - w)) - {_horner(diagnostics._FEW_MEAN, 'n')}) / exp({_horner(diagnostics._FEW_LOG_SD, 'n')}))")
_MANY_TAIL = _normal_tail(f"((ln(1 - w) - {_horner(diagnostics._MANY_MEAN, _LN)}) / exp({_horner(diagnostics._MANY_LOG_SD, _LN)}))")


@query(f"""WITH v AS (SELECT user_id, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS i, count(*) OVER (PARTITION BY user_id) AS n, value - avg(value) OVER (PARTITION BY user_id) AS e FROM events WHERE value IS NOT NULL),
  q AS (SELECT *, (i - 0.375::double) / (n + 0.25::double) AS p FROM v), z AS (SELECT *, {_normal_quantile('p')} AS s FROM q),
  a AS (SELECT user_id, any_value(n) AS n, sum(s * s) AS mm, sum(e * e) AS ss, max(s) FILTER (i = n) AS s1, max(s) FILTER (i = n - 1) AS s2, coalesce(sum(s * e) FILTER (i > 1 AND i < n), 0) AS inner_, coalesce(sum(s * e) FILTER (i > 2 AND i < n - 1), 0) AS inmost,
    max(e) FILTER (i = 1) AS e1, max(e) FILTER (i = 2) AS e2, max(e) FILTER (i = n - 1) AS f2, max(e) FILTER (i = n) AS f1 FROM z GROUP BY user_id),
  t AS (SELECT *, s1 / sqrt(mm) + {_horner(diagnostics._TOP, _U)} AS top, s2 / sqrt(mm) + {_horner(diagnostics._SECOND, _U)} AS second FROM a),
  b AS (SELECT *, CASE WHEN n = 3 THEN sqrt(0.5::double) * (f1 - e1) WHEN n <= 5 THEN top * (f1 - e1) + inner_ / sqrt((mm - 2 * s1 * s1) / (1 - 2 * top * top))
    ELSE top * (f1 - e1) + second * (f2 - e2) + inmost / sqrt((mm - 2 * s1 * s1 - 2 * s2 * s2) / (1 - 2 * top * top - 2 * second * second)) END AS b FROM t),
  w AS (SELECT user_id, n, CASE WHEN n >= 3 AND ss > 0 THEN least(1, b * b / ss) END AS w FROM b)
  SELECT user_id, n, round(w, 7) + 0.0 AS w, round(CASE WHEN w IS NULL THEN NULL WHEN n = 3 THEN greatest(0, 6 / pi() * (asin(sqrt(w)) - asin(sqrt(0.75::double)))) WHEN w >= 1 THEN 1 WHEN n <= 11 AND ln(1 - w) >= 0.459 * n - 2.273 THEN 0
    WHEN n <= 11 THEN {_FEW_TAIL} ELSE {_MANY_TAIL} END, 7) + 0.0 AS p_value FROM w""")
def shapiro_wilk_by_user(spark, sf_dir):
    """W and p of every user's values, whatever their number."""
    return _round(diagnostics.shapiro_wilk_table(_t(spark, sf_dir, "events").select("user_id", "event_id", "value"), "value", ["user_id"], ["event_id"]), "w", "p_value", digits=7)


@query(f"""WITH {_LINE_OF_ORDERS}, q AS (SELECT *, (row_number() OVER (ORDER BY e, o_orderkey) - 0.375::double) / (n + 0.25::double) AS p FROM r)
  SELECT o_orderkey, round(y, 2) + 0.0 AS observed, round(y - e, 2) + 0.0 AS fitted, round(e, 2) + 0.0 AS residual, round(e / sqrt(s2 * (1 - h)), 5) + 0.0 AS studentized, round(h * 1e4, 5) + 0.0 AS leverage_e4,
    round(e * e / (2 * s2) * h / power(1 - h, 2) * 1e4, 4) + 0.0 AS cooks_e4, round({_normal_quantile('p')}, 6) + 0.0 AS normal_quantile FROM q""")
def influence_of_orders(spark, sf_dir):
    """The influence table of a line through orders, with the normal scores of the residuals' ranks."""
    d = _pairs(spark, sf_dir).drop("o_custkey")
    d = diagnostics.influence_table(d, linear.fit_ols(d, ["a"], "b"), "b", ["o_orderkey"])
    d = d.withColumns({"leverage_e4": F.col("leverage") * 1e4, "cooks_e4": F.col("cooks") * 1e4}).drop("leverage", "cooks")
    return _round(_round(_round(_round(d, "observed", "fitted", "residual", digits=2), "studentized", "leverage_e4", digits=5), "cooks_e4", digits=4), "normal_quantile")


@query("""SELECT o_orderpriority FROM (SELECT o_orderpriority, min(o_orderkey) AS k FROM orders GROUP BY 1 ORDER BY k)""")
def first_appearances(spark, sf_dir):
    """Priorities in the order in which they first come up."""
    return tables.first_appearance(_t(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"])


@query("""SELECT run, n_nationkey, count(*) AS n FROM (SELECT 'customers' AS run, c_nationkey AS n_nationkey FROM customer UNION ALL SELECT 'suppliers', s_nationkey FROM supplier) GROUP BY 1, 2""")
def tagged_nations(spark, sf_dir):
    """Customers and suppliers under each other, counted by nation and table."""
    both = {"customers": _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n_nationkey")), "suppliers": _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))}
    return tables.tagged_union(both).groupBy("run", "n_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query()
def cepstral_features(spark, sf_dir):
    """Every embedding as a short recording: cepstral frames, pooled per recording."""
    d = _t(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("path"), F.lit(8000).alias("sample_rate"), F.col("embedding").cast("array<double>").alias("signal"))
    f = audio.FrontEnd(frame_ms=2.0, hop_ms=1.0, mels=8, coefficients=5, lifter=0)
    names = audio.frame_columns(f)
    wide = audio.cepstral_frames(d, f).select("path", *[F.get("v", k).alias(c) for k, c in enumerate(names)])
    return pooling.pool(wide, ["path"], names, ("mean", "std"))
