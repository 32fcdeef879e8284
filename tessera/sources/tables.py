"""Tables of recordings, ratings and analyses: reading, validation, and matching of ids to files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import DatasetError
from tessera.functions import halo, ranks

#: Values that a message lists before "and N more".
LISTED = 5


def listing(values: Sequence, total: int | None = None) -> str:
    total = len(values) if total is None else total
    shown = ", ".join(map(str, values[:LISTED]))
    return shown if total <= LISTED else f"{shown} and {total - LISTED} more"


def require(df: DataFrame, columns: Sequence[str]) -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise DatasetError(f"missing columns: {listing(missing)}; found {', '.join(df.columns)}")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; nothing is inferred."""
    return spark.read.option("header", True).csv(path)


#: Columns that say where a row stands in the files it was read from.
PLACE = ("_file", "_block", "_line")


def with_place(df: DataFrame) -> DataFrame:
    """Adds PLACE to a table read from files, by which its rows stand in the files' own order."""
    meta = df.select("_metadata").schema[0].dataType.names
    at = F.col("_metadata.row_index") if "row_index" in meta else F.monotonically_increasing_id()  # ascends within a block, which one task reads
    block = F.lit(0).cast("bigint") if "row_index" in meta else F.col("_metadata.file_block_start")
    return df.select("*", F.col("_metadata.file_path").alias(PLACE[0]), block.alias(PLACE[1]), at.alias(PLACE[2]))


def with_row_number(df: DataFrame, order: Sequence[str] = PLACE, out: str = "row", rows: int = halo.RANGE_ROWS) -> DataFrame:
    """Adds the number of each row in ``order``, from 0; rows are numbered in ranges."""
    d, _ = halo.in_ranges(df, list(order), rows)
    return ranks.numbered(d, list(order), [], F.col(halo.RANGE), out).drop(halo.RANGE)


def numeric(c: str) -> Column:
    """A column as double, NULL where it is no number."""
    return F.expr(f"try_cast(`{c}` AS double)")


def load_index(df: DataFrame, target: str, task: str = "regression") -> DataFrame:
    """path, target and group of an index; an error names the first rows without target, without number, or with a repeated path."""
    require(df, ["path", target])
    value = numeric(target) if task == "regression" else F.col(target).cast("string")
    group = F.coalesce(F.col("group").cast("string"), F.lit("")) if "group" in df.columns else F.lit("")
    out = df.select(F.col("path").cast("string").alias("path"), value.alias(target), group.alias("group"))
    bad = out.where(F.col(target).isNull()).select("path")
    if found := bad.limit(LISTED + 1).collect():
        raise DatasetError(f"no usable {target} for: {listing([r.path for r in found], bad.count())}")
    twice = out.groupBy("path").count().where("count > 1")
    if found := twice.limit(LISTED + 1).collect():
        raise DatasetError(f"repeated paths: {listing([r.path for r in found], twice.count())}")
    return out


def missing_files(index: DataFrame, files: DataFrame, key: str = "path") -> DataFrame:
    """Rows of the index whose file isn't in the listing."""
    return index.join(files.select(key), key, "left_anti")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def match_ids(ratings: DataFrame, files: DataFrame) -> DataFrame:
    """Each rating's file: by relative path without suffix, else by a stem that only one file has.

    status: matched, ambiguous (several files of that stem), or unmatched. Two equi-joins; a hot stem is reduced to its
    count before the join.
    """
    rel = F.regexp_replace("path", r"\.[^./]*$", "")
    f = files.select("path", rel.alias("rel"), F.regexp_extract(rel, r"([^/]*)$", 1).alias("stem"))
    by_rel = f.groupBy("rel").agg(F.min("path").alias("rel_path"))
    by_stem = f.groupBy("stem").agg(F.min("path").alias("stem_path"), F.count(F.lit(1)).alias("stem_n"))
    d = ratings.join(by_rel, F.col("id") == F.col("rel"), "left").join(by_stem, F.col("id") == F.col("stem"), "left")
    path = F.coalesce("rel_path", F.when(F.col("stem_n") == 1, F.col("stem_path")))
    status = F.when(path.isNotNull(), "matched").when(F.col("stem_n") > 1, "ambiguous").otherwise("unmatched")
    return d.select(*[F.col(c) for c in ratings.columns], path.alias("path"), status.alias("status"))


def check_matches(matched: DataFrame, files: DataFrame) -> DataFrame:
    """Files that no id claims; an error names ids that are unmatched, ambiguous or repeated, and files that several ids claim."""
    wrong = []
    for status in ("unmatched", "ambiguous"):
        d = matched.where(F.col("status") == status).select("id")
        if found := d.limit(LISTED + 1).collect():
            wrong.append(f"{status} ids: {listing([r.id for r in found], d.count())}")
    for column, what in (("id", "repeated ids"), ("path", "files claimed by several ids")):
        twice = matched.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        if found := twice.limit(LISTED + 1).collect():
            wrong.append(f"{what}: {listing([r[column] for r in found], twice.count())}")
    if wrong:
        raise DatasetError("; ".join(wrong))
    return files.select("path").join(matched.select("path"), "path", "left_anti")


def analysis_table(df: DataFrame, target: str, predictors: Sequence[str] | None = None, keep: Sequence[str] = ()) -> tuple[DataFrame, list[str]]:
    """Complete cases of the target and the predictors (by default every column that holds numbers only), with the columns of ``keep`` as they are."""
    require(df, [target, *(predictors or []), *keep])
    if predictors is None:
        others = [c for c in df.columns if c != target and c not in keep]
        bad = df.agg(*[F.count_if(F.col(f"`{c}`").isNotNull() & numeric(c).isNull()).alias(c) for c in others]).first()
        predictors = [c for c in others if not bad[c]]
    out = df.select(numeric(target).alias(target), *[numeric(c).alias(c) for c in predictors], *[c for c in keep if c not in predictors]).dropna(subset=[target, *predictors])
    if out.limit(3).count() < 3:
        raise DatasetError("fewer than three complete rows")
    return out, list(predictors)


CEMENT = T.StructType([T.StructField(c, T.DoubleType()) for c in ("x1", "x2", "x3", "x4", "heat")])
# Heat of hardening of thirteen cements by their four clinker compounds (Woods, Steinour and Starke, 1932).
_CEMENT_ROWS = [
    (7.0, 26.0, 6.0, 60.0, 78.5), (1.0, 29.0, 15.0, 52.0, 74.3), (11.0, 56.0, 8.0, 20.0, 104.3), (11.0, 31.0, 8.0, 47.0, 87.6), (7.0, 52.0, 6.0, 33.0, 95.9),
    (11.0, 55.0, 9.0, 22.0, 109.2), (3.0, 71.0, 17.0, 6.0, 102.7), (1.0, 31.0, 22.0, 44.0, 72.5), (2.0, 54.0, 18.0, 22.0, 93.1), (21.0, 47.0, 4.0, 26.0, 115.9),
    (1.0, 40.0, 23.0, 34.0, 83.8), (11.0, 66.0, 9.0, 12.0, 113.3), (10.0, 68.0, 8.0, 12.0, 109.4),
]


def cement(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_CEMENT_ROWS, CEMENT)


def _uniform(seed: int, k: int) -> Column:
    """A hashed number in (0, 1) per id: the same wherever it is computed."""
    return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 30)) + 0.5) / float(1 << 30)


def _normal(seed: int, k: int) -> Column:
    return F.sqrt(-2 * F.ln(_uniform(seed, k))) * F.cos(2 * F.pi() * _uniform(seed, k + 1))


#: Coefficients of the toy tables (intercept, linear, squared and product terms; by rising power; per share).
SURFACE, CURVE, SHARES = (5.0, 2.0, -1.5, -0.8, 0.3, 0.6), (1.0, -2.0, 0.0, 0.5), (50.0, 1.5, 0.6, 0.1, -0.2)


def quadratic_surface_table(spark: SparkSession, n: int = 30, noise: float = 1.0, seed: int = 0) -> DataFrame:
    """x1 and x2 in [-3, 3], and a quadratic surface over them with normal noise."""
    d = spark.range(n).select("id", (6 * _uniform(seed, 0) - 3).alias("x1"), (6 * _uniform(seed, 1) - 3).alias("x2"))
    terms = (F.lit(1.0), F.col("x1"), F.col("x2"), F.col("x1") * F.col("x1"), F.col("x2") * F.col("x2"), F.col("x1") * F.col("x2"))
    y = sum((b * t for b, t in zip(SURFACE, terms, strict=True)), F.lit(0.0)) + noise * _normal(seed, 2)
    return d.select("x1", "x2", y.alias("y"))


def polynomial_table(spark: SparkSession, n: int = 10, coefficients: Sequence[float] = CURVE, noise: float = 0.5, seed: int = 0) -> DataFrame:
    """Evenly spaced x of [-2, 2] and a polynomial (coefficients by rising power) with normal noise."""
    d = spark.range(n).select("id", (4 * F.col("id") / max(1, n - 1) - 2).alias("x"))
    y = sum((b * F.pow("x", F.lit(float(k))) for k, b in enumerate(coefficients)), F.lit(0.0)) + noise * _normal(seed, 0)
    return d.select("x", y.alias("y"))


def collinear_table(spark: SparkSession, n: int = 40, noise: float = 2.0, seed: int = 0) -> DataFrame:
    """Four shares that add up to between 98 and 100, and a response."""
    parts = [-F.ln(_uniform(seed, k)) for k in range(4)]
    total = sum(parts[1:], parts[0])
    size = 98 + 2 * _uniform(seed, 4)
    d = spark.range(n).select("id", *[(p / total * size).alias(f"p{k + 1}") for k, p in enumerate(parts)])
    y = sum((b * F.col(f"p{k + 1}") for k, b in enumerate(SHARES[1:])), F.lit(SHARES[0])) + noise * _normal(seed, 5)
    return d.select("p1", "p2", "p3", "p4", y.alias("y"))


def first_appearance(df: DataFrame, column: str, order: Sequence[str]) -> DataFrame:
    """Different values of a column in the order in which they first come up."""
    first = df.groupBy(column).agg(F.min(F.struct(*order)).alias("_first"))
    return first.orderBy("_first").select(column)


def tagged_union(tables: dict[str, DataFrame], tag: str = "run") -> DataFrame:
    """Tables of the same columns under each other, each row with its table's name."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
