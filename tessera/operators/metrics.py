"""Regression and classification metrics as grouped aggregates; undefined ones are NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranks import before, numeric_range
from tessera.functions.stats import concordance, pearson, ratio
from tessera.operators.association import rank_correlation

#: Metrics of each task in report order, the one that stands for the rest, and those of which less is better.
METRICS = {"regression": ("mae", "rmse", "r2", "r", "rho", "ccc"), "classification": ("uar", "accuracy", "macro_f1", "sensitivity", "specificity", "auc")}
HEADLINE = {"regression": "rmse", "classification": "uar"}
LOWER_IS_BETTER = frozenset({"mae", "rmse"})


def regression(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: n, MAE, RMSE, R2, Pearson's r, Spearman's rho, concordance."""
    by = list(by)
    d = df.select(*by, F.col(truth).cast("double").alias("_t"), F.col(predicted).cast("double").alias("_p"))
    e, n = F.col("_t") - F.col("_p"), F.count(F.lit(1))
    out = d.groupBy(*by).agg(
        n.alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - ratio(F.avg(e * e), F.var_pop("_t"))).alias("r2"),
        pearson("_t", "_p").alias("r"), F.when(n >= 3, concordance("_t", "_p")).alias("ccc"),
    )
    rho = rank_correlation(d, "_t", "_p", by).drop("n")
    out = out.join(rho, by) if by else out.join(rho)  # one row and one row
    return out.select(*by, "n", "mae", "rmse", "r2", "r", "rho", "ccc")


def with_pooled(df: DataFrame, metric, by: str) -> DataFrame:
    """A metric per group and over all rows together (group NULL)."""
    pooled = metric(df, [])
    return metric(df, [by]).unionByName(pooled.withColumn(by, F.lit(None).cast(df.schema[by].dataType)))


def confusion(df: DataFrame, truth: str, predicted: str, classes: Sequence) -> DataFrame:
    """Counts by truth (rows) and prediction (columns ``as_<class>``)."""
    counts = [F.count_if(F.col(predicted) == F.lit(c)).alias(f"as_{c}") for c in classes]
    return df.groupBy(F.col(truth).alias("truth")).agg(*counts)


def per_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Recall, precision, F1 and support of every class of either side; 0 where a denominator is 0."""
    cells = df.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    side = lambda c, of: cells.select(F.col(of).alias("class"), *[(F.col("n") if k == c else F.lit(0)).alias(k) for k in ("support", "called")], F.lit(0).alias("hit"))
    hits = cells.where("t = p").select(F.col("t").alias("class"), F.lit(0).alias("support"), F.lit(0).alias("called"), F.col("n").alias("hit"))
    d = side("support", "t").unionByName(side("called", "p")).unionByName(hits).groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "called", "hit")])
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    recall, precision = zero(ratio("hit", "support")), zero(ratio("hit", "called"))
    return d.select("class", recall.alias("recall"), precision.alias("precision"), zero(ratio(2 * F.col("hit"), F.col("support") + F.col("called"))).alias("f1"), F.col("support").cast("bigint").alias("support"))


def classification(df: DataFrame, truth: str, predicted: str, positive=None, score: str | None = None) -> DataFrame:
    """One row: n, accuracy, UAR (classes present in truth), macro F1 (classes of either side), and for two classes sensitivity, specificity, AUC.

    With more than two classes sensitivity, specificity and AUC are NULL; with one class only its own recall is defined.
    """
    table = per_class(df, truth, predicted)
    out = table.agg(F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("uar"), F.avg("f1").alias("macro_f1"), F.count_if(F.col("support") > 0).alias("_classes"))
    right, is_pos = (F.col(truth) == F.col(predicted)).cast("double"), F.col(truth) == F.lit(positive)
    more: list[Column] = [F.count(F.lit(1)).alias("n"), F.avg(right).alias("accuracy")]
    if positive is not None:
        more += [F.avg(F.when(is_pos, right)).alias("sensitivity"), F.avg(F.when(~is_pos, right)).alias("specificity")]
    out = df.agg(*more).join(out)  # one row and one row
    if score:
        out = out.join(auc(df, is_pos, score))
    two = [c for c in ("sensitivity", "specificity", "auc") if c in out.columns]
    return out.withColumns({c: F.when(F.col("_classes") <= 2, F.col(c)) for c in two}).drop("_classes")


def _by_score(df: DataFrame, positive: Column, score: str, by: Sequence[str]) -> DataFrame:
    """Per different score: positive and negative rows."""
    return df.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(F.sum(positive.cast("long")).alias("_p"), F.sum((~positive).cast("long")).alias("_n"))


def auc(df: DataFrame, positive: Column, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve: pairs of a positive and a negative row that the score orders, ties half; NULL unless both classes are there."""
    by = list(by)
    steps = _by_score(df, positive, score, by)
    steps = before(steps, "_n", ["threshold"], by, numeric_range(steps, "threshold"), "_below")
    pairs = F.sum(F.col("_p") * (F.col("_below") + F.col("_n") / 2))
    return steps.groupBy(*by).agg(ratio(pairs, F.sum("_p") * F.sum("_n")).alias("auc"))


def roc_curve(df: DataFrame, positive: Column, score: str, cap: float | None = None) -> DataFrame:
    """False and true positive rates from (0, 0) on, at every different score, highest first. The start's threshold is infinite, or ``cap``."""
    steps = _by_score(df, positive, score, []).withColumn("_down", -F.col("threshold"))
    steps = before(before(steps, "_n", ["_down"], [], numeric_range(steps, "_down"), "_fp"), "_p", ["_down"], [], numeric_range(steps, "_down"), "_tp")
    every = steps.agg(F.sum("_p").alias("_all_p"), F.sum("_n").alias("_all_n"))
    rates = steps.join(F.broadcast(every)).select("threshold", ratio(F.col("_fp") + F.col("_n"), "_all_n").alias("fpr"), ratio(F.col("_tp") + F.col("_p"), "_all_p").alias("tpr"))  # one row
    start = df.sparkSession.createDataFrame([(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    out = start.unionByName(rates)
    return out if cap is None else out.withColumn("threshold", F.least("threshold", F.lit(cap)))


def class_scores(df: DataFrame, scores: str, model_classes: Sequence, classes: Sequence) -> DataFrame:
    """Adds score_<class> for every class from an array of a model's scores; 0 for classes that the model hasn't seen."""
    at = {c: i for i, c in enumerate(model_classes)}
    return df.withColumns({f"score_{c}": F.coalesce(F.get(scores, F.lit(at[c])), F.lit(0.0)) if c in at else F.lit(0.0) for c in classes})


def summarize(df: DataFrame, metrics: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Mean and sample deviation over folds of the defined values, rounded to 12 digits."""
    made = [F.bround(f(m), 12).alias(f"{m}_{k}") for m in metrics for k, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return df.groupBy(*by).agg(*made)
