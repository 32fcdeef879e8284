"""Operator 2: URL filters by rules and gradient-boosted trees on lexical features (DataFrame functions only).

Rules decide where they fit: a rule holds for its host and all subdomains if the path starts with the rule's, and the
longest wins. Every other URL is judged by gradient-boosted trees trained on labelled URLs (by default those that the
rules label): lengths, depth, digit ratio, entropy, parameter counts, and statistics of the host's suffixes and of the
path's first part (how common they are and how often blocked among all labelled URLs). Only the trees are fitted on a
bounded sample: different URLs, so many of each class, weighted to the shares of the classes. The statistics that they are
fitted with are crossed: those of a URL come from the other half (by hash) of all labelled URLs, so no label shows through
its own statistics; a URL to judge has those of all labelled ones.

A null URL, or one without ``://``, has an empty host and path, fits no rule and is judged by its features like any
other. Repeated URLs get equal verdicts. Without labelled URLs of both classes the verdict is the only class's, or allow.
URLs are taken whole, whatever their length; an empty table gives an empty result. Of columns named host, path, rule or
verdict the operator's stay; other names can't clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import lower_ascii, stash

#: (verdict, host, path) of the production filter.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Different labelled URLs, in hash order, on which the trees are fitted; each class has an equal part of them at most.
TRAIN_ROWS = 20_000
#: Keys of a statistic that are broadcast at most; beyond that the rows of a key are dealt to so many tasks.
BROADCAST_KEYS, SALTS = 200_000, 32
TREES, DEPTH = 20, 4
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "parameter_length", "labels", "hyphens",
    "top_known", "top_blocked", "site_known", "site_blocked", "head_known", "head_blocked",
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    url = F.coalesce(url, F.lit(""))
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return lower_ascii(F.regexp_extract(url, pattern, 1)), F.regexp_extract(url, pattern, 2)


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits; null if none does."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        chosen = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(chosen)
    return chosen


def lexical(d: DataFrame, url: str = "url") -> DataFrame:
    """Adds the features that a URL's text alone gives, and the three keys of its statistics."""
    text = F.coalesce(F.col(url), F.lit(""))
    count = lambda c, of: F.char_length(of) - F.char_length(F.replace(of, F.lit(c)))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    names = F.split("host", r"\.")
    n = F.char_length(text)
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.char_length(F.replace(text, c))) / n)
    d = d.withColumns({
        "url_length": n, "host_length": F.char_length("host"), "path_length": F.char_length("path"), "depth": count("/", F.col("path")),
        "digit_ratio": F.when(n > 0, 1 - F.char_length(F.regexp_replace(text, "[0-9]", "")) / n).otherwise(0.0),
        "entropy": F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0),
        "parameters": F.when(query == "", 0).otherwise(count("&", query) + 1), "parameter_length": F.char_length(query),
        "labels": F.size(names), "hyphens": count("-", text),
        "top": F.element_at(names, -1), "site": F.array_join(F.slice(names, F.greatest(F.size(names) - 1, F.lit(1)), 2), "."),
        "head": F.get(F.split("path", "/"), 1),
    })
    return d.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in ("top", "site", "head")})


_KEYS = ("top", "site", "head")


def statistics(labelled: DataFrame, times: int = 1) -> dict[str, DataFrame]:
    """For each kind of key how common every key is among all labelled rows (url, label, n), each counted so many times, and how often it is blocked (smoothed)."""
    found = {}
    for key in _KEYS:
        s = labelled.groupBy(F.col(key).alias(f"_{key}")).agg((times * F.sum("n")).alias("_n"), (times * F.sum(F.col("label") * F.col("n"))).alias("_b"))
        found[key] = stash(s.select(f"_{key}", F.ln(F.col("_n") + 1).alias(f"{key}_known"), ((F.col("_b") + 2) / (F.col("_n") + 4)).alias(f"{key}_blocked")), f"urls-{key}")
    return found


def _with_statistics(d: DataFrame, found: dict[str, DataFrame]) -> DataFrame:
    """Adds the statistics of the three keys."""
    for key, s in found.items():
        same = F.col(key) == F.col(f"_{key}")
        if s.count() <= BROADCAST_KEYS:
            d = d.join(F.broadcast(s), same, "left").drop(f"_{key}")
        else:  # the rows of a common key go to several tasks
            s = s.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
            d = d.withColumn("_deal", F.monotonically_increasing_id() % SALTS).join(s, same & (F.col("_deal") == F.col("_salt")), "left").drop(f"_{key}", "_deal", "_salt")
    blanks = {f"{k}_known": F.coalesce(F.col(f"{k}_known"), F.lit(0.0)) for k in _KEYS}
    return d.withColumns(blanks | {f"{k}_blocked": F.coalesce(F.col(f"{k}_blocked"), F.lit(0.5)) for k in _KEYS})


def train(urls: DataFrame, bound: int = TRAIN_ROWS) -> tuple[dict[str, DataFrame] | None, object]:
    """Learn from URLs (url, label 1: block): statistics of all labelled rows and the fitted trees, or None and the only verdict."""
    labelled = urls.where("label IS NOT NULL").groupBy("url", "label").agg(F.count(F.lit(1)).alias("n"))
    labelled = stash(labelled, "urls")
    sizes = {r.label: r.n for r in labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return None, "block" if set(sizes) == {1} else "allow"
    host, path = parts(F.col("url"))
    labelled = lexical(labelled.withColumn("host", host).withColumn("path", path))
    found, part = statistics(labelled), max(1, bound // len(sizes))
    sample = None
    for label, n in sorted(sizes.items()):
        some = labelled.where(F.col("label") == label).orderBy(F.xxhash64("url"), "url").limit(part).withColumn("weight", F.lit(n / min(n, part)))
        sample = some if sample is None else sample.unionByName(some)
    sample, second = stash(sample, "urls-sample"), F.pmod(F.xxhash64("url", F.lit(1)), F.lit(2)) == 1
    crossed = [_with_statistics(sample.where(own), statistics(labelled.where(~own), 2)) for own in (second, ~second)]
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(crossed[0].unionByName(crossed[1]))
    ready = ready.select("features", F.col("label").cast("double").alias("label"), "weight").repartition(4)
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, maxBins=64, seed=7, weightCol="weight").fit(ready)
    return found, trees


def judge(pages: DataFrame, model: tuple, rules: Sequence[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to every row."""
    found, trees = model
    names = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    d = pages.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.col(f"`{url}`").alias("_url"))
    d = d.withColumn("host", parts(F.col("_url"))[0]).withColumn("path", parts(F.col("_url"))[1])
    d = d.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    method = F.lit(trees if found is None else None).cast("string")
    if found is not None:
        d = _with_statistics(lexical(d, "_url"), found)
        d = trees.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(d))
        method = F.when(F.col("prediction") > 0.5, "block").otherwise("allow")
    return d.select(*[F.col(f"_row.`{c}`").alias(c) for c in names], "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", method).alias("verdict"))


def url_filters(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, labels: DataFrame | None = None) -> DataFrame:
    """Judge every URL of ``pages``; ``labels`` (url, label) defaults to the URLs that the rules label."""
    if labels is None:
        host, path = parts(F.col("url"))
        verdict = rule_for(host, path, rules)["verdict"]
        labels = pages.select("url", F.when(verdict == "block", 1).when(verdict == "allow", 0).alias("label"))
    return judge(pages, train(labels), rules)
