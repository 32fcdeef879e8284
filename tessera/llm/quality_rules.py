"""Operator 4: quality rules by hashed n-gram log-likelihood ratios (DataFrame functions only).

Two multinomials over hashed unigrams and bigrams are estimated in one pass over the corpus: the raw corpus (every
document) and the trusted target (all documents labelled good). A document's score is its mean log ratio of the two per
n-gram; it is kept if the base rules pass and the score reaches the threshold, so equal texts always get equal
verdicts. The threshold follows from the target: each of its documents is scored by the ratios that the other half of the
target gives, and a small share of these scores may lie below. The base rules ask for at least 50 words and for at most
half of the words in repeated 3-word windows.

Null and empty texts have no words: they fail the base rules and score 0. Texts are judged whole, whatever their length.
Rows are judged one by one, so repeated rows are kept or dropped together; a null doc_id is never a target. Without a
target all scores are 0 and the base rules alone decide. An empty table gives an empty result. Columns other than the id
and the text stay, but for those that have the name of one of the operator's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.quantiles import percentiles
from tessera.llm.common import SPACE, stash, words

#: Buckets of the hashed n-grams; both multinomials have this many cells whatever the corpus size.
BUCKETS = 1 << 17
#: Rows of the trusted target that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Share of the trusted target whose scores, by ratios of its other half, lie below the threshold.
BELOW = 0.01
#: Part of the target in the smoothed target multinomial; the rest is the raw one, so unseen n-grams cost a fixed ratio.
OWN = 0.5
LEAST_WORDS = 50
SYMBOLS = "#*$%&|<>"
_LOW = (1 << 24) - 1


def _hashes(d: DataFrame) -> DataFrame:
    """Adds hashes of the words, and of each word with the next (the last word alone)."""
    d = d.withColumn("_u", F.transform("_w", lambda x: F.xxhash64(x)))
    return d.withColumn("_b", F.transform("_u", lambda h, i: F.xxhash64(h, F.get(F.col("_u"), i + 1))))


def target_ids(labels: DataFrame) -> DataFrame:
    """All ids labelled good, and the half of the target that each is in."""
    rows = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return rows.where("quality = 1").select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int").alias("half"))


def _marked(docs: DataFrame, targets: DataFrame, few: bool, id_col: str, text_col: str, how: str) -> DataFrame:
    """Words of documents and the half of the target that they are in."""
    marks = targets.select(F.col("doc_id").alias("_target"), F.col("half").alias("_half"))
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    d = d.join(F.broadcast(marks) if few else marks.hint("merge"), F.col("_id") == F.col("_target"), how)
    return _hashes(d.withColumn("_w", words(F.col("_text"))).drop("_text"))


@dataclass
class Model:
    """A written table of one row with the log ratios of all buckets (ratios), and the least score of a kept document."""

    table: DataFrame
    threshold: float


def _ratio(target: Column, t: int, n: int) -> Column:
    """Log ratio of the smoothed target to the raw multinomial for a bucket; 0 where nothing was counted or without a target."""
    if not t or not n:
        return F.lit(0.0).cast("float")
    own = F.coalesce(target, F.lit(0)) / F.lit(float(t)) / (F.col("n") / F.lit(float(n)))
    return F.coalesce(F.ln(F.lit(1 - OWN) + F.lit(OWN) * own), F.lit(0.0)).cast("float")


def _score(d: DataFrame, out: str, table: DataFrame, column: str = "ratios") -> DataFrame:
    """Adds the mean ratio of a row's n-grams, 0 without words. The table is a subquery's value: each task gets it once, and no plan holds it as text."""
    d = d.withColumn(f"_table_{out}", table.select(column).scalar())
    total = F.aggregate(F.concat("_u", "_b"), F.lit(0.0), lambda a, h: a + F.get(F.col(f"_table_{out}"), h.bitwiseAND(F.lit(BUCKETS - 1))))
    return d.withColumn(out, F.when(F.size("_w") > 0, total / (2 * F.size("_w"))).otherwise(0.0)).drop(f"_table_{out}")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", below: float = BELOW) -> Model:
    """Log ratios of all buckets, counted over all documents, and the threshold."""
    targets = stash(target_ids(labels), "targets")
    few = targets.count() <= BROADCAST_IDS
    d = _marked(docs, targets, few, id_col, text_col, "left")
    cells = d.select(F.coalesce("_half", F.lit(-1)).alias("t"), F.explode(F.concat("_u", "_b")).alias("h"))
    cells = cells.select("t", F.col("h").bitwiseAND(F.lit(BUCKETS - 1)).alias("b"))
    of = lambda half: F.sum((F.col("t") == half).cast("long"))
    counts = stash(cells.groupBy("b").agg(F.count(F.lit(1)).alias("n"), of(0).alias("t0"), of(1).alias("t1")), "buckets")  # BUCKETS rows at most
    n, t0, t1 = (x or 0 for x in counts.agg(F.sum("n"), F.sum("t0"), F.sum("t1")).first())
    every = docs.sparkSession.range(BUCKETS).join(counts, F.col("id") == F.col("b"), "left")
    rows = F.array_sort(F.collect_list(F.struct("id", _ratio(F.col("t0") + F.col("t1"), t0 + t1, n).alias("ratios"), _ratio(F.col("t0"), t0, n).alias("of_0"), _ratio(F.col("t1"), t1, n).alias("of_1"))))
    table = every.agg(rows.alias("r")).select("r.ratios", "r.of_0", "r.of_1")
    table = stash(table, "ratios")
    own = _marked(docs, targets, few, id_col, text_col, "inner").where(F.size("_w") >= LEAST_WORDS)
    own = _score(_score(own, "by_0", table, "of_0"), "by_1", table, "of_1")
    crossed = F.when(F.col("_half") == 0, F.col("by_1")).otherwise(F.col("by_0"))
    scores = stash(own.select(F.lit(0).alias("all"), crossed.alias("s")), "scores")
    threshold = percentiles(scores, ["all"], ["s"], [100 * below], lambda c, q: "threshold").first()  # exact, and of bounded memory for a target of any size
    threshold = None if threshold is None else threshold.threshold
    return Model(table, 0.0 if threshold is None else min(0.0, threshold))


def _repeated(d: DataFrame) -> DataFrame:
    """Adds the number of words in 3-word windows that occur twice or more.

    Windows are first paired by 40 bits of their hash in one primitive sort; the few candidates are then compared as words.
    """
    w, n, c = F.col("_w"), F.col("n_words"), F.col
    none = F.array().cast("array<bigint>")
    windows = F.transform(F.slice("_b", 1, F.greatest(n - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get(c("_u"), i + 2)))
    d = d.withColumn("_h", windows).withColumn("_h", F.when(F.size(F.array_distinct("_h")) < F.size("_h"), c("_h")).otherwise(none))
    d = d.withColumn("_s", F.sort_array(F.transform("_h", lambda v, i: v.bitwiseAND(F.lit(~_LOW)).bitwiseOR(i.cast("long")))))
    pairs = F.filter(
        F.when(F.size("_s") > 1, F.sequence(F.lit(0), F.size("_s") - 2)).otherwise(F.array().cast("array<int>")),
        lambda j: F.shiftrightunsigned(F.get(c("_s"), j).bitwiseXOR(F.get(c("_s"), j + 1)), 24) == 0,
    )
    d = d.withColumn("_j", pairs).withColumn("_j", F.array_distinct(F.concat("_j", F.transform("_j", lambda j: j + 1))))
    sure = F.transform("_j", lambda j: F.get(c("_s"), j).bitwiseAND(F.lit(_LOW)).cast("int"))
    d = d.withColumn("_c", F.when(n > _LOW, F.sequence(F.lit(0), n - 3)).otherwise(sure))
    found = F.transform("_c", lambda p: F.struct(F.get(w, p).alias("a"), F.get(w, p + 1).alias("b"), F.get(w, p + 2).alias("c"), p.alias("p")))
    d = d.withColumn("_r", F.sort_array(found))
    same = lambda r, j: F.coalesce((r["a"] == F.get(c("_r"), j)["a"]) & (r["b"] == F.get(c("_r"), j)["b"]) & (r["c"] == F.get(c("_r"), j)["c"]), F.lit(False))
    d = d.withColumn("_p", F.sort_array(F.transform(F.filter("_r", lambda r, j: same(r, j - 1) | same(r, j + 1)), lambda r: r["p"])))
    gaps = F.transform("_p", lambda p, k: F.least(F.lit(3), F.coalesce(p - F.get(c("_p"), k - 1), F.lit(3))))
    return d.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x))


def _figures(d: DataFrame) -> DataFrame:
    """Adds the base figures to rows with an id and a text (_id, _text); hashes of words and pairs stay beside them."""
    text, plain = F.coalesce(F.col("_text"), F.lit("")), F.col("_joined")
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    d = d.withColumn("_w", words(F.col("_text"))).withColumn("n_words", F.size("_w")).withColumn("_joined", F.array_join("_w", ""))
    d = d.withColumn("word_chars", F.char_length("_joined").cast("long")).withColumn("n_symbols", (F.col("word_chars") - F.char_length(plain)).cast("long"))
    d = d.withColumn("_l", lines).withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    return _hashes(d)


def _failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def base(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The base figures and whether the base rules fail, of every row, without a model."""
    d = _repeated(_figures(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))))
    figures = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return d.select(F.col("_id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), *figures, _failed().alias("base_failed"))


def judge(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with the base figures, its score and the verdict; the other columns stay."""
    keep = [c for c in docs.columns if c not in (id_col, text_col)]
    d = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *[F.col(f"`{c}`").alias(f"_keep{i}") for i, c in enumerate(keep)])
    d, n = _figures(d), F.col("n_words")
    d = _score(d, "score", model.table)
    d = _repeated(d)
    # Verdicts refer to a row number, so that a filter on them stays above: pushed below, its expressions would be copied into each other.
    d = d.withColumn("_row", F.monotonically_increasing_id())
    here = F.col("_row") >= 0
    d = d.withColumn("score", F.when(here, F.col("score")))
    d = d.withColumn("base_failed", ~here | _failed())
    d = d.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= F.lit(model.threshold)))
    made = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score", "base_failed", "kept"]
    rest = [F.col(f"_keep{i}").alias(c) for i, c in enumerate(keep) if c not in ("n_words", *made)]  # a clashing column gives way
    return d.select(F.col("_id").alias(id_col), F.col("_text").alias(text_col), *rest, n.cast("long").alias("n_words"), *made)


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Judge every document by ratios and a threshold learned from the same documents and their labels."""
    return judge(docs.select("doc_id", "text"), fit(docs, labels))
