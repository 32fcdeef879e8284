"""Operator 5: Order MinHash fingerprints (DataFrame functions only).

A text's k-mers are runs of two words, numbered by occurrence so that repeats count. Each numbered k-mer has one hash,
whose first bits name a cell; in every cell the minimal k-mers are selected, put back into text order and hashed as a
tuple; a cell with too few borrows from the next cells that have some, around the end, so that short texts show their
order too. Two texts agree in a cell if the same k-mers are minimal there and stand in the same order, so the share of
agreeing cells falls with the edit distance, and texts of the same k-mers in another order are told apart.

Null texts count as empty; a text without words has an empty fingerprint, and two empty fingerprints have likeness 1.
Rows repeated with the same id and text share one place in the order of documents, so every copy has the same next
document; rows of one id with different texts follow each other by a hash of the text, and null ids come first. A lone
document is its own next. Positions count modulo 2**24 words; texts are taken whole at any length. An empty table gives an
empty result. Columns other than the id and the text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stash, words

#: Cells of a fingerprint (a power of two), and k-mers of a tuple.
CELL_BITS, TUPLE = 6, 2
_LOW = (1 << 24) - 1
_TUPLE_BITS = 39


def _packed(high: Column, low: Column) -> Column:
    return high.bitwiseAND(F.lit(~_LOW)).bitwiseOR(low)


def sketch(d: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out``: one number per cell that has k-mers, in cell order; cells are the numbers' first bits."""
    c = F.col
    at = lambda name, j: F.get(c(name), j)
    cell = lambda x: F.shiftrightunsigned(x, 64 - CELL_BITS)
    d = d.withColumn("_w", words(c(text))).withColumn("_u", F.transform("_w", lambda x: F.xxhash64(x)))
    pairs = F.transform("_u", lambda h, i: _packed(F.xxhash64(h, at("_u", i + 1)), i.cast("long").bitwiseAND(F.lit(_LOW))))
    d = d.withColumn("_s", F.sort_array(pairs))
    same = lambda x, j: F.coalesce(F.shiftrightunsigned(x.bitwiseXOR(at("_s", j)), 24) == 0, F.lit(False))

    def occurrence(x: Column, j: Column) -> Column:
        """How many equal k-mers stand before: equal ones are neighbours after the sort, so a bisection finds the first."""
        steps = F.array(*[F.lit(1 << k) for k in range(23, -1, -1)])
        far = F.aggregate(steps, F.lit(0), lambda a, p: F.when(same(x, j - a - p), a + p).otherwise(a))
        return F.when(~same(x, j - 1), 0).when(~same(x, j - 2), 1).when(~same(x, j - 3), 2).otherwise(far)

    numbered = F.transform("_s", lambda x, j: _packed(F.xxhash64(F.shiftright(x, 24), occurrence(x, j)), x.bitwiseAND(F.lit(_LOW))))
    d = d.withColumn("_v", F.sort_array(numbered))
    d = d.withColumn("_m", F.filter("_v", lambda x, j: (j < TUPLE) | (cell(x) != cell(at("_v", j - TUPLE)))))

    def of_cell(x: Column, j: Column) -> Column:
        """The tuple that starts with the cell's least k-mer; null for its other members."""
        members = F.slice(c("_ring"), j + 1, TUPLE)  # of the cell first; what it lacks is the least of the next cells
        ordered = F.sort_array(F.transform(members, lambda y: F.shiftleft(y.bitwiseAND(F.lit(_LOW)), _TUPLE_BITS).bitwiseOR(F.shiftrightunsigned(y, 64 - _TUPLE_BITS))))
        value = F.xxhash64(F.transform(ordered, lambda z: z.bitwiseAND(F.lit((1 << _TUPLE_BITS) - 1))))
        first = F.coalesce(cell(at("_m", j - 1)) != cell(x), F.lit(True))
        return F.when(first, F.shiftleft(cell(x), 56).bitwiseOR(F.shiftrightunsigned(value, 8)))

    d = d.withColumn("_ring", F.concat("_m", F.slice("_m", 1, TUPLE - 1)))
    d = d.withColumn(out, F.filter(F.transform("_m", of_cell), lambda x: x.isNotNull()))
    return d.drop("_w", "_u", "_s", "_v", "_m", "_ring")


def as_text(numbers: Column) -> Column:
    """A fingerprint as text: 16 hexadecimal digits per cell."""
    return F.array_join(F.transform(numbers, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the cells with k-mers in either text whose tuples agree; 1 if neither text has words."""
    cells = lambda x: F.transform(x, lambda y: F.shiftrightunsigned(y, 56))
    union = F.size(F.array_union(cells(a), cells(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's id and the fingerprint of its text."""
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return sketch(d, "_text", "_f").select(id_col, as_text(F.col("_f")).alias("fingerprint"))


_KEY = ["kid", "knull", "khash"]


def following(docs: DataFrame) -> DataFrame:
    """For every different document its key, that of the one before it in id order (around the end) and a quarter of that one's length.

    Only keys are sorted: by range into parts, within the parts by a window, and across parts by their first rows.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(*_KEY, F.char_length("text").alias("n")).distinct()
    order = [F.col("knull").desc(), F.col("kid"), F.col("khash")]
    ids = stash(ids.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ids")
    key = F.struct(F.floor(F.col("n") / 4).cast("int").alias("need"), *[F.col(k).alias(f"p{k}") for k in _KEY])
    before = F.lag(key).over(Window.partitionBy("part").orderBy(*order))
    ends = ids.groupBy("part").agg(F.max_by(key, F.struct(~F.col("knull"), "kid", "khash")).alias("end"))  # one row a part
    ends = ends.select(F.lead("part").over(Window.orderBy("part")).alias("next_part"), F.first("part").over(Window.orderBy("part")).alias("first_part"), "end")
    ends = ends.select(F.coalesce("next_part", "first_part").alias("of_part"), "end")
    rows = ids.withColumn("before", before).join(ends, (F.col("part") == F.col("of_part")) & F.col("before").isNull(), "left")
    return stash(rows.select(*_KEY, F.coalesce("before", "end").alias("b")).select(*_KEY, "b.*"), "following")


def with_edits(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its fingerprint, its edited text's, and their likenesses."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.coalesce("doc_id", F.lit(0)).cast("bigint").alias("kid"), F.col("doc_id").isNull().alias("knull"), F.xxhash64(text).alias("khash"), text.alias("text"))
    after = following(d)
    d = sketch(d, "text", "own")
    # Both uses of d need the same columns, so its texts are shuffled once.
    pieces = d.join(after, _KEY).select("pkid", "pknull", "pkhash", F.expr("left(text, need)").alias("piece"), F.col("own").alias("next"))
    pieces = pieces.groupBy("pkid", "pknull", "pkhash").agg(F.first("piece").alias("piece"), F.first("next").alias("next"))
    on = [F.col(k) == F.col(f"p{k}") for k in _KEY]
    rows = d.join(pieces, on).withColumn("n_chars", F.char_length("text").cast("long"))
    edited = F.concat(F.expr("left(text, cast(n_chars - floor(n_chars / 4) as int))"), F.col("piece"))
    rows = sketch(rows.withColumn("edited", edited), "edited", "changed")
    return rows.select(
        F.when(~F.col("knull"), F.col("kid")).alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("own")).alias("fingerprint"),
        as_text(F.col("changed")).alias("edited_fingerprint"), likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next")).alias("near_next"),
    )
