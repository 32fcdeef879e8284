"""Registered queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import conversation_repair, html_text, license_scans, log_bilinear, merkle, mixing, ngram_join, order_minhash, packing, piece_codec, quality_rules, toxicity, url_filters
from tessera.llm.common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole document, learned from three quarters of the labels."""
    out = toxicity.toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "toxic_spans")


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on the URL of every page."""
    return url_filters.url_filters(table(spark, sf_dir, "pages").select("page_id", "url"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often every document is in the mixture, its source's weight, and the place of every copy."""
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "copies", "weight", "places")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality verdict of every document."""
    out = quality_rules.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op5_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint of every document and of its edited text."""
    return order_minhash.with_edits(table(spark, sf_dir, "documents"))


def op6_log_bilinear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base and model log-probability of every document."""
    return log_bilinear.log_bilinear(table(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence matches of every document, the best one apart."""
    return license_scans.license_scans(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license", "dice", "line", "licenses")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 1024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.html_text(table(spark, sf_dir, "pages"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle count and near-copy class of every document."""
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the SentencePiece ids of every whole document and of the text that they decode to."""
    return piece_codec.piece_codec(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and digest of every damaged conversation."""
    return conversation_repair.conversation_repair(table(spark, sf_dir, "conversations"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots, proof and check of every document in the dataset's Merkle manifest."""
    return merkle.manifest(table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path and rule of the URL of every page: the rules' part of operator 2."""
    host, path = url_filters.parts(F.col("url"))
    d = table(spark, sf_dir, "pages").select("page_id", host.alias("host"), path.alias("path"))
    rule = url_filters.rule_for(F.col("host"), F.col("path"))
    return d.select("page_id", "host", "path", rule["rule"].alias("rule"), rule["verdict"].alias("verdict"))


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base figures and rules of operator 4 for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.base(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def mixing_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and documents of every source, as operator 3 counts them."""
    plan = mixing.plan(table(spark, sf_dir, "documents"))
    return plan.select(F.regexp_replace("key", "^s:", "").alias("source"), "n_docs", "tokens")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    operators = (op1_toxicity, op2_url_filters, op3_mixing, op4_quality_rules, op5_order_minhash, op6_log_bilinear, op7_license_scans, op8_packing, op9_html_text, op10_ngram_join, op11_piece_codec, op12_conversation_repair, op13_merkle)
    return {f.__name__: f for f in (*operators, url_rules, quality_base, mixing_weights)}


_WORDS = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

_URL_RULES = r"""WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
  p AS (SELECT page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path FROM u),
  r AS (SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(verdict, h, p)),
  m AS (SELECT page_id, host, path, arg_max(r.h || r.p, length(r.h || r.p)) AS rule, arg_max(r.verdict, length(r.h || r.p)) AS verdict
    FROM p LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p) GROUP BY page_id, host, path)
  SELECT page_id, host, path, rule, verdict FROM m"""

_QUALITY_BASE = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS.format('text')} AS w FROM documents),
  x AS (SELECT doc_id, i, [w[i], w[i + 1], w[i + 2]] AS g FROM d, range(1, greatest(len(w) - 1, 1)) t(i) WHERE len(w) >= 3),
  c AS (SELECT doc_id, g FROM x GROUP BY doc_id, g HAVING count(*) > 1),
  r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM x JOIN c USING (doc_id, g), range(0, 3) s(k) GROUP BY doc_id),
  l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: len({_WORDS.format('s')}) > 0) AS lines FROM d)
  SELECT d.doc_id, len(w)::bigint AS n_words, length(array_to_string(w, ''))::bigint AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(r.n, 0)::bigint AS n_repeat_words, len(w) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(w) AS base_failed
  FROM d JOIN l USING (doc_id) LEFT JOIN r USING (doc_id)"""

_NGRAM_JOIN = f"""WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
  s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(CASE WHEN len(w) < 5 THEN w ELSE w[i : i + 4] END) AS g FROM d, range(1, greatest(len(w) - 4, 1) + 1) t(i) WHERE len(w) > 0),
  n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
  e AS MATERIALIZED (SELECT x, y FROM (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2) JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
  r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
  SELECT d.doc_id, coalesce(n.n, 0)::bigint AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x) c USING (doc_id)"""

_MIXING_WEIGHTS = f"""SELECT coalesce(source, 'null') AS source, count(*) AS n_docs, sum(len({_WORDS.format('text')}))::bigint AS tokens FROM documents WHERE len({_WORDS.format('text')}) > 0 GROUP BY 1"""


def _crc32(text: str) -> str:
    """crc32 of a text of ASCII characters."""
    bits = "list_reduce([0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda r, i: CASE WHEN (r & 1) = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, xor(a, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT), lambda a, b: {bits}, 4294967295), 4294967295)"


def _edit(way: str, cost: str, letter: str) -> str:
    """A way (ten digits of cost and an audit) with one more edit; ways compare by cost, then audit."""
    return f"(printf('%010d', left({way}, 10)::BIGINT + {cost}) || substr({way}, 11) || '{letter}')"


_BEFORE_U = ("s0", "s1", "s3")
_CONVERSATIONS = f"""WITH RECURSIVE h AS (SELECT coalesce(conv_id::varchar, ' ') AS key, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 AS hit FROM conversations),
  d AS (SELECT key, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM h, range(CASE WHEN hit = 3 THEN 2 ELSE 1 END) WHERE hit <> 0),
  o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body, left(role, 1) AS ini FROM d),
  f AS MATERIALIZED (SELECT *, CASE WHEN body = '' THEN 'b' WHEN row_number() OVER (PARTITION BY key, role, text ORDER BY i) > 1 THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '-' END AS fault,
    lag(ini) OVER (PARTITION BY key ORDER BY i) || ini AS pair FROM o),
  g AS (SELECT key, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY key),
  r AS (SELECT key, 0::BIGINT AS i, '0000000000' AS s0, NULL::varchar AS s1, '0000000003I' AS s2, '0000000006II' AS s3 FROM g
    UNION ALL
    SELECT key, i, s0, s1, u AS s2, least(s3, {_edit("u", "3", "I")}) AS s3 FROM (SELECT *, least(s2, {", ".join(_edit(s, "3", "I") for s in _BEFORE_U)}) AS u FROM (
      SELECT r.key, f.i, {_edit("s0", "4", "D")} AS s0, least({_edit("s1", "4", "D")}, CASE WHEN stays AND ini = 's' THEN {_edit("s0", "m", "K")} END) AS s1,
        least({_edit("s2", "4", "D")}, CASE WHEN stays AND ini = 'u' THEN least({", ".join(_edit(s, "m", "K") for s in _BEFORE_U)}) END, CASE WHEN stays THEN least({", ".join(_edit(s, "m + 3", "R") for s in _BEFORE_U)}) END) AS s2,
        least({_edit("s3", "4", "D")}, CASE WHEN stays AND ini = 'a' THEN {_edit("s2", "m", "K")} END, CASE WHEN stays THEN {_edit("s2", "m + 3", "R")} END) AS s3
      FROM r JOIN (SELECT *, fault IN ('t', '-') AS stays, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS m FROM f) f ON f.key = r.key AND f.i = r.i + 1))),
  b AS (SELECT key, arg_max(least(s0, s3), i) AS way FROM r GROUP BY key),
  a AS (SELECT key, substr(way, 11) AS audit, left(way, 10)::BIGINT AS cost FROM b),
  e AS (SELECT key, p, substr(audit, p, 1) AS letter, p - length(replace(left(audit, p), 'I', '')) AS inserted, length(replace(left(audit, p), 'D', '')) - length(replace(audit, 'D', '')) % 2 AS q FROM a, range(1, length(audit) + 1) t(p)),
  x AS (SELECT e.key, string_agg(CASE WHEN letter = 'K' THEN f.role WHEN q % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE f.text END, chr(10) ORDER BY p) AS said
    FROM e LEFT JOIN f ON f.key = e.key AND f.i = e.p - e.inserted WHERE letter <> 'D' GROUP BY e.key)
  SELECT c.conv_id, coalesce(gaps, 0)::bigint AS gaps, coalesce(blank, 0)::bigint AS blank, coalesce(duplicate, 0)::bigint AS duplicate, coalesce(truncated, 0)::bigint AS truncated, coalesce(illegal, 0)::bigint AS illegal,
    coalesce(cost, 0)::bigint AS cost, coalesce(audit, '') AS audit, sha256(coalesce(said, '')) AS repaired_sha256
  FROM (SELECT DISTINCT conv_id, coalesce(conv_id::varchar, ' ') AS key FROM conversations) c LEFT JOIN g USING (key) LEFT JOIN a USING (key) LEFT JOIN x USING (key)"""


def _leaf(n_chars: str) -> str:
    fields = ("doc_id::varchar", "source", "lang", f"({n_chars})::varchar", "text")
    return "sha256(" + " || ".join(f"coalesce(strlen({c}) || ':' || {c}, '-')" for c in fields) + ")"


def _levels(name: str, leaves: str) -> str:
    """The nodes of all levels of every tree of ``leaves`` (k, pos, d, n)."""
    return f"{name} AS (SELECT k, 0::BIGINT AS lvl, pos, d, n FROM {leaves} UNION ALL SELECT k, lvl + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2 FROM {name} WHERE n > 1 GROUP BY k, lvl, pos // 2, n)"


def _sides(nodes: str, at: str, key: str) -> str:
    """Per level the sibling of a node with its side, ``-`` for none."""
    return f"SELECT a.id, v.lvl, CASE WHEN s.d IS NULL THEN '-' WHEN s.pos < ({at} >> v.lvl) THEN 'L' || s.d ELSE 'R' || s.d END AS side FROM l a JOIN tops t ON t.tree = a.k JOIN (SELECT DISTINCT k, lvl FROM {nodes} WHERE n > 1) v ON v.k = {key} LEFT JOIN {nodes} s ON s.k = v.k AND s.lvl = v.lvl AND s.pos = xor({at} >> v.lvl, 1::BIGINT)"


_MERKLE = f"""WITH RECURSIVE x AS (SELECT doc_id, coalesce('=' || lang, '') AS k, {_leaf("n_chars")} AS d, CASE WHEN {_crc32("doc_id::varchar")} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS given FROM documents),
  l AS MATERIALIZED (SELECT *, row_number() OVER () AS id, (row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, d) - 1)::BIGINT AS pos, count(*) OVER (PARTITION BY k) AS n FROM x),
  {_levels("t", "l")}, tops AS MATERIALIZED (SELECT k AS tree, d AS subroot, (row_number() OVER (ORDER BY k) - 1)::BIGINT AS pos FROM t WHERE n = 1),
  y AS (SELECT '' AS k, pos, subroot AS d, count(*) OVER () AS n FROM tops), {_levels("u", "y")},
  w AS (SELECT 0 AS part, * FROM ({_sides("t", "a.pos", "a.k")}) UNION ALL SELECT 1, * FROM ({_sides("u", "t.pos", "''")})),
  p AS (SELECT id, list(side ORDER BY part, lvl) AS way FROM w GROUP BY id),
  z AS (SELECT l.*, coalesce(way, []) AS way FROM l LEFT JOIN p USING (id)),
  q AS (SELECT z.*, subroot, (SELECT d FROM u WHERE n = 1) AS root, sha256(coalesce(array_to_string(list_transform(way, lambda s: substr(s, 2)), ''), '')) AS proof_sha256,
    list_reduce(way, lambda h, s: CASE s[1] WHEN 'L' THEN sha256(substr(s, 2) || h) WHEN 'R' THEN sha256(h || substr(s, 2)) ELSE sha256(h) END, given) AS folded_root FROM z JOIN tops ON tree = k)
  SELECT doc_id, d AS leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM q"""


def oracle_sql() -> dict[str, str]:
    """SQL for what of the operators SQL can express; the learned parts are tested against plain versions."""
    return {"op10_ngram_join": _NGRAM_JOIN, "op12_conversation_repair": _CONVERSATIONS, "op13_merkle": _MERKLE, "url_rules": _URL_RULES, "quality_base": _QUALITY_BASE, "mixing_weights": _MIXING_WEIGHTS}
