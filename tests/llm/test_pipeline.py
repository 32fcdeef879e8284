"""The pipeline and the registered queries on the smallest tables."""

import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parents[2]))

import corpus_pipeline  # noqa: E402

from tessera.llm import queries  # noqa: E402
from tessera.llm.common import table  # noqa: E402

from .test_operators import plain_classes, texts  # noqa: E402


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    seen = [docs.select("doc_id", "text").collect()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == table(spark, sf_dir, "documents").columns
        seen.append(docs.select("doc_id", "text").collect())
    ids = [{r.doc_id for r in x} for x in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False)) and ids[-1]
    classes = plain_classes([(r.doc_id, r.text) for r in seen[2]])
    assert ids[3] == {k for k, _, c in classes if k == c}
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in last.select("doc_id").collect()} == ids[-1]


def test_stages_on_awkward_rows(spark, sf_dir):
    """Nulls, empty and long texts, repeated rows, and columns with names of the operators' own and of their helpers."""
    clash = ["score", "kept", "copies", "weight", "predicted", "gone", "row", "key", "label", "n", "a.b", "_w", "column_0"]
    rows = [(i, t, None, None if k % 2 else "s", None, *[f"own {c}" for c in clash]) for k, (i, t) in enumerate(texts())]
    columns = ", ".join(f"`{c}` string" for c in clash)
    awkward = spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {columns}")
    for docs in (awkward, awkward.limit(0)):
        before = docs.count()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            kept = out.collect()
            assert all(r[f"{c}"] == f"own {c}" for r in kept for c in clash) and len(kept) <= (2 if name == "mixing" else 1) * before
            if name == "toxicity":  # nothing toxic is labelled among these: all stay
                assert len(kept) == before
            if name != "quality_rules":  # those leave hardly any of these
                docs = out
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert (pieces.count() > 0) == (before > 0)


def test_packed_pieces_hold_the_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(40)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 2] for r in docs.collect()}
    seen = {}
    for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect():
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert zlib.crc32(np.array(ids, "<u4").tobytes()) == r.ids_crc32
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {k: len(v) for k, v in want.items()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    df, rel = queries.queries()[name](spark, sf_dir), con.sql(queries.oracle_sql()[name])
    names = sorted(df.columns)
    assert names == sorted(rel.columns)
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == sorted(tuple(str(r[rel.columns.index(c)]) for c in names) for r in rel.fetchall())


def test_every_operator_has_a_query():
    names = [n for n in queries.queries() if re.match("op[0-9]", n)]
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
