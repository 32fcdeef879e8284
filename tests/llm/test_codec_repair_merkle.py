"""Operators 11 to 13 against the library, a forward search over whole audits, and a tree built in one go."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tessera.llm import conversation_repair, merkle, piece_codec

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, unit string, ids string, tree string, digest string"
TALK = "conv_id bigint, turn bigint, role string, text string, key string, code string"
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def texts():
    rng = random.Random(3)
    letters = [" ", "  ", "\n", "\n\n", "\t", "\r", "▁", "a", "the", "Ünter", "中", "\U0001f600", "<s>", "<0x41>", "\x00", "́", "x" * 40, "int ", ".", " "]
    odd = [None, "", " ", "   ", "\n", "a ", " a", "a  b\n\n c\n", "▁", "▁ a▁▁b ▁", "\n a", "x" * 9000, " " * 300 + "word", "word " * 4000, "é" * 700]
    return odd + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(200)]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None if k % 17 == 0 else k % 150, t, None if k % 5 == 0 else "abcdefghijk"[k % 11], None if k % 3 else f"s é{k % 4}", None if k % 4 == 0 else k, *"wxyz") for k, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[20], rows[20]], DOCS).repartition(3)


# 11 SentencePiece


def test_chunks_leave_the_library_s_ids(library):
    model = piece_codec.Model.at(MODEL)
    assert model.cuts
    for text in texts():
        chunks = model.chunks(text or "")
        assert "".join(chunks)[1:] == (text or "")
        assert [i for ids in model.segment(chunks) for i in ids] == library.encode(text or "")


@pytest.mark.parametrize("unit_bytes", [1, 900, 1 << 24])
def test_ids_and_texts_equal_the_library_s(docs, library, unit_bytes, monkeypatch):
    monkeypatch.setattr(piece_codec, "BATCH_CHUNKS", 50)
    got = piece_codec.encode(docs, unit_bytes=unit_bytes, slice_bytes=2000, decoded=True)
    again = piece_codec.decode(got.select("doc_id", "ids"))
    assert got.columns == again.columns
    assert sorted(map(str, again.collect())) == sorted(map(str, got.collect()))
    got = got.collect()
    want = [(r.doc_id, library.encode(r.text or ""), library.decode(library.encode(r.text or "")) if r.text else "") for r in docs.collect()]
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=str) == sorted(want, key=str)


def test_a_model_whose_pieces_cross_markers_takes_whole_texts(library, monkeypatch):
    model = piece_codec.Model(MODEL)
    monkeypatch.setattr(model, "cuts", None)
    assert model.chunks("a b\nc") == ["a b\nc"] and model.segment(["a b\nc"]) == [library.encode("a b\nc")]


def test_distinct_chunks_are_segmented_once(monkeypatch):
    asked = []
    monkeypatch.setattr(piece_codec.Model, "segment", lambda self, chunks: asked.extend(chunks) or [[len(c)] for c in chunks])
    chunks = [pa.array(x, pa.large_string()) for x in ([" a", " bc"], [" bc", " d"], [])]
    out = piece_codec._segmented(MODEL, step=2)((), pa.table({"unit": [1, 2, 3], "slice": [0, 0, 0], "chunks": [piece_codec.pack_texts(c) for c in chunks]}))
    assert sorted(asked) == [" a", " bc", " d"]
    assert [piece_codec.unpack(x.as_py())[0].tolist() for x in out.column("ids")] == [[2, 3], [3, 2], []]


def test_packing_round_trips():
    for values in ([], [0], [1, -5, 2**31 - 1, 70_000]):
        assert piece_codec.unpack(piece_codec.pack(np.array(values, np.int32), b"xy"))[0].tolist() == values
    for some in ([], [""], ["a", "", "\U0001f600 é", "\x00"]):
        assert piece_codec.unpack_texts(piece_codec.pack_texts(pa.array(some, pa.large_string()))).to_pylist() == some
    chunks = pa.array([f" w{i}" for i in range(1000)], pa.large_string())
    for slices in (1, 7, 4096):
        found = piece_codec.slice_of(chunks, slices)
        assert found.min() >= 0 and found.max() < slices


def test_codec_query_and_empty_table(spark, docs, library):
    got = sorted(map(tuple, piece_codec.piece_codec(docs).collect()), key=str)
    ids = [(r.doc_id, library.encode(r.text or "")) for r in docs.collect()]
    assert got == sorted(((i, len(x), sha(",".join(map(str, x))), sha(library.decode(x) if x else "")) for i, x in ids), key=str)
    assert piece_codec.piece_codec(spark.createDataFrame([], DOCS)).count() == 0


# 12 conversations


def plain_repairs(rows):
    """A forward search that keeps the least (cost, audit) of every state with what it leaves."""
    conversations = {}
    for conv, turn, role, text in rows:
        out = conversations.setdefault(conv, [])
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        out += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    found = []
    for conv, said in conversations.items():
        said.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns, seen, faults = [t for t, _, _ in said if t is not None], set(), []
        for _, role, text in said:
            body = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))

        def leads(state, initial):
            return {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}.get(initial, {}).get(state)

        def better(best, state, new):
            if state is not None and (state not in best or new[:2] < best[state][:2]):
                best[state] = new

        def inserted(best):
            for _ in range(4):
                for state, (cost, audit, left) in list(best.items()):
                    for role in ("user", "assistant"):
                        better(best, leads(state, role[0]), (cost + 3, audit + "I", [*left, f"{role}:"]))
            return best

        best = inserted({"": (0, "", [])})
        for (_, role, text), fault in zip(said, faults, strict=True):
            new = {}
            for state, (cost, audit, left) in best.items():
                better(new, state, (cost + 4, audit + "D", left))
                if fault not in ("blank", "duplicate"):
                    more = 3 * (fault == "truncated")
                    better(new, leads(state, role[:1]), (cost + more, audit + "K", [*left, f"{role}:{text}"]))
                    for other in ("user", "assistant"):
                        better(new, leads(state, other[0]), (cost + more + 3, audit + "R", [*left, f"{other}:{text}"]))
            best = inserted(new)
        cost, audit, left = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        found.append((conv, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha("\n".join(left))))
    return sorted(found, key=str)


def talk(roles, n=300, seed=5):
    rng = random.Random(seed)
    said = [None, "", " \t\n", "a.", "b", "c!", " d? ", "eé.", "line\n", " ", *[f"t{i}." for i in range(30)], *[f"t{i}" for i in range(9)]]
    return [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([None, *range(n)]), rng.choice(roles), rng.choice(said)) for _ in range(n)]


@pytest.mark.parametrize("roles", [["user", "assistant", "system"], ["x", "", "user", None, "assistant", "Us"], ["user"], ["z"]])
def test_repairs_of_many_chunks_equal_a_whole_search(spark, roles):
    rows = talk(roles)
    df = spark.createDataFrame([(*r, "clash", "clash") for r in rows], TALK).repartition(3)
    got = conversation_repair.conversation_repair(df, most_rows=4)
    assert sorted(map(tuple, got.collect()), key=str) == plain_repairs(rows)


def test_repair_edge_tables(spark):
    assert conversation_repair.conversation_repair(spark.createDataFrame([], TALK)).count() == 0
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = conversation_repair.conversation_repair(spark.createDataFrame([(dropped, 0, "user", "a.", "", "")], TALK)).collect()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", sha(""))
    same = [(7, 3, "user", "long " * 5000 + "."), *[(7, 3, "user", "long " * 5000 + ".")] * 40, (7, None, None, None)]
    got = conversation_repair.conversation_repair(spark.createDataFrame([(*r, "", "") for r in same], TALK), most_rows=3)
    assert sorted(map(tuple, got.collect()), key=str) == plain_repairs(same)


def test_repaired_rows_are_those_of_the_digest(spark):
    rows = talk(["user", "assistant", "system"], 80, 1)
    d = conversation_repair.damaged(spark.createDataFrame([(*r, "", "") for r in rows], TALK)).where("alive").drop("alive")
    left = {}
    for r in conversation_repair.turns(conversation_repair.repair(d, most_rows=5)[1]).orderBy("key", "k", "at").collect():
        assert r.edit in "KRI" and (r.edit != "I" or r.text == "")
        left.setdefault(r.key, []).append(f"{r.role}:{r.text}")
    for want in plain_repairs(rows):
        said = left.get(" " if want[0] is None else str(want[0]), [])
        assert sha("\n".join(said)) == want[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in said))


def test_vectors_rerun_stops_where_they_run_parallel():
    codes = bytes([1, 2] * 50)
    first = conversation_repair.vectors(codes, conversation_repair.END)
    for end in ((0, 6, 0, 3), (3, 6, 3, 0), (4, 1, 0, 3)):
        assert conversation_repair.vectors(codes, end, first) == conversation_repair.vectors(codes, end)
        assert conversation_repair.vectors(codes, end)[:4] == first[:4]


# 13 Merkle manifest


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    levels = [nodes]
    while len(nodes) > 1:
        nodes = [sha("".join(nodes[i : i + 2])) for i in range(0, len(nodes), 2)]
        levels.append(nodes)
    return levels


def others(levels, at):
    found = []
    for nodes in levels[:-1]:
        pair = at // 2 * 2
        found.append([(j < at, nodes[j]) for j in (pair, pair + 1) if j != at and j < len(nodes)])
        at //= 2
    return found


def plain_manifest(rows):
    """rows: doc_id, source, lang, n_chars, text."""
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row, sha("".join(map(field, row)))))
    names = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    for name in names:
        trees[name].sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
    built = {name: tree([leaf for _, leaf in trees[name]]) for name in names}
    top, found = tree([built[name][-1][0] for name in names]), []
    for a, name in enumerate(names):
        for i, (row, leaf) in enumerate(trees[name]):
            proof, at = others(built[name], i) + others(top, a), leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                at = sha("".join(map(field, (*row[:3], row[3] + 1, row[4]))))
            for run in proof:
                at = sha("".join([d for left, d in run if left] + [at] + [d for left, d in run if not left]))
            found.append((row[0], leaf, built[name][-1][0], top[-1][0], sha("".join(d for run in proof for _, d in run)), at, at == top[-1][0]))
    return sorted(found, key=str)


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest_equals_a_tree_built_at_once(docs, levels):
    rows = [tuple(r) for r in docs.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    want = plain_manifest(rows)
    assert any(not r[-1] for r in want)
    assert sorted(map(tuple, merkle.manifest(docs, levels).collect()), key=str) == want


@pytest.mark.parametrize("n", [0, 1, 2, 3, 33])
def test_manifests_of_few_rows(docs, n):
    few = docs.sparkSession.createDataFrame(docs.orderBy("n_chars").limit(n).collect(), docs.schema)
    rows = [tuple(r) for r in few.select("doc_id", "source", "lang", "n_chars", "text").collect()]
    assert sorted(map(tuple, merkle.manifest(few, 2).collect()), key=str) == (plain_manifest(rows) if rows else [])
