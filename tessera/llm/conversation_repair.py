"""Operator 12: the cheapest repair of the structure of conversations, by a rank-convergence parallel Viterbi search.

A repaired conversation's role initials read ``(s?(ua)+)?``. Rows are kept, given another role, or deleted, and rows without
text are inserted; blank and duplicate rows must go. The search runs over four states (nothing yet, after s, after u, after
a) and from the end: a vector holds the least cost of the rest from each state. Rows in order are cut into chunks of bounded
size, so a conversation of any length is many chunks. All chunks start at once from a speculative vector at their end;
fix-up passes give each chunk the vector of the chunk behind it and rerun it, from its end to the row where its vector
differs from the one it had by a constant only, until no chunk changes. A constant changes no choice, so the vectors drive
the trace of the least audit chunk by chunk; the states at which chunks begin are found by the same passes, forwards. A pass
takes twice as many neighbouring chunks in one go as the one before (1,024 at most): even where vectors never converge the
number of passes grows slowly.

A null role or text is one space; a null turn comes first and doesn't count as a turn; a null conversation id is a
conversation of its own. Rows of one turn stand in order of role and text, bytewise. Repeated rows are duplicates of the
first one. Role initials other than s, u and a fit nowhere. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, small_batches, stash

#: Rows and bytes of text of a chunk, and chunks that one fix-up step takes in a row at most (as a power of two).
CHUNK_ROWS, CHUNK_BYTES, WIDEST = 256, 1 << 20, 10
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: States, and the state that an initial leads to from each (None: it doesn't fit).
START, S, U, A = range(4)
NEXT = {"s": (S, None, None, None), "u": (U, U, None, U), "a": (None, None, A, None)}
#: What inserting or giving another role leads to from each state, and the role that this sets.
FORCED, ROLE = (U, U, A, U), ("user", "user", "assistant", "user")
#: Codes of rows: place in INITIALS, plus 4 if truncated; blank and duplicate rows have codes of their own.
INITIALS, BLANK, DUPLICATE = "sua?", 8, 9

Vector = tuple[int, int, int, int]


def closed(cost: list[int]) -> list[int]:
    """Lowers each state's cost to that of inserting rows first."""
    cost[U] = min(cost[U], INSERT + cost[A])
    for state in (START, S, A):
        cost[state] = min(cost[state], INSERT + cost[U])
    return cost


def reduced(cost: list[int]) -> Vector:
    """The vector less the constant that makes its least cost 0."""
    return tuple(c - min(cost) for c in cost)


#: Behind the last row nothing more is due at the start or after a.
END = reduced(closed([0, 99, 99, 0]))


def edits(code: int, state: int) -> list[tuple[str, int, int]]:
    """The edits at a row from a state: letter, cost, next state. Inserting leaves the row where it is."""
    found = [("D", DELETE, state), ("I", INSERT, FORCED[state])]
    if code < BLANK:
        more = TRUNCATED * (code >= 4)
        to = NEXT.get(INITIALS[code % 4], (None,) * 4)[state]
        found += [("K", KEEP + more, to)] * (to is not None) + [("R", REROLE + more, FORCED[state])]
    return found


EDITS = [[edits(code, state) for state in range(4)] for code in range(DUPLICATE + 1)]
_known: dict[tuple[int, Vector], tuple[Vector, list]] = {}


def step(code: int, after: Vector) -> tuple[Vector, list[tuple[str, int, int]]]:
    """From the vector behind a row the one before it, and from each state the cheapest edit with the least letter."""
    if (code, after) not in _known:
        cost = closed([min(c + after[to] for letter, c, to in EDITS[code][state] if letter != "I") for state in range(4)])
        best = [min(e for e in EDITS[code][state] if e[1] + (cost if e[0] == "I" else after)[e[2]] == cost[state]) for state in range(4)]
        _known[code, after] = reduced(cost), best
    return _known[code, after]


def vectors(codes: bytes, end: Vector, known: bytes = b"") -> bytes:
    """The vectors before every row: from the last row up to where they are as already ``known``."""
    found, vector, kept = [], tuple(end), b""
    for i in range(len(codes) - 1, -1, -1):
        vector = step(codes[i], vector)[0]
        if known and tuple(known[4 * i : 4 * i + 4]) == vector:
            kept = known[: 4 * i + 4]
            break
        found.append(bytes(vector))
    return kept + b"".join(reversed(found))


def trace(codes: bytes, before: bytes, end: bytes, state: int, last: bool) -> tuple[str, int, int]:
    """The least of the cheapest audits of a chunk that begins in ``state``: audit, cost, state at its end."""
    audit, total, marks = [], 0, before + end
    for i, code in enumerate(codes):
        best, letter = step(code, tuple(marks[4 * i + 4 : 4 * i + 8]))[1], "I"
        while letter == "I":
            letter, cost, state = best[state]
            audit.append(letter)
            total += cost
    while last and state in (S, U):
        audit.append("I")
        total += INSERT
        state = FORCED[state]
    return "".join(audit), total, state


def repaired(audit: str, roles: list[str], texts: list[str], state: int) -> list[tuple[str | None, str | None]]:
    """Role and text that each edit of an audit leaves; nothing where it deletes."""
    rows, found = iter(zip(roles, texts, strict=True)), []
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter == "D":
            found.append((None, None))
            continue
        if letter != "K":
            role = ROLE[state]
            state = FORCED[state]
        else:
            state = NEXT[role[:1]][state]
        found.append((role, text))
    return found


# Damage and faults.


def damaged(conversations: DataFrame) -> DataFrame:
    """Every row after damage by the hash of its place: key, turn, role, text, and whether it is there at all (``alive``)."""
    conv, turn = F.col("conv_id").cast("string"), F.col("turn").cast("string")
    key = F.coalesce(conv, F.lit(" "))
    hit = F.pmod(F.crc32(F.concat(key, F.lit(":"), F.coalesce(turn, F.lit(" "))).cast("binary")), F.lit(20))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    d = conversations.select(
        key.alias("key"), F.col("turn").cast("bigint").alias("turn"), F.when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(hit == 1, "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (hit != 0).alias("alive"),
        F.explode(F.when(hit == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return d.drop("copy")


def with_codes(rows: DataFrame) -> DataFrame:
    """Adds ``uid`` and ``code``, the first fault or else the initial of each row of ``rows`` (key, turn, role, text)."""
    end = F.rtrim("text", F.lit(SPACE))
    place = F.coalesce(F.nullif(F.instr(F.lit(INITIALS[:3]), F.substring("role", 1, 1)), F.lit(0)), F.lit(4)) - 1
    initial = F.when(F.col("role") == "", 3).otherwise(place)
    d = rows.withColumns({
        "uid": F.monotonically_increasing_id(), "said": F.sha2(F.concat("role", F.lit(":"), "text"), 256), "blank": end == "",
        "plain": (initial + F.when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(4)).cast("int"),
    })
    d = stash(d, "rows")
    first = d.where(~F.col("blank")).groupBy("key", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("a"), "turn", "uid")).alias("first")).select(F.col("first.uid").alias("uid"), F.lit(True).alias("is_first"))
    code = F.when(F.col("blank"), BLANK).when(F.col("is_first"), F.col("plain")).otherwise(DUPLICATE).cast("int")
    return d.join(first, "uid", "left").select("key", "turn", "role", "text", "uid", code.alias("code"))


# Chunks.

_CHUNK = "key string, part int, seq int, codes binary, roles array<string>, texts array<string>, turns int, first_turn bigint, last_turn bigint, max_turn bigint, min_turn bigint, illegal bigint, blank bigint, duplicate bigint, truncated bigint, head string, tail string"
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _chunk(key: str, part: int, seq: int, rows: list[tuple]) -> dict:
    turns, roles, texts, codes = zip(*rows, strict=True)
    some = [t for t in turns if t is not None]
    heads = [r[:1] for r in roles]
    return {
        "key": key, "part": part, "seq": seq, "codes": bytes(codes), "roles": list(roles), "texts": list(texts), "turns": len(set(some)), "first_turn": turns[0], "last_turn": turns[-1],
        "blank": codes.count(BLANK), "duplicate": codes.count(DUPLICATE), "truncated": sum(4 <= c < BLANK for c in codes),
        "max_turn": max(some, default=None), "min_turn": min(some, default=None), "illegal": sum(p not in _LEGAL for p in zip(heads, heads[1:], strict=False)), "head": heads[0], "tail": heads[-1],
    }


def _chunks(most_rows: int, most_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts a sorted partition's rows into chunks of one conversation each."""
        part, now, seq, rows, size, out, held = TaskContext.get().partitionId(), None, 0, [], 0, [], 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(out, _CHUNK_ARROW)

        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (key != now or len(rows) >= most_rows or size >= most_bytes):
                    out.append(_chunk(now, part, seq, rows))
                    held, rows, size, seq = held + size, [], 0, seq + 1
                    if held >= most_bytes:
                        yield batch_of()
                        out, held = [], 0
                if key != now:
                    now, seq = key, 0
                rows.append(tuple(row))
                size += len(row[2])
        if rows:
            out.append(_chunk(now, part, seq, rows))
        if out:
            yield batch_of()

    return run


_CHUNK_ARROW = pa.schema([
    ("key", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("codes", pa.binary()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("turns", pa.int32()),
    *((c, pa.int64()) for c in ("first_turn", "last_turn", "max_turn", "min_turn", "illegal", "blank", "duplicate", "truncated")), ("head", pa.string()), ("tail", pa.string()),
])


def in_chunks(rows: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """Rows (with codes) sorted by ranges and cut into chunks; ``k`` numbers a conversation's chunks, ``n`` is how many it has."""
    keys = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("uid")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).select("key", "turn", "role", "text", "code")
    cut = stash(rows.mapInArrow(_chunks(most_rows, most_bytes), _CHUNK), "chunks")
    parts_of = cut.groupBy("key", "part").agg(F.count(F.lit(1)).alias("m"))  # a row a range
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts_of.select("key", "part", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("start"), F.sum("m").over(Window.partitionBy("key")).alias("n"))
    return cut.join(starts, ["key", "part"]).withColumn("k", F.col("start") + F.col("seq")).drop("start")


# Passes over chunks.

_STATE = "key string, k bigint, n bigint, part int, seq int, codes binary, end binary, before binary, out binary, start binary, finish binary, audit string, cost bigint"
_STATE_ARROW = pa.schema([
    ("key", pa.string()), ("k", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("seq", pa.int32()), *((c, pa.binary()) for c in ("codes", "end", "before", "out", "start", "finish")),
    ("audit", pa.string()), ("cost", pa.int64()),
])


def search(row: dict, end: bytes) -> None:
    """Reruns a chunk from another vector at its end."""
    row["before"] = vectors(row["codes"], tuple(end), row["before"] or b"")
    row["end"], row["out"] = end, row["before"][:4]


def follow(row: dict, start: bytes) -> None:
    """Traces a chunk from another state at its start."""
    row["audit"], row["cost"], state = trace(row["codes"], row["before"], row["end"], start[0], row["k"] == row["n"] - 1)
    row["start"], row["finish"] = start, bytes([state])


def _first(rerun: Callable[[dict, bytes], None], value: Callable[[dict], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                rerun(row, value(row))
            yield pa.RecordBatch.from_pylist(rows, _STATE_ARROW)

    return run


def _sweep(rerun: Callable[[dict, bytes], None], given: str, made: str, backwards: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        """Takes neighbouring chunks one after the other; only those whose given value has changed are run again."""
        rows = sorted(table.to_pylist(), key=lambda r: r["k"], reverse=backwards)
        now = None
        for row in rows:
            want = row.pop("want") if now is None else now
            if want is not None and want != row[given]:
                rerun(row, want)
            now = row[made]
        return pa.Table.from_pylist([{c: r[c] for c in _STATE_ARROW.names} for r in rows], _STATE_ARROW)

    return run


def settled(chunks: DataFrame, rerun: Callable[[dict, bytes], None], given: str, made: str, backwards: bool) -> DataFrame:
    """Fix-up passes until every chunk has been given what its neighbour made."""
    turn = 0
    while True:
        other = chunks.select("key", (F.col("k") - 1 if backwards else F.col("k") + 1).alias("k"), F.col(made).alias("want"))
        joined = chunks.join(other, ["key", "k"], "left")
        if joined.where(F.col("want") != F.col(given)).isEmpty():
            return chunks
        span = F.shiftright("k", min(turn, WIDEST)).alias("span")
        chunks = stash(joined.groupBy("key", span).applyInArrow(_sweep(rerun, given, made, backwards), _STATE), "pass")
        turn += 1


def searched(chunks: DataFrame) -> DataFrame:
    """Vectors, audit, cost and states of every chunk."""
    blank = {"end": "binary", "before": "binary", "out": "binary", "start": "binary", "finish": "binary", "audit": "string", "cost": "bigint"}
    d = chunks.select("key", "k", "n", "part", "seq", "codes", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])
    speculative = stash(d.mapInArrow(_first(search, lambda row: bytes(END)), _STATE), "pass")
    many = F.col("n") > 1
    found = settled(speculative.where(many), search, "end", "out", True).unionByName(speculative.where(~many))
    traced = stash(found.mapInArrow(_first(follow, lambda row: bytes([A if row["k"] else START])), _STATE), "pass")
    return settled(traced.where(many), follow, "start", "finish", False).unionByName(traced.where(~many))


# Results.

_REPAIRED = "key string, k bigint, audit string, cost bigint, roles array<string>, texts array<string>"


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        found = [repaired(r["audit"], r["roles"], r["texts"], r["start"][0]) for r in rows]
        out = [{"key": r["key"], "k": r["k"], "audit": r["audit"], "cost": r["cost"], "roles": [x for x, _ in f], "texts": [x for _, x in f]} for r, f in zip(rows, found, strict=True)]
        yield pa.RecordBatch.from_pylist(out, pa.schema([("key", pa.string()), ("k", pa.int64()), ("audit", pa.string()), ("cost", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))]))


def repair(rows: DataFrame, most_rows: int = CHUNK_ROWS, most_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Chunks of ``rows`` (key, turn, role, text) as they are, and repaired: per chunk its audit, cost, and role and text for every edit."""
    small_batches(rows.sparkSession)
    chunks = stash(in_chunks(with_codes(rows), most_rows, most_bytes), "numbered")
    found = searched(chunks)
    parts = found.select("key", "k", "audit", "cost", "start").join(chunks.select("key", "k", "roles", "texts"), ["key", "k"])
    return chunks, parts.mapInArrow(_repaired, _REPAIRED)


def turns(repaired_chunks: DataFrame) -> DataFrame:
    """The repaired conversations row by row: key, chunk and place of the edit (k, at), edit, role, text; deleted rows aside."""
    edit = F.transform(F.arrays_zip("roles", "texts"), lambda x, i: F.struct(i.alias("at"), F.substring("audit", i + 1, F.lit(1)).alias("edit"), x["roles"].alias("role"), x["texts"].alias("text")))
    d = repaired_chunks.select("key", "k", F.explode(edit).alias("e")).select("key", "k", "e.*")
    return d.where(F.col("role").isNotNull())


def faults(chunks: DataFrame) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated and illegal; neighbouring chunks settle what crosses their border."""
    ends = chunks.select("key", (F.col("k") + 1).alias("k"), F.col("last_turn").alias("turn_before"), F.col("tail").alias("tail_before"))
    pair = F.concat("tail_before", "head")
    d = chunks.join(ends, ["key", "k"], "left").select(
        "key", "max_turn", "min_turn", (F.col("turns") - F.when(F.col("turn_before") == F.col("first_turn"), 1).otherwise(0)).alias("turns"), "blank", "duplicate", "truncated",
        (F.col("illegal") + F.when((F.col("k") > 0) & ~pair.isin("su", "ua", "au"), 1).otherwise(0)).alias("illegal"),
    )
    gaps = F.coalesce(F.max("max_turn") - F.min("min_turn") + 1 - F.sum("turns"), F.lit(0)).alias("gaps")
    return d.groupBy("key").agg(gaps, *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])


_DIGEST = "key string, cost bigint, audit string, repaired_sha256 string"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose chunks come in order: nothing but the audit is held."""
    now, total, audit, state, lines = None, 0, [], None, 0

    def out() -> pa.RecordBatch:
        row = {"key": now, "cost": total, "audit": "".join(audit), "repaired_sha256": state.hexdigest()}
        return pa.RecordBatch.from_pylist([row], pa.schema([("key", pa.string()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]))

    for batch in batches:
        for row in batch.to_pylist():
            if row["key"] != now:
                if now is not None:
                    yield out()
                now, total, audit, state, lines = row["key"], 0, [], hashlib.sha256(), 0
            total += row["cost"]
            audit.append(row["audit"])
            for role, text in zip(row["roles"], row["texts"], strict=True):
                if role is not None:
                    state.update(("\n" * (lines > 0) + role + ":" + text).encode())
                    lines += 1
    if now is not None:
        yield out()


def conversation_repair(conversations: DataFrame, most_rows: int = CHUNK_ROWS, most_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Damages ``conversations``, repairs them, and returns faults, cost, audit and digest of every original conversation."""
    rows = damaged(conversations)
    chunks, fixed = repair(rows.where("alive").drop("alive"), most_rows, most_bytes)
    digests = fixed.repartition("key").sortWithinPartitions("key", "k").mapInArrow(_digests, _DIGEST)
    every = conversations.select(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), "conv_id").distinct()
    d = every.join(faults(chunks).join(digests, "key"), "key", "left")
    number = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return d.select("conv_id", *number, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
