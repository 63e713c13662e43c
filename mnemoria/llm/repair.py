"""Repair of conversation structure by a dynamic program with square-root checkpoints.

A conversation should be empty, or an optional system turn followed by user and assistant turns in alternation, the last
by the assistant. Turns are kept, deleted, given another role, or inserted; the cheapest edits win, and of equally cheap
ones those whose letters (Delete, Insert, Keep, Rerole) come first in ASCII order.

The program has four states (what was said last: nothing, system, user, assistant), and every letter leads from a state to
one other. A vector holds the cheapest rest for each state. Walking back over a piece of a conversation, only the vectors
at every sqrt(n)-th turn are stored; walking forward, the vectors of one block at a time are computed again and the least
letter that keeps to the cheapest rest is emitted. Vectors relative to their least entry are few, so steps are remembered.

Conversations are no groups: turns are sorted by conversation and place over all partitions, and cut into pieces of at most
PIECE turns and BYTES of text. A conversation of one piece inside a partition is solved there. The others, a conversation
of a third of all rows among them, are joined by their pieces' (min, +) matrices: one scan back over the matrices gives
each piece the vector at its end, each piece then walks from all four states, and one scan forward over the states reached
says which walk counts. The scans stream a few numbers for each piece and hold one.

Null conversations are one conversation. A null role or text is one blank. Turns are in order of turn (nulls first), role
and text, by code point; equal rows are duplicates. Roles are judged by their first character. A conversation without rows
has no result. Texts of any length are kept whole. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, stored
from .graph import sized

#: Most turns and, but for one longer turn, bytes of text of a piece.
PIECE, BYTES = 4096, 1 << 22
#: Characters of a role and of a text by which turns of one number are dealt to partitions.
KEY = 64
BLANKS = "\t\n\v\f\r "
#: State after an inserted or reroled turn; only these two roles can be given.
NEXT = (2, 2, 3, 2)
#: By state: what a kept turn of a role initial leads to.
KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
INITIALS = " sua"
DELETE, REROLE, INSERT, TRUNCATED = 3, 2, 2, 1
#: Cheapest rest after the last turn, by state.
END = (0, 2 * INSERT, INSERT, 0)
FAR = 1 << 30
GIVEN = {2: "user", 3: "assistant"}

Vector = tuple[int, int, int, int]


def code(initial: str, blank: bool, duplicate: bool, truncated: bool) -> int:
    """A turn as a byte: its role, whether it must go, whether it is truncated."""
    return (max(INITIALS.find(initial), 0) if initial else 0) | 4 * (blank or duplicate) | 8 * truncated


@lru_cache(maxsize=1 << 16)
def back(c: int, v: Vector) -> tuple[Vector, int]:
    """The vector before a turn, less its least entry, and that entry."""
    late, out = TRUNCATED if c & 8 else 0, []
    for q in range(4):
        best = v[q] + DELETE
        if not c & 4:
            best = min(best, v[NEXT[q]] + REROLE + late)
            to = KEEP[q].get(INITIALS[c & 3])
            best = min(best, v[to] + late) if to else best
        out.append(best)
    out[2], out[3] = min(out[2], out[3] + INSERT), min(out[3], out[2] + INSERT)
    out[0], out[1] = min(out[0], out[2] + INSERT), min(out[1], out[2] + INSERT)
    least = min(out)
    return tuple(x - least if x < FAR else FAR for x in out), least


@lru_cache(maxsize=1 << 16)
def step(c: int, v: Vector, q: int) -> tuple[str, int, int]:
    """From state q before a turn with the vector v after it: the letters up to this turn's, the state then, their cost."""
    before, least = back(c, v)
    late, letters, cost = TRUNCATED if c & 8 else 0, "", 0
    while True:
        rest, to = before[q] + least, KEEP[q].get(INITIALS[c & 3])
        if rest == v[q] + DELETE:
            return letters + "D", q, cost + DELETE
        if rest == before[NEXT[q]] + least + INSERT:
            letters, q, cost = letters + "I", NEXT[q], cost + INSERT
        elif to and rest == v[to] + late:
            return letters + "K", to, cost + late
        else:
            return letters + "R", NEXT[q], cost + REROLE + late


def matrix(codes: bytes) -> list[int]:
    """Cheapest way from each state before the turns to each state after them, row by row."""
    columns = []
    for q in range(4):
        v, total = tuple(0 if k == q else FAR for k in range(4)), 0
        for c in reversed(codes):
            v, least = back(c, v)
            total += least
        columns.append([x + total if x < FAR else FAR for x in v])
    return [columns[to][q] for q in range(4) for to in range(4)]


def walk(codes: bytes, states: list[int], end: Vector) -> list[tuple[str, int, int]]:
    """(letters, last state, cost) of the cheapest edits from each state; vectors are stored at checkpoints only."""
    n, size = len(codes), isqrt(len(codes)) + 1
    marks, v = {}, end
    for i in range(n - 1, -1, -1):
        if (i + 1) % size == 0 or i == n - 1:
            marks[i // size] = v
        v, _ = back(codes[i], v)
    got = [([], q, 0) for q in states]
    for k in range(-(-n // size)):
        block, vectors = codes[k * size : (k + 1) * size], [marks[k]]
        for c in reversed(block[1:]):
            vectors.append(back(c, vectors[-1])[0])
        for c, v in zip(block, reversed(vectors)):
            for g, (letters, q, cost) in enumerate(got):
                more, to, extra = step(c, v, q)
                letters.append(more)
                got[g] = (letters, to, cost + extra)
    return [("".join(letters), q, cost) for letters, q, cost in got]


def through(m: list[int], v: Vector) -> Vector:
    """The vector before turns with matrix m, less its least entry."""
    out = [min(m[4 * q + to] + v[to] for to in range(4)) for q in range(4)]
    least = min(out)
    return tuple(min(x - least, FAR) for x in out)


def render(letters: str, q: int, roles: list[str], texts: list[str]) -> list[dict]:
    """The repaired turns."""
    out, i = [], 0
    for e in letters:
        if e == "D":
            i += 1
        elif e == "K":
            out.append({"role": roles[i], "text": texts[i]})
            q, i = KEEP[q][roles[i][:1]], i + 1
        else:
            q = NEXT[q]
            out.append({"role": GIVEN[q], "text": texts[i] if e == "R" else ""})
            i += e == "R"
    return out


COUNTS = ["blank", "duplicate", "truncated", "illegal"]
TURNS = "array<struct<role:string,text:string>>"


def _pieces(conv: str, kind: str):
    """Sorted turns -> pieces: whole conversations are solved, of others the parts are described."""
    names = ["conv", "seg", "k", "whole", *COUNTS, "low", "high", "distinct", "first", "last", "codes", "matrix", "cost", "edits", "turns", "roles", "texts"]
    types = f"conv {kind}, seg int, k int, whole boolean, blank long, duplicate long, truncated long, illegal long, low long, high long, distinct long, first string, last string, codes binary, matrix array<int>, cost long, edits string, turns {TURNS}, roles array<string>, texts array<string>"
    turn_type = pa.struct([("role", pa.string()), ("text", pa.string())])
    some = {"k": pa.int32(), "seg": pa.int32(), "whole": pa.bool_(), "first": pa.string(), "last": pa.string(), "codes": pa.binary(), "matrix": pa.list_(pa.int32()), "edits": pa.string(), "turns": pa.list_(turn_type), "roles": pa.list_(pa.string()), "texts": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg, k, out, conv_type = TaskContext.get().partitionId(), 0, [], None
        piece: dict | None = None
        alone = False  # the piece began inside the partition, and its conversation with it
        before: tuple | None = None

        def close(whole: bool) -> None:
            nonlocal k
            p, raw = piece, bytes(piece.pop("raw"))
            p |= {"seg": seg, "k": k, "whole": whole, "distinct": p["distinct"], "cost": 0}
            p.pop("size")
            k += 1
            if whole:
                letters, q, cost = walk(raw, [0], END)[0]
                letters += "I" * (END[q] // INSERT)
                p |= {"cost": cost + END[q], "edits": letters, "turns": render(letters, 0, p["roles"], p["texts"]), "roles": None, "texts": None}
            else:
                p |= {"codes": raw, "matrix": matrix(raw)}
            out.append(p)

        def flush() -> pa.RecordBatch:
            rows = [[p.get(n) for p in out] for n in names]
            out.clear()
            return pa.record_batch([pa.array(r, conv_type if n == "conv" else some.get(n, pa.int64())) for n, r in zip(names, rows)], names=names)

        weight = 0
        for b in batches:
            conv_type = b.schema.field(0).type
            for c, turn, role, text, again in zip(*[x.to_pylist() for x in b.columns]):
                new = piece is None or c != piece["conv"]
                if new or len(piece["raw"]) >= PIECE or piece["size"] >= BYTES:
                    if piece is not None:
                        close(new and alone)
                        weight += piece["bytes"]
                        if weight > BYTES:
                            yield flush()
                            weight = 0
                    alone = new and piece is not None
                    piece = {"conv": c, "raw": bytearray(), "size": 0, "bytes": 0, "roles": [], "texts": [], "low": None, "high": None, "distinct": 0, "first": role[:1], "last": None} | dict.fromkeys(COUNTS, 0)
                    before = None if new else before
                tail = text.rstrip(BLANKS)[-1:]
                blank, duplicate = not tail, again or before == (turn, role, text)
                short = bool(tail) and not duplicate and tail not in ".!?"
                duplicate = duplicate and not blank
                piece["blank"] += blank
                piece["duplicate"] += duplicate
                piece["truncated"] += short
                if piece["last"] is not None:
                    piece["illegal"] += piece["last"] + role[:1] not in ("su", "ua", "au")
                piece["last"] = role[:1]
                if turn is not None:
                    piece["distinct"] += turn != piece["high"]
                    piece["low"] = turn if piece["low"] is None else piece["low"]
                    piece["high"] = turn
                piece["raw"].append(code(role[:1], blank, duplicate, short))
                piece["roles"].append(role)
                piece["texts"].append(text)
                piece["size"] += len(text)
                piece["bytes"] += len(text) + len(role) + 50
                before = (turn, role, text)
        if piece is not None:
            close(False)  # it may go on in the next partition
            yield flush()

    return run, types


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """turns -> conv, place (0, 1, ... of its pieces), pieces (their number), blank, duplicate, truncated, illegal, low, high,
    distinct (turns; of neighbouring pieces that share one it counts in the first), cost, edits, turns (the repaired ones:
    array of role, text). A row is a piece of a conversation: nearly all have one. Runs jobs while it is being built."""
    t = turns.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    t = t.withColumn("said", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    at = F.struct(F.col("turn").isNotNull().alias("given"), "turn")
    # what is said at one turn only needs no join: equal rows follow each other
    again = t.groupBy("conv", "said").agg(F.min(at).alias("least"), F.max(at).alias("most")).filter("least <> most")
    again = sized(cut(again.select(F.col("conv").alias("c"), F.col("said").alias("s"), "least")))
    known = t.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    known = known.select("conv", "turn", "role", "text", F.coalesce(at > F.col("least"), F.lit(False)).alias("again"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    run, types = _pieces(conv, t.schema["conv"].dataType.simpleString())
    # a sample of the keys passes through the driver, so that they are cut; equal keys stay together
    short = F.length("role") <= KEY
    keys = [*order[:2], F.substring("role", 1, KEY), F.when(short, F.substring("text", 1, KEY)).asc_nulls_first()]
    every = stored(known.repartitionByRange(*keys).sortWithinPartitions(*order).mapInArrow(run, types))
    whole = every.filter("whole").select("conv", F.lit(0).alias("place"), F.lit(1).alias("pieces"), *COUNTS, "low", "high", "distinct", "cost", "edits", "turns")
    return whole.unionByName(_joined(every.filter("not whole"))).withColumnRenamed("conv", conv)


def _scan(rows: DataFrame, order: list[Column], schema: str, start, forward):
    """Streams rows of each conversation in order: forward(state, row) -> (state, output row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, state = False, None
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            out = []
            for r in b.to_pylist():
                if not have or r["conv"] != conv_now:
                    have, conv_now, state = True, r["conv"], start
                state, got = forward(state, r)
                out.append(got)
            if out:
                yield pa.record_batch([pa.array([g[n] for g in out], pa.list_(pa.int32()) if n == "v" else pa.int64() if n == "moved" else pa.int32()) for n in names], names=names)

    return rows.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), *order).mapInArrow(run, schema)


def _joined(pieces: DataFrame) -> DataFrame:
    """Pieces of conversations that pass a partition's or a piece's end -> solved pieces."""
    slim = pieces.select("conv", "seg", "k", "matrix", "first", "last", "low", "high")
    after = _scan(slim, [F.col("seg").desc(), F.col("k").desc()], "seg int, k int, v array<int>, final int", (END, 1), lambda s, r: ((through(r["matrix"], s[0]), 0), {"seg": r["seg"], "k": r["k"], "v": list(s[0]), "final": s[1]}))
    after = sized(cut(after.select(F.col("seg").alias("s"), F.col("k").alias("n"), "v", "final")))
    here = (F.col("seg") == F.col("s")) & (F.col("k") == F.col("n"))

    def explore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [[q for _, q, _ in walk(c, [0, 1, 2, 3], tuple(v))] for c, v in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(got, pa.list_(pa.int32()))], names=["seg", "k", "to"])

    ends = cut(pieces.join(after, here).select("seg", "k", "codes", "v").mapInArrow(explore, "seg int, k int, to array<int>"))
    ends = sized(ends.select(F.col("seg").alias("s"), F.col("k").alias("n"), "to"))

    def forward(state, r):
        q, place, last, high = state
        joint = int(last is not None and last + r["first"] not in ("su", "ua", "au"))
        same = int(r["low"] is not None and r["low"] == high)
        now = (r["to"][q], place + 1, r["last"], high if r["high"] is None else r["high"])
        return now, {"seg": r["seg"], "k": r["k"], "q": q, "place": place, "joint": joint, "same": same}

    entry = _scan(slim.join(ends, here).select(slim["*"], "to"), [F.col("seg").asc(), F.col("k").asc()], "seg int, k int, q int, place int, joint int, same int", (0, 0, None, None), forward)
    entry = cut(entry.select(F.col("seg").alias("s2"), F.col("k").alias("n2"), "q", "place", "joint", "same"))
    known = pieces.join(after, here).join(sized(entry), (F.col("seg") == F.col("s2")) & (F.col("k") == F.col("n2")))
    per = sized(cut(known.groupBy("conv").agg(F.count("*").cast("int").alias("pieces"))).withColumnRenamed("conv", "c"))
    known = known.join(per, F.col("conv").eqNullSafe(F.col("c")))
    keep = ["conv", "place", "pieces", *COUNTS, "low", "high", "distinct"]
    known = known.withColumn("illegal", F.col("illegal") + F.col("joint")).withColumn("distinct", F.col("distinct") - F.col("same"))
    turn_type = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(whole.num_rows):
                b = whole.slice(i, 1)
                r = b.select(["codes", "v", "q", "final", "roles", "texts"]).to_pylist()[0]
                letters, q, cost = walk(r["codes"], [r["q"]], tuple(r["v"]))[0]
                if r["final"]:
                    letters, cost = letters + "I" * (END[q] // INSERT), cost + END[q]
                got = render(letters, r["q"], r["roles"], r["texts"])
                yield pa.record_batch([*[b.column(b.schema.get_field_index(c)) for c in keep], pa.array([cost], pa.int64()), pa.array([letters]), pa.array([got], turn_type)], names=[*keep, "cost", "edits", "turns"])

    kind = pieces.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, place int, pieces int, " + ", ".join(f"{c} long" for c in [*COUNTS, "low", "high", "distinct"]) + f", cost long, edits string, turns {TURNS}"
    return known.select(*keep, "codes", "v", "q", "final", "roles", "texts").mapInArrow(finish, schema)


def digests(repaired: DataFrame, conv: str = "conv_id") -> DataFrame:
    """repaired -> conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of role:text, joined by
    newlines). Conversations of several pieces are hashed as their pieces stream by."""
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    gaps = F.when(F.col("low").isNull(), 0).otherwise(F.col("high") - F.col("low") + 1 - F.col("distinct")).cast("long")
    one = repaired.filter("pieces = 1").select(conv, gaps.alias("gaps"), *COUNTS, "cost", F.col("edits").alias("audit"), F.sha2(lines, 256).alias("repaired_sha256"))
    sums = [*COUNTS, "distinct", "cost"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def done() -> pa.RecordBatch:
            gap = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["distinct"]
            row = [gap, *[now[c] for c in COUNTS], now["cost"], "".join(now["edits"]), now["hash"].hexdigest()]
            return pa.record_batch([now["conv"], *[pa.array([x]) for x in row]], names=[conv, "gaps", *COUNTS, "cost", "audit", "repaired_sha256"])

        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1).to_pylist()[0]
                if now is None or r["place"] == 0:
                    if now is not None:
                        yield done()
                    now = {"conv": b.slice(i, 1).column(0), "low": None, "high": None, "edits": [], "hash": hashlib.sha256(), "any": False} | dict.fromkeys(sums, 0)
                for c in sums:
                    now[c] += r[c]
                now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], now["high"] if r["high"] is None else r["high"]
                now["edits"].append(r["edits"])
                for x in r["turns"]:
                    now["hash"].update((("\n" if now["any"] else "") + x["role"] + ":" + x["text"]).encode())
                    now["any"] = True
        if now is not None:
            yield done()

    several = repaired.filter("pieces > 1").repartition(conv).sortWithinPartitions(F.col(conv).asc_nulls_first(), "place")
    return one.unionByName(several.select(conv, "place", "low", "high", *sums, "edits", "turns").mapInArrow(run, one.schema))
