"""SentencePiece encoding and decoding over a relational lattice.

Distinct words (a run of blanks with what follows it) are encoded once: their substrings of bounded length are exploded
and equi-joined to the piece table; the matching edges are grouped by word; a higher-order aggregate folds the edges
into a segmentation. Texts are then written as their words' ids: all words are sent to every task, or where they are too
many the most frequent, and the others of a text are joined to it.

The fold depends on the model. A unigram model takes the Viterbi fold (largest sum of scores). A BPE model is not a
shortest path: its fold runs over the edges in rank order and merges each edge whose two parts are still whole, which
equals the merge queue unless a merge makes an edge possible that ranks before it; such words are noticed, and take the
first possible edge again and again instead. Characters without a piece become the pieces of their bytes.

Blanks are kept as they are; U+2581 counts as a blank, as in the library. Null and empty texts have no ids and decode to
the empty text. Texts of any length are encoded whole; words of over LONGEST characters are encoded in the task that
finds them (merged by a heap, or their best path), as a bit mask cannot hold their cuts. Repeated rows get equal results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE_A, BASE_B, cut, flat, give_back, small_batches, span_hash, spread, text_batches

BLANK = "▁"
#: Longest word, in characters, whose cuts are held in one long.
LONGEST = 60
#: Most distinct words that are all sent to every task (about 22 bytes each); beyond it, the most frequent are, and the
#: others are joined.
BROADCAST_WORDS = 8_000_000
#: Most words that are sent to every task where others are joined.
FREQUENT_WORDS = 4_000_000


@dataclass
class Pieces:
    """rows: (piece, id, score); bytes_at: id of the piece of byte 0; blobs: the text of every id, blanks as spaces."""

    rows: list[tuple[str, int, float]]
    bytes_at: int
    blobs: list[bytes]
    bpe: bool

    @property
    def longest(self) -> int:
        return max(len(p) for p, _, _ in self.rows)


def load(model_file: str, bpe: bool = True) -> Pieces:
    """Read the piece table of a SentencePiece model with byte fallback."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    rows, blobs, first = [], [], None
    for i in range(m.get_piece_size()):
        p = m.id_to_piece(i)
        if m.is_byte(i):
            first = i if first is None else first
            blobs.append(bytes([int(p[3:5], 16)]))
        elif m.is_control(i) or m.is_unknown(i):
            blobs.append(b"")
        else:
            rows.append((p, i, m.get_score(i)))
            blobs.append(p.replace(BLANK, " ").encode())
    return Pieces(rows, first, blobs, bpe)


def ranked(pieces: Pieces) -> list[tuple[str, int, float, int, bool]]:
    """(piece, id, score, rank, late): rank from the best score, equal for equal scores; late if a part of a split
    ranks behind the piece."""
    scores = {s: r for r, s in enumerate(sorted({s for _, _, s in pieces.rows}, reverse=True))}
    rank = {p: scores[s] for p, _, s in pieces.rows}
    late = lambda p: any(a in rank and b in rank and any(len(c) > 1 and rank[c] >= rank[p] for c in (a, b)) for a, b in ((p[:k], p[k:]) for k in range(1, len(p))))
    return [(p, i, s, rank[p], late(p)) for p, i, s in pieces.rows]


#: Edges travel as one long: rank 20 bits, start and end 7 each, late 1, id 20 (all ones: no piece, bytes).
FULL = (1 << 20) - 1


def lattice(words: DataFrame, pieces: Pieces) -> DataFrame:
    """words(w, more) -> w, more, edges: array of (r rank, i, j, late, ids, s score), best first. Every character has an edge."""
    spark, own = words.sparkSession, words.columns
    table = spark.createDataFrame(ranked(pieces), "p string, id long, s double, r long, late boolean")
    n = F.length("w")
    # edges leave in order of k, so that grouping by it sorts what is in order
    at = words.select(F.monotonically_increasing_id().alias("k"), *own).select("k", *own, F.explode(F.sequence(F.lit(0), n - 1)).alias("i"))
    sub = at.select("k", *own, "i", F.explode(F.sequence(F.col("i") + 1, F.least(n, F.col("i") + pieces.longest))).alias("j"))
    sub = sub.withColumn("p", F.col("w").substr(F.col("i") + 1, F.col("j") - F.col("i")))
    hit = sub.join(F.broadcast(table), "p", "left").filter(F.col("id").isNotNull() | (F.col("j") == F.col("i") + 1))  # the table has the model's size
    bits = F.shiftleft(F.coalesce("r", F.lit(FULL)), 35) + F.shiftleft(F.col("i").cast("long"), 28) + F.shiftleft(F.col("j").cast("long"), 21)
    bits = bits + F.when(F.col("late"), 1 << 20).otherwise(0) + F.coalesce("id", F.lit(FULL))
    if pieces.bpe:
        got = hit.groupBy("k", *own).agg(F.sort_array(F.collect_list(bits)).alias("x"))
        e = lambda x: (x, F.lit(0.0))
    else:
        got = hit.groupBy("k", *own).agg(F.sort_array(F.collect_list(F.struct(bits.alias("b"), F.coalesce("s", F.lit(-1e12)).alias("s")))).alias("x"))
        e = lambda x: (x["b"], x["s"])

    def edge(x):
        b, s = e(x)
        field = lambda at, size: F.shiftright(b, at).bitwiseAND(F.lit((1 << size) - 1)).cast("int")
        i, j, name = field(28, 7), field(21, 7), field(0, 20)
        return F.struct(field(35, 20).alias("r"), i.alias("i"), j.alias("j"), (field(20, 1) == 1).alias("late"), name.alias("id"), s.alias("s"))

    return got.select(*own, F.transform("x", edge).alias("edges"))


def _between(cuts: Column, i: Column, j: Column) -> Column:
    """The cuts strictly between i and j, moved to bit 0."""
    return F.call_function("shiftright", cuts, i + 1).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), j - i - 1) - 1)


def _has(cuts: Column, i: Column) -> Column:
    return F.call_function("shiftright", cuts, i).bitwiseAND(F.lit(1).cast("long")) == 1


def _joins(cuts: Column, e: Column) -> Column:
    return (e["j"] - e["i"] > 1) & _has(cuts, e["i"]) & _has(cuts, e["j"]) & (F.bit_count(_between(cuts, e["i"], e["j"])) == 1)


def _clear(cuts: Column, e: Column) -> Column:
    return cuts.bitwiseXOR(F.call_function("shiftleft", _between(cuts, e["i"], e["j"]), e["i"] + 1))


def fold_bpe(edges: Column, late: Column, n: Column) -> Column:
    """Cuts after all merges, as a mask with bit p for a cut before character p. late: the edges of late pieces."""
    whole = F.call_function("shiftleft", F.lit(1).cast("long"), n + 1) - 1

    def walk(state, e):
        to = _clear(state["c"], e)
        # an edge that a merge makes possible has what was merged as its first or last part
        missed = F.exists(late, lambda x: (x["r"] < e["r"]) & ((x["i"] == e["i"]) | (x["j"] == e["j"])) & _joins(to, x))
        return F.when(_joins(state["c"], e), F.struct(to.alias("c"), (state["missed"] | missed).alias("missed"))).otherwise(state)

    def best(c, _):
        e = F.get(F.filter(edges, lambda x: _joins(c, x)), F.lit(0))
        return F.when(e.isNull(), c).otherwise(_clear(c, e))

    def finish(state):
        return F.when(state["missed"], F.aggregate(F.sequence(F.lit(1), n), whole, best)).otherwise(state["c"])

    return F.aggregate(edges, F.struct(whole.alias("c"), F.lit(False).alias("missed")), walk, finish)


def fold_viterbi(edges: Column, n: Column) -> Column:
    """Cuts of the path with the largest sum of scores: best sum and cuts for every end, edges by their start."""
    by_start = F.array_sort(F.transform(edges, lambda e: F.struct(e["i"].alias("i"), e["j"].alias("j"), e["s"].alias("s"))))
    none = F.struct(F.lit(-1e300).alias("s"), F.lit(1).cast("long").alias("c"))
    start = F.concat(F.array(F.struct(F.lit(0.0).alias("s"), F.lit(1).cast("long").alias("c"))), F.array_repeat(none, n))

    def step(best, e):
        to = F.struct((F.get(best, e["i"])["s"] + e["s"]).alias("s"), F.get(best, e["i"])["c"].bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), e["j"])).alias("c"))
        return F.transform(best, lambda b, k: F.when((k == e["j"]) & (to["s"] > b["s"]), to).otherwise(b))

    return F.get(F.aggregate(by_start, start, step), n)["c"]


def encode_words(words: DataFrame, pieces: Pieces) -> DataFrame:
    """words(w, more), up to LONGEST characters each -> w, more, ids."""
    e = lattice(words, pieces)
    if pieces.bpe:
        # edges of one character cannot join anything
        e = e.withColumn("long", F.filter("edges", lambda x: x["j"] - x["i"] > 1)).withColumn("late", F.filter("edges", lambda x: x["late"]))
        e = e.withColumn("cuts", fold_bpe(F.col("long"), F.col("late"), F.length("w")))
    else:
        e = e.withColumn("cuts", fold_viterbi(F.col("edges"), F.length("w")))
    c = F.col("cuts")
    chosen = F.filter("edges", lambda x: _has(c, x["i"]) & _has(c, x["j"]) & (_between(c, x["i"], x["j"]) == 0))
    in_order = F.array_sort(F.transform(chosen, lambda x: F.struct(x["i"].alias("i"), x["id"].alias("id"))))

    def ids(x):
        code = F.hex(F.encode(F.col("w").substr(x["i"] + 1, F.lit(1)), "utf-8"))
        own = F.transform(F.sequence(F.lit(0), F.length(code).cast("int") - 2, F.lit(2)), lambda k: F.conv(F.substring(code, k + 1, F.lit(2)), 16, 10).cast("int") + pieces.bytes_at)
        return F.when(x["id"] == FULL, own).otherwise(F.array(x["id"]))

    return e.select(*words.columns, F.flatten(F.transform(in_order, ids)).alias("ids"))


def merge_long(word: str, rank: dict[str, tuple[int, int]], bytes_at: int) -> list[int]:
    """The merge queue for one long word: rank has (rank, id) by piece."""
    sym: list[str | None] = list(word)
    left, right = list(range(-1, len(sym) - 1)), list(range(1, len(sym) + 1))
    queue: list[tuple[int, int, str, str]] = []

    def offer(i: int) -> None:
        if 0 <= i and right[i] < len(sym) and (r := rank.get(sym[i] + sym[right[i]])):
            heapq.heappush(queue, (r[0], i, sym[i], sym[right[i]]))

    for i in range(len(sym)):
        offer(i)
    while queue:
        _, i, a, b = heapq.heappop(queue)
        if sym[i] != a or right[i] >= len(sym) or sym[right[i]] != b:
            continue
        k = right[i]
        sym[i], sym[k], right[i] = a + b, None, right[k]
        if right[i] < len(sym):
            left[right[i]] = i
        offer(i)
        offer(left[i])
    return [x for s in sym if s is not None for x in ([rank[s][1]] if s in rank else [bytes_at + v for v in s.encode()])]


def best_path(word: str, scores: dict[str, tuple[float, int]], longest: int, bytes_at: int) -> list[int]:
    """The path with the largest sum of scores over one long word, as fold_viterbi takes it."""
    best = [(0.0, 0)] + [(-1e300, 0)] * len(word)
    for i in range(len(word)):
        for j in range(i + 1, min(len(word), i + longest) + 1):
            s = scores.get(word[i:j], (-1e12, 0) if j == i + 1 else None)
            if s is not None and best[i][0] + s[0] > best[j][0]:
                best[j] = (best[i][0] + s[0], i)
    out, j = [], len(word)
    while j:
        i = best[j][1]
        p = word[i:j]
        out.append([scores[p][1]] if p in scores else [bytes_at + v for v in p.encode()])
        j = i
    return [x for ids in reversed(out) for x in ids]


def long_words(pieces: Pieces):
    """The encoding of words of over LONGEST characters, in the task that finds them: merges, or the best path."""
    bytes_at = pieces.bytes_at
    if pieces.bpe:
        rank = {p: (r, i) for p, i, _, r, _ in ranked(pieces)}
        return lambda w: merge_long(w, rank, bytes_at)
    scores, longest = {p: (s, i) for p, i, s in pieces.rows}, pieces.longest
    return lambda w: best_path(w, scores, longest, bytes_at)


def neighbours(pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of characters stand side by side in a piece: of ASCII as a table, and all as sorted numbers."""
    pairs = {(ord(a) << 21) | ord(b) for p, _, _ in pieces.rows for a, b in zip(p.replace(BLANK, " "), p.replace(BLANK, " ")[1:])}
    every = np.array(sorted(pairs), np.int64)
    a, b = every >> 21, every & ((1 << 21) - 1)
    ascii_ = np.zeros(1 << 14, bool)
    ascii_[((a << 7) | b)[(a < 128) & (b < 128)]] = True
    return ascii_, every


def _cut_words(buf: np.ndarray, off: np.ndarray, beside: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Padded bytes (each text that is not empty after one blank), starts and ends of words, words per text.

    A word ends before a blank, and between two characters that no piece has side by side: no edge crosses there."""
    n = np.diff(off)
    full = n > 0
    out = np.full(len(buf) + int(full.sum()), 32, np.uint8)
    begins = (off[:-1] + np.cumsum(full) - full)[full]
    own = np.ones(len(out), bool)
    own[begins] = False
    out[own] = buf
    blank = out == 32
    first = blank.copy()
    first[1:] &= ~blank[:-1]
    first[begins] = True
    at = np.flatnonzero((out & 0xC0) != 0x80)
    code = np.frombuffer(out.tobytes().decode().encode("utf-32-le"), np.uint32)
    x, y = code[:-1], code[1:]
    known = beside[0][((x << np.uint32(7)) | y) & np.uint32(0x3FFF)]
    wide = np.flatnonzero((x | y) > 127)
    pair = (x[wide].astype(np.int64) << 21) | y[wide]
    known[wide] = beside[1][np.minimum(np.searchsorted(beside[1], pair), len(beside[1]) - 1)] == pair if len(beside[1]) else False
    first[at[1:][~known]] = True
    starts = np.flatnonzero(first)
    ends = np.append(starts[1:], len(out))
    per = np.zeros(len(n), np.int64)
    per[full] = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
    return out, starts, ends, per


def _keys(buf, starts, ends):
    a = span_hash(buf, starts, ends, BASE_A)
    return a, (span_hash(buf, starts, ends, BASE_B) >> np.uint64(32)).astype(np.uint32)


def distinct_words(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """docs(text) -> w, tasks: every distinct word of up to LONGEST characters, blanks as U+2581, and how many tasks had it.

    Words are dealt to more partitions than usual, as a word becomes many substrings and edges there."""
    beside = neighbours(pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(0, np.uint64)  # a task passes each word on once
        for x in text_batches(batches, "text"):
            buf, starts, ends, _ = _cut_words(*flat(x.column(0)), beside)
            name, first = np.unique(span_hash(buf, starts, ends, BASE_A), return_index=True)
            at = np.searchsorted(seen, name)
            new = np.ones(len(name), bool) if not len(seen) else seen[np.minimum(at, len(seen) - 1)] != name
            seen = np.insert(seen, at[new], name[new])
            first, raw = first[new], buf.tobytes()
            w = [raw[i:j].decode().replace(" ", BLANK) for i, j in zip(starts[first].tolist(), ends[first].tolist())]
            yield pa.record_batch([pa.array([v for v in w if len(v) <= LONGEST], pa.string())], names=["w"])

    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return docs.select("text").mapInArrow(run, "w string").repartition(parts, "w").groupBy("w").agg(F.count("*").alias("tasks"))


def _packed(words: DataFrame) -> DataFrame:
    """words(w, tasks, ids) -> a, b, n, ids, tasks as arrays of bytes, 10000 words a row: the words' hashes, numbers of ids,
    ids and numbers of tasks (up to 65535)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                w = [v.replace(BLANK, " ").encode() for v in x.column(0).to_pylist()]
                ends = np.cumsum([len(v) for v in w])
                a, b = _keys(np.frombuffer(b"".join(w), np.uint8), np.r_[0, ends[:-1]], ends)
                ids, tasks = x.column(1), np.minimum(np.asarray(x.column(2)), 65535).astype(np.uint16)
                n, flat_ids = np.diff(np.asarray(ids.offsets)).astype(np.uint8), np.asarray(ids.flatten()).astype(np.uint32)
                yield pa.record_batch([pa.array([v.tobytes()], pa.binary()) for v in (a, b, n, flat_ids, tasks)], names=list(PACKED))

    return words.select("w", "ids", "tasks").mapInArrow(run, ", ".join(f"{c} binary" for c in PACKED))


PACKED = {"a": np.uint64, "b": np.uint32, "n": np.uint8, "ids": np.uint32, "tasks": np.uint16}


def _frequent(packed: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """packed in two: the words of the most tasks, up to `most` (words of equally many tasks stay together), and the others."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            tasks, n = np.unique(np.frombuffer(b"".join(x.column(0).to_pylist()), np.uint16), return_counts=True)
            yield pa.record_batch([pa.array(tasks.astype(np.int64)), pa.array(n)], names=["tasks", "n"])

    least, left = 1 << 16, most
    sizes = packed.select("tasks").mapInArrow(count, "tasks long, n long").groupBy("tasks").agg(F.sum("n").alias("n"))  # up to 65535 rows
    for r in sorted(sizes.collect(), reverse=True):
        left -= r["n"]
        if left < 0:
            break
        least = r["tasks"]

    def part(frequent: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for x in batches:
                for r in x.to_pylist():
                    v = {c: np.frombuffer(r[c], k) for c, k in PACKED.items()}
                    own = (v["tasks"] >= least) == frequent
                    out = [v[c][own if c != "ids" else np.repeat(own, v["n"])].tobytes() for c in PACKED]
                    yield pa.record_batch([pa.array([o], pa.binary()) for o in out], names=list(PACKED))

        return packed.mapInArrow(run, packed.schema)

    return part(True), part(False)


def _unpacked(packed: DataFrame) -> DataFrame:
    """-> a, b, ids (bytes of 32-bit numbers), a row per word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for r in x.to_pylist():
                off = np.r_[0, np.cumsum(np.frombuffer(r["n"], np.uint8), dtype=np.int64) * 4].astype(np.int32)
                ids = pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(off), pa.py_buffer(r["ids"])])
                yield pa.record_batch([pa.array(np.frombuffer(r["a"], np.int64)), pa.array(np.frombuffer(r["b"], np.int32)), ids], names=["a", "b", "ids"])

    return packed.mapInArrow(run, "a long, b int, ids binary")


def _in_order(a: np.ndarray, n: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """An index of words: a in order, with numbers and places of ids, and ids."""
    start = (np.cumsum(n, dtype=np.uint32) - n).astype(np.uint32)
    order = np.argsort(a).astype(np.uint32)
    return a[order], n[order], start[order], ids


def _index(packed: DataFrame, pieces: int) -> tuple[np.ndarray, ...]:
    """The index of all words; gathered part by part, so that the driver holds it once."""
    kinds = {"a": np.uint64, "n": np.uint8, "ids": np.uint16 if pieces <= 1 << 16 else np.uint32}
    size = packed.agg(*[F.coalesce(F.sum(F.length(c)), F.lit(0)).alias(c) for c in kinds]).first()
    got = {c: np.empty(size[c] // np.dtype(PACKED[c]).itemsize, k) for c, k in kinds.items()}
    at = dict.fromkeys(kinds, 0)
    for r in packed.select(*kinds).toLocalIterator():
        for c in kinds:
            v = np.frombuffer(r[c], PACKED[c])
            got[c][at[c] : at[c] + len(v)] = v
            at[c] += len(v)
    return _in_order(**got)


def _encoded(texts: pa.Array, beside: tuple[np.ndarray, np.ndarray], encode_long, *indexes: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end and the n+1 offsets of the texts. Words are looked up in the indexes; only those of over
    LONGEST characters are in none."""
    buf, starts, ends, per = _cut_words(*flat(texts), beside)
    distinct, inverse = np.unique(span_hash(buf, starts, ends, BASE_A), return_inverse=True)
    of, at, count = np.full(len(distinct), -1, np.int8), np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
    for k, (a, n, _, _) in enumerate(indexes):
        if len(a):
            place = np.minimum(np.searchsorted(a, distinct), len(a) - 1)
            here = (a[place] == distinct) & (of < 0)
            of[here], at[here], count[here] = k, place[here], n[place[here]]
    of, at, count = of[inverse], at[inverse], count[inverse]
    long = {int(k): encode_long(bytes(buf[starts[k] : ends[k]]).decode().replace(" ", BLANK)) for k in np.flatnonzero(of < 0)}
    for k, v in long.items():
        count[k] = len(v)
    owner, place = spread(count)
    out, whose = np.zeros(len(owner), np.int32), of[owner]
    for k, (_, _, start, ids) in enumerate(indexes):
        own = np.flatnonzero(whose == k)
        out[own] = ids[start[at[owner[own]]].astype(np.int64) + place[own]]
    first = np.cumsum(count) - count
    for k, v in long.items():
        out[first[k] : first[k] + len(v)] = v
    return out, np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(per)]]


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", broadcast_words: int = BROADCAST_WORDS, decoded: bool = False) -> DataFrame:
    """docs(id, text) -> id, ids array<int>, text (if decoded: what the ids decode to, in the same pass)."""
    small_batches(docs)
    d = docs.select(id_col, F.translate(F.coalesce("text", F.lit("")), BLANK, " ").alias("text"))
    packed, rest = cut(_packed(encode_words(distinct_words(d, pieces), pieces))), None
    if (packed.agg(F.sum(F.length("n"))).first()[0] or 0) > broadcast_words:
        packed, rest = _frequent(packed, min(broadcast_words, FREQUENT_WORDS))
    held = docs.sparkSession.sparkContext.broadcast(_index(packed, len(pieces.blobs)))
    blobs = docs.sparkSession.sparkContext.broadcast(_blobs(pieces))  # the model's size
    beside, encode_long = neighbours(pieces), long_words(pieces)
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>{', text string' if decoded else ''}"

    def rows(ids: pa.Array, texts: pa.Array, *more: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        out, off = _encoded(texts, beside, encode_long, held.value, *more)
        text = [_decoded(out, off, *blobs.value)] if decoded else []
        return pa.record_batch([ids, pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(out)), *text], names=[id_col, "ids", "text"][: 2 + decoded])

    if rest is None:
        return d.mapInArrow(lambda batches: (rows(*x.columns) for x in text_batches(batches, "text")), schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, texts in _unzipped(batches):
            words = x.column(3).flatten()  # of the texts of this batch, whichever
            a, first = np.unique(np.asarray(words.field("a")).view(np.uint64), return_index=True)
            ids, off = flat(words.field("ids").take(pa.array(first)))
            yield rows(x.column(0), texts, _in_order(a, np.diff(off) // 4, ids.view(np.uint32)))

    # the key finds a text's words again; rows and texts that share one have each other's words as well, to no effect
    d = d.select(F.col(id_col).alias("row"), F.xxhash64(id_col, "text").alias("key"), "text")
    words = _rare(d, held, beside).join(_unpacked(rest), ["a", "b"]).select("key", F.struct("a", "ids").alias("word"))
    words = words.repartition("key").groupBy("key").agg(F.collect_list("word").alias("words"))
    got = _zipped(d).join(words, "key", "left")
    return got.select("row", "size", "zipped", F.coalesce("words", F.array().cast(words.schema["words"].dataType))).mapInArrow(run, schema)


def _rare(d: DataFrame, held, beside: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """d(key, text) -> key, a, b: the words of each text that the index hasn't, once a text, by their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value[0]
        for x in text_batches(batches, "text"):
            buf, starts, ends, per = _cut_words(*flat(x.column(1)), beside)
            a, b = _keys(buf, starts, ends)
            before = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
            rare = before[ends] - before[starts] <= LONGEST
            if len(known):
                distinct, inverse = np.unique(a, return_inverse=True)
                rare &= (known[np.minimum(np.searchsorted(known, distinct), len(known) - 1)] != distinct)[inverse]
            at, text = np.flatnonzero(rare), np.repeat(np.arange(x.num_rows), per)[rare]
            at = at[np.lexsort((a[at], text))]  # the texts are in order already
            key, a, b = np.asarray(x.column(0))[text], a[at], b[at]
            new = np.ones(len(at), bool)
            new[1:] = (key[1:] != key[:-1]) | (a[1:] != a[:-1])
            yield pa.record_batch([pa.array(key[new]), pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int32))], names=["key", "a", "b"])

    return d.select("key", "text").mapInArrow(run, "key long, a long, b int")


def _zipped(d: DataFrame) -> DataFrame:
    """d(row, key, text) -> row, key, size, zipped: the texts are shuffled in less room than Spark's own compression leaves them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", 3)
        for x in text_batches(batches, "text"):
            buf, off = flat(x.column(2))
            raw, at = buf.tobytes(), off.tolist()
            zipped = pa.array([codec.compress(raw[i:j], asbytes=True) for i, j in zip(at, at[1:])], pa.binary())
            yield pa.record_batch([x.column(0), x.column(1), pa.array(np.diff(off)), zipped], names=["row", "key", "size", "zipped"])

    return d.select("row", "key", "text").mapInArrow(run, f"row {d.schema['row'].dataType.simpleString()}, key long, size long, zipped binary")


def _unzipped(batches: Iterator[pa.RecordBatch], most: int = 1 << 18) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Rows of _zipped, so many at a time that their texts have about `most` bytes (one longer text stands alone), and the texts."""
    codec = pa.Codec("zstd")
    for b in batches:
        give_back()
        ends, start = np.cumsum(np.asarray(b.column(1))), 0
        while start < b.num_rows:
            end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, "right")))
            x = b.slice(start, end - start)
            texts = [codec.decompress(z.as_buffer(), n, asbytes=True) for z, n in zip(x.column(2), x.column(1).to_pylist())]
            yield x, pa.array(texts, pa.binary())
            start = end
    give_back()


def _blobs(pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts of all ids end to end, their sizes and starts."""
    size = np.array([len(x) for x in pieces.blobs], np.int64)
    return np.frombuffer(b"".join(pieces.blobs), np.uint8), size, np.cumsum(size) - size


def _decoded(ids: np.ndarray, off: np.ndarray, blob: np.ndarray, size: np.ndarray, start: np.ndarray) -> pa.Array:
    """The texts of ids[off[k] : off[k + 1]]."""
    owner, place = spread(size[ids])
    raw = blob[start[ids[owner]] + place].tobytes()
    ends = np.concatenate([[0], np.cumsum(size[ids])])[off].tolist()
    texts = [raw[i:j].decode("utf-8", "replace") for i, j in zip(ends, ends[1:])]
    return pa.array([t[1:] if t[:1] == " " else t for t in texts], pa.string())


def decode(encoded: DataFrame, pieces: Pieces, id_col: str = "doc_id") -> DataFrame:
    """encoded(id, ids) -> id, text: the pieces' texts end to end without the leading blank; bytes that are not UTF-8
    become U+FFFD."""
    held = encoded.sparkSession.sparkContext.broadcast(_blobs(pieces))  # the model's size
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for k in range(0, x.num_rows, 512):
                part = x.slice(k, 512)
                col = part.column(1)
                if col.null_count:
                    col = pa.array([v or [] for v in col.to_pylist()], pa.list_(pa.int32()))
                off = np.asarray(col.offsets).astype(np.int64)
                text = _decoded(np.asarray(col.flatten()).astype(np.int64), off - off[0], *held.value)
                yield pa.record_batch([part.column(0), text], names=[id_col, "text"])

    return encoded.select(id_col, "ids").mapInArrow(run, f"{id_col} {kind}, text string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def session_pieces(spark: SparkSession, model_file: str | None = None) -> Pieces:
    return load(model_file or default_model())
