"""Removal of repeated passages by prefix-partitioned suffix trees over words.

A word goes if a window of LENGTH words that covers it also starts anywhere else, in its own text too. All suffixes of a
corpus would move each word many times over, so the trees hold sampled suffixes:

1. Of the Q-word prefixes in each window only the least by hash is taken; equal windows have equal ones. The windows that
   follow each other with one such prefix travel as one string, known by its hash. Strings meet by prefix: those that
   occur twice are repeats as a whole, a prefix with a single string is a shallow leaf and dropped, and of a prefix with
   several strings one of each goes on.
2. Prefixes of variable length split the suffixes that are left into groups for a task's memory: a prefix with up to HOT
   strings is one group; beyond it the prefix of each window is lengthened to the whole window.
3. A group's subtree is built from its root down, STEPS words at a time: suffixes that agree so far stay together, lone
   ones are leaves. Nodes of depth LENGTH are the repeats; their windows are marked, and texts are cut.

Tasks count equal strings and windows before they pass one on, so a passage in very many documents makes no large group.
Equality is decided by hashes of 64 bits within a prefix and of 128 bits beyond one.

Words are runs of bytes other than ASCII white space. Null texts have no words; texts of under LENGTH words lose nothing.
Rows, not ids, are documents: rows with equal or null ids repeat each other's passages. Very long texts are taken whole.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE_A, BASE_B, _powers, flat, mix64, planes, small_batches, span_hash, spread, text_batches, unplanes

LENGTH, Q = 35, 8
#: Prefixes in a window, and most windows of a string.
W, RUN = LENGTH - Q + 1, 48
#: Words by which a subtree's nodes are parted; their sum is LENGTH.
STEPS = (9, 9, 9, 8)
#: Strings of a prefix beyond which it is lengthened.
HOT = 2048
#: Strings that a task gathers before it passes them on.
GATHER = 400_000
#: Longer words travel as their hashes.
LONG_WORD = 40
#: What is known of a string with the count: it repeats itself, its prefix is hot.
COUNT, INNER, MANY = 3, 4, 8


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words up to each text."""
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.r_[True, blank] | edge  # at a place: the byte before is no word's of this text
    start = np.flatnonzero(~blank & before[:-1])
    after = np.r_[blank, True] | edge
    end = np.flatnonzero(~blank & after[1:]) + 1
    return start, end, np.searchsorted(start, off)


def sequence_hash(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """64-bit hashes of ids[start:end]."""
    up, down = _powers(base, len(ids) + 1)
    sums = np.zeros(len(ids) + 1, np.uint64)
    np.cumsum((ids | np.uint64(1)) * up[: len(ids)], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


class Strings:
    """The strings of a batch of texts: runs of windows with one least prefix. Places count words."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        self.buf, self.off = buf, off
        self.start, self.end, self.upto = words(buf, off)
        self.a = span_hash(buf, self.start, self.end, BASE_A)
        n = np.maximum(np.diff(self.upto) - LENGTH + 1, 0)
        text, k = spread(n)
        at = self.upto[:-1][text] + k  # of all windows
        if not len(at):
            self.text = self.first = self.n = np.zeros(0, np.int64)
            self.prefix = self.name = np.zeros(0, np.uint64)
            self.inner = np.zeros(0, bool)
            return
        grams = np.arange(len(self.a) - Q + 1)
        value, place, span = sequence_hash(self.a, grams, grams + Q, BASE_A), grams, 1
        while span < W:  # the leftmost of the least prefixes, over twice as many places each time
            more = min(span, W - span)
            take = value[more:] < value[:-more]
            place = np.where(take, place[more:], place[:-more])
            value = np.where(take, value[more:], value[:-more])
            span += more
        value, place = value[at], place[at]
        new = np.r_[True, (value[1:] != value[:-1]) | (text[1:] != text[:-1])]
        run = np.flatnonzero(new)
        new |= (np.arange(len(at)) - run[np.cumsum(new) - 1]) % RUN == 0
        run = np.flatnonzero(new)
        self.text, self.first, self.prefix, self.n = text[run], at[run], value[run], np.diff(np.r_[run, len(at)])
        # a window that comes again within a string has its prefix there twice
        moved = np.r_[False, place[1:] != place[:-1]] & ~new
        self.inner = np.add.reduceat(moved, run) > 0
        self.name = sequence_hash(self.a, self.first, self.first + self.n + LENGTH - 1, BASE_A)

    def bytes_of(self, which: np.ndarray) -> list[bytes]:
        """Strings as their words, each with a blank behind it."""
        owner, k = spread(self.n[which] + LENGTH - 1)
        w = self.first[which][owner] + k
        raw, size = self.buf.tobytes(), self.end - self.start
        long = {int(i) for i in np.unique(w[size[w] > LONG_WORD])}
        b = span_hash(self.buf, self.start[list(long)], self.end[list(long)], BASE_B) if long else []
        short = {i: b"\x00%016x%016x" % (int(self.a[i]), int(x)) for i, x in zip(long, b)}
        said = [short[i] if i in short else raw[s:e] for i, s, e in zip(w.tolist(), self.start[w].tolist(), self.end[w].tolist())]
        ends = np.cumsum(self.n[which] + LENGTH - 1).tolist()
        return [b" ".join(said[i:j]) + b" " for i, j in zip([0, *ends], ends)]


def _lookup(row: np.ndarray, name: np.ndarray, rows: np.ndarray, names: np.ndarray) -> np.ndarray:
    """For each (row, name) its place among the pairs (rows, names), or -1."""
    if not len(names):
        return np.full(len(name), -1)
    mixed = mix64(names.astype(np.uint64) + mix64(rows.astype(np.uint64)))
    order = np.argsort(mixed)
    want = mix64(name.astype(np.uint64) + mix64(row.astype(np.uint64)))
    at = order[np.minimum(np.searchsorted(mixed[order], want), len(order) - 1)]
    return np.where((names[at] == name) & (rows[at] == row), at, -1)


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by the columns, and which of the ordered rows begin a group of equal ones."""
    order = np.lexsort(columns[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, new


#: What becomes of a string of a document: all its windows are repeats; its windows are to be compared, in its prefix's
#: group or each in its own.
SETTLED, GROUP, ALONE = 0, 1, 2


def meet(docs: DataFrame, parts: int) -> DataFrame:
    """docs(key, text) -> key, name, todo: the strings that are repeated, or may have repeated windows."""

    def out(key, name, todo) -> pa.RecordBatch:
        todo = np.full(len(key), todo, np.int32) if np.isscalar(todo) else todo.astype(np.int32)
        return pa.record_batch([pa.array(key), pa.array(name.view(np.int64)), pa.array(todo)], names=["key", "name", "todo"])

    def packed(prefix, name, key, count, kind, part) -> list[tuple]:
        order = np.lexsort((name, prefix, part))
        prefix, name, key, count, part = (v[order] for v in (prefix, name, key, count, part))
        edge = np.flatnonzero(np.r_[True, part[1:] != part[:-1]]) if len(part) else []
        plain = lambda v, w: planes(v.view(np.int64), w)
        return [(int(part[i]), kind, plain(np.diff(prefix[i:j], prepend=np.uint64(0)), 8), plain(name[i:j], 8), plain(key[i:j], 8), count[i:j].astype(np.uint8).tobytes()) for i, j in zip(edge, [*edge[1:], len(part)])]

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0

        def flush() -> pa.RecordBatch:
            prefix, name, key, inner = (np.concatenate(v) for v in zip(*got))
            order, new = _groups(prefix, name)
            prefix, name, key, inner = (v[order] for v in (prefix, name, key, inner))
            first = np.flatnonzero(new)
            size = np.diff(np.r_[first, len(new)])
            count = np.minimum(size, 2) + INNER * np.maximum.reduceat(inner, first)
            settled = np.repeat(size > 1, size) & ~new  # the first goes on and is settled where strings meet
            prefix, one, one_key = prefix[first], name[first], key[first]
            begin = np.r_[True, prefix[1:] != prefix[:-1]]
            start = np.flatnonzero(begin)
            strings = np.diff(np.r_[start, len(prefix)])
            many = np.repeat(strings > HOT, strings)  # known to be hot here: one stands for all
            count = count + MANY * (many & begin)
            go = ~many | begin
            part = lambda x: (mix64(x) % np.uint64(parts)).astype(np.int64)
            rows = packed(prefix[go], one[go], one_key[go], count[go], 0, part(prefix[go]))
            rows += packed(prefix[~go], one[~go], one_key[~go], count[~go], 1, part(one[~go]))
            rows += packed(np.zeros(int(settled.sum()), np.uint64), name[settled], key[settled], np.zeros(int(settled.sum()), np.int64), 2, part(key[settled].view(np.uint64)))
            return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int32(), *[pa.binary()] * 4))], names=["part", "kind", "prefixes", "names", "keys", "counts"])

        for x in text_batches(batches, "text"):
            s = Strings(*flat(x.column(1)))
            got.append((s.prefix, s.name, np.asarray(x.column(0))[s.text], s.inner))
            held += len(s.text)
            if held > GATHER:
                yield flush()
                got, held = [], 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, got = None, []

        def settle() -> Iterator[pa.RecordBatch]:
            prefix, name, key, count = (np.concatenate(v) for v in zip(*got))
            order, new = _groups(prefix, name)
            prefix, name, key, count = (v[order] for v in (prefix, name, key, count))
            first = np.flatnonzero(new)
            times, inner = np.add.reduceat(count & COUNT, first), np.maximum.reduceat(count & INNER, first)
            twice = np.repeat(times > 1, np.diff(np.r_[first, len(new)]))
            yield out(key[twice], name[twice], SETTLED)
            prefix, hot = prefix[first], np.maximum.reduceat(count & MANY, first) > 0
            start = np.flatnonzero(np.r_[True, prefix[1:] != prefix[:-1]])
            strings = np.diff(np.r_[start, len(prefix)])
            known = np.repeat((np.maximum.reduceat(hot, start) > 0) | (strings > HOT), strings)
            go = np.repeat(strings > 1, strings) | known | ((inner > 0) & (times == 1))
            yield out(key[first][go], name[first][go], np.where(known, ALONE, GROUP)[go])

        for b in batches:
            for r in b.to_pylist():
                prefix, name, key = (unplanes(r[c], 8).view(np.uint64) for c in ("prefixes", "names", "keys"))
                count = np.frombuffer(r["counts"], np.uint8).astype(np.int64)
                key = key.view(np.int64)
                if r["kind"]:
                    if r["kind"] == 1:
                        twice = (count & COUNT) > 1
                        yield out(key[twice], name[twice], SETTLED)
                    yield out(key, name, ALONE if r["kind"] == 1 else SETTLED)
                    continue
                if got and r["part"] != now:
                    yield from settle()
                    got = []
                now = r["part"]
                got.append((np.cumsum(prefix, dtype=np.uint64), name, key, count))
        if got:
            yield from settle()

    dealt = docs.mapInArrow(scatter, "part int, kind int, prefixes binary, names binary, keys binary, counts binary").repartition("part").sortWithinPartitions("kind", "part")
    return dealt.mapInArrow(gather, "key long, name long, todo int")


def deep(group: np.ndarray, ids: tuple[np.ndarray, np.ndarray], start: np.ndarray) -> np.ndarray:
    """Which suffixes (words ids[start:] of the subtree `group`) are below a node of depth LENGTH.

    From the root of each subtree down: the next words part the suffixes of a node, and those that are alone are leaves."""
    live, node, depth = np.arange(len(start)), group, 0
    for words_ in STEPS:
        if not len(live):
            break
        at = start[live] + depth
        order, new = _groups(node, *[sequence_hash(i, at, at + words_, base) for i, base in zip(ids, (BASE_A, BASE_B))])
        number = np.cumsum(new) - 1
        some = np.bincount(number)[number] > 1
        live, node, depth = live[order][some], number[some].astype(np.uint64), depth + words_
    out = np.zeros(len(start), bool)
    out[live] = True
    return out


COLUMNS = ["at", "kind", "other", "key", "name", "bit", "text"]


def marks(texts: DataFrame) -> DataFrame:
    """texts(key, text, names, todos, ...) -> key, name, mask: windows (bits) of strings that are repeats."""

    def rows(kind, key, at, name, other=None, bit=None, text=None) -> pa.RecordBatch:
        """at brings together: kind GROUP, strings of one prefix; ALONE, equal windows (at and other). SETTLED rows are
        done: bit has the mask."""
        m = len(key)
        longs = [pa.array(v) if v is not None else pa.nulls(m, pa.int64()) for v in (other, key, name, bit)]
        return pa.record_batch([pa.array(at), pa.array(np.full(m, kind, np.int32)), *longs, pa.array(text, pa.binary()) if text is not None else pa.nulls(m, pa.binary())], names=COLUMNS)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in text_batches(batches, "text"):
            s, keys, lists = Strings(*flat(x.column(1))), np.asarray(x.column(0)), x.column(2)
            of = np.repeat(np.arange(x.num_rows), np.diff(np.asarray(lists.offsets)))
            found = _lookup(s.text, s.name, of, np.asarray(lists.flatten()).view(np.uint64))
            todo = np.where(found >= 0, np.asarray(x.column(3).flatten())[found] if len(of) else 0, SETTLED)
            use = np.flatnonzero(todo == GROUP)
            _, new = np.unique(np.column_stack([s.name[use], s.text[use].astype(np.uint64)]), axis=0, return_index=True)
            use = use[new]
            yield rows(GROUP, keys[s.text[use]], s.prefix[use].view(np.int64), s.name[use].view(np.int64), text=s.bytes_of(use))
            use = np.flatnonzero(todo == ALONE)
            if not len(use):
                continue
            b = span_hash(s.buf, s.start, s.end, BASE_B)
            who, k = spread(s.n[use])
            at = s.first[use][who] + k
            a, b = sequence_hash(s.a, at, at + LENGTH, BASE_A), sequence_hash(b, at, at + LENGTH, BASE_B)
            key, name, bit = keys[s.text[use]][who], s.name[use][who].view(np.int64), np.int64(1) << k
            order, new = _groups(a, b)
            size = np.diff(np.r_[np.flatnonzero(new), len(new)])
            twice = order[np.repeat(size > 1, size)]
            yield rows(SETTLED, key[twice], key[twice], name[twice], bit=bit[twice])
            go = order[new]
            yield rows(ALONE, key[go], a[go].view(np.int64), name[go], b[go].view(np.int64), bit[go])

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole groups."""
        kind, at, key = (np.asarray(t.column(c)) for c in ("kind", "at", "key"))
        some = lambda c, use: t.column(c).take(pa.array(use))
        longs = lambda c, use: np.asarray(some(c, use))
        use = np.flatnonzero(kind == SETTLED)
        yield rows(SETTLED, key[use], at[use], longs("name", use), bit=longs("bit", use))
        use = np.flatnonzero(kind == ALONE)
        if len(use):
            order, new = _groups(at[use], longs("other", use))
            size = np.diff(np.r_[np.flatnonzero(new), len(new)])
            use = use[order[np.repeat(size > 1, size)]]
            yield rows(SETTLED, key[use], key[use], longs("name", use), bit=longs("bit", use))
        use = np.flatnonzero(kind == GROUP)
        if len(use):
            buf, off = flat(some("text", use))
            start, end, upto = words(buf, off)
            ids = tuple(span_hash(buf, start, end, base) for base in (BASE_A, BASE_B))
            who, k = spread(np.diff(upto) - LENGTH + 1)
            found = deep(at[use].view(np.uint64)[who], ids, upto[:-1][who] + k)
            mask = np.zeros(len(use), np.int64)
            np.bitwise_or.at(mask, who[found], np.int64(1) << k[found])
            use, mask = use[mask != 0], mask[mask != 0]
            yield rows(SETTLED, key[use], key[use], longs("name", use), bit=mask)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for x in batches:
            if not x.num_rows:
                continue
            t = pa.Table.from_batches([x]) if held is None else pa.concat_tables([held, pa.Table.from_batches([x])]).combine_chunks()
            at = np.asarray(t.column("at"))
            last = int(np.searchsorted(at, at[-1]))  # rows are in order of `at`; the last group may go on
            if last:
                yield from settle(t.slice(0, last))
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield from settle(held)

    schema = "at long, kind int, other long, key long, name long, bit long, text binary"
    return texts.mapInArrow(emit, schema).repartition("at").sortWithinPartitions("at").mapInArrow(resolve, schema).select("key", "name", F.col("bit").alias("mask"))


RESULT = ["n_words", "n_removed", "kept", "spans"]
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _cut_texts(marked: DataFrame) -> DataFrame:
    """marked(row, text, names, masks) -> row, n_words, n_removed, kept, spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in text_batches(batches, "text"):
            buf, off = flat(x.column(1))
            lists = x.column(2)
            if not len(lists.flatten()):
                start, end, upto = words(buf, off)
                gone = np.zeros(len(start), bool)
            else:
                s = Strings(buf, off)
                start, end, upto = s.start, s.end, s.upto
                masks = np.asarray(x.column(3).flatten())
                of = np.repeat(np.arange(x.num_rows), np.diff(np.asarray(lists.offsets)))
                names = np.asarray(lists.flatten()).view(np.uint64)
                edge = np.zeros(len(start) + 1, np.int64)
                order, new = _groups(of, names)  # masks of one name are joined
                of, names, masks = of[order][new], names[order][new], np.bitwise_or.reduceat(masks[order], np.flatnonzero(new))
                found = _lookup(s.text, s.name, of, names)
                who, k = spread(np.where(found >= 0, s.n, 0))
                first = (s.first[who] + k)[(masks[found[who]] >> k) & 1 > 0]
                np.add.at(edge, first, 1)
                np.add.at(edge, first + LENGTH, -1)
                gone = np.cumsum(edge[:-1]) > 0
            # kept words, a blank before each but a text's first
            keep = np.flatnonzero(~gone)
            owner, k = spread((end - start)[keep] + 1)
            data = np.full(len(owner), 32, np.uint8)
            body = k > 0
            data[body] = buf[(start[keep][owner] + k - 1)[body]]
            ends = np.r_[0, np.cumsum((end - start)[keep] + 1)][np.searchsorted(keep, upto)].tolist()
            raw, out = data.tobytes(), []
            for i in range(x.num_rows):
                g = gone[upto[i] : upto[i + 1]]
                turn = np.diff(np.r_[0, g.astype(np.int8), 0])
                spans = [{"start": int(p), "end": int(q)} for p, q in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1))]
                out.append((len(g), int(g.sum()), raw[ends[i] + 1 : ends[i + 1]].decode(), spans))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.list_(SPAN))
            yield pa.record_batch([x.column(0), *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]], names=["row", *RESULT])

    schema = T.StructType([T.StructField("row", marked.schema["row"].dataType), *T._parse_datatype_string("n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>").fields])
    return marked.mapInArrow(run, schema)


def cut_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """docs -> its columns without the text, and n_words, n_removed, kept (the words that are left, joined by blanks) and
    spans (maximal runs of removed words, by number), which take the place of columns of these names.

    parts: into which prefixes are dealt; a task holds one at a time. Four for each shuffle partition unless given."""
    small_batches(docs)
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in docs.columns if c not in (text_col, *RESULT)]
    # the key joins marks to texts; strings are known by their content, so that rows may share a key
    text = F.coalesce(F.col(text_col), F.lit(""))
    moved = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), text.alias("text"), F.xxhash64(id_col, text_col).alias("key"))
    found = meet(moved.select("key", "text"), parts)
    todo = found.filter(F.col("todo") > SETTLED).groupBy(F.col("key").alias("i")).agg(F.collect_list("name").alias("names"), F.collect_list("todo").alias("todos"))
    texts = moved.join(todo, F.col("key") == F.col("i")).select("key", "text", "names", "todos", "row")
    whole = found.filter(F.col("todo") == SETTLED).select("key", "name", F.lit((1 << RUN) - 1).cast("long").alias("mask"))
    masks = marks(texts).unionByName(whole).groupBy(F.col("key").alias("i")).agg(F.collect_list("name").alias("names"), F.collect_list("mask").alias("masks"))
    marked = moved.join(masks, F.col("key") == F.col("i"), "left")
    lists = [F.coalesce(c, F.array().cast("array<long>")).alias(c) for c in ("names", "masks")]
    return _cut_texts(marked.select("row", "text", *lists)).select("row.*", *RESULT)
