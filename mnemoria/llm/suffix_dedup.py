"""Removal of repeated byte strings by bucket-pointer refinement.

A byte goes if a LENGTH-byte string that covers it also starts in a document with a smaller id. Sorting all suffixes of
a corpus would move every byte many times over, so refinement is sparse:

1. Initial buckets are Q-grams. Of the Q-grams in each LENGTH-byte window only the least by hash (the anchor) is put in
   its bucket, so equal windows have equal anchors at equal places and meet in one bucket. Buckets with one document
   are dropped.
2. Windows in the buckets that are left are refined: the identifier of 2Q bytes is the pair of the Q-gram identifiers
   at offsets 0 and Q, and the one of LENGTH bytes pairs it with the Q-gram identifier at LENGTH - Q; identifiers of
   earlier steps are used again at every place. All windows with one anchor travel as one short string.
3. The least document of each refined bucket keeps its bytes; windows of others are marked, and texts are cut.

Buckets of over HOT documents are spread: by the strings of windows first, and the windows of the least document of each
string by themselves. Each task passes on only its least document of equal strings, so a passage in very many documents
makes no large bucket. Identifiers are hashes
of 128 bits where equality decides, and of 40 bits and more where they only drop buckets.

Null texts are empty. Texts of under LENGTH bytes lose nothing. Rows with equal ids are one document and don't shorten
each other; a null id is smaller than none and loses nothing. Very long texts are taken whole. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE_A, BASE_B, cut, flat, mix64, planes, small_batches, span_hash, spread, text_batches, unplanes
from .graph import BROADCAST_ROWS

LENGTH, Q = 50, 20
#: Windows that share an anchor at most: the Q-grams of a window.
W = LENGTH - Q + 1
#: Documents of a bucket beyond which its windows are spread.
HOT = 2048
#: Anchors that a task gathers before it passes them on.
GATHER = 400_000
PAIR = np.uint64(0xA0761D6478BD642F)


def gram_ids(buf: np.ndarray, base: int) -> np.ndarray:
    """Identifiers of the Q-grams at all places."""
    at = np.arange(max(len(buf) - Q + 1, 0))
    return span_hash(buf, at, at + Q, base)


def refine(ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Identifiers of the LENGTH-byte strings at starts: of 2Q bytes from two of Q, and so on by later offsets."""
    name, have = ids[starts], Q
    while have < LENGTH:
        step = min(have, LENGTH - have)
        later = ids[starts + have + step - Q] if step <= Q else mix64(ids[starts + have] * PAIR + ids[starts + have + step - Q])
        name = mix64(name * PAIR + later)
        have += min(step, Q)
    return name


def anchors(buf: np.ndarray, off: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, first window, number of windows) of each anchor; the leftmost of equal least Q-grams is taken."""
    n = np.maximum(np.diff(off) - LENGTH + 1, 0)
    text, k = spread(n)
    start = off[:-1][text] + k
    if not len(start):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    value, place, span = ids, np.arange(len(ids)), 1
    while span < W:
        step = min(span, W - span)
        right = value[step:]
        left = value[: len(right)]
        take = right < left
        place = np.where(take, place[step:], place[: len(right)])
        value = np.where(take, right, left)
        span += step
    best = place[start]
    new = np.ones(len(best), bool)
    new[1:] = (best[1:] != best[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    return text[first], best[first], start[first], np.diff(np.r_[first, len(best)])


def bucket_key(ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The part that a Q-gram bucket belongs to, and its key: the part above 40 bits of the identifier."""
    part = ((ids >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return part.astype(np.int64), ((part << np.uint64(40)) | (mix64(ids) & np.uint64((1 << 40) - 1))).astype(np.int64)


def shared_buckets(docs: DataFrame, parts: int) -> DataFrame:
    """docs(id, text) -> id, key, hot: the anchors' buckets that hold at least two documents."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, held = [], [], 0

        def flush() -> pa.RecordBatch | None:
            key, doc = np.concatenate(keys), np.concatenate(ids)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.r_[True, (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])]
            key, doc = key[new], doc[new]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[first, len(key)])
            many = np.repeat(size > HOT, size)  # known to be hot here: one stands for all in the bucket
            lead = np.zeros(len(key), bool)
            lead[first] = True
            go = ~many | lead
            count = np.where(many & lead, np.repeat(size, size), 1)
            rows = []
            for kind, use, part in ((0, go, key >> 40), (1, many, doc % parts)):
                k, d, p, c = key[use], doc[use], part[use], count[use]
                order = np.lexsort((d, p))
                k, d, p, c = k[order], d[order], p[order], c[order]
                edge = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else []
                for i, j in zip(edge, [*edge[1:], len(p)]):
                    rows.append((int(p[i]), kind, planes(k[i:j], 5 if kind == 0 else 8), planes(np.diff(d[i:j], prepend=0), 8), planes(np.minimum(c[i:j], HOT + 1), 2)))
            return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["part", "kind", "keys", "docs", "counts"])

        for x in text_batches(batches, "text"):
            buf, off = flat(x.column(1))
            name = gram_ids(buf, BASE_A)
            text, place, _, _ = anchors(buf, off, name)
            keys.append(bucket_key(name[place], parts)[1])
            ids.append(np.asarray(x.column(0))[text])
            held += len(text)
            if held > GATHER:
                yield flush()
                keys, ids, held = [], [], 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, got = None, []

        def settle():
            key = np.concatenate([g[0] for g in got])
            doc, count = np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])
            order = np.argsort(key, kind="stable")
            key, doc, count = key[order], doc[order], count[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size, total = np.diff(np.r_[first, len(key)]), np.add.reduceat(count, first)
            use = np.repeat(total > 1, size)
            return _batch(doc[use], key[use] | (part << 40), np.repeat(total > HOT, size)[use])

        for x in batches:
            for r in x.to_pylist():
                doc = np.cumsum(unplanes(r["docs"], 8))
                if r["kind"] == 1:
                    yield _batch(doc, unplanes(r["keys"], 8), np.ones(len(doc), bool))
                    continue
                if got and r["part"] != part:
                    yield settle()
                    got = []
                part = r["part"]
                got.append((unplanes(r["keys"], 5), doc, unplanes(r["counts"], 2)))
        if got:
            yield settle()

    def _batch(doc, key, hot):
        return pa.record_batch([pa.array(doc), pa.array(key), pa.array(hot)], names=["id", "key", "hot"])

    dealt = docs.mapInArrow(scatter, "part int, kind int, keys binary, docs binary, counts binary").repartition("part").sortWithinPartitions("kind", "part")
    return dealt.mapInArrow(gather, "id long, key long, hot boolean")


def _super(buf, off, parts):
    """Anchors with their keys, windows and the names of the strings that hold all windows of an anchor."""
    ids = gram_ids(buf, BASE_A)
    text, place, first, n = anchors(buf, off, ids)
    end = first + n + LENGTH - 1
    return text, bucket_key(ids[place], parts)[1], first, n, end, span_hash(buf, first, end, BASE_A), span_hash(buf, first, end, BASE_B)


def _lookup(row: np.ndarray, key: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For each (row, key) its place among the pairs (rows, keys), or -1."""
    if not len(keys):
        return np.full(len(key), -1)
    mixed = mix64(keys.astype(np.uint64) + mix64(rows.astype(np.uint64)))
    order = np.argsort(mixed)
    want = mix64(key.astype(np.uint64) + mix64(row.astype(np.uint64)))
    at = order[np.minimum(np.searchsorted(mixed[order], want), len(order) - 1)]
    return np.where((keys[at] == key) & (rows[at] == row), at, -1)


def _windows(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(string, number) and refined 128-bit identifiers of all windows of short strings."""
    size = np.array([len(s) for s in strings], np.int64)
    buf = np.frombuffer(b"".join(strings), np.uint8)
    who, k = spread(size - LENGTH + 1)
    start = (np.cumsum(size) - size)[who] + k
    return who, k, refine(gram_ids(buf, BASE_A), start), refine(gram_ids(buf, BASE_B), start)


def _first_docs(a, b, doc):
    """For each of the pairs (a, b), the least doc that it has."""
    order = np.lexsort((doc, b, a))
    x, y = a[order], b[order]
    new = np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
    out = np.empty(len(a), doc.dtype)
    out[order] = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    return out


COLUMNS = ["at", "kind", "other", "id", "name", "bit", "text"]


def marks(texts: DataFrame, parts: int) -> DataFrame:
    """texts(id, text, keys, hots, ...) -> id, name, mask: of the strings of windows that have `name` in document id, the
    windows (bits) that a smaller document has too."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in text_batches(batches, "text"):
            buf, off = flat(x.column(1))
            ids = np.asarray(x.column(0))
            lists = x.column(2)
            text, key, first, n, end, a, b = _super(buf, off, parts)
            rows = np.repeat(np.arange(x.num_rows), np.diff(np.asarray(lists.offsets)))
            at = _lookup(text, key, rows, np.asarray(lists.flatten()))
            use = at >= 0
            text, key, first, n, end, a, b, at = (v[use] for v in (text, key, first, n, end, a, b, at))
            hot, doc = np.asarray(x.column(3).flatten().cast(pa.int8()))[at] > 0, ids[text]
            # equal strings of this batch: the least document goes on, the others are settled
            low = _first_docs(a, b, doc)
            done = low < doc
            yield _out(3, doc[done], doc[done], a[done].view(np.int64), bit=(np.int64(1) << n[done]) - 1)
            go = ~done
            _, once = np.unique(np.column_stack([a[go], doc[go].view(np.uint64)]), axis=0, return_index=True)
            k = np.flatnonzero(go)[once]
            cold, warm = k[~hot[k]], k[hot[k]]
            raw = buf.tobytes()
            yield _out(0, doc[cold], key[cold], a[cold].view(np.int64), text=[raw[i:j] for i, j in zip(first[cold], end[cold])])
            yield _out(1, doc[warm], a[warm].view(np.int64), None, b[warm].view(np.int64), text=[raw[i:j] for i, j in zip(first[warm], end[warm])])

    def _out(kind, doc, at, name, other=None, bit=None, text=None):
        """at brings together: 0, strings of one bucket; 1, equal strings (at and other) of a hot bucket; 2, equal windows
        (at and other). 3 is settled: bit has the mask. name is the string's, for 1 it is at."""
        m = len(doc)
        longs = [pa.array(v) if v is not None else pa.nulls(m, pa.int64()) for v in (other, doc, name, bit)]
        return pa.record_batch([pa.array(at), pa.array(np.full(m, kind, np.int32)), *longs, pa.array(text, pa.binary()) if text is not None else pa.nulls(m, pa.binary())], names=COLUMNS)

    def settle(t: pa.Table) -> Iterator[pa.RecordBatch]:
        """Whole buckets of either round; what remains to be done comes out as windows, the rest as masks."""
        kind, at, doc = (np.asarray(t.column(c)) for c in ("kind", "at", "id"))
        some = lambda c, use: t.column(c).take(pa.array(use))
        longs = lambda c, use: np.asarray(some(c, use))
        use = np.flatnonzero(kind == 3)
        yield _out(3, doc[use], at[use], longs("name", use), bit=longs("bit", use))
        use = np.flatnonzero(kind == 2)
        if len(use):
            use = use[_first_docs(at[use], longs("other", use), doc[use]) < doc[use]]
            yield _out(3, doc[use], doc[use], longs("name", use), bit=longs("bit", use))
        use = np.flatnonzero(kind == 1)
        if len(use):
            # the least document of equal strings goes on by window, the others lose the whole string
            done = _first_docs(at[use], longs("other", use), doc[use]) < doc[use]
            size = np.asarray(pc.binary_length(some("text", use))).astype(np.int64) - LENGTH + 1
            yield _out(3, doc[use][done], doc[use][done], at[use][done], bit=(np.int64(1) << size[done]) - 1)
            go = use[~done]
            if len(go):
                who, number, a, b = _windows(some("text", go).to_pylist())
                yield _out(2, doc[go][who], a.view(np.int64), at[go][who], b.view(np.int64), np.int64(1) << number)
        use = np.flatnonzero(kind == 0)
        if len(use):
            who, number, a, b = _windows(some("text", use).to_pylist())
            d = doc[use][who]
            done = _first_docs(a, b, d) < d
            mask = np.zeros(len(use), np.int64)
            np.bitwise_or.at(mask, who[done], np.int64(1) << number[done])
            use, mask = use[mask != 0], mask[mask != 0]
            yield _out(3, doc[use], doc[use], longs("name", use), bit=mask)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for x in batches:
            if not x.num_rows:
                continue
            t = pa.Table.from_batches([x]) if held is None else pa.concat_tables([held, pa.Table.from_batches([x])]).combine_chunks()
            at = np.asarray(t.column("at"))
            last = int(np.searchsorted(at, at[-1]))  # rows are in order of `at`; the last bucket may go on
            if last:
                yield from settle(t.slice(0, last))
            held = t.slice(last)
        if held is not None and held.num_rows:
            yield from settle(held)

    schema = "at long, kind int, other long, id long, name long, bit long, text binary"
    rows = texts.mapInArrow(emit, schema)
    for _ in range(2):  # strings, then windows of hot buckets
        rows = rows.repartition("at").sortWithinPartitions("at").mapInArrow(resolve, schema)
    return rows.select("id", "name", F.col("bit").alias("mask"))


def _whole(x: pa.RecordBatch) -> pa.RecordBatch:
    """Results of texts that lose nothing."""
    none = pa.array(np.zeros(x.num_rows, np.int64))
    empty = pa.ListArray.from_arrays(pa.array(np.zeros(x.num_rows + 1, np.int32)), pa.array([], SPAN))
    return pa.record_batch([x.column(0), x.column(1).cast(pa.binary()), none, none, empty], names=["row", *RESULT])


def _cut_texts(marked: DataFrame, parts: int, characters: bool) -> DataFrame:
    """marked(row, text, names, masks) -> row, kept, n_removed, n_spans, spans. Without names a text is kept whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in text_batches(batches, "text"):
            some = pc.is_valid(x.column(2))
            if not pc.all(some).as_py():
                yield _whole(x.filter(pc.invert(some)))
                x = x.filter(some)
            if not x.num_rows:
                continue
            buf, off = flat(x.column(1))
            text, _, first, n, _, a, _ = _super(buf, off, parts)
            names, masks = x.column(2), np.asarray(x.column(3).flatten())
            rows = np.repeat(np.arange(x.num_rows), np.diff(np.asarray(names.offsets)))
            keys = np.asarray(names.flatten())
            order = np.lexsort((keys, rows))  # masks of one name are joined
            rows, keys, masks = rows[order], keys[order], masks[order]
            new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])])
            masks = np.bitwise_or.reduceat(masks, new)
            at = _lookup(text, a.view(np.int64), rows[new], keys[new])
            who, k = spread(np.where(at >= 0, n, 0))
            start = (first[who] + k)[(masks[at[who]] >> k) & 1 > 0]
            edge = np.zeros(len(buf) + 1, np.int64)
            np.add.at(edge, start, 1)
            np.add.at(edge, start + LENGTH, -1)
            gone = np.cumsum(edge[:-1]) > 0
            drop = gone
            if characters:
                lead = (buf & 0xC0) != 0x80
                drop = np.bitwise_or.reduceat(gone, np.flatnonzero(lead))[np.cumsum(lead) - 1]
            out = []
            for i in range(x.num_rows):
                g, t = gone[off[i] : off[i + 1]], buf[off[i] : off[i + 1]][~drop[off[i] : off[i + 1]]]
                step = np.diff(np.r_[0, g.astype(np.int8), 0])
                spans = [{"start": int(s), "end": int(e)} for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1))]
                out.append((t.tobytes(), int(g.sum()), len(spans), spans))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.list_(SPAN))
            yield pa.record_batch([x.column(0), *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]], names=["row", *RESULT])

    schema = T.StructType([T.StructField("row", marked.schema["row"].dataType), *T._parse_datatype_string("kept binary, n_removed long, n_spans long, spans array<struct<start:long,end:long>>").fields])
    return marked.mapInArrow(run, schema)


RESULT = ["kept", "n_removed", "n_spans", "spans"]
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _copies(plain: DataFrame) -> DataFrame | None:
    """(copy, copy_sha) of texts that a smaller document has whole, if they are few enough to broadcast. All their
    strings are in that document; where they are too many they just take part."""
    names = plain.filter(F.octet_length("text") >= LENGTH).select("id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    first = cut(names.groupBy("sha").agg(F.min("id").alias("first"), F.count("*").alias("n")).filter("n > 1"))
    if (first.agg(F.sum(F.col("n") - 1)).first()[0] or 0) > BROADCAST_ROWS:
        return None
    # no more rows than copies, so it is broadcast, and no text with very many copies is one task's
    found = names.join(F.broadcast(first.select("sha", "first")), "sha").filter("id > first")
    return cut(found.select(F.col("id").alias("copy"), F.col("sha").alias("copy_sha")).distinct())


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None, characters: bool = False) -> DataFrame:
    """docs -> its columns without the text, and n_bytes, kept (the remaining bytes), n_removed, n_spans, spans, which take
    the place of columns of these names.

    characters: also leave out of `kept` what remains of characters of which a byte went, so that it is text.
    parts: into which Q-gram buckets are dealt; a task holds one at a time. Four for each shuffle partition unless
    given."""
    small_batches(docs)
    spark = docs.sparkSession
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in docs.columns if c not in (text_col, "n_bytes", *RESULT)]
    every = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(id_col).cast("long").alias("id"), text.alias("text"))
    copies = _copies(every.filter(F.col("id").isNotNull()).select("id", "text"))
    if copies is None:
        every = every.withColumn("copy", F.lit(False))
    else:
        is_copy = (F.col("id") == F.col("copy")) & (F.sha2(F.col("text").cast("binary"), 256) == F.col("copy_sha"))
        every = every.join(F.broadcast(copies), is_copy, "left").select("row", "id", "text", F.col("copy").isNotNull().alias("copy"))
    # texts move once: both joins by id read one exchange, for which they take the same columns of the same rows
    moved = every.filter(F.col("id").isNotNull() & ~F.col("copy")).select("row", "id", "text")
    buckets = shared_buckets(moved.select("id", "text"), parts).groupBy(F.col("id").alias("i")).agg(F.collect_list("key").alias("keys"), F.collect_list("hot").alias("hots"))
    texts = moved.join(buckets, F.col("id") == F.col("i")).select("id", "text", "keys", "hots", "row")
    found = marks(texts, parts).groupBy(F.col("id").alias("i")).agg(F.collect_list("name").alias("names"), F.collect_list("mask").alias("masks"))
    marked = moved.join(found, F.col("id") == F.col("i"), "left")
    changed = _cut_texts(marked.select(F.struct("row", F.octet_length("text").cast("long").alias("n_bytes")).alias("row"), "text", "names", "masks"), parts, characters)
    changed = changed.select("row.row", "row.n_bytes", *RESULT)
    same = every.filter(F.col("copy") | F.col("id").isNull())
    gone = F.col("copy")
    size, empty = F.octet_length("text").cast("long"), F.array().cast("array<struct<start:long,end:long>>")
    all_of_it = F.array(F.struct(F.lit(0).cast("long").alias("start"), size.alias("end")))
    same = same.select(
        "row", size.alias("n_bytes"), F.when(gone, F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("kept"), F.when(gone, size).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(0).cast("long").alias("n_spans"), F.when(gone, all_of_it).otherwise(empty).alias("spans"),
    )
    return changed.unionByName(same).select("row.*", "n_bytes", *RESULT)
