"""N-gram Jaccard join with parity sketches.

A document is the set of its word shingles, as 64-bit hashes. A set is dealt by hash to m parts and each part becomes the
XOR of its hashes: a parity sketch of 64-bit cells. Two sketches differ in at most |A xor B| cells, and sets that link
differ in at most k elements, k known from their sizes; so with over k cells that are not empty one of them agrees
(pigeonhole). m and k are set per band of sizes; a document joins the band of its size and, near the lower end, the band
below. Of each sketch only the first k + 1 + 2 * SPARE cells that are not empty are joined: in the one of two whose last
such cell comes first, all but k agree with the other, which gives them too. So each document may leave out its SPARE
most common cells and still meet its partners; this drops cells of passages that very many documents share.

Documents that share cells are a family: each member of a cell is tied to the cell's first one. Pairs that link are in
one family, so families are dealt to tiles of bounded size and each tile verifies its pairs on whole texts, unites what
links and passes on a spanning forest only: less links than rows. The nearest pairs by bit sketches (their Hamming
distance is a lower bound of |A xor B| too) come first. A family of over one tile goes through one pass in which each
tile also has the family's first document, and then its largest component so far is compared with the rest, tile by tile,
by bit sketches before texts are moved. Where that would send more rows than the family's cells have, cells are compared
instead of families. Both ways find the same components. Equal sets are one class from the start.

The pigeonhole needs over k cells that are not empty in one of the two sets. m leaves more than that, which most sets
fill by far, but small sets can crowd into few cells. A set that fills no more than k cells of a band therefore also
gives its least hashes there, as keys under names of their own: sets that link share at least ceil(num / den * n) of n
hashes, so of the n - ceil(num / den * n) + 1 least ones of each, one is common. A pair that shares no cell fills at most
k cells on both sides, so both give these keys, and no link is lost but for equal 64-bit hashes.

Null or empty texts have no shingles and link with nothing. Very long texts are taken whole. Rows with equal ids are one
document that has the links of all its texts; a null id links with nothing and has a null component. An empty table
gives an empty result. Further columns are not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BASE_A, cut, flat, mix64, planes, small_batches, span_hash, spread, text_batches, unplanes
from .graph import components, sized

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Odd multipliers for the words of a shingle.
FACTORS = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: Cells that each of two documents may leave out.
SPARE = 4
#: Rows of a cell among GATHER rows of a task beyond which they pass by the task that gathers the cell.
HOT, GATHER = 128, 500_000
#: Size given to such a cell: larger than all others.
HUGE = (1 << 31) - 1
#: Rows a side of a tile, each of up to ROW shingles (larger ones count as several).
TILE, ROW = 512, 2048


def shingles(buf: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the distinct k-word shingles, in order; a text of fewer words is one shingle."""
    buf = LOWER[buf]
    word = ~SPACE[buf]
    edge = np.zeros(len(buf) + 1, bool)
    edge[off] = True
    before = np.zeros(len(buf), bool)
    before[1:] = word[:-1]
    starts = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.zeros(len(buf), bool)
    after[:-1] = word[1:]
    ends = np.flatnonzero(word & (~after | edge[1:])) + 1
    h = span_hash(buf, starts, ends, BASE_A)
    per = np.diff(np.searchsorted(starts, off))
    first = np.cumsum(per) - per
    n = np.where(per >= k, per - k + 1, (per > 0).astype(np.int64))
    owner, place = spread(n)
    at = first[owner] + place
    total = np.zeros(len(owner), np.uint64)
    for j in range(k):
        inside = j < per[owner]
        total[inside] += h[at[inside] + j] * FACTORS[j]
    total = mix64(total + np.minimum(per[owner], k).astype(np.uint64))
    order = np.lexsort((total, owner))
    owner, total = owner[order], total[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (total[1:] != total[:-1])
    return owner[new], total[new]


def bands(most: int, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(least size, least size of the next band, largest size of a partner, cells) up to sets of `most` elements, for
    links with den * intersection >= num * union."""
    out, low = [], 1
    while low <= most:
        high = max(low + 1, low * den * den // (num * num))
        union = (high - 1) * den // num  # of two sets of which the smaller has under high elements
        k = union * (den - num) // den
        out.append((low, high, union, k + 12 + k // 4))
        low = high
    return out


def _set_hash(owner: np.ndarray, h: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = np.bincount(owner, minlength=texts)
    a, b = np.zeros(texts, np.uint64), np.zeros(texts, np.uint64)
    np.add.at(a, owner, mix64(h))
    np.add.at(b, owner, mix64(h ^ np.uint64(BASE_A)))
    return n, a, b


def sets(docs: DataFrame, k: int) -> DataFrame:
    """docs(id, text) -> id, n, a, b: size and 128-bit name of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in text_batches(batches, "text"):
            n, a, b = _set_hash(*shingles(*flat(x.column(1)), k), x.num_rows)
            yield pa.record_batch([x.column(0), pa.array(n.astype(np.int64)), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["id", "n", "a", "b"])

    return docs.mapInArrow(run, "id long, n long, a long, b long")


def cells(docs: DataFrame, k: int, num: int, den: int, parts: int) -> DataFrame:
    """docs(id, text) -> cell, x, y, band, spare, size: the cells with at least two documents x, and their first y.

    A task packs its cells by part of the cells' names, sorted, and one task gathers a part. Cells that very many of a
    task's rows have pass by, tied to the task's first document of the cell, which stands for them."""

    def scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for x in text_batches(batches, "text"):
            ids = np.asarray(x.column(0))
            name, text, band, spare = _own_cells(ids, *flat(x.column(1)), k, num, den)
            part = ((name >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
            key = (part << np.uint64(40)) | (mix64(name) & np.uint64((1 << 40) - 1))
            got.append((key.view(np.int64), ids[text], (band % 8 * 8 + spare).astype(np.uint8)))
            held += len(name)
            if held > GATHER:
                yield _pack(*map(np.concatenate, zip(*got)), parts)
                got, held = [], 0
        if held:
            yield _pack(*map(np.concatenate, zip(*got)), parts)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, got = None, []
        for x in batches:
            for r in x.to_pylist():
                ids, code = unplanes(r["ids"], 8), np.frombuffer(r["codes"], np.uint8)
                if r["kind"] == 1:
                    yield _members(unplanes(r["keys"], 8), ids, unplanes(r["leads"], 8), code, np.full(len(ids), HUGE, np.int32))
                    continue
                if got and r["part"] != part:
                    yield _shared(part, *map(np.concatenate, zip(*got)))
                    got = []
                part = r["part"]
                got.append((unplanes(r["keys"], 5), ids, code))
        if got:
            yield _shared(part, *map(np.concatenate, zip(*got)))

    dealt = docs.mapInArrow(scatter, "part int, kind int, keys binary, ids binary, leads binary, codes binary")
    return dealt.repartition("part").sortWithinPartitions("kind", "part").mapInArrow(gather, "cell long, x long, y long, band int, spare int, size int")


def _own_cells(ids, buf, off, k: int, num: int, den: int):
    """(name, text, band, spare) of the cells of some texts, once for equal sets.

    A linking pair shares at least as many cells as one of the two gives over k; spare is half of that less one, rounded
    down: so many cells each of the two may leave out, and they still meet. Sets with no more than k cells have no spare
    and give their least hashes too."""
    owner, h = shingles(buf, off, k)
    n, a, _ = _set_hash(owner, h, len(ids))
    out = [(np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)]
    if n.any():
        order = np.lexsort((ids, a))
        once = np.ones(len(ids), bool)
        # copies under one id are dropped, others too: equal sets are tied by their names
        once[order[1:]] = a[order[1:]] != a[order[:-1]]
        first, plan = np.cumsum(n) - n, bands(int(n.max()), num, den)
        low, _, top, m = (np.array(v, np.int64) for v in zip(*plan))
        own = np.searchsorted(low, n, "right") - 1
        for back in range(3):
            band = own - back
            use = np.flatnonzero(once & (n > 0) & (band >= 0) & ((back == 0) | (n <= top[np.maximum(band, 0)])))
            if not len(use):
                continue
            who, place = spread(n[use])
            e = h[first[use][who] + place]
            count, most = m[band[use]], top[band[use]] * (den - num) // den
            base = np.cumsum(count) - count
            part = ((mix64(e ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * count[who].astype(np.uint64)) >> np.uint64(32)
            at = base[who] + part.astype(np.int64)
            xor, filled = np.zeros(int(count.sum()), np.uint64), np.zeros(int(count.sum()), bool)
            np.bitwise_xor.at(xor, at, e)
            filled[at] = True
            holder, number = spread(count)
            upto = np.cumsum(filled)
            upto -= (upto - filled)[base][holder]
            given = filled & (upto <= (most + 1 + 2 * SPARE)[holder])
            name = mix64(xor + mix64((band[use][holder] * (1 << 32) + number).astype(np.uint64)))[given]
            at = holder[given]
            over = np.bincount(at, minlength=len(use)) - most
            spare = np.maximum(over - 1, 0) // 2
            # the hashes of a text ascend; one of its first few is also among the first few of each partner
            few = (over[who] <= 0) & (place < (n[use] - -(-n[use] * num // den) + 1)[who])
            name = np.concatenate([name, mix64(e[few] + mix64((band[use][who[few]] + (1 << 62)).astype(np.uint64)))])
            at = np.concatenate([at, who[few]])
            out.append((name, use[at], band[use][at], spare[at]))
    return tuple(map(np.concatenate, zip(*out)))


def _pack(key, ids, code, parts: int) -> pa.RecordBatch:
    """Rows of cells as one packed row a part: kind 0 goes to the task of the part, kind 1 (all but the first of hot cells)
    passes by, dealt by id."""
    order = np.lexsort((ids, key))
    key, ids, code = key[order], ids[order], code[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    hot, lead = np.repeat(size > HOT, size), np.repeat(first, size)
    code = np.where(hot, code | 128, code).astype(np.uint8)
    aside = hot & (lead != np.arange(len(key)))
    rows = []
    for kind, use, part in ((0, ~aside, key >> 40), (1, aside, ids % parts)):
        at = np.flatnonzero(use)
        at = at[np.argsort(part[at], kind="stable")]
        p = part[at]
        edge = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else []
        for i, j in zip(edge, [*edge[1:], len(p)]):
            rows.append((int(p[i]), kind, planes(key[at[i:j]], 8 if kind else 5), planes(ids[at[i:j]], 8), planes(ids[lead[at[i:j]]], 8) if kind else b"", code[at[i:j]].tobytes()))
    kinds = (pa.int32(), pa.int32(), *[pa.binary()] * 4)
    return pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows), kinds)], names=["part", "kind", "keys", "ids", "leads", "codes"])


def _members(cell, x, y, code, size) -> pa.RecordBatch:
    code = code.astype(np.int32)
    longs = [pa.array(np.ascontiguousarray(v).astype(np.int64)) for v in (cell, x, y)]
    return pa.record_batch([*longs, pa.array((code >> 3) & 7), pa.array(code & 7), pa.array(size)], names=["cell", "x", "y", "band", "spare", "size"])


def _shared(part: int, key, ids, code) -> pa.RecordBatch:
    """The rows of one part whose cells have several documents, or were hot in a task."""
    order = np.lexsort((ids, key))
    key, ids, code = key[order], ids[order], code[order]
    new = np.r_[True, (key[1:] != key[:-1]) | (ids[1:] != ids[:-1])]
    hot = np.maximum.reduceat(code, np.flatnonzero(new)) > 127
    key, ids, code = key[new], ids[new], code[new]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    full = np.where(np.maximum.reduceat(hot, first), HUGE, size)
    use = np.repeat(full > 1, size)
    return _members(key[use] | (part << 40), ids[use], np.repeat(ids[first], size)[use], code[use], np.repeat(full, size)[use].astype(np.int32))


def _allowed(gap, smaller, num: int, den: int):
    """Whether sets with so many different bits may link: |A xor B| is at most (den - num) / den of the union, and the
    union at most den / num of the smaller set."""
    return gap * num <= (den - num) * smaller


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """docs(id, text) -> id, n, bits: parity of three or more bits an element, each element in one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in text_batches(batches, "text"):
            n, bits, start = _bits(*shingles(*flat(x.column(1)), k), x.num_rows)
            raw, at = bits.tobytes(), (8 * start).tolist()
            yield pa.record_batch([x.column(0), pa.array(n), pa.array([raw[i:j] for i, j in zip(at, at[1:])], pa.binary())], names=["id", "n", "bits"])

    return docs.mapInArrow(run, "id long, n long, bits binary")


def _bits(owner: np.ndarray, h: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, words of all sketches end to end, and their starts. A sketch has a power of two words; its halves' XOR is the
    sketch of half that size."""
    n = np.bincount(owner, minlength=rows)
    words = 1 << np.maximum(np.ceil(np.log2(np.maximum(3 * n, 1) / 64)), 3).astype(np.int64)
    start = np.r_[0, np.cumsum(words)]
    out, bit = np.zeros(start[-1], np.uint64), mix64(h + np.uint64(77))
    at = start[owner] + ((bit >> np.uint64(6)).astype(np.int64) & (words[owner] - 1))
    np.bitwise_xor.at(out, at, np.uint64(1) << (bit & np.uint64(63)))
    return n, out, start


def _gaps(a: np.ndarray, b: np.ndarray, bits: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Distances of the sketches of rows a and b, the longer ones folded."""
    words = np.diff(start)
    least, gap = np.minimum(words[a], words[b]), np.zeros(len(a), np.int64)
    for w in np.unique(least).tolist():
        pairs = np.flatnonzero(least == w)
        rows, at = np.unique(np.concatenate([a[pairs], b[pairs]]), return_inverse=True)
        folded = np.zeros((len(rows), w), np.uint64)
        for v in np.unique(words[rows]).tolist():
            of = np.flatnonzero(words[rows] == v)
            for i in range(0, len(of), max(1, (1 << 19) // v)):
                r = of[i : i + max(1, (1 << 19) // v)]
                folded[r] = np.bitwise_xor.reduce(bits[start[rows[r]][:, None] + np.arange(v)].reshape(len(r), -1, w), axis=1)
        p, q, step = at[: len(pairs)], at[len(pairs) :], max(1, (1 << 19) // w)
        for i in range(0, len(pairs), step):
            gap[pairs[i : i + step]] = np.bitwise_count(folded[p[i : i + step]] ^ folded[q[i : i + step]]).sum(1)
    return gap


def dealt(groups: DataFrame) -> DataFrame:
    """groups(g, x, component, w): rows of weight w -> tile, cross, side, x, component, so that all pairs of a group with
    different components meet in a tile (where cross: rows of different sides). Tiles hold about 2 * TILE at most.

    The largest component meets the rest only, and the rest meets itself."""
    weights = groups.groupBy("g", "component").agg(F.sum("w").alias("w"))
    size = weights.groupBy("g").agg(F.sum("w").alias("all"), F.max("w").alias("most"), F.max_by("component", F.struct("w", -F.col("component"))).alias("main"))
    tiles = lambda w: F.ceil(w / TILE).cast("int")
    size = cut(size.filter("all > most").select("g", "main", (F.col("all") <= 2 * TILE).alias("one"), tiles(F.col("most")).alias("mains"), tiles(F.col("all") - F.col("most")).alias("rests")))
    main = F.col("component") == F.col("main")
    rows = groups.join(sized(size), "g").withColumn("t", F.pmod(F.xxhash64("x"), F.when(main, F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    place = lambda kind, p, q, cross, side: F.struct(F.lit(kind).alias("kind"), p.alias("p"), q.alias("q"), cross.alias("cross"), side.alias("side"))
    no, t, zero = F.lit(False), F.col("t"), F.lit(0)
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    others = F.transform(upto("rests"), lambda q: place(1, t, q, F.lit(True), zero))
    own = F.concat(F.transform(upto("mains"), lambda p: place(1, p, t, F.lit(True), F.lit(1))), F.transform(upto("rests"), lambda q: place(2, F.least(t, q), F.greatest(t, q), t != q, t)))
    places = F.when(F.col("one"), F.array(place(0, zero, zero, no, zero))).when(main, others).otherwise(own)
    rows = rows.select("g", "x", "component", F.explode(places).alias("e"))
    # with its own tile a tile of the rest is compared once
    return rows.select(F.xxhash64("g", "e.kind", "e.p", "e.q").alias("tile"), "e.cross", "e.side", "x", "component")


def _whole_tiles(batches: Iterator[pa.RecordBatch], least: int = 0) -> Iterator[pa.Table]:
    """Tables of whole tiles from rows in order of `tile`, with at least so many bytes but for the last."""
    held: pa.Table | None = None
    for b in batches:
        for r in range(0, b.num_rows, 512):
            t = pa.Table.from_batches([b.slice(r, 512)])
            t = t if held is None else pa.concat_tables([held, t])
            tile = t.column("tile")
            if t.nbytes > least and tile[0] != tile[-1]:
                t = t.combine_chunks()
                last = int(np.searchsorted(np.asarray(t.column("tile")), tile[-1].as_py()))  # the last tile may go on
                yield t.slice(0, last)
                t = t.slice(last)
            held = t
    if held is not None and held.num_rows:
        yield held.combine_chunks()


def _pairs(t: pa.Table, n, bits, start, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, row, distance of the sketches): pairs of a tile in different components that the sketches allow to link, for
    each run of small tiles or block of a large one."""
    tile, side, x, comp = (np.asarray(t.column(c)) for c in ("tile", "side", "x", "component"))
    cross = np.asarray(t.column("cross").combine_chunks().cast(pa.int8())) > 0
    first = np.flatnonzero(np.r_[True, tile[1:] != tile[:-1]])
    size = np.diff(np.r_[first, len(tile)])
    # row i meets the rows before it in its tile
    before = np.arange(len(tile)) - np.repeat(first, size)
    upto, low = np.cumsum(before), 0
    while low < len(tile):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + (1 << 18), "right")))
        who, k = spread(before[low:high])
        a = low + who
        b = a - before[a] + k
        ok = (comp[a] != comp[b]) & (x[a] != x[b]) & (~cross[a] | (side[a] != side[b]))
        a, b = a[ok], b[ok]
        small = np.minimum(n[a], n[b])
        ok = (den * small >= num * np.maximum(n[a], n[b])) & (small > 0)
        a, b, small = a[ok], b[ok], small[ok]
        gap = _gaps(a, b, bits, start)
        ok = _allowed(gap, small, num, den)
        yield a[ok], b[ok], gap[ok]
        low = high


def allowed_rows(tiles: DataFrame, sk: DataFrame, num: int, den: int) -> DataFrame:
    """Of the rows of tiles, those with a partner that the sketches sk(id, n, bits) allow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches, 1 << 18):
            bits, start = flat(t.column("bits"))
            use = np.zeros(t.num_rows, bool)
            for a, b, _ in _pairs(t, np.asarray(t.column("n")), np.frombuffer(bits.tobytes(), np.uint64), start // 8, num, den):
                use[a] = use[b] = True
            yield from t.select(COLUMNS).filter(pa.array(use)).to_batches()

    rows = tiles.join(sk, tiles["x"] == sk["id"]).select(*COLUMNS, "n", "bits")
    return rows.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, TILES)


COLUMNS = ["tile", "cross", "side", "x", "component"]
TILES = "tile long, cross boolean, side int, x long, component long"


def linked_in_tiles(tiles: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Links (a, b) of a spanning forest of what links in each tile, judged on whole sets, beside what has one component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole_tiles(batches, 1 << 18):
            owner, h = shingles(*flat(t.column("text")), k)
            n, bits, start = _bits(owner, h, t.num_rows)
            end = np.cumsum(n)
            x = np.asarray(t.column("x")).tolist()
            comp = np.asarray(t.column("component"))
            # rows of one component in one tile start united
            _, root = np.unique(np.column_stack([np.asarray(t.column("tile")), comp]), axis=0, return_inverse=True)
            root, to = root.reshape(-1).tolist(), list(range(t.num_rows))

            def find(i: int) -> int:
                while to[i] != i:
                    to[i] = i = to[to[i]]
                return i

            out = []
            for a, b, gap in _pairs(t, n, bits, start, num, den):
                order = np.argsort(gap / np.maximum(n[a], 1), kind="stable")
                for i, j in zip(a[order].tolist(), b[order].tolist()):
                    p, q = find(root[i]), find(root[j])
                    if p != q:
                        same = len(np.intersect1d(h[end[i] - n[i] : end[i]], h[end[j] - n[j] : end[j]], assume_unique=True))
                        if den * same >= num * (n[i] + n[j] - same):
                            to[max(p, q)] = min(p, q)
                            out.append((x[i], x[j]))
            a, b = zip(*out) if out else ((), ())
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    few = cut(tiles)
    texts = docs.join(sized(few), docs["id"] == few["x"]).select(*COLUMNS, "text")
    return texts.repartition("tile").sortWithinPartitions("tile").mapInArrow(run, "a long, b long")


def _with(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows(x, ...) with their component: their own id where they have none."""
    c = comp.select(F.col("id").alias("i"), F.col("component").alias("c"))
    return rows.join(c, rows["x"] == c["i"], "left").withColumn("component", F.coalesce("c", "x")).drop("i", "c")


def family_links(members: DataFrame, docs: DataFrame, sizes: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """members(cell, x, y), sizes(id, n) -> links (a, b) that connect what links among documents that share cells."""
    fam = components(members.select(F.col("x").alias("a"), F.col("y").alias("b")))
    weight = (1 + F.floor(F.col("n") / ROW)).cast("int")
    fam = cut(fam.join(sizes.withColumnRenamed("id", "i"), F.col("id") == F.col("i")).select(F.col("id").alias("x"), F.col("component").alias("g"), weight.alias("w")))
    tiles = cut(fam.groupBy("g").agg(F.ceil(F.sum("w") / TILE).cast("int").alias("tiles")).filter("tiles > 1"))
    # first pass: each row once, and the first of a family of several tiles in all of them
    rows = fam.join(sized(tiles), "g", "left").withColumn("t", F.pmod(F.xxhash64("x"), F.coalesce("tiles", F.lit(1))).cast("int"))
    here = rows.filter(F.col("tiles").isNull() | (F.col("x") != F.col("g"))).select("g", "t", "x")
    lead = tiles.select("g", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("t"), F.col("g").alias("x"))
    first = here.unionByName(lead).select(F.xxhash64("g", F.lit(-1), "t").alias("tile"), F.lit(False).alias("cross"), F.lit(0).alias("side"), "x", F.col("x").alias("component"))
    links = cut(linked_in_tiles(first, docs, k, num, den))
    if tiles.isEmpty():
        return links
    # second pass: families of several tiles, or their cells
    wide = cut(_with(rows.filter("tiles > 1").select("g", "x", "w", "tiles"), components(links)))
    cells_of = members.join(sized(cut(wide.select("x", F.col("g").alias("f"), "w", "component"))), "x").select(F.col("cell").alias("g"), "x", "component", "w", "f")
    main = wide.groupBy("g", "component").agg(F.sum("w").alias("w")).groupBy("g").agg(F.sum("w").alias("all"), F.max("w").alias("most"))
    rows_of_cells = cells_of.groupBy("f").agg(F.count("*").alias("n"))
    count = wide.groupBy("g").agg(F.count("*").alias("rows"))
    plan = main.join(count, "g").join(rows_of_cells, F.col("g") == F.col("f"), "left")
    by_cells = cut(plan.filter(F.ceil((F.col("all") - F.col("most")) / TILE) * F.col("rows") > F.col("n")).select(F.col("g").alias("f")))
    groups = wide.join(sized(by_cells), F.col("g") == F.col("f"), "left_anti").select("g", "x", "component", "w")
    if not by_cells.isEmpty():
        groups = groups.unionByName(cells_of.join(sized(by_cells), "f", "left_semi").select("g", "x", "component", "w"))
    spread_out = cut(dealt(cut(groups)))
    need = cut(spread_out.select(F.col("x").alias("need")).distinct())
    sk = sketches(docs.join(sized(need), docs["id"] == need["need"], "left_semi"), k)
    near = allowed_rows(spread_out, sk, num, den).distinct()
    return cut(links.unionByName(linked_in_tiles(near, docs, k, num, den)))


def join(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id") -> DataFrame:
    """docs(id, text) -> id, n_shingles, component_id. Sets link where den * intersection >= num * union."""
    small_batches(docs)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    known = cut(sets(d, k))
    full = known.filter("n > 0 and id is not null")
    rep = full.groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).filter("copies > 1")
    same = cut(full.join(rep, ["n", "a", "b"]).filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b")).distinct())
    # a copy has the links of its first; ids with several texts stay, as only one of them is a copy
    several = full.groupBy("id").agg(F.count("*").alias("texts")).filter("texts > 1").select(F.col("id").alias("a"))
    copies = same.join(several, "a", "left_anti").select(F.col("a").alias("copy"))
    real = d.filter(F.col("id").isNotNull()).join(sized(copies, same.count()), F.col("id") == F.col("copy"), "left_anti")
    parts = 4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rank = F.row_number().over(Window.partitionBy("x", "band").orderBy(F.desc("size"), "cell"))
    members = cut(cells(real, k, num, den, parts).withColumn("rank", rank).filter("rank > spare").select("cell", "x", "y"))
    sizes = full.groupBy("id").agg(F.max("n").alias("n"))
    comp = components(same.unionByName(family_links(members, real, sizes, k, num, den)))
    c = sized(comp).select(F.col("id").alias("i"), "component")
    return known.join(c, known["id"] == c["i"], "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
