"""Hard-negative mining by matrix products in a residue number system.

Components become integers floor(scale * x), x as double. A tile of anchors by rows is multiplied modulo several small primes
in float32: residues lie around zero and columns are taken CHUNK at a time, so that no partial sum reaches 2**24 and every
float is an exact integer. Mixed-radix digits of the residues (Chinese remaindering) give the signed scores. The number of
primes follows from the largest component and the length of the vectors, so scores are exact for all that fit in a long;
larger ones wrap as longs do.

Tiles: anchors and rows are dealt to a grid of groups by row number, and each cell is one task's. A cell passes on the best
few rows of each anchor only, which are ranked again over all cells. The first round finds positives, the second, which
knows their scores, selects negatives in each positive's window of scores.

Rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of different lengths
don't meet. Equal scores go by smaller id. Repeated rows are separate rows: an anchor's copy is another row of its label,
and a repeated anchor has its results as often. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, stored

#: Columns of a partial product.
CHUNK = 64
#: Most anchors and rows of a cell, on average; anchors that are multiplied at a time.
ANCHORS, ROWS, BLOCK = 4096, 16384, 128


def primes(most: int) -> list[int]:
    """Odd primes, largest first, with a product over `most`, whose partial products of CHUNK residues are exact in float32."""
    out, product, p = [], 1, 1021  # CHUNK * 510**2 + 510 < 2**24
    while product <= most:
        if p < 3:
            raise ValueError("scores need more primes than there are")
        if all(p % q for q in range(2, int(p**0.5) + 1)):
            out.append(p)
            product *= p
        p -= 2
    return out


def residues(x: np.ndarray, moduli: list[int]) -> list[np.ndarray]:
    """The matrix modulo each prime, as float32 between -(p-1)/2 and (p-1)/2."""
    out = []
    for p in moduli:
        r = x % p
        out.append((r - p * (r > p // 2)).astype(np.float32))
    return out


def products(a: list[np.ndarray], b: list[np.ndarray], moduli: list[int], bound: int) -> np.ndarray:
    """Exact signed a @ b.T as longs, from residues. bound: at least the largest absolute score."""
    digits: list[np.ndarray] = []
    for p, x, y in zip(moduli, a, b):
        total = np.zeros((len(x), len(y)), np.float32)
        for k in range(0, x.shape[1], CHUNK):
            total += x[:, k : k + CHUNK] @ y[:, k : k + CHUNK].T
            if k + CHUNK < x.shape[1]:
                total -= np.rint(total / np.float32(p)) * np.float32(p)
        d = (total.astype(np.int32) + np.int32(bound % p)) % p  # of score + bound, which is not negative
        weight = 1
        for q, e in zip(moduli, digits):  # what the lower digits leave, then divided by their weight
            d = (d - e * np.int32(weight % p)) % p
            weight *= q
        digits.append((d * np.int32(pow(weight, -1, p)) % p).astype(np.int32))
    out, weight = np.zeros(digits[0].shape, np.uint64), 1
    for p, d in zip(moduli, digits):
        out += d.astype(np.uint64) * np.uint64(weight % (1 << 64))
        weight *= p
    return (out - np.uint64(bound % (1 << 64))).view(np.int64)


def best(score: np.ndarray, ids: np.ndarray, use: np.ndarray, k: int) -> np.ndarray:
    """The k places of `use` with the highest scores, ties by smaller id."""
    if len(use) > k:
        least = np.partition(score[use], len(use) - k)[len(use) - k]
        use = use[score[use] >= least]
    return use[np.lexsort((ids[use], ~score[use]))][:k]


def grid(rows: DataFrame, anchors: DataFrame, n: int, most_cells: int) -> DataFrame:
    """Anchors and rows in the cells (dim, g, c) in which they meet."""
    n_anchors = anchors.count()
    g_all, c_all = max(1, -(-n_anchors // ANCHORS)), max(1, -(-n // ROWS), min(most_cells, -(-n // 1024)))
    deal = lambda k: F.pmod(F.xxhash64("uid"), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    none = F.array().cast("array<long>")
    a = anchors.select("uid", "id", "label", "v", "low", "high", deal(g_all).alias("g"), every(c_all).alias("c"), F.lit(True).alias("anchor"))
    b = rows.select("uid", "id", "label", "v", none.alias("low"), none.alias("high"), every(g_all).alias("g"), deal(c_all).alias("c"), F.lit(False).alias("anchor"))
    return a.unionByName(b).withColumn("dim", F.size("v"))


def mine(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0
) -> DataFrame:
    """vectors(id, label, vector) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    An anchor's positives are its best `positives` other rows of its label; for each the best `negatives` rows of other
    labels with low * positive_score <= 100 * negative_score <= high * positive_score. Runs jobs while it is being built."""
    spark = vectors.sparkSession
    whole = F.transform(vec_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    bad = F.exists(vec_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad)
    rows = stored(rows.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole.alias("v"), is_anchor.alias("is_anchor")))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.array_max("v")).alias("top"), F.min(F.array_min("v")).alias("bottom")).first()
    bound = max(1, (size["dim"] or 0) * max(size["top"] or 0, -(size["bottom"] or 0)) ** 2)
    moduli = primes(2 * bound)
    cells = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = rows.filter("is_anchor").select("uid", "id", "label", "v")

    def cell(select, names):
        def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            order = np.argsort(np.asarray(t.column("id")), kind="stable")
            t = t.take(pa.array(order)).combine_chunks()
            is_a = np.asarray(t.column("anchor").cast(pa.int8())) > 0
            dim = key[0].as_py()
            x = np.asarray(t.column("v").combine_chunks().flatten()).reshape(len(t), dim)
            ids, label, uid = (np.asarray(t.column(c)) for c in ("id", "label", "uid"))
            at, b = np.flatnonzero(is_a), np.flatnonzero(~is_a)
            out: list[tuple] = []
            windows = [t.column(c).to_pylist() if len(at) else [] for c in ("low", "high")]
            right = residues(x[b], moduli)
            for k in range(0, len(at) if len(b) else 0, BLOCK):
                block = at[k : k + BLOCK]
                score = products(residues(x[block], moduli), right, moduli, bound) if dim else np.zeros((len(block), len(b)), np.int64)
                for s, i in zip(score, block):
                    same = label[b] == label[i]
                    for place, j in select(s, ids[b], uid[b] == uid[i], same, windows[0][i], windows[1][i]):
                        out.append((int(uid[i]), int(ids[i]), place, int(uid[b[j]]), int(ids[b[j]]), int(s[j])))
            cols = list(zip(*out)) if out else [[]] * 6
            return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, cols)})

        return run

    def nearest(s, ids, self_, same, *_):
        return [(0, j) for j in best(s, ids, np.flatnonzero(same & ~self_), positives)]

    def between(s, ids, self_, same, lows, highs):
        other = np.flatnonzero(~same)
        for place, (lo, hi) in enumerate(zip(lows, highs)):
            if lo <= hi:
                for j in best(s, ids, other[(s[other] >= lo) & (s[other] <= hi)], negatives):
                    yield place, j

    def ranked(found: DataFrame, per: list[str], most: int) -> DataFrame:
        w = Window.partitionBy(*per).orderBy(F.col("score").desc(), "other_id", "other")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)

    names = ["anchor", "anchor_id", "place", "other", "other_id", "score"]
    schema = ", ".join(f"{c} long" for c in names)
    none = F.array().cast("array<long>")
    first = grid(rows, anchors.withColumn("low", none).withColumn("high", none), size["n"], cells)
    found = ranked(first.groupBy("dim", "g", "c").applyInArrow(cell(nearest, names), schema), ["anchor"], positives)
    # windows as whole numbers: 100 * s >= low * p is s >= ceil(low * p / 100), in decimals, as longs could overflow
    p = F.col("score").cast("decimal(24,0)")
    found = cut(found.select("anchor", "other_id", "score", (F.col("rank") - 1).alias("place"), F.ceil(p * low / 100).cast("long").alias("low"), F.floor(p * high / 100).cast("long").alias("high")))
    lists = found.groupBy(F.col("anchor").alias("u")).agg(F.sort_array(F.collect_list(F.struct("place", "low", "high"))).alias("x"))  # up to `positives` each
    lists = lists.select("u", F.col("x.low").alias("low"), F.col("x.high").alias("high"))
    known = cut(anchors.join(lists, F.col("uid") == F.col("u")).drop("u"))
    second = grid(rows, known, size["n"], cells).groupBy("dim", "g", "c").applyInArrow(cell(between, names), schema)
    second = ranked(second, ["anchor", "place"], negatives)
    positive = found.select(F.col("anchor").alias("a"), F.col("place").alias("p"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    got = second.join(positive, (F.col("anchor") == F.col("a")) & (F.col("place") == F.col("p")))
    return got.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
