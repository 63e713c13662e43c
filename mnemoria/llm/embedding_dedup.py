"""Near duplicates among embeddings by spherical-cap filters.

Filters are directions from a random product code: the space is cut into two halves, each half has a code of random unit
vectors, and a filter is one code word of each. A vector is list-decoded to every filter whose inner product with it
exceeds a bound; code words of a half are ranked and only those that can reach the bound with the best of the other half
are combined, so the filters are never all visited. Vectors that share a filter are compared in double precision. The
code grows with the number of vectors, so that a filter holds a bounded number of vectors on average; a filter that holds
more is compared in tiles of TILE by TILE.

A vector always keeps its `least` best filters, also where none exceeds the bound. The larger the code, the fewer filters a
pair shares, so one code is not enough: pairs at the threshold are planted and the share that has no filter in common is
measured, and as many codes, each in a rotation of its own, are used as make the product of the shares less than `miss`.
At cosine 0.95 and 64 components these are two codes for 50,000 vectors, four for 20 million and five for a thousand
million; pairs at higher cosines are missed less. Vectors are assigned once, and travel to filters that have others.

Equal vectors are one class with a weight. Pairs are counted in the first filter that they share, tile by tile, and each
tile passes on a spanning forest, so the pairs of a group are never written out.

Vectors that are null, empty, zero or hold a null or non-finite component link with nothing and are their own component.
Vectors of different lengths don't link. Repeated rows are equal vectors: each counts the others. Rows with equal ids are
one node; rows with a null id link with nothing, have no component and are kept. An empty table gives an empty result;
other columns are ignored. Jobs run while the result is being built.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut
from .graph import components, sized

TILE = 512


def code(dim: int, words: int, seed: int = 11) -> list[np.ndarray]:
    """For each half of the components, `words` random unit vectors, scaled so that a filter has length 1."""
    rng = np.random.default_rng([seed, dim, words])
    out = []
    for size in (dim - dim // 2, dim // 2):
        c = rng.standard_normal((words, max(size, 1)))
        out.append((c / np.linalg.norm(c, axis=1, keepdims=True))[:, :size] / np.sqrt(2))
    return out


def decode(x: np.ndarray, halves: list[np.ndarray], bound: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, filter) of all filters over the bound, or over the row's `least`-th best if that is lower."""
    cut_at = halves[0].shape[1]
    s, t = x[:, :cut_at] @ halves[0].T, x[:, cut_at:] @ halves[1].T
    words = s.shape[1]
    k = min(least, words)
    best = (np.sort(s, 1)[:, -k:][:, :, None] + np.sort(t, 1)[:, -k:][:, None, :]).reshape(len(x), -1)
    bound = np.minimum(bound, np.sort(best, 1)[:, -min(least, best.shape[1])]) - 1e-12
    row, i = np.nonzero(s >= (bound - t.max(1))[:, None])
    pair, j = np.nonzero(t[row] >= (bound[row] - s[row, i])[:, None])
    return row[pair], i[pair] * words + j


def rotation(dim: int, number: int) -> np.ndarray:
    """The rotation of a code; the first has none."""
    return np.eye(dim) if number == 0 else np.linalg.qr(np.random.default_rng([13, dim, number]).standard_normal((dim, dim)))[0]


def bound_of(filters: int, words: int, dim: int) -> float:
    """The inner product that so many of a code's filters exceed, on average."""
    return NormalDist().inv_cdf(max(1e-12, 1 - min(0.5, filters / words**2))) / np.sqrt(dim)


def codes_for(dim: int, words: int, threshold: float, filters: int, least: int, miss: float, pairs: int = 3000) -> int:
    """How many codes leave less than `miss` of the pairs at the threshold without a common filter."""
    if dim < 2:
        return 1
    rng = np.random.default_rng([17, dim, words])
    x, y = rng.standard_normal((2, pairs, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * y / np.linalg.norm(y, axis=1, keepdims=True)
    halves, bound, lost = code(dim, words), bound_of(filters, words, dim), 0
    for k in range(0, pairs, 250):
        a, b = (decode(v[k : k + 250], halves, bound, least) for v in (x, y))
        both = np.intersect1d(*(row * np.int64(words) ** 2 + f for row, f in (a, b)))
        lost += len(x[k : k + 250]) - len(np.unique(both // np.int64(words) ** 2))
    share = max(lost, 1) / pairs
    return max(1, int(np.ceil(np.log(miss) / np.log(share)))) if share < 1 else 64


def _valid(vectors: DataFrame, id_col: str, vec_col: str, kind: str) -> DataFrame:
    """-> id, dim, v: the components as bytes of their kind, for vectors that can link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            lists = x.column(1)
            off = np.asarray(lists.offsets).astype(np.int64)
            data, size = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), kind), np.diff(off)  # nulls become NaN
            for dim in np.unique(size[size > 0]):
                at = np.flatnonzero(size == dim)
                v = data[(off[at] - off[0])[:, None] + np.arange(dim)]
                use = np.isfinite(v).all(1) & v.any(1)
                yield pa.record_batch([x.column(0).take(pa.array(at[use])), pa.array(np.full(int(use.sum()), dim, np.int32)), pa.array([r.tobytes() for r in v[use]], pa.binary())], names=["id", "dim", "v"])

    rows = vectors.filter(F.col(vec_col).isNotNull() & F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<float>" if kind == "f4" else "array<double>")).mapInArrow(run, "id long, dim int, v binary")


def _unit(blobs, dim: int, kind: str) -> np.ndarray:
    v = np.frombuffer(b"".join(blobs), kind).reshape(-1, dim).astype(np.float64)
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _forest(link: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The least label that links reach, for each row of a symmetric boolean matrix."""
    low = label.copy()
    while True:
        new = np.minimum(low, np.where(link, low[None, :], np.iinfo(np.int64).max).min(1, initial=np.iinfo(np.int64).max))
        if (new == low).all():
            return low
        low = new


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", filters: int = 12, least: int = 6, load: int = 16, miss: float = 5e-4
) -> DataFrame:
    """vectors(id, vector) -> id, n_links, component_id, kept. Links are pairs with cosine >= threshold.

    filters: filters of a code per vector on average; least: at least; load: vectors per filter of a code; miss: the share
    of links at the threshold that may be missed, from which the number of codes follows."""
    kind = "f4" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "f8"
    valid = cut(_valid(vectors, id_col, vec_col, kind))
    classes = cut(valid.groupBy("dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    n = classes.count()
    words = max(8, int(np.ceil(np.sqrt(n / load))))
    codes = {r["dim"]: codes_for(r["dim"], words, threshold, filters, least, miss) for r in classes.select("dim").distinct().collect()}  # a row per length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[tuple, list] = {}
        for whole in batches:
            for r in range(0, whole.num_rows, 1024):
                x = whole.slice(r, 1024)
                size, blobs, rep = np.asarray(x.column(0)), x.column(1).to_pylist(), np.asarray(x.column(2))
                for dim in np.unique(size):
                    at = np.flatnonzero(size == dim)
                    u = _unit([blobs[i] for i in at], int(dim), kind)
                    for c in range(codes[int(dim)]):
                        if (dim, c) not in made:
                            made[dim, c] = [code(int(dim), words, 11 + c), rotation(int(dim), c)]
                        halves, turned = made[dim, c][0], u @ made[dim, c][1]
                        row, f = decode(turned, halves, bound_of(filters, words, int(dim)), least)
                        yield pa.record_batch([pa.array(np.full(len(row), dim, np.int32)), pa.array(f.astype(np.int64) + c * words**2), pa.array(rep[at[row]])], names=["dim", "filter", "rep"])

    held = cut(classes.select("dim", "v", "rep").mapInArrow(assign, "dim int, filter long, rep long"))
    loads = cut(held.groupBy("dim", "filter").agg(F.count("*").alias("size")).filter("size > 1"))
    # filters of one vector are of no use; all others of a vector travel with it, so that a pair counts in its first one
    own = held.join(sized(loads), ["dim", "filter"]).groupBy(F.col("rep").alias("r")).agg(F.collect_list(F.struct("filter", "size")).alias("x"))
    small = max(codes.values(), default=1) * words**2 < 1 << 31
    rows = classes.join(own, F.col("rep") == F.col("r")).select("dim", "v", "rep", "copies", F.explode("x").alias("f"), F.col("x.filter").cast("array<int>" if small else "array<long>").alias("own"))
    rows = rows.withColumn("filter", F.col("f.filter")).withColumn("tiles", F.ceil(F.col("f.size") / TILE).cast("int")).withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.select("dim", "filter", F.least("tile", "other").alias("p"), F.greatest("tile", "other").alias("q"), "tile", "rep", "copies", "v", "own")
    none = pd.DataFrame({"id": np.zeros(0, np.int64), "links": np.zeros(0, np.int64), "to": np.zeros(0, np.int64)})

    def compare(key, g: pd.DataFrame) -> pd.DataFrame:
        dim, f, p, q = key
        if len(g) < 2:
            return none
        u = _unit(g.v, dim, kind)
        rep, copies, tile = g.rep.to_numpy(), g.copies.to_numpy(), g.tile.to_numpy()
        link = u @ u.T >= threshold
        np.fill_diagonal(link, False)
        if p != q:  # the tiles themselves are compared elsewhere
            link &= tile[:, None] != tile[None, :]
        if not link.any():
            return none
        at = np.flatnonzero(link.any(1))
        link = link[np.ix_(at, at)]
        lists = [np.asarray(x, np.int64) for x in g.own.iloc[at]]
        lower = [v[v < f] for v in lists]
        names, inverse = np.unique(np.concatenate(lower), return_inverse=True)
        has = np.zeros((len(at), max(len(names), 1)), np.float32)
        has[np.repeat(np.arange(len(at)), [len(v) for v in lower]), inverse] = 1
        first = link & ~((has @ has.T) > 0)
        return pd.DataFrame({"id": rep[at], "links": (first * copies[at][None, :]).sum(1), "to": _forest(link, rep[at])})

    found = cut(rows.groupBy("dim", "filter", "p", "q").applyInPandas(compare, "id long, links long, to long").groupBy("id", "to").agg(F.sum("links").alias("links")))
    per = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    comp = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    comp = comp.select(F.col("id").alias("i"), "component")
    cls = classes.join(per, "rep", "left")
    cls = cut(cls.join(sized(comp), cls["rep"] == comp["i"], "left").select("v", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "rep").alias("component")))
    known = valid.select("id", "v").join(cls, "v").groupBy("id").agg(F.max("links").alias("links"), F.min("component").alias("component"))
    ids = vectors.select(F.col(id_col).cast("long").alias("vec"))
    known = known.select("id", "links", "component")
    comp_of = F.coalesce("component", "vec")
    return ids.join(known, ids["vec"] == known["id"], "left").select(F.col("vec").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), comp_of.alias("component_id"), F.coalesce(F.col("vec") == comp_of, F.lit(True)).alias("kept"))
