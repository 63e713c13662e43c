"""Nearest rows of sets of queries: exactly, or among the rows of the nearest cells. No query passes through the driver.

Queries and rows meet by a key: their length for the exact search, a cell of a coarse clustering for the other. Of each
key, rows are dealt to parts and queries to blocks of bounded size, so a cell with a third of all rows is many tasks. A
task multiplies a block with a part and passes on the k best of each query.

Vectors that are null, zero, or hold a null or non-finite component are near nothing, as query or row; so are vectors of
another length. Equal distances (to 12 decimals) go by smaller vec_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Components of the rows and of the queries of a task, on average, and distances that it holds at a time.
PART, BLOCK, HELD = 1 << 20, 1 << 18, 1 << 20
#: Most cells, and rows that they are learned from, about: a model of bounded size.
CELLS, SAMPLE = 4096, 131_072
#: Rows of the sample that are asked for the number of probes.
ASKED = 300
FOUND = "query_id long, vec_id long, distance double"


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, and which vectors have a direction."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
    with np.errstate(all="ignore"):
        length = np.linalg.norm(x, axis=1)
        return x / length[:, None], np.isfinite(length) & (length > 0)


def vectors(df: DataFrame, id_name: str) -> DataFrame:
    """df(vec_id, embedding) -> id, v, dim."""
    rows = df.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0))
    return rows.select(F.col("vec_id").cast("long").alias(id_name), F.col("embedding").cast("array<double>").alias("v")).withColumn("dim", F.size("v"))


def meet(rows: DataFrame, queries: DataFrame, keys: list[str], k: int, threshold: float | None, exclude_self: bool, block: int | None = None) -> DataFrame:
    """rows(vec_id, v, *keys), queries(query_id, v, *keys), dim among the keys -> query_id, rank, vec_id, distance: the k
    nearest of the rows that share the keys with a query, which may have several rows."""
    n_rows, n_queries = (d.groupBy(*keys).agg(F.count("*").alias(n)) for d, n in ((rows, "n_rows"), (queries, "n_queries")))
    per = F.greatest(F.lit(1), F.lit(BLOCK) / F.col("dim")) if block is None else F.lit(block)
    # a row per key that has both; there are at most CELLS for each length of vector
    sizes = F.broadcast(n_rows.join(n_queries, keys).select(*keys, F.ceil(F.col("n_rows") * F.col("dim") / PART).cast("int").alias("parts"), F.ceil(F.col("n_queries") / per).cast("int").alias("blocks")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda i, n: F.pmod(F.xxhash64(i), F.col(n)).cast("int")
    r = rows.join(sizes, keys).select(*keys, every("blocks").alias("block"), own("vec_id", "parts").alias("part"), F.lit(False).alias("asks"), F.col("vec_id").alias("id"), "v")
    q = queries.join(sizes, keys).select(*keys, own("query_id", "blocks").alias("block"), every("parts").alias("part"), F.lit(True).alias("asks"), F.col("query_id").alias("id"), "v")

    def best(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        asks, ids = np.asarray(t.column("asks").cast(pa.int8())) > 0, np.asarray(t.column("id"))
        x, good = _matrix(t.column("v"), key[0].as_py())
        a, b = np.flatnonzero(asks & good), np.flatnonzero(~asks & good)
        out = []
        step = max(1, HELD // max(len(b), 1))
        for s in range(0, len(a) if len(b) else 0, step):
            some = a[s : s + step]
            d = np.round(1.0 - x[some] @ x[b].T, 12)
            if exclude_self:
                d[ids[some][:, None] == ids[b][None, :]] = np.inf
            if threshold is not None:
                d[d >= threshold] = np.inf
            m = min(k, len(b))
            edge = np.partition(d, m - 1, axis=1)[:, m - 1]
            row, col = np.nonzero((d <= edge[:, None]) & np.isfinite(d))
            # of those tied at the edge only the least ids can be among the k
            order = np.lexsort((ids[b][col], d[row, col], row))
            row, col = row[order], col[order]
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else row
            use = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)])) < k
            out.append((ids[some][row[use]], ids[b][col[use]], d[row[use], col[use]]))
        cols = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(["query_id", "vec_id", "distance"], cols)))

    found = r.unionByName(q).groupBy("dim", *[c for c in keys if c != "dim"], "block", "part").applyInArrow(best, FOUND)
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def nearest_batch(corpus: DataFrame, queries: DataFrame, k: int = 5, threshold: float | None = None, exclude_self: bool = True, block: int | None = None, where=None) -> DataFrame:
    """The k nearest rows of corpus(vec_id, embedding), or of those that pass `where`, for each of queries(vec_id,
    embedding): query_id, rank, vec_id, distance. block: queries of a task, on average."""
    corpus = corpus if where is None else corpus.filter(where)
    return meet(vectors(corpus, "vec_id"), vectors(queries, "query_id"), ["dim"], k, threshold, exclude_self, block)


# -- cells ----------------------------------------------------------------------------------------------------------------


def learn_cells(corpus: DataFrame, cells: int | None = None, rounds: int = 12, sample: int = SAMPLE, k: int = 5, aim: float = 0.97) -> DataFrame:
    """corpus(vec_id, embedding) -> dim, cell, centre, probes: spherical k-means over about `sample` rows, chosen by a hash
    of their ids, in one task for each length of vectors. cells: the square root of the number of rows unless given; CELLS
    at most.

    probes: how many cells a query must visit to find the share `aim` of its k nearest rows, by ASKED of the sample's rows,
    whose nearest are sought among the sample exactly. In the whole table, where rows are closer, it finds more."""
    rows = vectors(corpus, "vec_id")
    n = rows.count()
    cells = min(CELLS, cells or max(1, round(n**0.5)))
    some = rows.filter(F.pmod(F.xxhash64("vec_id", F.lit("cells")), F.lit(max(1, n // sample))) == 0)

    def train(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(np.asarray(t.column("vec_id")), kind="stable")))
        x, good = _matrix(t.column("v"), key[0].as_py())
        x = x[good]
        rng = np.random.default_rng(7)
        centre = x[rng.permutation(len(x))[: min(cells, len(x))]]
        for _ in range(rounds):
            sums, count, worst = np.zeros_like(centre), np.zeros(len(centre), np.int64), []
            for s in range(0, len(x), 4096):
                score = x[s : s + 4096] @ centre.T
                near = score.argmax(1)
                np.add.at(sums, near, x[s : s + 4096])
                count += np.bincount(near, minlength=len(centre))
                worst.append(score.max(1))
            length = np.linalg.norm(sums, axis=1)
            full = (count > 0) & (length > 0)
            centre[full] = sums[full] / length[full, None]
            empty = np.flatnonzero(~full)  # an empty cell begins again where rows are far from any centre
            centre[empty] = x[np.argsort(np.concatenate(worst), kind="stable")[: len(empty)]] if len(x) else centre[empty]
        near = np.concatenate([(x[s : s + 4096] @ centre.T).argmax(1) for s in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)
        asked, places = rng.permutation(len(x))[:ASKED], []
        for q in asked:
            score = x @ x[q]
            score[q] = -np.inf
            best = np.argsort(-score, kind="stable")[: min(k, len(x) - 1)]
            place = np.empty(len(centre), np.int64)
            place[np.argsort(-(centre @ x[q]), kind="stable")] = np.arange(len(centre))
            places += place[near[best]].tolist()
        probes = int(np.sort(places)[int(np.ceil(aim * len(places))) - 1]) + 1 if places else len(centre)
        ints = lambda v: pa.array(np.broadcast_to(np.asarray(v, np.int32), len(centre)))
        return pa.table({"dim": ints(key[0].as_py()), "cell": ints(np.arange(len(centre))), "centre": pa.array(centre.tolist(), pa.list_(pa.float64())), "probes": ints(probes)})

    return some.groupBy("dim").applyInArrow(train, "dim int, cell int, centre array<double>, probes int")


def _held(spark: SparkSession, cells: DataFrame):
    """The centres and probes of each length, in every task; at most CELLS of each."""
    got: dict[int, list] = {}
    for r in cells.orderBy("dim", "cell").collect():
        got.setdefault(r["dim"], []).append((r["centre"], r["probes"]))
    return spark.sparkContext.broadcast({d: (np.array([x for x, _ in c]), c[0][1]) for d, c in got.items()})


def assign(rows: DataFrame, cells: DataFrame, id_name: str, probes: int | None = 1) -> DataFrame:
    """rows(id, v, dim) -> id, v, dim, cell: a row for each of the `probes` (None: as learned) nearest cells. Vectors
    without a direction go."""
    held = _held(rows.sparkSession, cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                part = b.slice(s, 1024)
                size = np.asarray(part.column(2))
                for dim in np.unique(size):
                    if int(dim) not in held.value:
                        continue
                    centre, learned = held.value[int(dim)]
                    at = np.flatnonzero(size == dim)
                    x, good = _matrix(part.column(1).take(pa.array(at)), int(dim))
                    at, x = at[good], x[good]
                    m = min(probes or learned, len(centre))
                    near = np.argpartition(-(x @ centre.T), m - 1, axis=1)[:, :m]
                    row = pa.array(np.repeat(at, m))
                    yield pa.record_batch([part.column(0).take(row), part.column(1).take(row), part.column(2).take(row), pa.array(near.reshape(-1).astype(np.int32))], names=[id_name, "v", "dim", "cell"])

    return rows.select(id_name, "v", "dim").mapInArrow(run, f"{id_name} long, v array<double>, dim int, cell int")


def nearest_in_cells(corpus: DataFrame, queries: DataFrame, cells: DataFrame, k: int = 5, probes: int | None = None, threshold: float | None = None, exclude_self: bool = True) -> DataFrame:
    """As nearest_batch, among the rows of the `probes` cells nearest to a query, as many as learned unless given. More find
    more of the k nearest; as many as there are cells find all."""
    return meet(assign(vectors(corpus, "vec_id"), cells, "vec_id"), assign(vectors(queries, "query_id"), cells, "query_id", probes), ["dim", "cell"], k, threshold, exclude_self)


def write_index(corpus: DataFrame, path: str, cells: int | None = None) -> None:
    """Learns cells and stores them and the rows, those of a cell together and in its order, so that readers skip others."""
    learn_cells(corpus, cells).write.mode("overwrite").parquet(f"{path}/cells")
    learned = corpus.sparkSession.read.parquet(f"{path}/cells")
    rows = assign(vectors(corpus, "vec_id"), learned, "vec_id")
    # a salt spreads a hot cell over several files
    rows.repartition("cell", F.pmod(F.xxhash64("vec_id"), F.lit(8))).sortWithinPartitions("dim", "cell").write.mode("overwrite").parquet(f"{path}/rows")


def search_index(spark: SparkSession, path: str, queries: DataFrame, k: int = 5, probes: int | None = None, threshold: float | None = None, exclude_self: bool = True) -> DataFrame:
    """The search in a stored index."""
    asked = assign(vectors(queries, "query_id"), spark.read.parquet(f"{path}/cells"), "query_id", probes)
    return meet(spark.read.parquet(f"{path}/rows"), asked, ["dim", "cell"], k, threshold, exclude_self)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """queries, wanted, hits, recall: the share of exact(query_id, vec_id) that was found."""
    pair = ["query_id", "vec_id"]
    both = exact.select(*pair).join(found.select(*pair).withColumn("hit", F.lit(1)), pair, "left")
    return both.agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("hits"), F.round(F.try_divide(F.count("hit"), F.count("*")), 4).alias("recall"))
