"""Connected components of links between ids, by contraction in the tasks and repeated hooking between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget, stored

#: Most rows (of two longs) that are broadcast; beyond it, Spark joins by shuffle.
BROADCAST_ROWS = 1_000_000
#: Links that a task contracts at a time, rows for which a further task is used, and least tasks.
CHUNK, ROWS, TASKS = 1_000_000, 100_000, 8


def sized(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if it has few rows. df should be materialised."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, of up to so many rows, in tasks in proportion to them: small rounds need not run all shuffle partitions."""
    return df.coalesce(max(TASKS, -(-rows // ROWS)))


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links as stars: each id but the least of its component, with that least one."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    to = list(range(len(ids)))
    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while to[i] != i:
            to[i] = i = to[to[i]]
        while to[j] != j:
            to[j] = j = to[to[j]]
        if i < j:
            to[j] = i
        else:
            to[i] = j
    for i, p in enumerate(to):  # parents are smaller, so theirs are final
        to[i] = to[p]
    root = np.array(to, np.int64)
    use = root != np.arange(len(ids))
    return pa.record_batch([pa.array(ids[root[use]]), pa.array(ids[use])], names=["a", "b"])


def contract(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """edges(a, b) -> fewer edges (a < b) with the same components: a star for each component of a task's edges. rows: at
    least their number, if it is known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, held = [], 0
        for x in batches:
            got.append((np.asarray(x.column(0)), np.asarray(x.column(1))))
            held += x.num_rows
            if held > CHUNK:
                yield _stars(*map(np.concatenate, zip(*got)))
                got, held = [], 0
        if held:
            yield _stars(*map(np.concatenate, zip(*got)))

    once = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return (once if rows is None else few(once, rows)).mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of non-null longs -> id, component (the smallest id that links reach), for ids that have a link to
    another id.

    Tasks contract their edges to stars. Where all ids have one centre, that is the component. Else each round points
    every id to its smallest neighbour if that is smaller, follows the pointers to their roots and replaces ids by roots.
    Ids that are no local minimum vanish, so at least half do. Minima are summed in the tasks before the shuffle, so an id
    with very many links is no hot key."""
    e, roots = stored(contract(edges)), None
    while True:
        n = e.count()
        both = e.select(F.col("b").alias("id"), F.col("a").alias("to")).unionByName(e.select(F.col("a").alias("id"), F.col("a").alias("to")))
        step = cut(few(both.groupBy("id").agg(F.min("to").alias("to"), F.max("to").alias("far")), 2 * n))
        done, small = step.filter("to < far").isEmpty(), 2 * n <= BROADCAST_ROWS
        mark = (lambda x: F.broadcast(x)) if small else (lambda x: x)
        if not done:
            # ids without a smaller neighbour are roots; jump until all pointers end there
            everyone, up = step.select("id"), step.filter("to < id").select("id", "to")
            while True:
                ends = mark(up.select(F.col("id").alias("i2"), F.col("to").alias("to2")))
                moved = cut(few(up.join(ends, up["to"] == ends["i2"], "left").select("id", F.coalesce("to2", "to").alias("to"), F.col("to2").isNotNull().alias("moved")), 2 * n))
                up = moved.select("id", "to")
                if moved.filter("moved").isEmpty():
                    break
            ends = up.select(F.col("id").alias("i2"), F.col("to").alias("to2"))
            step = cut(few(everyone.join(mark(ends), F.col("id") == F.col("i2"), "left").select("id", F.coalesce("to2", "id").alias("to")), 2 * n))
        if roots is None:
            roots, all_ids = stored(step.select("id", F.col("to").alias("component"))), 2 * n
        else:
            ends = step.select(F.col("id").alias("i2"), F.col("to").alias("to2"))
            before, roots = roots, stored(few(roots.join(mark(ends), F.col("component") == F.col("i2"), "left").select("id", F.coalesce("to2", "component").alias("component")), all_ids))
            forget(before)
        if done:
            forget(e)
            return roots
        ends = mark(step.select(F.col("id").alias("i2"), F.col("to").alias("to2")))
        one = e.join(ends, e["a"] == ends["i2"], "left").select(F.coalesce("to2", "a").alias("a"), "b")
        before, e = e, stored(contract(one.join(ends, one["b"] == ends["i2"], "left").select("a", F.coalesce("to2", "b").alias("b")), n))
        forget(before)
