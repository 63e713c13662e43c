"""Greedy chains over sorted rows: token-bounded batches, and the first rows of duplicate windows.

In both, a row that begins a group says where the next group begins, by prefix sums or times and a binary search; the
groups are the chain of these pointers from the first row. A chain is followed in three passes over rows that are sorted
over all partitions, so no key is a group of one task:

1. each partition follows its pointers and says where the chain leaves it, for every place where it may enter. Chains soon
   run together, so that takes few entries;
2. these descriptions are followed from partition to partition, in one small task;
3. each partition knows where its chain enters and marks its rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import materialised


def _joined(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    got = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(got).combine_chunks() if got else None


def through_partitions(df: DataFrame, keys: list[Column], order: list[Column], describe: Callable, advance: Callable, start, mark: Callable, schema: str) -> DataFrame:
    """describe(table of a partition) -> its description; advance(state, description) -> state behind it; mark(table, state
    before it) -> record batch. keys deal the rows out, order sorts them. Runs jobs while it is being built."""
    parts = materialised(df.repartitionByRange(*keys).sortWithinPartitions(*order))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _joined(batches)
        if t is not None:
            yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([pickle.dumps(describe(t))])], names=["part", "about"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start
        for b in batches:
            before = []
            for about in b.column(1).to_pylist():
                before.append(pickle.dumps(state))
                state = advance(state, pickle.loads(about))
            yield pa.record_batch([b.column(0), pa.array(before, pa.binary())], names=["part", "state"])

    tables = parts.mapInArrow(first, "part int, about binary").repartition(1).sortWithinPartitions("part")
    # a few numbers for each partition
    states = {r["part"]: pickle.loads(r["state"]) for r in tables.mapInArrow(follow, "part int, state binary").collect()}

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = _joined(batches)
        if t is not None:
            yield from mark(t, states[TaskContext.get().partitionId()]).to_batches(max_chunksize=10_000)

    return parts.mapInArrow(last, schema)


# -- token-bounded batches -------------------------------------------------------------------------------------------------


def _pointers(tokens: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums, and for each row where the batch that it begins ends. A row over `most` is a batch of its own."""
    sums = np.r_[0, np.cumsum(tokens)]
    over = np.flatnonzero(tokens > most)
    ends = np.searchsorted(sums, sums[:-1] + most, "right") - 1
    barrier = np.r_[over, len(tokens)][np.searchsorted(over, np.arange(len(tokens)))]
    ends = np.minimum(ends, barrier)
    ends[over] = over + 1
    return sums, ends


def _enter(sums: np.ndarray, over: int, used: int | None, most: int) -> int:
    """The first row that isn't taken by the open batch of `used` tokens (None: no batch is open). over: first row over most."""
    return 0 if used is None else min(over, int(np.searchsorted(sums, most - used, "right")) - 1)


def token_batches(df: DataFrame, key: str, content: str = "content", most: int = 4000) -> DataFrame:
    """df -> key, tokens, batch: batches of rows in order of key, each as long as its tokens stay within `most`; longer rows
    are batches of their own. Over the whole table, with no restarts. Only keys and numbers reach Python. Rows with equal
    keys go by tokens; a null key comes first, null content has no tokens."""
    d = df.select(F.col(key).alias("key"), T.estimate_tokens(F.col(content)).alias("tokens"))
    kind = df.schema[key].dataType.simpleString()

    def describe(t: pa.Table) -> dict:
        tokens = np.asarray(t.column("tokens")).astype(np.int64)
        sums, ends = _pointers(tokens, most)
        n, over = len(tokens), np.flatnonzero(tokens > most)
        over = int(over[0]) if len(over) else n
        entries = min(over, int(np.searchsorted(sums, most, "right")) - 1) + 1  # where an open batch can end
        seen: dict[int, tuple] = {}

        def leave(p: int) -> tuple:
            path = []
            while p < n and p not in seen:
                path.append(p)
                p = int(ends[p])
            used, count = seen[p] if p < n else (None if tokens[path[-1]] > most else int(sums[n] - sums[path[-1]]), 0)
            for q in reversed(path):
                count += 1
                seen[q] = (used, count)
            return used, count

        return {"sums": sums[: entries + 1], "over": over, "n": n, "all": int(sums[n]), "leave": [leave(p) for p in range(min(entries, n))]}

    def advance(state, about):
        used, batches = state
        p = _enter(about["sums"], about["over"], used, most)
        if p >= about["n"]:
            return used + about["all"], batches
        used, more = about["leave"][p]
        return used, batches + more

    def mark(t: pa.Table, state) -> pa.Table:
        tokens = np.asarray(t.column("tokens")).astype(np.int64)
        sums, ends = _pointers(tokens, most)
        n, over = len(tokens), np.flatnonzero(tokens > most)
        p = _enter(sums, int(over[0]) if len(over) else n, state[0], most)
        begins = np.zeros(n, np.int64)
        while p < n:
            begins[p] = 1
            p = int(ends[p])
        return pa.table({key: t.column("key"), "tokens": t.column("tokens"), "batch": pa.array(state[1] - 1 + np.cumsum(begins))})

    order = [F.col("key").asc_nulls_first(), F.col("tokens")]
    return through_partitions(d, order, order, describe, advance, (None, 0), mark, f"`{key}` {kind}, tokens long, batch long")


# -- duplicate windows -----------------------------------------------------------------------------------------------------


def first_of_window(df: DataFrame, keys: list[str], ts: str, seconds: float, tie: str) -> DataFrame:
    """Rows that are kept when repeats of a key within `seconds` of the last kept row are dropped; a repeat doesn't extend
    the window, and exactly `seconds` later is still a repeat. ts: a timestamp, or epoch milliseconds. Rows without a time
    are kept. A key with all rows is spread over partitions by time."""
    width, columns = int(seconds * 1_000_000), df.columns
    at = F.unix_micros(ts) if dict(df.dtypes)[ts].startswith("timestamp") else (F.col(ts) * 1000).cast("long")
    timed = df.filter(F.col(ts).isNotNull()).withColumn("_at", at).withColumn("_key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))

    def groups(t: pa.Table) -> tuple[list, np.ndarray, np.ndarray]:
        """First and last key, times, and where keys begin."""
        key = t.column("_key").combine_chunks().dictionary_encode()
        if isinstance(key, pa.ChunkedArray):
            key = key.combine_chunks()
        code = np.asarray(key.indices)
        names = key.dictionary
        return [names[int(code[0])].as_py(), names[int(code[-1])].as_py()], np.asarray(t.column("_at")).astype(np.int64), np.flatnonzero(np.r_[True, code[1:] != code[:-1]])

    def follow(times: np.ndarray, p: int, end: int) -> list[int]:
        """The kept rows from p on."""
        out = []
        while p < end:
            out.append(p)
            p += int(np.searchsorted(times[p:end], times[p] + width, "right"))
        return out

    def describe(t: pa.Table) -> dict:
        names, times, starts = groups(t)
        if len(starts) > 1:  # the last key begins here, so that nothing before matters
            return {"first": names[0], "last": names[1], "alone": False, "kept": int(times[follow(times, int(starts[-1]), len(times))[-1]])}
        # where the chain may enter: at the first row, or at any up to the first that no kept row before can reach
        n = int(np.searchsorted(times, times[0] + width, "right"))
        last: dict[int, int] = {}
        entries: list[tuple[int, int]] = []
        for p in range(min(n, len(times) - 1), -1, -1):
            path = []
            q = p
            while q < len(times) and q not in last:
                path.append(q)
                q += int(np.searchsorted(times[q:], times[q] + width, "right"))
            kept = last[q] if q < len(times) else int(times[path[-1]])
            last |= dict.fromkeys(path, kept)
            if not entries or entries[-1][1] != kept:  # rows with one result in a row are one entry, known by its latest time
                entries.append((int(times[p]), kept))
        return {"first": names[0], "last": names[1], "alone": True, "entries": entries[::-1], "until": int(times[-1])}

    def advance(state, about):
        if not about["alone"]:
            return about["last"], about["kept"]
        if state is None or state[0] != about["first"]:
            return about["last"], about["entries"][0][1]
        if state[1] + width >= about["until"]:
            return state
        behind = int(np.searchsorted([x for x, _ in about["entries"]], state[1] + width, "right"))
        return about["last"], about["entries"][behind][1]

    def mark(t: pa.Table, state) -> pa.Table:
        names, times, starts = groups(t)
        use: list[int] = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(times)]):
            p = s
            if s == 0 and state is not None and state[0] == names[0]:
                p = int(np.searchsorted(times[:e], state[1] + width, "right"))
            use += follow(times, p, e)
        return t.take(pa.array(use, pa.int64())).select(columns)

    order = [F.col("_key"), F.col("_at"), F.col(tie)]
    kept = through_partitions(timed, order, order, describe, advance, None, mark, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields))
    return kept.unionByName(df.filter(F.col(ts).isNull()))
