"""Substring search by an index of three-character pieces, and by a scan for many queries at once.

A text that holds the words asked for, in any case, holds all their three-character pieces. Postings (piece, key) are stored
in order of the piece, so that a reader skips the files and row groups of others; keys that have the rarest pieces of the
query are looked up and verified. Queries of under three characters have no pieces and scan.

Many queries (`matches`) need no postings of all texts: a filter of bounded size tells which pieces of a text may be anchors
of a query, and only those leave the task that reads the text. An anchor is the whole query up to WHOLE characters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 3
#: Pieces of a query whose postings are read: the rarest.
PIECES = 3
#: Characters of a query that is its own anchor, at most; longer ones have ANCHORS of 16, 32 or LONGEST characters.
WHOLE, LONGEST, ANCHORS = 15, 64, 4
#: Bits of the filter: SPARE for each anchor, and least and most of all as powers of two (32 MB); places of an anchor there.
SPARE, BITS, PLACES = 32, (16, 28), 3
#: Characters of queries, with 32 for a row, that are sent to every task; those of more meet the texts' pieces by shuffle.
SENT = 1 << 25
#: Bytes of text and places of it that a task works on at a time, and keys that it gathers before it passes them on.
TEXTS, STEP, GATHERED = 1 << 20, 1 << 17, 1 << 18


def pieces(text: Column) -> Column:
    """Distinct three-character pieces of the text in lower case."""
    t = F.lower(F.coalesce(text, F.lit("")))
    n = F.length(t) - (SIZE - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(t, i, F.lit(SIZE))))).otherwise(F.array().cast("array<string>"))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.explode(pieces(F.col(text))).alias("piece"), F.col(key).alias("key"))


def write_index(df: DataFrame, path: str, key: str = "message_id", text: str = "content") -> None:
    """Postings, and how many each piece has."""
    # dealt by piece and key: a piece that most texts have is many files' worth
    postings(df, key, text).repartitionByRange("piece", "key").sortWithinPartitions("piece", "key").write.mode("overwrite").parquet(f"{path}/postings")
    read = df.sparkSession.read.parquet(f"{path}/postings")
    read.groupBy("piece").agg(F.count("*").alias("n")).repartitionByRange("piece").sortWithinPartitions("piece").write.mode("overwrite").parquet(f"{path}/counts")


def ilike(text: Column, q: str) -> Column:
    plain = q.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    return text.ilike(f"%{plain}%")


def candidates(spark: SparkSession, path: str, q: str) -> DataFrame | None:
    """Keys that may hold q; None if q is too short to tell."""
    wanted = spark.range(1).select(F.explode(pieces(F.lit(q))).alias("piece"))
    asked = [r["piece"] for r in wanted.collect()]  # those of one query
    if not asked:
        return None
    counts = {r["piece"]: r["n"] for r in spark.read.parquet(f"{path}/counts").filter(F.col("piece").isin(*asked)).collect()}
    rare = sorted(asked, key=lambda p: (counts.get(p, 0), p))[:PIECES]
    found = spark.read.parquet(f"{path}/postings").filter(F.col("piece").isin(*rare))
    return found.groupBy("key").agg(F.count_distinct("piece").alias("n")).filter(F.col("n") == len(rare)).select("key")


def search(messages: DataFrame, path: str, q: str, key: str = "message_id", text: str = "content") -> DataFrame:
    """The messages that hold q in any case: those of `ilike`, found by the index of their keys and texts."""
    found = candidates(messages.sparkSession, path, q)
    rows = messages if found is None else messages.join(found, messages[key] == found["key"], "left_semi")
    return rows.filter(ilike(F.col(text), q))


def folded(text: Column) -> Column:
    """Lower case, letter by letter: a capital sigma is the same at a word's end, so that a part of a text stays one."""
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def anchors(q: Column) -> Column:
    """Pieces that each text with q holds."""
    n = F.length(q)
    size = F.when(n < 32, 16).when(n < LONGEST, 32).otherwise(LONGEST)
    places = [((n - size) * i / (ANCHORS - 1)).cast("int") + 1 for i in range(ANCHORS)]
    return F.when(n <= WHOLE, F.array(q)).otherwise(F.array_distinct(F.array(*[F.substr(q, p, size) for p in places])))


@cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    odd = 0x9E3779B97F4A7C15
    return tuple(np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(STEP + LONGEST, x, np.uint64))]) for x in (odd, pow(odd, -1, 1 << 64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _sums(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * _powers()[0][: len(codes)], dtype=np.uint64)])


def _hashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Of each piece of so many characters."""
    n = max(0, len(sums) - size)
    return _mixed((sums[size:] - sums[:n]) * _powers()[1][:n] + np.uint64(size))


def _filter(asked: DataFrame, bits: int) -> np.ndarray:
    """asked(anchor) -> the filter, a bit a place; its parts of 4 KB are made in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            for size in {len(x) for x in texts}:
                h = np.concatenate([_hashes(_sums(_codes(x)), size) for x in texts if len(x) == size])
                for _ in range(PLACES):
                    yield pa.record_batch([pa.array((h >> np.uint64(64 - bits)).astype(np.int64) + 1)], names=["place"])
                    h = _mixed(h)

    places = asked.mapInArrow(run, "place long")
    parts = places.groupBy(F.bitmap_bucket_number("place").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros((max(1, 1 << bits >> 15), 4096), np.uint8)
    for r in parts.collect():  # of a bounded number
        out[r["part"] - 1] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(-1)


def hits(messages: DataFrame, asked: DataFrame, sizes: list[int], n: int, key: str, text: str) -> DataFrame:
    """asked(anchor), n at most, of the sizes -> anchor, keys of texts that hold it in lower case. Some pieces are not
    anchors, as the filter can't tell; an anchor has several rows, a text's row is once among them."""
    bits = min(max(BITS[0], (SPARE * n - 1).bit_length()), BITS[1]) if n else BITS[0]
    held = messages.sparkSession.sparkContext.broadcast(_filter(asked, bits))

    def places(h: np.ndarray) -> np.ndarray:
        """Where the filter has all places of the hash."""
        at = np.arange(len(h))
        for _ in range(PLACES):
            x = h >> np.uint64(64 - bits)
            on = (held.value[x >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            at, h = at[on], _mixed(h[on])
        return at

    def gather(found: dict[str, list[int]], first: int, part: list[str]) -> int:
        """Adds the numbers of the texts that hold an anchor; returns how many."""
        whole, ends, n = "".join(part), np.cumsum([len(x) for x in part]), 0
        codes = _codes(whole)
        for low in range(0, len(codes), STEP):
            sums = _sums(codes[low : low + STEP + LONGEST - 1])
            for size in sizes:
                at = places(_hashes(sums, size)[:STEP]) + low
                row = np.searchsorted(ends, at, "right")
                inside = at + size <= ends[row]
                for p, r in zip(at[inside].tolist(), (row[inside] + first).tolist(), strict=True):
                    rows = found.setdefault(whole[p : p + size], [])
                    if not rows or rows[-1] != r:
                        rows.append(r)
                        n += 1
        return n

    def batch(found: dict[str, list[int]], keys: pa.Array) -> pa.RecordBatch:
        ends = np.cumsum([0, *map(len, found.values())]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), keys.take(pa.array([r for rows in found.values() for r in rows], pa.int64())))
        return pa.record_batch([pa.array(list(found), pa.string()), lists], names=["anchor", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            off = np.cumsum([0, *pc.binary_length(b.column(1)).to_pylist()])
            start, n, found = 0, 0, {}
            while start < b.num_rows:
                end = max(start + 1, int(np.searchsorted(off, off[start] + TEXTS, "right")) - 1)
                n += gather(found, start, b.column(1).slice(start, end - start).to_pylist())
                start = end
                if found and (n >= GATHERED or start == b.num_rows):
                    yield batch(found, b.column(0))
                    n, found = 0, {}

    kind = messages.schema[key].dataType.simpleString()
    return messages.select(F.col(key).alias("key"), folded(F.coalesce(F.col(text), F.lit(""))).alias("text")).mapInArrow(run, f"anchor string, keys array<{kind}>")


def matches(messages: DataFrame, queries: DataFrame, key: str = "message_id", text: str = "content", sent: int = SENT) -> DataFrame:
    """queries(query_id, q) -> query_id, key of each message that holds q in any case, for many queries. Anchors that are
    the query prove it; a longer query is verified in the texts that hold its rarest anchor. Queries of under three
    characters find nothing."""
    wanted = queries.filter(F.length("q") >= SIZE).select("query_id", folded(F.col("q")).alias("q"))
    asked = wanted.select("q", F.explode(anchors(F.col("q"))).alias("anchor"))
    about = asked.agg(F.count("*").alias("n"), F.sum(F.length("q") + 32).alias("chars"), F.max(F.length("q")).alias("longest"), F.collect_set(F.length("anchor")).alias("sizes")).first()
    send = F.broadcast if (about["chars"] or 0) <= sent else lambda d: d
    found = hits(messages, asked.select("anchor"), sorted(about["sizes"]), about["n"], key, text)
    short = found.join(send(wanted.filter(F.length("q") <= WHOLE)), F.col("anchor") == F.col("q")).select("query_id", F.explode("keys").alias(key))
    if (about["longest"] or 0) <= WHOLE:
        return short
    long = wanted.filter(F.length("q") > WHOLE)
    counts = found.groupBy("anchor").agg(F.sum(F.size("keys")).alias("n"))
    of_long = asked.filter(F.length("q") > WHOLE).distinct().join(counts, "anchor", "left")
    rarest = of_long.groupBy("q").agg(F.min_by("anchor", F.struct(F.coalesce("n", F.lit(0)), "anchor")).alias("anchor"))
    pairs = found.join(rarest, "anchor").select("q", F.explode("keys").alias("_key")).distinct()
    # by key and not by row: of a key that several messages have, each is verified
    texts = messages.select(F.col(key).alias("_of"), folded(F.col(text)).alias("_text"))
    held = pairs.join(texts, F.col("_key").eqNullSafe(F.col("_of"))).filter(F.contains("_text", "q"))
    return short.unionByName(held.select("q", "_of").join(send(long), "q").select("query_id", F.col("_of").alias(key)))
