"""One large JSON array in a file, read by many tasks.

Spark splits the file at closing braces, wherever they are. Whether a brace ends an element depends on all before it: each
partition scans its text twice, as if it began outside and inside a string, and says how deep it ends; these descriptions are
followed from partition to partition; then each partition cuts its text at the elements' ends, and the pieces of an element
that passes partitions are joined by its number.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOKENS = re.compile(r'[\\"{}\[\]]')


def scan(text: str, quoted: bool, escaped: bool = False, depth: int = 0) -> tuple[bool, bool, int, list[tuple[int, int]]]:
    """(inside a string, behind a backslash, depth) at the end of a text, and the places behind closing braces outside of
    strings with the depth there."""
    ends, skip = [], 0 if escaped else -1
    last = -1
    for m in TOKENS.finditer(text):
        i, c = m.start(), m[0]
        if i == skip:
            continue
        if quoted:
            if c == "\\":
                skip = i + 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if c == "}":
                ends.append((i + 1, depth))
        last = i
    behind = quoted and skip == len(text) if text else escaped
    return quoted, behind, depth, ends


def elements(spark: SparkSession, path: str) -> DataFrame:
    """file, number, element (JSON text) of the objects of one array in each file."""
    from ..operators.chains import through_partitions

    pieces = spark.read.option("lineSep", "}").text(path)
    rows = pieces.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"), "value")
    order = [F.col("file"), F.col("at"), F.col("n")]

    def files(t: pa.Table) -> list[tuple[str, str, list[int]]]:
        """The text of each file in a partition, each piece with the brace that it ended with, and its last piece's place."""
        out: list = []
        for name, at, value in zip(*[t.column(c).to_pylist() for c in ("file", "at", "value")]):
            if not out or out[-1][0] != name:
                out.append((name, []))
            out[-1][1].append(value + "}")
        return [(name, "".join(v)) for name, v in out]

    def describe(t: pa.Table) -> dict:
        got = files(t)
        ways = {}
        for quoted, escaped in ((False, False), (True, False), (True, True)):
            q, e, d, ends = scan(got[-1][1], quoted, escaped)
            levels: dict[int, int] = {}
            for _, depth in ends:
                levels[depth] = levels.get(depth, 0) + 1
            ways[quoted, escaped] = (q, e, d, levels)
        return {"first": got[0][0], "last": got[-1][0], "one": len(got) == 1, "ways": ways}

    def advance(state, about):
        name, quoted, escaped, depth, number = state
        if not about["one"] or name != about["first"]:
            quoted = escaped = False
            depth = number = 0
        q, e, d, levels = about["ways"][quoted, escaped]
        return about["last"], q, e, depth + d, number + levels.get(1 - depth, 0)  # elements end at the array's depth

    def mark(t: pa.Table, state) -> pa.Table:
        out = []
        for k, (name, text) in enumerate(files(t)):
            same = k == 0 and state[0] == name
            quoted, escaped, depth, number = state[1:] if same else (False, False, 0, 0)
            start = 0
            for end, level in [*scan(text, quoted, escaped, depth)[3], (len(text), 1)]:
                if level == 1 and end > start:
                    out.append((name, number, text[start:end]))
                    number, start = number + 1, end
        return pa.table({c: pa.array(v, kind) for c, v, kind in zip(("file", "number", "piece"), zip(*out) if out else ((), (), ()), (pa.string(), pa.int64(), pa.string()))})

    parts = through_partitions(rows, order, order, describe, advance, ("", False, False, 0, 0), mark, "file string, number long, piece string")
    # pieces of one element come from partitions in the order of their numbers
    g = parts.withColumn("part", F.spark_partition_id()).groupBy("file", "number").agg(F.sort_array(F.collect_list(F.struct("part", "piece"))).alias("x"))
    text = F.regexp_replace(F.array_join(F.transform("x", lambda p: p["piece"]), ""), r"^[\s,\[]+", "")
    return g.select("file", "number", text.alias("element")).filter(F.col("element").startswith("{") & F.col("element").rlike(r"\}\s*\z") & (F.length("element") > 1))


def read_large_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of arrays as rows; of one large file by many tasks."""
    return elements(spark, path).select(F.from_json("element", schema).alias("r")).select("r.*")
