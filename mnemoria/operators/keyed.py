"""A stored table with one row per key, in hash buckets.

A change rewrites the buckets that its keys fall in, in a folder of its own, and commits a manifest that names the folder of
every bucket. Readers see the newest manifest. So a change costs what its buckets hold, not the table: choose so many
buckets that one is small. A change that is made again (the same writer and number) does nothing; a failed one leaves an
unnamed folder, which the next change removes with what is superseded.

One writer at a time: a manifest's name can be taken once only, and who comes late fails.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import files
from .sync import upsert


@dataclass
class KeyedTable:
    """path: a folder; key: of the rows; version: decides between rows of a key; buckets: fixed with the first change."""

    spark: SparkSession
    path: str
    key: str
    version: str
    buckets: int = 64

    def manifest(self) -> dict | None:
        names = [n for n in files.names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        return json.loads(files.read_text(self.spark, f"{self.path}/manifests/{names[-1]}")) if names else None

    def read(self, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows, of some buckets or all; None before the first change."""
        m = self.manifest()
        if m is None:
            return None
        schema = T.StructType.fromJson(m["schema"])
        folders = [f"{self.path}/{f}" for b, f in sorted(m["folders"].items(), key=lambda x: int(x[0])) if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucket(self, buckets: int | None = None):
        return F.pmod(F.xxhash64(self.key), F.lit(buckets or self.buckets)).cast("int")

    def change(self, rows: DataFrame, writer: str, number: int, apply: Callable[[DataFrame, DataFrame], DataFrame]) -> list[int]:
        """Replaces the buckets of the rows' keys by apply(their rows in the table, rows). -> the buckets."""
        m = self.manifest() or {"number": -1, "buckets": self.buckets, "schema": None, "folders": {}, "done": {}}
        if m["done"].get(writer, -1) >= number:
            return []
        rows = rows.filter(F.col(self.key).isNotNull())
        touched = sorted(r["b"] for r in rows.select(self.bucket(m["buckets"]).alias("b")).distinct().collect())  # at most one a bucket
        if touched:
            before = self.read(touched) if m["schema"] else rows.limit(0)
            after = apply(before, rows)
            folder = f"data/{m['number'] + 1:010d}"
            after.withColumn("_bucket", self.bucket(m["buckets"])).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
            there = {n.split("=")[1] for n in files.names(self.spark, f"{self.path}/{folder}") if n.startswith("_bucket=")}
            for b in map(str, touched):
                if b in there:
                    m["folders"][b] = f"{folder}/_bucket={b}"
                else:
                    m["folders"].pop(b, None)
            m["schema"] = after.schema.jsonValue()
        m["number"] += 1
        m["done"][writer] = number
        if not files.write_once(self.spark, f"{self.path}/manifests/{m['number']:010d}.json", json.dumps(m)):
            raise RuntimeError(f"another writer has changed {self.path}")
        self._tidy(m)
        return touched

    def upsert(self, rows: DataFrame, writer: str = "batch", number: int | None = None, last_wins: bool = True) -> list[int]:
        m = self.manifest()
        number = number if number is not None else (m["done"].get(writer, -1) if m else -1) + 1
        return self.change(rows, writer, number, lambda before, new: upsert(before, new, self.key, self.version, last_wins))

    def delete(self, keys: DataFrame, writer: str = "batch", number: int | None = None) -> list[int]:
        m = self.manifest()
        if m is None:
            return []
        number = number if number is not None else m["done"].get(writer, -1) + 1
        return self.change(keys.select(self.key), writer, number, lambda before, gone: before.join(gone, self.key, "left_anti"))

    def _tidy(self, m: dict) -> None:
        """Removes what neither this manifest nor the one before it names: readers of that one may be at work."""
        numbers = [n for n in files.names(self.spark, f"{self.path}/manifests") if n.endswith(".json")]
        for n in numbers[:-2]:
            files.remove(self.spark, f"{self.path}/manifests/{n}")
        kept = set(m["folders"].values())
        if len(numbers) > 1:
            kept |= set(json.loads(files.read_text(self.spark, f"{self.path}/manifests/{numbers[-2]}"))["folders"].values())
        for change in files.names(self.spark, f"{self.path}/data"):
            parts = [f"data/{change}/{n}" for n in files.names(self.spark, f"{self.path}/data/{change}") if n.startswith("_bucket=")]
            if not kept & set(parts):
                files.remove(self.spark, f"{self.path}/data/{change}")
                continue
            for p in parts:
                if p not in kept:
                    files.remove(self.spark, f"{self.path}/{p}")
