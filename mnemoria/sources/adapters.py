"""The given tables in the roles of captured messages and stored vectors."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = 1_700_000_000_000
PLATFORMS = ("chatgpt", "claude", "cli")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; times of events are UTC."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("ts", F.col("ts").cast("timestamp")) if name == "events" else df


def _platform(k) -> F.Column:
    return F.element_at(F.array(*[F.lit(p) for p in PLATFORMS]), (k % 3 + 1).cast("int"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as messages: a day per conversation, a second per turn."""
    c = read(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws("-", "conv_id", "turn").alias("message_id"), F.col("conv_id").cast("string").alias("conversation_id"), "role", F.col("text").alias("content"),
        (F.lit(EPOCH) + F.col("conv_id") * 86_400_000 + F.col("turn") * 1000).alias("timestamp"), _platform(F.col("conv_id")).alias("platform"), F.col("turn").alias("seq"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as stored messages: a second apart, roles by turns, source and tenant by label."""
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id"), F.col("vec_id").cast("string").alias("message_id"), F.when(F.col("vec_id") % 2 == 0, "user").otherwise("assistant").alias("role"),
        _platform(F.col("label")).alias("source"), (F.lit(EPOCH) + F.col("vec_id") * 1000).alias("timestamp"), (F.col("label") % 2).cast("string").alias("user_id"),
        F.col("embedding"),
    )


def read_store(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Stored arrays: files of one JSON array each, an element a row. A file is one task's."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def archive(df: DataFrame, path: str) -> None:
    """df as files of one JSON array each, which read_store reads; a file per partition, written as its rows stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = "["
        for b in batches:
            lines = []
            for x in b.column(0).to_pylist():
                lines.append(before + x)
                before = ","
            if lines:
                yield pa.record_batch([pa.array(lines)], names=["value"])
        yield pa.record_batch([pa.array(["[]" if before == "[" else "]"])], names=["value"])

    df.select(F.to_json(F.struct(*df.columns)).alias("value")).mapInArrow(run, "value string").write.mode("overwrite").text(path)
