"""Counts and health figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def counts(df: DataFrame, by: str, default: str | None = None) -> DataFrame:
    c = F.col(by) if default is None else T.or_else(F.col(by), F.lit(default))
    return df.groupBy(c.alias(by)).agg(F.count("*").alias("n"))


def source_summary(df: DataFrame, by: str = "source", default: str | None = None) -> DataFrame:
    """One row: rows, sources (their number), several (more than one), known (rows with a source)."""
    c = F.col(by) if default is None else T.or_else(F.col(by), F.lit(default))
    n = F.countDistinct(c)
    return df.agg(F.count("*").alias("rows"), n.alias("sources"), (n > 1).alias("several"), F.count(c).alias("known"))


def store_size(df: DataFrame, quota: int = 10_485_760) -> DataFrame:
    """Rows and their size as a JSON list, against a quota."""
    one = df.select(F.length(F.to_json(F.struct(*df.columns))).alias("n"))
    got = one.agg(F.count("*").alias("rows"), (F.coalesce(F.sum("n"), F.lit(0)) + F.greatest(F.count("*") - 1, F.lit(0)) + 2).alias("size"))
    return got.select("rows", "size", F.round(F.col("size") / 1024, 2).alias("kb"), F.round(F.col("size") * 100 / quota, 2).alias("percent"))


def store_statistics(captured: DataFrame, errors: DataFrame, as_of_ms: int, quota: int = 10_485_760) -> DataFrame:
    """One row: store_size, and errors (their number), last_save (the newest captured_at, epoch milliseconds; null if there
    is none) and ms_since_save."""
    saved = captured.agg(F.max("captured_at").alias("last_save"), (F.lit(as_of_ms) - F.max("captured_at")).alias("ms_since_save"))
    return store_size(captured, quota).join(F.broadcast(errors.agg(F.count("*").alias("errors")))).join(F.broadcast(saved))  # one row each


def sync_status(messages: DataFrame, by: str = "synced_at") -> DataFrame:
    """One row: total_messages, last_sync_time (null if there is none)."""
    return messages.agg(F.count("*").alias("total_messages"), F.max(by).alias("last_sync_time"))


def rate(part, whole):
    return F.round(F.try_divide(part * 100.0, whole), 1)


def capture_health(events: DataFrame, success: str = "captured", error: str = "error", kind: str = "event_type") -> DataFrame:
    """One row: events, errors, succeeded and their rates. success, error: kinds of events."""
    n = lambda name: F.count_if(F.col(kind) == name)
    got = events.agg(F.count("*").alias("events"), n(error).alias("errors"), n(success).alias("succeeded"))
    return got.select("events", "errors", "succeeded", rate(F.col("errors"), F.col("events")).alias("error_rate"), rate(F.col("succeeded"), F.col("events")).alias("success_rate"))


def injection_counters(injections: DataFrame) -> DataFrame:
    """injections(items, error) -> one row: attempts, injected (with items), empty, failed, items, success_rate."""
    bad = F.col("error").isNotNull()
    some = ~bad & (F.coalesce("items", F.lit(0)) > 0)
    got = injections.agg(F.count("*").alias("attempts"), F.count_if(some).alias("injected"), F.count_if(~bad & ~some).alias("empty"), F.count_if(bad).alias("failed"), F.coalesce(F.sum(F.when(some, F.col("items"))), F.lit(0)).alias("items"))
    return got.withColumn("success_rate", rate(F.col("injected"), F.col("attempts")))


def health_windows(events: DataFrame, width: str = "5 minutes") -> DataFrame:
    """Events and errors per window of time."""
    g = events.groupBy(F.window("ts", width).alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return g.select(F.col("w.start").alias("start"), "n", "errors", rate(F.col("errors"), F.col("n")).alias("error_rate"))


def silences(events: DataFrame, minutes: float, by: str | None = None) -> DataFrame:
    """Gaps of over so many minutes between events (of each value of `by`).

    A window over all time in one task would not grow; gaps are found within days, and between the last event of a day
    and the first of the next on one row a day."""
    keys = [by] if by else []
    day = F.to_date("ts")
    e = events.select(*keys, "ts", day.alias("day"))
    inside = e.withColumn("before", F.lag("ts").over(Window.partitionBy(*keys, "day").orderBy("ts")))
    ends = e.groupBy(*keys, "day").agg(F.min("ts").alias("ts"), F.max("ts").alias("last"))
    across = ends.withColumn("before", F.lag("last").over(Window.partitionBy(*keys).orderBy("day")))
    both = inside.select(*keys, "before", "ts").unionByName(across.select(*keys, "before", "ts"))
    gap = F.unix_micros("ts") - F.unix_micros("before")
    return both.filter(F.col("before").isNotNull() & (gap > minutes * 60e6)).withColumn("seconds", F.round(gap / 1e6, 3))


def newest(df: DataFrame, n: int, by: str, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(by), *ties).limit(n)
