"""Noise classification and clean-up, capture filters, duplicate suppression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .chains import first_of_window


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row, wherever it is used: no filter moves its expression below it."""
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def classify(df: DataFrame, content: str = "content") -> DataFrame:
    low = _once(df, "_low", F.lower(content))
    return low.withColumn("categories", T.noise_categories(F.col(content), F.col("_low"))).drop("_low")


def noise_report(df: DataFrame, content: str = "content") -> DataFrame:
    """category, n, percent of all rows; `all`, `clean` and `noise` besides the categories."""
    c = classify(df, content).select("categories")
    kinds = F.concat(F.array(F.lit("all"), F.when(F.size("categories") > 0, "noise").otherwise("clean")), "categories")
    n = c.select(F.explode(kinds).alias("category")).groupBy("category").agg(F.count("*").alias("n"))
    total = c.agg(F.count("*").alias("total"))
    return n.join(F.broadcast(total)).select("category", "n", F.round(F.try_divide(F.col("n") * 100.0, F.col("total")), 1).alias("percent"))


def without_noise(df: DataFrame, content: str = "content", dry_run: bool = False) -> DataFrame:
    """The rows that are not noise; with dry_run the rows that would go."""
    c = classify(df, content)
    return c.filter(F.size("categories") > 0 if dry_run else F.size("categories") == 0).drop("categories")


def capture_filter(df: DataFrame, content: str = "content", in_message: str | None = None, in_code: str | None = None) -> DataFrame:
    """Adds reject_reason; in_message, in_code: boolean columns about the element that a text is from."""
    plain = _once(_once(df, "_t", T.trim(F.coalesce(content, F.lit("")))), "_low", F.lower("_t"))
    return plain.withColumn("reject_reason", T.reject_reason(F.col("_t"), F.col("_low"), *[None if x is None else F.col(x) for x in (in_message, in_code)])).drop("_t", "_low")


def split_captures(captured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, failed): messages with text, trimmed; errors as type, message, timestamp."""
    t = captured.withColumn("content", T.trim(F.col("content")))
    ok = F.coalesce(F.col("content"), F.lit("")) != ""
    errors = t.filter(~ok).select(F.lit("SAVE_ERROR").alias("type"), F.lit("message has no content").alias("message"), F.col("timestamp"))
    return t.filter(ok), errors


def keep_last(errors: DataFrame, n: int = 100, by: str = "timestamp") -> DataFrame:
    """The newest rows; ties by all other columns."""
    return errors.orderBy(F.desc(by), *[c for c in errors.columns if c != by]).limit(n)


def first_captures(df: DataFrame, seconds: float = 5, content: str = "content", ts: str = "timestamp", tie: str = "message_id") -> DataFrame:
    """Captures without those whose first 100 characters were captured within `seconds` before."""
    keyed = df.withColumn("_content_key", T.content_key(F.col(content)))
    return first_of_window(keyed, ["_content_key"], ts, seconds, tie).drop("_content_key")
