"""Data-quality rules: one row per rule with the rows checked, the rows that fail, and whether it passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import parse

ROLES = ("user", "assistant", "system")
PLATFORMS = ("chatgpt", "claude", "cli")


def check(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rules: what holds for a good row. One pass over the data for all of them."""
    one = df.agg(F.count("*").alias("checked"), *[F.count_if(~F.coalesce(ok, F.lit(False))).alias(f"r{i}") for i, ok in enumerate(rules.values())])
    long = F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("failed")) for i, name in enumerate(rules)]))
    return one.select("checked", long.alias("x")).select("x.rule", "checked", "x.failed", (F.col("x.failed") == 0).alias("passed"))


def contract(df: DataFrame, expected: T.StructType) -> DataFrame:
    """column, expected, found, ok: the schema against what is required."""
    found = dict(df.dtypes)
    rows = [(f.name, f.dataType.simpleString(), found.get(f.name), found.get(f.name) == f.dataType.simpleString()) for f in expected.fields]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, found string, ok boolean")


def against_contract(expected: list[str], found: DataFrame) -> DataFrame:
    """The rules that a table must have, with what check() found for them; a rule that no row was checked for fails."""
    rules = found.sparkSession.createDataFrame([(x,) for x in expected], "rule string")
    got = rules.join(found, "rule", "left")
    zero = F.lit(0).cast("long")
    return got.select("rule", F.coalesce("checked", zero).alias("checked"), F.coalesce("failed", zero).alias("failed"), F.coalesce("passed", F.lit(False)).alias("passed"))


def chunk_rules() -> dict[str, Column]:
    return {
        "turn_count_positive": F.col("turn_count") > 0, "times_in_order": F.col("end_timestamp") >= F.col("start_timestamp"), "platform_allowed": F.col("platform").isin(*PLATFORMS),
        "content_present": filled("content"), "speakers_allowed": F.forall("speakers", lambda s: s.isin(*ROLES)), "turn_range_form": F.col("turn_range").rlike(r"^\d+-\d+\z"),
    }


def filled(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) != ""


def message_rules() -> dict[str, Column]:
    return {
        "content_present": filled("content"), "timestamp_present": F.coalesce(F.col("timestamp"), F.lit(0)) != 0, "role_present": filled("role"),
        "role_allowed": F.col("role").isin(*ROLES), "content_not_blank": F.trim(F.coalesce("content", F.lit(""))) != "",
    }


def out_of_order(messages: DataFrame, rows: int = 4096) -> DataFrame:
    """Messages whose timestamp is before the one that arrived before them in their conversation.

    A conversation of any length is compared within runs of `rows` arrival numbers, whose first message is compared with
    the last one of the run before."""
    m = messages.withColumn("_run", F.coalesce(F.floor(F.col("seq") / rows), F.lit(-(1 << 62))))
    place = F.struct("seq", "timestamp")
    inside = Window.partitionBy("conversation_id", "_run").orderBy("seq", "timestamp")
    ends = m.groupBy(F.col("conversation_id").alias("_c"), F.col("_run").alias("_r")).agg(F.max_by("timestamp", place).alias("_end"))
    ends = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy("_c").orderBy("_r")))
    m = m.withColumn("_first", F.row_number().over(inside) == 1).withColumn("previous", F.lag("timestamp").over(inside))
    m = m.join(ends, F.col("conversation_id").eqNullSafe(F.col("_c")) & (F.col("_run") == F.col("_r")))
    m = m.withColumn("previous", F.when(F.col("_first"), F.col("_carried")).otherwise(F.col("previous")))
    return m.filter(F.col("timestamp") < F.col("previous")).drop("_run", "_c", "_r", "_end", "_carried", "_first")


def known_conversations(messages: DataFrame, least: float = 0.8) -> DataFrame:
    known = (F.coalesce("conversation_id", F.lit("")) != "") & (F.col("conversation_id") != "unknown")
    share = F.try_divide(F.count_if(known).cast("double"), F.count("*"))
    return messages.agg(F.round(share, 6).alias("share")).withColumn("passed", F.coalesce(F.col("share") >= least, F.lit(False)))


def content_lengths(messages: DataFrame, least: float = 10) -> DataFrame:
    n = F.length("content")
    return messages.agg(F.round(F.avg(n), 6).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length")).withColumn("passed", F.coalesce(F.col("avg_length") >= least, F.lit(False)))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def embedding_coverage(df: DataFrame, dim: int) -> DataFrame:
    e = parse(F.col("embedding")) if dict(df.dtypes)["embedding"] == "string" else F.col("embedding")
    df = df.select(e.alias("embedding"))
    e = F.col("embedding")
    got = df.agg(F.count("*").alias("total"), F.count(e).alias("present"), F.count_if(F.coalesce(F.size(e) == dim, F.lit(False)) & e.isNotNull()).alias("right_size"))
    return got.withColumn("percent", F.round(F.try_divide(F.col("right_size") * 100.0, F.col("total")), 1))


def not_ascending(hits: DataFrame) -> DataFrame:
    """Hits that are nearer than the hit ranked before them."""
    order = Window.partitionBy("query_id").orderBy("rank")
    return hits.withColumn("previous", F.lag("distance").over(order)).filter(F.col("distance") < F.col("previous"))


def question_quality(chunks: DataFrame) -> DataFrame:
    """conversation questions against their chunk: shares that name a topic and that begin differently, lengths."""
    q = F.col("hypothetical_questions")
    n = F.size(q)
    named = F.size(F.filter(q, lambda x: F.exists("topics", lambda t: F.lower(x).contains(F.lower(t)))))
    firsts = F.size(F.array_distinct(F.transform(q, lambda x: F.lower(F.split(x, " ")[0]))))
    lengths = F.forall(q, lambda x: F.size(F.split(F.trim(x), r"\s+")).between(3, 30))
    c = chunks.withColumn("topic_share", F.try_divide(named.cast("double"), n)).withColumn("variety", F.try_divide(firsts.cast("double"), n)).withColumn("lengths_ok", lengths)
    return c.withColumn("passed", F.coalesce((F.col("topic_share") >= 0.5) & (F.col("variety") >= 0.6) & F.col("lengths_ok"), F.lit(False)))


def rewrite_quality(rewritten: Column, expected: Column, fillers: tuple[str, ...] = ("that", "thing", "um", "like")) -> Column:
    words = F.split(F.lower(rewritten), r"\W+")
    return F.forall(expected, lambda k: F.lower(rewritten).contains(F.lower(k))) & ~F.exists(words, lambda w: w.isin(*fillers))
