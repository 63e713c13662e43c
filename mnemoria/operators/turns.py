"""Messages to turns, and turns to overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


#: Buckets in which a conversation is scanned: of time, and of rows where there is no time.
BUCKET_MS, BUCKET_ROWS = 3_600_000, 4096


def bucket() -> Column:
    """Consecutive messages of a conversation by timestamp (0: none) and seq. One conversation may hold very many, as all
    messages without an id are one."""
    t = F.col("timestamp")
    rows = F.coalesce(F.floor(F.col("seq") / BUCKET_ROWS), F.lit(-(1 << 62)))
    return F.struct(F.signum(t).cast("int").alias("sign"), F.floor(t / BUCKET_MS).alias("hour"), F.when(t == 0, rows).otherwise(0).alias("rows"))


def with_turns(messages: DataFrame) -> DataFrame:
    """Adds turn_idx (0, 1, ...) to the user and assistant messages of each conversation, ordered by timestamp, seq and role.

    A user message opens a turn; an assistant message closes the open one or is a turn of its own. Buckets of a
    conversation are scanned by themselves; a scan over the buckets carries the last role and the turns so far."""
    m = messages.withColumn("conversation_id", T.or_else(F.col("conversation_id"), F.lit("unknown"))).withColumn("role", F.lower("role")).withColumn("timestamp", F.coalesce("timestamp", F.lit(0)))
    m = m.filter(F.col("role").isin("user", "assistant")).withColumn("_bucket", bucket())
    place = ["timestamp", "seq", "role"]
    inside = Window.partitionBy("conversation_id", "_bucket").orderBy(*place)
    before = F.lag("role").over(inside)
    # whether a bucket's first message opens a turn may depend on the buckets before it: null
    m = m.withColumn("_opens", F.when(F.col("role") == "user", 1).when(before.isNotNull(), (before != "user").cast("int")))
    sums = m.groupBy("conversation_id", "_bucket").agg(
        F.coalesce(F.sum("_opens"), F.lit(0)).alias("_sure"), F.max(F.col("_opens").isNull()).alias("_unsure"), F.max_by("role", F.struct(*place)).alias("_last"),
    )
    across = Window.partitionBy("conversation_id").orderBy("_bucket")
    carried = F.coalesce(F.lag("_last").over(across) != "user", F.lit(True))
    sums = sums.withColumn("_first", (F.col("_unsure") & carried).cast("int"))
    total = F.sum(F.col("_sure") + F.col("_first")).over(across.rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.select("conversation_id", "_bucket", (F.coalesce(total, F.lit(0)) + F.col("_first") - 1).alias("_base"))
    m = m.withColumn("_upto", F.coalesce(F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)))
    return m.join(sums, ["conversation_id", "_bucket"]).withColumn("turn_idx", F.col("_base") + F.col("_upto")).drop("_bucket", "_opens", "_upto", "_base")


def turns(messages: DataFrame) -> DataFrame:
    """A row per turn: conversation_id, turn_idx, user_content, assistant_content (either may be null)."""
    by = with_turns(messages).groupBy("conversation_id", "turn_idx")
    side = lambda r: F.max(F.when(F.col("role") == r, F.col("content"))).alias(f"{r}_content")
    return by.agg(side("user"), side("assistant"))


def chunks(messages: DataFrame, window: int = 5, overlap: int = 2, user_id: str | None = None) -> DataFrame:
    """Chunks of `window` turns that start every window - overlap turns.

    A turn goes to the chunks that hold it (two or three rows), which are then grouped; the plan shuffles by conversation
    for the turns and by chunk for the texts, so a long conversation is spread over its chunks."""
    step = window - overlap
    m = with_turns(messages)
    first, last = F.greatest(F.lit(0), F.ceil((F.col("turn_idx") - window + 1) / step)), F.floor(F.col("turn_idx") / step)
    m = m.filter(F.col("turn_idx").isNotNull()).withColumn("chunk_idx", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("content", F.lit("")))
    entry = F.struct("turn_idx", F.when(F.col("role") == "user", 0).otherwise(1).alias("side"), "timestamp", "seq", F.col("role").alias("who"), line.alias("line"), "platform")
    g = m.groupBy("conversation_id", "chunk_idx").agg(
        F.sort_array(F.collect_list(entry)).alias("e"), F.min("turn_idx").alias("lo"), F.max("turn_idx").alias("hi"), F.countDistinct("turn_idx").cast("int").alias("turn_count"),
        F.min("timestamp").alias("start_timestamp"), F.max("timestamp").alias("end_timestamp"),
    )
    g = g.withColumn("content", F.array_join(F.transform("e", lambda x: x["line"]), "\n\n"))
    return g.select(
        "conversation_id", "chunk_idx", F.concat_ws("-", F.col("lo") + 1, F.col("hi") + 1).alias("turn_range"), T.or_else(F.get("e", F.lit(0))["platform"], F.lit("chatgpt")).alias("platform"),
        "content", F.array_distinct(F.transform("e", lambda x: x["who"])).alias("speakers"), "turn_count", "start_timestamp", "end_timestamp", T.topics(F.col("content")).alias("topics"),
        F.array().cast("array<string>").alias("hypothetical_questions"), F.lit(user_id).cast("string").alias("user_id"),
    )


def chunk_statistics(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count("*").alias("total_chunks"), F.coalesce(F.round(F.avg("turn_count"), 2), F.lit(0.0)).alias("avg_turns"), F.coalesce(F.round(F.avg(F.length("content"))), F.lit(0.0)).cast("long").alias("avg_length"),
    )


def topic_counts(chunks: DataFrame) -> DataFrame:
    return chunks.select(F.explode("topics").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


def platform_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("platform").agg(F.count("*").alias("n"))


def conversation_rollup(chunks: DataFrame, limit: int = 10) -> DataFrame:
    by = chunks.groupBy("conversation_id").agg(F.count("*").alias("chunk_count"), F.min("start_timestamp").alias("started"), F.max("end_timestamp").alias("ended"))
    return by.orderBy(F.desc("ended"), "conversation_id").limit(limit)


def recent_topics(messages: DataFrame, last: int = 20, most: int = 10) -> DataFrame:
    """Topics of the last messages of each conversation, in their order."""
    from ..functions.patterns import RECENT_TERMS

    back = Window.partitionBy("conversation_id").orderBy(F.desc("timestamp"), F.desc("seq"))
    m = messages.withColumn("back", F.row_number().over(back)).filter(F.col("back") <= last)
    m = m.select("conversation_id", F.struct("timestamp", "seq", T.topics(F.col("content"), RECENT_TERMS, most=1_000_000).alias("t")).alias("e"))
    g = m.groupBy("conversation_id").agg(F.sort_array(F.collect_list("e")).alias("e"))
    return g.select("conversation_id", F.slice(F.array_distinct(F.flatten(F.transform("e", lambda x: x["t"]))), 1, most).alias("topics"))
