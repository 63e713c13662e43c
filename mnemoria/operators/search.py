"""Exact vector search over stored messages: thresholds, recency, tenants, filters before or after the cut, top k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import cosine_distance
from .knn import nearest_batch
from .substrings import ilike

ORDER = ["distance", "message_id"]


def nearest(corpus: DataFrame, query: DataFrame, k: int = 5, threshold: float | None = 0.5, where: Column | None = None) -> DataFrame:
    """The k rows of corpus(message_id, embedding, ...) nearest to one query row (embedding), nearest first.

    The one query row is broadcast; the cut is a partial top k in each task and one merge of k rows a task."""
    rows = corpus if where is None else corpus.filter(where)
    q = query.select(F.col("embedding").alias("_q")).limit(1)
    rows = rows.join(F.broadcast(q)).withColumn("distance", cosine_distance(F.col("embedding"), F.col("_q"))).drop("_q")
    rows = rows.filter(F.col("distance").isNotNull() & ~F.isnan("distance") if threshold is None else F.col("distance") < threshold)
    return rows.orderBy(*ORDER).limit(k)


def older_than(seconds: int, as_of_ms: int) -> Column:
    """Recency exclusion: rows before as_of_ms by more than the given seconds."""
    return F.col("timestamp") < F.lit(as_of_ms - seconds * 1000)


def for_tenant(df: DataFrame, user_id: str, anonymous: bool = False) -> DataFrame:
    own = F.col("user_id") == user_id
    return df.filter(own | (F.col("user_id") == "00000000-0000-0000-0000-000000000000") if anonymous else own)


def having(df: DataFrame, column: str, *values: str) -> DataFrame:
    """Rows whose array (topics, questions) has one of the values; a null array has none."""
    return df.filter(F.arrays_overlap(F.col(column), F.array(*[F.lit(v) for v in values])))


def search_chunks(corpus: DataFrame, query: DataFrame, user_id: str, platform: str | None = None, threshold: float = 0.5, k: int = 5) -> DataFrame:
    """Similarity search within a tenant: similarity > threshold, highest first."""
    rows = for_tenant(corpus, user_id)
    if platform is not None:
        rows = rows.filter(F.col("platform") == platform)
    hits = nearest(rows, query, k, 1.0 - threshold)
    return hits.withColumn("similarity", 1.0 - F.col("distance"))


MESSAGE_HIT = ["id", "content", "role", "conversation_id", "model", "msg_timestamp", "message_id", "source", "created_at", "synced_at", "distance"]
RECENT_HIT = ["id", "content", "msg_timestamp", "source", "distance"]
CHUNK_HIT = ["id", "turn_range", "conversation_id", "content", "topics", "similarity"]


def projected(hits: DataFrame, form: list[str]) -> DataFrame:
    """Hits in one of the forms in which they are given out: of messages, of messages without the latest, of chunks."""
    h = hits.withColumnRenamed("timestamp", "msg_timestamp") if "msg_timestamp" in form and "msg_timestamp" not in hits.columns else hits
    return (h.withColumn("similarity", 1.0 - F.col("distance")) if "similarity" in form and "similarity" not in h.columns else h).select(*form)


def in_conversation(hits: DataFrame, conversation_id: str) -> DataFrame:
    """Of the hits, after the cut, those of one conversation."""
    return hits.filter(F.col("conversation_id") == conversation_id)


def post_filtered_batch(corpus: DataFrame, queries: DataFrame, where: Column, k: int = 5, threshold: float | None = 0.5, limit: int | None = None) -> DataFrame:
    """The filter after the cut, for each query: of the k nearest, those that pass (at most `limit`), ranked anew."""
    best = nearest_batch(corpus, queries, k, threshold, exclude_self=False).drop("rank")
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    hits = best.join(corpus.filter(where).select("vec_id"), "vec_id").withColumn("rank", F.row_number().over(order))
    return (hits if limit is None else hits.filter(F.col("rank") <= limit)).select("query_id", "rank", "vec_id", "distance")


def find_similar(corpus: DataFrame, message_id: str, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """Nearest rows of a stored row, itself left out before the cut."""
    own = corpus.filter(F.col("message_id") == message_id)
    return nearest(corpus.filter(F.col("message_id") != message_id), own, k, threshold)


def post_filtered(corpus: DataFrame, query: DataFrame, where: Column, k: int = 5, threshold: float = 0.5) -> DataFrame:
    """The filter after the cut: of the k nearest, those that pass (at most k)."""
    return nearest(corpus, query, k, threshold).filter(where)


def advanced(corpus: DataFrame, query: DataFrame, start_ms: int | None = None, end_ms: int | None = None, roles: tuple[str, ...] = (), limit: int = 10, threshold: float = 0.3) -> DataFrame:
    """Twice the limit nearest below the threshold, then dates (inclusive) and roles, then the limit."""
    hits = nearest(corpus, query, 2 * limit, threshold)
    if start_ms is not None:
        hits = hits.filter(F.col("timestamp") >= start_ms)
    if end_ms is not None:
        hits = hits.filter(F.col("timestamp") <= end_ms)
    if roles:
        hits = hits.filter(F.col("role").isin(*roles))
    return hits.orderBy(*ORDER).limit(limit)


def conversation_context(messages: DataFrame, limit: int = 20) -> DataFrame:
    """The first messages of every conversation, in order."""
    order = Window.partitionBy("conversation_id").orderBy("timestamp", "seq")
    return messages.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def keyword(messages: DataFrame, q: str, limit: int = 5) -> DataFrame:
    """Messages that hold q in any case, newest first."""
    return messages.filter(ilike(F.col("content"), q)).orderBy(F.desc("timestamp"), "message_id").limit(limit)


def cross_platform_pairs(messages: DataFrame, limit: int = 5) -> DataFrame:
    """User and assistant messages of one conversation from different platforms, newest first.

    Pairs go by the user's time and id, then by the assistant's id, so only the `limit` first user messages that have a
    partner count, and of their conversations' assistants the `limit` least ids of each platform: no conversation's pairs
    are written out."""
    u = messages.filter("role = 'user'").select("conversation_id", F.col("message_id").alias("user_id"), F.col("platform").alias("user_platform"), F.col("timestamp").alias("t"))
    a = messages.filter("role = 'assistant'").select("conversation_id", F.col("message_id").alias("assistant_id"), F.col("platform").alias("assistant_platform"))
    # the least and the greatest platform say whether there is one other than the user's
    sides = a.groupBy(F.col("conversation_id").alias("_c")).agg(F.min("assistant_platform").alias("_low"), F.max("assistant_platform").alias("_high"))
    other = (F.col("user_platform") != F.col("_low")) | (F.col("user_platform") != F.col("_high"))
    first = u.join(sides, (F.col("conversation_id") == F.col("_c")) & other).drop("_c", "_low", "_high").orderBy(F.desc("t"), "user_id").limit(limit)
    few = F.broadcast(first.select(F.col("conversation_id").alias("_c")).distinct())  # at most `limit` rows
    order = Window.partitionBy("conversation_id", "assistant_platform").orderBy("assistant_id")
    a = a.join(few, F.col("conversation_id") == F.col("_c"), "left_semi").withColumn("_k", F.row_number().over(order)).filter(F.col("_k") <= limit).drop("_k")
    pairs = F.broadcast(first).join(a, "conversation_id").filter("user_platform <> assistant_platform")
    return pairs.orderBy(F.desc("t"), "user_id", "assistant_id").limit(limit)
