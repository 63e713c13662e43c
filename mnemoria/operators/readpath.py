"""From prompts to request bodies with context: topics, rewriting, embedding, search, blocks, insertion; for many prompts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import context, enrich, knn, search, turns

Embed = Callable[[DataFrame], DataFrame]


def asked(prompts: DataFrame, embed: Embed, history: DataFrame | None = None, model: Callable[[str], str] | None = None) -> DataFrame:
    """prompts(query_id, query, conversation_id) + rewritten, transformed, embedding.

    With a model, queries that are not specific are rewritten with the topics lately discussed in their conversation
    (history: messages); a model that fails leaves the query as it is. embed adds the embedding of the column content."""
    p = prompts
    if model is not None:
        none = F.array().cast("array<string>")
        if history is not None:
            topics = turns.recent_topics(history).withColumnRenamed("conversation_id", "_c")
            p = p.join(topics, p["conversation_id"] == topics["_c"], "left").drop("_c").withColumn("topics", F.coalesce("topics", none))
        else:
            p = p.withColumn("topics", none)
        p = enrich.rewrite_queries(p.withColumn("context", F.lit(None).cast("string")), model)
    else:
        p = p.withColumn("rewritten", F.col("query")).withColumn("transformed", F.lit(False))
    return embed(p.withColumn("content", F.col("rewritten"))).drop("content", "topics", "context", "success")


def search_messages(prompts: DataFrame, store: DataFrame, k: int = 5, threshold: float | None = 0.5, role: str | None = None, source: str | None = None, before: Column | None = None) -> DataFrame:
    """prompts(query_id, embedding), store(vec_id, embedding, content, role, source, timestamp) -> query_id, rank, vec_id,
    distance and the row's content, role, source, timestamp. `before` filters the store (pre-filter); role and source filter
    the k nearest (post-filter). A prompt without a vector, or without hits, has no rows."""
    hits = knn.nearest_batch(store, prompts.select(F.col("query_id").alias("vec_id"), "embedding"), k, threshold, exclude_self=False, where=before)
    rows = hits.drop("rank").join(store.select("vec_id", "content", "role", "source", "timestamp"), "vec_id")
    for name, value in (("role", role), ("source", source)):
        rows = rows if value is None else rows.filter(F.col(name) == value)
    order = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "vec_id", "distance", "content", "role", "source", "timestamp")


def contexts(prompts: DataFrame, store: DataFrame, as_of_ms: int, items: int = 3, threshold: float = 0.5, least_distance: float = 0.0, recent_seconds: int = 120) -> DataFrame:
    """prompts(query_id, embedding) -> query_id, items, block: the nearest messages that are not of the last recent_seconds."""
    hits = search_messages(prompts, store, items, threshold, before=search.older_than(recent_seconds, as_of_ms))
    return context.context_blocks(hits, least_distance)


def with_context(bodies: DataFrame, blocks: DataFrame, mode: str = "prepend") -> DataFrame:
    """bodies(query_id, body) -> + items, new_body: the body with its prompt's block; the body where there is none."""
    got = bodies.join(blocks.select("query_id", "items", "block"), "query_id", "left")
    return got.withColumn("items", F.coalesce("items", F.lit(0))).withColumn("new_body", context.inject(F.col("body"), F.col("block"), mode)).drop("block")
