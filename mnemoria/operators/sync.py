"""Incremental synchronisation into keyed tables: what is new, upserts, deletes, the full step."""

from __future__ import annotations

from collections.abc import Callable
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import materialised
from . import turns

if TYPE_CHECKING:
    from .keyed import KeyedTable


def unsynced(captured: DataFrame, stored_ids: DataFrame) -> DataFrame:
    """Captured messages whose id is not stored."""
    return captured.join(stored_ids.select("message_id"), "message_id", "left_anti")


def to_messages(captured: DataFrame) -> DataFrame:
    """Captured messages as rows of the message table, with its defaults."""
    c = captured
    pick = lambda name: F.col(name) if name in c.columns else F.lit(None).cast("string")
    late = F.col("captured_at") if "captured_at" in c.columns else F.lit(None).cast("long")
    return c.select(
        T.message_key(F.col("message_id")).alias("id"), "message_id", "content", T.or_else(F.col("role"), F.lit("user")).alias("role"),
        T.or_else(F.col("conversation_id"), F.lit(None)).alias("conversation_id"), T.or_else(pick("model"), F.lit(None)).alias("model"),
        T.or_else(F.col("timestamp"), late, (0,)).alias("timestamp"), T.or_else(pick("platform"), F.lit("chatgpt")).alias("source"),
    )


def upsert(target: DataFrame, updates: DataFrame, key: str, version: str, last_wins: bool = True) -> DataFrame:
    """One row per key from both: the greatest version, or the least if the first wins. At equal versions updates win
    over the target if the last wins, and the other way round."""
    both = target.withColumn("_new", F.lit(0)).unionByName(updates.withColumn("_new", F.lit(1)))
    order = [F.desc(version), F.desc("_new")] if last_wins else [F.asc(version), F.asc("_new")]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_rank", "_new")


def delete_keys(target: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return target.join(keys.select(key), key, "left_anti")


def backfill_source(messages: DataFrame, value: str = "chatgpt") -> DataFrame:
    return messages.fillna({"source": value})


FREE = ["id", "turn_range", "conversation_id", "platform", "content", "speakers", "turn_count", "start_timestamp", "end_timestamp", "topics", "hypothetical_questions", "embedding", "created_at"]


def free_tier(chunks: DataFrame, user_id: str, platform: str = "chatgpt") -> DataFrame:
    """What a user of the free tier sees of the chunks: their own, of one platform, without tenant and times of storing."""
    return chunks.filter((F.col("platform") == platform) & (F.col("user_id") == user_id)).select(*FREE)


def without_ids(messages: DataFrame, key: str = "message_id") -> DataFrame:
    """One row: rows and those without an id, which no keyed table can take."""
    return messages.agg(F.count("*").alias("rows"), F.count_if(F.coalesce(F.col(key), F.lit("")) == "").alias("without_id"))


def update_counts(chunks: DataFrame, updates: DataFrame, key: str = "id") -> DataFrame:
    """One row of updates by key: updated (their key is stored), unknown (it isn't), without_id."""
    u = updates.select(F.col(key).alias("_k"))
    known = u.join(chunks.select(F.col(key).alias("_k")).distinct(), "_k", "left_semi").agg(F.count("*").alias("updated"))
    missing = F.coalesce(F.col("_k").cast("string"), F.lit("")) == ""
    all_of = u.agg(F.count("*").alias("n"), F.count_if(missing).alias("without_id"))
    return all_of.join(F.broadcast(known)).select("updated", (F.col("n") - F.col("without_id") - F.col("updated")).alias("unknown"), "without_id")  # one row each


def synced_ids(before: DataFrame, now: DataFrame, at_ms: int) -> DataFrame:
    """message_id, synced_at: the ids that were synchronised, with those of now; an id that is synchronised again is there
    as often."""
    return before.select("message_id", "synced_at").unionByName(now.select("message_id", F.lit(at_ms).cast("long").alias("synced_at")))


def set_questions(chunks: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """New questions where there are any, else the old ones."""
    u = updates.select(key, F.col("hypothetical_questions").alias("_q"))
    return chunks.join(u, key, "left").withColumn("hypothetical_questions", F.coalesce("_q", "hypothetical_questions")).drop("_q")


def synchronise(captured: DataFrame, stored: DataFrame, embed: Callable[[DataFrame], DataFrame], user_id: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(messages, chunks): the new messages with their embeddings, and the chunks of all conversations that they touch,
    computed over the whole conversations and keyed by user, conversation and range."""
    fresh = unsynced(captured, stored)
    rows = embed(to_messages(fresh))
    touched = captured.join(fresh.select("conversation_id").distinct(), "conversation_id", "left_semi")
    c = turns.chunks(touched, user_id=user_id)
    return rows, embed(c.withColumn("id", T.message_key(F.col("user_id"), F.col("conversation_id"), F.col("turn_range"))))


def synchronise_tables(captured: DataFrame, messages: KeyedTable, chunks: KeyedTable, embed: Callable[[DataFrame], DataFrame], user_id: str | None = None, writer: str = "sync", number: int | None = None) -> tuple[int, int]:
    """The full step into keyed tables of messages and chunks: only what is not stored is embedded and written. -> buckets
    of either table that changed. A step that stopped between the tables is made whole when it is run again: chunks are
    those of conversations with messages that are not stored, or whose chunks are not."""
    stored, had = messages.read(), chunks.read()
    old = captured.limit(0) if stored is None else stored
    rows, made = synchronise(captured, old, embed, user_id)
    if stored is not None:  # conversations that are stored, but have no chunks yet
        with_chunks = made.select("conversation_id").limit(0) if had is None else had.select("conversation_id")
        lost = captured.join(stored.select("message_id"), "message_id", "left_semi").join(with_chunks.distinct(), "conversation_id", "left_anti")
        again = turns.chunks(captured.join(lost.select("conversation_id").distinct(), "conversation_id", "left_semi"), user_id=user_id)
        made = made.unionByName(embed(again.withColumn("id", T.message_key(F.col("user_id"), F.col("conversation_id"), F.col("turn_range"))))).dropDuplicates(["id"])
    made = materialised(made)  # before the messages are stored, on which it depends
    return len(messages.upsert(rows, writer, number)), len(chunks.upsert(made, writer, number))
