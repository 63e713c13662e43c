"""A training-corpus pipeline from the operators of mnemoria.llm.

documents(doc_id, text, lang, source, n_chars) pass five stages; all but the last return these columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoria.llm import jaccard, langid, mixing, pieces, queries, suffix_dedup
from mnemoria.llm.common import cut, forget, stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Least score of a verdict that corrects a given lang.
SURE = 0.999


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a language (null, or no letter) and those that the decoding flags ambiguous: mixed and foreign
    texts whatever their lang, and texts that are close to two languages unless their lang is one of the two, which
    settles it. So a short text without a lang goes where its few letters fit two languages alike; one with a lang stays.
    A missing lang becomes the predicted one, and so does one that a sure verdict (`SURE`) contradicts.

    Each half of the texts is judged by a model of the other half, so that none is evidence for itself; copies are in one
    half. A lang that the other half doesn't have can't be judged and stays, as all do where the other half has none."""
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    rows, out = docs.withColumn("row", F.struct("doc_id", "lang", "source", "n_chars")), []
    models = [langid.train(docs, half == 1 - h) for h in (0, 1)]
    for h, m in enumerate(models):
        m = m if m.languages else models[1 - h]
        got = langid.predict(rows.filter(half == h).select("row", "text"), m, "row", keep_text=True)
        given = F.col("row.lang")
        known = F.coalesce(given.isin(m.languages), F.lit(True))
        settled = ~F.col("unlike") & F.coalesce(given.isin(F.col("lang_pred"), F.col("runner_up")), F.lit(False))
        kept = got.filter((F.col("lang_pred") != "und") & (~known | ~F.col("ambiguous") | settled))
        lang = F.when(known & ~F.col("ambiguous") & (F.col("score") >= SURE), F.col("lang_pred")).otherwise(F.coalesce(given, "lang_pred"))
        out.append(kept.select("row.doc_id", "text", lang.alias("lang"), "row.source", "row.n_chars"))
    return out[0].unionByName(out[1])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the smallest id stays; rows that repeat an id and its text stay once, with the least
    of their other values."""
    found = jaccard.join(docs)
    gone = cut(found.filter("doc_id is not null and component_id <> doc_id").select("doc_id").distinct())
    kept = docs.join(F.broadcast(gone) if gone.count() <= queries.BROADCAST_IDS else gone, "doc_id", "left_anti")
    if cut(found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("doc_id is not null and n > 1")).isEmpty():
        return kept.select(*COLUMNS)
    once = kept.filter("doc_id is not null").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("rest"))
    return kept.filter("doc_id is null").select(*COLUMNS).unionByName(once.select("doc_id", "text", "rest.*").select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes bytes that a smaller document has in a string of 50; what is left of a split character goes too."""
    got = suffix_dedup.cut_repeats(docs, characters=True)
    return got.withColumn("text", F.col("kept").cast("string")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows that share id and text share what is taken of them, the first of
    them what is left over."""
    got = mixing.mix(docs, queries.quality_weights(table(spark, sf_dir, "labels")))
    times = got.groupBy(F.col("doc_id").alias("i"), F.coalesce("text_hash", F.lit(0)).alias("h")).agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    times = cut(times.filter("times <> rows"))
    times = F.broadcast(times) if times.count() <= queries.BROADCAST_IDS else times
    same = F.col("doc_id").eqNullSafe(F.col("i")) & (F.coalesce(F.xxhash64("text"), F.lit(0)) == F.col("h"))
    kept = docs.join(times, same, "left").drop("i", "h")
    several = F.coalesce("rows", F.lit(0)) > 1
    alone = kept.filter(~several).withColumn("times", F.coalesce("times", F.lit(1)))
    order = Window.partitionBy("doc_id", "text").orderBy("lang", "source", "n_chars")
    shared = kept.filter(several).withColumn("times", F.floor(F.col("times") / F.col("rows")) + (F.row_number().over(order) <= F.col("times") % F.col("rows")).cast("long"))
    kept = alone.unionByName(shared).filter("times > 0")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text."""
    got = pieces.encode(docs, pieces.session_pieces(spark))
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language),
    ("ngram_jaccard_join", near_copies),
    ("suffix_array_dedup", repeated_passages),
    ("source_mixing", mixture),
    ("sentencepiece_encoding", encoded),
]

#: A learned model, 128-bit hashes and byte removal are not for SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage but the last is written to the shared folder and read again: the next ones read it several times, and
    must see the same rows each time, whatever executors are lost."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for _, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir))
        forget(before)
    return STAGES[-1][1](spark, docs, sf_dir)
