"""Token-bounded batches and model stages; models are callables that run on the executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import files
from ..sources.scratch import materialised
from .chains import token_batches


def greedy_batches(lengths: list[int], most: int) -> list[int]:
    """Batch numbers by next fit in order; what exceeds `most` alone is a batch of its own."""
    out, batch, total, used = [], 0, 0, False
    for n in lengths:
        if n > most:
            batch += used
            out.append(batch)
            batch, total, used = batch + 1, 0, False
        else:
            if used and total + n > most:
                batch, total = batch + 1, 0
            out.append(batch)
            total, used = total + n, True
    return out


def embed(df: DataFrame, model: Callable[[list[str]], list[list[float]]], content: str = "content", most: int = 4000) -> DataFrame:
    """Adds embedding. Each task sends its rows to the model in token-bounded batches, in order; a failing model fails
    the task, which Spark retries."""
    from pyspark.sql import types as S

    schema = S.StructType([*[f for f in df.schema.fields if f.name != "embedding"], S.StructField("embedding", S.ArrayType(S.FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [(x or "")[: most * 4] for x in pdf[content]]
            number = greedy_batches([-(-len(x or "") // 4) for x in pdf[content]], most)
            vectors: list = []
            start = 0
            for i in range(1, len(texts) + 1):
                if i == len(texts) or number[i] != number[start]:
                    vectors += model(texts[start:i])
                    start = i
            yield pdf.drop(columns="embedding", errors="ignore").assign(embedding=[list(map(float, v)) for v in vectors])

    return df.mapInPandas(run, schema)


def call_model(df: DataFrame, prompt: str, answer: str, model: Callable[[str], str]) -> DataFrame:
    """Adds the model's answer to a prompt column; null where the model fails."""
    schema = df.withColumn(answer, F.lit(None).cast("string")).schema

    def ask(p):
        try:
            return model(p)
        except Exception:  # a model's failure is a null answer, which callers replace
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{answer: [ask(p) for p in pdf[prompt]]})

    return df.mapInPandas(run, schema)


def call_remembering(df: DataFrame, prompt: str, answer: str, model: Callable[[str], str], memory: str, slices: int = 8) -> DataFrame:
    """As call_model, with a memory of answers in a folder: a prompt is asked once, however many rows have it and however
    often this is called. Prompts are known by a hash. New ones are asked in `slices` by their hash, each written before the
    next is asked, so that a call that fails goes on where it stopped. Failures are not remembered. Runs jobs."""
    spark = df.sparkSession
    key = lambda c: F.sha2(F.col(c), 256)
    schema = "_k string, _answer string, slice int"

    def known() -> DataFrame:
        there = [n for n in files.names(spark, memory) if n.startswith("slice=")]
        return spark.read.schema(schema).parquet(memory) if there else spark.createDataFrame([], schema)

    rows = df.withColumn("_k", key(prompt))
    wanted = rows.filter(F.col(prompt).isNotNull()).groupBy("_k").agg(F.first(prompt).alias("_p"))
    fresh = materialised(wanted.join(known().select("_k"), "_k", "left_anti").withColumn("slice", F.pmod(F.xxhash64("_k"), F.lit(slices)).cast("int")))
    for r in fresh.groupBy("slice").count().orderBy("slice").collect():  # at most `slices` rows
        some = call_model(fresh.filter(F.col("slice") == r["slice"]), "_p", "_answer", model).filter(F.col("_answer").isNotNull())
        some.select("_k", "_answer", "slice").write.mode("append").partitionBy("slice").parquet(memory)
    got = known().groupBy(F.col("_k").alias("_k2")).agg(F.min("_answer").alias(answer))
    return rows.join(got, F.col("_k") == F.col("_k2"), "left").drop("_k", "_k2")


def _ask(df: DataFrame, prompt: str, answer: str, model: Callable[[str], str], memory: str | None) -> DataFrame:
    return call_model(df, prompt, answer, model) if memory is None else call_remembering(df, prompt, answer, model, memory)


def rewrite_queries(queries: DataFrame, model: Callable[[str], str], memory: str | None = None) -> DataFrame:
    """queries(query, topics, context) + rewritten, transformed, success. Specific queries are left as they are; only
    the rest reach the model, and keep their text if it fails. memory: a folder of answers (call_remembering)."""
    specific = T.is_specific(F.col("query"))
    as_is = queries.filter(specific).withColumn("rewritten", F.col("query")).withColumn("transformed", F.lit(False)).withColumn("success", F.lit(True))
    asked = _ask(queries.filter(~specific).withColumn("_p", T.rewrite_prompt(F.col("query"), F.col("topics"), F.col("context"))), "_p", "_a", model, memory)
    ok = F.coalesce(F.trim("_a"), F.lit("")) != ""
    asked = asked.withColumn("rewritten", F.when(ok, F.trim("_a")).otherwise(F.col("query"))).withColumn("transformed", ok).withColumn("success", ok).drop("_p", "_a")
    return as_is.unionByName(asked)


def generate_questions(chunks: DataFrame, model: Callable[[str], str], k: int = 5, memory: str | None = None) -> DataFrame:
    """Sets hypothetical_questions from the model's answers; none where it fails. memory: a folder of answers."""
    asked = _ask(chunks.withColumn("_p", T.question_prompt(F.col("content"), F.col("topics"), k)), "_p", "_a", model, memory)
    q = F.coalesce(T.parse_questions(F.col("_a"), k), F.array().cast("array<string>"))
    return asked.withColumn("hypothetical_questions", q).drop("_p", "_a")


def question_totals(chunks: DataFrame) -> DataFrame:
    n = F.size("hypothetical_questions")
    return chunks.agg(F.count("*").alias("processed"), F.coalesce(F.sum(n), F.lit(0)).alias("questions"), F.count_if(n == 0).alias("failed"))


def hashed_embedding(df: DataFrame, content: str = "content", dim: int = 64) -> DataFrame:
    """A deterministic embedding for tests and dry runs: words hashed to `dim` components, normalised."""
    words = F.filter(F.split(F.lower(F.coalesce(content, F.lit(""))), r"\W+"), lambda w: w != "")
    slots = F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(dim)))
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(slots, lambda s: s == i)).cast("double"))
    d = df.withColumn("_c", counts)
    length = F.sqrt(F.aggregate("_c", F.lit(0.0), lambda s, x: s + x * x))
    return d.withColumn("embedding", F.transform("_c", lambda x: F.coalesce(F.try_divide(x, length), F.lit(0.0)).cast("float"))).drop("_c")
