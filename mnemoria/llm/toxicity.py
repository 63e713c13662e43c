"""Toxicity from a weighted lexicon.

Texts are folded (case, homoglyphs of other scripts, digits and signs that stand for letters) and scanned once by an
Aho-Corasick automaton of the lexicon. An entry is a whole word or the beginning of words; it weighs its log odds in
toxic against other texts. Exception phrases, in which a listed word is harmless, take its weight back. The sum, also
normalised by length, goes through a logistic function.

Entries, weights, phrases and the logistic function are learned from a bounded sample of labelled rows. Null and empty
texts have no match and score as such; very long texts are scanned whole. Repeated rows get equal scores; with no
learning rows every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, text_batches

#: Homoglyphs: letters of other scripts (first row) and the Latin letters they look like (second row).
LOOKS = ("аеорсхуіјѕһԁԛԝвкмнтαβεικνορτυχ", "aeopcxyijshdqwbkmhtabeiknoptux")
#: Digits and signs, and the letters they stand for inside words.
SIGNS = ("013457@$", "oieastas")
SPLIT = r"[^\p{L}\p{M}\p{N}]+"


def fold_column(text: Column) -> Column:
    """The folded text: lower case, one blank between words, one at either end."""
    t = F.translate(F.translate(F.lower(F.coalesce(text, F.lit(""))), *LOOKS), *SIGNS)
    return F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), SPLIT, " ")


@dataclass
class Lexicon:
    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    phrases: dict[str, str] = field(default_factory=dict)  # phrase of two words -> the word it excuses
    logistic: np.ndarray | None = None

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, entries in enumerate((self.stems, self.words)):  # a word goes before the stem of the same letters
            for w, weight in entries.items():
                key = f" {w} " if k else f" {w}"
                a.add_word(key, (key, weight))
        for phrase, w in self.phrases.items():
            a.add_word(f" {phrase} ", (f" {phrase} ", -self.words.get(w, 0.0)))
        if len(a):
            a.make_automaton()
        return a


def features(folded: str, automaton) -> tuple[float, float, int]:
    """Weight of all matches, the same per hundred words, and the number of matches. Where a word and its stem both
    match, the word counts."""
    total, hits, n = 0.0, 0, folded.count(" ")
    if len(automaton):
        at: dict[int, tuple[int, float]] = {}
        for end, (key, w) in automaton.iter(folded):
            if w < 0:
                total += w
            elif (start := end - len(key) + 1) not in at or at[start][0] < len(key):
                at[start] = (len(key), w)
        hits = len(at)
        total += sum(w for _, w in at.values())
    return max(total, 0.0), max(total, 0.0) * 100 / (n + 50), hits


def _design(f: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(f)), f[:, 0] > 0, np.log1p(f[:, 0]), np.log1p(f[:, 1])])


def learn(docs: DataFrame, labels: DataFrame, learn_from: Column, most_rows: int = 20_000, least_texts: int = 4, stem: int = 4) -> Lexicon:
    """docs(doc_id, text), labels(doc_id, toxic); learn_from selects labelled rows by doc_id.

    most_rows bounds the sample of each label (smallest hashes of the id); the lexicon and the exception phrases have all
    words of the sample that qualify. So what is broadcast and what the driver sees doesn't grow with the table; texts
    themselves stay on the executors. An entry needs least_texts toxic
    texts and as many different words before it, so that copies of one text don't make entries."""
    picked = labels.filter(learn_from & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = picked.filter("toxic = 1").orderBy(*order).limit(most_rows).unionByName(picked.filter("toxic = 0").orderBy(*order).limit(most_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("toxic", fold_column(F.col("text")).alias("t")).cache()  # at most 2 * most_rows ids
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(1) or not n.get(0):
        rows.unpersist()
        return Lexicon()
    w = rows.select("toxic", F.array_distinct(F.filter(F.split("t", " "), lambda x: F.length(x) > 1)).alias("w"))
    own = F.transform("w", lambda x: F.concat(F.lit("="), x))
    first = F.array_distinct(F.transform(F.filter("w", lambda x: F.length(x) > stem), lambda x: F.concat(F.lit("^"), F.substring(x, 1, stem))))
    count = w.select("toxic", F.explode(F.concat(own, first)).alias("f")).groupBy("f").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (n[1] + 1.0)) - F.log((F.col("neg") + 0.5) / (n[0] + 1.0))
    best = count.filter(F.col("pos") >= least_texts).withColumn("o", odds).filter("o > 2.5")
    got = {r["f"]: r["o"] for r in best.collect()}
    # the words before an entry, in toxic and in other texts
    known = rows.sparkSession.createDataFrame([(k,) for k in got] or [("",)], "f string")
    parts = rows.select("toxic", F.filter(F.split("t", " "), lambda x: x != "").alias("p"))
    both = F.transform("p", lambda x, k: F.struct(x.alias("x"), F.coalesce(F.get("p", k - 1), F.lit("")).alias("before")))
    pair = parts.select("toxic", F.explode(both).alias("e")).select("toxic", "e.x", "e.before")
    pair = pair.select("toxic", "before", "x", F.explode(F.array(F.concat(F.lit("="), "x"), F.concat(F.lit("^"), F.substring("x", 1, stem)))).alias("f"))
    pair = pair.join(F.broadcast(known), "f").groupBy("f", "before").agg(F.sum("toxic").alias("pos"), F.sum(1 - F.col("toxic")).alias("neg"), F.approx_count_distinct("x").alias("forms"))
    near = pair.groupBy("f").agg(F.count_if(F.col("pos") > 0).alias("contexts"), F.sum("forms").alias("forms"))
    context = {r["f"]: r["contexts"] for r in near.collect()}
    lex = Lexicon()
    for f, o in got.items():
        if context.get(f, 0) >= least_texts * (1 if f[0] == "=" else 8):
            (lex.words if f[0] == "=" else lex.stems)[f[1:]] = float(o)
    harmless = pair.filter("neg >= 3 and pos = 0 and before <> '' and f like '=%'").collect()
    lex.phrases = {f"{r['before']} {r['f'][1:]}": r["f"][1:] for r in harmless if r["f"][1:] in lex.words}
    held = lex

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = held.automaton()
        for b in batches:
            f = np.array([features(t, a) for t in b.column(1).to_pylist()]).reshape(-1, 3)
            yield pa.record_batch([b.column(0).cast(pa.int32()), *[pa.array(f[:, i]) for i in range(3)]], names=["y", "a", "b", "c"])

    m = np.array(rows.mapInArrow(measure, "y int, a double, b double, c double").collect(), float)  # at most 2 * most_rows rows of four numbers
    rows.unpersist()
    x, y = _design(m[:, 1:]), m[:, 0]
    theta = np.zeros(x.shape[1])
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(len(theta))
        theta = theta + np.clip(np.linalg.solve(h, x.T @ (y - p) - 0.5 * theta), -5, 5)
    lex.logistic = theta
    return lex


def score(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", at: float = 0.7) -> DataFrame:
    """docs(id, text) -> id, score, predicted, matches (number), matched_weight."""
    small_batches(docs)
    held = docs.sparkSession.sparkContext.broadcast(lexicon)  # words of a bounded sample
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = held.value
        a = lex.automaton()
        for b in text_batches(batches, "t"):
            f = np.array([features(t, a) for t in b.column(1).to_pylist()]).reshape(-1, 3)
            s = 1 / (1 + np.exp(-np.clip(_design(f) @ lex.logistic, -30, 30))) if lex.logistic is not None else np.zeros(len(f))
            yield pa.record_batch([b.column(0), pa.array(s), pa.array((s >= at).astype(np.int32)), pa.array(f[:, 2].astype(np.int64)), pa.array(f[:, 0])], names=[id_col, "score", "predicted", "matches", "matched_weight"])

    return docs.select(id_col, fold_column(F.col("text")).alias("t")).mapInArrow(run, f"{id_col} {kind}, score double, predicted int, matches long, matched_weight double")
