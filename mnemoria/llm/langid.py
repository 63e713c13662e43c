"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary classifier of byte 3-grams (log odds of the 3-gram between
the languages whose bit is 1 and those whose bit is 0) predicts the bit from a whole text; the codeword with the least
weighted loss wins. A text is flagged ambiguous if its two best codewords are close, or if it is unlike its best one: its
evidence a 3-gram is below `least` of what the language's learning rows have on average (half in another language leaves
about half of it, a foreign language under a fifth), by over 3 standard errors. Few 3-grams have large errors, so a short
text is seldom unlike; a text of a few letters is flagged only where its codewords are close. Learning rows whose languages
hardly differ (under `LEAST_USUAL` a 3-gram) can't tell what is unlike. The 3-gram counts come from
all learning rows, summed in the tasks; the model has a fixed size (feature space x languages).

Null texts and texts without a letter are `und` with score 0. Very long texts are read whole. Learning rows with a null
language or text are left out; with no learning rows everything is `und`. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, small_batches, text_batches

#: A byte's class, 6 bits: letters without case, all other ASCII as one, bytes of other scripts by their low five bits.
CLASS = np.zeros(256, np.int64)
CLASS[65:91] = CLASS[97:123] = np.arange(1, 27)
CLASS[128:] = 32 + (np.arange(128, 256) & 31)
GRAMS = 1 << 18
#: Bytes of text that are turned into 3-grams at a time.
BATCH = 1 << 18
LETTER = r"\p{L}"
#: Least mean evidence of a 3-gram, in nats, of a language that texts can be unlike; the given four have 3 to 6.
LEAST_USUAL = 0.5


def _grams(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """3-gram numbers of all texts, each padded by one separator at its ends, and the offsets of the texts in them."""
    n = np.diff(off)
    text = np.repeat(np.arange(len(n)), n)
    c = np.zeros(len(buf) + 2 * len(n), np.int64)
    c[np.arange(len(buf)) + 2 * text + 1] = CLASS[buf]
    g = (c[:-2] << 12) | (c[1:-1] << 6) | c[2:] if len(c) > 2 else np.zeros(0, np.int64)
    ends = off + 2 * np.arange(len(off))  # 3-grams over the seam of two texts are cleared
    g = np.append(g, [0, 0])
    seams = ends[1:]
    g[np.concatenate([seams - 1, seams - 2])] = 0
    return g, ends


def codewords(k: int, seed: int = 5) -> np.ndarray:
    """k codewords of 0/1: all splits of up to 5 languages, else balanced random splits, 6 bits per doubling."""
    if k <= 5:
        cols = [[(j >> (i - 1)) & 1 if i else 1 for i in range(k)] for j in range(2 ** max(k - 1, 0) - 1)]
        return np.array(cols, np.int64).T.reshape(k, -1)
    rng, bits = np.random.default_rng(seed), 6 * int(np.ceil(np.log2(k)))
    return np.stack([rng.permutation(np.arange(k) % 2) for _ in range(bits)], axis=1)


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # language x bit
    weights: np.ndarray  # bit x 3-gram
    value: np.ndarray  # weight of each bit's loss
    usual: np.ndarray  # evidence of a 3-gram for its own language, mean by language
    error: np.ndarray  # and its standard deviation


def train(docs: DataFrame, learn: Column, most_languages: int = 512) -> Model:
    """docs(text, lang), learn: which rows to learn from. All languages are learned: GRAMS numbers each reach the driver, so
    a column with over most_languages values is refused."""
    small_batches(docs)
    rows = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in text_batches(batches, "text", BATCH):
            g, ends = _grams(*flat(b.column(0)))
            names, at = np.unique(np.array(b.column(1).to_pylist(), object).astype(str), return_inverse=True)
            of = np.repeat(at, np.diff(ends))
            for i, name in enumerate(names):
                total.setdefault(str(name), np.zeros(GRAMS, np.int64))
                total[str(name)] += np.bincount(g[: len(of)][of == i], minlength=GRAMS)
            if len(total) > 32:
                yield from _rows(total)
                total = {}
        yield from _rows(total)

    def _rows(total):
        for name, n in total.items():
            i = np.flatnonzero(n)
            yield pa.record_batch([pa.array([name] * len(i), pa.string()), pa.array(i.astype(np.int32)), pa.array(n[i])], names=["lang", "gram", "n"])

    sums = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    sums = sums.groupBy("lang").agg(F.collect_list(F.struct("gram", "n")).alias("g"))
    if rows.select("lang").distinct().limit(most_languages + 1).count() > most_languages:
        raise ValueError(f"lang has over {most_languages} values")
    got = sorted((r["lang"], r["g"]) for r in sums.collect())
    if not got:
        return Model([], np.zeros((0, 0), np.int64), np.zeros((0, GRAMS), np.float32), np.zeros(0), np.zeros(0), np.zeros(0))
    n = np.zeros((len(got), GRAMS))
    for i, (_, g) in enumerate(got):
        n[i, [x["gram"] for x in g]] = [x["n"] for x in g]
    n[:, 0] = 0  # runs of separators say nothing
    p = (n + 0.5) / (n + 0.5).sum(1, keepdims=True)  # every language counts alike
    code = codewords(len(got))
    one, zero = (code.T @ p) / code.sum(0)[:, None], ((1 - code).T @ p) / np.maximum(1, (1 - code).sum(0))[:, None]
    odds = np.log(one / zero).T if code.shape[1] else np.zeros((GRAMS, 0))
    odds[0] = 0
    value = ((one - zero).T * odds).sum(0) / 2  # mean margin of a bit: how well its languages differ
    value = value / value.sum() if len(value) else value
    share = n / np.maximum(n.sum(1, keepdims=True), 1)
    own = [odds @ (value * (2 * c - 1)) for c in code]
    usual = np.array([q @ x for q, x in zip(share, own)])
    # 3-grams overlap, so a text's independent ones are a third
    error = np.sqrt(np.array([3 * (q @ (x - u) ** 2) for q, x, u in zip(share, own, usual)]))
    return Model([x for x, _ in got], code, np.ascontiguousarray(odds.T, np.float32), value, usual, error)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", close: float = 0.6, least: float = 0.6, keep_text: bool = False) -> DataFrame:
    """docs(id, text) -> id, text (if it is kept), lang_pred, score (share of the best codeword's evidence, 0 to 1), runner_up, unlike (mixed or
    foreign: see above), ambiguous (unlike, or the best has less than `close` of the two best)."""
    small_batches(docs)
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # GRAMS x bits floats, whatever the input
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = held.value
        for b in text_batches(batches, "text", BATCH):
            g, ends = _grams(*flat(b.column(1)))
            used = np.maximum(1, np.add.reduceat((g != 0).astype(np.int64), ends[:-1]))
            k = len(m.languages)
            if k:
                margin = np.zeros((len(used), m.code.shape[1]))
                for bit in range(m.code.shape[1]):
                    margin[:, bit] = np.add.reduceat(m.weights[bit][g], ends[:-1], dtype=np.float64) / used
                # weighted logistic loss of each codeword; evidence grows with the length, up to 400 3-grams
                loss = np.logaddexp(0, -8 * margin[:, None, :] * (2 * m.code - 1)[None]) @ m.value
                p = -loss * np.minimum(used, 400)[:, None] / 20
                p = np.exp(p - p.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                best = p.argmax(1)
                score = p[np.arange(len(p)), best]
                p[np.arange(len(p)), best] = -1
                second, next_score = p.argmax(1), p.max(1)
                fit = (margin * (2 * m.code[best] - 1)) @ m.value
                unlike = (m.usual[best] >= LEAST_USUAL) & (fit < least * m.usual[best]) & (m.usual[best] - fit > 3 * m.error[best] / np.sqrt(used))
            letters = np.array(b.column(2).to_pylist(), bool)
            known = letters & (k > 0)
            names = m.languages or ["und"]
            yield pa.record_batch(
                [
                    b.column(0),
                    *([b.column(1)] if keep_text else []),
                    pa.array([names[best[i]] if known[i] else "und" for i in range(b.num_rows)], pa.string()),
                    pa.array(np.where(known, score if k else 0.0, 0.0), pa.float64()),
                    pa.array([names[second[i]] if known[i] and k > 1 else None for i in range(b.num_rows)], pa.string()),
                    pa.array(known & unlike if k else known, pa.bool_()),
                    pa.array(known & (unlike | (score < close * (score + np.maximum(next_score, 0)))) if k else known, pa.bool_()),
                ],
                names=[id_col, *(["text"] if keep_text else []), "lang_pred", "score", "runner_up", "unlike", "ambiguous"],
            )

    letters = F.coalesce(F.col("text").rlike(LETTER), F.lit(False))
    text = "text string, " if keep_text else ""
    return docs.select(id_col, "text", letters.alias("letters")).mapInArrow(run, f"{id_col} {kind.simpleString()}, {text}lang_pred string, score double, runner_up string, unlike boolean, ambiguous boolean")
