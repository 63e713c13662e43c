"""Sparse bucket-pointer refinement against all 50-byte strings."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from mnemoria.llm import suffix_dedup as S


def brute(rows):
    least = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for k in range(len(b) - 49):
                w = b[k : k + 50]
                least[w] = min(i, least.get(w, i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if i is not None and least[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        kept = bytes(c for c, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def run(df):
    got = S.cut_repeats(df)
    return sorted(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    passages = [text(12) for _ in range(5)] + [text(60)]
    rows = [(-1, None), (-2, ""), (-3, "ab" * 300), (-4, "ab" * 200), (-5, "x" * 49), (-6, "x" * 50), (-7, "x" * 51)]
    for i in range(n):
        r = rng.random()
        if r < 0.15 and i:
            t = rows[rng.randrange(len(rows))][1]
        elif r < 0.4 and i:
            t = rows[rng.randrange(len(rows))][1] or ""
            for _ in range(rng.randint(1, 3)):
                k = rng.randint(0, len(t))
                t = t[:k] + rng.choice(["", "Q", "zz zz"]) + t[k + rng.randint(0, 4) :]
        else:
            t = text(rng.choice([3, 20, 60, 300]))
            if r < 0.8:
                p = rng.choice(passages)
                k = rng.randint(0, len(t))
                t = t[:k] + p[rng.randint(0, 20) : len(p) - rng.randint(0, 20)] + t[k:]
        rows.append((i * 7 % 1009, t))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_strings(spark, seed):
    rows = corpus(seed, 250)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, row string, key string").repartition(5)
    assert run(df) == brute(rows)


def test_hot_passage_with_own_surroundings(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 16)
    rng = random.Random(9)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(130))
    rows = [(i, "".join(rng.choice("ijklmnop ") for _ in range(90)) + passage[: rng.randint(100, 130)] + "".join(rng.choice("qrstu ") for _ in range(90))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert run(df) == brute(rows)


def test_repeated_and_null_ids(spark):
    a, b = "some text that is long enough to be found again, surely it is", "another text of which two thirds are not found anywhere in here"
    rows = [(1, a), (2, a), (2, a), (2, b + a), (None, a), (3, b), (0, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(df) == brute(rows)
    assert run(df.limit(0)) == []


def test_columns_of_the_results_names(spark):
    docs = spark.createDataFrame([(1, "a" * 60, 5, "k", 7), (2, "a" * 60, 6, "l", 8)], "doc_id long, text string, n_bytes int, kept string, other int")
    got = S.cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "other").collect()
    assert sorted(map(tuple, got)) == [(1, 60, 0, 7), (2, 60, 60, 8)]
