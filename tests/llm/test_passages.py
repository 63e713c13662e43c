"""Repeated passages against all windows of words."""

import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemoria.llm import passages as P
from mnemoria.llm import queries

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows):
    said = [(i, WORD.findall(t or "")) for i, t in rows]
    seen = Counter(tuple(w[k : k + 35]) for _, w in said for k in range(len(w) - 34))
    out = []
    for i, w in said:
        gone = [False] * len(w)
        for k in range(len(w) - 34):
            if seen[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = [True] * 35
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(w), sum(gone), spans, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(df):
    got = P.cut_passages(df)
    return sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", F.size("spans"), F.sha2("kept", 256)).collect()), key=str)


def corpus(seed, n):
    rng = random.Random(seed)
    blank = lambda: rng.choice([" ", " ", " ", "\n", "\t ", "  \r\n", " x "])
    text = lambda k, a=40: "".join(f"{rng.choice('abcdefé☃')}{rng.randint(0, a)}{blank()}" for _ in range(k))
    passages = [text(rng.choice([35, 36, 50, 120])) for _ in range(8)]
    rows = [(None, None), (-2, ""), (-3, " \n"), (-4, "ab " * 300), (-5, "ab " * 35), (-6, "x y " * 17), (-7, "x y z " * 40), (None, text(80)), (-8, text(34)), (-9, text(400, 0)), (-10, "w" * 50_000 + " " + text(60))]
    for i in range(n):
        r, t = rng.random(), None
        if r < 0.15:
            t = rng.choice(rows)[1]
        elif r < 0.4:
            w = (rng.choice(rows)[1] or "").split(" ")
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randint(0, len(w)), rng.choice(["Q", "zz zz", ""]))
            t = " ".join(w)
        else:
            t = text(rng.choice([3, 20, 60, 300]), rng.choice([1, 40]))
            if r < 0.8:
                p = rng.choice(passages).split(" ")
                t += " ".join(p[rng.randint(0, 4) :]) + " " + text(20)
        rows.append((i * 7 % 1009, t))
    return rows + [rows[5], rows[-1], (rows[-1][0], text(50))]


def frame(spark, rows, parts=5):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "doc_id long, text string, row string, n_words int").repartition(parts)


@pytest.mark.parametrize("seed", range(3))
def test_equals_all_windows(spark, seed):
    rows = corpus(seed, 250)
    assert run(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("gather", [400_000, 50])
def test_hot_prefixes(spark, monkeypatch, gather):
    """Prefixes with very many different strings, known to one task or to all together."""
    monkeypatch.setattr(P, "HOT", 16)
    monkeypatch.setattr(P, "GATHER", gather)
    rng = random.Random(9)
    word = lambda a: f"{a}{rng.randint(0, 99)}"
    passage = [word("p") for _ in range(45)]
    rows = [(i, " ".join([word("l") for _ in range(40)] + passage[: rng.randint(8, 45)] + [word("r") for _ in range(40)])) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(60)]
    assert run(frame(spark, rows)) == brute(rows)


def test_empty(spark):
    df = frame(spark, [], 1)
    assert run(df) == []
    assert set(P.cut_passages(df).columns) == {"doc_id", "row", *P.RESULT}


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    want = con.sql(f"SELECT doc_id, n_words, n_removed, kept_sha256 FROM ({queries.ORACLE['op11_repeated_passages']})").fetchall()
    got = sorted(map(tuple, queries.op11_repeated_passages(spark, "/root/testdata/sf0.001").collect()))
    assert got == sorted(want) and sum(r[2] for r in want)
