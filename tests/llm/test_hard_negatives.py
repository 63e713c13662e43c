"""Products in a residue number system, and mined negatives against all pairs."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoria.llm import hard_negatives as H
from mnemoria.llm import queries

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("most,dim", [(3, 5), (256, 64), (40_000, 200), (2**30, 130), (2**31, 1)])
def test_products_are_exact(most, dim):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(-most, most + 1, (7, dim)), rng.integers(-most, most + 1, (9, dim))
    a[0], b[0], b[1] = most, most, -most
    bound = dim * most**2
    moduli = H.primes(2 * bound)
    assert math.prod(moduli) > 2 * bound
    got = H.products(H.residues(a, moduli), H.residues(b, moduli), moduli, bound)
    exact = a.astype(object) @ b.T.astype(object)
    assert (got == np.vectorize(lambda s: (s + 2**63) % 2**64 - 2**63)(exact).astype(np.int64)).all()


def brute(rows):
    ok = [(i, n, v) for n, (i, l, v) in enumerate(rows) if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ok = [(i, n, rows[n][1], [math.floor(256 * float(np.float32(x))) for x in v]) for i, n, v in ok]
    out = []
    for i, n, l, v in ok:
        if i % 100:
            continue
        s = sorted(((-sum(x * y for x, y in zip(v, w)), j, l == k) for j, m, k, w in ok if m != n and len(w) == len(v)))
        for p, j in [(-a, b) for a, b, same in s if same][:5]:
            found = [(-a, b) for a, b, same in s if not same and 30 * p <= -100 * a <= 90 * p][:10]
            out += [(i, j, r + 1, b, p, a) for r, (a, b) in enumerate(found)]
    return sorted(out)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((6, 16))
    rows = []
    for i in range(n):
        v = base[rng.integers(6)] * rng.choice([0.3, 0.6, 1]) + rng.choice([0, 0.2, 0.5]) * rng.standard_normal(16)
        rows.append((i * 10, int(rng.integers(4)), v.astype(np.float32).tolist()))
    rows += [rows[0], rows[0], rows[7], (100, None, rows[3][2]), (200, 1, None), (300, 1, [math.nan] * 16), (400, 1, [None] + [1.0] * 15), (500, 2, [math.inf] * 16)]
    return rows + [(600, 1, [1.0, 0.5]), (601, 1, [1.0, 0.4]), (602, 2, [0.5, 0.3]), (None, 1, rows[0][2]), (700, 1, []), (900, 3, [0.0] * 16)]


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs(spark, seed, monkeypatch):
    monkeypatch.setattr(H, "ANCHORS", 20)  # several groups of either side
    monkeypatch.setattr(H, "ROWS", 90)
    monkeypatch.setattr(H, "BLOCK", 7)
    rows = corpus(seed, 400)
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, label int, embedding array<float>, rank int, score int").repartition(3)
    got = H.mine(df, F.col("vec_id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute(rows)
    assert dict(got.dtypes)["rank"] == "int"


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert H.mine(df, F.col("vec_id") % 100 == 0).collect() == []


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(f"SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ({queries.ORACLE['op13_hard_negatives']})").fetchall()
    assert want and sorted(map(tuple, queries.op13_hard_negatives(spark, SF).collect())) == sorted(want)
