"""Spherical-cap filters against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from mnemoria.llm import embedding_dedup as E


def brute(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.array([v / np.linalg.norm(v) for _, v in ok])
    link = x @ x.T >= 0.95
    np.fill_diagonal(link, False)
    low = E._forest(link, np.array([i for i, _ in ok]))
    got = {i: (int(n), int(c)) for (i, _), n, c in zip(ok, link.sum(1), low)}
    return sorted((i, *got.get(i, (0, i)), got.get(i, (0, i))[1] == i) for i, _ in rows)


@pytest.mark.parametrize("seed", range(2))
def test_equals_all_pairs(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    centres = rng.standard_normal((40, 32))
    for i in range(3000):
        c = centres[min(int(rng.exponential(6)), 39)] if rng.random() < 0.7 else rng.standard_normal(32)
        rows.append((i * 2, (c + rng.choice([0, 0.05, 0.15, 0.22]) * rng.standard_normal(32)).astype(np.float32).tolist()))
    rows += [(7001, None), (7003, [0.0] * 32), (7005, [1.0, None] + [0.0] * 30), (7007, [float("nan")] * 32), (7009, []), (7011, [float("inf")] + [1.0] * 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got, want = sorted(map(tuple, E.near_duplicates(df).collect())), brute(rows)
    assert len(got) == len(want)
    linked = sum(w[1] for w in want)
    assert sum(abs(g[1] - w[1]) for g, w in zip(got, want)) <= linked * 1e-4
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[2] != w[2] for g, w in zip(got, want)) <= 2


def test_small_tables(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 3), (2, [2.0, 0.0], 3), (3, [0.0, 1.0], 3), (4, [1.0], 3), (5, [-1.0, 0.0], 3)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, E.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True)]
    assert E.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("n", [20_000, 200_000])
def test_links_at_the_threshold(spark, n):
    """Planted pairs of cosine 0.951 to 0.955 among many vectors: nearly all are found at either size."""
    rng = np.random.default_rng(n)
    pairs = 5000
    x = rng.standard_normal((n - pairs, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = rng.standard_normal((pairs, 64))
    y -= (x[:pairs] * y).sum(1, keepdims=True) * x[:pairs]
    c = rng.uniform(0.951, 0.955, (pairs, 1))
    y = c * x[:pairs] + np.sqrt(1 - c * c) * y / np.linalg.norm(y, axis=1, keepdims=True)
    table = pa.table({"vec_id": np.arange(n), "embedding": list(np.vstack([x, y]).astype(np.float32))})
    df = spark.createDataFrame(table)
    assert dict(df.dtypes)["embedding"] == "array<float>"
    found = E.near_duplicates(df).filter("n_links > 0").filter(f"vec_id >= {n - pairs}").count()
    assert found >= 0.999 * pairs


def test_codes_grow_with_the_table():
    words = lambda n: int(np.ceil(np.sqrt(n / 16)))
    got = [E.codes_for(64, words(n), 0.95, 12, 6, 5e-4, 1000) for n in (2_000, 200_000, 20_000_000, 1_000_000_000)]
    assert got == sorted(got) and got[0] <= 2 and 3 <= got[-1] <= 7


def test_null_ids_and_clashing_columns(spark):
    v = [1.0, 2.0]
    df = spark.createDataFrame([(None, v, 1, "x"), (1, v, 2, "y"), (2, v, 3, "z")], "vec_id long, embedding array<double>, rep int, filter string")
    got = sorted(map(tuple, E.near_duplicates(df).collect()), key=str)
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (None, 0, None, True)]
