"""Nearest rows of sets of queries: exact against numpy, and the recall of the search in cells."""

import numpy as np
import pytest

from mnemoria.operators import knn
from mnemoria.sources import adapters


def brute(rows, queries, k, threshold=None):
    out = []
    for q, x in queries:
        found = []
        for i, y in rows:
            if i == q or x is None or y is None or len(x) != len(y):
                continue
            a, b = np.array(x, float), np.array(y, float)
            size = np.linalg.norm(a) * np.linalg.norm(b)
            if np.isfinite(size) and size > 0:
                found.append((round(1 - float(a @ b) / size, 9), i))
        found = [f for f in sorted(found) if threshold is None or f[0] < threshold]
        out += [(q, n + 1, i) for n, (_, i) in enumerate(found[:k])]
    return sorted(out)


def table(spark, rows, parts=4):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)


def corpus(n=500, dim=12):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(dim) + 2 * (i % 3)).tolist()) for i in range(n)]
    rows += [(1000 + i, rows[5][1]) for i in range(30)]  # ties
    return rows + [(2000, None), (2001, [0.0] * dim), (2002, [None] + [1.0] * (dim - 1)), (2003, [float("nan")] * dim), (2004, [1.0, 2.0]), (2005, [1.0, 2.1]), (2006, [])]


@pytest.mark.parametrize("small", [False, True])
def test_exact(spark, monkeypatch, small):
    if small:  # many parts and blocks
        for name, size in (("PART", 300), ("BLOCK", 200), ("HELD", 100)):
            monkeypatch.setattr(knn, name, size)
    rows = corpus()
    queries = [r for r in rows if r[0] % 7 == 0 or r[0] > 1990 or r[0] == 5]
    got = knn.nearest_batch(table(spark, rows), table(spark, queries), 4, 0.4)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == brute(rows, queries, 4, 0.4)


def test_all_cells_are_exact_and_hot_cells_are_split(spark, monkeypatch, tmp_path):
    for name, size in (("PART", 300), ("BLOCK", 200)):
        monkeypatch.setattr(knn, name, size)
    rows = corpus() + [(3000 + i, [1.0] * 12) for i in range(250)]  # a third in one cell
    queries = [r for r in rows if r[0] % 7 == 0]
    df, q = table(spark, rows), table(spark, queries)
    want = brute(rows, queries, 4)
    cells = knn.learn_cells(df, 9).cache()
    got = knn.nearest_in_cells(df, q, cells, 4, probes=9)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == want
    knn.write_index(df, str(tmp_path / "index"), 9)
    got = knn.search_index(spark, str(tmp_path / "index"), q, 4, probes=9)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got.collect()) == want
    assert knn.nearest_in_cells(df.limit(0), q, cells, 4).collect() == []
    assert knn.learn_cells(df.limit(0)).collect() == []


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    v = adapters.vectors(spark, f"/root/testdata/{sf}")
    q = v.filter("vec_id % 20 = 0")
    cells = knn.learn_cells(v).cache()
    got = knn.recall(knn.nearest_in_cells(v, q, cells), knn.nearest_batch(v, q)).first()
    print(sf, got, cells.select("probes").first(), cells.count())
    assert got["wanted"] == 5 * got["queries"] and got["recall"] >= 0.95
