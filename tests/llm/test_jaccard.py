"""The parity-sketch join against all pairs."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mnemoria.llm import graph, jaccard
from mnemoria.llm.common import flat


def brute(rows):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[:x]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return sorted((i, len(sets[i]), find(i)) for i in ids)


def corpus(seed, n=220):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [f"p{i}" for i in range(60)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "One two THREE"), (4, "one two three"), (5, "é x b"), (6, "a b c d e"), (7, "A b\tc\vd e")]
    while len(rows) < n:
        if len(rows) > 20 and rng.random() < 0.6:
            t = rng.choice(rows)[1]
            w = (t or "").split()
            for _ in range(rng.choice([0, 1, 1, 2, 4, 8])):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(words)
        else:
            w = [rng.choice(words) for _ in range(rng.choice([1, 4, 6, 9, 15, 30, 80, 200, 700]))]
            if rng.random() < 0.4:
                w[3:3] = passage
        rows.append((len(rows) * 3, " ".join(w)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(4))
def test_equals_all_pairs(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, n string, a int")
    assert sorted(map(tuple, jaccard.join(df).collect())) == brute(rows)


def test_large_cells_lose_no_link(spark):
    """Thousands of rows in one cell, of which the first links with none: the tiles find the rest."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(40)]
    rows = [(0, " ".join(base[:22] + [f"z{i}" for i in range(24)]))]
    for i in range(1, 700):
        w = list(base)
        w[rng.randrange(40)] = f"v{i}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df).collect())) == brute(rows)


def test_small_sets_that_crowd_into_few_cells(spark):
    """4 of 5 shingles are shared, and all fall in one cell of the band: no cell of the two is equal."""
    band = {low: m for low, _, _, m in jaccard.bands(5, 80, 100)}
    low = max(x for x in band if x <= 4)
    part = lambda h: ((jaccard.mix64(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)) * np.uint64(band[low])) >> np.uint64(32)
    rng, rows = np.random.default_rng(8), []
    while len(rows) < 6:
        texts = [" ".join(f"w{x}" for x in r) for r in rng.integers(0, 10**6, (20000, 9))]
        owner, h = jaccard.shingles(*flat(pa.array(texts)), 5)
        cell = part(h).reshape(-1, 5)
        for i in np.flatnonzero((cell == cell[:, :1]).all(1)):
            rows += [(len(rows), texts[i]), (len(rows) + 1, texts[i].rsplit(" ", 1)[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df).collect())) == brute(rows)


def test_empty_null_and_repeated(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "a b c d e f"), (1, "a b c d e f"), (2, None)], "doc_id long, text string")
    assert sorted(map(tuple, jaccard.join(df).collect()), key=str) == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (None, 2, None)]
    assert jaccard.join(df.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        root[q] = p
    got = dict(map(tuple, graph.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: find(i) for e in edges if e[0] != e[1] for i in e}
