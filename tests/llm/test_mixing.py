"""Targets against the rule applied step by step; the mix against its contract."""

import random

import pytest

from mnemoria.llm import mixing


def step_by_step(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, set(sizes)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def rows(seed, n=400):
    rng = random.Random(seed)
    return [(i, " ".join("w" * rng.randint(1, 4) for _ in range(rng.choice([0, 1, 5, 40, 300]))) if rng.random() < 0.95 else None, rng.choice(["b", "a", "c", "é", None, "a", "a", "a", "B", "z"][: seed + 3])) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_targets_and_shares(spark, seed):
    data = rows(seed)
    docs = spark.createDataFrame([(*r, "x", "y") for r in data], "doc_id long, text string, source string, size string, key string")
    q = spark.createDataFrame([(i, float(i % 3)) for i in range(0, 400, 2)], "doc_id long, weight double")
    got = {r["doc_id"]: r for r in mixing.mix(docs, q).collect()}
    again = {r["doc_id"]: r for r in mixing.mix(docs.repartition(7), q).collect()}
    assert got == again and len(got) == len(data)
    n = {i: len((t or "").split()) for i, t, _ in data}
    sizes = {}
    for i, _, s in data:
        sizes[s] = sizes.get(s, 0) + n[i]
    want = step_by_step(sizes)
    for s in sizes:
        mine = [got[i] for i, _, x in data if x == s]
        assert {r["source_size"] for r in mine} == {sizes[s]}
        assert mine[0]["target"] == pytest.approx(want[s])
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(n.values())
        epochs = int(want[s] // sizes[s]) if sizes[s] else 0
        assert all(r["times"] in (epochs, epochs + 1) and r["taken"] == r["times"] * r["size"] for r in mine)
        assert all(r["taken"] <= 2 * r["size"] for r in mine)


def test_heavier_documents_are_taken_more_often(spark):
    docs = spark.createDataFrame([(i, "a b c d", "s" if i % 2 else "t") for i in range(4000)], "doc_id long, text string, source string")
    q = spark.createDataFrame([(i, 4.0 if i % 3 == 0 else 1.0) for i in range(4000)], "doc_id long, weight double")
    got = mixing.mix(docs, q, weights=(1, 1), share=0.3).collect()
    heavy = [r["times"] for r in got if r["doc_id"] % 3 == 0]
    light = [r["times"] for r in got if r["doc_id"] % 3]
    assert sum(heavy) / len(heavy) > 2 * sum(light) / len(light)


def test_empty_and_repeated(spark):
    docs = spark.createDataFrame([(1, "a b", None), (1, "a b", None), (2, None, "x")], "doc_id long, text string, source string")
    got = sorted((r["doc_id"], r["size"], r["taken"]) for r in mixing.mix(docs).collect())
    assert [g[:2] for g in got] == [(1, 2), (1, 2), (2, 0)] and sum(g[2] for g in got) == 6
    assert mixing.mix(docs.limit(0)).count() == 0
