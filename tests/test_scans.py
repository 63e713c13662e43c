"""Scans and chains over hot keys against plain folds."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemoria.operators import audits, chains, enrich, hygiene, turns

MESSAGE = "message_id string, conversation_id string, role string, content string, timestamp long, platform string, seq long"


@pytest.fixture(autouse=True)
def several_partitions(spark):
    """Small data would be one partition, which chains and scans have to pass."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def fold_turns(rows):
    out, by = [], {}
    for i, c, r, _, t, _, s in rows:
        if (r or "").lower() in ("user", "assistant"):
            by.setdefault(c or "unknown", []).append((t or 0, s, r.lower(), i))
    for c, m in by.items():
        turn, before = -1, None
        for _, _, r, i in sorted(m):
            turn += r == "user" or before != "user"
            before = r
            out.append((i, c, turn))
    return sorted(out)


def messages(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = rng.choice([None, None, "", "unknown", "a", "b", f"c{i % 30}"])
        t = rng.choice([0, None, i * 400_000, i * 1000, -i * 700_000])
        rows.append((f"m{i}", c, rng.choice(["user", "User", "assistant", "assistant", "system", None]), "x", t, "cli", i * 11))
    return rows


def test_turns_of_a_hot_conversation(spark):
    rows = messages(3000)
    df = spark.createDataFrame(rows, MESSAGE).repartition(5)
    got = turns.with_turns(df)
    assert sorted((r["message_id"], r["conversation_id"], r["turn_idx"]) for r in got.collect()) == fold_turns(rows)
    sizes = got.filter("conversation_id = 'unknown'").withColumn("b", turns.bucket()).groupBy("b").count().collect()
    assert len(sizes) > 20 and max(r["count"] for r in sizes) < 600  # no bucket has the whole conversation


def test_latest_of_a_conversation_are_cut_before_the_shuffle(spark):
    df = spark.createDataFrame(messages(50), MESSAGE)
    plan = turns.recent_topics(df)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize("rows", [3, 4096])
def test_out_of_order(spark, rows):
    rng = random.Random(3)
    m = [(f"m{i}", rng.choice([None, "a", "b"]), "user", "x", rng.choice([None, i, i + 5, i - 5]), "cli", i * 2) for i in range(400)]
    want, last = [], {}
    for i, c, _, _, t, _, _ in m:
        if t is not None and last.get(c) is not None and t < last[c]:
            want.append((i, last[c]))
        last[c] = t
    got = audits.out_of_order(spark.createDataFrame(m, MESSAGE).repartition(3), rows)
    assert sorted((r["message_id"], r["previous"]) for r in got.collect()) == sorted(want)
    assert "previous" in got.columns and len(got.columns) == 8


@pytest.mark.parametrize("kind", ["mixed", "small", "large", "empty texts", "one", "none"])
def test_token_batches_equal_a_fold(spark, kind):
    rng = random.Random(4)
    size = {"mixed": lambda: rng.choice([0, 3, 40, 399, 400, 401, 2000]), "small": lambda: rng.randint(0, 8), "large": lambda: rng.randint(300, 900), "empty texts": lambda: 0, "one": lambda: 7, "none": lambda: 7}[kind]
    rows = [(i * 3, "é" * size()) for i in range({"one": 1, "none": 0}.get(kind, 1500))]
    want = enrich.greedy_batches([-(-len(t) // 4) for _, t in rows], 100)
    shuffled = rows[:]
    rng.shuffle(shuffled)
    got = enrich.token_batches(spark.createDataFrame(shuffled, "k long, content string").repartition(6), "k", most=100)
    assert got.columns == ["k", "tokens", "batch"]
    assert [(r["k"], r["batch"]) for r in got.orderBy("k").collect()] == [(k, b) for (k, _), b in zip(rows, want)]


def test_token_batches_pass_partitions(spark):
    assert enrich.token_batches(spark.range(2000).select(F.col("id").alias("k"), F.lit("abcd").alias("content")).repartition(4), "k", most=1500).groupBy("batch").count().orderBy("batch").collect() == [(0, 1500), (1, 500)]


def fold_window(rows, seconds):
    out, last = [], {}
    for i, k, t in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        if k not in last or (t - last[k]).total_seconds() > seconds:
            last[k] = t
            out.append(i)
    return sorted(out + [i for i, _, t in rows if t is None])


@pytest.mark.parametrize("keys,seconds,step", [(["a"], 5, 1), (["a"], 3600, 1), ([None, "a", "b"], 30, 7), ([f"k{i}" for i in range(300)], 50, 9), (["a"], 0, 1)])
def test_window_of_a_hot_key(spark, keys, seconds, step):
    rng = random.Random(len(keys))
    start = datetime(2024, 1, 1)
    rows = [(i, rng.choice(keys), start + timedelta(seconds=rng.randint(0, 2000 * step) / 2)) for i in range(2000)] + [(9000, "a", None), (9001, "a", None)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp").repartition(5)
    got = hygiene.first_of_window(df, ["k"], "ts", seconds, "id")
    assert got.columns == df.columns
    assert sorted(r["id"] for r in got.collect()) == fold_window(rows, seconds)
    ms = df.withColumn("ts", F.unix_millis("ts"))
    assert sorted(r["id"] for r in hygiene.first_of_window(ms, ["k"], "ts", seconds, "id").collect()) == fold_window(rows, seconds)
    assert hygiene.first_of_window(df.limit(0), ["k"], "ts", seconds, "id").collect() == []


def test_a_hot_key_is_split(spark):
    df = spark.range(4000).select("id", F.lit("a").alias("k"), (F.col("id") * 1000).alias("ts"))
    parts = chains.first_of_window(df, ["k"], "ts", 10, "id").select(F.spark_partition_id().alias("p")).distinct().count()
    assert parts > 1
