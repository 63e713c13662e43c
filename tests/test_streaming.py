"""Streaming jobs under availableNow against their batch forms."""

import json
import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemoria.operators import hygiene, stats
from mnemoria.operators.keyed import KeyedTable
from mnemoria.sources import capture
from mnemoria.streaming import jobs

START = datetime(2024, 1, 1)


def stream_of(spark, tmp_path, df, files=1):
    path = str(tmp_path / "in")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def drain(spark, df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_dedup_equals_batch(spark, tmp_path):
    rows = [(i, "ab"[i % 2], START + timedelta(seconds=(i * 7) % 90)) for i in range(80)]
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    got = drain(spark, jobs.dedup(stream_of(spark, tmp_path, df), ["k"], "ts", 5), tmp_path, "dedup_out")
    want = hygiene.first_of_window(df, ["k"], "ts", 5, "id")
    assert sorted((r["k"], r["ts"]) for r in got.collect()) == sorted((r["k"], r["ts"]) for r in want.collect())


def test_responses_equal_batch(spark, tmp_path):
    lines = [(r, i, f"data: {json.dumps({'delta': f'{r}{i} '})}", START) for r in "xy" for i in range(5)] + [(r, 9, "data: [DONE]", START) for r in "xy"]
    df = spark.createDataFrame(lines, "response_id string, seq long, line string, ts timestamp")
    got = drain(spark, jobs.responses(stream_of(spark, tmp_path, df)), tmp_path, "sse_out")
    want = capture.assemble_responses(df)
    assert sorted(map(tuple, got.select("response_id", "content").collect())) == sorted(map(tuple, want.select("response_id", "content").collect()))


def test_health_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(START + timedelta(seconds=37 * i), "error" if i % 5 == 0 else "view") for i in range(100)], "ts timestamp, event_type string")
    got = drain(spark, jobs.health(stream_of(spark, tmp_path, df)), tmp_path, "health_out", "complete")
    want = stats.health_windows(df).select("start", "n", "errors")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_silence_alerts(spark, tmp_path):
    rows = [("a", START), ("a", START + timedelta(minutes=3)), ("b", START + timedelta(hours=2)), ("c", START + timedelta(hours=3))]
    path = tmp_path / "in"
    stream = None
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "k string, ts timestamp").coalesce(1).write.mode("append").parquet(str(path))
    stream = spark.readStream.schema("k string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(path))
    got = drain(spark, jobs.silence_alerts(stream, "k"), tmp_path, "silence_out")
    assert ("a", START + timedelta(minutes=3)) in {(r["k"], r["since"]) for r in got.collect()}


def test_sync_is_idempotent(spark, tmp_path):
    schema = "message_id string, content string, timestamp long"
    source, target = str(tmp_path / "src"), str(tmp_path / "dst")
    spark.createDataFrame([("a", "one", 1), ("b", "two", 1), ("a", " late ", 2), ("c", "  ", 1)], schema).write.parquet(source)
    stream = lambda: jobs.keep_valid(jobs.captured(spark, source, schema))
    jobs.sync_to(stream(), target, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, jobs.current(spark, target).select("message_id", "content").collect())) == [("a", "late"), ("b", "two")]
    spark.createDataFrame([("b", "newer", 3)], schema).write.mode("append").parquet(source)
    jobs.sync_to(stream(), target, str(tmp_path / "cp")).awaitTermination()
    jobs.sync_to(stream(), target, str(tmp_path / "cp")).awaitTermination()
    assert sorted(map(tuple, jobs.current(spark, target).select("message_id", "content").collect())) == [("a", "late"), ("b", "newer")]


def files_of(path):
    return {os.path.join(d, n): os.path.getmtime(os.path.join(d, n)) for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


def test_keyed_table_rewrites_touched_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", "v", buckets=16)
    rows = lambda *x: spark.createDataFrame(list(x), "k string, v long, x string")
    assert table.read() is None and table.delete(rows(("a", 1, "x"))) == []
    assert len(table.upsert(rows(*[(f"k{i}", 1, "old") for i in range(200)]), "w", 0)) == 16
    before = files_of(tmp_path)
    touched = table.upsert(rows(("k3", 2, "new"), ("k3", 1, "older"), ("z", 1, "new"), (None, 1, "no key")), "w", 1)
    after = files_of(tmp_path)
    assert 1 <= len(touched) <= 2 and len(set(after) - set(before)) == len(touched)
    got = {r["k"]: r["x"] for r in table.read().collect()}
    assert len(got) == 201 and got["k3"] == got["z"] == "new" and got["k4"] == "old"
    assert table.upsert(rows(("k3", 9, "replayed")), "w", 1) == [] and files_of(tmp_path) == after  # the same change again
    table.upsert(rows(("k3", 2, "first stays")), "v", 0, last_wins=False)
    assert {r["k"]: r["x"] for r in table.read().collect()}["k3"] == "new"
    table.delete(rows(*[(f"k{i}", 0, "") for i in range(200)]), "w", 2)
    assert [tuple(r) for r in table.read().collect()] == [("z", 1, "new")]
    for n in range(3, 8):
        table.upsert(rows(("z", n, f"x{n}")), "w", n)
    assert len(files_of(tmp_path)) <= 4 and [r["x"] for r in table.read().collect()] == ["x7"]


def test_unfinished_change_is_not_seen(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), "k", "v", buckets=4)
    df = spark.createDataFrame([("a", 1)], "k string, v long")
    table.upsert(df, "w", 0)
    with pytest.raises(Exception):
        table.change(df, "w", 1, lambda before, rows: before.select("k", (F.assert_true(F.lit(False)).cast("long")).alias("v")))
    assert [tuple(r) for r in table.read().collect()] == [("a", 1)]
    table.upsert(df.withColumn("v", F.lit(5).cast("long")), "w", 1)
    assert [tuple(r) for r in table.read().collect()] == [("a", 5)]


def test_valid_and_failed_are_all_that_arrived(spark, tmp_path):
    schema = "message_id string, content string, timestamp long"
    source, target, errors = (str(tmp_path / n) for n in ("src", "dst", "err"))
    spark.createDataFrame([("a", " one ", 1), ("b", "  ", 2), ("c", None, 3)], schema).write.parquet(source)
    start = lambda cp: jobs.save_captures(jobs.captured(spark, source, schema), target, errors, str(tmp_path / cp)).awaitTermination()
    start("cp")
    spark.createDataFrame([("d", "two", 4), ("e", "", 5)], schema).write.mode("append").parquet(source)
    start("cp")
    for name in ("1", ".1.crc"):  # as if it had stopped before the second batch was confirmed
        (tmp_path / "cp" / "commits" / name).unlink()
    start("cp")
    good, bad = jobs.current(spark, target).collect(), spark.read.parquet(errors).collect()
    assert sorted(r["content"] for r in good) == ["one", "two"] and all(r["captured_at"] > 0 for r in good)
    assert sorted(r["timestamp"] for r in bad) == [2, 3, 5] and {r["type"] for r in bad} == {"SAVE_ERROR"}


def test_search_leaves_out_the_latest(spark, tmp_path):
    now, target = 10_000_000, str(tmp_path / "store")
    store = [(str(i), i, [1.0, i / 100], now - age * 1000) for i, age in enumerate((0, 60, 119, 120, 121, 5000))]
    KeyedTable(spark, target, "message_id", "timestamp").upsert(spark.createDataFrame(store, "message_id string, vec_id long, embedding array<double>, timestamp long"))
    prompts = stream_of(spark, tmp_path, spark.createDataFrame([(77, [1.0, 0.0])], "vec_id long, embedding array<double>"))
    jobs.search_stream(prompts, target, str(tmp_path / "out"), str(tmp_path / "cp"), as_of=lambda: now).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["query_id"], r["vec_id"], r["as_of"]) for r in got) == [(77, 4, now), (77, 5, now)]


def test_late_rows_equal_the_batch_form(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice("ab"), START + timedelta(seconds=rng.randint(0, 400) / 2)) for i in range(300)]
    path = str(tmp_path / "in")
    schema = "id long, k string, ts timestamp"
    for n in range(6):  # files in no order of time
        spark.createDataFrame(rows[n * 50 : n * 50 + 50], schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([(999, "end", START + timedelta(days=1))], schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = drain(spark, jobs.dedup_in_order(stream, ["k"], "ts", 7, tie="id"), tmp_path, "ordered_out").filter("k <> 'end'")
    want = hygiene.first_of_window(spark.createDataFrame(rows, schema), ["k"], "ts", 7, "id")
    assert sorted(r["id"] for r in got.collect()) == sorted(r["id"] for r in want.collect())


def chunked(seed):
    """Answers as bytes cut anywhere, and their texts."""
    rng = random.Random(seed)
    chunks, texts = [], {}
    for r in range(6):
        words = [rng.choice(["é☃", "plain ", "日本", "a\nb ", "\"q\" "]) for _ in range(rng.randint(1, 30))]
        ends = rng.choice(["\n", "\r\n", "\n\n"])
        data = "".join(f"data: {json.dumps({'delta': w}, ensure_ascii=False)}{ends}" for w in words).encode() + b"data: [DONE]" + rng.choice([b"", b"\n"])
        cuts = sorted({0, len(data), *(rng.randrange(len(data)) for _ in range(rng.randint(0, 60)))})
        chunks += [(f"r{r}", k, data[a:b], START) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        texts[f"r{r}"] = "".join(words).strip()
    rng.shuffle(chunks)
    return chunks, {k: v for k, v in texts.items() if v}


@pytest.mark.parametrize("seed", range(3))
def test_lines_of_network_chunks(spark, tmp_path, seed):
    chunks, texts = chunked(seed)
    df = spark.createDataFrame(chunks, "response_id string, seq long, data binary, ts timestamp").repartition(4)
    got = capture.assemble_responses(capture.lines_of_chunks(df))
    assert {r["response_id"]: r["content"] for r in got.collect()} == texts
    path = str(tmp_path / "in")
    for n in range(3):
        spark.createDataFrame(chunks[n::3], df.schema).coalesce(1).write.mode("append").parquet(path)
    spark.createDataFrame([("end", 0, b"", START + timedelta(days=1))], df.schema).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
    lines = drain(spark, jobs.lines_of_chunks(stream), tmp_path, f"lines_{seed}")
    assert {r["response_id"]: r["content"] for r in capture.assemble_responses(lines).collect()} == texts


def test_usage_alerts(spark):
    df = spark.createDataFrame([(START, 79), (START, 81), (START, None)], "ts timestamp, bytes long")
    assert [r["percent"] for r in jobs.usage_alerts(df, 100).collect()] == [81.0]
