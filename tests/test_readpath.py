"""The composed read path, stored answers of models, substring index, archives, the full synchronisation."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from mnemoria.operators import enrich, readpath, search, stats, substrings, sync
from mnemoria.operators.keyed import KeyedTable
from mnemoria.sources import adapters

MESSAGE = "message_id string, conversation_id string, role string, content string, timestamp long, platform string, seq long"


def asked_file(tmp_path, fails=()):
    """A model that writes down what it is asked, on whatever machine."""
    path = str(tmp_path / "asked")

    def model(p):
        with open(path, "a") as f:
            f.write(json.dumps(p) + "\n")
        if any(x in p for x in fails):
            raise RuntimeError
        return "1. What is " + str(len(p)) + " about?"

    return model, lambda: [json.loads(x) for x in open(path)] if os.path.exists(path) else []


def test_a_model_is_asked_once(spark, tmp_path):
    model, asked = asked_file(tmp_path, ["bad"])
    memory = str(tmp_path / "memory")
    df = spark.createDataFrame([(i, f"text {i % 7}" if i % 10 else "bad") for i in range(60)] + [(99, None)], "i long, p string").repartition(4)
    got = enrich.call_remembering(df, "p", "a", model, memory).collect()
    assert len(got) == 61 and all((r["a"] is None) == (r["p"] in ("bad", None)) for r in got)
    assert sorted(asked()) == ["bad", *[f"text {k}" for k in range(7)]]
    more = df.unionByName(spark.createDataFrame([(100, "text 100")], df.schema))
    again = enrich.call_remembering(more, "p", "a", model, memory)
    assert again.columns == ["i", "p", "a"] and again.filter("a is not null").count() == 55
    assert sorted(asked()) == ["bad", "bad", *sorted(["text 100", *[f"text {k}" for k in range(7)]])]  # what failed is asked again


def test_a_stopped_call_goes_on(spark, tmp_path):
    """A call that breaks off keeps the slices that it has written."""
    model, asked = asked_file(tmp_path)
    memory = str(tmp_path / "memory")
    df = spark.createDataFrame([(f"text {k}",) for k in range(40)], "p string")
    first = df.filter(F.pmod(F.xxhash64(F.sha2("p", 256)), F.lit(8)) < 3)
    enrich.call_remembering(first, "p", "a", model, memory)
    n = len(asked())
    enrich.call_remembering(df, "p", "a", model, memory)
    assert 0 < n < 40 and len(asked()) == len(set(asked())) == 40


def test_questions_with_memory(spark, tmp_path):
    model, asked = asked_file(tmp_path)
    chunks = spark.createDataFrame([("c1", ["sync"]), ("c1", ["sync"]), ("c2", [])], "content string, topics array<string>")
    for _ in range(2):
        got = enrich.generate_questions(chunks, model, 3, str(tmp_path / "m")).collect()
        assert len(got) == 3 and all(len(r["hypothetical_questions"]) == 1 for r in got)
    assert len(asked()) == 2


def embed(df):
    return enrich.hashed_embedding(df, dim=32)


def store(spark):
    texts = ["rls policy in supabase", "a recipe for soup", "policy of supabase rls", "soup and bread", "vector index"]
    rows = [(i, f"m{i}", "user" if i % 2 else "assistant", t, "cli" if i == 2 else "chatgpt", 1_000_000 + i * 60_000) for i, t in enumerate(texts)]
    return embed(spark.createDataFrame(rows, "vec_id long, message_id string, role string, content string, source string, timestamp long"))


def test_prompts_are_rewritten_with_topics_and_searched(spark):
    history = spark.createDataFrame([("h1", "c", "user", "my rls policy fails in supabase", 1, "chatgpt", 0)], MESSAGE)
    prompts = spark.createDataFrame([(1, "that thing again", "c"), (2, "python api error", "c"), (3, "boom", "none")], "query_id long, query string, conversation_id string")

    def model(p):
        if '"boom"' in p:
            raise RuntimeError
        return "supabase rls policy" if "Lately discussed: rls" in p else "soup"

    asked = readpath.asked(prompts, embed, history, model)
    assert {r["query_id"]: (r["rewritten"], r["transformed"]) for r in asked.collect()} == {1: ("supabase rls policy", True), 2: ("python api error", False), 3: ("boom", False)}
    hits = readpath.search_messages(asked, store(spark), 5, 0.6).filter("query_id = 1").orderBy("rank").collect()
    assert [r["vec_id"] for r in hits] == [0, 2]
    only = readpath.search_messages(asked, store(spark), 5, 0.6, source="cli").filter("query_id = 1").collect()
    assert [(r["vec_id"], r["rank"]) for r in only] == [(2, 1)]


def test_bodies_get_their_blocks(spark):
    prompts = spark.createDataFrame([(1, "supabase rls policy", "c"), (2, "zzz qqq", "c"), (3, "", "c")], "query_id long, query string, conversation_id string")
    asked = readpath.asked(prompts, embed)
    bodies = prompts.select("query_id", F.to_json(F.struct(F.array(F.struct(F.col("query").alias("content"))).alias("messages"))).alias("body"))
    blocks = readpath.contexts(asked, store(spark), 1_000_000 + 240_000, threshold=0.6)
    got = {r["query_id"]: (r["items"], r["new_body"], r["body"]) for r in readpath.with_context(bodies, blocks).collect()}
    assert got[1][0] == 1 and "rls policy in supabase" in got[1][1] and "policy of supabase rls" not in got[1][1]  # of the last 120 s
    assert got[2] == (0, got[2][2], got[2][2]) and got[3] == (0, got[3][2], got[3][2])


def test_index_of_substrings_equals_the_scan(spark, tmp_path):
    rows = [(f"m{i}", f"Hello {'ÄÖ' if i % 3 else 'xyz'} number {i} 100%_done\\") for i in range(300)] + [("n", None), ("e", ""), ("s", "ab"), ("m0", "again hello")]
    df = spark.createDataFrame(rows, "message_id string, content string").repartition(3)
    path = str(tmp_path / "index")
    substrings.write_index(df, path)
    for q in ("hello", "äö", "ÄÖ N", "number 7", "%_d", "done\\", "ab", "nowhere", "1", "number 29", "HELLO XYZ NUMBER 3"):
        got = sorted(map(tuple, substrings.search(df, path, q).collect()))
        assert got == sorted(map(tuple, df.filter(substrings.ilike(F.col("content"), q)).collect())), q
    plan = substrings.candidates(spark, path, "number 29")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "In(piece" in plan
    assert substrings.candidates(spark, path, "number 29").count() < 30
    q = spark.createDataFrame([(1, "Number 29"), (2, "xy"), (3, "nowhere"), (4, "äö number 1 ")], "query_id int, q string")
    want = {(1, m) for m, c in rows if c and "number 29" in c.lower()} | {(4, m) for m, c in rows if c and "äö number 1 " in c.lower()}
    assert {tuple(r) for r in substrings.matches(df, q).collect()} == want


@pytest.mark.parametrize("sent", [substrings.SENT, 0])
def test_many_queries_equal_the_scan(spark, sent):
    """A row for each row of query and message, of any lengths, repeated and null keys, wherever a text holds the query."""
    words = ["the", "and", "Über", "naïve", "😀x", "a", "B c", "ing "]
    some = random.Random(3)
    rows = [(f"m{i}", " ".join(some.choices(words, k=some.randrange(60)))) for i in range(400)]
    far = "".join(some.choices("ab😀é", k=300_000))
    rows += [("far", far), ("m7", rows[7][1]), ("m7", rows[8][1]), (None, rows[9][1]), ("none", None), ("empty", ""), ("cut", "th"), ("on", "e and the")]
    texts = [c for _, c in rows if c and c != far]
    asked = [(i, (c := some.choice(texts))[(a := some.randrange(len(c))) : a + some.choice([3, 4, 5, 9, 15, 16, 17, 31, 32, 40, 64, 65, 120])]) for i in range(150)]
    asked += [(200, far[131_066:131_075]), (201, far[131_060:131_140].upper()), (202, far[-9:]), (203, "b" + far[-70:]), (204, far[:200])]
    asked += [(205, None), (206, ""), (207, "ab"), (208, "nowhere at all"), (209, "the and the"), (209, "the and the"), (209, "THE AND"), (None, "ing the a")]
    df = spark.createDataFrame(rows, "message_id string, content string").repartition(3)
    got = substrings.matches(df, spark.createDataFrame(asked, "query_id int, q string"), sent=sent).collect()
    want = [(i, m) for i, q in asked if q and len(q) >= 3 for m, c in rows if c and q.lower() in c.lower()]
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)
    assert substrings.matches(df, spark.createDataFrame([(1, "ab"), (2, None)], "query_id int, q string"), sent=sent).collect() == []


def test_many_queries_find_parts_that_end_in_a_sigma(spark):
    rows = [("a", "ΟΔΟΣ ΑΘΗΝΑΣ"), ("b", "οδοσ"), ("c", "ΟΔΟΣΑ"), ("d", "οδος")]
    df = spark.createDataFrame(rows, "message_id string, content string")
    q = spark.createDataFrame([(1, "ΟΔΟΣ"), (2, "δοσα"), (3, "ΟΔΟΣ ΑΘΗΝΑΣ"), (4, "Σ Α")], "query_id int, q string")
    got = sorted(map(tuple, substrings.matches(df, q).collect()))
    assert got == [(1, "a"), (1, "b"), (1, "c"), (2, "c"), (3, "a"), (4, "a")]


def test_many_queries_move_matches_only(spark):
    """Texts whose three-character pieces are all alike: what leaves a task are matches, and texts are not shuffled."""
    some = random.Random(4)
    rows = [(i, "".join(some.choices("ab", k=200))) for i in range(500)]
    df = spark.createDataFrame(rows, "message_id long, content string").repartition(3)
    asked = [(i, "".join(some.choices("ab", k=15))) for i in range(300)]
    q = spark.createDataFrame(asked, "query_id int, q string")
    got = substrings.matches(df, q)
    want = sorted((i, m) for i, x in asked for m, c in rows if x in c)
    assert sorted(map(tuple, got.collect())) == want
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    once = {(x, m) for i, x in asked for m, c in rows if x in c}
    left = substrings.hits(df, q.select(F.col("q").alias("anchor")), [15], len(asked), "message_id", "content")
    assert len(once) <= left.agg(F.sum(F.size("keys"))).first()[0] < 1.1 * len(once) + 100


def test_newest_pairs_equal_all_pairs(spark):
    rows = [(f"m{i:03}", f"c{i % 4}", ["user", "assistant"][i // 2 % 2], "x", 1000 - i // 9, ["chatgpt", "claude", None, "cli"][i % 11 % 4], i) for i in range(200)]
    df = spark.createDataFrame(rows, MESSAGE)
    for limit in (1, 5, 60, 100_000):
        pairs = [(-u[4], u[0], a[0]) for u in rows for a in rows if u[2] == "user" and a[2] == "assistant" and u[1] == a[1] and u[5] and a[5] and u[5] != a[5]]
        got = search.cross_platform_pairs(df, limit).collect()
        assert [(r["user_id"], r["assistant_id"]) for r in got] == [(u, a) for _, u, a in sorted(pairs)[:limit]]


def test_archive_round_trip(spark, tmp_path):
    rows = [(f"m{i}", f'te"xt\n{i} é', i) for i in range(50)]
    df = spark.createDataFrame(rows, "message_id string, content string, timestamp long").repartition(3)
    adapters.archive(df, str(tmp_path / "a"))
    files = [p for p in (tmp_path / "a").iterdir() if p.name.startswith("part-")]
    assert sum(len(json.loads(p.read_text())) for p in files) == 50 and len(files) == 3
    assert sorted(map(tuple, adapters.read_store(spark, str(tmp_path / "a"), "message_id string, content string, timestamp long").collect())) == sorted(rows)
    adapters.archive(df.limit(0), str(tmp_path / "b"))
    assert adapters.read_store(spark, str(tmp_path / "b"), "message_id string").count() == 0


def test_full_step_into_tables(spark, tmp_path):
    rows = [(f"{c}-{i}", c, ["user", "assistant"][i % 2], f"hello {i}", i + 1, "cli", i) for c in "pq" for i in range(6)]
    captured = spark.createDataFrame(rows, MESSAGE)
    m, c = KeyedTable(spark, str(tmp_path / "m"), "message_id", "timestamp", 8), KeyedTable(spark, str(tmp_path / "c"), "id", "end_timestamp", 8)
    sync.synchronise_tables(captured.filter("seq < 4"), m, c, embed, "u")
    assert m.read().count() == 8 and {r["turn_range"] for r in c.read().collect()} == {"1-2"}
    sync.synchronise_tables(captured, m, c, embed, "u")
    assert m.read().count() == 12 and {r["turn_range"] for r in c.read().collect()} == {"1-2", "1-3"}
    before = sorted(map(str, c.read().collect()))
    assert sync.synchronise_tables(captured, m, c, embed, "u") == (0, 0) and sorted(map(str, c.read().collect())) == before
    lost = KeyedTable(spark, str(tmp_path / "c2"), "id", "end_timestamp", 8)  # as if it had stopped between the tables
    sync.synchronise_tables(captured, m, lost, embed, "u")
    assert {r["conversation_id"] for r in lost.read().collect()} == {"p", "q"}


def test_counters(spark):
    df = spark.createDataFrame([(2, None), (0, None), (None, None), (3, "late"), (1, None)], "items int, error string")
    assert tuple(stats.injection_counters(df).first()) == (5, 2, 2, 1, 3, 40.0)
    assert tuple(stats.injection_counters(df.limit(0)).first()) == (0, 0, 0, 0, 0, None)
    captured = spark.createDataFrame([("a", 5)], "content string, captured_at long")
    assert tuple(stats.store_statistics(captured.limit(0), df, 9).select("rows", "errors", "last_save", "ms_since_save").first()) == (0, 5, None, None)
    assert tuple(stats.sync_status(captured, "captured_at").first()) == (1, 5)
