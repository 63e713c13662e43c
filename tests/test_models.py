"""Operators against short sequential models, on random and literal rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from mnemoria.functions import text as T
from mnemoria.operators import audits, context, enrich, hygiene, search, stats, sync, turns

MESSAGE = "message_id string, conversation_id string, role string, content string, timestamp long, platform string, seq long"


def pair(messages):
    """Turns of one conversation by the pairing loop."""
    out, user = [], None
    for role, content in messages:
        if role == "user":
            if user is not None:
                out.append((user, None))
            user = content
        elif role == "assistant":
            out.append((user, content))
            user = None
    return out + ([(user, None)] if user is not None else [])


def conversation(rng, name, n):
    return [(f"{name}-{i}", name, rng.choice(["user", "user", "assistant", "Assistant", "system"]), f"text {rng.random()}", 1000 + rng.choice([0, i]), rng.choice(["cli", "claude", ""]), i) for i in range(n)]


def test_turns_and_chunks(spark):
    rng = random.Random(2)
    data = [r for c in range(25) for r in conversation(rng, f"c{c}", rng.randint(0, 40))]
    df = spark.createDataFrame(data, MESSAGE)
    got = turns.turns(df).collect()
    whole = turns.chunks(df, 5, 2).collect()
    for c in {r[1] for r in data}:
        mine = sorted((r for r in data if r[1] == c), key=lambda r: (r[4], r[6]))
        want = pair([(r[2].lower(), r[3]) for r in mine])
        assert [(r["user_content"], r["assistant_content"]) for r in sorted((r for r in got if r["conversation_id"] == c), key=lambda r: r["turn_idx"])] == want
        ranges = [f"{i + 1}-{min(i + 5, len(want))}" for i in range(0, len(want), 3)]
        chunks = sorted((r for r in whole if r["conversation_id"] == c), key=lambda r: r["chunk_idx"])
        assert [r["turn_range"] for r in chunks] == ranges
        for k, r in enumerate(chunks):
            lines = [x for u, a in want[k * 3 : k * 3 + 5] for x in ([f"User: {u}"] if u is not None else []) + ([f"Assistant: {a}"] if a is not None else [])]
            assert r["content"] == "\n\n".join(lines) and r["turn_count"] == len(want[k * 3 : k * 3 + 5])


def test_ten_turns_make_four_chunks(spark):
    rows = [(f"m{i}", "c", ["user", "assistant"][i % 2], f"python {i}", i, "claude", i) for i in range(20)]
    got = sorted(turns.chunks(spark.createDataFrame(rows, MESSAGE)).collect(), key=lambda r: r["chunk_idx"])
    assert [r["turn_range"] for r in got] == ["1-5", "4-8", "7-10", "10-10"]
    assert got[0]["topics"] == ["python"] and got[0]["speakers"] == ["user", "assistant"] and got[0]["platform"] == "claude"


def test_edge_conversations(spark):
    rows = [("a", None, "user", "x", 5, "", 0), ("b", "", "user", "y", None, None, 1), ("c", "s", "system", "z", 1, "cli", 2)]
    got = turns.chunks(spark.createDataFrame(rows, MESSAGE)).collect()
    assert [(r["conversation_id"], r["turn_range"], r["platform"]) for r in got] == [("unknown", "1-2", "chatgpt")]
    assert turns.chunks(spark.createDataFrame([], MESSAGE)).count() == 0
    assert tuple(turns.chunk_statistics(turns.chunks(spark.createDataFrame([], MESSAGE))).first()) == (0, 0.0, 0)


@pytest.mark.parametrize("seed", range(3))
def test_dedup_window(spark, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = [(i, rng.choice("ab"), start + timedelta(seconds=rng.choice([0, 1, 5, 5, 6, 30]) + rng.randint(0, 60))) for i in range(300)]
    want, last = [], {}
    for i, k, t in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if k not in last or (t - last[k]).total_seconds() > 5:
            last[k] = t
            want.append(i)
    df = spark.createDataFrame(rows, "id long, k string, ts timestamp")
    assert sorted(r["id"] for r in hygiene.first_of_window(df, ["k"], "ts", 5, "id").collect()) == sorted(want)


def test_token_batches(spark):
    assert enrich.greedy_batches([10, 20, 4000, 3990, 10, 1, 5000, 5], 4000) == [0, 0, 1, 2, 2, 3, 4, 5]
    rng = random.Random(1)
    for _ in range(200):
        n = [rng.choice([0, 5, 60, 99, 100, 101, 250]) for _ in range(30)]
        b = enrich.greedy_batches(n, 100)
        assert b == sorted(b) and set(b) == set(range(b[-1] + 1))
        for k in set(b):
            mine = [x for x, y in zip(n, b) if y == k]
            assert sum(mine) <= 100 or len(mine) == 1


def test_text_functions(spark):
    df = spark.createDataFrame([("  Use C++11 and éque Python api  ",)], "c string")
    r = df.select(T.trim(F.col("c")).alias("t"), T.topics(F.col("c")).alias("k"), T.estimate_tokens(F.col("c")).alias("n"), T.is_specific(F.col("c")).alias("s")).first()
    assert r["t"] == "Use C++11 and éque Python api" and r["k"] == ["c++", "python", "api"] and r["s"]
    q = '1. "How to fix it?"\n\n- plain one\n* \'quoted\'\n' + "x" * 200 + "\n5. last"
    assert spark.createDataFrame([(q,)], "c string").select(T.parse_questions(F.col("c"), 3)).first()[0] == ["How to fix it?", "plain one", "quoted"]
    assert spark.createDataFrame([(q,)], "c string").select(T.parse_questions(F.col("c"), 9)).first()[0][-1] == "last"


NOISE = [
    (".box { color: red }", ["CSS"]), ("const a = 1", ["JavaScript"]), ("log in", ["UI Element"]), ("ChatGPTChatGPT", ["Repeated Text"]), ("[Memory Context - 3 relevant items]", ["Memory Context Metadata"]),
    ("A plain sentence.", []), ("", []), (None, []), ("see window.top and Privacy Policy", ["JavaScript", "UI Element"]),
]


def test_noise(spark):
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(NOISE)], "i long, content string")
    got = {r["i"]: r["categories"] for r in hygiene.classify(df).collect()}
    assert [got[i] for i in range(len(NOISE))] == [w for _, w in NOISE]
    assert hygiene.without_noise(df).count() == 3
    report = {r["category"]: (r["n"], r["percent"]) for r in hygiene.noise_report(df).collect()}
    assert report["all"][0] == 9 and report["noise"] == (6, 66.7) and report["UI Element"][0] == 2


def test_reject_reasons(spark):
    long = "This is an ordinary sentence of a message, long enough to be captured, with nothing odd about it at all. "
    cases = [("short", "too_short"), (long + ".a { b: c; }", "css"), (long + "x => {", "code"), (long + "Search", "ui"), (long * 3 + "Terms", "ignored"), (long * 120, "too_long"), (long[:80], "not_substantial"), (long * 2, None), (None, "too_short")]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i long, content string")
    got = {r["i"]: r["reject_reason"] for r in hygiene.capture_filter(df).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]


def test_roles(spark):
    df = spark.createDataFrame([("x", "User turn", None), ("x", "ChatGPT", None), ("x", None, "bot"), ("You said: 🤖", None, ""), ("ChatGPT said: x", None, None), ("x", None, None)], "t string, a string, d string")
    assert [r[0] for r in df.select(T.infer_role(F.col("t"), F.col("a"), F.col("d"))).collect()] == ["user", "assistant", "assistant", "user", "assistant", "user"]


def test_search_edges(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, 0.1]), ("e", [-1.0, 0.0])]
    df = spark.createDataFrame(rows, "message_id string, embedding array<double>")
    assert [r["message_id"] for r in search.nearest(df, df.filter("message_id = 'a'"), 5, 2.5).collect()] == ["a", "d", "e"]
    assert search.nearest(df, df.filter("message_id = 'b'"), 5, 2.5).count() == 0
    assert [r["message_id"] for r in search.find_similar(df, "a", 5, 0.5).collect()] == ["d"]
    ids = spark.createDataFrame([(i, v) for i, (_, v) in enumerate(rows)], "vec_id long, embedding array<double>")
    got = search.nearest_batch(ids, ids, 2, block=2).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got if r["query_id"] == 0) == [(0, 1, 3), (0, 2, 4)]
    assert search.nearest_batch(ids, ids.limit(0)).count() == 0


def test_context(spark):
    hits = [(1, 1, "first", "cli", 0, 0.1), (1, 2, "second", "chatgpt", 86_400_000, 0.25), (2, 1, "only", None, 0, 0.3), (3, 1, "near", "cli", 0, 0.01)]
    df = spark.createDataFrame(hits, "query_id long, rank int, content string, source string, timestamp long, distance double")
    got = {r["query_id"]: r["block"] for r in context.context_blocks(df, 0.05, debug=True).collect()}
    assert set(got) == {1, 2}
    assert got[1] == (
        '[Memory Context - 2 relevant items]\n\n1. 📝 Terminal (1/1/1970)\n   "first"\n   [Distance: 0.100, Source: cli]\n\n'
        '2. 💬 Previous conversation (1/2/1970)\n   "second"\n   [Distance: 0.250, Source: chatgpt]\n\n[End of Memory Context]\n\n'
    )
    assert context.context_blocks(df, 0.05).filter("query_id = 2").first()["block"].startswith("[Memory Context - 1 relevant item]\n\n1. 💬")


def test_injection_leaves_other_bodies(spark):
    bodies = [None, "", "no json", '{"messages":[]}', '{"prompt":"p"}']
    df = spark.createDataFrame([(b,) for b in bodies], "b string")
    for mode in ("prepend", "system"):
        assert [r[0] for r in df.select(context.inject(F.col("b"), F.lit("C"), mode)).collect()] == bodies
    assert df.select(context.inject(F.col("b"), F.lit("C"), "prompt")).collect()[4][0] == '{"prompt":"C\\n\\n---\\n\\np"}'
    some = spark.createDataFrame([('{"messages":[{"content":"x"}]}',)], "b string")
    assert some.select(context.inject(F.col("b"), F.lit(None).cast("string"))).first()[0] == '{"messages":[{"content":"x"}]}'


def test_upserts_and_sync(spark):
    target = spark.createDataFrame([("a", 1, "old"), ("b", 5, "old")], "k string, v long, x string")
    new = spark.createDataFrame([("a", 2, "new"), ("b", 5, "new"), ("c", 1, "new"), ("c", 3, "newer")], "k string, v long, x string")
    assert sorted(map(tuple, sync.upsert(target, new, "k", "v").collect())) == [("a", 2, "new"), ("b", 5, "new"), ("c", 3, "newer")]
    assert sorted(map(tuple, sync.upsert(target, new, "k", "v", last_wins=False).collect())) == [("a", 1, "old"), ("b", 5, "old"), ("c", 1, "new")]
    rows = [(f"{c}-{i}", c, ["user", "assistant"][i % 2], f"hello {i}", i + 1, "cli", i) for c in "pq" for i in range(6)]
    captured = spark.createDataFrame(rows, MESSAGE)
    stored = captured.filter("conversation_id = 'p' or seq < 4")
    messages, chunks = sync.synchronise(captured, stored, enrich.hashed_embedding, "u")
    assert sorted(r["message_id"] for r in messages.collect()) == ["q-4", "q-5"]
    got = chunks.collect()
    assert [(r["conversation_id"], r["turn_range"], r["user_id"]) for r in got] == [("q", "1-3", "u")] and abs(sum(x * x for x in got[0]["embedding"]) - 1) < 1e-5


def test_model_stages(spark):
    q = spark.createDataFrame([("python api error", ["x"], ""), ("that thing", ["rls"], None), ("boom", [], None)], "query string, topics array<string>, context string")

    def model(p):
        if '"boom"' in p:
            raise RuntimeError
        return " better terms " if "Lately discussed: rls" in p else ""

    got = {r["query"]: (r["rewritten"], r["transformed"], r["success"]) for r in enrich.rewrite_queries(q, model).collect()}
    assert got == {"python api error": ("python api error", False, True), "that thing": ("better terms", True, True), "boom": ("boom", False, False)}
    chunks = spark.createDataFrame([("c1", ["sync"]), ("c2", [])], "content string, topics array<string>")
    asked = enrich.generate_questions(chunks, lambda p: "1. How does sync work here?\n2. Why is sync slow today?" if "Topics: sync" in p else 1 / 0, 3)
    assert tuple(enrich.question_totals(asked).first()) == (2, 2, 1)
    assert {r["content"]: r["passed"] for r in audits.question_quality(asked).collect()} == {"c1": True, "c2": False}
    texts = spark.createDataFrame([(i, "w " * n) for i, n in enumerate([1, 5, 9000, 3])], "i long, content string")
    sizes = enrich.embed(texts.coalesce(1), lambda batch: [[float(len(t)), float(len(batch))] for t in batch], most=1000).orderBy("i").collect()
    assert [r["embedding"] for r in sizes] == [[2.0, 2.0], [10.0, 2.0], [4000.0, 1.0], [6.0, 1.0]]


def test_statistics_and_audits(spark):
    m = spark.createDataFrame([("a", "c", "user", "hello there", 5, "", 0), ("a", "unknown", "bot", " ", 0, None, 1)], MESSAGE)
    got = {r["rule"]: r["failed"] for r in audits.check(m, audits.message_rules()).collect()}
    assert got == {"content_present": 0, "timestamp_present": 1, "role_present": 0, "role_allowed": 1, "content_not_blank": 1}
    assert tuple(audits.known_conversations(m).first()) == (0.5, False)
    assert [tuple(r) for r in audits.duplicates(m, "message_id").collect()] == [("a", 2)]
    assert {tuple(r) for r in stats.counts(m, "platform", "unknown").collect()} == {("unknown", 2)}
    empty = stats.store_size(m.limit(0)).first()
    assert (empty["rows"], empty["size"]) == (0, 2)
    from mnemoria.sources.schemas import MESSAGES, struct

    bad = [r["column"] for r in audits.contract(m, struct(MESSAGES)).collect() if not r["ok"]]
    assert "embedding" in bad and "content" not in bad
    assert m.select(audits.rewrite_quality(F.lit("supabase rls policy"), F.array(F.lit("RLS")))).first()[0]


def test_injection_keeps_other_members(spark):
    import json

    one = {"action": "next", "parent_message_id": "p", "timezone": -60, "flag": True, "none": None, "messages": [{"id": "a", "content": "{first}"}, {"id": "b", "create_time": 1.5, "metadata": {"x": [1, "2"]}, "author": {"role": "user"}, "content": {"content_type": "text", "lang": "é", "parts": ['{"a": 1} why']}}]}
    two = {"model": "m", "messages": [{"id": 7, "role": "user", "content": "{hello}"}]}
    three = {"temperature": 0.5, "attachments": [{"n": "f"}], "prompt": 'say "x"'}
    four = {"messages": [{"content": {"parts": []}}, {"content": {"other": 1}}]}
    df = spark.createDataFrame([(i, json.dumps(b)) for i, b in enumerate((one, two, three, four))], "i int, b string").orderBy("i")
    got = {mode: [json.loads(r[0]) for r in df.select(context.inject(F.col("b"), F.lit("C "), mode)).collect()] for mode in ("prepend", "system", "prompt")}
    want = json.loads(json.dumps([one, two, three, four]))
    want[0]["messages"][1]["content"]["parts"] = ['C {"a": 1} why']
    want[1]["messages"][0]["content"] = "C {hello}"
    assert got["prepend"] == want
    extra = {"author": {"role": "system"}, "content": {"content_type": "text", "parts": ["C "]}}
    want = json.loads(json.dumps([one, two, three, four]))
    for k in (0, 1, 3):
        want[k]["messages"].insert(-1, extra)
    assert got["system"] == want
    assert got["prompt"] == [one, two, three | {"prompt": 'C \n\n---\n\nsay "x"'}, four]


def test_batch_search_of_odd_queries(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [1.0, 0.0, 0.0]), (4, [1.0, 0.0, 0.1]), (5, [float("nan"), 1.0]), (6, None), (7, [None, 1.0])], "vec_id long, embedding array<double>")
    got = search.nearest_batch(df, df, k=3, exclude_self=True).select("query_id", "vec_id").collect()
    assert sorted(map(tuple, got)) == [(1, 2), (2, 1), (3, 4), (4, 3)]
