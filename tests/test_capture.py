"""Request bodies and streamed answers in all their shapes."""

import json

from mnemoria.sources import capture as C

RAW = "url string, method string, body string"
CHAT = "https://chatgpt.com/backend-api/conversation"


def bodies(spark, rows):
    return spark.createDataFrame([(CHAT, "POST", b if b is None or isinstance(b, str) else json.dumps(b)) for b in rows], RAW)


def test_chatgpt_bodies(spark):
    rows = [
        {"messages": [{"content": "old"}, {"author": {"role": "assistant"}, "content": {"parts": ["  new \n", "x"]}}], "conversation_id": "c", "model": "m"},
        {"messages": [{"role": "system", "content": "text"}]}, {"messages": [{"content": {"parts": []}}]}, {"messages": []}, {"messages": [{"content": "   "}]}, "{broken", None, {"other": 1},
        {"messages": [{"content": {"text": "no parts"}}]},
    ]
    got = [(r["content"], r["role"], r["conversation_id"], r["model"]) for r in C.chatgpt_messages(bodies(spark, rows)).collect()]
    assert got == [("new", "assistant", "c", "m"), ("text", "system", "unknown", "unknown")]


def test_claude_bodies(spark):
    url = "https://claude.ai/api/organizations/o/chat_conversations/abc/completion"
    df = spark.createDataFrame([(url, "POST", '{"prompt":" hi "}'), ("https://claude.ai/api/x", "POST", '{"prompt":"p","uuid":"u","model":"k"}'), (url, "POST", '{"prompt":""}'), (url, "POST", '{"prompt":"  "}')], RAW)
    assert [(r["content"], r["conversation_id"], r["model"]) for r in C.claude_messages(df).collect()] == [("hi", "abc", "claude-3-opus"), ("p", "u", "k")]
    shipped = [(r["content"], r["conversation_id"], r["model"]) for r in C.claude_messages(df, shipped=True).collect()]
    assert shipped == [(" hi ", "abc", "claude-unknown"), ("p", None, "k"), ("  ", "abc", "claude-unknown")]


def test_calls_and_platforms(spark):
    df = spark.createDataFrame([(CHAT, "post", None), (CHAT, "GET", None), (CHAT, None, "x"), ("https://claude.ai/api/o/chat_conversations/a/completion", "POST", None), ("https://e.org", "POST", "x")], RAW)
    assert C.chatgpt_calls(df).count() == 2 and C.claude_calls(df).count() == 1
    from pyspark.sql import functions as F

    assert [r[0] for r in df.select(C.platform_of(F.col("url"))).collect()] == ["chatgpt"] * 3 + ["claude", None]


SHAPES = [
    {"choices": [{"delta": {"content": "a"}}]}, {"message": {"content": {"parts": ["b"]}}}, {"content": "c"}, {"delta": "d"}, {"text": "e"},
    {"v": [{"p": "/message/content/parts/0", "o": "append", "v": "f"}, {"p": "/other", "o": "append", "v": "-"}, {"p": "/message/content/parts/0", "o": "append", "v": "g"}]},
    {"o": "replace", "p": "x", "v": "h"}, {"p": "", "v": {"message": {"content": {"parts": ["i"]}}}}, {"v": {"content": "j"}}, {"v": {"text": "k"}}, {"v": {"message": {"content": {"parts": [""]}}}}, {"id": "late"},
]


def test_answer_shapes(spark):
    lines = ["event: delta", ""] + [f"data: {json.dumps(s)}" for s in SHAPES] + ['data: ""', "data: not json", "data: [DONE]"]
    df = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)] + [("s", 0, "data: [DONE]"), ("t", 0, 'data: {"delta":"  "}')], "response_id string, seq long, line string")
    got = C.assemble_responses(df).collect()
    assert [(r["response_id"], r["content"], r["message_id"]) for r in got] == [("r", "abcdefghijk", "late")]


def test_claude_answers(spark):
    events = [{"type": "message_start", "message": {"id": "m1"}}, {"type": "content_block_delta", "delta": {"text": "Hel"}}, {"type": "ping"}, {"type": "content_block_delta", "delta": {"text": "lo "}}]
    df = spark.createDataFrame([("r", 9 - i, f"data: {json.dumps(e)}") for i, e in enumerate(reversed(events))], "response_id string, seq long, line string")
    assert [(r["content"], r["message_id"]) for r in C.assemble_responses(df, "claude").collect()] == [("Hello", "m1")]


def test_cli_notes(spark):
    df = spark.createDataFrame([("note", " piped \n", 1), ("hi", None, 2), (None, "x" * 9000, 3), ("abc", "", 4)], "description string, body string, timestamp long")
    got = sorted((r["timestamp"], r["content"][:12], len(r["content"])) for r in C.cli_notes(df).collect())
    assert got == [(1, "note\n\npiped", 11), (3, "x" * 12, 8000), (4, "abc", 3)]


def test_texts_that_look_like_json(spark):
    import json

    texts = ['{"a": 1} why', "{hello}", "plain", "[1,2]", '{"parts":["x"]}']
    bodies = [json.dumps({"messages": [{"content": t}]}) for t in texts] + [json.dumps({"messages": [{"content": {"parts": [t]}}]}) for t in texts] + [json.dumps({"messages": [{"content": {"n": 1}}]})]
    got = C.chatgpt_messages(spark.createDataFrame([(b,) for b in bodies], "body string"))
    assert [r["content"] for r in got.collect()] == texts * 2
