"""Incremental counts against encoding the edited text anew."""

import random

import public_tokenizers as P
import pytest

from mnemoria.llm import token_counts as T


@pytest.fixture(scope="module")
def tok():
    return T.read_tokenizer(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


def whole(tok, text):
    return sum(tok.count(p) for p in tok.find(text))


def check(tok, tree, text):
    assert tree.total == (len(text), whole(tok, text))
    for low, high in zip(tree.levels, tree.levels[1:]):
        assert len(high) == (len(low) + 1) // 2
        assert [tuple(map(sum, zip(*low[i : i + 2]))) for i in range(0, len(low), 2)] == [tuple(x) for x in high]


@pytest.mark.parametrize("seed", range(40))
def test_random_edits_equal_full_counts(tok, seed):
    rng = random.Random(seed)
    bits = ["a", "it's", " ", "  ", "\n", "\n\n", "12", "!?", "'", "re", "é", "日本", "😀", " the", "\t", "x" * 90]
    text = "".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 300, 2000])))
    tree = T.Tree(tok.leaves(text))
    check(tok, tree, text)
    for _ in range(30):
        at, gone = rng.randint(-2, len(text) + 2), rng.choice([0, 0, 1, 3, 50, 3000])
        new = "".join(rng.choice(bits) for _ in range(rng.choice([0, 0, 1, 2, 40])))
        text, again = T.apply_edit(text, tree, at, gone, new, tok)
        check(tok, tree, text)


def test_only_the_surroundings_are_encoded_again(tok):
    text = "some plain words here. " * 5000
    tree = T.Tree(tok.leaves(text))
    _, again = T.apply_edit(text, tree, 60_000, 4, "other", tok)
    assert again < 1500


def test_frame(spark, tok):
    rows = [(1, "hello world " * 50, [(6, 5, "there"), None]), (1, "hello world " * 50, [(6, 5, "there"), None]), (2, None, None), (3, "", [(0, 0, "new")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<at int, remove int, insert string>>")
    got = sorted(map(tuple, T.count_edits(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).select("doc_id", "tokens_after", "chars_after").collect()))
    edited = "hello there " + "hello world " * 49
    assert got == [(1, whole(tok, edited), len(edited))] * 2 + [(2, 0, 0), (3, whole(tok, "new"), 3)]
    assert T.count_edits(df.limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0


def test_kept_trees_are_fed_back(spark, tok):
    """Three calls: the first encodes, the others encode what is touched; equal to encoding the last text anew."""
    file, rng = P.path("byte_bpe_50k.tiktoken"), random.Random(3)
    texts = {i: " ".join(rng.choice(["plain", "words", "it's", "12", "naïve", "日本"]) for _ in range(4000)) for i in range(4)} | {9: None, 10: ""}
    first = T.keep_trees(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), file, P.PATTERN).cache()
    assert {r["doc_id"]: r["tokens_after"] for r in first.collect()} == {i: whole(tok, t or "") for i, t in texts.items()}
    kept = first
    for k in range(2):
        edits = [(i, [(rng.randint(0, 9000), rng.randint(0, 20), f" new {k} text ")]) for i in (0, 2, 10)]
        e = spark.createDataFrame(edits, "doc_id long, edits array<struct<at int, remove int, insert string>>")
        kept = T.keep_trees(kept.select("doc_id", "text", "tree").join(e, "doc_id", "left"), file, P.PATTERN).cache()
        for r in kept.collect():
            assert r["tokens_after"] == whole(tok, r["text"] or "") and r["chars_after"] == len(r["text"] or "")
            assert r["reencoded_chars"] < 2000 if r["doc_id"] in (0, 2, 10) else r["reencoded_chars"] == 0
            check(tok, T.Tree.of([[(n["chars"], n["tokens"]) for n in level] for level in r["tree"]]), r["text"] or "")
    assert {r["doc_id"]: r["text"] for r in kept.collect()}[9] is None


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", [(0, 1, "c")], "x", 5)], "doc_id long, text string, edits array<struct<at int, remove int, insert string>>, sums string, tokens_after int")
    assert T.count_edits(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN).first()["tokens_after"] == 2
