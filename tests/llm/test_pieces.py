"""Encoding against the library, both ways of joining, and the round trip."""

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from mnemoria.llm import pieces as M

TEXTS = [
    None, "", " ", "    ", "  a  b\n c\t ", "x" * 300 + "  " + "é日本語😀" * 40, "ingngng Ａ ﬁ <s> <0x0A>", "hello world hello world", "hello world hello world", "naïve café — “quoted”\r\n" * 30,
    "".join(chr(c) for c in range(1, 700)), "a" * 61, "b" * 60, "c" * 59, "    indented\n        more",
]


@pytest.fixture(scope="module")
def model():
    return M.load(M.default_model())


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    more = ["".join(rng.choice("thequickbrown fox,.é\n0123") for _ in range(rng.randint(1, 400))) for _ in range(40)]
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS + more)], "doc_id long, text string, ids string")


@pytest.fixture(scope="module")
def encoded(docs, model):
    return M.encode(docs, model).cache()


def test_equals_the_library(docs, encoded):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}
    for r in docs.collect():
        assert got[r["doc_id"]] == lib.encode(r["text"] or ""), r["text"]


def test_round_trip(docs, encoded, model):
    back = {r["doc_id"]: r["text"] for r in M.decode(encoded, model).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_decoded_in_the_same_pass(docs, encoded, model):
    want = {r["doc_id"]: (list(r["ids"]), t) for r, t in zip(encoded.orderBy("doc_id").collect(), [r["text"] or "" for r in docs.orderBy("doc_id").collect()])}
    for words in (M.BROADCAST_WORDS, 0):
        got = M.encode(docs, model, broadcast_words=words, decoded=True)
        assert {r["doc_id"]: (list(r["ids"]), r["text"]) for r in got.collect()} == want


def test_joined_way_is_equal(docs, encoded, model):
    other = {r["doc_id"]: list(r["ids"]) for r in M.encode(docs, model, broadcast_words=0).collect()}
    assert other == {r["doc_id"]: list(r["ids"]) for r in encoded.collect()}


def test_only_rare_words_are_joined(spark, model):
    """With too many words to send to every task, all but the most frequent leave it; texts are shuffled once, zipped."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    common = [word() for _ in range(500)]
    rows = [(i % 1900, " ".join([rng.choice(common) for _ in range(400)] + [word(), word()]) + " " + "q" * (i % 3 * 70)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "ids long, text string").withColumnRenamed("ids", "key").repartition(4).localCheckpoint()
    size = sum(len(t) for _, t in rows)
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    want = M.encode(docs, model, "key", decoded=True).collect()
    before = shuffled()
    got = M.encode(docs, model, "key", broadcast_words=700, decoded=True).collect()
    moved = shuffled() - before
    assert 0 < moved < size
    assert sorted((r["key"], r["text"], r["ids"]) for r in got) == sorted((r["key"], r["text"], r["ids"]) for r in want)
    assert sorted((r["key"], r["text"]) for r in got) == sorted(rows)


def test_viterbi_takes_the_best_sum(spark):
    """A unigram table: the fold against all segmentations."""
    rng = random.Random(2)
    table = {c: -8.0 + rng.random() for c in "▁abc"} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))): -6 * rng.random() for _ in range(25)}
    model = M.Pieces([(p, i, s) for i, (p, s) in enumerate(table.items())], 1000, [], bpe=False)
    words = ["▁" + "".join(rng.choice("abc") for _ in range(rng.randint(1, 8))) for _ in range(40)]
    names = list(table)

    def best(w):
        if not w:
            return 0.0
        return max(table[w[:k]] + best(w[k:]) for k in range(1, min(4, len(w)) + 1) if w[:k] in table)

    for r in M.encode_words(spark.createDataFrame([(w,) for w in set(words)], "w string"), model).collect():
        assert "".join(names[i] for i in r["ids"]) == r["w"]
        assert sum(table[names[i]] for i in r["ids"]) == pytest.approx(best(r["w"]))


@pytest.mark.parametrize("words", [M.BROADCAST_WORDS, 0])
def test_long_words_take_the_best_sum_too(spark, words):
    """Words of 40 and of 80 characters under a unigram table: both take the best path, not merges."""
    table = {"▁": -1.0, "a": -1.0, "b": -1.0, "ab": -5.0, "ba": -5.0, "aaaa": -3.5}
    model = M.Pieces([(p, i, s) for i, (p, s) in enumerate(table.items())], 1000, [b""] * 1300, bpe=False)
    texts = ["ab" * 20, "ab" * 40, "a" * 39, "a" * 81, "abé" * 30]
    got = {r["doc_id"]: list(r["ids"]) for r in M.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model, broadcast_words=words).collect()}
    assert got[0] == [0] + [1, 2] * 20 and got[1] == [0] + [1, 2] * 40
    for i, n in ((2, 39), (3, 81)):
        assert sum(x == 5 for x in got[i]) == n // 4 and sum(x == 1 for x in got[i]) == n % 4
    assert got[4] == [0] + [1, 2, 1195, 1169] * 30


def test_empty_table(docs, model):
    assert M.encode(docs.limit(0), model).count() == 0
    assert M.decode(docs.limit(0).select("doc_id", F.array().cast("array<int>").alias("ids")), model).count() == 0
