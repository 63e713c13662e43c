"""Scores, decoding and verdicts against plain recomputation; clashing columns and very long texts."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemoria.llm import chat, jaccard, langid, mixing, passages, pieces, quality_rules, queries, suffix_dedup, toxicity
from mnemoria.llm.common import cut

SF = "/root/testdata/sf0.01"


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_toxicity_scores_equal_a_scan_of_words(spark):
    """Every text is split and its words are looked up one by one."""
    docs = documents(spark).select("doc_id", "text")
    lex = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"), F.lit(True))
    assert lex.words and lex.logistic is not None
    lex.stems |= {w[:4]: 1.5 for w in list(lex.words)[:3]}
    some = list(lex.words)[:2]
    lex.phrases |= {f"you {some[0]}": some[0]}
    extra = spark.createDataFrame([(-1, f"you {some[0]} and {some[1]}!"), (-2, f"{some[0].upper()} {some[0][:4]}ish"), (-3, None), (-4, "")], docs.schema)
    docs = docs.unionByName(extra)

    def brute(folded):
        words = folded.split()
        total = 0.0
        for w in words:
            stems = [s for s in lex.stems if w.startswith(s)]
            total += lex.words[w] if w in lex.words else lex.stems[max(stems, key=len)] if stems else 0.0
        for a, b in zip(words, words[1:]):
            total -= lex.words.get(lex.phrases.get(f"{a} {b}"), 0.0)
        total = max(total, 0.0)
        x = [1.0, float(total > 0), math.log1p(total), math.log1p(total * 100 / (folded.count(" ") + 50))]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(np.dot(x, lex.logistic))))))

    folded = {r["doc_id"]: r["t"] for r in docs.select("doc_id", toxicity.fold_column(F.col("text")).alias("t")).collect()}
    for r in toxicity.score(docs, lex).collect():
        want = brute(folded[r["doc_id"]])
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == int(want >= 0.7)


def test_decoding_equals_the_nearest_codeword(spark):
    docs = documents(spark).select("doc_id", "text", "lang")
    m = langid.train(docs, F.col("doc_id") % 2 == 0)
    signs, classes = 2 * m.code - 1, langid.CLASS
    texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id % 7 = 1").collect()}
    for r in langid.predict(docs.filter("doc_id % 7 = 1"), m).collect():
        text = texts[r["doc_id"]]
        if r["lang_pred"] == "und":
            assert text is None or not any(c.isalpha() for c in text)
            continue
        c = [0, *(int(classes[b]) for b in text.encode()), 0]
        grams = [g for g in ((x << 12) | (y << 6) | z for x, y, z in zip(c, c[1:], c[2:])) if g]
        margin = [sum(float(w[g]) for g in grams) / max(1, len(grams)) for w in m.weights]
        loss = [sum(v * math.log1p(math.exp(-8 * x * s)) for v, x, s in zip(m.value, margin, row)) for row in signs]
        p = [math.exp(-(x - min(loss)) * min(len(grams), 400) / 20) for x in loss]
        assert r["lang_pred"] == m.languages[int(np.argmin(loss))]
        assert r["score"] == pytest.approx(max(p) / sum(p), abs=1e-4)


def test_verdicts_equal_distances_from_the_fit(spark):
    docs = documents(spark)
    c = cut(quality_rules.vector(quality_rules.counts(docs)))
    good = c.filter((F.col("n_words") >= 50) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words")))
    fit = {(r["lang"], r["source"]): r for r in quality_rules.fit_mcd(good).collect()}
    stats = {r["doc_id"]: r for r in c.collect()}
    kept = 0
    for r in queries.op7_quality_rules(spark, SF).collect():
        s = stats[r["doc_id"]]
        failed = s["n_words"] < 50 or 100 * s["n_repeat_words"] > 50 * s["n_words"]
        assert r["base_failed"] == failed
        if failed:
            assert not r["kept"] and r["distance"] is None
            continue
        f = fit[s["lang"], s["source"]]
        off = np.array([s[f"x{i}"] - f[f"m{i}"] for i in range(4)])
        cov = np.array([[f[f"s{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
        d2 = float(off @ np.linalg.solve(cov, off))
        assert r["distance"] ** 2 == pytest.approx(d2, rel=1e-6, abs=1e-9) and r["kept"] == (d2 <= 80.0)
        kept += r["kept"]
    assert kept > 500


def test_contract_columns_come_first(spark):
    assert queries.op5_toxicity(spark, SF).columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    assert queries.op6_language_id(spark, SF).columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    assert queries.op7_quality_rules(spark, SF).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    null = spark.createDataFrame([(None,), (1,)], "doc_id long").select(queries.held_out(3, 1).alias("h")).collect()
    assert None not in [r["h"] for r in null]


CLASH = ["toxic", "lang_pred", "score", "ids", "tokens", "w", "n", "key", "row", "name", "tie", "slice", "size", "k", "x", "g", "tile", "component", "cell", "i", "t", "labels"]


def clashing(spark):
    rng = random.Random(1)
    words = ["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dogs", "hund", "und"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 5, 80]))), ["en", "de", None][i % 3], ["a", "b", None][i % 3], 1) for i in range(60)]
    rows += [(100, rows[2][1], "en", "a", 1), (2, rows[2][1], "en", "a", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df, df.select("*", *[F.lit("clash").alias(c) for c in CLASH])


def test_clashing_columns_change_nothing(spark):
    plain, odd = clashing(spark)
    labels = plain.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"), (F.col("doc_id") % 2).cast("int").alias("quality"))
    model, table = langid.train(plain, F.lit(True)), pieces.session_pieces(spark)
    for run in (
        lambda d: toxicity.score(d, toxicity.learn(d, labels, F.lit(True))),
        lambda d: langid.predict(d, langid.train(d, F.lit(True))),
        lambda d: langid.predict(d, model, keep_text=True),
        lambda d: pieces.encode(d, table),
        lambda d: jaccard.join(d),
        lambda d: quality_rules.judge(d),
        lambda d: mixing.mix(d, queries.quality_weights(labels)),
        lambda d: suffix_dedup.cut_repeats(d).select("doc_id", "n_removed", F.hex("kept")),
        lambda d: passages.cut_passages(d).select("doc_id", "n_removed", "kept"),
    ):
        assert sorted(map(str, run(odd).collect())) == sorted(map(str, run(plain).collect()))


def test_very_long_texts(spark):
    """Texts of over a million characters beside short ones."""
    rng = random.Random(6)
    words = ["the", "and", "house", "water", "naïve", "über", "it's"]
    long = " ".join(rng.choice(words) + str(rng.randint(0, 50_000)) for _ in range(120_000))
    near = long.replace("water7 ", "fire7 ", 3)
    rows = [(1, long, "en", "a"), (2, near, "en", "a"), (3, "w" * 1_200_000, "en", "a"), (4, "short text of a few words", "en", "a"), (5, long[:500], "en", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(2)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.join(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
    got = {r["doc_id"]: r for r in quality_rules.judge(df).collect()}
    assert got[1]["n_words"] == 120_000 and got[3]["word_chars"] == 1_200_000
    assert {r["lang_pred"] for r in langid.predict(df, langid.train(df, F.lit(True))).collect()} == {"en"}
    lex = toxicity.Lexicon({"house7": 2.0}, {}, {}, np.array([0.0, 1.0, 0.0, 0.0]))
    assert {r["doc_id"]: r["matches"] for r in toxicity.score(df, lex).collect()}[1] == long.split().count("house7")
    cut = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in passages.cut_passages(df).collect()}
    assert cut[3] == (1, 0) and cut[1][1] > 119_000 and cut[5][1] >= 35
    turns = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", near)], "conv_id long, turn long, role string, text string")
    assert {(r["perspective"], r["seq"], hashlib.md5(r["rendered"].encode()).hexdigest()) for r in chat.rotate(turns).collect()} and chat.rotate(turns).count() == 4
