"""The pipeline's stages on planted documents."""

import functools
import random

import pytest

import corpus_pipeline as P


@pytest.fixture(scope="module")
def outputs(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8)))
    fresh = lambda n: " ".join(word() for _ in range(n))
    passage = fresh(60)
    rows = []
    for i in range(60):
        rows.append((i, fresh(rng.randint(30, 120)), ["en", "de"][i % 2], f"s{i % 4}", 0))
    rows[3] = (3, fresh(150), *rows[3][2:])
    near = rows[3][1].split()
    near[10] = "changed"
    rows += [(100, rows[2][1], "en", "s0", 0), (101, " ".join(near), "en", "s1", 0), (102, None, "en", "s1", 0), (103, "123 !!", None, "s1", 0)]
    rows += [(110, fresh(40) + " " + passage + " é", "en", "s2", 0), (111, fresh(40) + " é" + passage, "en", None, 0)]
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i in range(0, 60, 3)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in P.STAGES:
        stage(spark, docs, d).write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        out.append(docs)
    return rows, passage, out, d


def test_columns_and_order(outputs):
    _, _, out, _ = outputs
    assert [n for n, _ in P.STAGES] == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "source_mixing", "sentencepiece_encoding"]
    assert all(set(o.columns) == set(P.COLUMNS) for o in out[:-1])


def test_language_drops_only_texts_without_one(outputs):
    rows, _, out, _ = outputs
    assert {r["doc_id"] for r in out[0].collect()} == {r[0] for r in rows} - {102, 103}


def test_one_of_each_group_stays(outputs):
    _, _, out, _ = outputs
    assert {r["doc_id"] for r in out[0].collect()} - {r["doc_id"] for r in out[1].collect()} == {100, 101}


def test_the_repeated_passage_goes_once(outputs):
    _, passage, out, _ = outputs
    texts = {r["doc_id"]: r["text"] for r in out[2].collect()}
    assert passage in texts[110] and passage not in texts[111] and len(texts[111]) < 400
    before = {r["doc_id"]: r["text"] for r in out[1].collect()}
    assert all(texts[i] == before[i] for i in before if i < 60)


def test_the_mix_repeats_documents(outputs):
    _, _, out, _ = outputs
    n = {r["doc_id"]: r["count"] for r in out[3].groupBy("doc_id").count().collect()}
    assert max(n.values()) <= 2 and set(n) <= {r["doc_id"] for r in out[2].collect()}
    words = lambda df: sum(len(r["text"].split()) for r in df.collect())
    assert words(out[3]) == pytest.approx(1.5 * words(out[2]), rel=0.1)


def test_ids_for_every_row_and_run_agrees(spark, outputs):
    _, _, out, d = outputs
    assert out[4].count() == out[3].count() and out[4].filter("n_tokens <> size(ids) or n_tokens = 0").count() == 0
    whole = P.run(spark, d)
    assert sorted((r["doc_id"], r["ids"]) for r in whole.collect()) == sorted((r["doc_id"], r["ids"]) for r in out[4].collect())


def test_ids_of_many_words_move_less_than_the_texts(spark, monkeypatch):
    """The last stage on a mix that repeats documents, with too many words to send to every task."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(7))
    common = [word() for _ in range(300)]
    once = [(i, " ".join([rng.choice(common) for _ in range(300)] + [word()]), "en", "s0", 0) for i in range(600)]
    rows = once + once[::2]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).localCheckpoint()
    context = spark.sparkContext._jsc.sc()

    def shuffled():
        context.listenerBus().waitUntilEmpty(30_000)
        executors = context.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    want = sorted((r["doc_id"], r["n_tokens"], r["ids"]) for r in P.encoded(spark, docs, "").collect())
    monkeypatch.setattr(P.pieces, "encode", functools.partial(P.pieces.encode, broadcast_words=400))
    before = shuffled()
    got = sorted((r["doc_id"], r["n_tokens"], r["ids"]) for r in P.encoded(spark, docs, "").collect())
    assert shuffled() - before < sum(len(r[1]) for r in rows)
    assert got == want and len(got) == 900


def test_language_rejects_mixed_and_foreign_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(*P.COLUMNS)
    have = [r for r in docs.filter("n_chars between 600 and 3000").orderBy("doc_id").collect()]
    of = lambda lang: [r["text"] for r in have if r["lang"] == lang][:3]
    half = [a[: min(len(a), len(b))] + " " + b[: min(len(a), len(b))] for x, y in (("de", "es"), ("es", "fr"), ("fr", "en")) for a, b in zip(of(x), of(y))]
    foreign = ["Kaikki ihmiset syntyv\u00e4t vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu j\u00e4rki ja omatunto, ja heid\u00e4n on toimittava toisiaan kohtaan veljeyden hengess\u00e4.", "\u0412\u0441\u0435 \u043b\u044e\u0434\u0438 \u0440\u043e\u0436\u0434\u0430\u044e\u0442\u0441\u044f \u0441\u0432\u043e\u0431\u043e\u0434\u043d\u044b\u043c\u0438 \u0438 \u0440\u0430\u0432\u043d\u044b\u043c\u0438 " * 3]
    swapped = of("fr")[0][:500] + " \u00e9"
    extra = [(-1 - i, t, ["de", "es", "fr"][i // 3], "s", 0) for i, t in enumerate(half)] + [(-1001 - i, t, "en", "s", 0) for i, t in enumerate(foreign)] + [(-2001, swapped, "de", "s", 0), (-2002, "ok", None, "s", 0), (-2003, "ok", "es", "s", 0)]
    rows = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    got = {r["doc_id"]: r["lang"] for r in P.language(spark, rows, "").collect()}
    assert not {-1001, -1002, -2002} & set(got)
    assert len(half) == 9 and sum(-1 - i in got for i in range(9)) <= 1
    assert got[-2001] == "fr" and got[-2003] == "es"
    clean = {r["doc_id"] for r in docs.collect() if r["text"] and any(c.isalpha() for c in r["text"])}
    assert len(clean & set(got)) >= 0.995 * len(clean)
