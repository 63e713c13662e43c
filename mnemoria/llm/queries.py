"""The registered query of each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, hard_negatives, jaccard, langid, mixing, passages, pieces, quality_rules, repair, suffix_dedup, token_counts, toxicity
from .common import table

WORD_SQL = r"[^\x20\x09-\x0D]+"
#: Most ids that are broadcast; beyond it, Spark joins by shuffle.
BROADCAST_IDS = 1_000_000


def held_out(mod: int, is_: int) -> Column:
    """Of a null id no row is."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod == is_, F.lit(False))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = suffix_dedup.cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the text decoded from them."""
    docs = table(spark, sf_dir, "documents")
    p = pieces.session_pieces(spark)
    got = pieces.encode(docs.select("doc_id", "text"), p, decoded=True)
    ids, text = F.col("ids"), F.col("text")
    return got.select("doc_id", F.size(ids).cast("long").alias("n_tokens"), F.xxhash64(ids).alias("ids_hash"), F.length(text).cast("long").alias("n_chars_decoded"), F.xxhash64(text).alias("decoded_hash"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out(3, 1))
    return toxicity.score(docs, lexicon).select("doc_id", held_out(3, 1).alias("held_out"), "score", "predicted", "matches", "matched_weight")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs, ~held_out(4, 2))
    return langid.predict(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score", "runner_up", "unlike", "ambiguous")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = quality_rules.judge(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return got.select(*first, *[c for c in got.columns if c not in first])


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = chat.rotate(table(spark, sf_dir, "conversations"))
    return got.withColumn("rendered", F.sha2("rendered", 256)).withColumnRenamed("rendered", "rendered_sha256")


def sample_edits(docs: DataFrame) -> DataFrame:
    """Three edits for every document, from its id and text alone: a replacement, a removal and an appended sentence."""
    n = F.length("text")
    place = lambda k: F.pmod(F.hash("doc_id", F.lit(k)), n + 1).cast("int")
    e = lambda at, remove, insert: F.struct(at.alias("at"), remove.cast("int").alias("remove"), insert.alias("insert"))
    piece = F.substring(F.col("text"), place(3) + 1, F.pmod(F.hash("doc_id", F.lit(4)), F.lit(60)).cast("int"))
    return docs.withColumn("edits", F.array(e(place(1), F.pmod(F.hash("doc_id", F.lit(2)), F.lit(40)), piece), e(place(5), F.lit(25), F.lit("")), e(n, F.lit(0), F.concat(F.lit(" See note "), F.col("doc_id").cast("string"), F.lit(".")))))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    got = token_counts.count_edits(sample_edits(docs), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return got.withColumn("sums", F.xxhash64("sums")).withColumnRenamed("sums", "tree_hash")


def quality_weights(labels: DataFrame) -> DataFrame:
    """labels(doc_id, quality) -> doc_id, weight: good documents are drawn four times as readily as bad ones."""
    return labels.select("doc_id", F.when(F.col("quality") == 1, 2.0).when(F.col("quality") == 0, 0.5).alias("weight"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mixing.mix(table(spark, sf_dir, "documents"), quality_weights(table(spark, sf_dir, "labels")))
    return got.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken")


def op11_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = passages.cut_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def damage(turns: DataFrame) -> DataFrame:
    """Of twenty turns one each is dropped, emptied, cut of its full stops, said twice, or given to the user."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    fate, text = F.crc32(key.cast("binary")) % 20, F.coalesce("text", blank)
    text = F.when(fate == 1, "").when(fate == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fate == 4, "user").otherwise(F.coalesce("role", blank))
    kept = turns.filter(fate != 0)
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), F.when(fate == 3, 2).otherwise(1))).alias("time")).drop("time")


def op12_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    got = repair.digests(repair.repair(damage(turns))).withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct().join(got, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *repair.COUNTS, "cost")]
    return every.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are a hundredth of the rows; each seventh label is moved by one."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_jaccard_join": op3_jaccard_join,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_quality_rules": op7_quality_rules,
    "op8_chat_format": op8_chat_format,
    "op9_token_counts": op9_token_counts,
    "op10_mixing": op10_mixing,
    "op11_repeated_passages": op11_repeated_passages,
    "op12_structure_repair": op12_structure_repair,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE = {
    "op10_mixing": rf"""
WITH w AS (SELECT doc_id, max(CASE quality WHEN 1 THEN 2.0::DOUBLE WHEN 0 THEN 0.5::DOUBLE END) AS weight FROM labels GROUP BY doc_id),
s AS (
  SELECT d.doc_id, d.source, len(regexp_extract_all(coalesce(d.text, ''), '{WORD_SQL}'))::BIGINT AS size,
    -ln((('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '') || ':17'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0) / coalesce(w.weight, 1.0) AS k
  FROM documents d LEFT JOIN w ON d.doc_id = w.doc_id),
g AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
o AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight FROM g),
r AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS rate FROM o),
c AS (SELECT a.source, a.source_size, a.weight, a.most, a.rate,
    (1.5::DOUBLE * (SELECT sum(source_size) FROM r) - coalesce((SELECT sum(b.most) FROM r b WHERE b.rate < a.rate), 0)) / (SELECT sum(b.weight) FROM r b WHERE b.rate >= a.rate) AS lv FROM r a),
l AS (SELECT arg_min(lv, rate) AS level FROM c WHERE lv <= rate),
t AS (SELECT source, source_size, CASE WHEN l.level IS NULL THEN most ELSE least(most, l.level * weight) END AS target FROM c, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (SELECT s.doc_id, s.size, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size AS rest,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id ROWS UNBOUNDED PRECEDING) AS upto
  FROM s JOIN e ON s.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, round(target, 3) AS target,
  (size * (epochs + CASE WHEN upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken FROM p""",
    "op11_repeated_passages": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD_SQL}') AS w FROM documents),
i AS (SELECT r, unnest(range(1, len(w) + 1)) AS k FROM d),
n AS (SELECT i.r, k, w[k] AS word, CASE WHEN k <= len(w) - 34 THEN md5(array_to_string(w[k:k + 34], ' ')) END AS name FROM i JOIN d ON i.r = d.r),
c AS (SELECT name FROM n WHERE name IS NOT NULL GROUP BY name HAVING count(*) > 1),
g AS (SELECT n.r, k, word, coalesce(max(CASE WHEN c.name IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY n.r ORDER BY k ROWS 34 PRECEDING), 0) AS gone FROM n LEFT JOIN c ON n.name = c.name),
a AS (SELECT r, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY k) FILTER (WHERE gone = 0) AS kept FROM g GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a ON d.r = a.r""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
n AS (SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
}
