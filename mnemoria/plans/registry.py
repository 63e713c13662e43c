"""Registered queries over the given tables, and their SQL counterparts.

QUERIES[name](spark, sf_dir) is a DataFrame; ORACLE[name] is SQL over the tables of the same names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import audits, context, enrich, hygiene, knn, readpath, search, stats, substrings, sync, turns
from ..sources import adapters, capture
from ..sources.scratch import materialised

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: The tables in their roles, in SQL.
M = """m AS (SELECT conv_id || '-' || turn AS message_id, conv_id::VARCHAR AS conversation_id, role, text AS content,
  (1700000000000 + conv_id * 86400000 + turn * 1000)::BIGINT AS timestamp, ['chatgpt', 'claude', 'cli'][(conv_id % 3 + 1)::INT] AS platform, turn AS seq FROM conversations)"""
V = """v AS (SELECT vec_id, vec_id::VARCHAR AS message_id, CASE WHEN vec_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role,
  ['chatgpt', 'claude', 'cli'][(label % 3 + 1)::INT] AS source, (1700000000000 + vec_id * 1000)::BIGINT AS timestamp, (label % 2)::VARCHAR AS user_id,
  embedding::DOUBLE[] AS e FROM embeddings)"""
#: Distances of all rows to message 0.
D = V + ", d AS (SELECT a.*, 1 - list_cosine_similarity(a.e, b.e) AS distance FROM v a, (SELECT e FROM v WHERE vec_id = 0) b)"
#: Turns and chunks of 5 turns, overlapping by 2.
TURNS = (
    M
    + """, o AS (SELECT *, CASE WHEN role = 'user' OR coalesce(lag(role) OVER (PARTITION BY conversation_id ORDER BY timestamp, seq) <> 'user', true) THEN 1 ELSE 0 END AS opens
  FROM m WHERE role IN ('user', 'assistant')),
t AS (SELECT *, (sum(opens) OVER (PARTITION BY conversation_id ORDER BY timestamp, seq ROWS UNBOUNDED PRECEDING) - 1)::INT AS turn_idx FROM o)"""
)
CHUNKS = (
    TURNS
    + """, x AS (SELECT *, unnest(generate_series(greatest(0, ceil((turn_idx - 4) / 3.0)::INT), (turn_idx // 3)::INT))::INT AS chunk_idx FROM t),
c AS (SELECT conversation_id, chunk_idx, (min(turn_idx) + 1) || '-' || (max(turn_idx) + 1) AS turn_range, first(platform ORDER BY turn_idx, role DESC) AS platform,
  string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || content, chr(10) || chr(10) ORDER BY turn_idx, role DESC) AS content,
  count(DISTINCT turn_idx)::INT AS turn_count, min(timestamp) AS start_timestamp, max(timestamp) AS end_timestamp FROM x GROUP BY ALL)"""
)


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*cols, F.round("distance", 6).alias("distance"))


def _query(v: DataFrame) -> DataFrame:
    return v.filter("vec_id = 0")


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# -- vector search --------------------------------------------------------------------------------------------------


@register("vector_topk", f"WITH {D} SELECT message_id, role, source, timestamp, round(distance, 6) AS distance FROM d WHERE distance < 0.9 ORDER BY distance, message_id LIMIT 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = adapters.vectors(spark, sf_dir)
    return rounded(search.nearest(v, _query(v), 5, 0.9), "message_id", "role", "source", "timestamp")


@register(
    "vector_topk_batch",
    f"""WITH {V}, q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0),
r AS (SELECT query_id, vec_id, 1 - list_cosine_similarity(e, qe) AS distance FROM q JOIN v ON vec_id <> query_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id)::INT AS rank FROM r)
SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM k WHERE rank <= 5""",
)
def vector_topk_batch(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir)
    return rounded(search.nearest_batch(v, v.filter("vec_id % 20 = 0")), "query_id", "rank", "vec_id")


@register("vector_recency_topk", f"WITH {D} SELECT message_id, role, source, timestamp, round(distance, 6) AS distance FROM d WHERE distance < 0.9 AND timestamp < 1700000000000 + 400000 - 120000 ORDER BY distance, message_id LIMIT 5")
def vector_recency_topk(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir)
    return rounded(search.nearest(v, _query(v), 5, 0.9, search.older_than(120, adapters.EPOCH + 400_000)), "message_id", "role", "source", "timestamp")


@register("chat_turn_search", f"WITH {D} SELECT message_id, source, round(1 - distance, 6) AS similarity FROM d WHERE user_id = '0' AND source = 'chatgpt' AND 1 - distance > 0.1 ORDER BY distance, message_id LIMIT 5")
def chat_turn_search(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir).withColumn("platform", F.col("source"))
    return search.search_chunks(v, _query(v), "0", "chatgpt", 0.1).select("message_id", "source", F.round("similarity", 6).alias("similarity"))


@register("find_similar", f"WITH {D} SELECT message_id, round(distance, 6) AS distance FROM d WHERE vec_id <> 0 AND distance < 0.9 ORDER BY distance, message_id LIMIT 5")
def find_similar(spark, sf_dir):
    return rounded(search.find_similar(adapters.vectors(spark, sf_dir), "0", 5, 0.9), "message_id")


@register("search_postfilter", f"WITH {D}, k AS (SELECT * FROM d WHERE distance < 0.9 ORDER BY distance, message_id LIMIT 10) SELECT message_id, source, round(distance, 6) AS distance FROM k WHERE role = 'user' AND source = 'chatgpt'")
def search_postfilter(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir)
    return rounded(search.post_filtered(v, _query(v), (F.col("role") == "user") & (F.col("source") == "chatgpt"), 10, 0.9), "message_id", "source")


@register("search_prefilter", f"WITH {D} SELECT message_id, source, round(distance, 6) AS distance FROM d WHERE distance < 0.9 AND role = 'user' AND source = 'chatgpt' ORDER BY distance, message_id LIMIT 10")
def search_prefilter(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir)
    return rounded(search.nearest(v, _query(v), 10, 0.9, (F.col("role") == "user") & (F.col("source") == "chatgpt")), "message_id", "source")


@register("advanced_search", f"WITH {D}, k AS (SELECT * FROM d WHERE distance < 0.9 ORDER BY distance, message_id LIMIT 20) SELECT message_id, role, timestamp, round(distance, 6) AS distance FROM k WHERE timestamp BETWEEN 1700000050000 AND 1700000450000 AND role IN ('user', 'system') ORDER BY distance, message_id LIMIT 10")
def advanced_search(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir)
    return rounded(search.advanced(v, _query(v), adapters.EPOCH + 50_000, adapters.EPOCH + 450_000, ("user", "system"), 10, 0.9), "message_id", "role", "timestamp")


# The same searches for a set of queries: every row whose id is divisible by 20, against all rows.


def _batch_sql(k: int, before: str = "true", after: str = "true", limit: int = 1000) -> str:
    return f"""WITH {V}, q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0),
d AS (SELECT query_id, v.*, 1 - list_cosine_similarity(e, qe) AS distance FROM q CROSS JOIN v),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), vec_id) AS place FROM d WHERE distance < 0.9 AND {before}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS rank FROM k WHERE place <= {k} AND {after})
SELECT query_id, rank, vec_id, round(distance, 6) AS distance FROM r WHERE rank <= {limit}"""


def _set(v: DataFrame) -> DataFrame:
    return v.filter("vec_id % 20 = 0")


@register("vector_recency_topk_batch", _batch_sql(5, "timestamp < 1700000000000 + 400000 - 120000"))
def vector_recency_topk_batch(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir)
    return rounded(search.nearest_batch(v, _set(v), 5, 0.9, False, where=search.older_than(120, adapters.EPOCH + 400_000)), "query_id", "rank", "vec_id")


@register("chat_turn_search_batch", _batch_sql(5, "user_id = '0' AND source = 'chatgpt'"))
def chat_turn_search_batch(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir)
    return rounded(search.nearest_batch(search.for_tenant(v, "0"), _set(v), 5, 0.9, False, where=F.col("source") == "chatgpt"), "query_id", "rank", "vec_id")


@register("find_similar_batch", _batch_sql(5, "vec_id <> query_id"))
def find_similar_batch(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir)
    return rounded(search.nearest_batch(v, _set(v), 5, 0.9), "query_id", "rank", "vec_id")


@register("search_postfilter_batch", _batch_sql(10, after="role = 'user' AND source = 'chatgpt'"))
def search_postfilter_batch(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir)
    return rounded(search.post_filtered_batch(v, _set(v), (F.col("role") == "user") & (F.col("source") == "chatgpt"), 10, 0.9), "query_id", "rank", "vec_id")


@register("search_prefilter_batch", _batch_sql(10, "role = 'user' AND source = 'chatgpt'"))
def search_prefilter_batch(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir)
    return rounded(search.nearest_batch(v, _set(v), 10, 0.9, False, where=(F.col("role") == "user") & (F.col("source") == "chatgpt")), "query_id", "rank", "vec_id")


@register("advanced_search_batch", _batch_sql(20, after="timestamp BETWEEN 1700000050000 AND 1700000450000 AND role IN ('user', 'system')", limit=10))
def advanced_search_batch(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir)
    where = F.col("timestamp").between(adapters.EPOCH + 50_000, adapters.EPOCH + 450_000) & F.col("role").isin("user", "system")
    return rounded(search.post_filtered_batch(v, _set(v), where, 20, 0.9, 10), "query_id", "rank", "vec_id")


@register("knn_cells")
def knn_cells(spark, sf_dir):
    """The five nearest rows among those of the nearest cells."""
    v = adapters.vectors(spark, sf_dir)
    cells = materialised(knn.learn_cells(v))
    return rounded(knn.nearest_in_cells(v, _set(v), cells), "query_id", "rank", "vec_id")


@register("knn_recall")
def knn_recall(spark, sf_dir):
    """How many of the exact five nearest the search in cells finds."""
    v = adapters.vectors(spark, sf_dir)
    cells = materialised(knn.learn_cells(v))
    return knn.recall(knn.nearest_in_cells(v, _set(v), cells), knn.nearest_batch(v, _set(v)))


@register("conversation_context", f"WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp, seq)::INT AS rank FROM m) SELECT conversation_id, rank, message_id, role, content FROM r WHERE rank <= 20")
def conversation_context(spark, sf_dir):
    return search.conversation_context(adapters.messages(spark, sf_dir)).select("conversation_id", "rank", "message_id", "role", "content")


@register("keyword_search", f"WITH {M} SELECT message_id, timestamp, content FROM m WHERE content ILIKE '%thing%' ORDER BY timestamp DESC, message_id LIMIT 5")
def keyword_search(spark, sf_dir):
    return search.keyword(adapters.messages(spark, sf_dir), "Thing").select("message_id", "timestamp", "content")


@register("latest_messages", f"WITH {M} SELECT message_id, platform, length(content)::INT AS n_chars, left(content, 100) AS preview FROM m WHERE platform = 'claude' ORDER BY timestamp DESC, message_id LIMIT 10")
def latest_messages(spark, sf_dir):
    m = adapters.messages(spark, sf_dir).filter("platform = 'claude'")
    return stats.newest(m, 10, "timestamp", "message_id").select("message_id", "platform", F.length("content").alias("n_chars"), F.substring("content", 1, 100).alias("preview"))


@register("message_ages", f"WITH {M} SELECT message_id, floor((1700000500500 - timestamp) / 1000.0)::BIGINT AS age_seconds FROM m")
def message_ages(spark, sf_dir):
    return adapters.messages(spark, sf_dir).select("message_id", T.age_seconds(F.col("timestamp"), adapters.EPOCH + 500_500).alias("age_seconds"))


@register("event_times", "SELECT event_id, epoch_us(ts::TIMESTAMP) // 1000 AS ts_ms FROM events")
def event_times(spark, sf_dir):
    return adapters.read(spark, sf_dir, "events").select("event_id", T.epoch_ms(F.col("ts")).alias("ts_ms"))


@register(
    "cross_platform_pairs",
    f"""WITH {M}, p AS (SELECT *, ['chatgpt', 'claude', 'cli'][((seq + timestamp // 86400000) % 3 + 1)::INT] AS place FROM m)
SELECT u.conversation_id, u.message_id AS user_id, a.message_id AS assistant_id, u.place AS user_platform, a.place AS assistant_platform FROM p u JOIN p a USING (conversation_id)
WHERE u.role = 'user' AND a.role = 'assistant' AND u.place <> a.place ORDER BY u.timestamp DESC, user_id, assistant_id LIMIT 5""",
)
def cross_platform_pairs(spark, sf_dir):
    place = F.element_at(F.array(*[F.lit(p) for p in adapters.PLATFORMS]), ((F.col("seq") + F.floor(F.col("timestamp") / 86_400_000)) % 3 + 1).cast("int"))
    m = adapters.messages(spark, sf_dir).withColumn("platform", place)
    return search.cross_platform_pairs(m).select("conversation_id", "user_id", "assistant_id", "user_platform", "assistant_platform")


# -- turns and chunks -------------------------------------------------------------------------------------------------


@register("turns", f"WITH {TURNS} SELECT conversation_id, turn_idx, max(CASE WHEN role = 'user' THEN content END) AS user_content, max(CASE WHEN role = 'assistant' THEN content END) AS assistant_content FROM t GROUP BY ALL")
def turns_query(spark, sf_dir):
    return turns.turns(adapters.messages(spark, sf_dir)).withColumn("turn_idx", F.col("turn_idx").cast("int"))


@register("turn_chunks", f"WITH {CHUNKS} SELECT conversation_id, chunk_idx, turn_range, platform, content, turn_count, start_timestamp, end_timestamp FROM c")
def turn_chunks(spark, sf_dir):
    return turns.chunks(adapters.messages(spark, sf_dir)).select("conversation_id", "chunk_idx", "turn_range", "platform", "content", "turn_count", "start_timestamp", "end_timestamp")


@register("chunk_statistics", f"WITH {CHUNKS} SELECT count(*) AS total_chunks, round(avg(turn_count), 2) AS avg_turns, round(avg(length(content)))::BIGINT AS avg_length FROM c")
def chunk_statistics(spark, sf_dir):
    return turns.chunk_statistics(turns.chunks(adapters.messages(spark, sf_dir)))


@register("conversation_rollup", f"WITH {CHUNKS} SELECT conversation_id, count(*) AS chunk_count, min(start_timestamp) AS started, max(end_timestamp) AS ended FROM c GROUP BY 1 ORDER BY ended DESC, conversation_id LIMIT 10")
def conversation_rollup(spark, sf_dir):
    return turns.conversation_rollup(turns.chunks(adapters.messages(spark, sf_dir)))


@register("platform_counts", f"WITH {CHUNKS} SELECT platform, count(*) AS n FROM c GROUP BY 1")
def platform_counts(spark, sf_dir):
    return turns.platform_counts(turns.chunks(adapters.messages(spark, sf_dir)))


#: Words that occur in the given texts, for topics.
WORDS = ["the", "of", "and", "that", "der", "und", "que", "les"]


def _topics_sql(text: str, words: list[str] | tuple[str, ...]) -> str:
    found = [f"regexp_extract_all({text}, '(?i)\\b({p})\\b', 1)" for p in (P.LANGUAGES, "|".join(words))]
    return f"list_transform(list_concat({found[0]}, {found[1]}), lambda x: lower(x))"


def _first_seen(name: str) -> str:
    """Distinct entries of a list in order, at most ten."""
    return f"list_filter({name}, lambda x, i: list_position({name}, x) = i)[1:10]"


@register("topics", f"WITH a AS (SELECT doc_id, {_topics_sql('text', WORDS)} AS f FROM documents) SELECT doc_id, array_to_string({_first_seen('f')}, ',') AS topics FROM a")
def topics(spark, sf_dir):
    d = adapters.read(spark, sf_dir, "documents")
    return d.select("doc_id", F.array_join(T.topics(F.col("text"), WORDS), ",").alias("topics"))


@register("topic_members", f"WITH a AS (SELECT doc_id, {_topics_sql('text', WORDS)} AS f FROM documents) SELECT doc_id FROM a WHERE list_contains({_first_seen('f')}, 'que')")
def topic_members(spark, sf_dir):
    d = adapters.read(spark, sf_dir, "documents")
    return search.having(d.select("doc_id", T.topics(F.col("text"), WORDS).alias("topics")), "topics", "que").select("doc_id")


@register("question_members", f"WITH {M} SELECT message_id FROM m WHERE list_contains(list_transform(string_split(content, ' '), lambda x: lower(x)), 'the')")
def question_members(spark, sf_dir):
    m = adapters.messages(spark, sf_dir).withColumn("hypothetical_questions", F.transform(F.split("content", " "), F.lower))
    return search.having(m, "hypothetical_questions", "the").select("message_id")


@register("topic_histogram", f"WITH a AS (SELECT {_topics_sql('text', WORDS)} AS f FROM documents), b AS (SELECT unnest({_first_seen('f')}) AS topic FROM a) SELECT topic, count(*) AS n FROM b GROUP BY 1")
def topic_histogram(spark, sf_dir):
    d = adapters.read(spark, sf_dir, "documents")
    return turns.topic_counts(d.select(T.topics(F.col("text"), WORDS).alias("topics")))


@register("default_topics", f"WITH a AS (SELECT message_id, {_topics_sql('content', P.TECH_TERMS)} AS f FROM (WITH {M} SELECT * FROM m)) SELECT message_id, array_to_string({_first_seen('f')}, ',') AS topics FROM a")
def default_topics(spark, sf_dir):
    return adapters.messages(spark, sf_dir).select("message_id", F.array_join(T.topics(F.col("content")), ",").alias("topics"))


@register(
    "recent_topics",
    f"""WITH {M}, r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY timestamp DESC, seq DESC) AS back FROM m),
a AS (SELECT conversation_id, flatten(list({_topics_sql("content", P.RECENT_TERMS)} ORDER BY timestamp, seq)) AS f FROM r WHERE back <= 20 GROUP BY 1)
SELECT conversation_id, array_to_string({_first_seen("f")}, ',') AS topics FROM a""",
)
def recent_topics(spark, sf_dir):
    t = turns.recent_topics(adapters.messages(spark, sf_dir))
    return t.select("conversation_id", F.array_join("topics", ",").alias("topics"))


@register("query_gate", f"WITH {M} SELECT message_id, ({' + '.join(f'regexp_matches(content, {quote(chr(40) + "?i)" + chr(92) + "b(" + p + ")" + chr(92) + "b")})::INT' for p in P.SPECIFIC)}) >= 2 AS specific FROM m")
def query_gate(spark, sf_dir):
    return adapters.messages(spark, sf_dir).select("message_id", T.is_specific(F.col("content")).alias("specific"))


# -- noise and captures ------------------------------------------------------------------------------------------------


def _any_sql(text: str, patterns: list[str]) -> str:
    return f"regexp_matches({text}, {quote('|'.join(f'(?:{p})' for p in patterns))})"


NOISE_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_any_sql('content', p)} THEN {quote(n)} END" for n, p in P.NOISE.items()) + "], lambda x: x IS NOT NULL)"
CONTENTS = "u AS (SELECT 'page' AS kind, page_id AS id, html AS content FROM pages UNION ALL SELECT 'document', doc_id, text FROM documents)"
N = f"{CONTENTS}, n AS (SELECT *, CASE WHEN coalesce(content, '') = '' THEN [] ELSE {NOISE_SQL} END AS categories FROM u)"


def contents(spark, sf_dir) -> DataFrame:
    p = adapters.read(spark, sf_dir, "pages").select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("content"))
    return p.unionByName(adapters.read(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("content")))


@register("noise_scan", f"WITH {N} SELECT kind, id, array_to_string(categories, ',') AS categories FROM n WHERE len(categories) > 0")
def noise_scan(spark, sf_dir):
    c = hygiene.classify(contents(spark, sf_dir)).filter(F.size("categories") > 0)
    return c.select("kind", "id", F.array_join("categories", ",").alias("categories"))


@register(
    "noise_report",
    f"""WITH {N}, x AS (SELECT unnest(list_concat(['all', CASE WHEN len(categories) > 0 THEN 'noise' ELSE 'clean' END], categories)) AS category FROM n)
SELECT category, count(*) AS n, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM n), 1) AS percent FROM x GROUP BY 1""",
)
def noise_report(spark, sf_dir):
    return hygiene.noise_report(contents(spark, sf_dir))


@register("noise_delete", f"WITH {N} SELECT kind, id FROM n WHERE len(categories) = 0")
def noise_delete(spark, sf_dir):
    return hygiene.without_noise(contents(spark, sf_dir)).select("kind", "id")


_t = "trim(coalesce(content, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(65279))"
_reject = f"""CASE WHEN length(t) < 50 THEN 'too_short' WHEN {_any_sql("t", P.CSS_LIKE)} THEN 'css' WHEN {_any_sql("t", P.CODE_LIKE)} THEN 'code'
  WHEN length(t) < 300 AND regexp_matches(t, {quote("|".join(P.UI_PHRASES))}) THEN 'ui' WHEN {_any_sql("t", P.IGNORED)} THEN 'ignored'
  WHEN length(t) > 10000 THEN 'too_long' WHEN length(t) < 100 THEN 'not_substantial' END"""


@register("capture_filter", f"WITH {CONTENTS}, k AS (SELECT kind, id, {_t} AS t FROM u) SELECT kind, id, {_reject} AS reject_reason FROM k")
def capture_filter(spark, sf_dir):
    return hygiene.capture_filter(contents(spark, sf_dir)).select("kind", "id", "reject_reason")


@register(
    "dedup_window",
    """WITH RECURSIVE e AS (SELECT event_id, event_type, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT *, t AS kept_at, true AS kept FROM e WHERE k = 1 UNION ALL
  SELECT e.*, CASE WHEN e.t - r.kept_at > 3600000000 THEN e.t ELSE r.kept_at END, e.t - r.kept_at > 3600000000
  FROM r JOIN e ON e.event_type IS NOT DISTINCT FROM r.event_type AND e.user_id IS NOT DISTINCT FROM r.user_id AND e.k = r.k + 1)
SELECT event_id, event_type, user_id FROM r WHERE kept""",
)
def dedup_window(spark, sf_dir):
    e = adapters.read(spark, sf_dir, "events")
    return hygiene.first_of_window(e, ["event_type", "user_id"], "ts", 3600, "event_id").select("event_id", "event_type", "user_id")


# -- synchronisation -----------------------------------------------------------------------------------------------------

STORED = "s AS (SELECT * FROM m WHERE seq % 2 = 0)"


@register("unsynced", f"WITH {M}, {STORED} SELECT message_id FROM m WHERE message_id NOT IN (SELECT message_id FROM s)")
def unsynced(spark, sf_dir):
    m = adapters.messages(spark, sf_dir)
    return sync.unsynced(m, m.filter("seq % 2 = 0")).select("message_id")


def _versions(spark, sf_dir):
    m = adapters.messages(spark, sf_dir).select("message_id", "content", "timestamp")
    changed = m.withColumn("content", F.concat(F.lit("edited "), "content")).withColumn("timestamp", F.col("timestamp") + F.when(F.length("content") % 2 == 0, 5).otherwise(-5))
    return m, changed


_upsert = f"""WITH {M}, a AS (SELECT message_id, content, timestamp, 0 AS fresh FROM m UNION ALL
SELECT message_id, 'edited ' || content, timestamp + CASE WHEN mod(length(content) + 7, 2) = 0 THEN 5 ELSE -5 END, 1 FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY message_id ORDER BY timestamp {{way}}, fresh {{way}}) AS k FROM a) SELECT message_id, content, timestamp FROM r WHERE k = 1"""


@register("upsert_last", _upsert.replace("{way}", "DESC"))
def upsert_last(spark, sf_dir):
    return sync.upsert(*_versions(spark, sf_dir), "message_id", "timestamp")


@register("upsert_first", _upsert.replace("{way}", "ASC"))
def upsert_first(spark, sf_dir):
    return sync.upsert(*_versions(spark, sf_dir), "message_id", "timestamp", last_wins=False)


@register("backfill", f"WITH {M} SELECT message_id, coalesce(nullif(platform, 'cli'), 'chatgpt') AS source FROM m")
def backfill(spark, sf_dir):
    m = adapters.messages(spark, sf_dir).select("message_id", F.nullif(F.col("platform"), F.lit("cli")).alias("source"))
    return sync.backfill_source(m)


@register("message_rows", f"WITH {M} SELECT message_id, coalesce(nullif(role, ''), 'user') AS role, nullif(conversation_id, '') AS conversation_id, timestamp, platform AS source FROM m")
def message_rows(spark, sf_dir):
    return sync.to_messages(adapters.messages(spark, sf_dir)).select("message_id", "role", "conversation_id", "timestamp", "source")


@register("source_counts", f"WITH {V} SELECT source, count(*) AS n FROM v GROUP BY 1")
def source_counts(spark, sf_dir):
    return stats.counts(adapters.vectors(spark, sf_dir), "source")


# -- audits ----------------------------------------------------------------------------------------------------------------


@register(
    "dq_messages",
    f"""WITH {M}, f AS (SELECT count(*) AS checked, [count(*) FILTER (NOT coalesce(content <> '', false)), count(*) FILTER (coalesce(timestamp, 0) = 0), count(*) FILTER (NOT coalesce(role <> '', false)),
  count(*) FILTER (NOT coalesce(role IN ('user', 'assistant', 'system'), false)), count(*) FILTER (trim(coalesce(content, '')) = '')] AS n FROM m),
r AS (SELECT checked, unnest(['content_present', 'timestamp_present', 'role_present', 'role_allowed', 'content_not_blank']) AS rule, unnest(n) AS failed FROM f)
SELECT rule, checked, failed, failed = 0 AS passed FROM r""",
)
def dq_messages(spark, sf_dir):
    return audits.check(adapters.messages(spark, sf_dir), audits.message_rules())


@register("dq_order", f"WITH {M}, a AS (SELECT message_id, timestamp + CASE WHEN length(content) % 7 = 0 THEN 5000 ELSE 0 END AS timestamp, conversation_id, seq FROM m), p AS (SELECT *, lag(timestamp) OVER (PARTITION BY conversation_id ORDER BY seq) AS previous FROM a) SELECT message_id, timestamp, previous FROM p WHERE timestamp < previous")
def dq_order(spark, sf_dir):
    m = adapters.messages(spark, sf_dir).withColumn("timestamp", F.col("timestamp") + F.when(F.length("content") % 7 == 0, 5000).otherwise(0))
    return audits.out_of_order(m).select("message_id", "timestamp", "previous")


@register("dq_conversations", f"WITH {M} SELECT round(count(*) FILTER (coalesce(conversation_id, '') NOT IN ('', 'unknown'))::DOUBLE / count(*), 6) AS share, count(*) FILTER (coalesce(conversation_id, '') NOT IN ('', 'unknown')) * 10 >= count(*) * 8 AS passed FROM m")
def dq_conversations(spark, sf_dir):
    return audits.known_conversations(adapters.messages(spark, sf_dir))


@register("dq_lengths", f"WITH {M} SELECT round(avg(length(content)), 6) AS avg_length, min(length(content))::INT AS min_length, max(length(content))::INT AS max_length, avg(length(content)) >= 10 AS passed FROM m")
def dq_lengths(spark, sf_dir):
    return audits.content_lengths(adapters.messages(spark, sf_dir))


@register("dq_duplicates", "SELECT text AS content, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dq_duplicates(spark, sf_dir):
    return audits.duplicates(adapters.read(spark, sf_dir, "documents").select(F.col("text").alias("content")), "content")


@register("dq_embeddings", f"WITH {V} SELECT count(*) AS total, count(e) AS present, count(*) FILTER (len(e) = 64) AS right_size, round(count(*) FILTER (len(e) = 64) * 100.0::DOUBLE / count(*), 1) AS percent FROM v")
def dq_embeddings(spark, sf_dir):
    return audits.embedding_coverage(adapters.vectors(spark, sf_dir), 64)


@register("dq_sources", f"WITH {V} SELECT message_id, source FROM v WHERE source NOT IN ('chatgpt', 'cli')")
def dq_sources(spark, sf_dir):
    return adapters.vectors(spark, sf_dir).filter(~F.col("source").isin("chatgpt", "cli")).select("message_id", "source")


# -- enrichment ---------------------------------------------------------------------------------------------------------------


@register("token_estimate", "SELECT doc_id, ceil(coalesce(length(text), 0) / 4.0)::BIGINT AS tokens, length(left(text, 16000))::INT AS kept_chars FROM documents")
def token_estimate(spark, sf_dir):
    d = adapters.read(spark, sf_dir, "documents")
    return d.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), F.length(T.truncate_tokens(F.col("text"), 4000)).alias("kept_chars"))


TOKEN_BATCHES = """WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, ceil(coalesce(length(text), 0) / 4.0)::BIGINT AS tokens, row_number() OVER (ORDER BY doc_id) AS k FROM documents),
r AS (SELECT doc_id, tokens, k, 0 AS batch, CASE WHEN tokens > 4000 THEN NULL ELSE tokens END AS total FROM d WHERE k = 1 UNION ALL
  SELECT d.doc_id, d.tokens, d.k, CASE WHEN d.tokens > 4000 OR r.total IS NULL OR r.total + d.tokens > 4000 THEN r.batch + 1 ELSE r.batch END,
    CASE WHEN d.tokens > 4000 THEN NULL WHEN r.total IS NULL OR r.total + d.tokens > 4000 THEN d.tokens ELSE r.total + d.tokens END FROM r JOIN d ON d.k = r.k + 1)
SELECT doc_id, batch::BIGINT AS batch, tokens FROM r"""


@register("token_batches", TOKEN_BATCHES)
def token_batches(spark, sf_dir):
    return enrich.token_batches(adapters.read(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "batch", "tokens")


@register("batch_totals", f"SELECT batch, count(*) AS n, sum(tokens)::BIGINT AS tokens FROM ({TOKEN_BATCHES}) GROUP BY ALL")
def batch_totals(spark, sf_dir):
    return token_batches(spark, sf_dir).groupBy("batch").agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))


@register(
    "question_prompts",
    f"""WITH {CHUNKS} SELECT conversation_id, chunk_idx, 'Write 3 questions to which the conversation below would be a good answer.' || chr(10) || chr(10) || 'Conversation:' || chr(10) ||
  CASE WHEN length(content) > 500 THEN left(content, 500) || '...' ELSE content END || chr(10) || chr(10) ||
  'Ask for the problem, for its remedy, for messages that were shown and for the ideas behind it, each in the words of' || chr(10) || 'somebody who searches. Between five and fifteen words each, one a line, numbered from 1 to 3.' AS prompt FROM c""",
)
def question_prompts(spark, sf_dir):
    c = turns.chunks(adapters.messages(spark, sf_dir))
    return c.select("conversation_id", "chunk_idx", T.question_prompt(F.col("content"), F.array().cast("array<string>"), 3).alias("prompt"))


@register(
    "parse_questions",
    f"""WITH {M}, a AS (SELECT message_id, list_filter(list_transform(list_filter(string_split(content, chr(10)), lambda x: trim(x) <> ''),
  lambda x: regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(x, '^\\d+\\.\\s*', ''), '^[-*•]\\s*', '')), '^["'']', ''), '["'']\\z', '')), lambda x: length(x) > 0 AND length(x) < 200)[1:3] AS q FROM m)
SELECT message_id, array_to_string(q, '|') AS questions FROM a""",
)
def parse_questions(spark, sf_dir):
    return adapters.messages(spark, sf_dir).select("message_id", F.array_join(T.parse_questions(F.col("content"), 3), "|").alias("questions"))


# -- context blocks -------------------------------------------------------------------------------------------------------------


def _hits(spark, sf_dir) -> DataFrame:
    v = adapters.vectors(spark, sf_dir)
    best = search.nearest_batch(v, v.filter("vec_id % 20 = 0"), 3, 0.95)
    rows = v.select("vec_id", "source", "timestamp", F.concat(F.lit("message "), "message_id").alias("content"))
    return best.join(rows, "vec_id")


_date = "strftime(make_timestamp(timestamp * 1000), '%-m/%-d/%Y')"


@register(
    "context_block",
    f"""WITH {V}, q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0),
r AS (SELECT query_id, v.*, 1 - list_cosine_similarity(e, qe) AS distance FROM q JOIN v ON vec_id <> query_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM r WHERE distance < 0.95)
SELECT query_id, count(*)::INT AS items, '[Memory Context - ' || count(*) || CASE WHEN count(*) > 1 THEN ' relevant items]' ELSE ' relevant item]' END || chr(10) || chr(10) ||
  string_agg(rank || '. ' || CASE WHEN source = 'cli' THEN '📝 Terminal' ELSE '💬 Previous conversation' END || ' (' || {_date} || ')' || chr(10) || '   "message ' || message_id || '"' || chr(10) || chr(10), '' ORDER BY rank)
  || '[End of Memory Context]' || chr(10) || chr(10) AS block FROM k WHERE rank <= 3 GROUP BY 1""",
)
def context_block(spark, sf_dir):
    return context.context_blocks(_hits(spark, sf_dir))


def _bodies(spark, sf_dir) -> DataFrame:
    """A request body per conversation, from its messages; every third in the form with parts, every third with text."""
    m = adapters.messages(spark, sf_dir)
    one = F.to_json(F.struct(F.struct(F.col("role")).alias("author"), F.struct(F.array("content").alias("parts")).alias("content")))
    two = F.to_json(F.struct("role", "content"))
    row = F.struct("timestamp", "seq", F.when(F.col("conversation_id").cast("long") % 2 == 0, one).otherwise(two).alias("j"))
    g = m.groupBy("conversation_id").agg(F.sort_array(F.collect_list(row)).alias("x"))
    text = F.concat(F.lit('{"conversation_id":"'), "conversation_id", F.lit('","model":"m1","messages":['), F.array_join(F.transform("x", lambda r: r["j"]), ","), F.lit("]}"))
    return g.select("conversation_id", F.lit("https://chatgpt.com/backend-api/conversation").alias("url"), F.lit("POST").alias("method"), text.alias("body"))


LAST = f"WITH {M}, l AS (SELECT conversation_id, arg_max(role, seq) AS role, arg_max(content, seq) AS content FROM m GROUP BY 1)"


@register("chatgpt_requests", f"{LAST} SELECT conversation_id, role, content, 'm1' AS model, 'chatgpt' AS platform FROM l")
def chatgpt_requests(spark, sf_dir):
    b = _bodies(spark, sf_dir).withColumnRenamed("conversation_id", "own")
    return capture.chatgpt_messages(capture.chatgpt_calls(b)).select("conversation_id", "role", "content", "model", "platform")


ODD = f"WITH {M}, l AS (SELECT conversation_id, conversation_id::BIGINT % 6 AS shape, arg_max(content, seq) AS content FROM m GROUP BY 1)"


def _odd_bodies(spark, sf_dir) -> DataFrame:
    """Bodies whose last message has an image, a number, several parts, no text at all, or repeated members."""
    m = adapters.messages(spark, sf_dir).groupBy("conversation_id").agg(F.max_by("content", "seq").alias("text"))
    j = F.to_json(F.array("text"))
    said = F.substring(j, F.lit(2), F.length(j) - 2)  # as a JSON string
    shapes = ['{"parts":[{"img":1},%s]}', '{"parts":[5,%s]}', "123", '{"parts":[%s,"more"]}', '%s,"content":{"parts":[%s,{"img":1}]}', '{"parts":[]}']
    built = F.element_at(F.array(*[F.concat(*[x for k, part in enumerate(t.split("%s")) for x in ([said] if k else []) + [F.lit(part)]]) for t in shapes]), (F.col("conversation_id").cast("long") % 6 + 1).cast("int"))
    return m.select("conversation_id", F.concat(F.lit('{"conversation_id":"'), "conversation_id", F.lit('","messages":[{"role":"user","content":'), built, F.lit("}]}")).alias("body"))


@register("odd_requests", f"{ODD} SELECT conversation_id, content FROM l WHERE shape IN (3, 4)")
def odd_requests(spark, sf_dir):
    b = _odd_bodies(spark, sf_dir).withColumnRenamed("conversation_id", "own")
    return capture.chatgpt_messages(b).select("conversation_id", "content")


@register("inject_odd", f"{ODD} SELECT conversation_id, shape = 3 AS changed, CASE WHEN shape = 3 THEN 'CTX ' || content END AS first_part FROM l")
def inject_odd(spark, sf_dir):
    """Only a first part that is a text gets a block; bodies with repeated members are left alone."""
    b = _odd_bodies(spark, sf_dir).withColumn("new", context.inject(F.col("body"), F.lit("CTX ")))
    changed = F.col("new") != F.col("body")
    return b.select("conversation_id", changed.alias("changed"), F.when(changed, F.get_json_object("new", "$.messages[0].content.parts[0]")).alias("first_part"))


@register("claude_requests", f"{LAST} SELECT conversation_id, 'user' AS role, content, 'claude-3-opus' AS model, 'claude' AS platform FROM l")
def claude_requests(spark, sf_dir):
    m = adapters.messages(spark, sf_dir).groupBy("conversation_id").agg(F.max_by("content", "seq").alias("prompt"))
    raw = m.select(F.concat(F.lit("https://claude.ai/api/organizations/o/chat_conversations/"), "conversation_id", F.lit("/completion")).alias("url"), F.lit("POST").alias("method"), F.to_json(F.struct("prompt")).alias("body"))
    return capture.claude_messages(capture.claude_calls(raw)).select("conversation_id", "role", "content", "model", "platform")


@register("inject_prepend", f"{LAST} SELECT conversation_id, 'CTX ' || content AS content FROM l")
def inject_prepend(spark, sf_dir):
    b = _bodies(spark, sf_dir).withColumn("body", context.inject(F.col("body"), F.lit("CTX "))).withColumnRenamed("conversation_id", "own")
    return capture.chatgpt_messages(b).select("conversation_id", "content")


@register("inject_system", f"WITH {M} SELECT conversation_id, (count(*) + 1)::INT AS n_messages, 'CTX' AS inserted FROM m GROUP BY 1")
def inject_system(spark, sf_dir):
    b = _bodies(spark, sf_dir).withColumn("body", context.inject(F.col("body"), F.lit("CTX"), "system"))
    j = F.from_json("body", "struct<messages:array<struct<author:struct<role:string>,content:string>>>")["messages"]
    return b.select("conversation_id", F.size(j).alias("n_messages"), F.from_json(F.element_at(j, -2)["content"], "struct<parts:array<string>>")["parts"][0].alias("inserted"))


@register("inject_prompt", f"{LAST} SELECT conversation_id, 'CTX' || chr(10) || chr(10) || '---' || chr(10) || chr(10) || content AS prompt FROM l")
def inject_prompt(spark, sf_dir):
    m = adapters.messages(spark, sf_dir).groupBy("conversation_id").agg(F.max_by("content", "seq").alias("prompt"))
    b = m.select("conversation_id", context.inject(F.to_json(F.struct("prompt")), F.lit("CTX"), "prompt").alias("body"))
    return b.select("conversation_id", F.get_json_object("body", "$.prompt").alias("prompt"))


def _lines(spark, sf_dir) -> DataFrame:
    """Streamed answers: every message is a response, a line per word, in one of three shapes of events."""
    m = adapters.messages(spark, sf_dir).filter("role = 'assistant'")
    w = m.select("message_id", "seq", F.posexplode(F.split("content", "(?<= )")).alias("k", "w"))
    shape = F.when(F.col("seq") % 3 == 0, F.to_json(F.struct(F.col("w").alias("delta"), F.col("message_id").alias("id")))).when(F.col("seq") % 3 == 1, F.to_json(F.struct(F.struct(F.struct(F.array(F.col("w")).alias("parts")).alias("content")).alias("message"), F.col("message_id"))))
    patch = F.to_json(F.struct(F.array(F.struct(F.lit("/message/content/parts/0").alias("p"), F.lit("append").alias("o"), F.col("w").alias("v"))).alias("v"), F.col("message_id").alias("conversation_id")))
    lines = w.select(F.col("message_id").alias("response_id"), F.col("k").cast("long").alias("seq"), F.concat(F.lit("data: "), F.coalesce(shape, patch)).alias("line"))
    end = m.select(F.col("message_id").alias("response_id"), F.lit(1_000_000_000).cast("long").alias("seq"), F.lit("data: [DONE]").alias("line"))
    return lines.unionByName(end)


@register("sse_assemble", f"WITH {M} SELECT message_id, regexp_replace(content, '^\\s+|\\s+\\z', '', 'g') AS content, 'assistant' AS role FROM m WHERE role = 'assistant'")
def sse_assemble(spark, sf_dir):
    return capture.assemble_responses(_lines(spark, sf_dir)).select("message_id", "content", "role")


@register("sse_from_chunks", f"WITH {M} SELECT message_id, regexp_replace(content, '^\\s+|\\s+\\z', '', 'g') AS content FROM m WHERE role = 'assistant'")
def sse_from_chunks(spark, sf_dir):
    """The same answers, cut every 37 bytes as a network might."""
    lines = _lines(spark, sf_dir).groupBy("response_id").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("x"))
    data = F.encode(F.concat(F.array_join(F.transform("x", lambda r: r["line"]), "\n"), F.lit("\n")), "UTF-8")
    cut = lines.select("response_id", data.alias("d")).select("response_id", "d", F.explode(F.sequence(F.lit(0), F.floor(F.octet_length("d") / 37).cast("int"))).alias("seq"))
    chunks = cut.select("response_id", F.col("seq").cast("long").alias("seq"), F.substring("d", F.col("seq") * 37 + 1, F.lit(37)).alias("data"))
    return capture.assemble_responses(capture.lines_of_chunks(chunks)).select("message_id", "content")


# -- statistics and health ----------------------------------------------------------------------------------------------------------


@register("health_windows", "SELECT time_bucket(INTERVAL 5 MINUTE, ts::TIMESTAMP) AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, round(count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*), 1) AS error_rate FROM events GROUP BY 1")
def health_windows(spark, sf_dir):
    return stats.health_windows(adapters.read(spark, sf_dir, "events"))


@register("silence_gaps", "WITH g AS (SELECT ts, user_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events) SELECT user_id, before, ts, round((epoch_us(ts) - epoch_us(before)) / 1e6, 3) AS seconds FROM g WHERE epoch_us(ts) - epoch_us(before) > 86400000000")
def silence_gaps(spark, sf_dir):
    return stats.silences(adapters.read(spark, sf_dir, "events"), 1440, "user_id").select("user_id", "before", "ts", "seconds")


@register("capture_health", "SELECT count(*) AS events, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS succeeded, round(count(*) FILTER (event_type = 'error') * 100.0::DOUBLE / count(*), 1) AS error_rate, round(count(*) FILTER (event_type = 'purchase') * 100.0::DOUBLE / count(*), 1) AS success_rate FROM events")
def capture_health(spark, sf_dir):
    return stats.capture_health(adapters.read(spark, sf_dir, "events"), success="purchase")


@register("error_retention", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100")
def error_retention(spark, sf_dir):
    e = adapters.read(spark, sf_dir, "events").filter("event_type = 'error'").select("event_id", "ts")
    return hygiene.keep_last(e, 100, "ts")


@register(
    "store_size",
    f"""WITH {M}, j AS (SELECT length(to_json({{message_id: message_id, conversation_id: conversation_id, role: role, content: content, timestamp: timestamp, platform: platform, seq: seq}})) AS n FROM m),
s AS (SELECT count(*) AS rows, (sum(n) + count(*) + 1)::BIGINT AS size FROM j) SELECT rows, size, round(size / 1024.0::DOUBLE, 2) AS kb, round(size * 100.0::DOUBLE / 10485760, 2) AS percent FROM s""",
)
def store_size(spark, sf_dir):
    return stats.store_size(adapters.messages(spark, sf_dir))


@register("store_statistics", f"WITH {M} SELECT count(*) AS rows, (SELECT count(*) FROM events WHERE event_type = 'error') AS errors, max(timestamp) AS last_save, 1800000000000 - max(timestamp) AS ms_since_save FROM m")
def store_statistics(spark, sf_dir):
    m = adapters.messages(spark, sf_dir).withColumn("captured_at", F.col("timestamp"))
    errors = adapters.read(spark, sf_dir, "events").filter("event_type = 'error'")
    return stats.store_statistics(m, errors, 1_800_000_000_000).select("rows", "errors", "last_save", "ms_since_save")


@register("sync_status", f"WITH {M} SELECT count(*) AS total_messages, max(timestamp) AS last_sync_time FROM m")
def sync_status(spark, sf_dir):
    return stats.sync_status(adapters.messages(spark, sf_dir), "timestamp")


@register("source_summary", f"WITH {V} SELECT count(*) AS rows, count(DISTINCT source) AS sources, count(DISTINCT source) > 1 AS several, count(source) AS known FROM v")
def source_summary(spark, sf_dir):
    return stats.source_summary(adapters.vectors(spark, sf_dir))


@register("ids_missing", f"WITH {M}, k AS (SELECT CASE WHEN seq % 3 = 0 THEN '' WHEN seq % 5 = 0 THEN NULL ELSE message_id END AS message_id FROM m) SELECT count(*) AS rows, count(*) FILTER (coalesce(message_id, '') = '') AS without_id FROM k")
def ids_missing(spark, sf_dir):
    m = adapters.messages(spark, sf_dir).withColumn("message_id", F.when(F.col("seq") % 3 == 0, "").when(F.col("seq") % 5 == 0, None).otherwise(F.col("message_id")))
    return sync.without_ids(m)


# -- from prompts to bodies --------------------------------------------------------------------------------------------------------


def letters(df: DataFrame) -> DataFrame:
    """An embedding that SQL can compute too: how often each letter of a to z occurs in the content."""
    n = lambda c: (F.length("content") - F.length(F.replace(F.col("content"), F.char(c), F.lit("")))).cast("double")
    return df.withColumn("embedding", F.transform(F.sequence(F.lit(97), F.lit(122)), n))


E = "list_transform(range(97, 123), lambda c: (length(content) - length(replace(content, chr(c::INT), '')))::DOUBLE)"
PROMPTS = f"""{M}, s AS (SELECT *, conversation_id::BIGINT * 1000 + seq AS vec_id, {E} AS e FROM m),
p AS (SELECT vec_id AS query_id, content AS query, e AS qe FROM s WHERE role = 'user' AND conversation_id::BIGINT % 5 = 0),
h AS (SELECT query_id, query, s.*, round(1 - list_cosine_similarity(e, qe), 12) AS distance FROM p JOIN s ON list_sum(e) > 0 AND list_sum(qe) > 0)"""
AS_OF = adapters.EPOCH + 60 * 86_400_000


def _store(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Messages as a store, and every fifth conversation's user messages as prompts."""
    m = adapters.messages(spark, sf_dir)
    store = letters(m.withColumn("vec_id", F.col("conversation_id").cast("long") * 1000 + F.col("seq")).withColumn("source", F.col("platform")))
    some = m.filter((F.col("role") == "user") & (F.col("conversation_id").cast("long") % 5 == 0))
    prompts = some.select((F.col("conversation_id").cast("long") * 1000 + F.col("seq")).alias("query_id"), F.col("content").alias("query"), "conversation_id")
    return store, prompts


@register(
    "search_messages",
    f"""WITH {PROMPTS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM h WHERE distance < 0.5),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS rank FROM k WHERE place <= 10 AND role = 'assistant' AND platform = 'claude')
SELECT query_id, rank, message_id, round(distance, 6) AS distance FROM r""",
)
def search_messages(spark, sf_dir):
    store, prompts = _store(spark, sf_dir)
    hits = readpath.search_messages(readpath.asked(prompts, letters), store, 10, 0.5, "assistant", "claude")
    return rounded(hits.join(store.select("vec_id", "message_id"), "vec_id"), "query_id", "rank", "message_id")


@register(
    "bodies_with_context",
    f"""WITH {PROMPTS}, k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS place FROM h WHERE distance < 0.5 AND timestamp < {AS_OF} - 120000),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place) AS rank FROM k WHERE place <= 3 AND distance >= 0.001),
b AS (SELECT query_id, count(*)::INT AS items, '[Memory Context - ' || count(*) || CASE WHEN count(*) > 1 THEN ' relevant items]' ELSE ' relevant item]' END || chr(10) || chr(10) ||
  string_agg(rank || '. ' || CASE WHEN platform = 'cli' THEN '📝 Terminal' ELSE '💬 Previous conversation' END || ' (' || {_date} || ')' || chr(10) || '   "' || content || '"' || chr(10) || chr(10), '' ORDER BY rank)
  || '[End of Memory Context]' || chr(10) || chr(10) AS block FROM x GROUP BY 1)
SELECT p.query_id, coalesce(items, 0) AS items, coalesce(block, '') || query AS sent FROM p LEFT JOIN b ON p.query_id = b.query_id""",
)
def bodies_with_context(spark, sf_dir):
    """Prompts as request bodies, each with the block of its nearest messages before its text."""
    store, prompts = _store(spark, sf_dir)
    blocks = readpath.contexts(readpath.asked(prompts, letters), store, AS_OF, 3, 0.5, 0.001)
    message = F.struct(F.lit("user").alias("role"), F.col("query").alias("content"))
    bodies = prompts.select("query_id", F.to_json(F.struct(F.array(message).alias("messages"))).alias("body"))
    got = readpath.with_context(bodies, blocks)
    return got.select("query_id", "items", F.get_json_object("new_body", "$.messages[0].content").alias("sent"))


@register(
    "free_tier",
    f"""WITH {CHUNKS} SELECT sha256('u1' || chr(1) || conversation_id || chr(1) || turn_range) AS id, turn_range, conversation_id, platform, content, turn_count, start_timestamp, end_timestamp
FROM c WHERE platform = 'chatgpt' AND conversation_id::BIGINT % 2 = 1""",
)
def free_tier(spark, sf_dir):
    c = turns.chunks(adapters.messages(spark, sf_dir)).withColumn("user_id", F.concat(F.lit("u"), F.col("conversation_id").cast("long") % 2))
    c = letters(c.withColumn("id", T.message_key(F.col("user_id"), F.col("conversation_id"), F.col("turn_range")))).withColumn("created_at", F.timestamp_millis("end_timestamp"))
    return sync.free_tier(c, "u1").drop("speakers", "topics", "hypothetical_questions", "embedding", "created_at")


@register(
    "substring_matches",
    f"WITH {M}, q AS (SELECT message_id AS query_id, substr(content, 4, 9) AS q FROM m WHERE seq = 1) SELECT query_id, message_id FROM q JOIN m ON length(q) >= 3 AND contains(lower(content), lower(q))",
)
def substring_matches(spark, sf_dir):
    """Nine characters of each second message, sought in all messages by their rarest piece."""
    m = adapters.messages(spark, sf_dir)
    q = m.filter("seq = 1").select(F.col("message_id").alias("query_id"), F.substring("content", 4, 9).alias("q"))
    return substrings.matches(m, q)


# -- what captures, chunks and audits need beside ------------------------------------------------------------------------------


@register("url_platforms", f"WITH {M}, u AS (SELECT message_id, CASE seq % 4 WHEN 0 THEN 'https://chatgpt.com/c/' WHEN 1 THEN 'https://chat.openai.com/c/' WHEN 2 THEN 'https://claude.ai/chat/' ELSE 'https://example.org/' END || conversation_id AS url FROM m) SELECT message_id, CASE WHEN contains(url, 'chatgpt.com') OR contains(url, 'chat.openai.com') THEN 'chatgpt' WHEN contains(url, 'claude.ai') THEN 'claude' END AS platform FROM u")
def url_platforms(spark, sf_dir):
    hosts = F.element_at(F.array(*[F.lit(f"https://{h}/") for h in ("chatgpt.com/c", "chat.openai.com/c", "claude.ai/chat", "example.org")]), (F.col("seq") % 4 + 1).cast("int"))
    return adapters.messages(spark, sf_dir).select("message_id", capture.platform_of(F.concat(hosts, "conversation_id")).alias("platform"))


@register("claude_sse", f"WITH {M} SELECT message_id, regexp_replace(content, '^\\s+|\\s+\\z', '', 'g') AS content, 'claude' AS platform FROM m WHERE role = 'assistant'")
def claude_sse(spark, sf_dir):
    """Answers as the other platform streams them: a start event with the id, a delta a word, and other events."""
    m = adapters.messages(spark, sf_dir).filter("role = 'assistant'")
    start = m.select(F.col("message_id").alias("response_id"), F.lit(-1).cast("long").alias("seq"), F.to_json(F.struct(F.lit("message_start").alias("type"), F.struct(F.col("message_id").alias("id")).alias("message"))).alias("j"))
    w = m.select("message_id", F.posexplode(F.split("content", "(?<= )")).alias("k", "w"))
    delta = F.to_json(F.struct(F.when(F.col("k") % 50 == 49, "ping").otherwise("content_block_delta").alias("type"), F.struct(F.col("w").alias("text")).alias("delta")))
    # a ping carries no text: the word comes again behind it
    again = w.filter("k % 50 = 49").select(F.col("message_id").alias("response_id"), (F.col("k") * 2 + 1).cast("long").alias("seq"), F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.col("w").alias("text")).alias("delta"))).alias("j"))
    words = w.select(F.col("message_id").alias("response_id"), (F.col("k") * 2).cast("long").alias("seq"), delta.alias("j"))
    lines = start.unionByName(words).unionByName(again).select("response_id", "seq", F.concat(F.lit("data: "), "j").alias("line"))
    return capture.assemble_responses(lines, "claude").select("message_id", "content", "platform")


@register(
    "cli_notes",
    """WITH n AS (SELECT doc_id, trim(left(coalesce(text, ''), doc_id % 5), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS d, CASE WHEN doc_id % 3 = 0 THEN '' ELSE trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) END AS b FROM documents),
t AS (SELECT doc_id, CASE WHEN d <> '' AND b <> '' THEN d || chr(10) || chr(10) || b ELSE d || b END AS t FROM n) SELECT doc_id AS timestamp, left(t, 8000) AS content, 'user' AS role, 'cli' AS model FROM t WHERE length(t) >= 3""",
)
def cli_notes(spark, sf_dir):
    d = adapters.read(spark, sf_dir, "documents")
    short = F.when(F.col("doc_id") % 5 > 0, F.substr(F.col("text"), F.lit(1), (F.col("doc_id") % 5).cast("int")))
    notes = d.select(short.alias("description"), F.when(F.col("doc_id") % 3 > 0, F.col("text")).alias("body"), F.col("doc_id").alias("timestamp"))
    return capture.cli_notes(notes).select("timestamp", "content", "role", "model")


@register("point_reads", f"WITH {V} SELECT message_id, list_sum(e) AS total FROM v WHERE vec_id % 7 = 3")
def point_reads(spark, sf_dir):
    v = adapters.vectors(spark, sf_dir).withColumn("content", F.lit("x"))
    got = capture.by_ids(v, v.filter("vec_id % 7 = 3").select("message_id"))
    return got.select("message_id", F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x).alias("total"))


@register("platform_distribution", f"WITH {M} SELECT CASE WHEN seq % 3 = 1 OR platform = '' THEN 'unknown' ELSE platform END AS platform, count(*) AS n FROM m GROUP BY 1")
def platform_distribution(spark, sf_dir):
    m = adapters.messages(spark, sf_dir).withColumn("platform", F.when(F.col("seq") % 3 == 1, None).otherwise(F.col("platform")))
    return stats.counts(m, "platform", "unknown")


QUESTIONS = f"""{M}, q AS (SELECT message_id, content, CASE WHEN seq % 3 = 0 THEN [] ELSE list_transform(string_split(left(content, 200), '. ')[1:4], lambda x: trim(x)) END AS q FROM m)"""


def _questions(spark, sf_dir) -> DataFrame:
    """Messages as chunks, whose first sentences stand for questions."""
    m = adapters.messages(spark, sf_dir)
    first = F.transform(F.slice(F.split(F.substring("content", 1, 200), r"\. "), 1, 4), lambda x: F.trim(x))
    return m.withColumn("hypothetical_questions", F.when(F.col("seq") % 3 == 0, F.array().cast("array<string>")).otherwise(first)).withColumn("topics", F.array(F.lit("The"), F.lit("que")))


@register("question_totals", f"WITH {QUESTIONS} SELECT count(*) AS processed, sum(len(q))::BIGINT AS questions, count(*) FILTER (len(q) = 0) AS failed FROM q")
def question_totals(spark, sf_dir):
    return enrich.question_totals(_questions(spark, sf_dir))


@register(
    "dq_questions",
    f"""WITH {QUESTIONS}, s AS (SELECT message_id, q, len(list_filter(q, lambda x: contains(lower(x), 'the') OR contains(lower(x), 'que'))) / nullif(len(q), 0)::DOUBLE AS topic_share,
  len(list_distinct(list_transform(q, lambda x: lower(string_split(x, ' ')[1])))) / nullif(len(q), 0)::DOUBLE AS variety, len(list_filter(q, lambda x: len(string_split_regex(trim(x), '\\s+')) NOT BETWEEN 3 AND 30)) = 0 AS lengths_ok FROM q)
SELECT message_id, round(topic_share, 6) AS topic_share, round(variety, 6) AS variety, coalesce(topic_share >= 0.5 AND variety >= 0.6 AND lengths_ok, false) AS passed FROM s""",
)
def dq_questions(spark, sf_dir):
    got = audits.question_quality(_questions(spark, sf_dir))
    return got.select("message_id", F.round("topic_share", 6).alias("topic_share"), F.round("variety", 6).alias("variety"), "passed")


@register(
    "dq_rewrites",
    f"WITH {M} SELECT message_id, contains(lower(content), 'the') AND len(list_filter(string_split_regex(lower(content), '[^0-9A-Za-z_]+'), lambda w: w IN ('that', 'thing', 'um', 'like'))) = 0 AS passed FROM m",
)
def dq_rewrites(spark, sf_dir):
    return adapters.messages(spark, sf_dir).select("message_id", audits.rewrite_quality(F.col("content"), F.array(F.lit("The"))).alias("passed"))


@register("dq_ranking", f"""WITH {V}, q AS (SELECT vec_id AS query_id, e AS qe FROM v WHERE vec_id % 20 = 0), r AS (SELECT query_id, vec_id, round(1 - list_cosine_similarity(e, qe), 6) AS distance FROM q JOIN v ON vec_id <> query_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY vec_id) AS rank FROM r WHERE vec_id % 25 = 1), p AS (SELECT *, lag(distance) OVER (PARTITION BY query_id ORDER BY rank) AS previous FROM k)
SELECT query_id, rank::INT AS rank, distance, previous FROM p WHERE distance < previous""")
def dq_ranking(spark, sf_dir):
    """Hits that are ranked by id, not by distance: which of them are out of order."""
    v = adapters.vectors(spark, sf_dir)
    hits = search.nearest_batch(v.filter("vec_id % 25 = 1"), _set(v), 1_000_000)
    order = Window.partitionBy("query_id").orderBy("vec_id")
    hits = hits.withColumn("rank", F.row_number().over(order)).withColumn("distance", F.round("distance", 6))
    return audits.not_ascending(hits).select("query_id", "rank", "distance", "previous")


@register(
    "dq_chunks",
    f"""WITH {CHUNKS}, f AS (SELECT count(*) AS n, [count(*) FILTER (NOT turn_count > 0), count(*) FILTER (NOT end_timestamp >= start_timestamp), count(*) FILTER (platform NOT IN ('chatgpt', 'claude', 'cli')), count(*) FILTER (content = ''), 0,
  count(*) FILTER (NOT regexp_matches(turn_range, '^\\d+-\\d+$'))] AS x FROM c), r AS (SELECT n, unnest(['turn_count_positive', 'times_in_order', 'platform_allowed', 'content_present', 'speakers_allowed', 'turn_range_form']) AS rule, unnest(x) AS failed FROM f)
SELECT rule, n AS checked, failed, failed = 0 AS passed FROM r UNION ALL SELECT 'embedding_size', 0, 0, false""",
)
def dq_chunks(spark, sf_dir):
    found = audits.check(turns.chunks(adapters.messages(spark, sf_dir)), audits.chunk_rules())
    return audits.against_contract([*audits.chunk_rules(), "embedding_size"], found)


@register("dq_embedding_texts", f"WITH {V} SELECT count(*) AS total, count(*) FILTER (vec_id % 9 <> 0 AND vec_id % 9 <> 1) AS present, count(*) FILTER (vec_id % 9 > 2 AND len(e) = 64) AS right_size, round(count(*) FILTER (vec_id % 9 > 2 AND len(e) = 64) * 100.0::DOUBLE / count(*), 1) AS percent FROM v")
def dq_embedding_texts(spark, sf_dir):
    """Vectors that arrive as text, of which some are no vectors or have another length."""
    v = adapters.vectors(spark, sf_dir)
    k, text = F.col("vec_id") % 9, F.to_json("embedding")
    return audits.embedding_coverage(v.select(F.when(k == 0, "[1, oops").when(k == 1, "[1, null]").when(k == 2, "[1, 2.5]").otherwise(text).alias("embedding")), 64)


@register(
    "rewrite_prompts",
    f"""WITH {M} SELECT message_id, 'Make a precise search of this question:' || chr(10) || '"' || content || '"' || chr(10) || chr(10) || CASE WHEN seq % 2 = 0 THEN 'Lately discussed: rls, api' || chr(10) || chr(10) ELSE '' END ||
  CASE WHEN seq % 3 = 0 THEN 'Background: ' || platform || chr(10) || chr(10) ELSE '' END || 'Keep what the user is after, name the technical terms that the topics suggest, and leave out words that' || chr(10) ||
  'carry no meaning. Answer with at most ten search words and nothing besides them.' AS prompt FROM m""",
)
def rewrite_prompts(spark, sf_dir):
    topics = F.when(F.col("seq") % 2 == 0, F.array(F.lit("rls"), F.lit("api"))).otherwise(F.array().cast("array<string>"))
    m = adapters.messages(spark, sf_dir)
    return m.select("message_id", T.rewrite_prompt(F.col("content"), topics, F.when(F.col("seq") % 3 == 0, F.col("platform"))).alias("prompt"))


@register(
    "inferred_roles",
    f"""WITH {M}, r AS (SELECT message_id, CASE WHEN seq % 5 = 0 THEN 'The ' || role || ' turn' END AS aria, CASE WHEN seq % 3 = 0 THEN role END AS author, CASE WHEN seq % 2 = 0 THEN 'You said: ' ELSE 'ChatGPT said: ' END || content AS t FROM m)
SELECT message_id, CASE WHEN contains(lower(aria), 'user') THEN 'user' WHEN contains(lower(aria), 'assistant') THEN 'assistant' WHEN author <> '' THEN CASE WHEN author = 'user' THEN 'user' ELSE 'assistant' END
  WHEN starts_with(t, 'You said:') THEN 'user' ELSE 'assistant' END AS role FROM r""",
)
def inferred_roles(spark, sf_dir):
    m = adapters.messages(spark, sf_dir)
    t = F.concat(F.when(F.col("seq") % 2 == 0, "You said: ").otherwise("ChatGPT said: "), "content")
    return m.select("message_id", T.infer_role(t, F.when(F.col("seq") % 5 == 0, F.concat(F.lit("The "), "role", F.lit(" turn"))), F.when(F.col("seq") % 3 == 0, F.col("role"))).alias("role"))


@register("message_previews", f"WITH {M} SELECT message_id, replace(left(content, 150), chr(10), ' ') AS preview FROM m")
def message_previews(spark, sf_dir):
    return adapters.messages(spark, sf_dir).select("message_id", T.preview(F.col("content"), 150).alias("preview"))


@register(
    "first_captures",
    """WITH RECURSIVE k AS (SELECT doc_id, left(text, 100) AS key, doc_id * 700 AS t FROM documents), e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, doc_id) AS n FROM k),
r AS (SELECT *, t AS kept_at, true AS kept FROM e WHERE n = 1 UNION ALL SELECT e.*, CASE WHEN e.t - r.kept_at > 60000 THEN e.t ELSE r.kept_at END, e.t - r.kept_at > 60000 FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1) SELECT doc_id FROM r WHERE kept""",
)
def first_captures(spark, sf_dir):
    """Documents captured 0.7 seconds apart, without repeats within a minute."""
    d = adapters.read(spark, sf_dir, "documents").select("doc_id", "text", (F.col("doc_id") * 700).alias("ts"))
    return hygiene.first_captures(d, 60, "text", "ts", "doc_id").select("doc_id")


@register("elements_filter", "SELECT doc_id, CASE WHEN doc_id % 4 = 1 THEN 'no_message' WHEN doc_id % 6 = 2 THEN 'in_code' ELSE 'other' END AS reason FROM documents")
def elements_filter(spark, sf_dir):
    """Reasons for which the element that a text is from decides."""
    d = adapters.read(spark, sf_dir, "documents").withColumn("m", F.when(F.col("doc_id") % 8 > 3, F.col("doc_id") % 4 != 1).otherwise(F.when(F.col("doc_id") % 4 == 1, False))).withColumn("c", F.col("doc_id") % 6 == 2)
    got = hygiene.capture_filter(d, "text", "m", "c")
    return got.select("doc_id", F.when(F.col("reject_reason").isin("no_message", "in_code"), F.col("reject_reason")).otherwise("other").alias("reason"))


def _stored(spark, sf_dir) -> DataFrame:
    v = adapters.vectors(spark, sf_dir)
    at = F.timestamp_millis("timestamp")
    return v.select("vec_id", F.concat(F.lit("i"), "message_id").alias("id"), F.concat(F.lit("text "), "message_id").alias("content"), "role", (F.col("vec_id") % 4).cast("string").alias("conversation_id"), F.lit("m1").alias("model"), "timestamp", "message_id", "source", at.alias("created_at"), at.alias("synced_at"), "embedding")


@register(
    "message_hits",
    f"WITH {D} SELECT 'i' || message_id AS id, 'text ' || message_id AS content, role, (vec_id % 4)::VARCHAR AS conversation_id, 'm1' AS model, timestamp AS msg_timestamp, message_id, source, epoch_us(make_timestamp(timestamp * 1000)) AS created_us, round(distance, 6) AS distance FROM d WHERE distance < 0.9 ORDER BY d.distance, message_id LIMIT 8",
)
def message_hits(spark, sf_dir):
    """All columns of a hit; times as numbers."""
    s = _stored(spark, sf_dir)
    hits = search.projected(search.nearest(s, _query(s), 8, 0.9), search.MESSAGE_HIT)
    return rounded(hits.withColumn("created_us", F.unix_micros("created_at")), "id", "content", "role", "conversation_id", "model", "msg_timestamp", "message_id", "source", "created_us")


@register("conversation_hits", f"WITH {D}, k AS (SELECT * FROM d WHERE distance < 0.9 ORDER BY distance, message_id LIMIT 30) SELECT 'i' || message_id AS id, 'text ' || message_id AS content, timestamp AS msg_timestamp, source, round(distance, 6) AS distance FROM k WHERE vec_id % 4 = 1")
def conversation_hits(spark, sf_dir):
    s = _stored(spark, sf_dir)
    hits = search.in_conversation(search.nearest(s, _query(s), 30, 0.9), "1")
    return rounded(search.projected(hits, search.RECENT_HIT), "id", "content", "msg_timestamp", "source")


@register("synced_ids", f"WITH {M} SELECT message_id, timestamp AS synced_at FROM m WHERE seq % 2 = 0 UNION ALL SELECT message_id, 5 FROM m WHERE seq < 3")
def synced_ids(spark, sf_dir):
    m = adapters.messages(spark, sf_dir)
    return sync.synced_ids(m.filter("seq % 2 = 0").withColumn("synced_at", F.col("timestamp")), m.filter("seq < 3"), 5)


@register("question_updates", f"WITH {M}, u AS (SELECT CASE seq % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'x' || message_id ELSE message_id END AS id FROM m) SELECT count(*) FILTER (id IN (SELECT message_id FROM m)) AS updated, count(*) FILTER (id LIKE 'x%') AS unknown, count(*) FILTER (coalesce(id, '') = '') AS without_id FROM u")
def question_updates(spark, sf_dir):
    m = adapters.messages(spark, sf_dir)
    k = F.col("seq") % 4
    u = m.select(F.when(k == 0, None).when(k == 1, "").when(k == 2, F.concat(F.lit("x"), "message_id")).otherwise(F.col("message_id")).alias("id"))
    return sync.update_counts(m.withColumnRenamed("message_id", "id"), u)
