"""Raw request bodies, streamed answers and command-line notes as messages of one schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import message_key, or_else, trim

#: Platform by a part of the URL; the first that matches counts.
URL_PARTS = [("chatgpt.com", "chatgpt"), ("chat.openai.com", "chatgpt"), ("claude.ai", "claude")]


def platform_of(url: Column) -> Column:
    c = None
    for part, name in URL_PARTS:
        c = F.when(url.contains(part), name) if c is None else c.when(url.contains(part), name)
    return c


def _posted(method: Column, body: Column) -> Column:
    return F.coalesce(F.upper(method) == "POST", F.lit(False)) | (F.coalesce(body, F.lit("")) != "")


def chatgpt_calls(raw: DataFrame) -> DataFrame:
    """raw(url, method, body): calls that send a message."""
    path = F.col("url").contains("/backend-api/conversation") | F.col("url").contains("/backend-api/f/conversation")
    return raw.filter(path & _posted(F.col("method"), F.col("body")))


def claude_calls(raw: DataFrame, strict: bool = True) -> DataFrame:
    path = F.col("url").contains("/chat_conversations/") & F.col("url").contains("/completion")
    return raw.filter(path & F.col("url").contains("claude.ai/api/") & _posted(F.col("method"), F.col("body")) if strict else path)


def _kind(json: Column) -> Column:
    """The type of a variant: STRING, BIGINT, OBJECT<...> and so on; null for none."""
    return F.when(json.isNotNull(), F.schema_of_variant(json))


def _text(json: Column) -> Column:
    """A variant that is a JSON string."""
    return F.when(_kind(json) == "STRING", F.try_variant_get(json, "$", "string"))


def chatgpt_messages(raw: DataFrame, body: str = "body") -> DataFrame:
    """The last message of each body: its first part, or its content, where that is a text; nothing where it is an image, a
    number or another value, where there is no message, or the body is no JSON. Of a member that is repeated the last
    counts."""
    b = F.from_json(F.col(body), "struct<conversation_id:string,model:string,messages:array<string>>")
    last = F.try_element_at(b["messages"], F.lit(-1))
    m = F.from_json(last, "struct<author:struct<role:string>,role:string>")
    # the content by its own text, as a body with a repeated member is no variant
    json = F.try_parse_json(F.from_json(F.concat(F.lit('{"m":'), last, F.lit("}")), "struct<m:struct<content:string>>")["m"]["content"])
    typed = F.try_parse_json(last)
    content = F.when(typed.isNotNull(), F.try_variant_get(typed, "$.content", "variant")).otherwise(json)
    parts = F.try_variant_get(content, "$.parts", "array<variant>")
    text = trim(F.when(parts.isNotNull(), _text(F.get(parts, F.lit(0)))).otherwise(_text(content)))
    rows = raw.select(
        "*", text.alias("content"), or_else(m["author"]["role"], or_else(m["role"], F.lit("user"))).alias("role"), or_else(b["conversation_id"], F.lit("unknown")).alias("conversation_id"),
        or_else(b["model"], F.lit("unknown")).alias("model"), F.lit("chatgpt").alias("platform"),
    )
    return rows.filter(F.coalesce("content", F.lit("")) != "")


def claude_messages(raw: DataFrame, body: str = "body", shipped: bool = False) -> DataFrame:
    """The prompt of each body. shipped: no trimming, the id only from the URL, and another default model."""
    b = F.from_json(F.col(body), "struct<prompt:string,model:string,uuid:string,conversation_uuid:string>")
    from_url = F.nullif(F.regexp_extract("url", r"chat_conversations/([^/]+)/completion", 1), F.lit(""))
    if shipped:
        text, conv, model = b["prompt"], from_url, or_else(b["model"], F.lit("claude-unknown"))
    else:
        text, model = trim(b["prompt"]), or_else(b["model"], F.lit("claude-3-opus"))
        conv = F.coalesce(from_url, or_else(b["uuid"], or_else(b["conversation_uuid"], F.lit("unknown"))))
    rows = raw.select("*", text.alias("content"), F.lit("user").alias("role"), conv.alias("conversation_id"), model.alias("model"), F.lit("claude").alias("platform"))
    return rows.filter(F.coalesce("content", F.lit("")) != "")



def _full(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


#: Members of an event that are looked at: one parse of a line has them all.
EVENT = "struct<" + ",".join(f"{m}:variant" for m in ("choices", "message", "content", "delta", "text", "v", "o", "id", "message_id", "conversation_id", "type")) + ">"


def chatgpt_event_text(e: Column) -> Column:
    """The text that an event (EVENT) adds: the first of the known shapes that the event has."""
    get = lambda member, path="$": F.try_variant_get(e[member], path, "string")
    patches = F.try_variant_get(e["v"], "$", "array<struct<p:string,o:string,v:string>>")
    appended = F.filter(patches, lambda p: (p["p"] == "/message/content/parts/0") & (p["o"] == "append") & p["v"].isNotNull())
    return F.coalesce(
        _full(get("choices", "$[0].delta.content")),
        _full(get("message", "$.content.parts[0]")),
        _text(e["content"]),
        _text(e["delta"]),
        _text(e["text"]),
        F.when(F.size(patches) > 0, F.array_join(F.transform(appended, lambda p: p["v"]), "")),
        F.when(F.coalesce(get("o"), F.lit("")) != "", _full(_text(e["v"]))),
        _full(get("v", "$.message.content.parts[0]")),
        _full(_text(F.try_variant_get(e["v"], "$.content", "variant"))),
        _full(_text(F.try_variant_get(e["v"], "$.text", "variant"))),
    )


def claude_event_text(e: Column) -> Column:
    return F.when(F.try_variant_get(e["type"], "$", "string") == "content_block_delta", F.try_variant_get(e["delta"], "$.text", "string"))


def events(lines: DataFrame, platform: str = "chatgpt") -> DataFrame:
    """lines(response_id, seq, line, ...) -> + text, event_id of each data line that is a JSON object with a known member."""
    data = F.when(F.col("line").startswith("data: "), F.trim(F.substring(F.col("line"), F.lit(7), F.length("line"))))
    rows = lines.withColumn("_d", data).filter((F.coalesce("_d", F.lit("")) != "") & ~F.col("_d").isin("[DONE]", '""'))
    rows = rows.withColumn("_j", F.from_json("_d", EVENT))
    get = lambda member, path="$": _full(F.try_variant_get(F.col("_j")[member], path, "string"))
    if platform == "claude":
        rows = rows.withColumn("text", claude_event_text(F.col("_j"))).withColumn("event_id", get("message", "$.id"))
    else:
        rows = rows.withColumn("text", chatgpt_event_text(F.col("_j"))).withColumn("event_id", F.coalesce(get("id"), get("message_id"), get("conversation_id")))
    return rows.drop("_d", "_j")


def assemble_responses(lines: DataFrame, platform: str = "chatgpt") -> DataFrame:
    """lines(response_id, seq, line) -> one assistant message per response with text: the events' texts in order, and
    the first id that an event carries (else one made from the response)."""
    e = events(lines, platform)
    g = e.groupBy("response_id").agg(F.sort_array(F.collect_list(F.when(F.col("text").isNotNull(), F.struct("seq", "text")))).alias("x"), F.min_by("event_id", F.when(F.col("event_id").isNotNull(), F.col("seq"))).alias("event_id"))
    text = trim(F.array_join(F.transform("x", lambda t: t["text"]), ""))
    rows = g.select("response_id", F.coalesce("event_id", message_key(F.lit(platform), F.col("response_id"))).alias("message_id"), text.alias("content"), F.lit("assistant").alias("role"), F.lit(platform).alias("platform"))
    return rows.filter("content <> ''")


def cli_notes(notes: DataFrame, most: int = 8000) -> DataFrame:
    """notes(description, body, timestamp) -> messages; under 3 characters nothing, cut at `most`."""
    d, b = trim(F.coalesce("description", F.lit(""))), trim(F.coalesce("body", F.lit("")))
    text = F.when((d != "") & (b != ""), F.concat(d, F.lit("\n\n"), b)).otherwise(F.concat(d, b))
    rows = notes.withColumn("_t", text).filter(F.length("_t") >= 3)
    content = F.substring("_t", 1, most)
    return rows.select(
        message_key(F.lit("cli"), F.col("timestamp"), content).alias("message_id"), content.alias("content"), F.lit("user").alias("role"), F.lit("cli").alias("model"), F.lit("cli").alias("platform"),
        F.lit(None).cast("string").alias("conversation_id"), "timestamp",
    )


def by_ids(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """Point reads in bulk: the embedding and content of the given ids."""
    return messages.join(ids.select("message_id"), "message_id").select("message_id", "embedding", "content")


def lines_of_chunks(chunks: DataFrame) -> DataFrame:
    """chunks(response_id, seq, data binary), as they came from the network -> response_id, seq (of the line), line. Lines
    and characters may be cut anywhere between chunks: a piece of a line belongs to the line whose number is that of the
    line ends before it, and pieces are joined before they are decoded. Null data is empty; a last line needs no end."""
    raw = F.decode(F.coalesce("data", F.lit(b"")), "ISO-8859-1")  # a character for each byte
    ends = F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit("")))
    before = Window.partitionBy("response_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    pieces = chunks.select("response_id", "seq", raw.alias("raw"), F.coalesce(F.sum(ends).over(before), F.lit(0)).alias("_before"))
    pieces = pieces.select("response_id", "seq", "_before", F.posexplode(F.split("raw", "\n")).alias("k", "piece"))
    g = pieces.groupBy("response_id", (F.col("_before") + F.col("k")).alias("line_no")).agg(F.sort_array(F.collect_list(F.struct("seq", "piece"))).alias("x"))
    line = F.decode(F.encode(F.array_join(F.transform("x", lambda p: p["piece"]), ""), "ISO-8859-1"), "UTF-8")
    return g.select("response_id", F.col("line_no").cast("long").alias("seq"), F.regexp_replace(line, "\r\\z", "").alias("line")).filter("line <> ''")
