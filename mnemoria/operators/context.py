"""Ranked hits as a context block per prompt, and its insertion in request bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import SOURCE_LABELS


def context_blocks(hits: DataFrame, least_distance: float = 0.0, debug: bool = False) -> DataFrame:
    """hits(query_id, rank, content, source, timestamp, distance) -> query_id, items, block. Hits nearer than
    least_distance are left out, numbers follow the ranks of the rest. Dates are UTC."""
    rows = hits.filter(F.col("distance") >= least_distance)
    g = rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "source", "timestamp", "content", "distance"))).alias("x"))
    label = lambda s: F.when(s == "cli", SOURCE_LABELS["cli"]).otherwise(SOURCE_LABELS[None])

    def item(x: Column, i: Column) -> Column:
        date = F.date_format(F.timestamp_millis(x["timestamp"]), "M/d/yyyy")
        lines = [(i + 1).cast("string"), F.lit(". "), label(x["source"]), F.lit(" ("), date, F.lit(')\n   "'), x["content"], F.lit('"\n')]
        if debug:
            lines += [F.lit("   [Distance: "), F.format_string("%.3f", x["distance"]), F.lit(", Source: "), x["source"], F.lit("]\n")]
        return F.concat(*lines, F.lit("\n"))

    n = F.size("x")
    head = F.concat(F.lit("[Memory Context - "), n.cast("string"), F.when(n > 1, " relevant items]\n\n").otherwise(" relevant item]\n\n"))
    return g.select("query_id", n.alias("items"), F.concat(head, F.array_join(F.transform("x", item), ""), F.lit("[End of Memory Context]\n\n")).alias("block"))


MEMBERS = "map<string,variant>"


def _set(members: Column, name: str, value: Column) -> Column:
    """An object's members (variants) with another value for one that it has."""
    return F.transform_values(members, lambda k, v: F.when(k == name, value.cast("variant")).otherwise(v))


def inject(body: Column, block: Column, mode: str = "prepend") -> Column:
    """The body (JSON text) with the block, and all its other members, those of the last message and of its content as they
    are (in order of their names); unchanged if there is no block or nothing to insert it in.

    prepend: before the last message's first part, which becomes its only one, or its text, where that is a text; system: as a system message
    before the last one; prompt: before the prompt."""
    v = F.try_parse_json(body)
    top = F.try_variant_get(v, "$", MEMBERS)
    if mode == "prompt":
        prompt = F.try_variant_get(v, "$.prompt", "string")
        new = F.when(F.coalesce(prompt, F.lit("")) != "", F.to_json(_set(top, "prompt", F.concat(block, F.lit("\n\n---\n\n"), prompt))))
        return F.when(block.isNull(), body).otherwise(F.coalesce(new, body))
    messages = F.try_variant_get(v, "$.messages", "array<variant>")
    last = F.try_element_at(messages, F.lit(-1))
    before = F.slice(messages, 1, F.greatest(F.size(messages) - 1, F.lit(0)))
    if mode == "system":
        content = F.struct(F.lit("text").alias("content_type"), F.array(block).alias("parts"))
        extra = F.parse_json(F.to_json(F.struct(F.struct(F.lit("system").alias("role")).alias("author"), content.alias("content"))))
        changed = F.concat(before, F.array(extra), F.array(last))
    else:
        message, content = F.try_variant_get(last, "$", MEMBERS), F.try_variant_get(last, "$.content", MEMBERS)
        parts = F.try_variant_get(content["parts"], "$", "array<variant>")
        part = F.get(parts, F.lit(0))
        first = F.when(F.schema_of_variant(F.coalesce(part, F.parse_json(F.lit("null")))) == "STRING", F.try_variant_get(part, "$", "string"))
        with_part = F.parse_json(F.to_json(_set(content, "parts", F.parse_json(F.to_json(F.array(F.concat(block, first)))))))
        of_parts = F.when(first.isNotNull(), F.parse_json(F.to_json(_set(message, "content", with_part))))
        text = F.when(content.isNull() & (F.schema_of_variant(message["content"]) == "STRING"), F.try_variant_get(last, "$.content", "string"))
        of_text = F.when(text.isNotNull(), F.parse_json(F.to_json(_set(message, "content", F.concat(block, text)))))
        changed = F.concat(before, F.array(F.coalesce(of_parts, of_text)))
        changed = F.when(of_parts.isNotNull() | of_text.isNotNull(), changed)
    new = F.when(changed.isNotNull(), F.to_json(_set(top, "messages", F.parse_json(F.to_json(changed)))))
    return F.when(block.isNull() | F.coalesce(F.size(messages) < 1, F.lit(True)), body).otherwise(F.coalesce(new, body))

