"""Chat formatting by multi-party perspective rotation.

For every participant of a conversation, the dialogue is rendered with that speaker as the assistant and all others as
named users; the mask marks the characters to learn from: the participant's own turns and their end marker. System turns
are context for all and have no perspective. Rendering is by turn: each row carries its piece of text and its place in
the whole, so a conversation of any length is spread over tasks; `assemble` joins the pieces of conversations that fit
in a row.

Neither texts nor names can forge a turn: markers in them are broken up, and a name's control characters become blanks.

Turns are ordered by turn, then role and text; repeated rows are repeated turns. A null turn comes first, a null text is
empty, a null role is the speaker `unknown`, and rows with a null conversation form one conversation. A conversation with
only system turns has no perspective and no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


OPEN, END = "<|im_start|>", "<|im_end|>\n"
#: Turn numbers per block: prefix sums are windows over blocks, then over the totals of a conversation's blocks.
BLOCK = 256


def rotate(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", system: str = "system") -> DataFrame:
    """turns -> conv, perspective, seq (0, 1, ...), role, name, rendered, mask (learn from it), start and end (characters
    in the dialogue), mask_start (where the learned part of a masked turn begins)."""
    plain = lambda c: F.regexp_replace(c, r"<\|(im_start|im_end)\|>", "<| $1 |>")
    t = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(speaker), F.lit("unknown")).alias("speaker"),
        plain(F.coalesce(F.col(text), F.lit(""))).alias("text"),
    )
    people = t.filter(F.col("speaker") != system).select("conv", F.col("speaker").alias("perspective")).distinct()
    # place within a block of turn numbers, then the number of turns in all blocks before
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(2**62))))
    inside = Window.partitionBy("conv", "block").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text")
    t = t.withColumn("k", F.row_number().over(inside) - 1)
    mine = t.join(people, t["conv"].eqNullSafe(people["conv"])).select(t["*"], "perspective")
    role = F.when(F.col("speaker") == system, "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    mine = mine.withColumn("role", role).withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
    head = F.concat(F.lit(OPEN), "role", F.coalesce(F.concat(F.lit(" name="), plain(F.regexp_replace("name", r"[\x00-\x1F\x7F\u0085\u2028\u2029]+", " "))), F.lit("")), F.lit("\n"))
    mine = mine.withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, "text", F.lit(END))).withColumn("n", F.length("rendered").cast("long"))
    upto = Window.partitionBy("conv", "block", "perspective").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    mine = mine.withColumn("upto", F.sum("n").over(upto))
    totals = mine.groupBy("conv", "perspective", "block").agg(F.sum("n").alias("chars"), F.count("*").alias("turns"))
    before = Window.partitionBy("conv", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"),
        F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"), F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"),
    )
    on = mine["conv"].eqNullSafe(totals["c"]) & (mine["perspective"] == totals["p"]) & (mine["block"] == totals["b"])
    end = F.col("chars_before") + F.col("upto")
    mask = F.col("role") == "assistant"
    return mine.join(totals, on).select(
        F.col("conv").alias(conv), "perspective", (F.col("turns_before") + F.col("k")).alias("seq"), "role", "name", "rendered", mask.alias("mask"),
        (end - F.col("n")).alias("start"), end.alias("end"), F.when(mask, end - F.col("n") + F.col("head")).alias("mask_start"),
    )


def assemble(rotated: DataFrame, conv: str = "conv_id") -> DataFrame:
    """rotated -> conv, perspective, text, spans (array of start, end of what to learn from). For conversations whose
    dialogue fits in a row."""
    g = rotated.groupBy(conv, "perspective").agg(F.sort_array(F.collect_list(F.struct("seq", "rendered", "mask_start", "end"))).alias("x"))
    spans = F.transform(F.filter("x", lambda t: t["mask_start"].isNotNull()), lambda t: F.struct(t["mask_start"].alias("start"), t["end"].alias("end")))
    return g.select(conv, "perspective", F.array_join(F.transform("x", lambda t: t["rendered"]), "").alias("text"), spans.alias("spans"))
