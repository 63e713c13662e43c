"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets a word budget. Whole epochs of a source come first; what is left of its budget is filled with a
weighted sample without replacement: each document draws an exponential key -ln(u) / weight, documents are taken in key
order while the prefix sum of their sizes stays nearest to the budget. u is a hash of the id, so reruns agree.

No source is sorted as a whole: keys are dealt to equal slices of their range, slices are summed, and only the order
within one slice of one source is a window. A source with a third of all rows has as many slices as any other.

Null texts count as empty (size 0, taken 0). Null sources form one source, last in the order. Repeated rows are separate
documents with equal keys, in order of size and text. An empty table gives an empty result. Columns other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, n_words

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size) -> + target. The budget is `share` of all sizes; no target exceeds `cap` times its source.

    Resharing the excess by weight ends where uncapped targets are in proportion to their weights (level * weight), so
    the level is found on the sources sorted by cap * size / weight, the order in which they reach their caps."""
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    rate = Window.orderBy("rate", F.col("source").isNull(), F.encode("source", "utf-8"))
    upto, after = rate.rowsBetween(Window.unboundedPreceding, -1), rate.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    return (
        sizes.withColumn("weight", w)
        .withColumn("most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("rate", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(whole) * F.lit(float(share)))
        .withColumn("level", (F.col("budget") - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / F.sum("weight").over(after))
        .withColumn("level", F.first(F.when(F.col("level") <= F.col("rate"), F.col("level")), ignorenulls=True).over(rate.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .select("source", "source_size", F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight"))).alias("target"))
    )


def mix(docs: DataFrame, quality: DataFrame | None = None, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0, seed: int = 17, slice_rows: int = 200) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, text_hash, size, source_size, target, times, taken.

    times: how often the mix takes the document (complete epochs, and one more if sampled); taken = times * size.
    quality(doc_id, weight double): positive weights of documents; 1 where absent, null or not positive.
    slice_rows: documents per slice of keys that are ordered together, on average."""
    sized = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("tie"))
    if quality is not None:
        best = quality.filter(F.col("weight") > 0).groupBy("doc_id").agg(F.max("weight").alias("weight"))
        sized = sized.join(best, "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    else:
        sized = sized.withColumn("weight", F.lit(1.0))
    u = (F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    sized = cut(sized.withColumn("key", -F.log(u) / F.col("weight")))
    rows = sized.count()
    slices = min(65536, max(256, rows // slice_rows))
    sized = sized.withColumn("slice", F.least(F.lit(slices - 1), F.floor((1 - F.exp(-F.col("key"))) * slices)).cast("int"))
    # one long per source and slice: all further sums are over these
    sums = cut(sized.groupBy("source", "slice").agg(F.sum("size").alias("sum")))
    want = targets(sums.groupBy("source").agg(F.sum("sum").alias("source_size")), weights, share, cap)
    want = want.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    want = cut(want.withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")))
    before = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("start", F.coalesce(F.sum("sum").over(before), F.lit(0)))
    starts = starts.join(F.broadcast(want) if want.count() < 10_000 else want, starts["source"].eqNullSafe(want["source"])).select(starts["source"].alias("s"), starts["slice"].alias("k"), "start", "source_size", "target", "epochs", "left")
    inside = Window.partitionBy("source", "slice").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    placed = sized.withColumn("upto", F.sum("size").over(inside))
    placed = placed.join(starts, placed["source"].eqNullSafe(starts["s"]) & (placed["slice"] == starts["k"]))
    middle = F.col("start") + F.col("upto") - F.col("size") / 2.0
    times = F.col("epochs") + (middle <= F.col("left")).cast("long")
    return placed.select("doc_id", F.col("tie").alias("text_hash"), "size", "source_size", F.col("target"), times.alias("times"), (F.col("size") * times).alias("taken"))
