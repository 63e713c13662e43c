"""Quality rules with robust multivariate outlier rejection, in DataFrame functions only.

Each text is described by counts (words, their characters, symbols, repeated lines, words in repeated 3-word windows).
Base rules come first. Texts that pass them are compared with their own language and source: a minimum covariance
determinant estimate of centre and scatter, found by concentration steps from a median/MAD start, gives Mahalanobis
distances of the transformed statistics; texts beyond `cutoff` are rejected.

Null and empty texts have zero counts and fail the base rule. Null languages and sources are groups of their own.
Repeated rows count as often as they occur; equal rows get equal verdicts. Empty tables give empty results. Columns
other than those named are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

SPLIT = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
#: The components of the transformed statistic vector and the least standard deviation that each is given, below which
#: a difference is of no interest.
FLOORS = {"x0": 0.10, "x1": 0.25, "x2": 0.15, "x3": 0.15}
#: Bins a unit for medians, and a unit of the logarithm for distances.
BINS = 200


def counts(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, lang, source) -> doc_id, lang, source and the five counts.

    Repeated 3-word windows are found by sorting one long per window, 40 bits of its hash above 24 bits of its place;
    neighbours that agree are compared again as strings, so hash collisions don't count. Texts of over 2^24 words
    compare strings at once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select("doc_id", "lang", "source", text.alias("text"))
    d = d.withColumn("w", F.filter(F.split("text", SPLIT), lambda x: x != "")).withColumn("n", F.size("w"))
    d = d.withColumn("lines", F.when(F.instr("text", "\n") > 0, F.filter(F.split("text", "\n"), lambda x: x.rlike(HAS_WORD))))
    n_dup = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines") - F.size(F.array_distinct("lines")))
    d = d.select(
        "doc_id", "lang", "source", "w", "n",
        F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
        F.length(F.regexp_replace("text", r"[^#*$%&|<>]", "")).cast("long").alias("n_symbols"),
        n_dup.cast("long").alias("n_dup_lines"),
    )
    three = lambda w, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    w, n = F.col("w"), F.col("n")
    places = F.sequence(F.lit(0), n - 3)
    d = d.withColumn("keys", F.when((n >= 3) & (n < 1 << 24), F.sort_array(F.transform(places, lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 24).bitwiseOR(i.cast("long"))))))
    k = F.col("keys")
    same = lambda a, b: F.shiftright(a, 24) == F.shiftright(b, 24)
    near = F.filter(k, lambda x, j: F.coalesce(same(x, F.get(k, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(k, j + 1)), F.lit(False)))
    d = d.withColumn("near", F.when(n >= 1 << 24, places).when(k.isNotNull(), F.transform(near, lambda x: x.bitwiseAND(F.lit((1 << 24) - 1)).cast("int"))))
    d = d.withColumn("sure", F.when(F.size("near") > 0, F.sort_array(F.transform("near", lambda i: F.struct(three(w, i).alias("t"), i.alias("i"))))))
    s = F.col("sure")
    twice = F.filter(s, lambda x, j: F.coalesce(x["t"] == F.get(s, j - 1)["t"], F.lit(False)) | F.coalesce(x["t"] == F.get(s, j + 1)["t"], F.lit(False)))
    d = d.withColumn("repeats", F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
    return d.select(
        "doc_id", "lang", "source", n.cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines",
        F.coalesce(F.when(s.isNull(), 0).otherwise(F.size("repeats")), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def vector(c: DataFrame) -> DataFrame:
    """Transformed statistics: variance-stabilised, and pulled to their common value for short texts."""
    n = F.col("n_words") + 20.0
    return (
        c.withColumn("x0", F.log((F.col("word_chars") + 100.0) / n))
        .withColumn("x1", F.log1p(100.0 * F.col("n_symbols") / n))
        .withColumn("x2", F.asin(F.sqrt(F.least(F.lit(1.0), F.col("n_repeat_words") / n))))
        .withColumn("x3", F.log1p(100.0 * F.col("n_dup_lines") / n))
    )


KEYS = ["lang", "source"]


def _match(rows: DataFrame, per: DataFrame, on: list[str], broadcast_rows: int = 50_000) -> DataFrame:
    """Left join with one row per group; broadcast only while there are few groups."""
    per = per.select(*[F.col(k).alias(f"_{k}") for k in on], *[c for c in per.columns if c not in on])
    cond = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(per[f"_{k}"]) for k in on])
    return rows.join(F.broadcast(per) if per.count() <= broadcast_rows else per, cond, "left").drop(*[f"_{k}" for k in on])


def _quantile(bins: DataFrame, by: list[str], q: float, bin_col: str, out: Column) -> DataFrame:
    """The bin in which the share q of each group's rows is reached, from (by, bin, n)."""
    w = Window.partitionBy(*by).orderBy(bin_col)
    whole = Window.partitionBy(*by)
    reached = bins.withColumn("_c", F.sum("n").over(w)).withColumn("_t", F.sum("n").over(whole)).filter(F.col("_c") >= F.col("_t") * q)
    return reached.groupBy(*by).agg(F.min(bin_col).alias(bin_col)).select(*by, out.alias("v"))


def _whiten(fit: DataFrame) -> DataFrame:
    """m_i and, from the scatter s_ij = L L', the entries v_ij of L's inverse: one small row per group."""
    p = range(len(FLOORS))
    for i in p:
        for j in range(i + 1):
            rest = F.col(f"s{i}{j}") - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            fit = fit.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l{j}{j}"))
    fit = cut(fit)
    for j in p:
        fit = fit.withColumn(f"v{j}{j}", 1.0 / F.col(f"l{j}{j}"))
        for i in range(j + 1, len(FLOORS)):
            fit = fit.withColumn(f"v{i}{j}", -sum((F.col(f"l{i}{k}") * F.col(f"v{k}{j}") for k in range(j, i)), F.lit(0.0)) / F.col(f"l{i}{i}"))
    return cut(fit.select(*KEYS, *[f"m{i}" for i in p], *[f"v{i}{j}" for i in p for j in range(i + 1)]))


def _distance(rows: DataFrame, fit: DataFrame, keep: list[str]) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance |L^-1 (x - m)|^2."""
    d = _match(rows, _whiten(fit), KEYS)
    off = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(FLOORS)]
    y = [sum((F.col(f"v{i}{j}") * off[j] for j in range(i + 1)), F.lit(0.0)) for i in range(len(off))]
    return d.select(*keep, sum((F.pow(v, 2) for v in y), F.lit(0.0)).alias("d2"))


def _moments(rows: DataFrame, keep_share: float) -> DataFrame:
    """Means and covariances per group, with the consistency factor of the kept share and the floors added."""
    xs, floor = list(FLOORS), list(FLOORS.values())
    # for a share of 3/4 of 4-dimensional normal vectors, chi2 quantile 5.385: 0.75 / P(chi2_6 <= 5.385)
    factor = {0.75: 0.75 / 0.5045}.get(keep_share, 1.0)
    aggs = [F.avg(x).alias(f"m{i}") for i, x in enumerate(xs)]
    aggs += [F.coalesce(F.covar_pop(x, xs[j]) * factor, F.lit(0.0)).alias(f"s{i}{j}") for i, x in enumerate(xs) for j in range(i + 1)]
    got = rows.groupBy(*KEYS).agg(*aggs)
    for i, f in enumerate(floor):
        got = got.withColumn(f"s{i}{i}", F.col(f"s{i}{i}") + F.lit(f * f))
    return got


def fit_mcd(rows: DataFrame, keep_share: float = 0.75, steps: int = 3) -> DataFrame:
    """rows(lang, source, x0..x3) -> per group m_i and s_ij of the concentrated three quarters.

    Medians and distance limits come from counts of narrow bins, which are summed before any shuffle."""
    xs = list(FLOORS)

    def medians(r: DataFrame) -> DataFrame:
        long = r.select(*KEYS, F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(x).alias("x")) for i, x in enumerate(xs)])).alias("e"))
        bins = long.groupBy(*KEYS, F.col("e.i").alias("i"), F.floor(F.col("e.x") * BINS).alias("b")).agg(F.count("*").alias("n"))
        got = _quantile(bins, [*KEYS, "i"], 0.5, "b", (F.col("b") + 0.5) / BINS)
        return got.groupBy(*KEYS).agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias(f"m{i}") for i in range(len(xs))])

    centre = cut(medians(rows))
    away = _match(rows, centre, KEYS).select(*KEYS, *[F.abs(F.col(x) - F.col(f"m{i}")).alias(x) for i, x in enumerate(xs)])
    spread = cut(medians(away).select(*KEYS, *[F.col(f"m{i}").alias(f"a{i}") for i in range(len(xs))]))
    fit = _match(centre, spread, KEYS)
    for i in range(len(xs)):
        for j in range(i + 1):
            fit = fit.withColumn(f"s{i}{j}", F.pow(F.col(f"a{i}") * 1.4826, 2) + F.lit(FLOORS[xs[i]] ** 2) if i == j else F.lit(0.0))
    fit = cut(fit.drop(*[f"a{i}" for i in range(len(xs))]))
    for _ in range(steps):
        far = _distance(rows, fit, [*KEYS, *xs]).withColumn("b", F.floor(F.log(F.col("d2") + 1e-6) * BINS))
        bins = far.groupBy(*KEYS, "b").agg(F.count("*").alias("n"))
        limit = _quantile(bins, KEYS, keep_share, "b", F.col("b"))
        fit = cut(_moments(_match(far, cut(limit), KEYS).filter(F.col("b") <= F.col("v")), keep_share))
    return fit


def judge(docs: DataFrame, min_words: int = 50, cutoff: float = 80.0) -> DataFrame:
    """docs(doc_id, text, lang, source) -> doc_id, the counts, base_failed, distance (null if base_failed), kept.

    cutoff: the largest squared distance that is kept. It is far above the 0.999 point of chi-square with four degrees
    (18.5), as the statistics of clean texts have longer tails than normal ones."""
    c = counts(docs)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    c = cut(vector(c).withColumn("base_failed", failed))
    fit = fit_mcd(c.filter(~F.col("base_failed")))
    keep = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    d = _distance(c, fit, keep).withColumn("distance", F.when(~F.col("base_failed"), F.sqrt("d2")))
    return d.select(*keep, "distance", (~F.col("base_failed") & F.coalesce(F.col("d2") <= cutoff, F.lit(True))).alias("kept"))
