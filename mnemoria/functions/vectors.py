"""Vector arithmetic in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """1 - cosine; null if a vector is null or zero, so that filters drop it."""
    return F.lit(1.0) - F.try_divide(dot(a, b), (norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm))


def parse(embedding: Column) -> Column:
    """A vector that arrives as JSON text; null where it is none, or a component is no number."""
    v = F.from_json(embedding, "array<double>")
    return F.when(~F.exists(v, lambda x: x.isNull()), v)
