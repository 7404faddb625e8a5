"""Vector scalars as Spark columns, accumulated in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.text import clamp


def dot(a: Column, b: Column) -> Column:
    parts = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Column, b: Column, metric: str = "cosine") -> Column:
    """Cosine and inner product as one minus similarity; l2 squared, as the index keeps it."""
    if metric == "cosine":
        return 1 - dot(a, b) / (norm(a) * norm(b))
    if metric == "ip":
        return 1 - dot(a, b)
    if metric == "l2":
        parts = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)
    raise ValueError(f"unknown distance: {metric}")


def relevance(d: Column, metric: str = "cosine") -> Column:
    """A distance as a score from 0 to 1."""
    if metric in ("cosine", "ip"):
        return clamp(1 - d)
    if metric == "l2":
        return 1 / (1 + F.greatest(F.lit(0.0), d))
    raise ValueError(f"unknown distance: {metric}")
