"""Vector arithmetic on arrays, and a lexical embedding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 64


def _doubles(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a, b) -> Column:
    """0 where a norm is zero."""
    return F.coalesce(dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def hash_embedding(text, dimensions: int = DIMENSIONS) -> Column:
    """Counts of a text's tokens in hashed buckets, at unit length: lexical, not semantic. A text without tokens is all zeros."""
    text = F.col(text) if isinstance(text, str) else text
    with_value = lambda c, f: F.get(F.transform(F.array(c), f), F.lit(0))  # noqa: E731  computes c once, whatever f does with it
    tokens = F.filter(F.split(F.lower(text), " "), lambda t: t != "")
    buckets = F.transform(tokens, lambda t: F.conv(F.substring(F.md5(t), 1, 8), 16, 10).cast("long") % dimensions)
    counts = with_value(buckets, lambda b: F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda i: F.size(F.filter(b, lambda x: x == i)).cast("double")))
    measured = with_value(counts, lambda c: F.struct(c.alias("c"), norm(c).alias("n")))
    return with_value(measured, lambda m: F.transform(m["c"], lambda x: F.coalesce(x / F.nullif(m["n"], F.lit(0.0)), F.lit(0.0))))
