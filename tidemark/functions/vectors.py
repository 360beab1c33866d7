"""Vector columns: arrays of numbers, computed in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def hashed_embedding(tokens: Column, size: int = 64) -> Column:
    """A deterministic stand-in for an embedding model: signed hashed counts, to unit length."""
    at = F.transform(tokens, lambda t: F.struct(F.pmod(F.xxhash64(t), F.lit(size)).cast("int").alias("k"), F.when(F.pmod(F.crc32(t.cast("binary")), F.lit(2)) == 0, 1.0).otherwise(-1.0).alias("s")))
    raw = F.transform(
        F.sequence(F.lit(0), F.lit(size - 1)),
        lambda i: F.aggregate(F.filter(at, lambda e: e["k"] == i), F.lit(0.0), lambda acc, e: acc + e["s"]),
    )
    length = norm(raw)
    return F.when(length > 0, F.transform(raw, lambda x: (x / length).cast("float")))
