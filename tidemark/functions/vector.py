"""Vector functions as Spark columns, in double precision, and a deterministic embedder."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where the lengths differ or either is zero."""
    scale = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (scale > 0), dot(a, b) / scale).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def hashed_embedding(words: Column, dims: int = 64) -> Column:
    """A unit vector of signed word hashes: a stand-in where no model's vectors are supplied."""
    slot = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(dims)))
    sign = F.transform(words, lambda w: F.when(F.pmod(F.xxhash64(w, F.lit(1)), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    paired = F.arrays_zip(slot.alias("slot"), sign.alias("sign"))
    raw = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: F.aggregate(F.filter(paired, lambda p: p["slot"] == i), F.lit(0.0), lambda s, p: s + p["sign"]))
    return F.transform(F.array(raw), lambda v: F.transform(v, lambda x: (x / F.greatest(norm(v), F.lit(1e-12))).cast("float")))[0]
