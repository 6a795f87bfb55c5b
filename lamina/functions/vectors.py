"""Dense vectors (array<float>) in JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; the shorter vector counts as padded with nulls, which makes the result null."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def l2_normalize(a: Column) -> Column:
    """v / |v|; a zero vector stays as it is."""
    # The norm is a lambda's argument, so it is computed once for all components.
    return F.element_at(F.transform(F.array(norm(a)), lambda n: F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x.cast("double")))), 1)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where a vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(F.lit(0.0))


def cls_pool(states: Column) -> Column:
    """First token's state."""
    return F.element_at(states, 1)


def last_pool(states: Column, mask: Column) -> Column:
    """State of the last token under the mask: at place sum(mask)."""
    return F.element_at(states, F.aggregate(mask, F.lit(0), lambda s, x: s + x.cast("int")))


def mean_pool(states: Column, mask: Column) -> Column:
    """Sum of masked states over max(sum of the mask, 1e-9)."""
    dims = F.sequence(F.lit(0), F.size(F.element_at(states, 1)) - 1)
    kept = F.zip_with(states, mask, lambda s, m: F.struct(s.alias("s"), m.cast("double").alias("m")))
    total = F.aggregate(mask, F.lit(0.0), lambda s, x: s + x.cast("double"))
    one = lambda i: F.aggregate(kept, F.lit(0.0), lambda acc, e: acc + e["s"][i].cast("double") * e["m"])
    return F.transform(dims, lambda i: one(i) / F.greatest(total, F.lit(1e-9)))
