"""Connected components of an edge table, with every step a distributed join.

Alternating large and small stars: each node points its neighbours at the
least node it knows, until nothing changes.  Minima are aggregated before the
shuffle and joined back, so a node with very many edges is never gathered in
one task, and AQE can split it.  Each round ends in a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import fewer, materialize

MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v): one large or small star step, as edges (larger, smaller)."""
    if large:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialize(fewer(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))), "least")
    linked = both.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges (u long, v long)`` that is not
    its component's least node; that least node is the component.

    Self edges and nulls are ignored; an empty table gives an empty table.
    """
    now = materialize(fewer(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), "edges")
    state = _state(now)
    for _ in range(MAX_ROUNDS):
        if not state[0]:
            break
        now = materialize(fewer(_star(materialize(fewer(_star(now, True)), "large"), False)), "small")
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
