"""Exact top-k inner-product search: a ball tree per shard, branch and bound.

Vectors are scaled to integers, so scores are exact.  Rows are dealt to the cell of
the nearest of a bounded number of pivots, and there by a hash of their id to
shards of a bounded number of rows; one ball tree is built per shard and stored
as one row.  Queries are packed into blocks by their cells.  A block meets the
shards of every cell whose ball may hold a row above some query's k-th score: a
task takes a shard once and streams blocks past it.  In a tree, nodes are taken in the order of their upper bound ``q.c + |q| r``, leaves
are scored a few more at a time, and the search ends when the best bound left
is below the query's k-th score.  That score is shared: a first meeting of each
block with a shard of its own cell sets it, and a task keeps raising it over all the shards
it meets.

Components that need more than 31 bits after scaling are "wide": such vectors
have shards and blocks of their own and are scored with Python's integers.

Edge cases: vectors that are null, or hold a null, NaN or infinite component,
take no part, nor do null ids.  Vectors of different dimension are never
compared.  Ties go to the smaller id.  Rows that share one id are candidates
each, but not of a query with that id; the query of a repeated id is the least
of its vectors (by dimension, then components).  A result whose score does not
fit a long fails the job rather than wrapping round.
"""

from __future__ import annotations

import heapq
import math
from collections import OrderedDict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import ship
from .common import materialize

SHARD_ROWS = 8192
BLOCK_QUERIES = 256
#: Pivots at most, and their bytes (all tasks get them).
CELLS, PIVOT_BYTES = 1024, 4 << 20
#: Rows that pivots are chosen from, for each pivot.
PIVOT_SAMPLE = 8
LEAF = 64
#: Components from here on are wide.
WIDE = 1 << 31
#: Blocks whose k-th scores a task remembers, and blocks that one copy of a shard serves.
REMEMBERED, BLOCKS_A_SHARD = 4096, 32


def quantize(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<int>, w array<double>, dim) with ``floor(scale * x)`` of each component, valid vectors only.

    ``w`` holds the whole numbers of wide vectors, ``v`` those of the others.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.col("id").isNotNull() & F.col("x").isNotNull())
    rows = rows.where(F.coalesce(usable, F.lit(False)))
    wide = F.exists("x", lambda c: F.abs(c) * scale >= float(WIDE - 1))
    whole = lambda c: c * scale - F.pmod(c * scale, F.lit(1.0))  # noqa: E731  floor, as a double
    narrow = F.when(~wide, F.transform("x", lambda c: F.floor(c * scale).cast("int")))
    return rows.select("id", narrow.alias("v"), F.when(wide, F.transform("x", whole)).alias("w"), F.size("x").alias("dim"))


def grow_tree(points: np.ndarray, leaf: int = LEAF):
    """(order, nodes): nodes are (start, end, left, right), split at the median of the widest direction."""
    order, nodes = np.arange(len(points)), []
    stack = [(0, len(points), -1, 0)]
    while stack:
        start, end, parent, side = stack.pop()
        me = len(nodes)
        nodes.append([start, end, -1, -1])
        if parent >= 0:
            nodes[parent][2 + side] = me
        own = points[order[start:end]]
        if end - start <= leaf or (own == own[0]).all():
            continue
        far = own[((own - own.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        other = own[((own - far) ** 2).sum(axis=1).argmax()]
        along = own @ (other - far)
        middle = (end - start) // 2
        cut = np.argpartition(along, middle)
        order[start:end] = order[start:end][cut]
        stack += [(start + middle, end, me, 1), (start, start + middle, me, 0)]
    return order, np.array(nodes, dtype=np.int32)


def pack_vectors(vectors: np.ndarray, wide: bool) -> bytes:
    return vectors.astype("<f8" if wide else "<i4").tobytes()


def unpack_vectors(data: bytes, n: int, dim: int, wide: bool) -> np.ndarray:
    """int32 rows, or rows of Python's integers where they are wide."""
    found = np.frombuffer(data, "<f8" if wide else "<i4").reshape(n, dim)
    return np.array([[int(x) for x in row] for row in found.tolist()], dtype=object).reshape(n, dim) if wide else found


def pack_shard(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, wide: bool = False) -> dict:
    points = vectors.astype(np.float64)
    order, nodes = grow_tree(points, leaf)
    points, ids = points[order], ids[order]
    centres = np.array([points[a:b].mean(axis=0) for a, b in nodes[:, :2]])
    radii = np.array([math.sqrt(((points[a:b] - c) ** 2).sum(axis=1).max()) for (a, b), c in zip(nodes[:, :2], centres)])
    return {"ids": ids.astype("<i8").tobytes(), "vectors": pack_vectors(points, wide), "nodes": nodes.astype("<i4").tobytes(), "centres": centres.astype("<f8").tobytes(), "radii": radii.astype("<f8").tobytes()}


class Tree:
    """A shard's tree, read from its packed row."""

    def __init__(self, row: dict, dim: int):
        self.ids, self.wide = np.frombuffer(row["ids"], "<i8"), bool(row.get("wide"))
        self.vectors = unpack_vectors(row["vectors"], len(self.ids), dim, self.wide)
        self.nodes = np.frombuffer(row["nodes"], "<i4").reshape(-1, 4)
        self.centres = np.frombuffer(row["centres"], "<f8").reshape(len(self.nodes), dim)
        self.radii = np.frombuffer(row["radii"], "<f8")
        self.largest = float(np.abs(self.vectors).max(initial=0)) if dim else 0.0
        self.floats, self.links = self.vectors.astype(np.float64), self.nodes.tolist()
        self.scored = 0

    def scores(self, a: int, b: int, q: np.ndarray) -> np.ndarray:
        """Exact integer products of rows a..b: floats only where they are exact, Python's integers where longs may not do."""
        self.scored += b - a
        most = self.largest * float(np.abs(q).max(initial=0)) * max(len(q), 1)
        if most < 2.0**52:
            return (self.floats[a:b] @ q.astype(np.float64)).astype(np.int64)
        if most < 2.0**62:
            return self.vectors[a:b].astype(np.int64) @ q.astype(np.int64)
        return self.vectors[a:b].astype(object) @ q.astype(object)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bounds of all nodes for all queries, above rounding errors."""
        q = queries.astype(np.float64)
        norms, reach = np.sqrt((q * q).sum(axis=1)), np.sqrt((self.centres**2).sum(axis=1)) + self.radii
        return q @ self.centres.T + norms[:, None] * (self.radii + 1e-9 * reach)[None, :] + 1e-6

    def search(self, q: np.ndarray, own: int, bound: np.ndarray, k: int, floor: int | None) -> list[tuple[int, int]]:
        """Up to k (score, -id) of this shard that may belong to the best k; ``floor``: a k-th score known so far.

        Leaves come off the heap best bound first; each time twice as many are
        scored together, neighbours in one product.
        """
        best: list[tuple[int, int]] = []
        least = -math.inf if floor is None else floor
        heap, at_once = [(-bound[0], 0)], 1
        while heap and -heap[0][0] >= least:
            leaves: list[tuple[int, int]] = []
            while heap and -heap[0][0] >= least and len(leaves) < at_once:
                start, end, left, right = self.links[heapq.heappop(heap)[1]]
                if left < 0:
                    leaves.append((start, end))
                    continue
                for child in (left, right):
                    if bound[child] >= least:
                        heapq.heappush(heap, (-bound[child], child))
            at_once *= 2
            for start, end in _joined(sorted(leaves)):
                score = self.scores(start, end, q)
                hit = np.flatnonzero((score >= least) & (self.ids[start:end] != own))
                if len(hit) > k:  # of equal scores, smaller ids first
                    if score.dtype != object:  # the k-th highest score bounds what is sorted
                        hit = hit[score[hit] >= np.partition(score[hit], len(hit) - k)[len(hit) - k]]
                    hit = np.array(sorted(hit.tolist(), key=lambda i: (-score[i], self.ids[start + i]))[:k])  # noqa: B023
                for i in hit.tolist():
                    found = int(score[i]), -int(self.ids[start + i])
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
                if len(best) == k:
                    least = max(least, best[0][0])
        return best


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans, those that touch as one."""
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


SHARD = "shard long, dim int, wide boolean, ids binary, vectors binary, nodes binary, centres binary, radii binary"
BLOCK = "block long, dim int, wide boolean, query_ids binary, queries binary, floors array<decimal(38,0)>"
HITS = "query_id long, vec_id long, score long"


def _matrix(pdf: pd.DataFrame, wide: bool, dim: int) -> np.ndarray:
    return np.array(pdf["w" if wide else "v"].tolist(), dtype=np.float64).reshape(len(pdf), dim)


def _values(pdf: pd.DataFrame, dim: int) -> np.ndarray:
    return np.array([v if w is None else w for v, w in zip(pdf["v"].tolist(), pdf["w"].tolist())], dtype=np.float64).reshape(len(pdf), dim)


def choose_pivots(rows: DataFrame, n: int) -> dict[int, np.ndarray]:
    """Of each dimension ``n`` pivots at most, of ``PIVOT_SAMPLE`` times as many rows (those of the least hashes): each the farthest from those before it."""
    sample = rows.orderBy(F.xxhash64("id", F.lit(17)), "id").limit(n * PIVOT_SAMPLE).toPandas()
    out = {}
    for dim, pdf in sample.groupby("dim"):
        x = np.unique(_values(pdf, int(dim)), axis=0)
        chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
        while len(chosen) < min(n, len(x)):
            chosen.append(int(np.argmax(far)))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
        out[int(dim)] = x[chosen]
    return out


def dealt_to_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """``rows`` with cell, the number of the nearest pivot (0 where a dimension has none), and its distance."""

    def run(batches):
        for pdf in batches:
            cell, far = np.zeros(len(pdf), np.int64), np.full(len(pdf), np.inf)
            for dim, own in pdf.groupby("dim").indices.items():
                middle = pivots.get(int(dim))
                if middle is not None:
                    x = _values(pdf.iloc[own], int(dim))
                    near = np.argmin((middle * middle).sum(axis=1)[None, :] - 2 * (x @ middle.T), axis=1)
                    cell[own], far[own] = near, np.sqrt(((x - middle[near]) ** 2).sum(axis=1))
            yield pdf.assign(cell=cell, far=far)

    return rows.mapInPandas(run, "id long, v array<int>, w array<double>, dim int, cell long, far double")


def build_shards(rows: DataFrame, leaf: int = LEAF) -> DataFrame:
    """One row per (shard, dimension, wide) with its packed tree; rows have their shard."""

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, wide = pdf.sort_values("id", kind="stable"), bool(key[2])
        packed = pack_shard(pdf["id"].to_numpy(), _matrix(pdf, wide, int(key[1])), leaf, wide)
        return pd.DataFrame([{"shard": key[0], "dim": key[1], "wide": wide, **packed}])

    dealt = rows.withColumn("wide", F.col("w").isNotNull()).select("shard", "dim", "wide", "id", "v", "w")
    return dealt.groupBy("shard", "dim", "wide").applyInPandas(build, SHARD)


def build_blocks(queries: DataFrame) -> DataFrame:
    """One row per (block, dimension, wide) of queries (id, v, w, dim, block, floor): packed vectors and k-th scores known so far."""

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, wide = pdf.sort_values("id", kind="stable"), bool(key[2])
        known = [None if x is None or x != x else x for x in pdf["floor"].tolist()]
        return pd.DataFrame([{"block": key[0], "dim": key[1], "wide": wide, "query_ids": pdf["id"].to_numpy().astype("<i8").tobytes(), "queries": pack_vectors(_matrix(pdf, wide, int(key[1])), wide), "floors": known}])

    dealt = queries.withColumn("wide", F.col("w").isNotNull())
    return dealt.groupBy("block", "dim", "wide").applyInPandas(build, BLOCK)


def reachable(blocks: DataFrame, pivots: dict[int, np.ndarray], radii: dict[tuple[int, int], float]) -> DataFrame:
    """(block, dim, wide, cell): the cells whose ball may hold a row above some query's k-th score."""
    cells = {dim: (np.array([c for d, c in sorted(radii) if d == dim]), np.array([radii[k] for k in sorted(radii) if k[0] == dim])) for dim in {d for d, _ in radii}}

    def run(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                dim = int(row["dim"])
                own, radius = cells.get(dim, (np.zeros(0, np.int64), np.zeros(0)))
                keep = np.ones(len(own), dtype=bool)
                if dim in pivots and len(own):
                    n = len(row["query_ids"]) // 8
                    q = np.asarray(unpack_vectors(row["queries"], n, dim, bool(row["wide"])), dtype=np.float64)
                    bound = q @ pivots[dim][own].T + np.sqrt((q * q).sum(axis=1))[:, None] * radius[None, :]
                    floors = np.array([-np.inf if x is None else float(x) for x in row["floors"]])
                    # Rounding is far below a billionth of the products' sizes; what is no number is kept.
                    slack = 1.0 + 1e-9 * np.sqrt((q * q).sum(axis=1))[:, None] * (np.sqrt((pivots[dim][own] ** 2).sum(axis=1)) + radius)[None, :]
                    keep = (~(bound + slack < floors[:, None])).any(axis=0)
                out += [(row["block"], dim, bool(row["wide"]), int(c)) for c in own[keep]]
            yield pd.DataFrame(out, columns=["block", "dim", "wide", "cell"])

    return blocks.select("block", "dim", "wide", "query_ids", "queries", "floors").mapInPandas(run, "block long, dim int, wide boolean, cell long")


def search_pairs(pairs: DataFrame, shards: DataFrame, k: int, n_parts: int, scored=None) -> DataFrame:
    """Hits of blocks (with the ``shard`` that each row shall meet) in the shards.

    A shard's row leads the blocks of its partition, so it is read once for
    ``BLOCKS_A_SHARD`` of them; k-th scores are kept from row to row of a task.
    ``scored``: an accumulator that counts the vectors scored.
    """
    pairs = pairs.withColumnRenamed("wide", "wide_queries").withColumn("part", F.expr(f"block div {BLOCKS_A_SHARD}"))
    copies = pairs.select("shard", "dim", "part").distinct().join(shards, ["shard", "dim"])
    rows = copies.withColumn("block", F.lit(-1).cast("long")).unionByName(pairs, allowMissingColumns=True)
    dealt = rows.repartition(n_parts, "shard", "dim", "part").sortWithinPartitions("shard", "dim", "part", "block", "wide")
    names = ["shard", "dim", "part", "block", "wide", "ids", "vectors", "nodes", "centres", "radii", "wide_queries", "query_ids", "queries", "floors"]

    def run(batches):
        known: OrderedDict = OrderedDict()
        trees_of, trees = None, []
        for pdf in batches:
            out, tried = [], 0
            for row in pdf.to_dict("records"):
                dim, key = int(row["dim"]), (row["shard"], row["dim"], row["part"])
                if trees_of != key:
                    trees_of, trees = key, []
                if row["block"] < 0:
                    trees.append(Tree(row, dim))
                    continue
                ids = np.frombuffer(row["query_ids"], "<i8")
                queries = unpack_vectors(row["queries"], len(ids), dim, bool(row["wide_queries"]))
                block = (row["block"], dim, bool(row["wide_queries"]))
                floors = known.pop(block, None)
                if floors is None:
                    floors = [None] * len(ids) if row["floors"] is None else [None if x is None else int(x) for x in row["floors"]]
                for tree in trees:
                    bounds, before = tree.bounds(queries), tree.scored
                    for i, own in enumerate(ids.tolist()):
                        best = tree.search(queries[i], own, bounds[i], k, floors[i])
                        if len(best) == k and (floors[i] is None or best[0][0] > floors[i]):
                            floors[i] = best[0][0]
                        out += [(own, -i2, s) for s, i2 in best]
                    tried += tree.scored - before
                known[block] = floors
                if len(known) > REMEMBERED:
                    known.popitem(last=False)
            if scored is not None:
                scored.add(tried)
            yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="object" if any(abs(s) >= 1 << 62 for *_, s in out) else "int64")

    return dealt.select(*names).mapInPandas(run, HITS)


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES, leaf: int = LEAF, scored=None, met=None) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best rows for each row that ``is_query(id)`` selects.

    ``scored``, ``met``: accumulators of the session for the number of (query, vector)
    products and of (block, shard) meetings, which show how much the bounds prune.
    """
    spark = ship(vectors.sparkSession).sparkContext
    rows = quantize(vectors, id_col, vector_col, scale)
    total, width = rows.agg(F.count("*"), F.max("dim")).first()
    n_pivots = max(1, min(CELLS, PIVOT_BYTES // (8 * max(1, width or 1)), math.ceil(total / shard_rows)))
    pivots = choose_pivots(rows, n_pivots)
    rows = materialize(dealt_to_cells(rows, pivots), "cells")
    # A row for each cell of each dimension: its ball, and the shards and blocks that it is cut into.
    of = rows.groupBy("dim", "cell").agg(F.max("far").alias("radius"), F.count("*").alias("n"), F.count_if(is_query(F.col("id"))).alias("asked")).orderBy("dim", "cell").collect()
    plan, n_shards, n_blocks = [], 0, 0
    for r in of:
        shards, asking = -(-r["n"] // shard_rows), max(1, -(-r["asked"] // block_queries))
        plan.append((r["dim"], r["cell"], n_shards, shards, n_blocks, asking))
        n_shards, n_blocks = n_shards + shards, n_blocks + asking
    plan = vectors.sparkSession.createDataFrame(plan, "dim int, cell long, first_shard long, shards long, first_block long, blocks long")
    radii = {(r["dim"], r["cell"]): r["radius"] for r in of}
    n_parts = max(1, min(n_shards * math.ceil(n_blocks / BLOCKS_A_SHARD), max(spark.defaultParallelism, 1 << 16)))
    placed = rows.join(F.broadcast(plan), ["dim", "cell"])
    shards = materialize(build_shards(placed.withColumn("shard", F.col("first_shard") + F.pmod(F.xxhash64("id", "v", "w"), F.col("shards"))), leaf), "shards")
    queries = placed.where(is_query(F.col("id"))).groupBy("id").agg(F.min(F.struct("dim", F.coalesce(F.col("w"), F.transform("v", lambda c: c.cast("double"))).alias("x"), "v", "w", "first_shard", "first_block", "blocks")).alias("q"))
    queries = queries.select("id", "q.v", "q.w", "q.dim", "q.first_shard", (F.col("q.first_block") + F.pmod(F.xxhash64("id"), F.col("q.blocks"))).alias("block"))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    # The shard of its own cell that each block meets first gives every query a k-th score to start from.
    blocks = build_blocks(queries.withColumn("floor", F.lit(None).cast("decimal(38,0)")))
    own = plan.select(F.explode(F.sequence("first_block", F.col("first_block") + F.col("blocks") - 1)).alias("block"), F.col("first_shard").alias("shard"))
    first = materialize(search_pairs(blocks.join(F.broadcast(own), "block"), shards, k, n_parts, scored), "first")
    seeds = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k)
    floors = seeds.select("query_id", F.col("score").cast("decimal(38,0)").alias("floor"))
    known = queries.join(floors, F.col("id") == F.col("query_id"), "left").drop("query_id")
    blocks = materialize(build_blocks(known), "blocks")
    of_cells = plan.select("dim", "cell", F.explode(F.sequence("first_shard", F.col("first_shard") + F.col("shards") - 1)).alias("shard"))
    near = reachable(blocks, pivots, radii).join(of_cells, ["dim", "cell"]).join(F.broadcast(own), ["block", "shard"], "left_anti")
    near = materialize(near.select("block", "dim", "wide", "shard"), "near")
    if met is not None:
        met.add(near.count())
    rest = search_pairs(blocks.join(near, ["block", "dim", "wide"]), shards, k, n_parts, scored)
    hits = first.unionByName(rest).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return hits.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
