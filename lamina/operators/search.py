"""Batch search: blocks of queries meet blocks of rows, and only the best of each leave a task.

Vectors travel as packed matrices.  A few queries are broadcast (behind a check of
their size) and rows stay where they are; more of them are dealt, with the rows,
to numbered meeting places, of whose two sides one is held and the other streams
past it.  Over a whole collection the rows are held, so each of them is shuffled once
and the queries alone are copied.  Either way nothing passes the driver, and a task
holds one place's rows and one slice of the queries.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..runtime import ship

#: Rows and queries that are multiplied at a time.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 1024
#: Bytes of queries that a task holds at a time, those that may be broadcast, and those of rows that one meeting place holds.
SLICE_BYTES, BROADCAST_BYTES, HELD_BYTES = 64 << 20, 8 << 20, 32 << 20


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; zero rows stay."""
    size = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of one width as float64; null components are 0."""
    return np.asarray(pc.fill_null(vectors.flatten().cast(pa.float64()), 0.0)).reshape(-1, width)


def packed(rows: DataFrame, block: int) -> DataFrame:
    """rows(at, id, v array) -> (at, width, ids array, data binary): vectors of one place and width, ``block`` at a time; a null vector has width -1."""
    id_kind = rows.schema["id"].dataType.simpleString()
    exact = "double" in rows.schema["v"].dataType.simpleString()
    kind = np.dtype("<f8" if exact else "<f4")

    def run(batches):
        for b in batches:
            at = np.asarray(b.column(0))
            sizes = np.asarray(pc.fill_null(pc.list_value_length(b.column(2)), -1))
            order = np.lexsort((sizes, at))
            at, sizes = at[order], sizes[order]
            ends = [*(np.flatnonzero((np.diff(at) != 0) | (np.diff(sizes) != 0)) + 1).tolist(), len(order)]
            out, start = [], 0
            for end in ends:
                for low in range(start, end, block):
                    chosen = pa.array(order[low : min(low + block, end)])
                    width = int(sizes[low])
                    data = matrix(b.column(2).take(chosen), width).astype(kind).tobytes() if width > 0 else b""
                    out.append((int(at[low]), width, b.column(1).take(chosen), data))
                start = end
            if out:
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[len(x[2]) for x in out]]), type=pa.int32()), pa.concat_arrays([x[2] for x in out]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], type=pa.int64()), pa.array([x[1] for x in out], type=pa.int32()), lists, pa.array([x[3] for x in out], type=pa.binary())], names=["at", "width", "ids", "data"])

    made = rows.select(F.col("at").cast("long").alias("at"), "id", "v").mapInArrow(run, f"at long, width int, ids array<{id_kind}>, data binary")
    return made.withColumn("exact", F.lit(exact))


class Best:
    """The best k rows so far of each query of a block."""

    def __init__(self, ids: list, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, unit(vectors), k
        self.floors, self.held = np.full(len(ids), -np.inf), [[] for _ in ids]

    def meet(self, names: list, rows: np.ndarray | None) -> None:
        """Score unit rows (None: all zero) against the queries; cosines to 12 decimals, ties to the lesser id."""
        rows = np.zeros((len(names), self.vectors.shape[1])) if rows is None else rows
        k = self.k
        for low in range(0, len(self.ids), BLOCK_QUERIES):
            scores = np.round(self.vectors[low : low + BLOCK_QUERIES] @ rows.T, 12) + 0.0
            known = self.floors[low : low + BLOCK_QUERIES]
            for q in np.flatnonzero(scores.max(axis=1) >= known).tolist():
                floor = known[q] if len(names) <= k else max(known[q], np.partition(scores[q], len(names) - k)[len(names) - k])
                new = [(-float(scores[q, j]), names[j]) for j in np.flatnonzero(scores[q] >= floor)]
                held = self.held[low + q] = heapq.nsmallest(k, self.held[low + q] + new)
                if len(held) == k:
                    known[q] = -held[-1][0]

    def rows(self) -> list[tuple]:
        return [(q, name, -score + 0.0) for q, held in zip(self.ids, self.held) for score, name in held]


def _vectors(width: int, data: bytes, exact: bool) -> np.ndarray | None:
    return np.frombuffer(data, "<f8" if exact else "<f4").astype(np.float64).reshape(-1, width) if width > 0 else None


def _found(best: list[Best], names: tuple[str, str], kinds: list[pa.DataType]):
    rows = [r for b in best for r in b.rows()]
    if rows:
        q, i, s = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(q, type=kinds[0]), pa.array(i, type=kinds[1]), pa.array(s, type=pa.float64())], names=[*names, "score"])


def _best_of(found: DataFrame, k: int, query_id: str, id_col: str) -> DataFrame:
    w = Window.partitionBy(query_id).orderBy(F.desc("score"), id_col)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(query_id, "rank", id_col, "score")


def meet_broadcast(queries: DataFrame, rows: DataFrame, k: int, query_id: str, id_col: str) -> DataFrame:
    """Blocks of few queries are sent to every block of rows."""
    names = (query_id, id_col)
    sent = queries.select("at", F.col("width").alias("q_width"), F.col("ids").alias("q"), F.col("data").alias("q_data"), F.col("exact").alias("q_exact"))
    pairs = rows.join(F.broadcast(sent), "at").where((F.col("width") == F.col("q_width")) | (F.col("width") < 0))
    pairs = pairs.select("q_width", "q", "q_data", "q_exact", "width", "ids", "data", "exact")
    q_kind, i_kind = (x.schema["ids"].dataType.elementType.simpleString() for x in (queries, rows))

    def run(batches):
        best: dict = {}
        kinds = None
        for b in batches:
            kinds = [b.column(k).type.value_type for k in (1, 5)]
            for q_width, q, q_data, q_exact, width, ids, data, exact in zip(*[c.to_pylist() for c in b.columns]):
                key = (q_width, q[0])
                if key not in best:
                    best[key] = Best(q, _vectors(q_width, q_data, q_exact), k)
                rows = _vectors(width, data, exact)
                best[key].meet(ids, None if rows is None else unit(rows))
        if kinds:
            yield from _found(list(best.values()), names, kinds)

    return pairs.mapInArrow(run, f"`{query_id}` {q_kind}, `{id_col}` {i_kind}, score double")


def meet_dealt(queries: DataFrame, rows: DataFrame, k: int, query_id: str, id_col: str, partitions: int) -> DataFrame:
    """Blocks of queries and rows of one place meet in one task: its queries are held, its rows pass."""
    names = (query_id, id_col)
    q_kind, i_kind = (x.schema["ids"].dataType.elementType.simpleString() for x in (queries, rows))
    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    left = queries.select("at", F.lit(0).alias("kind"), "width", F.col("ids").alias("q"), none(i_kind).alias("i"), "data", "exact")
    right = rows.select("at", F.lit(1).alias("kind"), "width", none(q_kind).alias("q"), F.col("ids").alias("i"), "data", "exact")
    dealt = left.unionByName(right).repartitionById(partitions, F.pmod("at", F.lit(partitions)).cast("int")).sortWithinPartitions("at", "kind")

    def run(batches):
        place, best, kinds = None, [], None
        for b in batches:
            kinds = [b.column(k).type.value_type for k in (3, 4)]
            for at, kind, width, q, i, data, exact in zip(*[c.to_pylist() for c in b.columns]):
                if at != place:
                    yield from _found(best, names, kinds)
                    place, best = at, []
                if kind == 0:
                    best.append(Best(q, _vectors(width, data, exact), k))
                    continue
                rows = _vectors(width, data, exact)
                rows = None if rows is None else unit(rows)
                for one in best:
                    if width < 0 or one.vectors.shape[1] == width:
                        one.meet(i, rows)
        if kinds:
            yield from _found(best, names, kinds)

    return dealt.mapInArrow(run, f"`{query_id}` {q_kind}, `{id_col}` {i_kind}, score double")


def meet_held(queries: DataFrame, rows: DataFrame, k: int, query_id: str, id_col: str, partitions: int) -> DataFrame:
    """Blocks of queries and rows of one place meet in one task: its rows are held, its queries pass."""
    names = (query_id, id_col)
    q_kind, i_kind = (x.schema["ids"].dataType.elementType.simpleString() for x in (queries, rows))
    none = lambda kind: F.lit(None).cast(f"array<{kind}>")
    left = queries.select("at", F.lit(1).alias("kind"), "width", F.col("ids").alias("q"), none(i_kind).alias("i"), "data", "exact")
    right = rows.select("at", F.lit(0).alias("kind"), "width", none(q_kind).alias("q"), F.col("ids").alias("i"), "data", "exact")
    dealt = left.unionByName(right).repartitionById(partitions, F.pmod("at", F.lit(partitions)).cast("int")).sortWithinPartitions("at", "kind")

    def run(batches):
        place, held = None, []
        for b in batches:
            kinds = [b.column(c).type.value_type for c in (3, 4)]
            for at, kind, width, q, i, data, exact in zip(*[c.to_pylist() for c in b.columns]):
                if at != place:
                    place, held = at, []
                vectors = _vectors(width, data, exact)
                if kind == 0:
                    held.append((width, i, None if vectors is None else unit(vectors)))
                    continue
                best = Best(q, vectors, k)
                for own, i, vectors in held:
                    if own < 0 or own == width:
                        best.meet(i, vectors)
                yield from _found([best], names, kinds)

    return dealt.mapInArrow(run, f"`{query_id}` {q_kind}, `{id_col}` {i_kind}, score double")


def top_k_batch(collection: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "chunk_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_embedding", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(query_id, rank, id, score) for a stated set of queries against all rows, in blocks.

    Scores are cosines to 12 decimals, so equal vectors score alike wherever they
    lie; ties go to the lesser id.  Rows and queries without an id take no part,
    nor do queries without a vector (or of no components); null and zero rows score
    0; rows of another dimension than a query are not compared with it.  Only the
    numbers of queries and rows and their widths come to the driver.
    """
    spark = ship(collection.sparkSession)
    asked = queries.select(F.col(query_id).alias("id"), F.col(query_vector).alias("v")).where("id is not null and size(v) > 0")
    rows = collection.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("id is not null")
    total, width = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    size = total * 8 * (width or 1)
    if size <= min(slice_bytes, BROADCAST_BYTES):
        here = F.lit(0).cast("long").alias("at")
        found = meet_broadcast(packed(asked.select(here, "id", "v"), BLOCK_QUERIES), packed(rows.select(here, "id", "v"), BLOCK_ROWS), k, query_id, id_col)
        return _best_of(found, k, query_id, id_col)
    # A row goes to one place; the queries go to all of them, a slice at a time.
    held, wide = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-held * 8 * max(wide or 1, 1) // HELD_BYTES))
    block = max(1, min(BLOCK_QUERIES, slice_bytes // (8 * (width or 1))))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("at")
    left = packed(asked.select(F.lit(0).alias("at"), "id", "v"), block).drop("at").select(every, "width", "ids", "data", "exact")
    right = packed(rows.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("at"), "id", "v"), BLOCK_ROWS)
    return _best_of(meet_held(left, right, k, query_id, id_col, parts), k, query_id, id_col)
