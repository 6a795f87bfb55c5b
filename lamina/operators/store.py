"""A vector store over Parquet: add, get, query, delete, count, and an index for approximate search.

A collection is a generation of files.  Every addition adds a folder of its own, by
which its rows are told apart (``add``), and files them by their cell (``cell``,
see :mod:`.index`).  Ids are keys: an addition that brings an id again replaces the
earlier row, and ``delete`` removes one, by a small table of what is gone, (id,
addition); rows are read without those.  ``compact``, ``build_index`` and ``clear``
write a new generation and then move a small pointer table, so a reader never sees
half a change; they must be the only change at their time.  Additions of several
writers don't disturb each other: two that bring one id at the same time both keep
it until the next that brings it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import vectors as vec
from ..schema import VECTOR
from . import index
from .search import top_k_batch

#: Ids or filters longer than this go through a join instead of an IN list.
MANY = 1000
ROWS, GONE, CENTROIDS = f"{VECTOR}, add string, cell int", "chunk_id string, add string, by string", "cell int, centroid array<double>"


def top_k(collection: DataFrame, query: list[float], k: int = 5, filters: dict | None = None, id_col: str = "chunk_id", vector_col: str = "embedding") -> DataFrame:
    """The k most similar rows with ``score``, ties to the lesser id: a filter, a projection and TakeOrderedAndProject."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = matching(collection, filters).withColumn("score", vec.cosine(F.col(vector_col), q))
    return rows.orderBy(F.desc("score"), id_col).limit(k)


def matching(collection: DataFrame, filters: dict | None) -> DataFrame:
    """Rows that equal every given value: of a column where there is one, else of the metadata map."""
    for name, value in (filters or {}).items():
        left = F.col(name) if name in collection.columns else F.col("metadata")[name]
        collection = collection.where(left == (value if name in collection.columns else str(value)))
    return collection


def create_store(spark: SparkSession, path: str, kind: str = "parquet", **config) -> VectorStore:
    """A store by its kind's name."""
    if kind != "parquet":
        raise ValueError(f"unknown vector store: {kind}")
    return VectorStore(spark, path, **config)


class VectorStore:
    """A collection (chunk_id, embedding, text, metadata) in a folder that Spark reads."""

    def __init__(self, spark: SparkSession, path: str, dimension: int | None = None, recreate: bool = False):
        self.spark, self.path, self.dimension = spark, path.rstrip("/"), dimension
        if recreate or self._generation() is None:
            self.clear()

    def _generation(self) -> str | None:
        jvm, at = self.spark.sparkContext._jvm, f"{self.path}/current"
        path = jvm.org.apache.hadoop.fs.Path(at)
        if not path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return None
        last = self._pointers().first()
        return last and last["generation"]

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema("number long, generation string").json(f"{self.path}/current").orderBy(F.desc("number"), "generation")

    def _point(self, generation: str, first: bool) -> None:
        last = None if first else self._pointers().first()
        number = last["number"] + 1 if last else 0
        self.spark.createDataFrame([(number, generation)], "number long, generation string").coalesce(1).write.mode("append").json(f"{self.path}/current")

    def _table(self, name: str, schema: str, generation: str | None = None) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{generation or self._generation()}/{name}")

    def _live(self) -> DataFrame:
        """All rows with their addition and cell, without those that are gone."""
        generation = self._generation()
        return self._table("rows", ROWS, generation).join(self._table("gone", GONE, generation).drop("by"), ["chunk_id", "add"], "left_anti")

    def read(self) -> DataFrame:
        return self._live().select("chunk_id", "embedding", "text", "metadata")

    def centroids(self) -> DataFrame:
        return self._table("centroids", CENTROIDS)

    def _start(self, rows: DataFrame | None = None, centroids: DataFrame | None = None) -> None:
        """A new generation, of the given rows or empty, and the pointer to it."""
        generation, first = uuid.uuid4().hex, self._generation() is None
        made = f"{self.path}/{generation}"
        empty = lambda schema: self.spark.createDataFrame([], schema)
        (empty(CENTROIDS) if centroids is None else centroids.coalesce(1)).write.parquet(f"{made}/centroids")
        empty(GONE).drop("by").write.parquet(f"{made}/gone/by=start")
        self._put(empty(ROWS) if rows is None else rows, made, uuid.uuid4().hex)
        self._point(generation, first)

    @staticmethod
    def _put(rows: DataFrame, generation: str, added: str, filed: bool = True) -> None:
        """Write an addition's rows below a folder of its own: writers of one folder would disturb each other.

        A cell's rows go to as many files as they need, and each file holds one cell;
        ``filed``: they are of several cells, so they are brought together.
        """
        rows = rows.select("chunk_id", "embedding", "text", "metadata", "cell")
        rows = rows.hint("rebalance", "cell") if filed else rows
        rows.write.option("compression", "zstd").partitionBy("cell").parquet(f"{generation}/rows/add={added}")

    def clear(self) -> None:
        """An empty collection from here on."""
        self._start()

    def compact(self) -> None:
        """The same rows in new files, without what is gone."""
        self._start(self._live(), self.centroids())

    def build_index(self, cells: int | None = None, seed: int = 7) -> int:
        """Train centroids and file every row by them; returns how many there are."""
        rows = self.read()
        known = index.train(rows, cells, seed=seed)
        known = self.spark.createDataFrame(known.collect(), CENTROIDS)  # bounded; the model is not trained again
        self._start(index.filed(rows, known), known)
        return known.count()

    def probes_for(self, recall: float = 0.95, k: int = 10, queries: int = 200) -> int:
        """The cells to probe for this share of the exact answer, measured on about ``queries`` rows of the collection.

        Probes are doubled up to all cells.  Vectors in groups need a few; vectors spread evenly need most.
        A neighbour is found by as many probes as its cell's place in the query's order of cells,
        so one exact search tells the recall of every number of them.
        """
        rows, cells = self.read(), self.centroids().count()
        step = max(1, rows.count() // queries)
        asked = rows.where(F.pmod(F.xxhash64("chunk_id", F.lit(3)), F.lit(step)) == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
        exact = self.query_batch(asked, k).select("query_id", "chunk_id")
        order = index.nearest(asked, self.centroids(), cells, "query_embedding", "cells").select("query_id", "cells")
        found = self._live().select("chunk_id", "cell").join(exact, "chunk_id").join(order, "query_id")
        place = F.when(F.col("cell") == index.ALWAYS, 0).otherwise(F.nullif(F.array_position("cells", F.col("cell")), F.lit(0)))
        tried = [1 << n for n in range(max(1, cells).bit_length())]
        total, *counts = found.select(place.alias("place")).agg(F.count("*"), *[F.count_if(F.col("place") <= n) for n in tried]).first()
        probes = next((n for n, held in zip(tried, counts) if held >= recall * total), cells)
        return max(1, min(probes, cells))

    def add(self, rows: DataFrame, distinct: bool = False) -> DataFrame:
        """Add (chunk_id?, embedding, text, metadata); returns the ids.

        Missing ids get a UUID.  Rows present with one of the ids are replaced; of
        rows that share an id here, the one of the least text (then vector) stays.
        ``distinct``: the caller knows that no two do, so texts and vectors are not shuffled.
        """
        if "embedding" not in rows.columns or "text" not in rows.columns:
            raise ValueError("documents need a text and an embedding each")
        named = "chunk_id" in rows.columns
        own = F.col("chunk_id").cast("string") if named else F.lit(None).cast("string")
        data = F.col("metadata") if "metadata" in rows.columns else F.create_map().cast("map<string,string>")
        new = rows.select(F.coalesce(own, F.expr("uuid()")).alias("chunk_id"), F.col("embedding").cast("array<float>").alias("embedding"), F.col("text"), data.cast("map<string,string>").alias("metadata"))
        if named and not distinct:
            w = Window.partitionBy("chunk_id").orderBy("text", "embedding")
            new = new.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")
        if self.dimension is not None:
            from .embedding import checked

            new = checked(new, self.dimension)
        generation, added = self._generation(), uuid.uuid4().hex
        centroids = self._table("centroids", CENTROIDS, generation)
        filed = not centroids.isEmpty()
        new = index.filed(new, centroids) if filed else new.withColumn("cell", F.lit(index.ALWAYS))
        self._put(new, f"{self.path}/{generation}", added, filed)
        # The ids are read back: those returned are those written.
        mine = self._table("rows", ROWS, generation).where(F.col("add") == added).select("chunk_id")
        if named:
            self._remove(mine, F.col("add") != added)
        return mine

    def _wanted(self, ids: list[str] | DataFrame) -> tuple[Column | None, DataFrame | None]:
        if isinstance(ids, DataFrame):
            return None, ids.select(F.col(ids.columns[0]).alias("chunk_id")).distinct()
        if len(ids) > MANY:
            return None, self.spark.createDataFrame([(i,) for i in ids], "chunk_id string").distinct()
        return F.col("chunk_id").isin(*ids), None

    def _remove(self, ids: list[str] | DataFrame, which: Column | None = None) -> None:
        """Note the live rows of these ids as gone: only ids are read, and only theirs are written."""
        where, join = self._wanted(ids)
        rows = self._live().select("chunk_id", "add")
        rows = rows if which is None else rows.where(which)
        rows = rows.where(where) if join is None else rows.join(join, "chunk_id", "left_semi")
        rows.write.parquet(f"{self.path}/{self._generation()}/gone/by={uuid.uuid4().hex}")

    def get(self, ids: list[str] | DataFrame) -> DataFrame:
        where, join = self._wanted(ids)
        rows = self.read().select("chunk_id", "text", "metadata")
        return rows.where(where) if join is None else rows.join(join, "chunk_id", "left_semi")

    def query(self, embedding: list[float], k: int = 5, filters: dict | None = None) -> DataFrame:
        return top_k(self.read(), embedding, k, filters).select("chunk_id", "text", "metadata", "score")

    def query_batch(self, queries: DataFrame, k: int = 5, filters: dict | None = None, probes: int | None = None) -> DataFrame:
        """(query_id, rank, chunk_id, score): exact, or with ``probes`` among that many cells of the index for each query."""
        if probes is None:
            return top_k_batch(matching(self.read(), filters), queries, k)
        return index.top_k_probed(matching(self._live(), filters), self.centroids(), queries, k, probes)

    def delete(self, ids: list[str] | DataFrame) -> None:
        self._remove(ids)

    def count(self) -> int:
        return self.read().count()
