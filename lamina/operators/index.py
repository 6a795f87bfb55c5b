"""An inverted file over vectors: rows filed by their nearest centroid, of which a search reads a few.

Centroids are trained by k-means (cosine) on a bounded sample; every row is filed.
Files are partitions by ``cell``, so a search's cells reach the scan as a partition
filter.  Cell ``ALWAYS`` holds what is near no centroid (null and zero vectors, rows
filed before there were centroids) and is read by every search.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from ..functions import vectors as vec
from ..runtime import ship
from . import search

ALWAYS = -1
#: Rows of the sample for each centroid, and bytes of centroids (they are sent to all tasks).
SAMPLE_PER_CELL, CENTROID_BYTES = 256, 64 << 20
#: Rows of a cell that one meeting place takes; larger cells have several.
PLACE_ROWS = 1 << 16


def train(rows: DataFrame, cells: int | None = None, id_col: str = "chunk_id", vector_col: str = "embedding", seed: int = 7) -> DataFrame:
    """(cell, centroid) of ``cells`` centroids at most (by default the root of the number of rows).

    The sample is drawn by a hash of the id: ``SAMPLE_PER_CELL`` rows for each cell
    of those that have a vector other than zero.  Without such rows there are no centroids.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = rows.sparkSession
    known = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(vec.norm(F.col("v")) > 0)
    total, width = known.agg(F.count("*"), F.max(F.size("v"))).first()
    kind = "cell int, centroid array<double>"
    if not total:
        return spark.createDataFrame([], kind)
    cells = max(1, min(cells or math.isqrt(total), CENTROID_BYTES // (8 * width), total))
    share = min(1.0, SAMPLE_PER_CELL * cells / total)
    sample = known.where((F.size("v") == width) & (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) <= int(share * (1 << 20)))).select(array_to_vector("v").alias("features"))
    if cells == 1 or sample.isEmpty():
        return spark.createDataFrame([(0, [1.0] + [0.0] * (width - 1))], kind)
    model = KMeans(k=cells, seed=seed, distanceMeasure="cosine", maxIter=10).fit(sample)
    return spark.createDataFrame([(n, [float(x) for x in c]) for n, c in enumerate(model.clusterCenters())], kind)


def _matrix(centroids: DataFrame) -> tuple[list[int], np.ndarray | None]:
    rows = centroids.orderBy("cell").collect()  # CENTROID_BYTES at most
    return [r["cell"] for r in rows], search.unit(np.array([r["centroid"] for r in rows])) if rows else None


def nearest(rows: DataFrame, centroids: DataFrame, n: int, vector_col: str, name: str) -> DataFrame:
    """``rows`` with an array of the ``n`` cells nearest to each vector; empty for null, zero and other vectors than the centroids'."""
    ship(rows.sparkSession)
    cells, middle = _matrix(centroids)
    names, at = rows.columns, rows.columns.index(vector_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches):
        for b in batches:
            sizes = np.asarray(pc.fill_null(pc.list_value_length(b.column(at)), -1))
            out: list[list[int]] = [[] for _ in range(b.num_rows)]
            own = np.flatnonzero(sizes == middle.shape[1]) if middle is not None else np.array([], dtype=np.int64)
            for low in range(0, len(own), search.BLOCK_ROWS):
                some = own[low : low + search.BLOCK_ROWS]
                units = search.unit(search.matrix(b.column(at).take(pa.array(some)), middle.shape[1]))
                order = np.argsort(-np.round(units @ middle.T, 12), axis=1, kind="stable")[:, :n]
                for row, chosen in zip(some.tolist(), order.tolist()):
                    out[row] = [cells[c] for c in chosen]
                for row in some[~units.any(axis=1)].tolist():
                    out[row] = []
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, type=pa.list_(pa.int32()))], names=[*names, name])

    return rows.mapInArrow(run, f"{schema}, `{name}` array<int>")


def filed(rows: DataFrame, centroids: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """``rows`` with ``cell``, that of the nearest centroid."""
    found = nearest(rows, centroids, 1, vector_col, "cells")
    return found.withColumn("cell", F.coalesce(F.get("cells", F.lit(0)), F.lit(ALWAYS))).drop("cells")


def top_k_probed(rows: DataFrame, centroids: DataFrame, queries: DataFrame, k: int, probes: int, id_col: str = "chunk_id", vector_col: str = "embedding", query_id: str = "query_id", query_vector: str = "query_embedding") -> DataFrame:
    """(query_id, rank, id, score) among the rows of the ``probes`` cells nearest to each query (and of ``ALWAYS``).

    rows(id, vector, cell, ...).  What comes to the driver is the cells that are probed and
    their sizes.  A cell of more than ``PLACE_ROWS`` rows is dealt to several places.
    """
    spark = ship(rows.sparkSession)
    asked = queries.select(F.col(query_id).alias("id"), F.col(query_vector).alias("v")).where("id is not null and size(v) > 0")
    asked = nearest(asked, centroids, probes, "v", "cells").withColumn("cell", F.explode(F.concat("cells", F.array(F.lit(ALWAYS))))).select("id", "v", "cell")
    wanted = sorted(r[0] for r in asked.select("cell").distinct().collect())
    near = rows.where(F.col("cell").isin(*wanted) & F.col(id_col).isNotNull())
    places, first = [], 0
    for cell, n in sorted(near.groupBy("cell").agg(F.count("*")).collect()):
        places.append((cell, first, -(-n // PLACE_ROWS)))
        first += places[-1][2]
    known = F.broadcast(spark.createDataFrame(places, "cell int, first long, parts long"))
    here = near.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), "cell").join(known, "cell")
    here = here.select((F.col("first") + F.pmod(F.xxhash64("id"), F.col("parts"))).alias("at"), "id", "v")
    there = asked.join(known, "cell").select(F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("at"), "id", "v")
    partitions = max(1, min(first, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    found = search.meet_dealt(search.packed(there, search.BLOCK_QUERIES), search.packed(here, search.BLOCK_ROWS), k, query_id, id_col, partitions)
    return search._best_of(found, k, query_id, id_col)
