"""Profiles of cells: columns, rows and the whole; and look-ups by place."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as fn
from ..sources.csv import HIGH, WIDE, typed


def column_profile(cells: DataFrame) -> DataFrame:
    """Per column of data cells: types, distinct values, empties, longest value and numeric statistics.

    The deviation is the sample's, NaN for a single number, null without any.
    """
    rows = typed(cells.where(~F.col("is_header")))
    number = F.when(F.col("is_numeric"), fn.as_number(F.col("value")))
    rows = rows.withColumn("number", number)
    return rows.groupBy("doc_id", "col", "column_name").agg(
        F.array_sort(F.collect_set("data_type")).alias("data_types"),
        F.countDistinct("value").alias("unique_values"),
        F.count_if("is_empty").alias("null_count"),
        F.max(F.length("value")).cast("long").alias("max_length"),
        F.count("number").alias("numeric_count"),
        F.avg("number").alias("mean"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.when(F.count("number") == 1, F.lit(float("nan"))).otherwise(F.stddev_samp("number")).alias("std"),
    )


def row_completeness(cells: DataFrame) -> DataFrame:
    """(doc_id, row, n_cells, n_empty, completeness) of data rows."""
    rows = typed(cells.where(~F.col("is_header"))).groupBy("doc_id", "row").agg(F.count("*").alias("n_cells"), F.count_if("is_empty").alias("n_empty"))
    return rows.withColumn("completeness", (F.col("n_cells") - F.col("n_empty")) / F.col("n_cells"))


def data_quality(cells: DataFrame) -> DataFrame:
    """Per document of data cells: totals and shares of empty and numeric cells."""
    rows = typed(cells.where(~F.col("is_header"))).groupBy("doc_id").agg(F.count("*").alias("total_cells"), F.count_if("is_empty").alias("empty_cells"), F.count_if("is_numeric").alias("numeric_cells"))
    return rows.withColumns({
        "empty_percentage": F.col("empty_cells") / F.col("total_cells"), "numeric_percentage": F.col("numeric_cells") / F.col("total_cells"), "completeness_score": 1 - F.col("empty_cells") / F.col("total_cells"),
    })


def column_patterns(cells: DataFrame) -> DataFrame:
    """(doc_id, col, column_name, data_type, n, share, empty_ratio): the types of each column."""
    rows = typed(cells.where(~F.col("is_header"))).groupBy("doc_id", "col", "column_name", "data_type").agg(F.count("*").alias("n"), F.count_if("is_empty").alias("n_empty"))
    totals = rows.groupBy("doc_id", "col").agg(F.sum("n").alias("total"), F.sum("n_empty").alias("empty"))
    return rows.join(totals, ["doc_id", "col"]).select("doc_id", "col", "column_name", "data_type", "n", (F.col("n") / F.col("total")).alias("share"), (F.col("empty") / F.col("total")).alias("empty_ratio"))


def row_patterns(cells: DataFrame) -> DataFrame:
    return row_completeness(cells).withColumn("empty_ratio", F.col("n_empty") / F.col("n_cells"))


def with_boxes(cells: DataFrame) -> DataFrame:
    """Cells at their places on the grid."""
    return cells.withColumns({
        "x0": (F.col("col") * WIDE).cast("double"), "y0": (F.col("row") * HIGH).cast("double"), "x1": ((F.col("col") + 1) * WIDE).cast("double"), "y1": ((F.col("row") + 1) * HIGH).cast("double"),
    })


def cell_at(cells: DataFrame, x: float, y: float) -> DataFrame:
    """Per document, the first cell in row order whose box holds the point, edges included."""
    hit = with_boxes(cells).where((F.col("x0") <= x) & (F.col("x1") >= x) & (F.col("y0") <= y) & (F.col("y1") >= y))
    first = hit.groupBy("doc_id").agg(F.min(F.struct("row", "col", "column_name", "value")).alias("c"))
    return first.select("doc_id", "c.*")


def column_data(cells: DataFrame, column_name: str) -> DataFrame:
    """(doc_id, row, value) of a column's data cells."""
    return cells.where((F.col("column_name") == column_name) & ~F.col("is_header")).select("doc_id", "row", "value")


def row_data(cells: DataFrame, row: int) -> DataFrame:
    """(doc_id, col, value) of a row."""
    return cells.where(F.col("row") == row).select("doc_id", "col", "value")


def find_cells(cells: DataFrame, text: str, case_sensitive: bool = False) -> DataFrame:
    """Cells that contain a text, header cells included."""
    hit = F.col("value").contains(text) if case_sensitive else F.lower("value").contains(text.lower())
    return cells.where(hit)


def data_range(cells: DataFrame, row_from: int, row_to: int, col_from: int, col_to: int) -> DataFrame:
    """(doc_id, row, values array<string>) of an inclusive rectangle; cells that are missing are empty."""
    inside = cells.where(F.col("row").between(row_from, row_to) & F.col("col").between(col_from, col_to))
    grid = cells.select("doc_id").distinct().select("doc_id", F.explode(F.sequence(F.lit(row_from), F.lit(row_to))).alias("row"))
    held = inside.groupBy("doc_id", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("held"))
    values = F.transform(F.sequence(F.lit(col_from), F.lit(col_to)), lambda c: F.coalesce(F.try_element_at("held", c), F.lit("")))
    return grid.join(held, ["doc_id", "row"], "left").select("doc_id", "row", values.alias("values"))


def column_sketch(cells: DataFrame, precision: int = 14) -> DataFrame:
    """A profile of columns that adds up: (doc_id, col, column_name, types, cells, empties, longest, numbers, mean, spread, low, high, values_sketch).

    ``spread`` is the sum of squared differences from the mean.  The sketch is
    HyperLogLog of ``precision`` bits: a standard error of 1.04 / sqrt(2^precision).
    Write it for each batch; :func:`merged_sketches` makes one of several.
    """
    rows = typed(cells.where(~F.col("is_header")))
    rows = rows.withColumn("number", F.when(F.col("is_numeric"), fn.as_number(F.col("value"))))
    return rows.groupBy("doc_id", "col", "column_name").agg(
        F.array_sort(F.collect_set("data_type")).alias("types"),
        F.count("*").alias("cells"),
        F.count_if("is_empty").alias("empties"),
        F.max(F.length("value")).cast("long").alias("longest"),
        F.count("number").alias("numbers"),
        F.avg("number").alias("mean"),
        (F.var_pop("number") * F.count("number")).alias("spread"),
        F.min("number").alias("low"),
        F.max("number").alias("high"),
        F.hll_sketch_agg("value", precision).alias("values_sketch"),
    )


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """The sketches of several batches as one for each of ``keys`` (by default doc_id, col, column_name), in the same columns.

    Means and spreads are combined from those of the batches, so no cell is read again.
    """
    keys = keys or ("doc_id", "col", "column_name")
    merged = sketches.groupBy(*keys).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("types")))).alias("types"),
        F.sum("cells").alias("cells"),
        F.sum("empties").alias("empties"),
        F.max("longest").alias("longest"),
        F.sum("numbers").alias("numbers"),
        # One pair for each batch.
        F.collect_list(F.when(F.col("numbers") > 0, F.struct(F.col("numbers").alias("n"), "mean"))).alias("parts"),
        F.sum("spread").alias("spread"),
        F.min("low").alias("low"),
        F.max("high").alias("high"),
        F.hll_union_agg("values_sketch", True).alias("values_sketch"),
    )
    # Means are taken from the first one, so large numbers lose no digits.
    first = F.get("parts", F.lit(0))["mean"]
    off = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["n"] * (x["mean"] - first)) / F.col("numbers")
    mean = F.when(F.col("numbers") > 0, first + off)
    merged = merged.withColumn("mean", mean)
    apart = F.aggregate("parts", F.lit(0.0), lambda s, x: s + x["n"] * (x["mean"] - F.col("mean")) * (x["mean"] - F.col("mean")))
    return merged.withColumn("spread", F.col("spread") + apart).select(*keys, *[c for c in sketches.columns if c not in ("doc_id", "col", "column_name")])


def profile_of_sketches(sketches: DataFrame) -> DataFrame:
    """The columns of :func:`column_profile` from sketches; ``unique_values`` is an estimate."""
    std = F.when(F.col("numbers") == 1, F.lit(float("nan"))).when(F.col("numbers") > 1, F.sqrt(F.col("spread") / (F.col("numbers") - 1)))
    return sketches.select(
        *[c for c in sketches.columns if c in ("doc_id", "col", "column_name")], F.col("types").alias("data_types"), F.hll_sketch_estimate("values_sketch").alias("unique_values"), F.col("empties").alias("null_count"),
        F.col("longest").alias("max_length"), F.col("numbers").alias("numeric_count"), "mean", F.col("low").alias("min"), F.col("high").alias("max"), std.alias("std"),
    )
