"""CSV: a long table of cells, and element rows on a 100 x 20 grid.

cells(doc_id, row, col, column_name, value, is_header): row 0 is the header;
values stay as written.  Files are read whole, one record batch at a time.
"""

from __future__ import annotations

import csv
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as fn
from ..runtime import ship
from .text import finish

WIDE, HIGH = 100, 20
CELL = "doc_id string, row int, col int, column_name string, value string, is_header boolean"


def sniff(sample: str) -> dict:
    """Delimiter, quote and whether a header leads, from the first 1024 characters; comma and a header by default."""
    found = {"delimiter": ",", "quotechar": '"', "has_header": True}
    try:
        dialect = csv.Sniffer().sniff(sample[:1024], delimiters=",;\t|")
        found = {"delimiter": dialect.delimiter, "quotechar": dialect.quotechar or '"', "has_header": csv.Sniffer().has_header(sample[:1024])}
    except csv.Error:
        pass
    return found


def csv_rows(content: str, delimiter: str):
    """The rows of a text that are not empty; fields may have any length. Raises csv.Error where the rest cannot be read."""
    csv.field_size_limit(2**31 - 1)
    return (r for r in csv.reader(io.StringIO(content, newline=""), delimiter=delimiter) if r)


def _readable(content: str, delimiter: str):
    """The same up to the first row that cannot be read."""
    try:
        yield from csv_rows(content, delimiter)
    except csv.Error:
        return


def csv_dialects(docs: DataFrame, id_col: str, csv_col: str) -> DataFrame:
    """(doc_id, delimiter, quotechar, has_header, line_count, max_columns) of each file."""
    ship(docs.sparkSession)
    chosen = docs.where(F.col(csv_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), F.col(csv_col).alias("content"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                facts = sniff(content)
                widths = [len(r) for r in _readable(content, facts["delimiter"])]
                rows.append({"doc_id": doc, **facts, "line_count": len(widths), "max_columns": max(widths, default=0)})
            kind = [("doc_id", pa.string()), ("delimiter", pa.string()), ("quotechar", pa.string()), ("has_header", pa.bool_()), ("line_count", pa.int64()), ("max_columns", pa.int64())]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(kind))

    return chosen.mapInArrow(run, "doc_id string, delimiter string, quotechar string, has_header boolean, line_count long, max_columns long")


def csv_cells(docs: DataFrame, id_col: str, csv_col: str, delimiter: str = ",") -> DataFrame:
    """The cells of each file.

    Short rows are filled with empty cells up to the header's width; cells beyond
    it have the column name ``column_<number>``.  A file that cannot be read to
    its end gives the rows before.
    """
    ship(docs.sparkSession)
    chosen = docs.where(F.col(csv_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), F.col(csv_col).alias("content"))

    def run(batches):
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names: list[str] | None = None
                widths, values, begun = [], [], 0
                for row in _readable(content, delimiter):
                    names = row if names is None else names
                    values += row + [""] * (len(names) - len(row))
                    widths.append(max(len(row), len(names)))
                    if len(values) > 50_000:
                        yield _cells(doc, names, begun, widths, values)
                        begun, widths, values = begun + len(widths), [], []
                if widths:
                    yield _cells(doc, names, begun, widths, values)

    return chosen.mapInArrow(run, CELL)


def _cells(doc: str, names: list[str], begun: int, widths: list[int], values: list[str]) -> pa.RecordBatch:
    """Cells of consecutive rows, the first of which has the number ``begun``."""
    n = np.array(widths)
    row, col = np.repeat(np.arange(begun, begun + len(n)), n), np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n)
    every = names + [f"column_{c + 1}" for c in range(len(names), int(n.max()))]
    columns = [pa.array([doc]).take(pa.array(np.zeros(len(values), np.int32))), pa.array(row, type=pa.int32()), pa.array(col, type=pa.int32()), pa.array(every, type=pa.string()).take(pa.array(col)), pa.array(values, type=pa.string()), pa.array(row == 0)]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "col", "column_name", "value", "is_header"])


def table_cells(rows: DataFrame, doc: Column, row: Column, columns: list[str]) -> DataFrame:
    """Cells of the columns of a DataFrame, as if it were a file: no Python, no shuffle; header cells are not made."""
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])
    cells = rows.select(doc.cast("string").alias("doc_id"), row.cast("int").alias("row"), F.posexplode(items).alias("col", "x"))
    return cells.select("doc_id", "row", F.col("col").cast("int").alias("col"), "x.column_name", F.coalesce("x.value", F.lit("")).alias("value"), F.lit(False).alias("is_header"))


def typed(cells: DataFrame) -> DataFrame:
    """Cells with data_type, is_numeric and is_empty; an empty cell's type is string."""
    empty = fn.strip(F.col("value")) == ""
    kind = F.when(empty, "string").otherwise(fn.infer_type(F.col("value")))
    return cells.withColumns({"data_type": kind, "is_numeric": kind.isin("integer", "float"), "is_empty": empty})


def csv_elements(cells: DataFrame, columns_profile: DataFrame | None = None) -> DataFrame:
    """A row element (tab-joined) before its cell elements; header rows are headings; then the table's text, and statistics if given."""
    rows = cells.groupBy("doc_id", "row").agg(
        F.array_sort(F.collect_list(F.struct("col", "value", "column_name"))).alias("cells"), F.max("is_header").alias("is_header"),
    )
    before = F.coalesce(F.sum(F.size("cells") + 1).over(Window.partitionBy("doc_id").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("first", before)
    kind = F.when(F.col("is_header"), "heading").otherwise("text")
    y = F.col("row") * HIGH
    line = F.struct(
        F.col("first").cast("int").alias("pos"), kind.alias("element_type"), F.array_join(F.transform("cells", lambda c: c["value"]), "\t").alias("content"), F.lit(0.0).alias("x0"), y.cast("double").alias("y0"),
        (F.size("cells") * WIDE).cast("double").alias("x1"), (y + HIGH).cast("double").alias("y1"), F.create_map(F.lit("row"), F.col("row").cast("string")).alias("metadata"),
    )
    each = F.transform("cells", lambda c, i: F.struct(
        (F.col("first") + 1 + i).cast("int").alias("pos"), kind.alias("element_type"), c["value"].alias("content"), (c["col"] * WIDE).cast("double").alias("x0"), y.cast("double").alias("y0"),
        ((c["col"] + 1) * WIDE).cast("double").alias("x1"), (y + HIGH).cast("double").alias("y1"),
        F.create_map(F.lit("row"), F.col("row").cast("string"), F.lit("column"), c["col"].cast("string"), F.lit("column_name"), c["column_name"]).alias("metadata"),
    ))
    out = rows.select("doc_id", F.explode(F.concat(F.array(line), each)).alias("e")).select("doc_id", "e.*")
    whole = table_text(cells)
    size = cells.groupBy("doc_id").agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), (F.count("*") + F.countDistinct("row")).alias("n"))
    table = whole.join(size, "doc_id").select(
        "doc_id", F.col("n").cast("int").alias("pos"), F.lit("table").alias("element_type"), F.col("text").alias("content"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"),
        (F.col("n_cols") * WIDE).cast("double").alias("x1"), (F.col("n_rows") * HIGH).cast("double").alias("y1"), F.create_map(F.lit("type"), F.lit("csv_table")).alias("metadata"),
    )
    out = out.unionByName(table)
    if columns_profile is not None:
        data = size.withColumn("data_rows", F.col("n_rows") - 1)
        report = statistics_text(columns_profile, data.select("doc_id", "data_rows", "n_cols")).join(data, "doc_id").select(
            "doc_id", (F.col("n") + 1).cast("int").alias("pos"), F.lit("annotation").alias("element_type"), F.col("report").alias("content"), F.lit(0.0).alias("x0"), (F.col("data_rows") * HIGH + 20).cast("double").alias("y0"),
            (F.col("n_cols") * WIDE).cast("double").alias("x1"), (F.col("data_rows") * HIGH + 200).cast("double").alias("y1"), F.create_map(F.lit("type"), F.lit("statistics")).alias("metadata"),
        )
        out = out.unionByName(report)
    return finish(out)


def table_text(cells: DataFrame) -> DataFrame:
    """(doc_id, text): rows joined by tabs and line feeds, header first."""
    rows = cells.groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("c"))
    rows = rows.select("doc_id", "row", F.array_join(F.transform("c", lambda x: x["value"]), "\t").alias("line"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n").alias("text"))


def statistics_text(profile: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, report): a summary of the column profile in words."""
    # The wording of the report.
    part = F.concat_ws(
        "\n", F.concat(F.lit("Column: "), "column_name"), F.concat(F.lit("  Data types: "), F.array_join("data_types", ", ")), F.concat(F.lit("  Unique values: "), F.col("unique_values").cast("string")),
        F.concat(F.lit("  Null count: "), F.col("null_count").cast("string")), F.concat(F.lit("  Max length: "), F.col("max_length").cast("string")),
        F.when(F.col("numeric_count") > 0, F.concat(F.lit("  Statistics: "), F.to_json(F.struct("mean", "min", "max", "std")))), F.lit(""),
    )
    body = profile.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", part.alias("p")))), lambda x: x["p"]), "\n").alias("body"))
    head = F.concat(F.lit("CSV Statistics:\nDimensions: "), F.col("data_rows").cast("string"), F.lit(" rows × "), F.col("n_cols").cast("string"), F.lit(" columns\n\n"))
    return body.join(sizes, "doc_id").select("doc_id", F.concat(head, "body").alias("report"))


def csv_reading_order(elements: DataFrame) -> DataFrame:
    """ro_pos over text, heading and table rows by (y0, x0, pos); others have none."""
    w = Window.partitionBy("doc_id").orderBy("y0", "x0", "pos")
    read = elements.where(F.col("element_type").isin("text", "heading", "table")).withColumn("ro_pos", (F.row_number().over(w) - 1).cast("int"))
    rest = elements.where(~F.col("element_type").isin("text", "heading", "table")).withColumn("ro_pos", F.lit(None).cast("int"))
    return read.unionByName(rest)


def csv_metadata(cells: DataFrame) -> DataFrame:
    """(doc_id, rows, columns, column_names, page_width, page_height)."""
    per = cells.groupBy("doc_id").agg((F.max("row") - F.max(F.col("is_header").cast("int")) + 1).cast("long").alias("rows"), (F.max("col") + 1).cast("long").alias("columns"), F.array_sort(F.collect_set(F.struct("col", "column_name"))).alias("names"))
    return per.select("doc_id", "rows", "columns", F.transform("names", lambda x: x["column_name"]).alias("column_names"), (F.col("columns") * WIDE).cast("double").alias("page_width"), ((F.col("rows") + 1) * HIGH).cast("double").alias("page_height"))
