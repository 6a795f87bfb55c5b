"""Sinks: parsed documents and chunks as JSON, layouts as JSON or HTML."""

from __future__ import annotations

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize, ship
from . import layout

STYLE = (
    "body { font-family: sans-serif } .document { padding: 1em } .page { position: relative; outline: 1px solid silver } "
    ".element { position: absolute; outline: 1px solid gray; background: #8882 } .heading { background: #c004 } .table { background: #00c4 } .image { background: #cc04 }"
)


def _box():
    return F.struct("x0", "y0", "x1", "y1", "page").alias("bbox")


def positioned(documents: DataFrame, elements: DataFrame) -> DataFrame:
    """One row per document: its facts, layout analysis, sections, elements and reading order, for JSON."""
    ordered = layout.reading_order(elements)
    items = F.struct("pos", F.col("element_id").alias("id"), F.col("element_type").alias("type"), "content", _box(), "style", "confidence", "metadata")
    held = ordered.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ro_pos", "element_id"))).alias("ro"), F.collect_list(items).alias("elements"))
    held = held.select("doc_id", F.array_sort("elements", lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0)).alias("elements"), F.transform("ro", lambda x: x["element_id"]).alias("reading_order"))
    parts = layout.sections(ordered).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "title", "content"))).alias("sections"))
    out = documents.join(layout.titles(elements), "doc_id", "left").join(layout.layout_analysis(elements), "doc_id", "left").join(parts, "doc_id", "left")
    return out.join(held, "doc_id", "left")


def write_json(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, a file for each partition."""
    rows.write.mode(mode).json(path)


def json_column(rows: DataFrame) -> DataFrame:
    """(doc_id, json): each row as one JSON object."""
    return rows.select("doc_id", F.to_json(F.struct(*rows.columns)).alias("json"))


def write_files(rows: DataFrame, folder: str, ending: str, folders: int = 1) -> DataFrame:
    """Write each (doc_id, json) to ``<folder>/<stem of the id><ending>``; returns the written (doc_id, file).

    A stem that several ids share is followed by a hash of the id.  Files are
    written under a name of the task's attempt and renamed, so none is partial.
    With several ``folders`` they are spread over as many, numbered below the given one.
    """
    spark = ship(rows.sparkSession)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    folder = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(at).toString()
    stem = F.regexp_replace(F.regexp_replace(F.regexp_replace("doc_id", r"^.*/", ""), r"\.[^.]*$", ""), r"[^\p{L}\p{N}._ -]", "_")
    named = rows.select("doc_id", "json", F.substring(stem, 1, 100).alias("stem"))
    shared = named.groupBy("stem").agg(F.countDistinct("doc_id").alias("n")).where("n > 1").select("stem", F.lit(True).alias("shared"))
    named = named.join(shared, "stem", "left")
    name = F.concat("stem", F.when(F.col("shared"), F.concat(F.lit("_"), F.substring(F.md5("doc_id"), 1, 12))).otherwise(F.lit("")), F.lit(ending))
    below = F.lit("") if folders < 2 else F.concat(F.pmod(F.xxhash64("doc_id"), F.lit(folders)).cast("string"), F.lit("/"))

    def run(batches):
        context, places = TaskContext.get(), {}
        for batch in batches:
            out = []
            for doc, text, file, sub in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if sub not in places:
                    places[sub] = pafs.FileSystem.from_uri(f"{folder}/{sub}".rstrip("/"))
                    places[sub][0].create_dir(places[sub][1], recursive=True)
                files, path = places[sub]
                mine = f"{path}/.{file}.{context.taskAttemptId()}"
                with files.open_output_stream(mine) as sink:
                    sink.write(text.encode())
                files.move(mine, f"{path}/{file}")
                out.append({"doc_id": doc, "file": f"{folder}/{sub}{file}"})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("doc_id", pa.string()), ("file", pa.string())]))

    return materialize(named.select(F.col("doc_id").cast("string"), "json", name.alias("name"), below.alias("below")).mapInArrow(run, "doc_id string, file string"), "files")


def escaped(text):
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("'", "&#39;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def html_pages(elements: DataFrame) -> DataFrame:
    """(doc_id, html): every page's boxes at half scale, texts escaped and cut at 50 characters."""
    half = lambda c: F.concat((F.col(c) if isinstance(c, str) else c).cast("double").__mul__(0.5).cast("string"), F.lit("px"))
    title = F.when(F.length("content") > 50, F.concat(F.left("content", F.lit(50)), F.lit("..."))).otherwise(F.col("content"))
    div = F.concat(
        F.lit("<div class='element "), "element_type", F.lit("' style='left: "), half("x0"), F.lit("; top: "), half("y0"), F.lit("; width: "), half(F.col("x1") - F.col("x0")), F.lit("; height: "), half(F.col("y1") - F.col("y0")), F.lit(";' title='"), escaped(title), F.lit("'></div>"),
    )
    pages = elements.groupBy("doc_id", "page").agg(F.max("x1").alias("w"), F.max("y1").alias("h"), F.array_sort(F.collect_list(F.struct("pos", div.alias("div")))).alias("d"))
    body = F.concat(F.lit("<div class='page' style='width: "), half("w"), F.lit("; height: "), half("h"), F.lit(";'>\n<h3>Page "), (F.col("page") + 1).cast("string"), F.lit("</h3>\n"), F.array_join(F.transform("d", lambda x: x["div"]), "\n"), F.lit("\n</div>"))
    docs = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", body.alias("body")))).alias("p"))
    head = f"<!DOCTYPE html>\n<html><head>\n<title>Document layout</title>\n<style>{STYLE}</style>\n</head><body>\n<div class='document'>\n<h2>"
    return docs.select("doc_id", F.concat(F.lit(head), escaped(F.col("doc_id")), F.lit("</h2>\n"), F.array_join(F.transform("p", lambda x: x["body"]), "\n"), F.lit("\n</div>\n</body></html>")).alias("html"))
