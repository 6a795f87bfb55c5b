"""Files of every kind: scan, dispatch by suffix, parse; failures become error rows."""

from __future__ import annotations

import codecs
import gc
import mimetypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..runtime import materialize, scratch, settings, ship
from ..schema import ELEMENT, PARSED
from . import binary, html, json, office, text, xml
from .csv import csv_cells, csv_elements, csv_rows, sniff
from .flatten import _ELEMENT, _PARSED, _map, parse_one
from .ranges import csv_cells_ranged

# Suffixes of each type, in the order of dispatch.
SUFFIXES = {
    "pdf": (".pdf",),
    "word": (".docx", ".doc"),
    "html": (".html", ".htm"),
    "image": (".png", ".jpg", ".jpeg", ".tiff", ".bmp", ".gif"),
    "excel": (".xlsx", ".xls", ".xlsm"),
    "text": (".txt", ".md", ".rst"),
    "json": (".json",),
    "xml": (".xml", ".xsd", ".xsl", ".xslt", ".svg", ".rss", ".atom"),
    "csv": (".csv",),
}


def file_type(path: Column) -> Column:
    """The type a path's suffix says, in lower case; 'unsupported' otherwise."""
    low, out = F.lower(path), None
    for kind, suffixes in SUFFIXES.items():
        hit = low.rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + r")\z")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("unsupported")


def encoding(content: Column) -> Column:
    """A guess at the encoding of bytes: by a byte-order mark, else utf-8 if they are valid, else latin-1 (as :func:`decode` reads them)."""
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head == "EFBBBF", "utf-8-sig").when(head.startswith("FFFE"), "utf-16-le").when(head.startswith("FEFF"), "utf-16-be")
        .when(F.is_valid_utf8(content.cast("string")), "utf-8").otherwise("latin-1")
    )


def _found(spark: SparkSession, path: str | list[str], glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, file_type, length, content) of files that hold anything, hidden names left out: Spark's file source passes over empty ones."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    rows = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return rows.where(~_name().startswith(".")).select("path", file_type(F.col("path")).alias("file_type"), "length", "content")


def _name() -> Column:
    return F.element_at(F.split("path", "/"), -1)


def _listed(found: DataFrame) -> DataFrame:
    """(path, file_type) of all files of a scan, empty ones too, from the listing that Spark made for it."""
    spark, path = found.sparkSession, F.url_decode(F.replace(F.col("value"), F.lit("+"), F.lit("%2B")))
    jvm = spark.sparkContext._jvm
    # The names stay in the JVM: Python would fetch them one by one.
    names = spark._jsparkSession.createDataset(jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(found._jdf.inputFiles()), jvm.org.apache.spark.sql.Encoders.STRING()).toDF()
    rows = DataFrame(names, spark).select(_same(path).alias("path")).where(~_name().startswith("."))
    return rows.select("path", file_type(F.col("path")).alias("file_type"))


def _same(path: Column) -> Column:
    """Local paths are written with one slash or three."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def scan(spark: SparkSession, path: str, glob: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, file_type, length, content) of the files below a folder, hidden names left out; contents are read only if used."""
    found = _found(spark, path, glob, recursive)
    empty = _listed(found).join(found.select(_same(F.col("path")).alias("path")), "path", "left_anti")
    return found.unionByName(empty.select("path", "file_type", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content")))


def scan_pdf(spark: SparkSession, path: str) -> DataFrame:
    return scan(spark, path).where(F.col("file_type") == "pdf")


#: A file-name pattern of the supported types, in any case, so other files' contents are never read.
SUPPORTED = "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in x) for xs in SUFFIXES.values() for x in xs) + "}"


def decode(content: bytes) -> tuple[str, str, str | None]:
    """(text, encoding, error): by a byte-order mark, else UTF-8; what is neither is read as latin-1, with an error."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if content.startswith(mark):
            text = content.decode(name, "replace")
            return text, {codecs.BOM_UTF16_LE: "utf-16-le", codecs.BOM_UTF16_BE: "utf-16-be"}.get(mark, name), "broken characters were replaced" if "\ufffd" in text else None
    try:
        return content.decode("utf-8"), "utf-8", None
    except UnicodeDecodeError as e:
        return content.decode("latin-1"), "latin-1", f"not UTF-8 (byte {e.start}), read as latin-1"


def _word(content: bytes, elements: list, metadata: dict) -> None:
    (office.parse_document if content[:2] == b"PK" else office.parse_legacy_document)(content, elements, metadata)


def _excel(content: bytes, elements: list, metadata: dict) -> None:
    (office.parse_workbook if content[:2] == b"PK" else office.parse_legacy_workbook)(content, elements, metadata)


def _image(content: bytes, elements: list, metadata: dict) -> None:
    metadata["file_size"] = len(content)
    binary.parse_image(content, elements, metadata)


def _text_facts(content: str, elements: list, metadata: dict) -> None:
    metadata["total_characters"] = len(content)


def _csv_facts(content: str, elements: list, metadata: dict) -> None:
    metadata.update({**sniff(content), "file_size": len(content)})
    metadata["line_count"] = sum(1 for _ in csv_rows(content, ","))  # raises where the file cannot be read to its end


#: The parser of each type; those of _TEXTS take text, those of _LATER leave its elements to JVM expressions.
PARSERS = {"pdf": binary.parse_pdf, "word": _word, "image": _image, "excel": _excel, "html": html.parse, "json": json.parse, "xml": xml.parse, "text": _text_facts, "csv": _csv_facts}
_TEXTS, _LATER = ("text", "csv", "html", "json"), ("text", "csv")
_ROW = "array<struct<pos:int,element_id:string,element_type:string,content:string,page:int,x0:double,y0:double,x1:double,y1:double,confidence:double,style:map<string,string>,metadata:map<string,string>>>"
FILE = f"{PARSED}, text string, elements {_ROW}"
_FILE = _PARSED.append(pa.field("text", pa.string())).append(pa.field("elements", pa.list_(pa.struct([_ELEMENT.field(n) for n in ("pos", "element_id", "element_type", "content", "page", "x0", "y0", "x1", "y1", "confidence", "style", "metadata")]))))
#: Bytes of content, and elements, that are parsed before rows leave: a small file may hold many elements.
PARSED_BYTES, PARSED_ELEMENTS = 4 << 20, 5_000


def parse_file(path: str, kind: str, content: bytes | None) -> dict:
    """The row of one file: facts, errors, and its text (text, CSV) or elements (all others). Nothing raises."""
    row = {"doc_id": path, "file_type": kind, "parser_used": kind, "text": None, "elements": []}
    if kind not in PARSERS:
        return row | {"parser_used": None, "metadata": _map({"mime_type": mimetypes.guess_type(path)[0]}), "errors": [f"no parser for {path}"]}
    if content is None:
        return row | {"metadata": [], "errors": ["no content"]}
    given, facts, notes = content, {}, []
    if kind in _TEXTS:
        given, facts["encoding"], note = decode(content)
        notes = [note] if note else []
    elements, metadata, errors = parse_one(PARSERS[kind], given)
    if kind == "xml" and errors and not elements:  # bytes of no known encoding, or a wrong declaration
        text, facts["encoding"], note = decode(content)
        again = parse_one(PARSERS[kind], text)
        if not again[2]:
            elements, metadata, errors = again[0], again[1], [note or f"read as {facts['encoding']}: {errors[0]}"]
    rows = [{**e, "pos": n, "element_id": e["element_id"] or f"{e['element_type']}_{n}", "style": _map(e["style"]), "metadata": _map(e["metadata"])} for n, e in enumerate(elements)]
    return row | {"metadata": _map({**metadata, **facts}), "errors": notes + errors or None, "text": given if kind in _LATER else None, "elements": rows}


def parse_files(files: DataFrame) -> DataFrame:
    """(``FILE``) one row for each scanned file: every content is read and parsed once.

    Write the result before using both its documents and its elements.
    """
    ship(files.sparkSession)

    def run(batches):
        for batch in batches:
            rows, size, held = [], 0, 0
            for k in range(batch.num_rows):
                content = batch.column(2)[k].as_py()
                rows.append(parse_file(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), content))
                size, held = size + len(content or b""), held + len(rows[-1]["elements"])
                if size > PARSED_BYTES or held > PARSED_ELEMENTS:
                    yield pa.RecordBatch.from_pylist(rows, schema=_FILE)
                    rows, size, held = [], 0, 0
            yield pa.RecordBatch.from_pylist(rows, schema=_FILE)

    return files.select("path", "file_type", "content").mapInArrow(run, FILE)


def documents_of(parsed: DataFrame) -> DataFrame:
    """(``PARSED``) of parsed files."""
    return parsed.drop("text", "elements")


def elements_of(parsed: DataFrame) -> DataFrame:
    """The element rows of parsed files; a file without content or of no known type has none."""
    texts = lambda kind: parsed.where((F.col("file_type") == kind) & F.col("text").isNotNull()).select("doc_id", "text")
    trees = parsed.where(~F.col("file_type").isin(*_LATER)).select("doc_id", F.explode("elements").alias("e")).select("doc_id", "e.*")
    return text.text_elements(texts("text")).unionByName(csv_elements(csv_cells(texts("csv"), "doc_id", "text"))).unionByName(text.finish(trees))


def file_elements(files: DataFrame) -> DataFrame:
    """Elements of scanned files of every supported type; the path is the document."""
    return elements_of(materialize(parse_files(files), "parsed"))


def file_documents(files: DataFrame) -> DataFrame:
    """One row per scanned file: type, parser, metadata, errors."""
    return documents_of(parse_files(files))


def scan_all(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(path, file_type, content) of all files: contents of supported types (empty ones too), null for others, which are only listed."""
    found = _found(spark, path)
    return _contents(path, found, _listed(found))


def _contents(path: str | list[str], found: DataFrame, listed: DataFrame) -> DataFrame:
    """The same of a scan and its listing; without files of other types no second listing is made."""
    known = found if listed.where(F.col("file_type") == "unsupported").isEmpty() else _found(found.sparkSession, path, SUPPORTED)
    rest = listed.join(known.select(_same(F.col("path")).alias("path")), "path", "left_anti")
    return known.select("path", "file_type", "content").unionByName(rest.select("path", "file_type", F.when(F.col("file_type") != "unsupported", F.lit(b"")).alias("content")))


#: CSV files of more bytes than this are read by ranges.
LARGE_CSV = 64 << 20
#: Files that are listed and parsed at a time, as far as folders divide them: the driver holds an entry for each.
FILES_AT_ONCE = 20_000
#: While parts are read: Spark keeps no listing of theirs for later (in the driver, up to 250 MB), and small files share tasks.
PARTS = {"spark.sql.hive.filesourcePartitionFileCacheSize": "0", "spark.sql.files.openCostInBytes": str(64 << 10)}


def _parts(spark: SparkSession, path: str) -> list[list[str]]:
    """Folders (or names of files) that make up a tree, those of about ``FILES_AT_ONCE`` files together; a folder without others inside stays whole."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return _divided(fs, at, fs.getContentSummary(at)) or [[path]]


def _divided(fs, at, size) -> list[list[str]]:
    if size.getFileCount() <= FILES_AT_ONCE or size.getDirectoryCount() < 2:
        return [[at.toString()]]
    out, held, count = [], [], 0
    found = [(x.isDirectory(), x.getPath()) for x in fs.listStatus(at)]
    for below in (x for folder, x in found if folder and not x.getName().startswith((".", "_"))):
        inside = fs.getContentSummary(below)
        if inside.getFileCount() > FILES_AT_ONCE:
            out += _divided(fs, below, inside)
            continue
        if held and count + inside.getFileCount() > FILES_AT_ONCE:
            out.append(held)
            held, count = [], 0
        held.append(below.toString())
        count += inside.getFileCount()
    own = sorted(x.toString() for folder, x in found if not folder and not x.getName().startswith((".", "_")))
    return [*out, *([held] if held else []), *(own[k : k + FILES_AT_ONCE] for k in range(0, len(own), FILES_AT_ONCE))]


def parse_path(spark: SparkSession, path: str, large_csv: int = LARGE_CSV) -> tuple[DataFrame, DataFrame]:
    """(documents, elements) of one file or folder; a path that does not exist is a document of type 'unknown' with an error.

    A large tree is listed and read part by part, each part once, into one
    temporary table of parsed files.  CSV files of more than ``large_csv`` bytes
    are read by ranges, if they are UTF-8 throughout.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        row = spark.createDataFrame([(path, "unknown", None, {}, [f"no such file: {path}"])], PARSED)
        return row, spark.createDataFrame([], ELEMENT)
    parsed, large = scratch(spark, "parsed"), {}
    with settings(spark, PARTS):
        for part in _parts(spark, path):
            found = _found(spark, part)
            listed = _listed(found)
            own = {} if listed.where(F.col("file_type") == "csv").isEmpty() else _large(found, large_csv)
            rows = _contents(part, found, listed)
            rows = parse_files(rows.where(~F.col("path").isin(list(own))) if own else rows)
            rows.write.mode("append").parquet(parsed)
            large |= own
            kind = rows.schema
            del found, listed, rows
            gc.collect()  # handles of the JVM's objects refer to themselves, and these hold a listing each
    every = spark.read.schema(kind).parquet(parsed)
    documents, elements = documents_of(every), elements_of(every)
    if not large:
        return documents, elements
    more = _ranged(spark, large)
    return documents.unionByName(more[0]), elements.unionByName(more[1])


def _large(found: DataFrame, least: int) -> dict[str, int]:
    """Name and size of the CSV files of a scan that are above ``least`` bytes and UTF-8."""
    big = found.where((F.col("length") > least) & (F.col("file_type") == "csv")).select("path", "length")
    lines = lambda name: found.sparkSession.read.option("lineSep", "\n").text(name)
    return {r["path"]: r["length"] for r in big.collect() if lines(r["path"]).where(~F.is_valid_utf8("value")).isEmpty()}


def _ranged(spark: SparkSession, found: dict[str, int]) -> tuple[DataFrame, DataFrame]:
    """(documents, elements) of large CSV files, given by name and size, that are UTF-8."""
    cells = [materialize(csv_cells_ranged(spark, name), "cells").withColumn("doc_id", F.lit(name)) for name in found]
    every = cells[0]
    for more in cells[1:]:
        every = every.unionByName(more)
    facts = []
    for (name, length), own in zip(found.items(), cells):
        lines = spark.read.option("lineSep", "\n").text(name).select(F.substring("value", 1, 1024)).head(1024)
        sample = "\n".join(r[0] for r in lines).removeprefix("\ufeff")
        mark = "utf-8-sig" if lines and lines[0][0].startswith("\ufeff") else "utf-8"
        rows = own.agg(F.max("row")).first()[0]
        facts.append((name, "csv", "csv", {k: str(v) for k, v in {**sniff(sample), "file_size": length, "line_count": 0 if rows is None else rows + 1, "encoding": mark}.items()}, None))
    return spark.createDataFrame(facts, PARSED), csv_elements(every)
