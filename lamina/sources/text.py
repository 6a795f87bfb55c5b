"""Plain text: lines, their classes, and code blocks and pipe tables within.

Lines are exploded and classified by JVM expressions; only documents that hold
a fence or a pipe go to Python, for the offsets of blocks and tables.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as fn
from ..runtime import ship

# What a code block and a table of pipes are.
CODE_BLOCK = re.compile(r"```(\w+)?\n(.*?)\n```", re.S)
PIPE_TABLE = re.compile(r"\|.*\|(?:\n\|.*\|)*")
LINE_HEIGHT, CHAR_WIDTH = 20, 8


def _lines(text: Column) -> Column:
    return F.split(fn.newlines(text), "\n", -1)


def classify(line: Column, following: Column) -> Column:
    """The element type of a non-blank line; ``following`` is the next line, null after the last."""
    s, after = fn.strip(line), fn.strip(following)
    underlined = F.coalesce(after.rlike(r"\A(=+|-+|~+|\^+)\z"), F.lit(False))
    numbered = fn.starts_with_digit(s) & F.substring(s, 1, 5).contains(".")
    return (
        F.when(s.startswith("#") | underlined, "heading")
        .when(fn.starts_with_bullet(s) | numbered, "list")
        .when(fn.is_upper(s) & (F.length(s) < 100), "heading")
        .when(s.startswith("```"), "annotation")
        .otherwise("paragraph")
    )


def text_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, line, following) of every line, blank ones too."""
    lines = docs.select(F.col(id_col).alias("doc_id"), _lines(F.col(text_col)).alias("lines"))
    paired = F.transform("lines", lambda x, i: F.struct(x.alias("line"), F.get("lines", i + 1).alias("following")))
    return lines.select("doc_id", F.posexplode(paired).alias("line_no", "x")).select("doc_id", "line_no", "x.line", "x.following")


def line_metadata(lines: DataFrame) -> DataFrame:
    """Facts about each non-blank line."""
    line = F.col("line")
    s = fn.strip(line)
    return lines.where(s != "").select(
        "doc_id",
        (F.col("line_no") + 1).cast("long").alias("line_number"),
        (F.length(line) - F.length(fn.lstrip(line))).cast("long").alias("indent_level"),
        fn.token_count(line).cast("long").alias("word_count"),
        F.length(line).cast("long").alias("character_count"),
        fn.starts_with_digit(s).alias("starts_with_number"),
        fn.starts_with_bullet(s).alias("starts_with_bullet"),
        fn.is_upper(s).alias("is_all_caps"),
    )


def structure_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of line kinds, line lengths and the likely format; one row per document, no shuffle."""
    count = lambda f: F.size(F.filter("lines", f)).cast("long")
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda s, x: s + F.length(x))
    marks, rules = F.size(F.filter("stripped", lambda x: x.startswith("#"))), count(lambda x: x.contains("=") | x.contains("-"))
    rows = docs.select(F.col(id_col).alias("doc_id"), _lines(F.col(text_col)).alias("lines"))
    stripped = lambda f: F.size(F.filter("stripped", f)).cast("long")
    return rows.withColumn("stripped", F.transform("lines", fn.strip)).select(
        "doc_id",
        F.size("lines").cast("long").alias("total_lines"),
        stripped(lambda x: x == "").alias("empty_lines"),
        count(lambda x: x.rlike(r"\A[ \t]")).alias("indented_lines"),
        stripped(fn.starts_with_bullet).alias("bulleted_lines"),
        stripped(fn.starts_with_digit).alias("numbered_lines"),
        stripped(fn.is_upper).alias("all_caps_lines"),
        F.array_max(F.transform("lines", F.length)).cast("long").alias("max_line_length"),
        (total / F.size("lines")).alias("avg_line_length"),
        F.when(marks > 0, "markdown").when(rules > 5, "restructuredtext").otherwise("plain_text").alias("likely_format"),
    )


def line_endings(text: Column) -> Column:
    """CRLF, CR, LF or None, of the text before newlines are unified."""
    return F.when(text.contains("\r\n"), "CRLF").when(text.contains("\r"), "CR").when(text.contains("\n"), "LF").otherwise("None")


def document_metadata(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Totals, line endings and page size (characters 8 wide, lines 20 high)."""
    lines = _lines(F.col(text_col))
    longest = F.coalesce(F.array_max(F.transform(F.filter(lines, lambda x: fn.strip(x) != ""), F.length)), F.lit(0))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.size(lines).cast("long").alias("total_lines"),
        F.length(fn.newlines(F.col(text_col))).cast("long").alias("total_characters"),
        F.lit("utf-8").alias("encoding"),
        line_endings(F.col(text_col)).alias("line_endings"),
        (longest * CHAR_WIDTH).cast("double").alias("page_width"),
        (F.size(lines) * LINE_HEIGHT).cast("double").alias("page_height"),
    )


def special_spans(text: str) -> list[dict]:
    """Code blocks, then pipe tables, with their boxes."""
    found = []
    for m in CODE_BLOCK.finditer(text):
        body, above = m.group(2), text.count("\n", 0, m.start())
        found.append({"element_type": "annotation", "content": body, "width": max(map(len, body.split("\n"))), "top": above, "bottom": above + body.count("\n"), "metadata": {"structure_type": "code_block", "language": m.group(1) or "unknown"}})
    for m in PIPE_TABLE.finditer(text):
        rows, above = m.group(0).split("\n"), text.count("\n", 0, m.start())
        found.append({"element_type": "table", "content": m.group(0), "width": max(map(len, rows)), "top": above, "bottom": above + len(rows), "metadata": {"structure_type": "markdown_table", "rows": str(len(rows)), "columns": str(rows[0].count("|") - 1)}})
    return found


def special_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, element_type, content, width, top, bottom, metadata) of code blocks and pipe tables."""
    return _special(docs, id_col, text_col).drop("held")


def may_be_special(text: Column) -> Column:
    """Whether a text can hold a code block or a table; false for null."""
    return F.coalesce(text.contains("```") | text.contains("|"), F.lit(False))


def _special(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The same with ``held``, the number of the text's non-blank lines."""
    ship(docs.sparkSession)
    held = F.size(F.filter(_lines(F.col(text_col)), lambda x: fn.strip(x) != ""))
    chosen = docs.where(may_be_special(F.col(text_col))).select(F.col(id_col).alias("doc_id"), fn.newlines(F.col(text_col)).alias("text"), held.alias("held"))
    id_type = chosen.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = []
            for doc, text, held in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                rows += [{"doc_id": doc, "n": n, **x, "metadata": list(x["metadata"].items()), "held": held} for n, x in enumerate(special_spans(text))]
            kind = pa.schema([("doc_id", batch.schema.field(0).type), ("n", pa.int32()), ("element_type", pa.string()), ("content", pa.string()), ("width", pa.int32()), ("top", pa.int32()), ("bottom", pa.int32()), ("metadata", pa.map_(pa.string(), pa.string())), ("held", pa.int32())])
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return chosen.mapInArrow(run, f"doc_id {id_type}, n int, element_type string, content string, width int, top int, bottom int, metadata map<string,string>, held int")


def text_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", special: bool = True) -> DataFrame:
    """Elements of text documents: a row for each non-blank line, then those of code blocks and tables.

    The text of a block or table is thus in two kinds of rows; ``special=False``
    leaves the lines alone.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), _lines(F.col(text_col)).alias("lines"))
    paired = F.filter(
        F.transform("lines", lambda x, i: F.struct(x.alias("line"), fn.strip(x).alias("s"), F.get("lines", i + 1).alias("following"), i.alias("line_no"))),
        lambda x: x["s"] != "",
    )
    rows = rows.select("doc_id", F.posexplode(paired).alias("pos", "x")).select("doc_id", "pos", "x.*")
    s = F.col("s")
    text = lambda c: c.cast("string")
    facts = F.create_map(
        F.lit("line_number"), text(F.col("line_no") + 1), F.lit("indent_level"), text(F.length("line") - F.length(fn.lstrip(F.col("line")))),
        F.lit("word_count"), text(fn.token_count(F.col("line"))), F.lit("character_count"), text(F.length("line")),
        F.lit("starts_with_number"), text(fn.starts_with_digit(s)), F.lit("starts_with_bullet"), text(fn.starts_with_bullet(s)), F.lit("is_all_caps"), text(fn.is_upper(s)),
    )
    lines = rows.select(
        "doc_id", F.col("pos").cast("int").alias("pos"), classify(s, F.col("following")).alias("element_type"), F.col("line").alias("content"),
        F.lit(0.0).alias("x0"), (F.col("line_no") * LINE_HEIGHT).cast("double").alias("y0"), (F.length("line") * CHAR_WIDTH).cast("double").alias("x1"), ((F.col("line_no") + 1) * LINE_HEIGHT).cast("double").alias("y1"), facts.alias("metadata"),
    )
    if special:
        more = _special(docs, id_col, text_col).select(
            "doc_id", (F.col("held") + F.col("n")).cast("int").alias("pos"), "element_type", "content", F.lit(0.0).alias("x0"), (F.col("top") * LINE_HEIGHT).cast("double").alias("y0"),
            (F.col("width") * CHAR_WIDTH).cast("double").alias("x1"), (F.col("bottom") * LINE_HEIGHT).cast("double").alias("y1"), "metadata",
        )
        lines = lines.unionByName(more)
    return finish(lines)


def ordered_text_elements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text_elements`` with their reading order, ro_pos.

    Lines stand one below the other, so where a document is one row without blocks
    and tables, its order is that of its lines and nothing is shuffled.  Rows that
    share an id (or have none) are one document; those are put in order by place.
    """
    from ..operators.layout import reading_order

    own = F.col(id_col)
    shared = docs.groupBy(own).agg(F.count("*").alias("n")).where((F.col("n") > 1) & own.isNotNull()).select(own)
    placed = may_be_special(F.col(text_col)) | own.isNull()
    alone, others = docs.where(~placed), docs.where(placed)
    if not shared.isEmpty():
        alone, others = alone.join(shared, id_col, "left_anti"), others.unionByName(alone.join(shared, id_col, "left_semi"))
    lines = text_elements(alone, id_col, text_col, special=False).withColumn("ro_pos", F.col("pos"))
    return lines.unionByName(reading_order(text_elements(others, id_col, text_col)))


def finish(elements: DataFrame) -> DataFrame:
    """Fill what a source leaves out, in the order of the element table."""
    empty = F.create_map().cast("map<string,string>")
    given = set(elements.columns)
    columns = {
        "doc_id": F.col("doc_id").cast("string"), "pos": F.col("pos"), "element_id": F.concat_ws("_", "element_type", F.col("pos").cast("string")), "element_type": F.col("element_type"), "content": F.col("content"),
        "page": F.lit(0), "x0": F.col("x0"), "y0": F.col("y0"), "x1": F.col("x1"), "y1": F.col("y1"), "confidence": F.lit(1.0), "parent_id": F.lit(None).cast("string"), "style": empty, "metadata": empty,
    }
    optional = {"element_id", "page", "confidence", "parent_id", "style", "metadata"}
    return elements.select(*[(F.col(k) if k in given and k in optional else v).alias(k) for k, v in columns.items()])
