"""Large CSV files by ranges: every split of a file is read by a task of its own.

A range may begin inside a quoted field, which only what stands before can tell.
So each range is read for both cases at once: of every line it notes the state
before it and the rows begun so far, if the range begins outside quotes and if
inside; and of the range the state it ends in, which makes it a function of the
state it begins in.  The functions of a file's ranges, one row each, are combined in
order, and each line then takes its case.  Lines of one record are joined where a
record has several; nothing else is grouped.

Spark's text source splits the files and reads the ranges.
"""

from __future__ import annotations

import csv
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..runtime import materialize, ship

_QUOTED = re.compile(r'[^"]*(?:""[^"]*)*')
_LINE = "path string, block long, seq long, line string, s0 int, s1 int, n0 long, n1 long, last boolean"
_KINDS = pa.schema([("path", pa.string()), ("block", pa.int64()), ("seq", pa.int64()), ("line", pa.string()), ("s0", pa.int32()), ("s1", pa.int32()), ("n0", pa.int64()), ("n1", pa.int64()), ("last", pa.bool_())])
#: Cells that leave a task at a time.
CELLS = 50_000


def leaves(line: str, inside: int, delimiter: str) -> int:
    """Whether a line that begins inside a quoted field (1) or at a field's start (0) ends inside one."""
    if '"' not in line:
        return inside
    at = 0
    while True:
        if not inside and line[at : at + 1] == '"':
            at, inside = at + 1, 1
        if inside:
            at = _QUOTED.match(line, at).end()
            if at >= len(line):
                return 1
        at = line.find(delimiter, at) + 1
        if not at:
            return 0
        inside = 0


def split_lines(value: str) -> list[str]:
    """The lines of what stands between two line feeds, each with its end: a lone carriage return ends one too."""
    parts = value.split("\r")
    if len(parts) > 1 and not parts[-1]:
        return [p + "\r" for p in parts[:-2]] + [parts[-2] + "\r\n"]
    return [p + "\r" for p in parts[:-1]] + [parts[-1] + "\n"]


def ranged_lines(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(``_LINE``): the lines of each range with state and rows begun before them, for both states it may begin in; and a row for its end."""
    ship(spark)
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", "true").text(path)
    given = text.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")

    def run(batches):
        key, seq, state, begun, out = None, 0, [0, 1], [0, 0], []

        def end():
            return (*key, seq, None, *state, *begun, True)

        for batch in batches:
            for path, block, value in zip(*[batch.column(k).to_pylist() for k in range(3)]):
                if (path, block) != key:
                    if key:
                        out.append(end())
                    key, seq, state, begun = (path, block), 0, [0, 1], [0, 0]
                for line in split_lines(value):
                    if block == 0 and seq == 0:
                        line = line.removeprefix("﻿")
                    out.append((*key, seq, line, *state, *begun, False))
                    blank = not line.strip("\r\n")
                    begun = [n + (s == 0 and not blank) for n, s in zip(begun, state)]
                    state, seq = [leaves(line, s, delimiter) for s in state], seq + 1
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), _KINDS)], schema=_KINDS) if out else pa.RecordBatch.from_pylist([], schema=_KINDS)
            out = []
        if key:
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(end(), _KINDS)], schema=_KINDS)

    return given.mapInArrow(run, _LINE)


def settled(ends: DataFrame) -> DataFrame:
    """(path, block, entry, base, follows): the state that each range begins in, the rows begun before it, and whether its last record goes on behind it.

    A range either ends in one state whatever it began in, or keeps or turns the
    state; so a range begins in the state of the last range of the first kind,
    turned as often as ranges since then turn it.
    """
    w = Window.partitionBy("path").orderBy("block")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum(F.when((F.col("s0") == 1) & (F.col("s1") == 0), 1).otherwise(0)).over(before), F.lit(0))
    rows = ends.withColumn("turns", turns)
    known = F.last(F.when(F.col("s0") == F.col("s1"), F.struct(F.col("s0").alias("state"), "turns")), ignorenulls=True).over(before)
    rows = rows.withColumn("known", known)
    entry = (F.coalesce("known.state", F.lit(0)) + F.col("turns") - F.coalesce("known.turns", F.lit(0))) % 2
    rows = rows.withColumn("entry", entry.cast("int"))
    begun = F.when(F.col("entry") == 0, F.col("n0")).otherwise(F.col("n1"))
    rows = rows.withColumn("base", F.coalesce(F.sum(begun).over(before), F.lit(0)))
    return rows.select("path", "block", "entry", "base", F.coalesce(F.lead("entry").over(w) == 1, F.lit(False)).alias("follows"))


def csv_records(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """(doc_id, row, record): the records of CSV files that are not blank, as they are written; the path is the document.

    The files are UTF-8.  Fields may hold line ends; quotes inside an unquoted field
    mean nothing.  A quote that is never closed takes the rest of its file.
    """
    lines = materialize(ranged_lines(spark, path, delimiter), "lines")
    known = materialize(settled(lines.where("last").drop("last", "line", "seq")), "ranges")
    rows = lines.join(F.broadcast(known), ["path", "block"])  # a row for each range
    pick = lambda a, b: F.when(F.col("entry") == 0, F.col(a)).otherwise(F.col(b))
    rows = rows.select("path", "block", "seq", "line", "last", "follows", pick("s0", "s1").alias("inside"), (F.col("base") + pick("n0", "n1")).alias("begun"))
    # The last row of a range stands for the first line of the next one.
    after = F.lead("inside").over(Window.partitionBy("path", "block").orderBy("seq", "last"))
    rows = rows.withColumn("goes_on", after == 1).where("not last and (inside = 1 or line rlike '[^\\\\r\\\\n]')")
    rows = rows.withColumn("row", F.col("begun") - F.col("inside"))
    single = rows.where("inside = 0 and not goes_on").select("path", "row", F.col("line").alias("record"))
    several = rows.where("inside = 1 or goes_on").groupBy("path", "row").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "line"))).alias("x"))
    both = single.unionByName(several.select("path", "row", F.array_join(F.transform("x", lambda r: r["line"]), "").alias("record")))
    return both.select(F.col("path").alias("doc_id"), F.col("row").cast("int").alias("row"), "record")


def csv_cells_ranged(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """The cells that :func:`.csv.csv_cells` gives, from files of any size."""
    from .csv import CELL

    records = csv_records(spark, path, delimiter)
    header = records.where("row = 0").select("doc_id", F.col("record").alias("header"))
    rows = records.join(F.broadcast(header), "doc_id").select("doc_id", "row", "record", "header")

    def run(batches):
        csv.field_size_limit(2**31 - 1)
        fields = lambda record: next(csv.reader([record], delimiter=delimiter), [])
        names_of: dict = {}
        kinds = pa.schema([("doc_id", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("column_name", pa.string()), ("value", pa.string()), ("is_header", pa.bool_())])
        for batch in batches:
            out: list[tuple] = []
            for doc, row, record, head in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if doc not in names_of:
                    names_of = {doc: fields(head)}
                names, values = names_of[doc], fields(record)
                values += [""] * (len(names) - len(values))
                out += [(doc, row, c, names[c] if c < len(names) else f"column_{c + 1}", v, row == 0) for c, v in enumerate(values)]
                if len(out) > CELLS:
                    yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out), kinds)], schema=kinds)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*out), kinds)], schema=kinds)

    return rows.mapInArrow(run, CELL)
