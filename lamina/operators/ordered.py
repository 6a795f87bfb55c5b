"""Rows of whole documents, in order, as Arrow batches: for folds that need one row after the other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def sorted_documents(rows: DataFrame, *order: str, dealt: bool = False) -> DataFrame:
    """``rows`` dealt by doc_id (unless they are), each partition sorted by it and ``order``: one shuffle."""
    return (rows if dealt else rows.repartition("doc_id")).sortWithinPartitions("doc_id", *order)


def whole_documents(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that end where a document does; ``at``: the id's column."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(at).to_pylist()
        start = len(ids) - 1
        while start and ids[start - 1] == ids[-1]:
            start -= 1
        if held and (start or held[-1].column(at)[0].as_py() != ids[0]):
            yield _one(held + ([batch.slice(0, start)] if start else []))
            held = []
        elif start:
            yield batch.slice(0, start)
        held.append(batch.slice(start))
    if held:
        yield _one(held)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def spans(ids: list) -> Iterator[tuple[int, int]]:
    """(start, stop) of each run of equal ids."""
    start = 0
    for k in range(1, len(ids) + 1):
        if k == len(ids) or ids[k] != ids[start]:
            yield start, k
            start = k
