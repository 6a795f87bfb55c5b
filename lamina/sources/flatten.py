"""Python parsers as table functions: one content in, element rows and one metadata row out."""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..runtime import ship
from ..schema import ELEMENT, PARSED

_TEXT = pa.map_(pa.string(), pa.string())
_ELEMENT = pa.schema(
    [("doc_id", pa.string()), ("pos", pa.int32()), ("element_id", pa.string()), ("element_type", pa.string()), ("content", pa.string()), ("page", pa.int32())]
    + [(c, pa.float64()) for c in ("x0", "y0", "x1", "y1", "confidence")]
    + [("parent_id", pa.string()), ("style", _TEXT), ("metadata", _TEXT)]
)
_PARSED = pa.schema([("doc_id", pa.string()), ("file_type", pa.string()), ("parser_used", pa.string()), ("metadata", _TEXT), ("errors", pa.list_(pa.string()))])


def words(value) -> str:
    """A map value: strings as they are, the rest as JSON."""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)


def _map(values: dict | None) -> list[tuple[str, str]]:
    return [(k, words(v)) for k, v in (values or {}).items() if v is not None]


def element(element_type: str, content: str, x0: float, y0: float, x1: float, y1: float, page: int = 0, confidence: float = 1.0, element_id: str | None = None, style: dict | None = None, metadata: dict | None = None) -> dict:
    return {"element_type": element_type, "content": content, "page": page, "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1), "confidence": float(confidence), "element_id": element_id, "style": style, "metadata": metadata}


def parse_one(parser: Callable, content) -> tuple[list[dict], dict, list[str]]:
    """(elements, metadata, errors); a parser that fails part-way keeps what it had."""
    elements: list[dict] = []
    metadata: dict = {}
    try:
        parser(content, elements, metadata)
        return elements, metadata, []
    except Exception as e:  # noqa: BLE001  any failure becomes the document's error row
        return elements, metadata, [f"{type(e).__name__}: {e}"]


def parsed_elements(docs: DataFrame, parser: Callable, id_col: str, content_col: str) -> DataFrame:
    """The element rows of every document; null contents have none."""
    ship(docs.sparkSession)
    chosen = docs.where(F.col(content_col).isNotNull()).select(F.col(id_col).cast("string").alias("doc_id"), F.col(content_col).alias("content"))

    def run(batches):
        for batch in batches:
            rows: list[dict] = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for pos, e in enumerate(parse_one(parser, content)[0]):
                    rows.append({**e, "doc_id": doc, "pos": pos, "element_id": e["element_id"] or f"{e['element_type']}_{pos}", "style": _map(e["style"]), "metadata": _map(e["metadata"])})
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ELEMENT)
                    rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=_ELEMENT)

    return chosen.mapInArrow(run, ELEMENT)


def parsed_documents(docs: DataFrame, parser: Callable, file_type: str, parser_used: str, id_col: str, content_col: str) -> DataFrame:
    """One row per document with its metadata and errors."""
    ship(docs.sparkSession)
    chosen = docs.select(F.col(id_col).cast("string").alias("doc_id"), F.col(content_col).alias("content"))

    def run(batches):
        for batch in batches:
            rows = []
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                _, metadata, errors = parse_one(parser, content) if content is not None else ([], {}, ["no content"])
                rows.append({"doc_id": doc, "file_type": file_type, "parser_used": parser_used, "metadata": _map(metadata), "errors": errors or None})
            yield pa.RecordBatch.from_pylist(rows, schema=_PARSED)

    return chosen.mapInArrow(run, PARSED)
