"""JSON: a pre-order walk of the value, objects in their own key order."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import DataFrame, functions as F

from .flatten import element, parsed_documents, parsed_elements

INDENT, STEP, HEIGHT, CHAR = 20, 25, 20, 8


def walk(value, key: str = "", depth: int = 0):
    """(key, value, depth) of every node in pre-order, without recursion."""
    stack = [(key, value, depth)]
    while stack:
        k, v, d = stack.pop()
        yield k, v, d
        if isinstance(v, dict):
            stack += [(name, item, d + 1) for name, item in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"[{i}]", v[i], d + 1) for i in range(len(v) - 1, -1, -1)]


def structure(value) -> dict:
    """Depth, key and value counts, types and array sizes.

    A primitive that is an object's value counts twice among the types (as its
    parent's value and as itself), one in an array once, a container only as an
    object's value; the totals count object values.
    """
    depth, keys, values, kinds, sizes = 0, 0, 0, Counter(), []
    for _, v, d in walk(value):
        depth = max(depth, d)
        if isinstance(v, dict):
            keys, values = keys + len(v), values + len(v)
            kinds.update(type(x).__name__ for x in v.values())
        elif isinstance(v, list):
            sizes.append(len(v))
        else:
            kinds[type(v).__name__] += 1
    return {"max_depth": depth, "total_keys": keys, "total_values": values, "data_types": dict(kinds), "array_sizes": sizes}


def parse(content: str, elements: list[dict], metadata: dict) -> None:
    value = json.loads(content)
    metadata.update(structure(value))
    metadata.update({"file_size": len(content), "is_array": isinstance(value, list), "is_object": isinstance(value, dict)})
    y = 0
    for key, v, depth in walk(value):
        x = depth * INDENT
        if isinstance(v, (dict, list)):
            if not key:
                continue
            kind, sign, size = ("object_key", "{", "object_size") if isinstance(v, dict) else ("array_key", "[", "array_size")
            facts = {"json_type": kind, "key": key, "depth": depth, size: len(v)}
            elements.append(element("heading", f"{key}: {sign}", x, y, x + len(key) * CHAR + 20, y + HEIGHT, metadata=facts))
        else:
            text = f"{key}: {json.dumps(v)}" if key else str(v)
            facts = {"json_type": "primitive", "key": key, "value": json.dumps(v), "value_type": type(v).__name__, "depth": depth}
            elements.append(element("text", text, x, y, x + len(text) * CHAR, y + HEIGHT, metadata=facts))
        y += STEP


def json_elements(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    return parsed_elements(docs, parse, id_col, json_col)


def json_documents(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    return parsed_documents(docs, parse, "json", "json_walk", id_col, json_col)


def json_structure(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """Structure statistics as columns."""
    facts = F.col("metadata")
    return json_documents(docs, id_col, json_col).select(
        "doc_id", *[facts[c].cast("long").alias(c) for c in ("max_depth", "total_keys", "total_values", "file_size")],
        F.from_json(facts["data_types"], "map<string,long>").alias("data_types"), F.from_json(facts["array_sizes"], "array<long>").alias("array_sizes"),
        *[facts[c].cast("boolean").alias(c) for c in ("is_array", "is_object")],
    )
