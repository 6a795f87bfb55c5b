"""XML: a pre-order walk of the tree with boxes by depth, and analyses of its rows."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame, Window, functions as F

from .flatten import element, parsed_documents, parsed_elements

# Local tag -> element type.
TAG_TYPES = {
    "heading": ("title", "header", "h1", "h2", "h3", "h4", "h5", "h6", "heading"),
    "paragraph": ("p", "paragraph", "text", "description", "summary"),
    "table": ("table", "grid", "matrix"),
    "image": ("img", "image", "picture", "graphic"),
    "list": ("list", "ul", "ol", "items"),
    "annotation": ("annotation", "comment", "note"),
    "footer": ("footer", "bottom"),
    "sidebar": ("sidebar", "aside"),
    "caption": ("caption", "label"),
    "formula": ("formula", "equation", "math"),
}
TYPE_OF = {tag: kind for kind, tags in TAG_TYPES.items() for tag in tags}
# Root tag -> document type.
ROOT_TYPES = {"svg": "svg", "rss": "rss", "feed": "atom", "schema": "xsd", "xsd": "xsd", "stylesheet": "xslt", "transform": "xslt", "html": "xhtml", "xhtml": "xhtml", "configuration": "config", "config": "config", "pom": "maven", "project": "maven", "beans": "spring"}
# Attributes that stand for a missing text, in order.
NAMING = ("name", "id", "title", "value", "href", "src")
# Types that some document types give to tags (lower case).
RETYPED = {
    "feed": {"title": "heading", "name": "heading", "description": "paragraph", "summary": "paragraph", "content": "paragraph", "link": "annotation", "url": "annotation"},
    "xsd": {"element": "annotation", "attribute": "annotation", "complextype": "heading", "simpletype": "heading", "documentation": "caption", "annotation": "caption"},
}
SHAPES = ("rect", "circle", "ellipse", "line", "polyline", "polygon", "path")


def local(tag: str) -> str:
    return tag.rpartition("}")[2] if tag.startswith("{") else tag


def uri(tag: str) -> str | None:
    return tag[1:].partition("}")[0] if tag.startswith("{") else None


def namespaces(root) -> dict[str, str]:
    """ns0, ns1, ... in the order in which tags use them; prefixes aren't in the tree."""
    found: dict[str, str] = {}
    for e in root.iter():
        u = uri(e.tag) if isinstance(e.tag, str) else None
        if u is not None and u not in found.values():
            found[f"ns{len(found)}"] = u
    return found


def declaration(content: str) -> dict[str, str]:
    head = re.search(r"<\?xml\s+([^?]+)\?>", content)
    out = {}
    for name, key in (("version", "xml_version"), ("encoding", "encoding"), ("standalone", "standalone")):
        m = head and re.search(rf"{name}\s*=\s*[\"']([^\"']+)[\"']", head.group(1))
        if m:
            out[key] = m.group(1)
    return out


def content_of(e) -> str:
    tag, text = local(e.tag), (e.text or "").strip()
    named = next((f"{tag}: {e.attrib[a]}" for a in NAMING if a in e.attrib), None)
    return text or named or (f"<{tag}> ({len(e)} children)" if len(e) else f"<{tag}>")


def document_type(root) -> str:
    return ROOT_TYPES.get(local(root.tag).lower()) or ("android" if "namespace" in root.attrib and "android" in str(root.attrib.values()) else "generic")


def _retype(kind: str, e, tag: str, box: tuple, given: str) -> tuple[str, tuple]:
    if kind == "svg" and tag in SHAPES:
        try:
            x, y = float(e.attrib["x"]), float(e.attrib["y"])
            box = (x, y, x + float(e.attrib.get("width", 50)), y + float(e.attrib.get("height", 50)))
        except (KeyError, ValueError):
            pass
        return "image", box
    table = RETYPED.get("feed" if kind in ("rss", "atom") else kind, {})
    return table.get(tag.lower(), given), box


def parse(content: str | bytes, elements: list[dict], metadata: dict) -> None:
    root = ET.fromstring(content)
    text = content if isinstance(content, str) else content.decode("utf-8", "replace")
    spaces, kind = namespaces(root), document_type(root)
    prefix = {u: p for p, u in spaces.items()}
    every = list(root.iter())
    metadata.update({"root_tag": root.tag, "namespaces": spaces, "total_elements": len(every), "file_size": len(text), "encoding": "utf-8", "xml_version": "1.0", "unique_tags": len({e.tag for e in every}), "attributes_count": sum(len(e.attrib) for e in every), "text_nodes": sum(bool(e.text and e.text.strip()) for e in every), "xml_type": kind})
    metadata.update(declaration(text))
    deepest, number = 0, 0
    # A frame's children start below the lowest box of the child before; an explicit stack, as trees may be deep.
    stack = [("open", root, 0, 0)]
    y_of: list[float] = [0.0]
    lows: list[float] = []
    while stack:
        what, e, depth, x = stack.pop()
        if what == "close":
            low = lows.pop()
            y_of[-1] = low + 5
            if lows:
                lows[-1] = max(lows[-1], low)
            continue
        if not isinstance(e.tag, str):  # comments and instructions
            continue
        deepest, y, tag, value = max(deepest, depth), y_of[-1], local(e.tag), content_of(e)
        high = 20 + 5 * depth
        box = (x, y, x + max(200, 8 * len(value)), y + high)
        lowest = box[3]
        given, placed = _retype(kind, e, tag, box, TYPE_OF.get(tag.lower(), "text"))
        number += 1
        style = {"tag_name": tag, "depth": depth, "attributes": dict(e.attrib), "namespace": prefix.get(uri(e.tag)), "has_children": len(e) > 0, "has_text": bool(e.text and e.text.strip())}
        facts = {"xpath": f"//{tag}", "tag_full": e.tag, "tag_local": tag, "attributes": dict(e.attrib), "namespace_uri": uri(e.tag), "depth": depth, "child_count": len(e), "text_content": (e.text or "").strip(), "tail_content": (e.tail or "").strip()}
        elements.append(element(given, value, *placed, element_id=f"xml_element_{number}", style=style, metadata=facts))
        below = y + high + 5
        for name, v in e.attrib.items():
            number += 1
            facts = {"attribute_name": name, "attribute_value": v, "parent_tag": tag, "depth": depth + 1}
            style = {"attribute_name": name, "attribute_value": v, "depth": depth + 1, "is_attribute": True}
            wide = max(200, 8 * len(f"{name}={v}"))
            elements.append(element("annotation", f"@{name}={v}", x + 20, below, x + 20 + wide, below + 20, element_id=f"xml_attr_{number}", style=style, metadata=facts))
            lowest, below = max(lowest, below + 20), below + 25
        lows.append(lowest)
        y_of[-1] = below
        stack.append(("close", e, depth, x))
        stack += [("open", c, depth + 1, x + 30) for c in reversed(list(e))]
    metadata["depth"] = deepest


def xml_elements(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    return parsed_elements(docs, parse, id_col, xml_col)


def xml_documents(docs: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    return parsed_documents(docs, parse, "xml", "xml_tree", id_col, xml_col)


def xml_reading_order(elements: DataFrame) -> DataFrame:
    """Level order: by depth, then y, then x."""
    w = Window.partitionBy("doc_id").orderBy(F.col("style")["depth"].cast("int"), "y0", "x0", "pos")
    return elements.withColumn("ro_pos", (F.row_number().over(w) - 1).cast("int"))


def by_tag(elements: DataFrame, pattern: str) -> DataFrame:
    """Elements of a tag for '//tag'; other patterns give none."""
    tag = pattern[2:] if pattern.startswith("//") else None
    return elements.where(F.col("style")["tag_name"] == F.lit(tag))


def by_namespace(elements: DataFrame, prefix: str) -> DataFrame:
    return elements.where(F.col("style")["namespace"] == prefix)


def by_attribute(elements: DataFrame, name: str, value: str | None = None) -> DataFrame:
    """Elements that have an attribute, or have it with a value."""
    held = F.from_json(F.col("metadata")["attributes"], "map<string,string>")
    return elements.where(F.coalesce(F.map_contains_key(held, name) if value is None else held[name] == value, F.lit(False)))


def proximity_children(elements: DataFrame) -> DataFrame:
    """(doc_id, parent_id, child_id): children by place, one level deeper, right of and at most 200 below."""
    rows = elements.select("doc_id", "element_id", "pos", "x0", "y0", "y1", F.col("style")["depth"].cast("int").alias("depth"))
    p, c = rows.alias("p"), rows.alias("c")
    near = (F.col("c.doc_id") == F.col("p.doc_id")) & (F.col("c.depth") == F.col("p.depth") + 1)
    near &= (F.col("c.y0") > F.col("p.y0")) & (F.col("c.x0") > F.col("p.x0")) & (F.col("c.y0") < F.col("p.y1") + 200)
    return p.join(c, near).select("p.doc_id", F.col("p.element_id").alias("parent_id"), F.col("c.element_id").alias("child_id"))


def xml_schema(elements: DataFrame, children: DataFrame | None = None) -> DataFrame:
    """Per document and tag: count, attribute names, child tags and namespaces, sorted."""
    rows = elements.where(F.col("style")["tag_name"].isNotNull())
    names = F.map_keys(F.from_json(F.col("metadata")["attributes"], "map<string,string>"))
    tagged = rows.select("doc_id", "element_id", F.col("style")["tag_name"].alias("tag"), names.alias("names"), F.col("style")["namespace"].alias("namespace"))
    per = tagged.groupBy("doc_id", "tag").agg(
        F.count("*").alias("count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("attributes"), F.array_sort(F.collect_set("namespace")).alias("namespaces"),
    )
    edges = proximity_children(elements) if children is None else children
    below = edges.join(tagged.select("doc_id", F.col("element_id").alias("parent_id"), F.col("tag").alias("parent_tag")), ["doc_id", "parent_id"])
    below = below.join(tagged.select("doc_id", F.col("element_id").alias("child_id"), F.col("tag").alias("child_tag")), ["doc_id", "child_id"])
    kids = below.groupBy("doc_id", F.col("parent_tag").alias("tag")).agg(F.array_sort(F.collect_set("child_tag")).alias("children"))
    return per.join(kids, ["doc_id", "tag"], "left").withColumn("children", F.coalesce("children", F.array().cast("array<string>")))


def attribute_counts(elements: DataFrame) -> DataFrame:
    """(doc_id, attribute, count) over the documents' elements."""
    names = F.map_keys(F.from_json(F.col("metadata")["attributes"], "map<string,string>"))
    return elements.where(F.col("style")["tag_name"].isNotNull()).select("doc_id", F.explode(names).alias("attribute")).groupBy("doc_id", "attribute").agg(F.count("*").alias("count"))
