"""Office files from their zip and XML parts: .xlsx / .xlsm workbooks and .docx texts.

Nothing beyond the standard library is needed.  Legacy .xls and .doc files give
an error row, .xls only where its optional reader is missing.
"""

from __future__ import annotations

import io
import json
import re
import zipfile
import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame

from .flatten import element, parsed_documents, parsed_elements

S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
CORE = {"title": "{http://purl.org/dc/elements/1.1/}title", "author": "{http://purl.org/dc/elements/1.1/}creator", "created": "{http://purl.org/dc/terms/}created", "modified": "{http://purl.org/dc/terms/}modified"}
WIDE, HIGH = 100, 20


def column_number(letters: str) -> int:
    n = 0
    for c in letters:
        n = n * 26 + ord(c) - 64
    return n


def _part(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _joined(node, tag: str) -> str:
    return "".join(t.text or "" for t in node.iter(tag))


def sheets(z: zipfile.ZipFile):
    """(name, sheet tree) in workbook order, and the active sheet's name."""
    book, rels = _part(z, "xl/workbook.xml"), _part(z, "xl/_rels/workbook.xml.rels")
    target = {r.get("Id"): r.get("Target") for r in rels}
    found = []
    for s in book.iter(f"{S}sheet"):
        path = target[s.get(f"{R}id")].lstrip("/")
        found.append((s.get("name"), _part(z, path if path.startswith("xl/") else f"xl/{path}")))
    view = book.find(f".//{S}workbookView")
    active = int(view.get("activeTab", 0)) if view is not None else 0
    return found, found[active][0] if found else None


def cell_value(cell, strings: list[str]):
    kind, v = cell.get("t", "n"), cell.find(f"{S}v")
    if kind == "inlineStr":
        return _joined(cell, f"{S}t")
    if v is None or v.text is None:
        return None
    if kind == "s":
        return strings[int(v.text)]
    if kind == "b":
        return v.text == "1"
    if kind in ("str", "e", "d"):
        return v.text
    number = float(v.text)
    return int(number) if number.is_integer() and "." not in v.text and "e" not in v.text.lower() else number


def merged_cells(tree) -> set[tuple[int, int]]:
    """The first cells of merged ranges, which hold their values."""
    found = [re.match(r"([A-Z]+)(\d+)", m.get("ref", "")) for m in tree.iter(f"{S}mergeCell")]
    return {(int(m[2]), column_number(m[1])) for m in found if m}


def _styles(z: zipfile.ZipFile) -> list[dict]:
    tree = _part(z, "xl/styles.xml")
    if tree is None:
        return []
    value = lambda node, tag, name="val": (x.get(name) if (x := node.find(f"{S}{tag}")) is not None else None)
    fonts = [{"font_name": value(f, "name"), "font_size": value(f, "sz"), "bold": f.find(f"{S}b") is not None, "italic": f.find(f"{S}i") is not None, "font_color": value(f, "color", "rgb")} for f in tree.findall(f"{S}fonts/{S}font")]
    fills = [(c.get("rgb") if (c := f.find(f".//{S}fgColor")) is not None else None) for f in tree.findall(f"{S}fills/{S}fill")]
    out = []
    for xf in tree.findall(f"{S}cellXfs/{S}xf"):
        look = dict(fonts[int(xf.get("fontId", 0))]) if fonts else {}
        if fills:
            look["fill_color"] = fills[int(xf.get("fillId", 0))]
        at = xf.find(f"{S}alignment")
        out.append(look | ({"alignment": at.get("horizontal")} if at is not None else {}))
    return out


def _size(tree) -> list[int]:
    """[width, height] of a sheet: up to its last column and row that has a cell, empty ones too; a sheet without cells is one cell."""
    places = [m for c in tree.iter(f"{S}c") if (m := re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", "")))]
    return [max((column_number(m[1]) for m in places), default=1) * WIDE, max((int(m[2]) for m in places), default=1) * HIGH]


def parse_workbook(content: bytes, elements: list[dict], metadata: dict) -> None:
    """Cells by row, then each sheet's table region and its first row as headings; a sheet is a page."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        strings = [_joined(si, f"{S}t") for si in shared.iter(f"{S}si")] if (shared := _part(z, "xl/sharedStrings.xml")) is not None else []
        found, active = sheets(z)
        looks = _styles(z)
        metadata.update({"sheets": len(found), "sheet_names": [n for n, _ in found], "active_sheet": active, "sheet_sizes": json.dumps([_size(tree) for _, tree in found])})
        for page, (name, tree) in enumerate(found):
            merged = merged_cells(tree)
            cells = {}
            for c in tree.iter(f"{S}c"):
                m = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r", ""))
                v = cell_value(c, strings)
                if m and v is not None:
                    cells[int(m[2]), column_number(m[1])] = (v, c, m[1])
            for (row, col), (v, c, letters) in sorted(cells.items()):
                text = str(v)
                kind = "heading" if row == 1 or (isinstance(v, str) and len(v) < 50 and v.isupper()) else "text"
                facts = {"sheet": name, "row": row, "column": col, "address": f"{letters}{row}", "column_letter": letters, "data_type": type(v).__name__}
                if (row, col) in merged:
                    facts["is_merged"] = True
                style = looks[int(c.get("s", 0))] if looks else {}
                elements.append(element(kind, text, (col - 1) * WIDE, (row - 1) * HIGH, col * WIDE, row * HIGH, page=page, style=style, metadata=facts))
            if not cells:
                continue
            rows, cols = [r for r, _ in cells], [c for _, c in cells]
            top, bottom, left, right = min(rows), max(rows), min(cols), max(cols)
            grid = "\n".join("\t".join(str(cells[r, c][0]) if (r, c) in cells else "" for c in range(left, right + 1)) for r in range(top, bottom + 1))
            elements.append(element("table", grid, (left - 1) * WIDE, (top - 1) * HIGH, right * WIDE, bottom * HIGH, page=page, metadata={"sheet": name, "rows": bottom - top + 1, "columns": right - left + 1}))
            for (row, col), (v, _, letters) in sorted(cells.items()):
                if row == 1:
                    elements.append(element("heading", str(v), (col - 1) * WIDE, 0, col * WIDE, HIGH, page=page, metadata={"sheet": name, "is_header": True, "column_letter": letters}))


def style_type(name: str) -> str:
    low = name.lower()
    return "heading" if "heading" in low or "title" in low else "caption" if "caption" in low else "list" if "list" in low else "paragraph"


def parse_document(content: bytes, elements: list[dict], metadata: dict) -> None:
    """Paragraphs 25 apart, then the tables below them."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        core = _part(z, "docProps/core.xml")
        for key, tag in CORE.items():
            node = core.find(tag) if core is not None else None
            metadata[key] = (node.text or "") if node is not None else ""
        named = {}
        if (styles := _part(z, "word/styles.xml")) is not None:
            named = {s.get(f"{W}styleId"): s.find(f"{W}name").get(f"{W}val") for s in styles.iter(f"{W}style") if s.find(f"{W}name") is not None}
        body = _part(z, "word/document.xml").find(f"{W}body")
        y = 0
        for p in body.findall(f"{W}p"):
            text = _paragraph(p)
            if not text.strip():
                continue
            look, place = p.find(f"{W}pPr/{W}pStyle"), p.find(f"{W}pPr/{W}jc")
            style = named.get(look.get(f"{W}val"), look.get(f"{W}val")) if look is not None else "Normal"
            elements.append(element(style_type(style), text, 0, y, 600, y + 20, style={"style_name": style, "alignment": place.get(f"{W}val") if place is not None else None}))
            y += 25
        for t in body.findall(f"{W}tbl"):
            rows = [["\n".join(_paragraph(p) for p in c.findall(f"{W}p")).strip() for c in r.findall(f"{W}tc")] for r in t.findall(f"{W}tr")]
            elements.append(element("table", "\n".join("\t".join(r) for r in rows), 0, y, 600, y + 20 * len(rows), metadata={"rows": len(rows), "columns": len(rows[0]) if rows else 0}))
            y += 25 * len(rows)
        metadata.update({"page_width": 600, "page_height": y})


def _paragraph(p) -> str:
    out = []
    for node in p.iter():
        if node.tag == f"{W}t":
            out.append(node.text or "")
        elif node.tag == f"{W}tab":
            out.append("\t")
        elif node.tag in (f"{W}br", f"{W}cr"):
            out.append("\n")
    return "".join(out)


def parse_legacy_workbook(content: bytes, elements: list[dict], metadata: dict) -> None:
    """An .xls file by pandas' optional reader: text cells by sheet, the first row as column names."""
    import pandas as pd

    frames = pd.read_excel(io.BytesIO(content), sheet_name=None)
    metadata.update({"sheets": len(frames), "sheet_names": list(frames)})
    for page, (name, frame) in enumerate(frames.items()):
        for r, values in enumerate(frame.itertuples(index=False)):
            for c, v in enumerate(values):
                if pd.notna(v):
                    elements.append(element("text", str(v), c * WIDE, r * HIGH, (c + 1) * WIDE, (r + 1) * HIGH, page=page, metadata={"sheet": name, "row": r + 1, "column": c + 1}))


def parse_legacy_document(content: bytes, elements: list[dict], metadata: dict) -> None:
    raise ValueError("legacy .doc files cannot be read")


def workbook_elements(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    return parsed_elements(files, parse_workbook, id_col, content_col)


def word_elements(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    return parsed_elements(files, parse_document, id_col, content_col)


def workbook_documents(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    return parsed_documents(files, parse_workbook, "excel", "ooxml_workbook", id_col, content_col)


def word_documents(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    return parsed_documents(files, parse_document, "word", "ooxml_document", id_col, content_col)
