"""PDF and image files by optional libraries; without them a document is an error row, never a failed job."""

from __future__ import annotations

import io

from .flatten import element


def span_type(size: float, flags: int) -> str:
    return "heading" if flags & 16 or size > 16 else "caption" if size < 8 else "text"


def group_chars(chars: list[dict], near: float = 2.0) -> list[dict]:
    """Words of consecutive characters: the next one starts within ``near`` of the last's end and top."""
    words: list[list[dict]] = []
    for c in chars:
        last = words[-1][-1] if words else None
        if last is not None and abs(c["x0"] - last["x1"]) <= near and abs(c["top"] - last["top"]) <= near:
            words[-1].append(c)
        else:
            words.append([c])
    return [
        {"text": "".join(c["text"] for c in w), "x0": min(c["x0"] for c in w), "y0": min(c["top"] for c in w), "x1": max(c["x1"] for c in w), "y1": max(c["bottom"] for c in w), "font": w[0].get("fontname"), "size": w[0].get("size", 0)}
        for w in words
    ]


def grid_text(rows) -> str:
    return "\n".join("\t".join("" if v is None else str(v) for v in r) for r in rows)


def parse_pdf(content: bytes, elements: list[dict], metadata: dict) -> None:
    """Spans, tables and images of each page by PyMuPDF, or words and tables by pdfplumber."""
    try:
        import fitz
    except ImportError:
        return _parse_pdf_words(content, elements, metadata)
    doc = fitz.open(stream=content, filetype="pdf")
    info = doc.metadata or {}
    metadata.update({"pages": len(doc), "title": info.get("title", ""), "author": info.get("author", ""), "creator": info.get("creator", ""), "creation_date": info.get("creationDate", "")})
    metadata["page_sizes"] = [[page.rect.width, page.rect.height] for page in doc]
    for n, page in enumerate(doc):
        for block in page.get_text("dict")["blocks"]:
            for line in block.get("lines", []):
                for s in line["spans"]:
                    if s["text"].strip():
                        style = {"font": s["font"], "size": s["size"], "flags": s["flags"], "color": s["color"]}
                        elements.append(element(span_type(s["size"], s["flags"]), s["text"], *s["bbox"], page=n, style=style))
        for t in page.find_tables():
            rows = t.extract()
            elements.append(element("table", grid_text(rows), *t.bbox, page=n, metadata={"rows": len(rows), "columns": len(rows[0]) if rows else 0}))
        for k, image in enumerate(page.get_images()):
            boxes = page.get_image_rects(image[0])
            if boxes:
                elements.append(element("image", f"[Image {k}]", *boxes[0], page=n))
    return None


def _parse_pdf_words(content: bytes, elements: list[dict], metadata: dict) -> None:
    try:
        import pdfplumber
    except ImportError as e:
        raise RuntimeError("no PDF library is installed") from e
    with pdfplumber.open(io.BytesIO(content)) as pdf:
        info = pdf.metadata or {}
        metadata.update({"pages": len(pdf.pages), "title": info.get("Title", ""), "author": info.get("Author", "")})
        metadata["page_sizes"] = [[float(page.width), float(page.height)] for page in pdf.pages]
        for n, page in enumerate(pdf.pages):
            for w in group_chars(page.chars):
                elements.append(element(span_type(w["size"], 0), w["text"], w["x0"], w["y0"], w["x1"], w["y1"], page=n, style={"font": w["font"], "size": w["size"]}))
            for rows in page.extract_tables():
                elements.append(element("table", "\n".join("\t".join(str(v) for v in r) for r in rows), 0, 0, page.width, page.height, page=n))


def parse_image(content: bytes, elements: list[dict], metadata: dict) -> None:
    """Recognised words with their boxes, those above confidence 30."""
    try:
        import pytesseract
        from PIL import Image
    except ImportError as e:
        raise RuntimeError("no text recognition is installed") from e
    image = Image.open(io.BytesIO(content))
    metadata.update({"format": image.format, "mode": image.mode, "width": image.width, "height": image.height})
    words_into(pytesseract.image_to_data(image, output_type=pytesseract.Output.DICT), elements)


def words_into(data: dict, elements: list[dict], least: float = 30.0) -> None:
    """Elements of a word table (text, conf, left, top, width, height, level)."""
    for k, text in enumerate(data["text"]):
        sure = float(data["conf"][k])
        if text.strip() and sure > least:
            x, y = data["left"][k], data["top"][k]
            elements.append(element("text", text, x, y, x + data["width"][k], y + data["height"][k], confidence=sure / 100, metadata={"ocr_level": data["level"][k]}))
