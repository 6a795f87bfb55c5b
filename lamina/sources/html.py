"""HTML: block elements of the tree, in document order.

The tree is the lenient one of the standard parser: an end tag closes up to the
nearest open tag of its name, an end tag without one is ignored, void tags close
at once, and nothing closes by itself.  Nested blocks each give a row, so text
inside two of them is in both.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, functions as F

from .flatten import element, parsed_documents, parsed_elements

TYPES = {**{f"h{n}": "heading" for n in range(1, 7)}, "p": "paragraph", "ul": "list", "ol": "list", "table": "table", "img": "image", "div": "text"}
VOID = frozenset("area base br col embed hr img input link meta param source track wbr basefont bgsound command frame image isindex nextid spacer keygen".split())
HIDDEN = ("script", "style", "template")


class _Tree(HTMLParser):
    """Collects blocks with the text pieces below them; each text run is stripped on its own."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, dict | None]] = []
        self.blocks: list[dict] = []
        self.counts = {"a": 0, "img": 0, "table": 0}
        self.title: str | None = None
        self.title_open: list | None = None
        self.run: list[str] = []

    def _flush(self) -> None:
        text, self.run = "".join(self.run), []
        if not text:
            return
        if self.title_open is not None:
            self.title_open.append(text)
        inside = {id(b): b for _, b in self.open if b is not None}
        if self.open and self.open[-1][0] in HIDDEN:
            return
        stripped = text.strip()
        if stripped:
            for b in inside.values():
                b["texts"].append(stripped)

    def handle_data(self, data):
        self.run.append(data)

    def handle_starttag(self, tag, attrs):
        self._flush()
        found: dict = {}
        for k, v in attrs:
            found[k] = "" if v is None else v
        if tag in self.counts:
            self.counts[tag] += 1
        block = None
        if tag in TYPES:
            block = {"tag": tag, "attrs": found, "texts": []}
            self.blocks.append(block)
        if tag == "title" and self.title is None and self.title_open is None:
            self.title_open = []
        if tag not in VOID:
            self.open.append((tag, block))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self._flush()
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        if at is None:
            return
        if any(t == "title" for t, _ in self.open[at:]) and self.title_open is not None:
            # A title is a single text or, with more inside, none.
            self.title, self.title_open = self.title_open[0] if len(self.title_open) == 1 else "", None
        del self.open[at:]

    def handle_comment(self, data):
        self._flush()

    def handle_decl(self, decl):
        self._flush()

    def close(self):
        super().close()
        self._flush()
        if self.title_open is not None:
            self.title, self.title_open = self.title_open[0] if len(self.title_open) == 1 else "", None


def parse(content: str, elements: list[dict], metadata: dict) -> None:
    tree = _Tree()
    tree.feed(content)
    tree.close()
    metadata.update({"title": tree.title or "", "links": tree.counts["a"], "images": tree.counts["img"], "tables": tree.counts["table"]})
    y = 0
    for b in tree.blocks:
        text = "".join(b["texts"])
        if text or b["tag"] == "img":
            style = {"tag": b["tag"], "class": b["attrs"].get("class", "").split(), "id": b["attrs"].get("id", "")}
            elements.append(element(TYPES[b["tag"]], text or f"[{b['tag'].upper()}]", 0, y, 800, y + 20, style=style))
            y += 25


def html_elements(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    return parsed_elements(pages, parse, id_col, html_col)


def html_documents(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Title and counts of links, images and tables, as the tree has them."""
    return parsed_documents(pages, parse, "html", "html_blocks", id_col, html_col)


def html_metadata(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """The same facts by regular expressions alone, for well-formed pages: no Python, no tree."""
    body = F.regexp_replace(F.col(html_col), r"(?s)<!--.*?-->", "")
    tags = lambda name: F.regexp_count(body, F.lit(rf"(?i)<{name}(\s[^>]*)?/?>")).cast("long")
    return pages.select(F.col(id_col).alias("doc_id"), F.regexp_extract(body, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), tags("a").alias("links"), tags("img").alias("images"), tags("table").alias("tables"))
