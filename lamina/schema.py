"""The tables of the engine. Rows are unordered, so order is always a column."""

ELEMENT_TYPES = ("text", "heading", "paragraph", "table", "image", "list", "footer", "header", "sidebar", "caption", "formula", "annotation")

#: ``pos`` is document order; ``ro_pos`` (set by layout) is reading order.
ELEMENT = (
    "doc_id string, pos int, element_id string, element_type string, content string, page int, "
    "x0 double, y0 double, x1 double, y1 double, confidence double, parent_id string, "
    "style map<string,string>, metadata map<string,string>"
)
PARSED = "doc_id string, file_type string, parser_used string, metadata map<string,string>, errors array<string>"
CHUNK = (
    "doc_id string, chunk_no int, chunk_id string, text string, heading string, element_ids array<string>, "
    "element_types array<string>, page_start int, page_end int"
)
VECTOR = "chunk_id string, embedding array<float>, text string, metadata map<string,string>"

#: What a parser yields for one element, before the row's key is added.
PARSER_ROW = "pos int, element_id string, element_type string, content string, page int, x0 double, y0 double, x1 double, y1 double, confidence double, style map<string,string>, metadata map<string,string>"
