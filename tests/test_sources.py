import io
import zipfile

from pyspark.sql import functions as F

from lamina.operators import profile
from lamina.sources import binary, csv, html, json, office, xml
from lamina.sources.files import encoding, file_documents, file_elements, parse_path, scan
from lamina.sources.flatten import parse_one


def parsed(parser, content):
    elements, metadata, errors = parse_one(parser, content)
    assert not errors, errors
    return elements, metadata


def test_html_blocks():
    page = "<html><head><title>T &amp; U</title><style>p{}</style></head><body><h1> Big </h1><div class='a b' id=x><p>one <b>two</b><!-- c --> three<p>four</div><img src=x><ul><li>i</li><li>j</li></ul><p></p></body></html>"
    elements, facts = parsed(html.parse, page)
    assert [(e["element_type"], e["content"]) for e in elements] == [
        ("heading", "Big"), ("text", "onetwothreefour"), ("paragraph", "onetwothreefour"), ("paragraph", "four"), ("image", "[IMG]"), ("list", "ij"),
    ]
    assert facts == {"title": "T & U", "links": 0, "images": 1, "tables": 0}
    assert elements[1]["style"] == {"tag": "div", "class": ["a", "b"], "id": "x"} and [e["y0"] for e in elements] == [0, 25, 50, 75, 100, 125]


def test_json_walk():
    elements, facts = parsed(json.parse, '{"b": {"x": 1, "y": [true, null]}, "a": "s"}')
    assert [(e["content"], e["x0"], e["y0"]) for e in elements] == [("b: {", 20, 0), ("x: 1", 40, 25), ("y: [", 40, 50), ("[0]: true", 60, 75), ("[1]: null", 60, 100), ('a: "s"', 20, 125)]
    assert facts["max_depth"] == 3 and facts["total_keys"] == 4 and facts["total_values"] == 4 and facts["array_sizes"] == [2]
    assert facts["data_types"] == {"dict": 1, "str": 2, "int": 2, "list": 1, "bool": 1, "NoneType": 1}
    assert parsed(json.parse, "5")[0][0]["content"] == "5"
    assert parse_one(json.parse, "{")[2]


def test_xml_tree():
    elements, facts = parsed(xml.parse, '<?xml version="1.1" encoding="UTF-8"?><r xmlns="u" id="7"><title>Hi</title><empty name="n"/><box><p> t </p></box></r>')
    assert [e["content"] for e in elements] == ["r: 7", "@id=7", "Hi", "empty: n", "@name=n", "<box> (1 children)", "t"]
    assert [e["element_type"] for e in elements] == ["text", "annotation", "heading", "text", "annotation", "text", "paragraph"]
    assert facts["namespaces"] == {"ns0": "u"} and facts["depth"] == 2 and facts["total_elements"] == 5 and facts["xml_version"] == "1.1"
    assert [(e["x0"], e["y0"]) for e in elements] == [(0, 0), (20, 25), (30, 50), (30, 80), (50, 110), (30, 135), (60, 165)]


def test_xml_types():
    svg = parsed(xml.parse, '<svg><rect x="1" y="2" width="3"/><circle r="5"/></svg>')[0]
    assert [(e["element_type"], e["x0"], e["x1"]) for e in svg if e["element_id"].startswith("xml_element")][1:] == [("image", 1, 4), ("image", 30, 230)]
    feed = parsed(xml.parse, "<rss><channel><title>t</title><link>l</link><description>d</description></channel></rss>")
    assert [e["element_type"] for e in feed[0]][2:] == ["heading", "annotation", "paragraph"] and feed[1]["xml_type"] == "rss"
    assert parsed(xml.parse, "<schema><complexType/></schema>")[0][1]["element_type"] == "heading"


def test_deep_xml_needs_no_recursion():
    deep = "<a>" * 3000 + "</a>" * 3000
    assert len(parsed(xml.parse, deep)[0]) == 3000


def workbook() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", '<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Name</t></si><si><t>TOTAL</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
    return out.getvalue()


def document() -> bytes:
    out = io.BytesIO()
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    return out.getvalue()


def test_workbook():
    elements, facts = parsed(office.parse_workbook, workbook())
    assert [(e["element_type"], e["content"]) for e in elements] == [("heading", "Name"), ("heading", "TOTAL"), ("text", "2"), ("table", "Name\t\n\t\nTOTAL\t2"), ("heading", "Name")]
    assert facts["sheet_names"] == ["S"] and elements[2]["metadata"]["address"] == "B3"


def test_document():
    elements, _ = parsed(office.parse_document, document())
    assert [(e["element_type"], e["content"], e["y0"]) for e in elements] == [("heading", "Top", 0), ("paragraph", "Body", 25), ("table", "a\tb", 50)]


def test_pdf_words_and_ocr():
    chars = [{"text": c, "x0": x, "x1": x + 5, "top": t, "bottom": t + 10} for c, x, t in (("a", 0, 0), ("b", 6, 1), ("c", 20, 0), ("d", 25, 30))]
    assert [w["text"] for w in binary.group_chars(chars)] == ["ab", "c", "d"]
    found: list = []
    binary.words_into({"text": ["x", " ", "y"], "conf": [90, 95, 30], "left": [1, 2, 3], "top": [1, 1, 1], "width": [5, 5, 5], "height": [5, 5, 5], "level": [5, 5, 5]}, found)
    assert [(e["content"], e["confidence"]) for e in found] == [("x", 0.9)]
    assert [binary.span_type(*a) for a in ((20, 0), (10, 16), (7, 0), (10, 0))] == ["heading", "heading", "caption", "text"]


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b"HEAD\nbody", "b.json": b'{"k": 1}', "c.html": b"<p>x</p>", "d.xml": b"<a>t</a>", "e.csv": b"h,i\n1,\n", "f.xlsx": workbook(), "g.docx": document(), "h.pdf": b"%PDF", "i.bin": b"?", "j.json": b"{", ".hidden.txt": b"no", "k.doc": b"old", "l.png": b"png"}.items():
        (tmp_path / name).write_bytes(data)
    files = scan(spark, str(tmp_path))
    facts = {r.doc_id.rsplit("/")[-1]: (r.file_type, bool(r.errors)) for r in file_documents(files).collect()}
    assert facts["a.txt"] == ("text", False) and facts["f.xlsx"] == ("excel", False) and facts["i.bin"] == ("unsupported", True)
    assert facts["j.json"] == ("json", True) and facts["h.pdf"][1] and facts["k.doc"] == ("word", True) and facts["l.png"][1] and ".hidden.txt" not in facts
    kinds = {r.doc_id.rsplit("/")[-1] for r in file_elements(files).select("doc_id").distinct().collect()}
    assert kinds == {"a.txt", "b.json", "c.html", "d.xml", "e.csv", "f.xlsx", "g.docx"}
    missing, none = parse_path(spark, str(tmp_path / "nope"))
    assert missing.first().file_type == "unknown" and none.count() == 0


def test_encodings(spark):
    cases = {"a": b"\xef\xbb\xbfx", "b": b"\xff\xfex\x00", "c": b"\xfe\xff\x00x", "d": "é".encode(), "e": b"\xe9t", "f": b""}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "k string, content binary")
    got = {r.k: r.e for r in rows.select("k", encoding(rows.content).alias("e")).collect()}
    assert got == {"a": "utf-8-sig", "b": "utf-16-le", "c": "utf-16-be", "d": "utf-8", "e": "latin-1", "f": "utf-8"}


def test_csv_gaps(spark):
    docs = spark.createDataFrame([("d", "n,s\n1,\n2.5,x\n,yes\n")], "doc_id string, content string")
    cells = csv.csv_cells(docs, "doc_id", "content")
    p = {r.column_name: r for r in profile.column_profile(cells).collect()}
    assert list(p["n"].data_types) == ["float", "integer", "string"] and p["n"].null_count == 1 and p["n"].mean == 1.75
    assert list(p["s"].data_types) == ["boolean", "string"] and p["s"].numeric_count == 0 and p["s"].std is None
    q = profile.data_quality(cells).first()
    assert (q.total_cells, q.empty_cells, q.numeric_cells) == (6, 2, 2)
    rows = csv.csv_elements(cells, profile.column_profile(cells)).orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(len(rows))) and rows[0].content == "n\ts" and rows[-2].element_type == "table" and rows[-1].content.startswith("CSV Statistics:\nDimensions: 3 rows × 2 columns")
    assert csv.sniff("a;b\n1;2\n3;4\n")["delimiter"] == ";"


def test_no_file_fails_the_batch(spark, tmp_path):
    """Latin-1, UTF-16, a field of 200,000 characters, an open quote, declared encodings, empty files, upper-case suffixes."""
    files = {
        "a.txt": b"Caf\xe9\nok", "b.txt": "\ufeffwide".encode("utf-16-le"), "c.csv": b"h,i\n" + b"x" * 200_000 + b",1\n", "d.csv": b'h,i\n"open,1\n2,3\n', "e.csv": b"a,b\n1,2,3\n4\n", "f.xml": b"<?xml version='1.0' encoding='latin-1'?><r>\xe9</r>",
        "g.xml": b"<r>\xe9</r>", "h.json": b'{"k": "\xe9"}', "i.html": b"<p>\xe9</p>", "j.TXT": b"upper", "k.txt": b"", "l.csv": b"", "m.xml": b"", "n.xlsx": b"PK broken", "o.bin": b"?" * 10,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    documents, elements = parse_path(spark, str(tmp_path))
    facts = {r.doc_id.rsplit("/")[-1]: r for r in documents.collect()}
    assert set(facts) == set(files) and len(facts) == documents.count()
    assert facts["k.txt"].errors is None and facts["l.csv"].errors is None and facts["m.xml"].errors and facts["k.txt"].metadata["total_characters"] == "0"
    contents: dict = {}
    for r in elements.collect():
        contents.setdefault(r.doc_id.rsplit("/")[-1], []).append(r.content)
    assert contents["a.txt"] == ["Café", "ok"] and "latin-1" in facts["a.txt"].errors[0] and facts["a.txt"].metadata["encoding"] == "latin-1"
    assert contents["b.txt"] == ["wide"] and facts["b.txt"].metadata["encoding"] == "utf-16-le" and facts["b.txt"].errors is None
    assert "x" * 200_000 in contents["c.csv"] and facts["c.csv"].errors is None
    assert any("open,1" in c for c in contents["d.csv"])
    assert contents["f.xml"] == ["é"] and contents["g.xml"] == ["é"] and facts["f.xml"].errors is None and facts["g.xml"].errors
    assert contents["h.json"] == ['k: "\\u00e9"'] and contents["i.html"] == ["é"] and contents["j.TXT"] == ["upper"]
    assert facts["n.xlsx"].errors and facts["o.bin"].file_type == "unsupported" and not {"k.txt", "l.csv", "m.xml"} & set(contents)
    cells = csv.csv_cells(spark.createDataFrame([("e", "a,b\n1,2,3\n4\n")], "doc_id string, content string"), "doc_id", "content")
    assert sorted((r.row, r.col, r.column_name, r.value) for r in cells.collect()) == [(0, 0, "a", "a"), (0, 1, "b", "b"), (1, 0, "a", "1"), (1, 1, "b", "2"), (1, 2, "column_3", "3"), (2, 0, "a", "4"), (2, 1, "b", "")]


def test_one_content_scan(spark, tmp_path):
    """The plan that parses a folder reads contents once; names of other files come from a listing."""
    import re

    from lamina.sources.files import parse_files, scan_all

    (tmp_path / "a.txt").write_bytes(b"x")
    plan = parse_files(scan_all(spark, str(tmp_path)))._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert len(schemas) == 2 and sum("content" in x for x in schemas) == 1


def test_empty_files_have_rows(spark, tmp_path):
    (tmp_path / "sub dir+%20").mkdir()
    for name, data in {"a.txt": b"text", "empty.txt": b"", "sub dir+%20/é empty.md": b"", "sub dir+%20/full.md": b"# T", ".hidden": b"", "other.bin": b""}.items():
        (tmp_path / name).write_bytes(data)
    short = lambda p: p.split(str(tmp_path) + "/")[1]
    rows = scan(spark, str(tmp_path)).collect()
    assert sorted((short(r.path), r.length, len(r.content)) for r in rows) == [("a.txt", 4, 4), ("empty.txt", 0, 0), ("other.bin", 0, 0), ("sub dir+%20/full.md", 3, 3), ("sub dir+%20/é empty.md", 0, 0)]
    documents, elements = parse_path(spark, str(tmp_path))
    got = sorted((short(r.doc_id), r.file_type, r.errors is None) for r in documents.collect())
    assert got == [("a.txt", "text", True), ("empty.txt", "text", True), ("other.bin", "unsupported", False), ("sub dir+%20/full.md", "text", True), ("sub dir+%20/é empty.md", "text", True)]
    assert elements.count() == 2
    documents, elements = parse_path(spark, str(tmp_path / "empty.txt"))
    assert documents.count() == 1 and elements.count() == 0


def test_sketches_add_up(spark):
    """Two batches merged equal one over both: exactly but for distinct values, those within the stated error."""
    import math
    import random

    from lamina.operators import profile

    rng = random.Random(2)
    rows = [("d", r, c, f"c{c}", "" if rng.random() < 0.1 else str(rng.randrange(20_000) if c else 1e6 + rng.random()) if c < 2 else rng.choice(["x", "7", "yes"]), False) for r in range(3000) for c in range(3)] + [("one", 0, 0, "c0", "5", False), ("none", 0, 0, "c0", "", False)]
    cells = spark.createDataFrame(rows, "doc_id string, row int, col int, column_name string, value string, is_header boolean")
    halves = [profile.column_sketch(cells.where(F.col("row") % 3 == k)) for k in range(3)]
    got = {(r.doc_id, r.col): r for r in profile.profile_of_sketches(profile.merged_sketches(halves[0].unionByName(halves[1]).unionByName(halves[2]))).collect()}
    want = {(r.doc_id, r.col): r for r in profile.column_profile(cells).collect()}
    assert set(got) == set(want)
    for key, a in got.items():
        b = want[key]
        assert (a.data_types, a.null_count, a.max_length, a.numeric_count, a.min, a.max) == (b.data_types, b.null_count, b.max_length, b.numeric_count, b.min, b.max)
        assert abs(a.unique_values - b.unique_values) <= 4 * 1.04 / math.sqrt(2**14) * b.unique_values + 1
        for x, y in ((a.mean, b.mean), (a.std, b.std)):
            assert x == y or (math.isnan(x) and math.isnan(y)) or abs(x - y) <= 1e-6 * abs(y) + 1e-9
    whole = profile.merged_sketches(profile.column_sketch(cells), "col")
    assert {r.col: r.cells for r in whole.collect()} == {0: 3002, 1: 3000, 2: 3000}
