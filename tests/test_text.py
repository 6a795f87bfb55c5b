import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lamina.functions import text as fn
from lamina.sources import text

SPACES = ["a b", " a", "a ", " x ", "　a　", "\x1cx\x1d", "a\x85b", "\t a\n b \n", "", " ", "\n"]


def test_tokens_and_strip_follow_python(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(SPACES)], "i int, s string")
    got = rows.select("i", fn.tokens(F.col("s")).alias("t"), fn.tokens(F.col("s"), True).alias("u"), fn.strip(F.col("s")).alias("p"), fn.token_count(F.col("s")).alias("n")).collect()
    for r in got:
        s = SPACES[r.i]
        assert list(r.t) == re.findall(r"\S+", s) and r.n == len(s.split())
        assert list(r.u) == re.findall(r"\S+|\n", s)
        assert r.p == s.strip()


def test_inferred_types(spark):
    cases = {"1": "integer", "+1_000": "integer", "-5": "integer", "1.5": "float", "1e5": "float", ".5": "float", "5.": "float", "nan": "float", "Infinity": "float", "1d": "string", "1f": "string", "1__0": "string", "2024-01-02": "date", "2024-01-02x": "date", "01/02/2024": "date", "01-02-2024": "date", "TRUE": "boolean", "no": "boolean", "x": "string", "": "empty", "  ": "empty", "1_0.5": "float"}
    rows = spark.createDataFrame([(k,) for k in cases], "v string").select("v", fn.infer_type(F.col("v")).alias("t")).collect()
    assert {r.v: r.t for r in rows} == cases


def test_line_classes(spark):
    lines = ["# Title", "Under", "=====", "- item", "1. first", "2024 was. long", "SHOUT NOW", "```python", "plain text", "MixedCASE", "Last", "~~~"]
    docs = spark.createDataFrame([("d", "\n".join(lines))], "doc_id string, text string")
    kinds = [r.element_type for r in text.text_elements(docs, special=False).orderBy("pos").collect()]
    assert kinds == ["heading", "heading", "paragraph", "list", "list", "paragraph", "heading", "annotation", "paragraph", "paragraph", "heading", "paragraph"]


def test_blocks_and_tables(spark):
    content = "intro\n```python\nx = 1\ny = 2\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\nend | not | table"
    docs = spark.createDataFrame([("d", content), ("e", None), ("f", "")], "doc_id string, text string")
    rows = text.special_elements(docs).orderBy("n").collect()
    assert [(r.element_type, r.content, r.top, r.bottom) for r in rows] == [
        ("annotation", "x = 1\ny = 2", 1, 2), ("table", "| a | b |\n|---|---|\n| 1 | 2 |", 6, 9), ("table", "| not |", 9, 10),
    ]
    assert rows[0].metadata["language"] == "python" and rows[1].metadata["columns"] == "2"
    every = text.text_elements(docs).orderBy("pos").collect()
    assert [r.pos for r in every] == list(range(len(every)))


def test_newlines_and_endings(spark):
    docs = spark.createDataFrame([(1, "a\r\nb\rc\n")], "doc_id int, text string")
    assert text.document_metadata(docs).first().total_lines == 4
    assert docs.select(text.line_endings(F.col("text"))).first()[0] == "CRLF"


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab#=-. \tA1`|", max_size=12), min_size=1, max_size=8))
def test_stats_match_python(spark, lines):
    docs = spark.createDataFrame([("d", "\n".join(lines))], "doc_id string, text string")
    r = text.structure_stats(docs).first()
    assert r.total_lines == len(lines) and r.empty_lines == sum(not x.strip() for x in lines)
    assert r.max_line_length == max(map(len, lines)) and abs(r.avg_line_length - sum(map(len, lines)) / len(lines)) < 1e-9
    assert r.all_caps_lines == sum(x.strip().isupper() for x in lines)
