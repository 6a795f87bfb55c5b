"""The jobs: SQL, growing input, changed and repeated documents, failures half way, command lines."""

import json
import uuid

import pytest
from pyspark.sql import functions as F

from jobs import answer_prompts, chunk_documents, common, queries
from lamina.operators import layout
from lamina.operators.chunking import Chunker
from lamina.sources.text import text_elements
from tests import oracle

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, extra int"


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_sql(spark, name):
    before = dict(spark.conf.getAll)
    oracle.same(queries.QUERIES[name](spark, SF), oracle.connect(SF), queries.SQL[name])
    assert dict(spark.conf.getAll) == before


@pytest.fixture()
def place(tmp_path):
    return f"file://{tmp_path}/{uuid.uuid4().hex}"


def put(spark, place, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(f"{place}/in")


def take(spark, place, **settings):
    return chunk_documents.run(spark, f"{place}/in", f"{place}/out", f"{place}/mark", {"strategy": "fixed", "chunk_size": 5, "chunk_overlap": 1, "dimension": 8} | settings)


def chunks(spark, place):
    rows = chunk_documents.current(spark, f"{place}/out").select("doc_id", "lang", "chunk_no", "chunk_id", "heading", "text", "n_tokens", "page_start", "page_end", F.col("embedding").cast("string").alias("embedding"))
    return sorted(tuple(r) for r in rows.collect())


FIRST = [(1, "one two three four five six seven", "en", 1), (2, "TITLE\nline", "fr", 2), (3, None, None, 3), (4, "", "en", 4), (2, "TITLE\nline", "fr", 2), (None, "without an id", None, 5)]


def test_takes_only_what_is_new(spark, place):
    put(spark, place, FIRST)
    assert take(spark, place) == {"batches": 1, "documents": 5, "chunks": 4}
    first = chunks(spark, place)
    assert [c[3] for c in first if c[0] == "1"] == ["1-chunk-0", "1-chunk-1"]
    # Nothing new: not even a batch.
    assert take(spark, place) == {"batches": 0, "documents": 0, "chunks": 0} and chunks(spark, place) == first
    # A file that brings old documents again, a changed text and a new document.
    put(spark, place, [*FIRST[:3], (2, "TITLE\nanother line", "fr", 2), (5, "five", "de", 1)])
    again = take(spark, place)
    assert again["batches"] == 1 and again["documents"] == 2, again
    after = chunks(spark, place)
    assert {c[0] for c in after} == {"1", "2", "5", next(c[0] for c in first if c[0].startswith("text-"))}
    assert [c for c in after if c[0] == "1"] == [c for c in first if c[0] == "1"]
    assert ["another" in c[5] for c in after if c[0] == "2"] == [True]
    # Files that Spark wrote into the same folder are taken once each, however the runs fall.
    other = place + "-at-once"
    put(spark, other, FIRST)
    put(spark, other, [(5, "five", "de", 1)])
    assert take(spark, other, files_per_batch=1)["batches"] == 2
    assert [c for c in chunks(spark, other) if c[0] != "2"] == [c for c in after if c[0] != "2"]


def test_a_text_that_comes_back(spark, place):
    for text in ("old text", "new text", "old text"):
        put(spark, place, [(1, text, "en", 0)])
        take(spark, place)
        assert [c[5] for c in chunks(spark, place)] == [text]


def test_a_batch_that_failed_half_way(spark, place, monkeypatch, tmp_path):
    put(spark, place, FIRST)
    real = chunk_documents.read

    def broken(session, path, schema):
        # The chunks are written whole, then the batch ends before its ledger is.
        if path.endswith("/chunks") and list((tmp_path / place.rsplit("/", 1)[1]).glob("out/chunks/batch=0/*/*.parquet")):
            raise RuntimeError("lost")
        return real(session, path, schema)

    monkeypatch.setattr(chunk_documents, "read", broken)
    with pytest.raises(Exception, match="lost"):
        take(spark, place)
    monkeypatch.undo()
    assert real(spark, f"{place}/out/chunks", chunk_documents.CHUNKS).count() == 4 and real(spark, f"{place}/out/documents", chunk_documents.LEDGER).count() == 0
    assert take(spark, place) == {"batches": 1, "documents": 5, "chunks": 4}
    other = place + "-whole"
    put(spark, other, FIRST)
    take(spark, other)
    assert chunks(spark, place) == chunks(spark, other)
    assert spark.read.parquet(f"{place}/out/chunks").count() == 4


def test_chunks_are_those_of_a_batch_ingest(spark, place):
    spark.read.parquet(f"{SF}/documents.parquet").repartition(4).write.parquet(f"{place}/in")
    take(spark, place, strategy="semantic", chunk_size=100, files_per_batch=1)
    elements = layout.single_line_order(text_elements(spark.read.parquet(f"{SF}/documents.parquet"), special=False))
    want = sorted(tuple(r) for r in Chunker("semantic", 100, 1).chunks(elements).select("doc_id", "chunk_no", "text").collect())
    assert [(c[0], c[2], c[5]) for c in chunks(spark, place)] == want


def test_no_documents(spark, place):
    put(spark, place, [])
    take(spark, place)
    assert chunks(spark, place) == []


def test_globs():
    assert chunk_documents.as_glob("/a/b.parquet") == "/a/b.parque[t]" and chunk_documents.as_glob("/a/*.parquet") == "/a/*.parquet" and chunk_documents.as_glob("s://a/b/") == "s://a/[b]"


VECTORS = "vec_id long, embedding array<float>"


def ask(spark, place, docs, vectors, **settings):
    spark.createDataFrame(docs, DOCS).write.mode("overwrite").parquet(f"{place}/docs")
    spark.createDataFrame(vectors, VECTORS).write.mode("overwrite").parquet(f"{place}/vectors")
    said = answer_prompts.run(spark, f"{place}/docs", f"{place}/vectors", f"{place}/out", {"every": 2, "top_k": 2} | settings)
    return said, {r.query_id: r for r in answer_prompts.read(spark, f"{place}/out", answer_prompts.PROMPTS).collect()}


def test_prompts(spark, place):
    docs = [(0, "zero\nmore", "en", 1), (1, "one", "en", 1), (2, None, "fr", 1), (3, "three", None, 1), (4, "four", None, 1), (3, "three", None, 1), (None, "x", "en", 1), (6, "no vector", "en", 1)]
    vectors = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 1.0]), (3, [0.1, 1.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (7, [1.0, 0.05]), (None, [1.0, 0.0]), (5, None)]
    said, rows = ask(spark, place, docs, vectors)
    assert set(rows) == {0, 2, 4} and said["prompts"] == 3 == said["with_context"]
    # 4 is equal to 0 and comes first; 7 is the next but has no document.
    assert rows[0].source_ids == [4] and rows[0].scores == [1.0] and rows[0].retrieved_chunks == 1
    assert rows[0].question == "What else is said about: zero" and "Context:\nfour\n\nQuestion: What else is said about: zero" in rows[0].prompt
    assert rows[2].source_ids == [3, 1] and rows[2].question == "What else is said about: " and rows[2].lang == "fr"
    assert rows[4].source_ids == [0] and rows[4].lang is None
    # Again: the same rows; partitions that get none are left as they are.
    assert ask(spark, place, docs, vectors)[1] == rows
    changed = [d if d[0] != 4 else (4, "quatre", None, 1) for d in docs]
    assert "quatre" in ask(spark, place, changed, vectors)[1][0].prompt
    assert ask(spark, place + "-none", [], [])[1] == {}


def test_no_hits(spark, place):
    rows = ask(spark, place, [(2, "two", "en", 1)], [(2, [1.0])])[1]
    assert rows[2].source_ids == [] and rows[2].retrieved_chunks == 0 and "Context:\n\n\nQuestion" in rows[2].prompt


def test_command_lines(spark, place, monkeypatch, caplog):
    stopped = []
    monkeypatch.setattr(type(spark), "stop", lambda self: stopped.append(1))
    settings = f"{place}/settings"
    spark.createDataFrame([(json.dumps({"strategy": "fixed", "chunk_size": 9, "chunk_overlap": 0}),)], "value string").coalesce(1).write.text(settings)
    put(spark, place, FIRST)
    caplog.set_level("INFO")
    chunk_documents.main(["--documents", f"{place}/in", "--output", f"{place}/out", "--checkpoint", f"{place}/mark", "--config", settings])
    assert len(chunks(spark, place)) == 3
    events = [json.loads(r.message) for r in caplog.records if r.name == "lamina.jobs"]
    assert [e["event"] for e in events] == ["start", "batch", "end"] and events[1]["read"] == 6 and events[1]["documents"] == 5 and events[0]["settings"]["chunk_size"] == 9
    answer_prompts.main(["--documents", f"{SF}/documents.parquet", "--embeddings", f"{SF}/embeddings.parquet", "--output", f"{place}/prompts"])
    assert answer_prompts.read(spark, f"{place}/prompts", answer_prompts.PROMPTS).count() == 2 and len(stopped) == 2
    monkeypatch.undo()
    for job, name in ((chunk_documents, "chunk_documents"), (answer_prompts, "answer_prompts")):
        assert set(common.config(spark, f"file:///root/repo/jobs/{name}.json".replace("/root/repo", str(__import__("pathlib").Path(__file__).parents[1])), job.DEFAULTS)) == set(job.DEFAULTS)
    with pytest.raises(ValueError):
        common.config(spark, settings, {"other": 1})
