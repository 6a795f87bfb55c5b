"""Odd inputs on which queries differed from their SQL, and steps that grew faster than their input."""

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lamina import queries
from lamina.operators import export, search
from tests import oracle

SF = "/root/testdata/sf0.001"


def tables(spark, folder, **changed) -> str:
    """The smallest tables in a folder, some of them changed."""
    for t in oracle.TABLES:
        if t in changed:
            pq.write_table(changed[t].toArrow(), f"{folder}/{t}.parquet")
        else:
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["last_pool", "cls_pool", "mean_pool"])
def test_batches_that_end_early(spark, tmp_path, name):
    sf = tables(spark, tmp_path, embeddings=spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id not in (20, 33) and vec_id < 152"))
    oracle.same(queries.QUERIES[name](spark, sf), oracle.connect(sf), queries.SQL[name])


@pytest.mark.parametrize("name", ["engine_file_status", "engine_statistics"])
def test_texts_of_list_items_alone(spark, tmp_path, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    sf = tables(spark, tmp_path, documents=docs.unionByName(docs.limit(1).selectExpr("99999L as doc_id", "'- one two\n- three' as text", "lang", "source", "9L as n_chars").select(docs.columns).to(docs.schema)))
    oracle.same(queries.QUERIES[name](spark, sf), oracle.connect(sf), queries.SQL[name])


@pytest.mark.parametrize("name", ["engine_file_status", "engine_statistics"])
def test_texts_without_anything_to_read(spark, tmp_path, name):
    """Long lists, fences alone, and texts without a line: one chunk each in SQL; lines of fences are lines."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(5)
    odd = ["- item" + " word" * 1200, "- one\n" * 700, "```", "```\ncode\n```", "", "  \n ", None]
    rows = spark.createDataFrame([(90000 + k, text) for k, text in enumerate(odd)], "doc_id long, text string")
    sf = tables(spark, tmp_path, documents=docs.unionByName(rows.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "cast(length(text) as bigint) as n_chars").select(docs.columns).to(docs.schema)))
    oracle.same(queries.QUERIES[name](spark, sf), oracle.connect(sf), queries.SQL[name])


def test_unread_texts_are_cut_by_default(spark):
    """Chunks of list items: windows, or one with every token, or none; an empty document is known by its table alone."""
    from lamina.operators.chunking import Chunker
    from lamina.sources.text import ordered_text_elements

    docs = spark.createDataFrame([("a", "- item" + " word" * 28), ("b", ""), ("c", "Words to read")], "doc_id string, text string")
    elements = ordered_text_elements(docs)
    sizes = lambda unread: sorted((r.doc_id, len(r.text.split())) for r in Chunker("fixed", 10, 0, unread).chunks(elements, docs).collect())
    assert sizes("cut") == [("a", 10), ("a", 10), ("a", 10), ("c", 3)]
    assert sizes("one") == [("a", 30), ("b", 0), ("c", 3)]
    assert sizes("none") == [("c", 3)]
    with pytest.raises(ValueError):
        Chunker("fixed", unread="some")


def test_dealt_search_shuffles_each_row_once(spark, monkeypatch):
    """Rows go to one place whatever the size of a slice of queries; only queries are copied."""
    placed = []
    held = search.meet_held
    monkeypatch.setattr(search, "meet_held", lambda queries, rows, *more: placed.append(rows) or held(queries, rows, *more))
    rows = spark.range(300).select(F.col("id").alias("chunk_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    asked = rows.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    got = search.top_k_batch(rows, asked, 1, slice_bytes=64)
    assert got.count() == 300 and got.where("query_id = chunk_id").count() == 300
    assert placed[0].agg(F.sum(F.size("ids"))).first()[0] == 300


def test_csv_is_written_by_every_task(spark, tmp_path, monkeypatch):
    """Documents of several files give several CSV files, however large they are."""
    from lamina.sources import ranges

    spark.read.parquet(f"{SF}/documents.parquet").repartition(6).write.parquet(f"file://{tmp_path}/documents.parquet")
    seen = []
    cells = ranges.csv_cells_ranged
    monkeypatch.setattr(ranges, "csv_cells_ranged", lambda spark, folder: seen.append(folder) or cells(spark, folder))
    assert queries.QUERIES["csv_ranges"](spark, str(tmp_path)).count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(spark.read.text(seen[0]).inputFiles()) > 2


def test_large_trees_are_listed_in_parts(spark, tmp_path, monkeypatch):
    """No more files at a time than a folder holds; the same documents and elements as at once."""
    from lamina.sources import files

    rows = [(f"d{n}", f"line {n}\n- more") for n in range(40)]
    export.write_files(spark.createDataFrame(rows, "doc_id string, json string"), f"file://{tmp_path}/in", ".txt", 8).count()
    (tmp_path / "in/top.txt").write_text("on top")
    (tmp_path / "in/x.zip").write_bytes(b"PK")
    (tmp_path / "in/empty.json").write_bytes(b"")
    whole = [oracle.rows(x.drop("metadata", "style").toPandas()) for x in files.parse_path(spark, f"file://{tmp_path}/in")]
    seen = []
    listed = files._listed
    monkeypatch.setattr(files, "FILES_AT_ONCE", 10)
    monkeypatch.setattr(files, "_listed", lambda found: seen.append(len(found.inputFiles())) or listed(found))
    parts = [oracle.rows(x.drop("metadata", "style").toPandas()) for x in files.parse_path(spark, f"file://{tmp_path}/in")]
    assert parts == whole and len(whole[0]) == 43 and sum(seen) == 43 and max(seen) < 20


def test_the_driver_holds_the_listing_of_one_part(spark, tmp_path, monkeypatch):
    """A tree is never listed as a whole, small folders are read together, listings are not kept, and settings are as before."""
    import gc
    import weakref

    from lamina.sources import files

    root, cached = f"file://{tmp_path}/in", "spark.sql.hive.filesourcePartitionFileCacheSize"
    export.write_files(spark.createDataFrame([(f"d{n}", f"line {n}") for n in range(60)], "doc_id string, json string"), root, ".txt", 20).count()
    (tmp_path / "in/0").mkdir(exist_ok=True)
    (tmp_path / "in/0/large.csv").write_text("a,b\n" + "1,2\n" * 100)
    (tmp_path / "in/0/latin.csv").write_bytes("a,b\n".encode() + "é,2\n".encode("latin-1") * 100)
    calls, given, alive = [], [], []
    found, contents = files._found, files._contents
    monkeypatch.setattr(files, "FILES_AT_ONCE", 20)
    monkeypatch.setattr(files, "_found", lambda spark, path, *more: calls.append((path, spark.conf.get(cached))) or found(spark, path, *more))

    def watched(part, frame, listed):
        alive.append(sum(x() is not None for x in given))
        given.append(weakref.ref(frame._jdf))
        return contents(part, frame, listed)

    monkeypatch.setattr(files, "_contents", watched)
    gc.disable()
    before = dict(spark.conf.getAll)
    try:
        documents, elements = files.parse_path(spark, root, 200)
    finally:
        gc.enable()
    assert {k: v for k, v in spark.conf.getAll.items() if "arrow" not in k} == {k: v for k, v in before.items() if "arrow" not in k}
    assert all(path != root and [root] != path and held.startswith("0") for path, held in calls)
    assert 4 <= len(calls) <= 8 and len(alive) > 2 and max(alive) == 0
    kinds = {r["doc_id"].rsplit("/", 1)[-1]: r["errors"] for r in documents.collect()}
    assert len(kinds) == 62 and kinds["large.csv"] is None and "not UTF-8" in kinds["latin.csv"][0]
    assert elements.where("element_type = 'paragraph'").count() == 60


def test_small_files_of_many_elements_leave_early(spark, monkeypatch):
    """Workbooks of a few kilobytes each: a batch that leaves the parser holds few elements."""
    from types import SimpleNamespace

    import pyarrow as pa

    from lamina.sources import files

    taken = []
    fake = SimpleNamespace(sparkSession=spark, select=lambda *names: SimpleNamespace(mapInArrow=lambda run, kind: taken.append(run)))
    files.parse_files(fake)
    monkeypatch.setattr(files, "PARSED_ELEMENTS", 100, raising=False)
    book = queries._workbook([f"n{k}" for k in range(50)])
    given = pa.RecordBatch.from_pydict({"path": [f"b{k}" for k in range(12)], "file_type": ["excel"] * 12, "content": [book] * 12})
    made = list(taken[0]([given]))
    assert sum(b.num_rows for b in made) == 12 and max(b.num_rows for b in made) == 1


@pytest.mark.parametrize("frequent", [[], [1, 2, 3], list(range(5, 2**63, 2**53))])
def test_links_do_not_depend_on_what_is_taken_as_frequent(spark, monkeypatch, frequent):
    """The sample sets the order of tokens in a prefix alone; any order gives the components of SQL."""
    import __spark_entry__
    from lamina.llm import signature_tree

    monkeypatch.setattr(signature_tree, "frequent_tokens", lambda docs, width: np.array(frequent, dtype=np.uint64))
    name = "op4_signature_tree_join"
    oracle.same(__spark_entry__.queries()[name](spark, SF), oracle.connect(SF), __spark_entry__.oracle_sql()[name])


def most_joined(df) -> int:
    """The rows that the largest join of a frame's plan gives, run without adaptive execution."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = df.select("*")
        found.collect()
        left, most = [found._jdf.queryExecution().executedPlan()], 0
        while left:
            node = left.pop()
            if "Join" in node.nodeName():
                most = max(most, node.metrics().apply("numOutputRows").value())
            children = node.children()
            left += [children.apply(i) for i in range(children.size())]
        return most
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_boxes_of_one_place_are_compared_once(spark, monkeypatch):
    """Copies of three boxes, in several blocks each: pairs as by brute force, from a join of few rows."""
    from lamina.operators import layout

    monkeypatch.setattr(layout, "GATHERED", 16, raising=False)
    places = [(0.0, 0.0, 30.0, 30.0), (5.0, 5.0, 20.0, 20.0), (25.0, 8.0, 60.0, 18.0)]
    boxes = [("d", 1, n, f"b{n}", *places[n * 7 % 3]) for n in range(120)]
    rows = spark.createDataFrame(boxes, "doc_id string, page int, pos long, element_id string, x0 double, y0 double, x1 double, y1 double")
    meets = lambda a, b: a[4] <= b[6] and b[4] <= a[6] and a[5] <= b[7] and b[5] <= a[7]
    holds = lambda a, b: a[4] <= b[4] and a[5] <= b[5] and a[6] >= b[6] and a[7] >= b[7]
    wanted = [(a[3], b[3], "contains" if holds(a, b) else "intersects") for a in boxes for b in boxes if a[2] < b[2] and meets(a, b)]
    found = layout.overlapping(rows)
    assert sorted((r.element1, r.element2, r.overlap_type) for r in found.collect()) == sorted(wanted)
    assert sorted((r.parent, r.child) for r in layout.nested(rows).collect()) == sorted(w[:2] for w in wanted if w[2] == "contains")
    assert len(wanted) > 3000 > 20 * most_joined(found)


def test_regions_of_one_place_are_ranked_once(spark, monkeypatch):
    """Equal questions, in several blocks: each has its own ranks, those without an id too, from a join of few rows."""
    from lamina.operators import layout

    monkeypatch.setattr(layout, "GATHERED", 16, raising=False)
    kind = "doc_id string, page int, pos long, element_id string, x0 double, y0 double, x1 double, y1 double"
    elements = spark.createDataFrame([("d", 1, n, f"e{n}", n * 3.0, 5.0, n * 3.0 + 4, 9.0) for n in range(60)], kind)
    regions = spark.createDataFrame([(None if n == 7 else n, "d", 1, n % 2 * 90.0, 0.0, n % 2 * 90.0 + 10, 10.0) for n in range(100)], "query_id long, doc_id string, page int, x0 double, y0 double, x1 double, y1 double")
    wanted = []
    for n in range(100):
        x = n % 2 * 90.0 + 5
        near = sorted((((k * 3.0 + 2 - x) ** 2 + 4) ** 0.5, k) for k in range(60))
        wanted += [(-1 if n == 7 else n, k, r + 1) for r, (far, k) in enumerate(near) if far <= 100]
    found = layout.spatial_context(elements, regions)
    assert sorted((-1 if r.query_id is None else r.query_id, r.pos, r["rank"]) for r in found.collect()) == sorted(wanted)
    assert len(wanted) > 3000 > 5 * most_joined(found)


def test_texts_are_ordered_without_a_shuffle(spark):
    """The reading order of plain texts, of texts with blocks, of rows that share an id and of those without one; only the latter are dealt."""
    from lamina.operators import layout
    from lamina.sources import text

    rows = [("a", "TITLE\n\none two\n- three"), ("b", "x | y\n| 1 | 2 |\n| 3 | 4 |\nend"), ("c", "```py\nq = 1\n```\nafter"), ("d", "first\nsecond"), ("d", "other\nmore"), (None, "p\nq"), (None, "r"), ("e", None), ("f", "")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    of = lambda df: oracle.rows(df.select("doc_id", "element_type", "content", "y0", "pos", "ro_pos").toPandas())
    found = of(text.ordered_text_elements(docs))
    wanted = of(layout.reading_order(text.text_elements(docs)))
    # Rows of one id that are equal in place may be numbered either way.
    plain = lambda rows: [r for r in rows if r[1] not in ("d", None)]
    assert len(found) == len(wanted) and plain(found) == plain(wanted)
    assert sorted((r[1], r[-2]) for r in found if r[1] == "d") == sorted((r[1], r[-2]) for r in wanted if r[1] == "d")


def test_ingest_shuffles_no_vectors(spark, tmp_path, monkeypatch):
    """Chunks are added as they are read: neither by id nor by cell are texts and vectors dealt out."""
    from lamina.operators.store import VectorStore
    from lamina.plans.engine import Engine

    plans = []
    put = VectorStore._put
    monkeypatch.setattr(VectorStore, "_put", staticmethod(lambda rows, *more: plans.append((rows, more)) or put(rows, *more)))
    made = Engine(spark, f"file://{tmp_path}/e", embedder_config={"dimension": 8})
    plans.clear()
    made.ingest_texts(spark.createDataFrame([("a", "one two"), ("b", "three")], "doc_id string, text string"))
    (rows, more), = plans
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString() and more[2:] == (False,)
    assert made.store.count() == 2


def test_probes_are_told_by_one_search(spark, tmp_path, monkeypatch):
    """The number of probes is the least power of two whose search reaches the recall, from a single exact search."""
    from lamina.operators.store import VectorStore

    rows = spark.range(400).select(F.concat(F.lit("v"), "id").alias("chunk_id"), F.array(*[F.sin(F.col("id") * n).cast("float") for n in (1, 3, 7, 11)]).alias("embedding"), F.lit("t").alias("text"))
    made = VectorStore(spark, f"file://{tmp_path}/v", 4)
    made.add(rows)
    cells = made.build_index(8)
    seen, search_all = [], made.query_batch
    monkeypatch.setattr(made, "query_batch", lambda *a, **more: seen.append(more) or search_all(*a, **more))
    probes = made.probes_for(0.9, 5)
    assert seen == [{}]
    step = 400 // 200
    asked = made.read().where(F.pmod(F.xxhash64("chunk_id", F.lit(3)), F.lit(step)) == 0).select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_embedding"))
    ids = lambda n: {(r.query_id, r.chunk_id) for r in search_all(asked, 5, probes=n).collect()}
    exact = {(r.query_id, r.chunk_id) for r in search_all(asked, 5).collect()}
    assert len(ids(probes) & exact) >= 0.9 * len(exact) and probes <= cells
    assert probes == 1 or len(ids(probes // 2) & exact) < 0.9 * len(exact)


def test_folds_and_embedders_hold_little():
    """Chunks leave the fold some documents at a time, and what an embedder remembers goes at a task's end."""
    import pyarrow as pa

    from lamina.operators import chunking, embedding

    batch = pa.RecordBatch.from_pydict({"doc_id": [n // 30 for n in range(9000)], "t": list(range(9000))})
    made = list(chunking._parts([batch, batch.slice(0, 5)]))
    assert [v for b in made for v in b.column(1).to_pylist()] == [*range(9000), *range(5)]
    assert max(b.num_rows for b in made) < chunking.FOLDED_ROWS + 30 and all(b.column(0)[-1] != c.column(0)[0] for b, c in zip(made[:-2], made[1:-1]))
    model = embedding.HashingEmbedder(8)
    model.embed(["one two"])
    model.forget()
    assert not model.known
