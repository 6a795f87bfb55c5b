"""The stages against brute force, each on its own input."""

import random
import re

import zstandard

import corpus_pipeline as cp
from lamina.llm import compression_bands as cb, piece_scan
from lamina.llm.queries import vocabulary
from tests.llm.helpers import corpus, edited, empty, prose, table
from tests.llm.test_filters import brute_repeats
from tests.llm.test_joins import shingles


def test_stages(spark):
    rows = corpus(seed=8, n=80)
    docs = table(spark, rows)
    names = docs.columns
    kept = cp.quality(spark, docs, "")
    compressor = zstandard.ZstdCompressor(level=3)

    def good(text):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        return len(words) >= 10 and 100 * brute_repeats(words) <= 20 * len(words) and cb.judge((text or "").encode(), compressor, cb.BANDS, cb.CHUNK_BYTES, cb.MAX_BAD_CHUNKS)[2]

    want = sorted(repr(r[:2]) for r in rows if good(r[1]))
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == want and len(want) > 60

    lines = cp.lines(spark, kept, "")
    assert lines.columns == names and lines.where("length(text) = 0").count() == 0 and 0 < lines.count() <= kept.count()

    near = cp.near_duplicates(spark, docs, "")
    check_near(rows, near)

    mixed = cp.mixed(spark, near, "")
    assert mixed.columns == names
    counts = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert max(counts.values()) <= 6 and set(counts) <= {r.doc_id for r in near.collect()}

    ids = cp.encoded(spark, mixed, "")
    back = piece_scan.decode(ids, vocabulary("piece_bpe_32k.model"))
    assert sorted((repr(r.doc_id), r.text) for r in back.collect()) == sorted((repr(r.doc_id), r.text.replace("▁", " ")) for r in mixed.collect())


def groups(rows):
    """Distinct (id, text) of each group of linked texts, by a plain loop; what is not linked stands alone."""
    nodes = sorted({r[:2] for r in rows}, key=repr)
    sets = [shingles(t, 5) for _, t in nodes]
    up = list(range(len(nodes)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(a & b)
            if a and b and 100 * common >= 80 * (len(a) + len(b) - common):
                up[find(i)] = find(j)
    out: dict = {}
    for k, node in enumerate(nodes):
        out.setdefault(find(k), []).append(node)
    return list(out.values())


def check_near(rows, near):
    """One row of each group stays, that of the least id; rows without an id only where no other is linked."""
    found = [(r.doc_id, r.text) for r in near.collect()]
    assert len(found) == len(set(found)) == len(groups(rows)) and set(found) <= {r[:2] for r in rows}
    for group in groups(rows):
        (kept,) = [x for x in found if x in group]
        ids = [i for i, _ in group if i is not None]
        assert kept[0] == (min(ids) if ids else None)


def test_rows_that_share_or_lack_an_id(spark):
    """Unrelated texts under one id all stay; copies go whatever their ids."""
    rng = random.Random(4)
    text = [prose(rng, 80) for _ in range(8)]
    rows = [
        (1, text[0]), (1, text[1]), (1, text[1]), (2, text[1]), (3, edited(rng, text[0], 1)), (0, edited(rng, text[2], 1)), (0, text[3]), (9, text[2]), (9, text[4]), (4, text[4]),
        (None, text[5]), (None, edited(rng, text[5], 1)), (None, text[6]), (None, text[6]), (7, text[6]), (None, text[7]), (None, None), (5, None), (5, None), (6, ""), (None, ""),
    ]
    rows = [(*r, "en", "s", None) for r in rows]
    docs = table(spark, rows)
    near = cp.near_duplicates(spark, docs, "")
    assert near.columns == docs.columns
    check_near(rows, near)


def test_empty_and_run(spark):
    for _, stage in cp.STAGES:
        assert stage(spark, empty(spark), "").count() == 0
    out = cp.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "ids", "n_pieces"] and 0 < out.count() <= 600


def test_temporary_tables_go(spark):
    """A run leaves the table that its result reads, and what the last stage wrote; clashing names crash no stage."""
    from lamina.llm.common import written

    before = len(written())
    out = cp.run(spark, "/root/testdata/sf0.001")
    left = [p.rsplit("/", 1)[-1] for p in written()[before:]]
    assert left == ["source_mix"] + [p for p in left if p == "chunks"] and out.count() > 0


def test_stage_columns_may_clash(spark):
    from pyspark.sql import functions as F

    docs = table(spark, corpus(seed=8, n=40)).withColumns({"n_lines_removed": F.lit("own"), "n_lines_removed_": F.lit(1), "taken": F.lit(2), "component_id": F.lit(3)})
    for _, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, "")
        assert out.columns == docs.columns and out.where("n_lines_removed = 'own'").count() == out.count() > 0
