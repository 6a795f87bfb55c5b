"""CSV by ranges equals the reader of whole files, wherever the ranges begin."""

import csv as std
import io
import random

import pytest
from pyspark.sql import functions as F

from lamina.sources import csv, ranges


@pytest.fixture()
def small_ranges(spark):
    """Ranges of a few bytes; settings are put back."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")

    yield use
    for n, v in before.items():
        spark.conf.set(n, v)


def random_csv(rng, rows=25):
    out = []
    for _ in range(rows):
        fields = []
        for _ in range(rng.randint(1, 4)):
            kind = rng.random()
            if kind < 0.4:
                inner = "".join(rng.choice(['a', ',', '\n', '""', 'é', '\r\n', '\r', ' ', '漢']) for _ in range(rng.randint(0, 12)))
                fields.append(f'"{inner}"' + ("x" if rng.random() < 0.1 else ""))
            elif kind < 0.5:
                fields.append('a"b' + '"' * rng.randint(0, 2))
            else:
                fields.append("".join(rng.choice("abc 1") for _ in range(rng.randint(0, 6))))
        out.append(",".join(fields) + rng.choice(["\n", "\n", "\r\n", "\n\n", "\r"]))
    return "h1,h2,h3\n" + "".join(out)


def test_leaves():
    for line, outside, inside in [("a,b", 0, 1), ('"a', 1, 0), ('a"', 0, 0), ('"a""', 1, 0), ('a","b', 1, 1), ('"a"b","c', 1, 1), ('""', 0, 1), ('"', 1, 0), (',"', 1, 0)]:
        assert (ranges.leaves(line, 0, ","), ranges.leaves(line, 1, ",")) == (outside, inside), line


def test_states_agree_with_the_reader():
    """A line at a record's start ends inside a field if and only if the reader wants another line."""
    rng = random.Random(8)
    for _ in range(3000):
        line = "".join(rng.choice('a",') for _ in range(rng.randint(0, 9)))
        one = len(list(std.reader(io.StringIO(line + "\nz\n", newline="")))) == 1
        assert (ranges.leaves(line + "\n", 0, ",") == 1) == one, line


@pytest.mark.parametrize("size", (41, 1 << 20))
def test_equal_to_the_reader_of_whole_files(spark, tmp_path, small_ranges, size):
    rng = random.Random(size)
    texts = {f"f{n}.csv": random_csv(rng) for n in range(2)} | {"one.csv": 'a,b\n"' + "long\n" * 40 + '",2\n3\n', "head.csv": "only,head\n", "mark.csv": "﻿a,b\n1,2,3\n"}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    small_ranges(size)
    got = {(r.doc_id.rsplit("/", 1)[1], r.row, r.col, r.column_name, r.value, r.is_header) for r in ranges.csv_cells_ranged(spark, f"file://{tmp_path}").collect()}
    whole = csv.csv_cells(spark.createDataFrame([(k, v.removeprefix("﻿")) for k, v in texts.items()], "doc_id string, content string"), "doc_id", "content")
    want = {tuple(r) for r in whole.collect()}
    assert got == want and len(want) > 100
    if size < 100:
        assert ranges.ranged_lines(spark, f"file://{tmp_path}").rdd.getNumPartitions() > 12


def test_large_files_of_a_folder_go_by_ranges(spark, tmp_path, small_ranges):
    from lamina.sources.files import parse_path

    (tmp_path / "big.csv").write_text("k,v\n" + "".join(f'{n},"line\n{n}"\n' for n in range(120)))
    (tmp_path / "small.csv").write_text("k,v\n1,2\n")
    (tmp_path / "latin.csv").write_bytes(b"k,v\n\xe9,2\n" * 200)
    small_ranges(400)
    found = []
    for large in (1000, 1 << 30):
        documents, elements = parse_path(spark, f"file://{tmp_path}", large_csv=large)
        facts = sorted((r.doc_id, r.file_type, r.parser_used, r.metadata["encoding"], r.metadata["file_size"], r.metadata["line_count"], r.metadata["delimiter"], bool(r.errors)) for r in documents.collect())
        found.append((facts, sorted((r.doc_id, r.pos, r.element_type, r.content) for r in elements.select("doc_id", "pos", "element_type", "content").collect())))
    assert found[0] == found[1] and len(found[0][0]) == 3
