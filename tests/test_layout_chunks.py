import random

import pytest
from hypothesis import given, settings, strategies as st

from lamina.operators import chunking, layout

FIELDS = "doc_id string, pos int, element_id string, element_type string, content string, page int, x0 double, y0 double, x1 double, y1 double"


def boxes(spark, rows):
    return spark.createDataFrame([("d", i, f"e{i}", kind, text, page, float(a), float(b), float(c), float(d)) for i, (kind, text, page, a, b, c, d) in enumerate(rows)], FIELDS)


def brute_order(rows):
    out = []
    for page in sorted({r[2] for r in rows}):
        mine = sorted((i for i, r in enumerate(rows) if r[2] == page), key=lambda i: (rows[i][4], rows[i][3], i))
        lines, anchor = [], None
        for i in mine:
            center = (rows[i][4] + rows[i][6]) / 2
            if anchor is None or abs(center - anchor) > 5.0:
                lines.append([])
                anchor = center
            lines[-1].append(i)
        for line in lines:
            out += sorted(line, key=lambda i: (rows[i][3], rows[i][4], i))
    return out


def test_reading_order_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [("text", "", rng.randrange(3), x := rng.randrange(300), y := rng.randrange(60), x + 30, y + rng.randrange(5, 15)) for _ in range(150)]
    got = [r.pos for r in layout.reading_order(boxes(spark, rows)).orderBy("ro_pos").collect()]
    assert got == brute_order(rows)


def test_pairs_match_brute_force(spark):
    rng = random.Random(5)
    rows = [("text", "", rng.randrange(2), x := rng.randrange(900), y := rng.randrange(900), x + rng.randrange(1, 400), y + rng.randrange(1, 300)) for _ in range(60)]
    over, nest, near = set(), set(), set()
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            if a[2] != b[2]:
                continue
            ax0, ay0, ax1, ay1, bx0, by0, bx1, by1 = *a[3:], *b[3:]
            xo, yo = ax0 <= bx1 and bx0 <= ax1, ay0 <= by1 and by0 <= ay1
            if xo and yo:
                over.add((f"e{i}", f"e{j}"))
            if ax0 <= bx0 and ay0 <= by0 and ax1 >= bx1 and ay1 >= by1:
                nest.add((f"e{i}", f"e{j}"))
            if ((abs(ax1 - bx0) <= 10 or abs(bx1 - ax0) <= 10) and yo) or ((abs(ay1 - by0) <= 10 or abs(by1 - ay0) <= 10) and xo):
                near.add((f"e{i}", f"e{j}"))
    e = boxes(spark, rows)
    assert {(r.element1, r.element2) for r in layout.overlapping(e).collect()} == over and len(over) > 20
    assert {(r.parent, r.child) for r in layout.nested(e).collect()} == nest
    assert {(r.element1, r.element2) for r in layout.adjacent(e).collect()} == near


def test_alignment_rounds_half_to_even(spark):
    rows = [("text", "", 0, 0, 0, 5, 0), ("text", "", 0, 5, 40, 10, 40), ("text", "", 0, 10, 80, 15, 80), ("text", "", 1, 1, 200, -1, 200)]
    got = {(r.alignment, r.coordinate): list(r.element_ids) for r in layout.alignment_groups(boxes(spark, rows)).collect()}
    # Centres 2.5, 7.5, 12.5 and 0 snap to 0, 10, 10 and 0.
    assert got == {("vertical", 0.0): ["e0", "e3"], ("vertical", 10.0): ["e1", "e2"]}


def test_flow_and_columns(spark):
    two = [("text", "", 0, x, y, x + 100, y + 10) for y in range(0, 200, 20) for x in (0, 300)]
    flow = layout.reading_flow(boxes(spark, two)).first()
    assert flow.flow_type == "two_column"
    assert layout.reading_flow(boxes(spark, two[:2])).first().flow_type == "unknown"
    assert sum(r.n for r in layout.detect_columns(boxes(spark, two)).collect()) == len(two)
    assert [r.n for r in layout.detect_columns(boxes(spark, [("text", "", 0, 5, 5, 5, 5)])).collect()] == [1]


def fold(sizes, size, overlap, heads=()):
    out, open_ = [], []
    for i, t in enumerate(sizes):
        if sum(sizes[k] for k in open_) + t > size and sum(sizes[k] for k in open_) > 0:
            out.append(list(open_))
            open_ = [] if i in heads else open_[max(0, len(open_) - overlap) :]
        open_.append(i)
    return out + ([open_] if open_ else [])


@settings(max_examples=12, deadline=None)
@given(st.lists(st.integers(0, 9), min_size=1, max_size=15), st.integers(1, 12), st.integers(0, 4), st.sets(st.integers(0, 14)))
def test_semantic_fold(spark, sizes, size, overlap, heads):
    rows = [("heading" if i in heads else "paragraph", " ".join(["w"] * n), 0, 0, 20 * i, 8, 20 * i + 20) for i, n in enumerate(sizes)]
    got = [[int(x[1:]) for x in r.element_ids] for r in chunking.semantic_chunks(boxes(spark, rows), size, overlap).orderBy("chunk_no").collect()]
    assert got == fold(sizes, size, overlap, heads)


@settings(max_examples=12, deadline=None)
@given(st.integers(0, 40), st.integers(1, 9), st.integers(0, 8))
def test_fixed_windows(spark, n, size, overlap):
    docs = spark.createDataFrame([("d", " ".join(map(str, range(n))))], "doc_id string, content string")
    if overlap >= size:
        with pytest.raises(ValueError):
            chunking.fixed_chunks(docs, size, overlap)
        return
    got = [(r.start_idx, r.end_idx, r.text) for r in chunking.fixed_chunks(docs, size, overlap).orderBy("chunk_no").collect()]
    want, start = [], 0
    while n and (not want or want[-1][1] < n):
        want.append((start, min(n, start + size), " ".join(map(str, range(start, min(n, start + size))))))
        start += size - overlap
    assert got == want


def test_hierarchical(spark):
    texts = [("paragraph", "before"), ("heading", "One"), ("paragraph", "a b c"), ("table", "t t"), ("heading", "Two"), ("heading", "Three"), ("paragraph", "x y z"), ("paragraph", "u v w"), ("paragraph", "q")]
    rows = [(k, t, i // 5, 0, 20 * i, 8, 20 * i + 20) for i, (k, t) in enumerate(texts)]
    got = [(r.heading, r.text, r.page_start, r.page_end) for r in chunking.hierarchical_chunks(boxes(spark, rows), 6, 0).orderBy("chunk_no").collect()]
    assert got == [("One", "One\na b c\nt t", 0, 0), ("Two", "Two", 0, 0), ("Three", "Three\nx y z", 1, 1), ("Three", "Three (continued)\nu v w\nq", 1, 1)]
    flat = chunking.hierarchical_chunks(boxes(spark, rows[:1]), 6, 0).collect()
    assert [(r.heading, r.text) for r in flat] == [(None, "before")]


def test_chunker_settings():
    with pytest.raises(ValueError):
        chunking.Chunker("other")
    assert chunking.Chunker("fixed", 10, 2).chunk_overlap == 2


def test_rows_that_share_an_id_stay_apart(spark):
    """Two documents of one id: as many elements and numbers as rows, none twice."""
    from lamina.sources import text

    docs = spark.createDataFrame([("d", "A\n|a|b|\n|c|d|"), ("d", "x\n|e|f|")], "doc_id string, text string")
    elements = text.text_elements(docs)
    assert sorted(r.content for r in elements.where("element_type = 'table'").collect()) == ["|a|b|\n|c|d|", "|e|f|"]
    ordered = layout.reading_order(elements)
    assert ordered.count() == elements.count() == 7 and [r.ro_pos for r in ordered.orderBy("ro_pos").collect()] == list(range(7))


def test_batches_of_any_size(spark):
    """Documents that span Arrow batches, and batches that span documents."""
    rows = [(f"d{k % 7}", 0, k, f"e{k}", "heading" if k % 13 == 0 else "text", "w " * (k % 5), float(k % 3), 10.0 * (k // 21), 5.0, 10.0 * (k // 21) + 4) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id string, page int, pos int, element_id string, element_type string, content string, x0 double, y0 double, x1 double, y1 double")
    out = []
    for size in ("3", "50", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        found = [layout.reading_order(frame).select("doc_id", "pos", "ro_pos"), chunking.hierarchical_chunks(frame, 6, 1), chunking.semantic_chunks(frame, 6, 1)]
        out.append([sorted(map(repr, f.collect())) for f in found])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert out[0] == out[1] == out[2] and len(out[0][0]) == 400


def test_long_pages_are_linear(spark):
    """Four times the lines of one page may not take sixteen times as long."""
    import time

    def seconds(n):
        page = spark.createDataFrame([("d", "\n".join(f"line {k}" for k in range(n)))], "doc_id string, text string")
        from lamina.sources import text

        began = time.time()
        assert layout.reading_order(text.text_elements(page, special=False)).count() == n
        return time.time() - began

    seconds(100)
    short = min(seconds(4000) for _ in range(2))
    assert min(seconds(16000) for _ in range(2)) < 4 * short + 2


def brute_places(rows):
    """Reading order by a loop: rows (doc, page, pos, x0, y0, x1, y1)."""
    out = {}
    none = lambda v: (v is not None, v)
    for doc in {r[0] for r in rows}:
        own, line, lines = sorted((r for r in rows if r[0] == doc), key=lambda r: (none(r[1]), none(r[4]), none(r[3]), r[2])), [], []
        centre = lambda r: None if None in (r[4], r[6]) else (r[4] + r[6]) / 2
        for r in own:
            if line and line[0][1] == r[1] and None not in (centre(r), centre(line[0])) and abs(centre(r) - centre(line[0])) <= 5:
                line.append(r)
            else:
                line = [r]
                lines.append(line)
        flat = [r for x in lines for r in sorted(x, key=lambda r: (none(r[3]), none(r[4]), r[2]))]
        out |= {(doc, r[2]): n for n, r in enumerate(flat)}
    return out


PLACED = "doc_id string, page int, pos int, x0 double, y0 double, x1 double, y1 double, element_id string"


def placed(spark, rows):
    return spark.createDataFrame([(*r, f"e{r[2]}") for r in rows], PLACED)


def test_reading_order_of_every_kind_of_page(spark):
    """Pages of single lines, lines of several boxes, tall boxes, boxes that creep downward, boxes without a place."""
    rng = random.Random(5)
    rows = []
    for d in range(12):
        for pos in range(60):
            y = {0: 20.0 * pos, 1: 20.0 * (pos // 3), 2: rng.randrange(300) * 1.0, 3: 3.0 * pos}[d % 4]
            high = 200.0 if d in (4, 6) and pos % 9 == 0 else 10.0
            box = (rng.randrange(5) * 50.0, y, 400.0, y + high)
            if d == 8 and pos % 7 == 0:
                box = (None, None, None, None)
            rows.append((f"d{d}", None if d == 9 else pos % (d % 3 + 1), pos, *box))
    rng.shuffle(rows)
    got = {(r.doc_id, r.pos): r.ro_pos for r in layout.reading_order(placed(spark, rows).repartition(5)).collect()}
    assert got == brute_places(rows)


def test_pairs_of_boxes_of_any_size(spark):
    rng = random.Random(6)
    rows = [("a", rng.randrange(2), p, x := rng.uniform(-500, 500), y := rng.uniform(-500, 500), x + 10 ** rng.uniform(-1, 3), y + 10 ** rng.uniform(-1, 3)) for p in range(150)]
    rows += [("a", 0, 150, None, 0.0, 1.0, 1.0), ("a", 0, 151, 10.0, 10.0, 5.0, 5.0)]
    touch = lambda a, b: a[3] <= b[5] and b[3] <= a[5] and a[4] <= b[6] and b[4] <= a[6]
    holds = lambda a, b: a[3] <= b[3] and a[4] <= b[4] and a[5] >= b[5] and a[6] >= b[6]

    def near(a, b):
        gap = lambda p, q: abs(a[q] - b[p]) <= 10 or abs(b[q] - a[p]) <= 10
        common = lambda p, q: a[q] >= b[p] and b[q] >= a[p]
        return (gap(3, 5) and common(4, 6)) or (gap(4, 6) and common(3, 5))

    want = set()
    for a in rows[:-2]:
        for b in rows[:-2]:
            if a[1] == b[1] and a[2] < b[2] and (touch(a, b) or holds(a, b) or near(a, b)):
                want.add((a[2], b[2], touch(a, b), holds(a, b), near(a, b)))
    got = {(r.pos1, r.pos2, r.overlapping, r.nested, r.adjacent) for r in layout.pairs(placed(spark, rows)).collect() if r.pos2 < 150}
    assert got == want and len(want) > 100


def test_a_box_as_wide_as_a_sheet(spark):
    """One box of 1.6 million x 21 million units with 10,000 small ones in it."""
    small = [("a", 0, p, x := p % 100 * 16_000.0, y := p // 100 * 200_000.0, x + 50, y + 20) for p in range(1, 10_001)]
    rows = [("a", 0, 0, 0.0, 0.0, 1.6e6, 2.1e7), *small]
    got = layout.pairs(placed(spark, rows))
    assert got.where("pos1 = 0 and nested").count() == 10_000 == got.count()
