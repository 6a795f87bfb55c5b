import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.llm import components as cc, signature_tree as st
from tests.llm.helpers import clashing, corpus, edited, empty, prose, table


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if len(words) >= width else {tuple(words)}


def brute(rows, width, percent):
    """{id: ({sizes}, component)} with rows that share an id as one node."""
    sets = [(i, shingles(t, width)) for i, t, *_ in rows]
    up: dict = {i: i for i, _ in sets if i is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(i, s) for i, s in sets if i is not None and s]
    for k, (i, s) in enumerate(known):
        for j, t in known[k + 1 :]:
            common = len(s & t)
            if 100 * common >= percent * (len(s) + len(t) - common):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sorted(repr((i, len(s), None if i is None else find(i))) for i, s in sets)


def result(df):
    return sorted(repr((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


@pytest.mark.parametrize("width,percent", ((4, 85), (5, 80)))
def test_matches_brute_force(spark, width, percent):
    assert result(st.jaccard_components(clashing(table(spark)), width=width, percent=percent)) == brute(corpus(), width, percent)


def test_large_families_in_small_chunks(spark, monkeypatch):
    rng = random.Random(9)
    base = prose(rng, 120)
    texts = [edited(rng, base, rng.randrange(0, 9)) for _ in range(70)] + [edited(rng, prose(rng, 60), 1) for _ in range(30)]
    rows = [(i, t, "en", "s", None) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    for limit in (10**6, 0):  # with and without the broadcast of ids
        monkeypatch.setattr(st, "BROADCAST_IDS", limit)
        assert result(st.jaccard_components(table(spark, rows), width=4, percent=85, chunk=8)) == brute(rows, 4, 85)


def test_last_pass_alone_is_complete(spark, monkeypatch):
    """Without the passes that merely save work, the blocks over all prefix tokens find every link."""
    monkeypatch.setattr(st, "first_pass", lambda reps: reps.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0))
    monkeypatch.setattr(st, "likeliest", lambda pairs, most: pairs.select("a", "b").limit(0))
    rng = random.Random(10)
    base = prose(rng, 150)
    rows = [(i, edited(rng, base, rng.randrange(0, 14)), "en", "s", None) for i in range(60)]
    assert result(st.jaccard_components(table(spark, rows), width=4, percent=85, chunk=16)) == brute(rows, 4, 85)


def test_likeliest_pairs_come_out_of_blocks():
    """What a block leaves out of the second pass is nobody's likeliest pair; what comes out is linear in its members."""
    rng = random.Random(12)
    found = [(a, b, round(rng.random(), 2)) for a in range(60) for b in range(a + 1, 60)]
    got = st.most_likely([(b, a, e) if rng.random() < 0.5 else (a, b, e) for a, b, e in found], 3)
    want = set()
    for i in range(60):
        want |= set(sorted((p for p in found if i in p[:2]), key=lambda p: (-p[2], p[0], p[1]))[:3])
    assert set(got) == want and len(got) <= 180 and st.most_likely(found, None) == found


def test_hub_is_no_near_copy_of_most(spark):
    """Copies with one edit each, far enough apart not to link, around one text with a large id that links to all."""
    rng = random.Random(13)
    base = prose(rng, 90).replace("\n", " ").split(" ")
    texts = []
    for k in range(80):
        own = list(base)
        own[4 + k] = f"own{k}"
        texts.append(" ".join(own))
    rows = [(i, t, "en", "s", None) for i, t in enumerate([*texts, " ".join(base)])]
    got = st.jaccard_components(table(spark, rows), chunk=16)
    assert result(got) == brute(rows, 5, 80) and got.select("component_id").distinct().count() == 1


def test_tree_prunes_no_link():
    rng = np.random.default_rng(1)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 1 << 62, rng.integers(5, 400), dtype=np.uint64)
        for _ in range(4):
            other = base.copy()
            other[rng.integers(0, len(base), max(1, len(base) // 15))] += np.uint64(1)
            sets.append(np.unique(other))
    members = [(i, i, len(s), st.bitmap(s), i % 2) for i, s in enumerate(sets)]
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if st.linked(sets[i], sets[j], 85)}
    one = {(min(a, b), max(a, b)) for a, b, _ in st.block_candidates([(*m[:4], 0) for m in members], 85, 0, 0)}
    assert links <= one and all(i // 4 == j // 4 for i, j in one)
    split = {(min(a, b), max(a, b)) for a, b, _ in st.block_candidates(members, 85, 0, 1)}
    assert {p for p in links if p[0] % 2 != p[1] % 2} <= split
    assert all(st.may_link(len(sets[i]), len(sets[j]), st.bitmap(sets[i]), st.bitmap(sets[j]), 85) for i, j in links)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 40)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(50)] + [(5, 5)]
    up: dict = {}
    find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in up if find(x) != x}
    got = {tuple(r) for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == want
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty(spark):
    assert st.jaccard_components(empty(spark)).count() == 0
