import math

import numpy as np
import pytest

from lamina.llm import balltree

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every, k, scale=256):
    good = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    queries: dict = {}
    for i, v in good:
        if i % every == 0 and (i not in queries or (len(v), v) < (len(queries[i]), queries[i])):
            queries[i] = v
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in good if i != q and len(w) == len(v))[:k]
        out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    return out


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(5, 8))
    rows = [(i, (centres[i % 5] + 0.1 * rng.normal(size=8)).astype(np.float32).tolist(), None) for i in range(600)]
    rows += [(1000 + i, rows[0][1], 3) for i in range(80)]  # one very common vector
    rows += [(2000, None, 1), (2010, [1.0, None] + [0.0] * 6, 1), (2020, [float("nan")] * 8, 1), (2030, [float("inf")] * 8, 1), (None, [0.0] * 8, 1), (2040, [0.0] * 8, 1), (2050, [1.0, 2.0], 1), (2051, [2.0, 2.0], 1), (2060, [], 1), (20, [9.0] * 8, 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in balltree.top_k(df, lambda i: i % 10 == 0, 5, shard_rows=100, block_queries=16, leaf=8).collect()}
    assert got == brute(rows, 10, 5)


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2**19 + i), float(-(2**19) + 3 * i)], 0) for i in range(40)]
    got = {tuple(r) for r in balltree.top_k(spark.createDataFrame(rows, SCHEMA), lambda i: i % 10 == 0, 3, shard_rows=7, leaf=2).collect()}
    assert got == brute(rows, 10, 3)


def test_wide_components(spark):
    """Components of 1e7 and beyond 2^31 after scaling, beside ordinary ones: nothing is left out."""
    rows = [(0, [2.0e6, 0.0], 0), (1, [2.0e6, 0.0], 0), (10, [1.0e7, 0.0], 0), (11, [-1.0e7, 3.0], 0), (20, [3.0e38, 0.0], 0), (21, [0.0, 0.004], 0), (12, [1.0, 2.0], 0), (30, [0.0, 1.0e7], 0), (31, [0.5, 1.0e7 + 1], 0), (40, [0.0, 0.0], 0)]
    narrow = [r for r in rows if r[0] != 20]
    got = {tuple(r) for r in balltree.top_k(spark.createDataFrame(narrow, SCHEMA), lambda i: i % 10 == 0, 3, shard_rows=3, leaf=2).collect()}
    assert got == brute(narrow, 10, 3) and {(0, 1, 10, 512_000_000 * 2_560_000_000), (0, 2, 1, 512_000_000**2)} <= got
    # A score that fits no long fails the job; nothing wraps round.
    with pytest.raises(Exception, match="(?i)overflow|int too|value|convert"):
        balltree.top_k(spark.createDataFrame(rows, SCHEMA), lambda i: i == 0, 1).collect()


def test_wide_equals_sql(spark, tmp_path):
    import duckdb

    from lamina.llm.queries import OP2

    rows = [(i, [float(i % 7) * 1.0e7 if i % 2 else 0.25 * i, 0.0 if i % 2 else 1.0e7 - i], i) for i in range(120)]
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(str(tmp_path / "e"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/e/*.parquet')")
    got = {tuple(r) for r in balltree.top_k(df, lambda i: i % 50 == 0, 5, shard_rows=40).collect()}
    assert got == set(con.execute(OP2.replace("list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT", "list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1]::HUGEINT * z[2]))::HUGEINT")).fetchall())


def test_share_scored(spark):
    """Groups of near vectors: few are scored; the count is what the search did."""
    rng = np.random.default_rng(8)
    centres = 4 * rng.normal(size=(40, 16))
    rows = [(i, (centres[i % 40] + 0.05 * rng.normal(size=16)).astype(np.float32).tolist(), None) for i in range(4000)]
    scored = spark.sparkContext.accumulator(0)
    got = {tuple(r) for r in balltree.top_k(spark.createDataFrame(rows, SCHEMA), lambda i: i % 50 == 0, 5, scored=scored).collect()}
    assert got == brute(rows, 50, 5) and 0 < scored.value < 0.5 * 2 * 80 * 4000


def test_blocks_pass_over_far_cells(spark):
    """Groups of near vectors: few of all pairs of block and shard meet, with the same results; a cell of very many rows has several shards."""
    rng = np.random.default_rng(9)
    centres = 4 * rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30 if i % 3 else 0] + 0.05 * rng.normal(size=16)).astype(np.float32).tolist(), None) for i in range(3000)]
    rows += [(5000 + i, [1.0, 2.0], None) for i in range(40)]
    met = spark.sparkContext.accumulator(0)
    got = {tuple(r) for r in balltree.top_k(spark.createDataFrame(rows, SCHEMA), lambda i: i % 20 == 0, 5, shard_rows=100, block_queries=8, met=met).collect()}
    assert got == brute(rows, 20, 5)
    shards, blocks = 3040 // 100, 152 // 8
    assert 0 < met.value < 0.4 * shards * blocks


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(c, 1, (200, 16)) * 20 for c in (-9, 0, 9)]).astype(np.int64)
    row = balltree.pack_shard(np.arange(600), points, 16)
    tree = balltree.Tree(row, 16)
    queries = points[::50]
    bounds = tree.bounds(queries)
    for q, bound in zip(queries, bounds):
        for n, (a, b, _, _) in enumerate(tree.links):
            assert tree.scores(a, b, q).max() <= bound[n]
    seen = []
    tree.scores = lambda a, b, q, f=tree.scores: seen.append(b - a) or f(a, b, q)
    tree.search(queries[0], -1, bounds[0], 5, None)
    assert sum(seen) < 400 and tree.scored > sum(seen)


def test_empty(spark):
    assert balltree.top_k(spark.createDataFrame([], SCHEMA), lambda i: i % 10 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0], 1)], SCHEMA)
    assert balltree.top_k(one, lambda i: i % 10 == 0).count() == 0
