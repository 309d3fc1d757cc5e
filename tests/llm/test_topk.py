import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import topk


def brute(rows, k=5, every=50):
    whole = set()
    for vec_id, v in rows:
        if vec_id is not None and v and all(x is not None and math.isfinite(x) for x in v):
            whole.add((vec_id, tuple(math.floor(256 * x) for x in v)))
    out = []
    for q in whole:
        if q[0] % every == 0:
            scores = [(-sum(a * b for a, b in zip(q[1], c[1])), c[0]) for c in whole if c != q and len(c[1]) == len(q[1])]
            out += [(q[0], i, v, -s) for i, (s, v) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def ran(spark, rows, **how):
    return sorted(tuple(r) for r in topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), **how).collect())


def clustered(n, dim=8, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    v = centres[rng.integers(0, 6, n)] + 0.05 * rng.standard_normal((n, dim))
    return [(i, [float(x) for x in np.float32(row)]) for i, row in enumerate(v)]


@pytest.mark.parametrize("how", [{}, {"per_pivot": 20, "max_pivots": 16}, {"per_pivot": 20, "max_pivots": 7, "block": 30, "chunk": 3}])
def test_equals_brute_force(spark, how):
    rows = clustered(700)
    rows += [(2000 + i, rows[0][1]) for i in range(120)]  # one vector very often, among queries too
    rows += [(50, rows[50][1]), (150, rows[3][1])]  # a repeated row, a second vector of a query's id
    rows += [(None, rows[1][1]), (900, None), (950, []), (1000, [1.0, None]), (1050, [float("nan")] * 8), (1100, [float("inf")] * 8)]
    rows += [(1150, [0.0] * 8), (1200, [1.0, 2.0]), (1201, [-1.0, 2.0]), (1250, [3.0])]  # zeros; other lengths
    assert ran(spark, rows, **how) == brute(rows)


def test_ties_and_small_tables(spark):
    ties = [(i, [1.0, 0.0]) for i in range(1, 40)] + [(50, [2.0, 0.0]), (100, [0.0, 0.0])]
    assert ran(spark, ties, per_pivot=5, block=4) == brute(ties)
    assert ran(spark, [(0, [1.0])]) == []
    assert ran(spark, []) == []
    big = [(i, [1e6 * (i % 4), -3e5 * (i % 5)]) for i in range(101)] + [(200, [1e30, 0.0])]
    assert ran(spark, big) == brute(big[:-1])


def test_names_may_clash_and_queries_are_free(spark):
    rows = clustered(120)
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", *[F.lit("x").alias(c) for c in ("q", "h1", "region", "kind", "ids")])
    out = topk.top_products(frame, queries=F.col("vec_id") % 7 == 0, k=3)
    assert sorted(tuple(r) for r in out.collect()) == brute(rows, 3, 7)


def test_bounds_spare_distances():
    points = np.floor(256 * np.array([v for _, v in clustered(4000)])).astype(np.int64)
    m2 = float(np.einsum("ij,ij->i", points, points).max())
    tree = topk.MTree(points, m2, leaf=32)
    ids = [[i] for i in range(len(points))]
    for i in range(0, 4000, 400):
        scores = points @ points[i]
        want = sorted((-int(s), j) for j, s in enumerate(scores))[:5]
        assert [(-s, j) for s, j, _ in tree.search(points[i], ids, 5)] == want
    assert tree.computed < 0.5 * 10 * 4000


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(tuple(r) for r in topk.op12_topk_search(spark, sf_dir).collect()) == brute(rows)
