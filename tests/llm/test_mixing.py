import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from lectern.llm import mixing


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full = set()
    while True:
        left = sum(sizes.values()) - sum(cap * sizes[s] for s in full)
        each = {s: left * w[s] / sum(w[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in each if each[s] > cap * sizes[s]}
        if not over:
            return each | {s: cap * sizes[s] for s in full}
        full |= over


def test_targets_and_takings(spark, sf_dir):
    rows = mixing.op6_mixing(spark, sf_dir).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes, taken, goal = Counter(), Counter(), {}
    for r in rows:
        d = docs[r.doc_id]
        assert r.size == len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) and 0 <= r.taken <= 3 * r.size
        sizes[d.source] += r.size
        taken[d.source] += r.taken
        goal[d.source] = (r.target, r.source_size)
    want = brute_targets(sizes)
    for s in sizes:
        assert goal[s][1] == sizes[s] and goal[s][0] == pytest.approx(want[s])
        assert abs(taken[s] - want[s]) <= max(0.01 * want[s], 60)
    again = sorted(map(tuple, mixing.op6_mixing(spark, sf_dir).collect()))
    assert again == sorted(map(tuple, rows))


def test_odd_rows(spark):
    rows = [(1, None, None), (1, "", None), (2, "a b c", None), (2, "a b c", None), (None, "x " * 50000, "é"), (4, "a", "z"), (5, "", "empty")]
    docs = spark.createDataFrame([r + (0,) for r in rows], "doc_id long, text string, source string, size int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    by = defaultdict(set)
    for r in got:
        by[r.source].add((r.source_size, r.target))
    want = brute_targets({None: 6, "é": 50000, "z": 1, "empty": 0})
    for s, vals in by.items():
        assert len(vals) == 1 and next(iter(vals))[1] == pytest.approx(want[s])
    assert mixing.mix(docs.limit(0)).count() == 0


def test_hot_source_is_dealt_exactly(spark):
    docs = spark.range(4000).selectExpr("id doc_id", "repeat('w ', int(1 + id % 7)) text", "if(id % 3 = 0, 'a', concat('b', id % 5)) source")
    got = mixing.mix(docs).collect()
    sums, goal = Counter(), {}
    for r in got:
        sums[r.source] += r.size * r.copies
        goal[r.source] = r.target
    assert all(abs(sums[s] - goal[s]) <= 4 for s in goal)


def test_rates_are_the_tilt(spark):
    """Rates equal min(cap, exp(dual x)) with the dual found by bisection, and copies add up to them."""
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('w ', int(1 + (id * id) % 40)) text", "if(id % 5 = 0, 'a', if(id % 5 < 3, 'b', 'c')) source")
    sizes = defaultdict(Counter)
    for i in range(3000):
        sizes["a" if i % 5 == 0 else "b" if i % 5 < 3 else "c"][1 + (i * i) % 40] += 1
    words = {s: sum(k * n for k, n in c.items()) for s, c in sizes.items()}
    want = brute_targets(words)
    solved = {}
    for s, c in sizes.items():
        mean = words[s] / sum(c.values())
        got = lambda d: sum(k * n * min(3, math.exp(min(50, d * k / mean))) for k, n in c.items())  # noqa: E731, B023
        low, high = -64.0, 64.0
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if got(mid) < want[s] else (low, mid)
        solved[s] = low, mean
    counts = spark.createDataFrame([(s, k / solved[s][1], float(k * n)) for s, c in sizes.items() for k, n in c.items()], "source_key string, x double, mass double")
    goals = spark.createDataFrame(list(want.items()), "source_key string, target double")
    capped = {s for s in want if want[s] >= 3 * words[s] - 1e-6}
    for r in mixing.duals(counts, goals).collect():
        if r.source_key not in capped:
            assert r.dual == pytest.approx(solved[r.source_key][0], abs=1e-6)
    taken = defaultdict(Counter)
    for r in mixing.mix(docs).collect():
        taken[r.source][r.size] += r.copies
    for s, c in sizes.items():
        for k, n in c.items():
            rate = min(3, math.exp(min(50, solved[s][0] * k / solved[s][1])))
            assert abs(taken[s][k] - n * rate) <= 0.5 + 40 / k, (s, k)


def test_stage_keeps_columns_with_clashing_names(spark):
    names = ["row_hash", "copies", "copy", "took", "rows", "took_id", "took_hash", "row", "row_id", "n_rows", "a.b"]
    docs = spark.range(30).selectExpr("id doc_id", "repeat('w ', int(1 + id % 3)) text", "concat('s', id % 2) source").select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    out = mixing.mix_stage(spark, docs.union(docs.limit(3)), "")
    assert out.columns == docs.columns
    assert {tuple(r)[3:] for r in out.collect()} == {tuple(range(len(names)))}
