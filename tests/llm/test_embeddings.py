import numpy as np
import pytest

from lectern.llm import embeddings


def brute(rows, threshold=0.93):
    good = {}
    for i, v, label in rows:
        if v is None or label is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        good[i] = (label, np.array(v, np.float64))
    ids = sorted(good)
    near = {i: set() for i in ids}
    for a in ids:
        for b in ids:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]):
                x, y = good[a][1], good[b][1]
                if x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                    near[a].add(b)
                    near[b].add(a)
    root = {}
    for i in ids:
        if i not in root:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in root:
                    root[k] = i
                    todo += near[k]
    return {r[0]: (len(near.get(r[0], ())), root.get(r[0], r[0])) for r in rows}


def result(df):
    return {r.vec_id: (r.n_links, r.component_id) for r in df.collect()}


def test_table_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert result(embeddings.op3_embedding_dedup(spark, sf_dir)) == brute(rows)


@pytest.mark.parametrize("block", [16, 1024])
def test_groups_blocks_and_bad_vectors(spark, block):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):
        base = rng.standard_normal(16)
        for scale in rng.uniform(0, 0.6, 40):
            rows.append((base + scale * rng.standard_normal(16), c % 2))
        rows += [(base * 2, c % 2)] * 30
    rows = [(10 + i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    n = len(rows)
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * 16, 1), (903, [1.0, None] * 8, 1), (904, [float("nan")] * 16, 1)]
    rows += [(905, [float("inf")] * 16, 1), (906, rows[0][1], None), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1)]
    df = spark.createDataFrame([r + (1,) for r in rows], "vec_id long, embedding array<float>, label int, n_links int")
    got = result(embeddings.near_vectors(df, per_bucket=20, block=block))
    assert got == brute(rows) and len(got) == n + 9
    assert embeddings.near_vectors(df.limit(0)).count() == 0


def test_rows_that_repeat_an_id_link_as_vectors_of_their_own(spark):
    near, far = [1.0, 0.0, 0.0, 0.1], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, near, 0), (1, far, 0), (2, [1.0, 0.0, 0.0, 0.0], 0), (3, [0.0, 1.0, 0.1, 0.0], 0)]
    got = sorted(tuple(r)[:3] for r in embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_miss_bound():
    for bits in (4, 8, 12):
        p = (1 - np.arccos(0.93) / np.pi) ** bits
        assert (1 - p) ** embeddings.n_tables(bits) <= embeddings.MISS


def test_pool_meets_pairs_at_the_threshold():
    """Pairs at the threshold, by their sketches: with fewer tables the share met is as the bound says."""
    rng = np.random.default_rng(3)
    dim, n, bits, tables = 24, 4000, 8, 6
    a = rng.standard_normal((n, dim))
    b = rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.93 * a + np.sqrt(1 - 0.93**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    one, two = ((v @ embeddings._planes(dim) > 0).astype(np.int32) for v in (a, b))
    met = (embeddings._codes(one, bits, tables) == embeddings._codes(two, bits, tables)).any(axis=1)
    flips = np.arange(embeddings.POOL + 1)
    meet = np.prod([(embeddings.POOL - flips - k) / (embeddings.POOL - k) for k in range(bits)], axis=0).clip(0, 1)
    told = embeddings._spread(0.93) @ (1 - (1 - meet) ** tables)
    assert abs(met.mean() - told) < 0.06 and (one != two).sum(axis=1).max() <= embeddings.most_flips()
    assert abs(embeddings._spread(0.93).sum() - 1) < 1e-9
