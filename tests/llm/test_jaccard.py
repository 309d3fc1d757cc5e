import random
import re

import pytest

from lectern.llm import jaccard
from lectern.llm.graph import components


def brute_sets(texts, n=5):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    return out


def brute(rows, percent=80):
    ids, sets = [r[0] for r in rows], brute_sets([r[1] for r in rows])
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            inter = len(a & b)
            if a and b and 100 * inter >= percent * (len(a) + len(b) - inter):
                x, y = sorted((find(ids[i]), find(ids[j])))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in zip(ids, sets)}


def test_equals_brute_force_on_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.op7_jaccard_join(spark, sf_dir).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("seed, percent, block, known", [(2, 80, 4, 0), (3, 50, 512, 1000)])
def test_chains_groups_and_odd_texts(spark, seed, percent, block, known):
    """Small blocks make lists go by combinations of tokens and by pairs of blocks."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [f"p{i}" for i in range(60)]
    texts = [None, "", " \n", "z y x w v", "z y x w v u", "one", "ONE ", "a b c d", "A  b c\td", "a b c d e", "a b c d e f", "É a b c d e", "é a b c d e"]
    for _ in range(4):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        for _ in range(8):  # a chain: each a few words away from the last
            for _ in range(rng.randrange(3)):
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            texts.append(" ".join(base))
            texts.append(" ".join(base + passage[: rng.randrange(60)]))
    for _ in range(90):  # a large group around one text
        base = list(passage) * 2
        for _ in range(rng.randrange(4)):
            base[rng.randrange(len(base))] = rng.choice(vocabulary)
        texts.append(" ".join(base))
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    members, links = jaccard.near_duplicates(docs, percent=percent, block=block, max_known=known)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in members.collect()}
    assert got == brute(rows, percent)


def test_repeated_null_and_empty(spark):
    t = "a b c d e f g h i j k l m n o p q r s t"
    two = " ".join(f"v{i}" for i in range(40))
    rows = [(None, t, 1), (3, t, 1), (3, t, 1), (5, t, 2), (5, None, 2), (7, two + " end", 1), (8, two, 1), (8, "q " * 30 + two, 1), (9, "q " * 31 + two, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.near_duplicates(docs)[0].collect()), key=str)
    assert got == sorted([(None, 16, None), (3, 16, 3), (3, 16, 3), (5, 16, 3), (5, 0, 5), (7, 37, 7), (8, 36, 7), (8, 41, 7), (9, 41, 7)], key=str)
    assert jaccard.near_duplicates(docs.limit(0))[0].count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 7 * i + 101) for i in range(30)] + [(500, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {7 * i + 101: 100 for i in range(30)} | {100: 100}
