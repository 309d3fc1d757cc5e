import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lectern.llm import features, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def grams(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=5, min_words=20, n_buckets=10_000):
    s, t = Counter(), Counter()
    for c, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            c.update(h % n_buckets for h in grams(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + n_buckets) / ((s[b] + 1.0) * (big_t + n_buckets)))) for b in range(n_buckets)]
    out = []
    for doc_id, text in docs:
        n, found = grams(text)
        weight = sum(gain[h % n_buckets] for h in found)
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, n, len(found), weight, score, None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0], r[2], r[3]))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=str)


def ran(spark, docs, target, **how):
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string")
    return sorted((tuple(r) for r in resampling.resample(*frames, **how).collect()), key=str)


LINES = ["The quick brown fox", "", "one", "two\r", "a-b c_d 12x", "ÉCOLE école, naïve 东京", "😀 x😀", "x" * 64 + " " + "y" * 65 + " " + "z" * 300, "  ..  ", "repeated line of words"]


def made(n):
    rng = np.random.default_rng(3)
    return [(i, "\n".join(LINES[k] for k in rng.integers(0, len(LINES), rng.integers(0, 30)))) for i in range(n)]


@pytest.mark.parametrize("how", [{}, {"percent": 50, "min_words": 3}, {"hot_share": 3, "percent": 30}, {"n_buckets": 65_536}])
def test_equals_brute_force(spark, how):
    docs = made(150) + [(200, None), (201, ""), (202, "\n\n"), (None, LINES[0] * 9), (5, "again " * 30), (5, "again " * 30), (203, "one\ntwo\nthree\nfour"), (204, "w\n" * 3000)]
    target = ["the quick brown fox jumps", "naïve école", None, ""]
    assert ran(spark, docs, target, **how) == brute(docs, target, **{k: v for k, v in how.items() if k != "hot_share"})


def test_empty_tables(spark):
    assert ran(spark, [], ["a b"]) == []
    docs = made(40)
    assert ran(spark, docs, []) == brute(docs, [])


def test_names_may_clash(spark):
    docs = spark.createDataFrame([(1, "a b c", 9, "x", "y")], "doc_id long, text string, n_words int, lines string, weight string")
    assert resampling.resample(docs, docs).count() == 1


def test_crc_of_runs():
    texts = ["\n".join(LINES), "x" * 200, "", "a b\nc d e"]
    raw = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    words = features.Words(np.frombuffer(b"".join(raw), np.uint8), offsets)
    owner, crc = features.runs(words, words.text)
    for i, text in enumerate(texts):
        assert sorted(crc[owner == i].tolist()) == sorted(grams(text)[1])


def test_query_equals_brute_force(spark, sf_dir):
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*c).collect()]
    want = brute(read("documents", "doc_id", "text"), [t for (t,) in read("benchmark", "text")])
    got = sorted((tuple(r) for r in resampling.op13_importance_resampling(spark, sf_dir).collect()), key=str)
    assert got == sorted(((d, f, w, s, r) for d, _, f, w, s, r in want), key=str)
    assert any(r[4] is not None for r in got)
