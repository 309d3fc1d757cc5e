import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from lectern.llm import ctw


def brute_model(train, depth):
    """Plain recursive context-tree weighting; returns log10 P(text)."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def walk(text):
        raw = b"\0" * depth + text + b"\0"
        for i in range(depth, len(raw)):
            yield raw[i - depth : i], 0, int(i + 1 == len(raw))
            for j in range(8 if i + 1 < len(raw) else 0):
                yield raw[i - depth : i], (1 << j) | (raw[i] >> (8 - j)), (raw[i] >> (7 - j)) & 1

    for text in train:
        for ctx, node, bit in walk(text):
            for d in range(depth + 1):
                counts[ctx[depth - d :], node][bit] += 1
                if d:
                    children[ctx[depth - d + 1 :], node].add(ctx[depth - d :])
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    held = {}

    def weighted(ctx, node):
        if (ctx, node) not in held:
            own = kt(*counts.get((ctx, node), (0, 0)))
            if len(ctx) < depth:
                below = sum(weighted(c, node) for c in children.get((ctx, node), ()))
                held[ctx, node] = own - math.log(2), float(np.logaddexp(own, below)) - math.log(2)
            else:
                held[ctx, node] = own, own
        return held[ctx, node][1]

    def score(text):
        out = 0.0
        for ctx, node, bit in walk(text):
            p, left = 0.0, 1.0
            for d in range(depth + 1):
                c = ctx[depth - d :]
                weighted(c, node)
                own, total = held[c, node]
                stop = math.exp(own - total)
                a, b = counts.get((c, node), (0, 0))
                p += left * stop * (b + 0.5) / (a + b + 1)
                left *= 1 - stop
            out += math.log10(p if bit else 1 - p)
        return out

    return score


def check(got, rows):
    train = [(t or "").encode() for _, t, h in rows if h is False]
    score = brute_model(train, ctw.DEPTH)
    tokens = Counter(w for t in train for w in re.findall(rb"[^\x20\x09-\x0D]+", t.lower()))
    tokens[None] = len(train)
    n, v = sum(tokens.values()), sum(1 for c in tokens.values() if c)
    want = Counter()
    for doc_id, text, held in rows:
        raw = (text or "").encode()
        own = [*re.findall(rb"[^\x20\x09-\x0D]+", raw.lower()), None]
        base = sum(math.log10((tokens.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        want[doc_id, held is not False, len(own), sum(tokens.get(w, 0) > 0 for w in own), n, round(base, 6), round(score(raw), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == want


@pytest.mark.parametrize("block", [300, 1 << 20])
def test_equals_plain_weighting(spark, block):
    texts = ["the cat sat on the mat", "The CAT  sat", "", None, "été à la plage 😀", "aaaa aaaa aaaa", "zq\nx\x00y", "\x00", "\x00\x00", "".join(map(chr, range(128))) * 2, "the dog sat on the log " * 8, "the cat"]
    rows = [(i, t, i % 3 == 2) for i, t in enumerate(texts)] + [(0, texts[0], False), (None, "null id", None)]
    docs = spark.createDataFrame([r + (1.0,) for r in rows], "doc_id long, text string, held_out boolean, score double")
    check(ctw.score_texts(docs, block).collect(), rows)


def test_nothing_learned_and_empty(spark):
    docs = spark.createDataFrame([(1, "ab", True)], "doc_id long, text string, held_out boolean")
    r = ctw.score_texts(docs).first()
    assert r.score == pytest.approx(-(3 + 2 * 8) * math.log10(2)) and r.n_known == 0 and r.train_tokens == 0
    assert ctw.score_texts(docs.limit(0)).count() == 0


def test_documents_code_well(spark, sf_dir):
    rows = ctw.op5_lm_scoring(spark, sf_dir).collect()
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows)
    bits = -sum(r.score for r in held) / math.log10(2) / sum(len(docs[r.doc_id].encode()) + 1 for r in held)
    assert bits < 3.2, bits


def test_lookup():
    rng = np.random.default_rng(2)
    keys = np.unique(np.concatenate([rng.integers(0, 2**63, 5000).astype(np.uint64), np.arange(50, dtype=np.uint64)]))
    table = ctw.Lookup(keys, np.arange(len(keys)) / 7)
    at = rng.integers(0, len(keys), 20000)
    assert (table(keys[at]) == at / 7).all()
    assert len(ctw.Lookup(keys[:0], np.zeros(0))(keys[:0])) == 0


def test_scores_are_probabilities_and_stretches_agree(spark, monkeypatch):
    """Texts with NULs don't share their code with ends: those of one byte and none sum to at most one."""
    rows = [(-1, "a\x00b", False), (-2, "\x00", False), (-3, "", False)] + [(i, chr(i), True) for i in range(128)] + [(200, "", True), (201, "\x00\x00", True)]
    got = {r.doc_id: r.score for r in ctw.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert sum(10 ** got[i] for i in (*range(128), 200, 201)) < 1 and got[200] > got[201]
    keys, _ = ctw.grams([bytes(range(256)) * 2, b"abc abd", b""])
    keys = keys[(keys >> np.uint64(ctw.SYMBOL_BITS)) & np.uint64(65535) < 300]
    frame = ctw.pd.DataFrame({"key": np.unique(keys).view(np.int64), "n": 1})
    frame["context"] = 0
    whole = ctw._weigh_low(frame)
    monkeypatch.setattr(ctw, "STRETCH", 2)
    parts = ctw._weigh_low(frame)
    assert np.allclose(whole.to_numpy(float), parts.to_numpy(float))
