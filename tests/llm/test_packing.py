import zlib
from collections import defaultdict

import numpy as np
import pytest

from lectern.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")


def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, texts, capacity=2048):
    by_seq, by_doc = defaultdict(list), defaultdict(list)
    for r in rows:
        assert 1 <= r.length <= capacity
        by_seq[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for held in by_seq.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    t = tokenizer()
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [0]
        want = [(k, a, len(ids[a : a + capacity]), zlib.crc32(np.array(ids[a : a + capacity], "<u4").tobytes())) for k, a in enumerate(range(0, len(ids), capacity))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]) == want
    return len(by_seq), sum(r.length for r in rows)


def test_documents_pack_near_the_bound(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    n, total = check(packing.op1_best_fit_packing(spark, sf_dir).collect(), texts)
    assert n <= 1.02 * total / 2048 + 1


def test_odd_texts(spark):
    texts = [None, "", " ", "e ́x don't 's", "İstanbul ΣΑΣ σας", "a b　c\x1cd", "日本語 😀👍🏽", "<|endoftext|> a<|endoftext|>b", "​z ﻿", "word " * 9000]
    docs = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, offset int")
    check(packing.pack_documents(docs).collect(), dict(enumerate(texts)))
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [list(range(1, 101)) * 20, [60] * 500, [51, 49] * 300, [100] * 50, [34, 33, 33] * 100])
def test_merge_rounds(spark, sizes):
    pieces = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "id long, length long").repartition(16)
    rows = packing.pack(pieces, 100, fan_in=4).collect()
    assert sorted(r.id for r in rows) == list(range(len(sizes)))
    seqs = defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for held in seqs.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 100
    best = len(packing.best_fit(np.array(sizes), 100)[2])
    assert len(seqs) <= 1.03 * best + 2
