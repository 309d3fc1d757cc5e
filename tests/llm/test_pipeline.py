from collections import Counter

import corpus_pipeline
from lectern.llm import mixing
from tests.llm.test_jaccard import brute as near_brute
from tests.llm.test_lines import brute as line_brute


def test_stages_keep_columns_and_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, n = docs.columns, docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.collect()
        docs = corpus_pipeline.stored(stage(spark, docs, sf_dir))
        assert docs.columns == columns
        kept[name] = rows = docs.collect()
        if name == "quality rules":
            assert {r.doc_id for r in rows} <= {r.doc_id for r in before} and 0.5 * n < len(rows) < n
        elif name == "line dedup":
            assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in before)
            want = {d: lines - gone for d, lines, gone, _ in line_brute([(r.doc_id, r.text) for r in before])}
            assert all(len(r.text.split("\n")) == max(1, want[r.doc_id]) for r in rows)
        elif name == "near duplicates":
            roots = near_brute([(r.doc_id, r.text) for r in before])
            assert sorted(r.doc_id for r in rows) == sorted(d for d, (_, root) in roots.items() if root == d)
        else:
            copies = Counter(r.doc_id for r in rows)
            assert max(copies.values()) <= 3 and set(copies) <= {r.doc_id for r in before}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(r.doc_id for r in kept["mix to targets"])


def test_mix_stage_shares_among_equal_rows(spark):
    rows = [(1, "a b c", "s")] * 5 + [(2, "a b c d", "t"), (None, None, "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix_stage(spark, docs, "")
    took = Counter(r.doc_id for r in out.collect())
    assert 1 <= took[1] <= 15 and took[2] <= 3
