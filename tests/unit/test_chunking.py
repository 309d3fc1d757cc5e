import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.operators.chunking import Chunking, _strips, chunks, spans

TEXT = st.text(alphabet=st.sampled_from(list("ab. 。\n😀\t")), max_size=120)


def spec(t, size, overlap):
    if len(t) <= size:
        return [t]
    out, start = [], 0
    while start < len(t):
        end = start + size
        part = t[start:end]
        if end < len(t):
            best = max(part.rfind(m) for m in ("。", ". ", "\n"))
            if best > size // 2:
                part, end = part[: best + 1], start + best + 1
        if part.strip():
            out.append(part.strip())
        start = end - overlap
    return out


@settings(max_examples=5, deadline=None)
@given(st.lists(TEXT, min_size=40, max_size=60), st.sampled_from([(20, 5), (9, 3), (40, 0)]))
def test_equals_the_rule(spark, texts, how):
    texts = [*texts, "", "  a ", "x" * 100]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)
    got: dict = {i: [] for i in range(len(texts))}
    for r in chunks(docs, Chunking(*how)).orderBy("doc_id", "chunk_idx").collect():
        got[r.doc_id].append(r.text)
    assert got == {i: spec(t, *how) for i, t in enumerate(texts)}


def test_tail_windows_and_limits(spark):
    rows = spark.createDataFrame([("x" * 7800,), ("x" * 4100,), ("x" * 2001 + "\n" + "x" * 3000,), ("x" * 2000 + "\n" + "x" * 3000,)], "t string")
    got = [[(s.start, s.len) for s in r.s] for r in rows.withColumns({"n": F.length("t"), "k": _strips(F.col("t"), Chunking())}).select(spans(F.col("n"), F.col("k")).alias("s")).collect()]
    assert [s for s, _ in got[0]] == [0, 3800, 7600] and [s for s, _ in got[1]] == [0, 3800]
    assert got[2][0] == (0, 2002) and got[3][0] == (0, 4000)
    with pytest.raises(ValueError):
        Chunking(100, 52)


def test_long_text(spark):
    text = "".join(f"Sentence {i} of a very long text 数. " for i in range(100_000))
    got = [r.text for r in chunks(spark.createDataFrame([(1, text)], "doc_id int, text string")).orderBy("chunk_idx").collect()]
    assert got == spec(text, 4000, 200)
