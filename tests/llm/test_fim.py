import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lectern.llm import fim


def brute(doc_id, text, unit=None):
    """(n, form, prefix_chars, middle_chars, output), unit by unit."""
    text = text or ""
    ends = [m.end() for m in re.compile(unit or ".", re.S).finditer(text) if m.end() > m.start()]
    n = len(ends)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = ([0, *ends][k] for k in (a, b))
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


TEXTS = [None, "", "a", "é", "😀x", "<P> here", "tail <", "<S", "x<M>y", "ab\ncd\n\n", "é😀" * 900, "word " * 4000 + "end", "\x00\x01", "<" * 50, " lead", "é" * 700]


@pytest.mark.parametrize("unit, block", [(None, 1024), (None, 7), (r"\s*\S+", 16), (r"[^\n]*\n?", 1024)])
def test_equals_brute_force(spark, unit, block):
    rows = [(i, TEXTS[i % len(TEXTS)]) for i in range(160)] + [(None, "no id at all"), (3, "é"), (3, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = fim.fill_in_middle(docs, unit=unit, block=block).select("doc_id", "lectern_fim.*", "text", fim.restored(F.col("text"), F.col("lectern_fim.form")).alias("back"))
    got = sorted((tuple(r) for r in out.collect()), key=str)
    want = sorted(((d, *brute(d, t, unit), t or "") for d, t in rows), key=str)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_cuts_by_blocks_alone():
    text = "".join(chr(97 + i % 26) * (i % 4) + "é😀"[i % 2] for i in range(3000))
    counts = fim.BlockCounts(text.encode(), block=13)
    assert counts.n == counts.n_chars == len(text)
    for k in [0, 1, 2, 13, 14, 777, len(text) - 1, len(text)]:
        assert counts.cut(k) == (len(text[:k].encode()), k)


def test_columns_stay_and_names_may_clash(spark):
    docs = spark.createDataFrame([(1, "some text here", "a", 5, "x")], "doc_id long, text string, n string, form int, lectern_fim string")
    row = fim.fill_in_middle(docs).first()
    assert (row["n"], row["form"]) == ("a", 5) and row["lectern_fim"]["n"] == 14
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_query_equals_its_columns(spark, sf_dir):
    got = {r.doc_id: tuple(r) for r in fim.op11_fill_in_middle(spark, sf_dir).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        *head, output = brute(r.doc_id, r.text)
        assert got[r.doc_id] == (r.doc_id, *head, sha(output), sha(r.text or ""))
