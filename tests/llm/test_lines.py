import hashlib
import re
from collections import defaultdict

from lectern.llm import lines


def brute(rows):
    holders = defaultdict(set)
    keyed = []
    for doc_id, text in rows:
        own = []
        for line in (text or "").split("\n"):
            key = re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line)
            key = re.sub("[A-Z]", lambda m: m[0].lower(), key)
            own.append((line, key))
            if len(key) >= 20:
                holders[key].add(doc_id)
        keyed.append((doc_id, own))
    out = []
    for doc_id, own in keyed:
        kept = [x for x, k in own if len(holders.get(k, ())) < 3 or doc_id == max(holders[k], key=lambda d: -1 if d is None else d)]
        out.append((doc_id, len(own), len(own) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def digest(out):
    return sorted(((r.doc_id, r.lectern_lines.n_lines, r.lectern_lines.n_dropped, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in out), key=str)


def test_documents(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = sorted(map(tuple, lines.op4_line_dedup(spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()), key=str)
    assert got == brute(rows)


def test_odd_rows_and_columns(spark):
    long = "A line that is Long enough É"
    rows = [(None, long), (1, None), (1, f"{long}\nx\n\t{long} "), (2, f"{long.replace('L', 'l')}\r\nshort"), (2, f"{long}\n{long}"), (3, "é" * 19 + "\n" + "é" * 20)]
    rows += [(4, "é" * 19 + "\n" + "é" * 20), (5, "é" * 19 + "\n" + "é" * 20 + "\n"), (6, ""), (7, long), (7, long), (8, "y\n" * 5000 + long)]
    docs = spark.createDataFrame([r + (i, "k") for i, r in enumerate(rows)], "doc_id long, text string, place int, h1 string")
    out = lines.dedup_lines(docs).collect()
    assert digest(out) == brute(rows)
    assert sorted((r.place, r.h1) for r in out) == [(i, "k") for i in range(len(rows))]
    assert lines.dedup_lines(docs.limit(0)).count() == 0


def test_scratch_drops_what_is_not_kept(spark):
    import os

    from lectern.llm.common import scratch, stored

    with scratch() as outer:
        with scratch() as inner:
            kept, gone = stored(spark.range(3)), stored(spark.range(4))
            inner.append(kept)
        assert os.path.isdir(kept._lectern_path.removeprefix("file:")) and not os.path.isdir(gone._lectern_path.removeprefix("file:"))
        assert outer == []
    assert not os.path.isdir(kept._lectern_path.removeprefix("file:"))
