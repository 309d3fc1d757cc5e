import hashlib
import random
import re
from collections import Counter
from math import comb

import pytest
from pyspark.sql import functions as F

from lectern.llm import quality

WS = r"[^\x20\x09-\x0D]+"


def brute(text):
    text = text or ""
    w = re.findall(WS, text)
    wins = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(WS, x)]
    rep = len(covered)
    return (
        len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep,
        len(w) < 50 or 100 * rep > 50 * len(w),
    )


def test_counts_equal_brute_force(spark, sf_dir):
    out = quality.op8_quality_rules(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(out) == len(texts)
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), r.doc_id
        assert not (r.base_failed and r.kept)


def test_odd_texts_and_clashing_columns(spark):
    rng = random.Random(3)
    texts = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x x x x", "é b\x0bc\n\nd\n d\nd\n \n "]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(40))) for _ in range(40)] + ["w " * 30000]
    rows = [(i if i else None, t, None, i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows + rows[-2:], "doc_id long, text string, lang string, n_words int")
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    got = quality.judged(docs, labels).select("text", "n_words", "lectern_quality").collect()
    assert len(got) == len(rows) + 2
    for r in got:
        q = r.lectern_quality
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute(r.text)
        assert texts[r.n_words] == r.text
    assert quality.judged(docs.limit(0), labels.limit(0)).count() == 0


@pytest.mark.parametrize("n,k", [(20, 0), (300, 1), (1000, 3), (5000, 20), (40, 39)])
def test_binomial_tail_is_exact(spark, n, k):
    p = 0.01
    want = sum(comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if k < n * p else 1.0
    got = spark.range(1).select(quality.binomial_tail(F.lit(k), F.lit(n), p)).first()[0]
    assert got == pytest.approx(want, rel=1e-9)


def frame(spark, rows):
    """rows: (stratum, tuning, quality, measures by rule)."""
    return spark.createDataFrame([(s, t, q, *[m.get(r, 0.0) for r in quality.RULES]) for s, t, q, m in rows], "stratum string, tuning boolean, quality int, " + ", ".join(f"{r} double" for r in quality.RULES))


def test_few_labels_decide_nothing_enough_do(spark):
    rows = []
    for s, n in (("s", 90), ("few", 60)):
        for tuning in (True, False):
            rows += [(s, tuning, 1, {})] * n + [(s, tuning, 0, {"symbol_rate": 0.9})] * 9
    got = quality.select_cutoffs(frame(spark, rows)).collect()
    assert [(r.stratum, r.rule, r.cutoff) for r in got] == [("s", "symbol_rate", max(c for c in quality.GRID if c < 0.9))]


def brute_cutoffs(rows, risk=0.05, level=0.05):
    """(stratum, rule): cutoff of rows as for ``frame``."""
    out, strata = {}, {r[0] for r in rows if not r[1] and r[2] == 1}
    for s in strata:
        path = []
        for i, rule in enumerate(quality.RULES):
            gains = [(sum((-quality.GOOD_WEIGHT if q == 1 else 1) * (m[rule] > c) for x, t, q, m in rows if x == s and t), c) for c in quality.GRID]
            if max(gains)[0] > 0:
                path.append((-max(gains)[0], i, rule, max(gains)[1]))
        path.sort()
        good = [m for x, t, q, m in rows if x == s and not t and q == 1]
        for j in range(1, len(path) + 1):
            n, k = len(good), sum(any(m[rule] > c for *_, rule, c in path[:j]) for m in good)
            tail = sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) if k < n * risk else 1.0
            if tail * len(strata) > level:
                break
            out[s, path[j - 1][2]] = path[j - 1][3]
    return out


def test_cutoffs_equal_brute_force(spark):
    rng = random.Random(8)
    rows = []
    for s, n in (("sa", 1800), ("sb", 900), ("n", 1200), ("s", 60)):
        for _ in range(n):
            good = rng.random() < 0.8
            rows.append((s, rng.random() < 0.3, int(good), {r: rng.random() ** (9 if good else 2) * (0.4 if good else 1) for r in quality.RULES}))
    got = {(r.stratum, r.rule): r.cutoff for r in quality.select_cutoffs(frame(spark, rows)).collect()}
    assert got == brute_cutoffs(rows) and len(got) > 4


def test_the_risk_holds_in_simulation(spark):
    """Rules that really reject more good documents than allowed pass in few of many strata."""
    rng = random.Random(5)
    rows = []
    for k in range(200):
        for i in range(160):
            good = i % 4 > 0
            # Six in a hundred good documents exceed any cutoff, and nearly all bad ones.
            high = rng.random() < (0.06 if good else 0.95)
            rows.append((f"s{k}", i % 3 == 0, int(good), {"symbol_rate": 0.95 if high else 0.0}))
    strata = 1  # each stratum is a trial of its own: at the level of one
    got = quality.select_cutoffs(frame(spark, rows), level=0.05 * 200 * strata).select("stratum").distinct().count()
    assert got <= 14  # 200 trials at 0.05 or less: 15 or more has a chance below 0.06


def test_verdicts_equal_brute_force(spark):
    """Texts whose languages, null and empty among them, need different cutoffs."""
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(3000):
        lang = (None, "", "x")[i % 3]
        good = i % 4 > 0
        words = [f"w{rng.randrange(10**6)}" for _ in range(55)]
        if not good and lang != "x":
            words = [w + "#" * (8 if lang is None else 2) for w in words]
        rows.append((i, " ".join(words), lang))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = quality.judged(docs, spark.createDataFrame(labels, "doc_id long, quality int")).select("doc_id", "lang", "lectern_kept", "lectern_quality").collect()
    key = lambda lang: "n" if lang is None else "s" + lang
    tuning = lambda d: hashlib.sha256(f"split:{d}".encode()).hexdigest()[0] < quality.TUNING
    cutoffs = brute_cutoffs([(key(r.lang), tuning(r.doc_id), labels[r.doc_id][1], {k: r.lectern_quality[k] for k in quality.RULES}) for r in got])
    assert {s for s, _ in cutoffs} == {"n", "s"}
    for r in got:
        over = any(r.lectern_quality[k] > cutoffs.get((key(r.lang), k), 9) for k in quality.RULES)
        assert r.lectern_kept == (not over and not r.lectern_quality.base_failed)
