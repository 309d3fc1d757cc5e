"""Registered queries against plain rules over every row and whole texts."""

import hashlib
import os.path
import re
import unicodedata

from lectern.plans import flow_queries, text_queries

LONG = "A first line of words, long enough. " * 20
TEXTS = {
    0: "x" * 130 + "/é b\\c\r\nÄ.tail", 1: LONG + "one", 2: LONG + "two", 3: "", 4: "12 34", 5: "...", 6: "a/b.c\nd/e.f. ", 7: "\\(y\\) " + "z" * 30 + " \\[q\\] \r\nend",
    8: "word " * 20 + "\n  pie of the day\nrest\n```mermaid\nx\n```", 9: "数" * 40 + "名.b", 10: "w" * 59 + " one", 11: "w" * 59 + " two", 12: "k" * 31 + "_-_",
    13: ".PDF", 14: "a.b/c", 15: "..", 16: "/", 17: "a.b\n/.c", 18: "x.TXT\n", 20: "plain " * 9 + "\n\x1cgraph LR\nend", 24: "# t\n\n" + "many words here. " * 30,
    28: "word " * 20 + "and more",
}


def folder(spark, path, texts=TEXTS):
    docs = [(i, t, "en", "web", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "b" * 70 + " item"), (2, "b" * 70 + " other")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_completion_order_numbers_all_events(spark, tmp_path):
    events = [(k, 1000 - k // 2, 1 + (k % 10 == 0), f"t{k}", None if k == 3 else f'{{"k": {k}}}') for k in range(60)]
    spark.createDataFrame(events, "event_id long, ts long, user_id long, event_type string, props string").selectExpr("event_id", "timestamp_seconds(ts) ts", "user_id", "event_type", "props").write.parquet(f"{tmp_path}/events.parquet")
    want = set()
    for user in (1, 2):
        for n, e in enumerate(sorted((e for e in events if e[2] == user), key=lambda e: (e[1], e[0])), 1):
            want.add((user, n, f"event: {e[3]}\ndata: {e[4] or '{}'}\n\n"))
    got = flow_queries.completion_order(spark, str(tmp_path)).collect()
    assert len(got) == 60 and set(map(tuple, got)) == want


def test_upload_names_has_every_document(spark, tmp_path):
    d = folder(spark, tmp_path, TEXTS | {30: None, 33: None})
    rows = text_queries.upload_names(spark, d).collect()
    got = {r.doc_id: (r.allowed, r.ext) for r in rows}
    ends = [".PDF", ".txt", ".exe", "", ".tar.docx"]
    ext = {i: os.path.splitext(t + ends[i % 5])[1].lower() for i, t in TEXTS.items()} | {30: "", 33: ""}
    assert got == {i: (e in (".txt", ".pdf", ".docx", ".pptx"), e) for i, e in ext.items()}
    for r in rows:
        safe = secure((TEXTS.get(r.doc_id) or "") + ends[r.doc_id % 5])
        assert r.name == (None if not r.allowed else safe if safe and safe.lower().endswith(r.ext) else "made up")


def compact(t, n=300):
    t = re.sub(r"\s+", " ", t).strip()
    return t if len(t) <= n else t[:n].rstrip() + "..."


def stem(t):
    t = re.sub(r"\.[^.]+\Z", "", t + ".v1.pdf")
    return re.sub(r"^_+|_+\Z", "", re.sub("[^A-Za-z0-9_一-龥-]+", "_", t)) or "session"


def math(t):
    t = re.sub("\r\n", "\n", f"\\[{t}\\]\r\n\\(x_1\\) and $y$")
    t = re.sub(r"\\\[([\s\S]*?)\\\]", lambda m: f"$${m[1]}$$", t)
    return re.sub(r"\\\(([\s\S]*?)\\\)", lambda m: f"${m[1]}$", t)


def secure(t):
    t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    t = "_".join(t.replace("/", " ").replace("\\", " ").split())
    return re.sub("_+", "_", re.sub("[^A-Za-z0-9_.-]", "", t)).strip("._")


STARTS = ("graph ", "mindmap", "flowchart ", "pie", "sequenceDiagram", "stateDiagram", "classDiagram")


def diagram(reply):
    lines = reply.strip().split("\n")
    at = next(i for i, x in enumerate(lines) if x.strip().startswith(STARTS))
    out = "\n".join(lines[at:]).strip()
    return out, re.sub(r"```mermaid\n?|```\n?", "", reply, flags=re.I).strip()


def test_text_rules_over_whole_texts(spark, tmp_path):
    d = folder(spark, tmp_path)
    rows = lambda q: {r[0]: tuple(r)[1:] for r in q(spark, d).collect()}
    assert rows(text_queries.math_text) == {i: (math(t),) for i, t in TEXTS.items()}
    assert rows(text_queries.file_stem) == {i: (stem(t),) for i, t in TEXTS.items()}
    assert rows(text_queries.secure_filename) == {i: (secure(t),) for i, t in TEXTS.items()}
    got = rows(text_queries.mermaid_salvage)
    assert {i: got[i] for i in TEXTS if i % 4 == 0} == {i: diagram(t + "\n  graph LR\n  A[x] --> B\n") for i, t in TEXTS.items() if i % 4 == 0}


def test_records_and_reports_over_whole_texts(spark, tmp_path):
    d = folder(spark, tmp_path)
    hashed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rule = "\n\n---\n\n"
    records = sorted([(0, 1, "b" * 70 + " item"), (0, 2, "b" * 70 + " other"), *((1, i, compact(t)) for i, t in TEXTS.items())])
    first = {}
    for r in records:
        first.setdefault(r[2].lower(), r)
    assert {tuple(r) for r in flow_queries.dedup_titles(spark, d).collect()} == {r for k, r in first.items() if k}
    found = {(r.src_ord, r.pos): r.title for r in flow_queries.search_union_limit(spark, d).collect()}
    # Query 1 has room for its benchmark item only; 8 and 28 share a query.
    assert found == {r[:2]: r[2] for r in records if r[2] and r[:2] != (1, 1)}
    cards = sorted(r.title for r in flow_queries.paper_cards(spark, d).collect())
    assert cards == sorted(compact(t) or "Untitled" for t in TEXTS.values())
    reports = {r.doc_id: r.sha256 for r in flow_queries.report_markdown(spark, d).collect()}
    assert reports == {i: hashed(f"# Analysis report\n\n> Generated: 2024-05-06 07:08:09\n> Source: web\n> Elapsed: 1.5s{rule}## Summary\n\n{t}{rule}## Quotes\n\nen{rule}## Structure\n\nm{rule}## Evaluation\n\ne\n\n---\n## About\n\n- Version: 1\n- Characters: {len(t)}\n") for i, t in TEXTS.items()}
    sessions = {r.session_id: r.sha256 for r in flow_queries.session_markdown(spark, d).collect()}
    want = {}
    for i, t in TEXTS.items():
        parts = [
            f"# Session report\n\n## Session\n\n| Item | Value |\n| --- | --- |\n| Source file | web |\n| Session ID | {i} |\n| Character count | {len(t)} |",
            "## Overview\n\n" + (t or "_No summary generated._"), "## Citations\n\n_No citations generated._", "## Structure\n\n" + ("_No structure generated._" if i % 2 else "tree"),
        ]
        want[i] = hashed(rule.join(parts + ["## Diagram\n\n```mermaid\ngraph TD\n```"] * (i % 3 == 0)))
    assert sessions == want
