import io
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from lectern.operators import papers, sections, sessions
from lectern.operators.history import history_blocks
from lectern.operators.providers import OfflineProvider, answered, cached
from lectern.plans import pipelines
from lectern.sources import files, papers_api
from lectern.streaming import events


def zipped(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = zipped({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t> One </w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>"})
NS = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
REL = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'


def slide(*texts, kind=""):
    return f"<p:sld {NS}>" + "".join(f"<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>" for t in texts) + "</p:sld>"


PPTX = zipped({
    "ppt/presentation.xml": f'<p:presentation {NS}><p:sldIdLst><p:sldId r:id="r1"/><p:sldId r:id="r2"/><p:sldId r:id="r3"/></p:sldIdLst></p:presentation>',
    "ppt/_rels/presentation.xml.rels": f'<Relationships {REL}>' + "".join(f'<Relationship Id="r{k}" Target="slides/slide{k}.xml"/>' for k in (1, 2, 3)) + "</Relationships>",
    "ppt/slides/slide1.xml": slide("Title", "Body"), "ppt/slides/slide2.xml": slide(), "ppt/slides/slide3.xml": slide("Third"),
    "ppt/slides/_rels/slide3.xml.rels": f'<Relationships {REL}><Relationship Id="n" Target="../notesSlides/notesSlide1.xml"/></Relationships>',
    "ppt/notesSlides/notesSlide1.xml": slide("say it", kind='<p:ph type="body"/>'),
})


def test_files(spark, tmp_path):
    for name, raw in {"a.txt": b"x\xff\r\ny\r\n\r\n\r\n\r\nz", "b.docx": DOCX, "c.pptx": PPTX, "d.exe": b"q", "e.txt": b"", "f.docx": b"broken"}.items():
        (tmp_path / name).write_bytes(raw)
    good, bad = files.read_documents(spark, str(tmp_path))
    assert {r.source_filename: r.text for r in good.collect()} == {
        "a.txt": "x\ny\n\nz", "b.docx": "One\n\nTwo\n\n[Table 1]\na | b", "c.pptx": "[Slide 1]\nTitle\nBody\n\n[Slide 3]\nThird\n[Notes] say it"}
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in bad.collect()}
    assert set(errors) == {"d.exe", "f.docx"} and errors["f.docx"].startswith("could not read .docx")


ATOM = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><entry><id>http://x/1</id><title>A
  b</title><summary>s</summary><published>2017-06-12T00:00:00Z</published><author><name>N One</name></author><author><name> </name></author>
<link href="http://x/abs"/><link title="pdf" href="http://x/1.pdf"/></entry><entry><id>http://x/2</id><title>c</title></entry></feed>"""
JSON = '{"data":[{"paperId":"p1","title":"a B","year":2020,"authors":[{"name":"M"}],"openAccessPdf":{"url":"http://y/p.pdf"}},{"paperId":"p2","title":"","authors":null}]}'


def test_search_over_two_sources(spark):
    replies = lambda body: spark.createDataFrame([(1, body)], "query_id long, body string")
    records = papers_api.scholar_records(replies(JSON)).unionByName(papers_api.atom_records(replies(ATOM)))
    got = papers.federated(records, spark.createDataFrame([(1, "5")], "query_id long, limit string")).orderBy("rank").collect()
    assert [(r.rank, r.source, r.title, r.year, r.pdf_url) for r in got] == [(1, "Semantic Scholar", "a B", "2020", "http://y/p.pdf"), (2, "arXiv", "c", "", "")]
    atom = papers_api.atom_records(replies(ATOM)).where("pos = 0").first()
    assert (atom.title, atom.authors, atom.year, atom.venue, atom.pdf_url) == ("A b", ["N One"], "2017", "arXiv", "http://x/1.pdf")


def test_imports_try_addresses_in_order(spark):
    rows = spark.createDataFrame([("p", "http://10.0.0.1/x.pdf", "http://x.org/y.pdf"), ("q", None, "http://x.org/page")], "paper_id string, pdf_url string, url string")
    got = {(r.paper_id, r.ord): r.refused for r in papers_api.import_candidates(rows).collect()}
    assert got == {("p", 0): "address not public", ("p", 1): None, ("q", 0): "not a direct file"}
    tries = spark.createDataFrame([("p", 0, "a", "bad"), ("p", 1, "b", None), ("q", 0, "c", "worse")], "paper_id string, ord int, link string, error string")
    assert {r.paper_id: (r.link, r.error) for r in papers_api.first_usable(tries).collect()} == {"p": ("b", None), "q": (None, "worse")}


def test_history_skips_blank_turns_and_stops(spark):
    turns = spark.createDataFrame([(1, 1, "q" * 500, "a"), (1, 2, " ", None), (1, 3, "x", "y")], "session_id int, turn int, question string, answer string")
    r = history_blocks(turns, 100).first()
    assert (r.history, r.n_turns) == ("Q: x\nA: y", 1)
    r = history_blocks(turns, 1000).first()
    assert r.n_turns == 2 and r.history.startswith("Q: " + "q" * 400 + "\n...[truncated]\nA: a\n\n---\n\nQ: x")


def failing(task, prompt):
    if task == "summary" and "bad" in prompt:
        raise ValueError("HTTP 503")
    return OfflineProvider()(task, prompt)


class Metered:
    """A metered provider spreads its prompts over its open calls."""

    metered = True

    def __call__(self, task, prompt):
        return failing(task, prompt)

    def deltas(self, prompt):
        if "bad" in prompt:
            yield "half"
            raise ValueError("HTTP 503")
        yield from ("an", "swer")


def test_analysis_and_failures(spark):
    docs = spark.createDataFrame([(1, "One two. Three four.\n" * 300), (2, "bad " * 1200), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in pipelines.analyse(docs, failing, mermaid=True).collect()}
    assert out[1].sections["summary"].status == "success" and out[1].mermaid.startswith("graph TD")
    assert (out[2].sections["summary"].status, out[2].sections["summary"].retryable) == ("failed", True) and out[2].error is None
    assert out[3].sections["quotes"].status == "empty" and out[3].sections["evaluation"].status == "disabled"
    assert pipelines.reports(pipelines.analyse(docs, failing).withColumn("source_filename", F.lit("f")), F.lit("2024-01-01").cast("timestamp_ntz")).count() == 3
    replies = spark.createDataFrame([], "key string, reply string")
    prompts = spark.createDataFrame([(1, "quotes", "A b."), (2, "quotes", "A b.")], "doc_id long, task string, prompt string")
    assert [r.reply for r in cached(prompts, replies, OfflineProvider()).collect()] == ['1. "A b."'] * 2


def test_ask(spark):
    known = spark.createDataFrame([("s1", "doc text", "t1"), ("s2", "", "t2")], "session_id string, document string, token string").withColumn("token_hash", sessions.token_hash(F.col("token")))
    asked = [(1, "s1", "t1", "What?"), (2, "s1", "no", "What?"), (3, "s9", "t", "x"), (4, "", "t", "x"), (5, "s2", "t2", "x"), (6, "s1", "t1", None)]
    requests = spark.createDataFrame(asked, "request_id long, session_id string, token string, question string")
    turns = spark.createDataFrame([], "session_id string, turn long, question string, answer string")
    out = {r.request_id: (r.answer is not None, r.error) for r in pipelines.ask(requests, known, turns, OfflineProvider()).collect()}
    assert out == {1: (True, None), 2: (False, "session token invalid"), 3: (False, "session not found"), 4: (False, "session id required"), 5: (False, "no document"), 6: (False, "no question")}


def test_rewrite(spark):
    queries = spark.createDataFrame([(1, " yolo ", "ctx"), (2, "  ", None)], "query_id long, query string, context string")
    p = {r.query_id: r for r in pipelines.rewrite_prompts(queries).collect()}
    assert "Query:\nyolo" in p[1].prompt and (p[2].prompt, p[2].error) == (None, "empty query")
    replies = spark.createDataFrame([(1, '```json\n{"rewritten_query":"q","topics":["a"],"why":"w"}\n```'), (2, "nothing")], "query_id long, reply string")
    got = {r.query_id: (r.query, r.topics, r.error) for r in pipelines.rewritten(replies).collect()}
    assert got == {1: ("q", ["a"], None), 2: (None, None, "no query in reply")}


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.range(6).selectExpr("id doc_id", "concat('Text of ', id, '. More here.') text")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    out = events.section_events(stream, OfflineProvider())
    events.run_available(out, lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))
    rows = lambda df: sorted((r.doc_id, r.seq, r.name, str(r.section), r.char_count) for r in df.collect())
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(events.section_events(docs, OfflineProvider()))


def test_stream_equals_analysis_of_long_texts(spark, tmp_path):
    long = "".join(f"Part {k}  says\tthis. " + "x" * 70 + ".\n\n\n\n" for k in range(200))
    docs = spark.createDataFrame([(1, long), (2, long + "bad " * 1200), (3, ""), (4, None), (5, " short.  text "), (6, "y" * 13000)], "doc_id long, text string").coalesce(1)
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    out = events.section_events(stream, failing, mermaid=True)
    events.run_available(out, lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {(r.doc_id, r.name): r.section for r in rows}
    wide = pipelines.analyse(docs, failing, mermaid=True).collect()
    want = {(r.doc_id, n): s for r in wide for n, s in r.sections.items()}
    assert got == want | {(r.doc_id, "done"): None for r in wide}
    assert got[2, "summary"].status == "failed" and len(rows) == 36
    assert all(sorted(r.seq for r in rows if r.doc_id == d) == [1, 2, 3, 4, 5, 6] for d in range(1, 7))
    assert {r.doc_id: r.char_count for r in rows if r.name == "done"} == {r.doc_id: r.char_count for r in wide}
    metered = pipelines.analyse(docs, Metered(), mermaid=True).collect()
    assert {(r.doc_id, n): s for r in metered for n, s in r.sections.items()} == want


def _finish(query, seconds=90):
    if not query.awaitTermination(seconds):
        query.stop()
        raise AssertionError("the stream does not end")


def test_answers_by_state(spark, tmp_path):
    at = datetime(2024, 1, 2, 3, 0, 0)
    log = [(1, "delta", 1, 1, "bad"), (1, "delta", 2, 1, "a"), (1, "delta", 2, 2, "b"), (1, "done", 2, 3, ""), (2, "delta", 1, 1, "x"), (2, "error", 1, 2, "HTTP"), (3, "delta", 1, 1, "open"), (4, "done", 1, 1, "whole")]
    schema = "request_id long, event string, attempt int, seq int, text string, at timestamp"

    def run(rows, when):
        spark.createDataFrame([(*r, when) for r in rows], schema).write.mode("append").parquet(str(tmp_path / "in"))
        out = events.answers_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        write = lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out"))
        _finish(out.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
        return {(r.request_id, r.status, r.answer) for r in spark.read.schema("request_id long, status string, answer string").parquet(str(tmp_path / "out")).collect()}

    first = {(1, "done", "ab"), (2, "error", None), (4, "done", "whole")}
    assert run(log, at) == first
    # Three hours later request 3 is forgotten: only what comes then is in its answer.
    assert run([(9, "delta", 1, 1, "z")], at.replace(hour=6)) == first
    assert run([(3, "delta", 1, 2, "late"), (3, "done", 1, 3, "")], at.replace(hour=6)) == first | {(3, "done", "late")}


def test_streamed_answers(spark):
    from lectern.operators.providers import stream_deltas, streamed

    lines = [b": hi", b"", b'data: {"choices":[{"delta":{"role":"x"}}]}', b'data: {"choices":[{"delta":{"content":"a"}}]}', b"data: not json", b'data:{"choices":[]}', 'data: {"choices":[{"delta":{"content":"数"}}]}', b"data: [DONE]"]
    assert list(stream_deltas(lines)) == ["a", "数"]
    try:
        list(stream_deltas([b"data: [DONE]"]))
        raise AssertionError
    except ValueError as e:
        assert str(e) == "empty reply"
    rows = [(1, "q", None), (2, "bad", None), (3, None, "no document")]
    got = streamed(spark.createDataFrame(rows, "request_id long, prompt string, error string"), Metered(), attempts=2, max_concurrency=2, pause=0).collect()
    by = {k: sorted(tuple(r)[1:] for r in got if r.request_id == k) for k in (1, 2, 3)}
    assert by[1] == [("delta", 1, 1, "an"), ("delta", 1, 2, "swer"), ("done", 1, 3, "")]
    assert by[2] == [("delta", 1, 1, "half"), ("delta", 2, 1, "half"), ("error", 2, 2, "HTTP 503")] and by[3] == [("error", 1, 1, "no document")]


def test_search_and_recommendations(spark):
    def fetch(queries):
        one = papers_api.scholar_records(queries.select("query_id", F.lit(JSON).alias("body")))
        two = papers_api.atom_records(queries.where("query <> 'down'").select("query_id", F.lit(ATOM).alias("body")))
        failed = queries.where("query = 'down'").select("query_id", F.lit("arXiv").alias("source"), F.lit(429).cast("long").alias("status"), F.lit(None).cast("string").alias("reason"))
        return one.unionByName(two), failed

    queries = spark.createDataFrame([(1, " a  b ", "5"), (2, " ", None), (3, "down", "99")], "query_id long, query string, limit string")
    items, outcomes = pipelines.searched(queries, fetch)
    assert {r.query_id: (r.query, r.errors) for r in outcomes.collect()} == {1: ("a b", []), 2: ("", ["empty query"]), 3: ("down", ["arXiv: rate limited, try again later"])}
    assert {(r.query_id, r.rank, r.title) for r in items.collect()} == {(1, 1, "a B"), (1, 2, "c"), (3, 1, "a B")}

    def rewrites(task, prompt):
        return '{"rewritten_query":"q","topics":["t"],"why":"since"}' if "good" in prompt else "no json"

    held = spark.createDataFrame([("s1", "good text", None), ("s2", "", ""), ("s3", None, "odd")], "session_id string, document_content string, document_excerpt string")
    text_ids = lambda q: tuple(x.withColumn("query_id", F.col("query_id").cast("string")) for x in fetch(q))
    items, outcomes = pipelines.recommended(held, rewrites, text_ids)
    assert {(r.query_id, r.rank, r.title, r.reason) for r in items.collect()} == {("s1", 1, "a B", "since"), ("s1", 2, "c", "since")}
    got = {r.query_id: (r.query, r.topics, r.errors) for r in outcomes.collect()}
    assert got == {"s1": ("q", ["t"], []), "s2": (None, None, ["no document"]), "s3": (None, None, ["no query in reply"])}
    now = F.lit(datetime(2024, 1, 2, 3, 4, 5)).cast("timestamp_ntz")
    full = sessions.with_defaults(held.withColumn("extra", F.lit(1)), now)
    r = full.where("session_id = 's1'").first()
    assert set(full.columns) == {f.name for f in sessions.T.StructType.fromDDL(sessions.SESSION_SCHEMA).fields} | {"extra"}
    assert (r.qa_history, r.paper_search.last_query, r.session_auth.token_hash, r.analysis.sections, r.document_excerpt) == ([], "", "", {}, "good text")
    assert (r.expires_at - r.created_at).total_seconds() == 86400
    kept = sessions.with_last_recommendation(sessions.with_last_search(full, items, outcomes.where("query IS NOT NULL")), items, outcomes, now)
    got = {r.session_id: r.paper_search for r in kept.collect()}
    assert [p.title for p in got["s1"].last_results] == ["a B", "c"] and got["s1"].last_recommendation.reason == "since" and got["s2"].last_query == ""


class _Reply(io.BytesIO):
    def __init__(self, body, headers, url):
        super().__init__(body)
        self.headers, self.url = headers, url

    def geturl(self):
        return self.url


def _open(link):
    import urllib.error

    if link.endswith("404.pdf"):
        raise urllib.error.HTTPError(link, 404, "Not Found", {}, None)
    body = {"http://x.org/big.pdf": b"x" * 50, "http://x.org/none.pdf": b""}.get(link, b"%PDF")
    return _Reply(body, {"Content-Type": "text/html" if "page" in link else "application/pdf"}, link)


def test_downloads_are_capped_and_guarded(spark):
    rows = [("a", "http://x.org/a.pdf", None), ("b", "http://x.org/big.pdf", None), ("c", "http://x.org/none.pdf", None), ("d", "http://10.0.0.1/a.pdf", None), ("e", "http://x.org/404.pdf", None), ("f", "http://x.org/page.pdf", None)]
    tries = papers_api.import_candidates(spark.createDataFrame(rows, "paper_id string, pdf_url string, url string"))
    got = {r.paper_id: (r.content, r.error) for r in papers_api.downloaded(tries, limit=20, open_url=_open).collect()}
    assert got == {"a": (bytearray(b"%PDF"), None), "b": (None, "larger than 16 MiB"), "c": (None, "empty file"), "d": (None, "address not public"), "e": (None, "the file is not at its source"), "f": (None, "a web page, not a file")}
    for url in ("http://127.0.0.1/x", "file:///etc/passwd", "http://localhost/"):
        try:
            papers_api._Guarded().redirect_request(None, None, 302, "", {}, url)
            raise AssertionError(url)
        except ValueError:
            pass


def test_sessions(spark):
    at = datetime(2024, 1, 2, 3, 4, 5)
    now = F.lit(at).cast("timestamp_ntz")
    rows = spark.createDataFrame([("a", at), ("b", datetime(2024, 1, 2, 3, 4, 4)), ("c", None)], "session_id string, expires_at timestamp_ntz")
    assert {r.session_id for r in sessions.alive(rows, now).collect()} == {"a", "c"}
    fresh = sessions.sessions_of(spark.createDataFrame([("a", "f", "x" * 13000, "t")], "session_id string, source_filename string, document string, token string"), now).first()
    assert len(fresh.document_excerpt) == 12000 and (fresh.expires_at - fresh.created_at).total_seconds() == 86400
    log = spark.createDataFrame([("a", 1, "q", "r", at)], "session_id string, turn long, question string, answer string, ts timestamp_ntz")
    new = spark.createDataFrame([("a", "q2", "r", at), ("b", "q", "r", at)], "session_id string, question string, answer string, ts timestamp_ntz")
    assert {(r.session_id, r.turn) for r in sessions.appended_turns(log, new).collect()} == {("a", 2), ("b", 1)}
    old = sections.section_of(F.lit(None).cast(f"map<string,{sessions.SECTION}>"), "summary", F.lit("flat"))
    assert spark.range(1).select(old.alias("s")).first().s.status == "success"


def test_limits(spark):
    raw = ["0", "-3", "99", "x", None]
    got = spark.createDataFrame([(x,) for x in raw], "v string").select(papers.clamped_limit(F.col("v")).alias("n")).collect()
    assert [r.n for r in got] == [8, 1, 20, 8, 8]
    assert answered(spark.createDataFrame([("quotes", None)], "task string, prompt string"), OfflineProvider()).first().reply is None
