"""Registered queries over what is written, imported and streamed, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import protected_math, restored_math
from lectern.operators.providers import OfflineProvider
from lectern.operators.session_store import SessionStore
from lectern.operators.sessions import expiry, validated
from lectern.operators.storage import shared_folder
from lectern.plans import imports, pipelines
from lectern.plans.flow_queries import _CLEAN
from lectern.plans.service_queries import _PIECES, _streamed
from lectern.plans.text_queries import cleaned_sql, table
from lectern.sources.file_sink import saved_texts, stored
from lectern.streaming import asking, events, frames, superseding


def session_compaction(spark, d):
    """Every event is a write of its user's session, in three appends that overlap in time with two
    compactions; what is left are the sessions that outlive the last one."""
    e = table(spark, d, "events")
    ends = F.when(F.col("user_id") % 7 > 0, expiry(F.col("ts"), 86400 * 3))
    writes = e.select(F.col("user_id").cast("string").alias("session_id"), F.col("ts").alias("updated_at"), ends.alias("expires_at"), F.col("event_id").alias("note"))
    store = SessionStore(spark, shared_folder(spark, "sessions"), "session_id string, updated_at timestamp_ntz, expires_at timestamp_ntz, note long", buckets=16)
    middle, last = e.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2"), F.max("ts")).first()
    for part in range(3):
        store.append(writes.where(F.col("note") % 3 == part))
        if part:
            store.cleanup(middle if part == 1 else last, force=True)
    return store.sessions().select("session_id", "updated_at", "expires_at")


def saved_files(spark, d):
    """Each document's text as a file, read back by tasks that list the files' folders."""
    folder = shared_folder(spark, "files")
    docs = table(spark, d, "documents")
    saved_texts(docs, folder, F.concat(F.lit("d"), "doc_id", F.lit(".txt")), F.col("text"), spread=True)
    return stored(spark, folder).select("name", "length", F.sha2("content", 256).alias("sha256"))


def _served(spark, d):
    """What the addresses of ``import_outcomes`` answer: documents, refusals and pages."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))

    def fetch(candidates: DataFrame) -> DataFrame:
        k = F.col("paper_id") % 8
        error = F.coalesce("refused", F.when((k == 1) & (F.col("ord") == 0), "the file is not at its source"))
        kind = F.when(k == 4, "text/html; charset=utf-8").when(k.isin(0, 1, 7), "text/plain")
        name = F.when(k == 7, F.concat(F.lit('attachment; filename="paper '), "paper_id", F.lit('.txt"')))
        served = candidates.join(docs, "paper_id")
        return served.select("paper_id", F.col("ord").cast("int").alias("ord"), "link", kind.alias("content_type"), name.alias("disposition"), F.when(error.isNull(), F.col("content")).alias("content"), error.alias("error"))

    return fetch


def import_outcomes(spark, d):
    k, link = F.col("doc_id") % 8, lambda *x: F.concat(F.lit("http://x.org/"), *x)
    key = F.col("doc_id").cast("string")
    pdf = (
        F.when(k == 0, link(key, F.lit(".txt"))).when(k == 1, link(F.lit("404/"), key, F.lit(".pdf"))).when(k == 2, "http://10.0.0.1/a.txt")
        .when(k == 4, link(F.lit("page/"), key)).when(k == 5, link(key, F.lit(".bin"))).when(k == 6, link(key, F.lit(".docx"))).when(k == 7, link(F.lit("files/"), key))
    )
    url = F.when(k == 1, link(key, F.lit(".txt"))).when(k == 2, link(F.lit("abs/"), key))
    papers = table(spark, d, "documents").select(F.col("doc_id").alias("paper_id"), F.lit("T").alias("title"), pdf.alias("pdf_url"), url.alias("url"), F.when(F.col("doc_id") % 16 < 8, "no").alias("generate_mermaid"))
    out = imports.imported(papers, OfflineProvider(), fetch=_served(spark, d))
    diagram = F.coalesce(F.col("sections.mermaid.status"), F.lit("none"))
    return out.select("paper_id", "source_filename", "char_count", F.split_part("error", F.lit(":"), F.lit(1)).alias("error"), "status", diagram.alias("diagram"))


def request_statuses(spark, d):
    c = table(spark, d, "customer")
    known = c.where("c_custkey % 5 > 0").select(F.col("c_custkey").cast("string").alias("session_id"), F.sha2(F.col("c_custkey").cast("string"), 256).alias("token_hash"))
    token = F.when(F.col("c_custkey") % 3 == 0, "bad").otherwise(F.col("c_custkey").cast("string"))
    asked = c.select(F.col("c_custkey").alias("request_id"), F.when(F.col("c_custkey") % 11 > 0, F.col("c_custkey").cast("string")).alias("session_id"), token.alias("token"))
    error = F.coalesce("error", F.when(F.col("request_id") % 4 == 0, "HTTP 503"))
    return validated(asked, known).select("request_id", imports.request_status(error).alias("status"))


def frame_pieces(spark, d):
    """Each document is streamed as one frame of its lines and one of its language, in pieces of 97 bytes."""
    lines = F.concat(F.lit(": whole text\r\nevent: text\r\ndata: "), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\r\ndata: ")), F.lit("\r\n\r\ndata: "), "lang", F.lit("\n"))
    raw = table(spark, d, "documents").select(F.col("doc_id").alias("stream_id"), F.encode(lines, "UTF-8").alias("b"))
    at = raw.select("stream_id", "b", F.explode(F.sequence(F.lit(0), F.octet_length("b"), F.lit(97))).alias("at"))
    out = frames.frames_of(at.select("stream_id", "at", F.expr("substring(b, at + 1, 97)").alias("piece")))
    return out.select("stream_id", "nth", "event", F.sha2("data", 256).alias("sha256"))


def ask_protocol(spark, d):
    """Questions answered word by word, as the events their clients get."""
    rows = _streamed(spark, d).withColumns({"session_id": (F.col("request_id") / 1000).cast("long").cast("string"), "question": F.lit("?")})
    return asking.protocol_batch(rows).select("request_id", "seq", "event", "text", "session_id")


def math_protection(spark, d):
    """Texts with formulas put in, two for each sentence: what is protected, and what comes back."""
    docs = table(spark, d, "documents")
    plain = F.replace(F.coalesce("text", F.lit("")), F.lit("$"), F.lit("S"))
    formulas = F.concat(F.lit(". \\[a_"), F.col("doc_id").cast("string"), F.lit("\n*b*\\] and \\(x < "), F.col("doc_id").cast("string"), F.lit("\\) "))
    held = docs.select("doc_id", F.replace(plain, F.lit(". "), formulas).alias("t"))
    p = held.select("doc_id", protected_math(F.col("t")).alias("p"))
    return p.select("doc_id", (F.size("p.blocks") + F.size("p.inline")).alias("n"), F.sha2("p.text", 256).alias("protected"), F.sha2(restored_math(F.col("p.text"), F.col("p.blocks"), F.col("p.inline")), 256).alias("restored"))


def evaluated_documents(spark, d):
    out = pipelines.analyse(table(spark, d, "documents").select("doc_id", "text"), OfflineProvider(), evaluation=True)
    return out.select("doc_id", "evaluation", F.col("sections.evaluation.status").alias("status"))


def analysis_frames(spark, d):
    """The streamed analysis as its clients get it."""
    out = events.analysis_protocol(table(spark, d, "documents").select("doc_id", "text"), OfflineProvider(), mermaid=True)
    return out.select("doc_id", "seq", "event", F.sha2(F.coalesce(F.get_json_object("payload", "$.section.content"), "payload"), 256).alias("sha256"), F.get_json_object("payload", "$.name").alias("name"))


def shown_pieces(spark, d):
    """Every twentieth event of a user begins a request, numbered by its event; the others are pieces of the
    request before, of the one before that, or of none."""
    e = table(spark, d, "events")
    begins = F.col("event_id") % 20 == 0
    rows = e.select(
        F.col("user_id").alias("client_id"), F.when(begins, F.col("event_id")).otherwise((F.col("event_id") / 20).cast("long") * 20 - (F.col("event_id") % 3) * 20).alias("request_id"),
        F.when(begins, "start").otherwise("delta").alias("event"), (F.col("event_id") % 20).alias("seq"), F.col("props").alias("text"), F.col("ts").alias("at"))
    return superseding.shown_batch(rows)


QUERIES = {f.__name__: f for f in [
    session_compaction, saved_files, import_outcomes, request_statuses, frame_pieces, ask_protocol, math_protection, evaluated_documents, analysis_frames, shown_pieces,
]}

_SERVED = f"SELECT doc_id, doc_id % 8 AS k, coalesce(text, '') AS t, {cleaned_sql('text')} AS clean FROM documents"

ORACLES = {
    "session_compaction": """WITH newest AS (SELECT user_id, ts, CASE WHEN user_id % 7 > 0 THEN date_trunc('second', ts) + INTERVAL 72 HOUR END AS ends FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT CAST(user_id AS VARCHAR) AS session_id, ts AS updated_at, ends AS expires_at FROM newest WHERE ends IS NULL OR ends >= (SELECT max(ts) FROM events)""",
    "saved_files": "SELECT 'd' || doc_id || '.txt' AS name, CAST(octet_length(encode(text)) AS BIGINT) AS length, sha256(text) AS sha256 FROM documents WHERE text <> ''",
    "import_outcomes": f"""WITH served AS ({_SERVED}), told AS (SELECT *, CASE WHEN k = 3 THEN 'address required' WHEN k = 2 THEN 'not a direct file' WHEN t = '' THEN 'empty file' WHEN k = 4 THEN 'a web page, not a file' WHEN k = 5 THEN 'unknown file type' WHEN k = 6 THEN 'could not read .docx' END AS error FROM served)
        SELECT doc_id AS paper_id, CASE WHEN k IN (0, 1) AND error IS NULL THEN doc_id || '.txt' WHEN k = 7 AND error IS NULL THEN 'paper_' || doc_id || '.txt' WHEN k = 6 AND t <> '' THEN doc_id || '.docx' END AS source_filename,
        CASE WHEN error IS NULL THEN CAST(length(clean) AS INTEGER) END AS char_count, error, CASE WHEN error IS NULL THEN 200 ELSE 400 END AS status,
        CASE WHEN error IS NOT NULL THEN 'none' WHEN doc_id % 16 < 8 THEN 'disabled' WHEN clean = '' THEN 'empty' ELSE 'success' END AS diagram FROM told""",
    "request_statuses": """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 5 = 0 THEN 400 WHEN c_custkey % 3 = 0 THEN 403 WHEN c_custkey % 4 = 0 THEN 500 ELSE 200 END AS status FROM customer""",
    "frame_pieces": """WITH f AS (SELECT doc_id, 1 AS part, 'text' AS event, coalesce(text, '') AS data FROM documents UNION ALL SELECT doc_id, 2, 'message', lang FROM documents)
        SELECT doc_id AS stream_id, row_number() OVER (PARTITION BY doc_id ORDER BY part) AS nth, event, sha256(data) AS sha256 FROM f WHERE data <> ''""",
    "ask_protocol": f"""WITH {_PIECES}, words AS (SELECT *, string_split(text, ' ') AS w FROM pieces WHERE role <> 'system'), rows AS (
        SELECT request_id, 0 AS part, 0 AS attempt, 0 AS place, 'start' AS event, NULL AS text FROM pieces
        UNION ALL SELECT request_id, 1, 1, i, 'delta', w[i] || '|' FROM words, range(1, 100000) r(i) WHERE NOT broken AND i <= len(w)
        UNION ALL SELECT request_id, 1, a, i, 'delta', w[i] || '|' FROM words, (VALUES (1), (2)) v(a), (VALUES (1), (2)) u(i) WHERE broken
        UNION ALL SELECT request_id, 2, 0, 0, CASE WHEN broken THEN 'error' ELSE 'done' END, CASE WHEN broken THEN 'broken off' ELSE replace(text, ' ', '|') || '|' END FROM words
        UNION ALL SELECT request_id, 2, 0, 0, 'error', 'refused' FROM pieces WHERE role = 'system')
        SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY part, attempt, place) AS INTEGER) AS seq, event, text, CAST(request_id // 1000 AS VARCHAR) AS session_id FROM rows""",
    "math_protection": r"""WITH p AS (SELECT doc_id, string_split(replace(coalesce(text, ''), '$', 'S'), '. ') AS w FROM documents), m AS (SELECT *, len(w) - 1 AS n FROM p)
        SELECT doc_id, CAST(2 * n AS INTEGER) AS n,
        sha256(array_to_string(list_transform(range(1, n + 2), lambda i: w[i] || CASE WHEN i <= n THEN '. ' || chr(10) || chr(10) || '@@MATHBLOCK' || (i - 1) || '@@' || chr(10) || chr(10) || ' and @@MATHINLINE' || (i - 1) || '@@ ' ELSE '' END), '')) AS protected,
        sha256(array_to_string(list_transform(range(1, n + 2), lambda i: w[i] || CASE WHEN i <= n THEN '. $$a_' || doc_id || chr(10) || '*b*$$ and $x < ' || doc_id || '$ ' ELSE '' END), '')) AS restored FROM m""",
    "analysis_frames": _CLEAN + """, sections AS (SELECT doc_id, 1 AS seq, 'summary' AS name, reply FROM summary UNION ALL SELECT doc_id, 2, 'quotes', reply FROM quotes UNION ALL SELECT doc_id, 3, 'mindmap', reply FROM mindmap
        UNION ALL SELECT doc_id, 4, 'mermaid', reply FROM mermaid UNION ALL SELECT doc_id, 5, 'evaluation', '' FROM docs)
        SELECT doc_id, seq, 'section' AS event, sha256(reply) AS sha256, name FROM sections UNION ALL SELECT doc_id, 0, 'start', sha256('{"doc_id":' || doc_id || '}'), NULL FROM docs
        UNION ALL SELECT doc_id, 6, 'done', sha256('{"doc_id":' || doc_id || ',"char_count":' || n || '}'), NULL FROM docs""",
    "shown_pieces": """WITH r AS (SELECT user_id AS client_id, CASE WHEN event_id % 20 = 0 THEN event_id ELSE (event_id // 20) * 20 - (event_id % 3) * 20 END AS request_id, event_id % 20 > 0 AS piece, CAST(event_id % 20 AS INTEGER) AS seq, props AS text, ts AS at_ FROM events)
        SELECT client_id, request_id, seq, text, at_ AS "at" FROM r WHERE piece AND request_id >= coalesce((SELECT max(request_id) FROM r s WHERE s.client_id = r.client_id AND NOT s.piece AND s.at_ <= r.at_), request_id)""",
    "evaluated_documents": _CLEAN + """SELECT doc_id, CASE WHEN len(q) > 0 THEN '## Extent' || chr(10) || len(q) || ' sentences, ' || length(left(t, 15000)) || ' characters' ELSE '' END AS evaluation,
        CASE WHEN len(q) > 0 THEN 'success' ELSE 'empty' END AS status FROM found JOIN docs USING (doc_id)""",
}
