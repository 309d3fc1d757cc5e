"""Registered queries over what surrounds an analysis: reports, sessions on reading, searches, streamed
answers, errors; each with its SQL twin."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.render import command_report, export_timestamp
from lectern.functions.text import json_or_error
from lectern.functions.urls import safe_link
from lectern.operators import papers, sessions
from lectern.operators.providers import streamed
from lectern.plans import pipelines
from lectern.plans.flow_queries import _TURNS, turns
from lectern.plans.text_queries import _compact, table
from lectern.sources.files import SAMPLE_TEXT, or_sample
from lectern.streaming.events import completed


def command_reports(spark, d):
    docs = table(spark, d, "documents")
    r = docs.select("doc_id", F.concat(F.lit("/in/"), "source").alias("path"), F.col("text").alias("summary"), F.col("lang").alias("quotes"), F.lit("m").alias("mindmap"))
    at = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    return r.select("doc_id", F.sha2(command_report(r, "1", at, "full", "none", 5), 256).alias("sha256"))


def export_times(spark, d):
    return table(spark, d, "events").select("event_id", export_timestamp(F.col("ts")).alias("shown"))


def reply_json(spark, d):
    kind = F.when(F.col("event_id") % 3 == 0, " Application/JSON; charset=utf-8").when(F.col("event_id") % 3 == 1, "text/html")
    body = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("{"), "event_type"))
    return table(spark, d, "events").select("event_id", json_or_error(kind, body).alias("reply"))


def source_errors(spark, d):
    e = table(spark, d, "events")
    source = F.when(F.col("event_id") % 2 == 0, "arXiv").otherwise("Semantic Scholar")
    status = F.when(F.col("event_id") % 4 > 0, 400 + F.col("event_id") % 40)
    reason = F.when(F.col("event_id") % 8 == 0, "[SSL: CERTIFICATE_VERIFY_FAILED] x").otherwise(F.col("event_type"))
    return e.select("event_id", papers.source_error(source, status, reason).alias("search"), papers.download_error(status, reason).alias("download"))


def safe_links(spark, d):
    link = F.element_at(F.array(F.col("url"), F.concat(F.lit("/p/"), "page_id"), F.lit(" javascript:alert(1)"), F.lit("mailto:a@b.org"), F.lit("")), (F.col("page_id") % 5 + 1).cast("int"))
    return table(spark, d, "pages").select("page_id", safe_link(link).alias("link"))


def sample_texts(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("text")).when(F.col("doc_id") % 2 == 0, " \n").alias("text"))
    return or_sample(docs).select("doc_id", F.sha2("text", 256).alias("sha256"), "is_empty")


def session_reads(spark, d):
    """Sessions as an older version kept them, read with all defaults."""
    docs = table(spark, d, "documents")
    old = docs.select(F.concat(F.lit("s"), "doc_id").alias("session_id"), F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("document_content"), F.struct(F.col("source").alias("last_query")).alias("paper_search"))
    now = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    full = sessions.with_defaults(old, now)
    text = sessions.session_text(F.col("document_content"), F.col("document_excerpt"))
    return full.select(
        "session_id", "source_filename", "created_at", "expires_at", F.sha2(text, 256).alias("text"), F.sha2("document_excerpt", 256).alias("excerpt"), F.size("qa_history").alias("turns"),
        "paper_search.last_query", F.size("paper_search.last_results").alias("results"), "session_auth.token_hash", F.size("analysis.sections").alias("sections"))


def fresh_sessions(spark, d):
    docs = table(spark, d, "documents")
    a = docs.select(F.col("doc_id").alias("session_id"), F.col("source").alias("source_filename"), F.col("text").alias("document"), F.col("lang").alias("token"))
    out = sessions.sessions_of(a, F.lit("2024-05-06 07:08:09.5").cast("timestamp_ntz"))
    return out.select("session_id", "source_filename", "created_at", "expires_at", F.sha2("document_content", 256).alias("content"), F.sha2("document_excerpt", 256).alias("excerpt"), "session_auth.token_hash")


def cleanup_times(spark, d):
    e = table(spark, d, "events")
    last = F.when(F.col("event_id") % 5 > 0, F.col("ts") - F.make_dt_interval(secs=F.col("event_id") % 1200))
    return e.select("event_id", sessions.cleanup_due(last, F.col("ts")).alias("due"), sessions.cleanup_due(last, F.col("ts"), force=True).alias("forced"))


def appended_turns(spark, d):
    """The later questions of each session, appended to its first two."""
    all_turns = turns(spark, d)
    old = all_turns.where("turn < 4")
    new = all_turns.where("turn >= 4").select("session_id", "question", "answer", F.col("turn").alias("ts"))
    return sessions.appended_turns(old, new).select("session_id", F.col("ts").alias("at"), "turn")


# ---- searches and answers ----


def _sources(spark, d, some_fail: bool):
    """Two sources that find documents and benchmark items of a query's number; some calls fail."""

    def fetch(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        def of(name: str, key: str, src: int) -> DataFrame:
            rows = table(spark, d, name).select((F.col(key) % 20).alias("number"), F.col(key).alias("pos"), papers.compacted(F.col("text"), 300).alias("title"))
            asked = queries.select("query_id", F.regexp_extract(F.col("query_id").cast("string"), r"\d+$", 0).cast("long").alias("number"))
            return rows.join(asked, "number").select(
                "query_id", F.lit(src).alias("src_ord"), "pos", "title", F.array().cast("array<string>").alias("authors"), *[F.lit("").alias(c) for c in papers.FIELDS if c not in ("title", "authors")])

        failed = queries.select("query_id", F.lit("arXiv").alias("source"), F.lit(429).cast("long").alias("status"), F.lit(None).cast("string").alias("reason"))
        bad = F.regexp_extract(F.col("query_id").cast("string"), r"\d$", 0).isin("3", "7") & F.lit(some_fail)
        records = of("benchmark", "item_id", 0).unionByName(of("documents", "doc_id", 1).where(~bad))
        return records, failed.where(bad)

    return fetch


def search_outcomes(spark, d):
    query = F.when(F.col("id") % 6 == 0, "  ").otherwise(F.concat(F.lit(" query \n "), F.col("id").cast("string")))
    queries = spark.range(20).select(F.col("id").alias("query_id"), query.alias("query"), F.lit("5").alias("limit"))
    items, outcomes = pipelines.searched(queries, _sources(spark, d, True))
    found = items.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.min("src_ord").alias("first"), F.sum("pos").alias("places"))
    return outcomes.join(found, "query_id", "left").select("query_id", "query", F.array_join("errors", ";").alias("errors"), "found", "first", "places")


class _Rewriter:
    """Deterministic: the query is the first words of the context."""

    def __call__(self, task: str, prompt: str) -> str:
        context = prompt.split("Context:\n", 1)[1]
        words = context.split()[:3]
        return "none" if len(words) < 3 else json.dumps({"rewritten_query": " ".join(words), "topics": words[:1], "why": f"{len(context)} characters"})


def recommendations(spark, d):
    docs = table(spark, d, "documents")
    held = docs.select(F.concat(F.lit("s"), "doc_id").alias("session_id"), F.when(F.col("doc_id") % 4 > 0, F.col("text")).alias("document_content"), F.when(F.col("doc_id") % 4 == 1, "").alias("document_excerpt"))
    items, outcomes = pipelines.recommended(held, _Rewriter(), _sources(spark, d, False))
    found = items.groupBy("query_id").agg(F.count(F.lit(1)).alias("found"), F.sum("pos").alias("places"), F.min("reason").alias("shared"))
    return outcomes.join(found, "query_id", "left").select("query_id", "query", F.array_join("topics", ";").alias("topics"), "reason", F.array_join("errors", ";").alias("errors"), "found", "places", "shared")


class _Words:
    """Streams a prompt's words back; prompts with ``x`` fail once they have begun."""

    def __call__(self, task: str, prompt: str) -> str:
        return prompt

    def deltas(self, prompt: str) -> Iterator[str]:
        for k, word in enumerate(prompt.split(" ")):
            if k == 2 and "x" in prompt:
                raise ValueError("broken off")
            yield word + "|"


def _streamed(spark, d) -> DataFrame:
    c = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), "role", F.col("text").alias("prompt"))
    asked = c.select("request_id", F.when(F.col("role") != "system", F.col("prompt")).alias("prompt"), F.when(F.col("role") == "system", "refused").alias("error"))
    return streamed(asked, _Words(), attempts=2, pause=0)


def answer_events(spark, d):
    return _streamed(spark, d).groupBy("request_id", "event", "attempt").agg(F.count(F.lit(1)).alias("n"), F.max("seq").alias("last"), F.min(F.when(F.col("event") == "error", F.col("text"))).alias("error"))


def streamed_answers(spark, d):
    rows = _streamed(spark, d)
    done = rows.where("event = 'done'").select("request_id", F.col("text").alias("answer"))
    whole = completed(rows.where("event = 'delta'"), done).join(done.select("request_id"), "request_id", "left_semi")
    return whole.select("request_id", F.sha2("answer", 256).alias("sha256"))


QUERIES = {f.__name__: f for f in [
    command_reports, export_times, reply_json, source_errors, safe_links, sample_texts, session_reads, fresh_sessions, cleanup_times, appended_turns,
    search_outcomes, recommendations, answer_events, streamed_answers,
]}

_RULE = "chr(10)||chr(10)||'---'||chr(10)||chr(10)"
_PARA = "chr(10)||chr(10)"
_REASONS = "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'arXiv' ELSE 'Semantic Scholar' END AS source, CASE WHEN event_id % 4 > 0 THEN 400 + event_id % 40 END AS status, CASE WHEN event_id % 8 = 0 THEN '[SSL: CERTIFICATE_VERIFY_FAILED] x' ELSE event_type END AS reason FROM events"
_FOUND = f"""records AS (
  SELECT item_id % 20 AS number, item_id AS pos, 0 AS src_ord, {_compact('text', 300)} AS title FROM benchmark UNION ALL SELECT doc_id % 20, doc_id, 1, {_compact('text', 300)} FROM documents
), joined AS (SELECT query_id, top, src_ord, pos, lower(title) AS k FROM asked JOIN records USING (number) WHERE NOT (bad AND src_ord = 1)
), cut AS (SELECT * FROM joined QUALIFY row_number() OVER (PARTITION BY query_id, src_ord ORDER BY pos) <= top
), one AS (SELECT * FROM cut WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY src_ord, pos) = 1
), ranked AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY src_ord, pos) <= top)"""
_PIECES = """pieces AS (SELECT conv_id * 1000 + turn AS request_id, role, text, len(string_split(text, ' ')) AS n, contains(text, 'x') AND len(string_split(text, ' ')) > 2 AS broken FROM conversations)"""

ORACLES = {
    "command_reports": f"""SELECT doc_id, sha256('# Analysis report'||{_PARA}||'> Generated: 2024-05-06 07:08:09'||chr(10)||'> Source: /in/'||source||chr(10)||'> Version: 1'||chr(10)||'> Mode: full'||chr(10)||'> Model: none'||chr(10)||'> Concurrency: 5'
        ||{_RULE}||'## Summary'||{_PARA}||coalesce(text, '')||{_RULE}||'## Quotes'||{_PARA}||coalesce(lang, '')||{_RULE}||'## Structure'||{_PARA}||'m'||chr(10)) AS sha256 FROM documents""",
    "export_times": "SELECT event_id, strftime(ts, '%-m/%-d/%Y, %-I:%M:%S %p') AS shown FROM events",
    "reply_json": """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN props ELSE '{}' END
        ELSE '{"error":' || to_json(CASE WHEN event_id % 2 = 0 THEN props ELSE '{' || event_type END) || '}' END AS reply FROM events""",
    "source_errors": f"""SELECT event_id, CASE WHEN status = 429 THEN source || ': rate limited, try again later' WHEN status IS NOT NULL THEN source || ': HTTP ' || status
        WHEN contains(lower(reason), 'ssl') THEN source || ': secure connection failed' ELSE source || ': ' || reason END AS search,
        CASE status WHEN 404 THEN 'the file is not at its source' WHEN 403 THEN 'the source refuses access to the file' WHEN 429 THEN 'the source limits downloads, try again later'
        ELSE CASE WHEN status IS NOT NULL THEN 'the download failed with HTTP ' || status WHEN contains(reason, 'CERTIFICATE_VERIFY_FAILED') THEN 'secure connection failed during the download'
        ELSE 'the download failed: ' || reason END END AS download FROM ({_REASONS})""",
    "safe_links": "SELECT page_id, [url, 'https://localhost/p/' || page_id, '#', 'mailto:a@b.org', '#'][page_id % 5 + 1] AS link FROM pages",
    "sample_texts": f"SELECT doc_id, sha256(t) AS sha256, trim(t, ' ') = '' AS is_empty FROM (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN text WHEN doc_id % 2 = 0 THEN ' ' || chr(10) ELSE '{SAMPLE_TEXT}' END AS t FROM documents)",
    "session_reads": """SELECT 's' || doc_id AS session_id, '' AS source_filename, TIMESTAMP '2024-05-06 07:08:09' AS created_at, TIMESTAMP '2024-05-07 07:08:09' AS expires_at,
        sha256(CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE '' END) AS text, sha256(left(CASE WHEN doc_id % 2 = 0 THEN coalesce(text, '') ELSE '' END, 12000)) AS excerpt,
        0 AS turns, source AS last_query, 0 AS results, '' AS token_hash, 0 AS sections FROM documents""",
    "fresh_sessions": """SELECT doc_id AS session_id, source AS source_filename, TIMESTAMP '2024-05-06 07:08:09.5' AS created_at, TIMESTAMP '2024-05-07 07:08:09' AS expires_at,
        sha256(text) AS content, sha256(left(coalesce(text, ''), 12000)) AS excerpt, sha256(lang) AS token_hash FROM documents""",
    "cleanup_times": "SELECT event_id, event_id % 5 = 0 OR event_id % 1200 >= 600 AS due, true AS forced FROM events",
    "appended_turns": f"""WITH {_TURNS}, old AS (SELECT session_id, max(turn) AS last FROM turns WHERE turn < 4 GROUP BY session_id)
        SELECT session_id, turn AS at, CAST(coalesce(last, 0) + row_number() OVER (PARTITION BY session_id ORDER BY turn, question) AS BIGINT) AS turn FROM turns LEFT JOIN old USING (session_id) WHERE turn >= 4""",
    "search_outcomes": f"""WITH asked AS (SELECT range AS query_id, range AS number, 5 AS top, range % 10 IN (3, 7) AS bad FROM range(20) WHERE range % 6 > 0), {_FOUND}
        SELECT range AS query_id, CASE WHEN range % 6 = 0 THEN '' ELSE 'query ' || range END AS query, CASE WHEN range % 6 = 0 THEN 'empty query' WHEN range % 10 IN (3, 7) THEN 'arXiv: rate limited, try again later' ELSE '' END AS errors, found, first, places
        FROM range(20) LEFT JOIN (SELECT query_id, count(*) AS found, min(src_ord) AS first, CAST(sum(pos) AS BIGINT) AS places FROM ranked GROUP BY query_id) ON query_id = range""",
    "recommendations": f"""WITH held AS (SELECT doc_id, CASE WHEN doc_id % 4 > 0 THEN coalesce(text, '') ELSE '' END AS t FROM documents
        ), worded AS (SELECT *, list_filter(string_split_regex(left(t, 6000), '\\s+'), lambda w: w <> '') AS w, length(left(t, 6000)) AS n FROM held
        ), asked AS (SELECT 's' || doc_id AS query_id, CAST(regexp_extract('s' || doc_id, '\\d+$') AS BIGINT) AS number, 6 AS top, false AS bad FROM worded WHERE len(w) > 2), {_FOUND}
        SELECT 's' || doc_id AS query_id, CASE WHEN len(w) > 2 THEN array_to_string(w[1:3], ' ') END AS query, CASE WHEN len(w) > 2 THEN w[1] END AS topics, CASE WHEN len(w) > 2 THEN n || ' characters' END AS reason,
        CASE WHEN t = '' THEN 'no document' WHEN len(w) < 3 THEN 'no query in reply' ELSE '' END AS errors, found, places, CASE WHEN found > 0 THEN n || ' characters' END AS shared
        FROM worded LEFT JOIN (SELECT query_id, count(*) AS found, CAST(sum(pos) AS BIGINT) AS places FROM ranked GROUP BY query_id) f ON f.query_id = 's' || doc_id""",
    "answer_events": f"""WITH {_PIECES}
        SELECT request_id, 'error' AS event, 1 AS attempt, 1 AS n, 1 AS last, 'refused' AS error FROM pieces WHERE role = 'system'
        UNION ALL SELECT request_id, 'delta', 1, n, n, NULL FROM pieces WHERE role <> 'system' AND NOT broken UNION ALL SELECT request_id, 'done', 1, 1, n + 1, NULL FROM pieces WHERE role <> 'system' AND NOT broken
        UNION ALL SELECT request_id, 'delta', a, 2, 2, NULL FROM pieces, (VALUES (1), (2)) v(a) WHERE role <> 'system' AND broken UNION ALL SELECT request_id, 'error', 2, 1, 3, 'broken off' FROM pieces WHERE role <> 'system' AND broken""",
    "streamed_answers": f"WITH {_PIECES} SELECT request_id, sha256(replace(text, ' ', '|') || '|') AS sha256 FROM pieces WHERE role <> 'system' AND NOT broken",
}
