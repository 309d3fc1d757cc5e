"""Registered queries over sessions, history, sections, papers and events, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.render import session_markdown as as_markdown
from lectern.functions.render import turns_markdown
from lectern.operators import papers, sections, sessions
from lectern.operators.history import answer_prompt, history_blocks
from lectern.operators.providers import OfflineProvider, answered
from lectern.plans import pipelines
from lectern.plans.text_queries import _compact, _trim, cleaned_sql, table, windows_sql
from lectern.streaming import events as streams


def turns(spark: SparkSession, d: str) -> DataFrame:
    """Questions of conversations with the answers that follow them."""
    by = W.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").withColumn("next_role", F.lead("role").over(by)).withColumn("next_text", F.lead("text").over(by))
    answer = F.when(F.col("next_role") == "assistant", F.col("next_text"))
    return rows.where("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("question"), answer.alias("answer"))


_TURNS = """turns AS (
  SELECT conv_id AS session_id, turn, text AS question, CASE WHEN next_role = 'assistant' THEN next_text END AS answer FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user')"""
_HISTORY = """{turns}, shown AS (
  SELECT session_id, turn, 'Q: ' || {q} || chr(10) || 'A: ' || {a} AS section FROM turns WHERE {q} <> '' OR {a} <> ''
), fitting AS (
  SELECT * FROM (SELECT *, sum(length(section)) OVER (PARTITION BY session_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM shown) WHERE used <= {budget}
), blocks AS (
  SELECT session_id, string_agg(section, chr(10)||chr(10)||'---'||chr(10)||chr(10) ORDER BY turn) AS history, count(*) AS n_turns FROM fitting GROUP BY session_id)"""


def _history(budget: int) -> str:
    return "WITH " + _HISTORY.format(turns=_TURNS, q=_trim("question", 400), a=_trim("answer", 800), budget=budget)


def history_block(spark, d):
    return history_blocks(turns(spark, d)).select("session_id", "n_turns", F.sha2("history", 256).alias("sha256"))


def history_block_tight(spark, d):
    return history_blocks(turns(spark, d), 1500).select("session_id", "n_turns", F.sha2("history", 256).alias("sha256"))


def prompt_build(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("session_id"), F.col("text").alias("document"))
    blocks = history_blocks(turns(spark, d), 1500)
    joined = docs.join(blocks, "session_id", "left")
    prompt = answer_prompt(F.col("document"), F.col("history"), F.concat(F.lit("What of "), F.col("session_id").cast("string"), F.lit("?")))
    return joined.select("session_id", F.sha2(prompt, 256).alias("sha256"), F.length(prompt).alias("chars"))


def session_markdown(spark, d):
    docs = table(spark, d, "documents")
    held = docs.select(
        F.col("doc_id").alias("session_id"), F.col("source").alias("source_filename"), F.col("n_chars").alias("char_count"), F.col("text").alias("summary"),
        F.lit("").alias("quotes"), F.when(F.col("doc_id") % 2 == 0, "tree").alias("mindmap"), F.lit(None).cast("string").alias("evaluation"), F.when(F.col("doc_id") % 3 == 0, "graph TD").alias("mermaid"),
    )
    return as_markdown(held, turns(spark, d)).select("session_id", F.sha2("markdown", 256).alias("sha256"))


def report_markdown(spark, d):
    from lectern.functions.render import analysis_report

    docs = table(spark, d, "documents")
    r = docs.select("doc_id", F.col("source").alias("source_filename"), F.col("n_chars").alias("char_count"), F.col("text").alias("summary"), F.col("lang").alias("quotes"), F.lit("m").alias("mindmap"), F.lit("e").alias("evaluation"))
    at = F.lit("2024-05-06 07:08:09").cast("timestamp_ntz")
    return r.select("doc_id", F.sha2(analysis_report(r, "1", at, True, F.lit(1.5)), 256).alias("sha256"))


def turn_numbers(spark, d):
    return turns_markdown(turns(spark, d)).select("session_id", F.length("qa").alias("chars"))


# ---- papers ----


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Two sources: documents and benchmark items, as records of query doc_id % 20."""
    shared = lambda df, key, src: df.select(
        (F.col(key) % 20).alias("query_id"), F.col(key).alias("pos"), F.lit(src).alias("src_ord"), papers.compacted(F.col("text"), 300).alias("title"))
    return shared(table(spark, d, "documents"), "doc_id", 1).unionByName(shared(table(spark, d, "benchmark"), "item_id", 0))


_RECORDS = f"""records AS (
  SELECT doc_id % 20 AS query_id, doc_id AS pos, 1 AS src_ord, {_compact('text', 300)} AS title FROM documents
  UNION ALL SELECT item_id % 20, item_id, 0, {_compact('text', 300)} FROM benchmark
), keyed AS (SELECT *, lower(regexp_replace(regexp_replace(title, '^\\s+|\\s+$', '', 'g'), '\\s+', ' ', 'g')) AS k FROM records)"""


def dedup_titles(spark, d):
    return papers.first_wins(_records(spark, d), []).select("src_ord", "pos", "title")


def search_union_limit(spark, d):
    limits = spark.range(20).select(F.col("id").alias("query_id"), F.when(F.col("id") < 10, F.col("id").cast("string")).when(F.col("id") < 15, "x").alias("limit"))
    return papers.federated(_records(spark, d), limits).select("query_id", "rank", "src_ord", "pos", "title")


def paper_cards(spark, d):
    i = table(spark, d, "documents").select("doc_id", F.struct(
        F.col("source").alias("paperId"), F.col("text").alias("title"), F.lit(None).cast("string").alias("abstract"), (F.lit(1990) + F.col("doc_id") % 40).cast("int").alias("year"),
        F.when(F.col("doc_id") % 2 == 0, "Venue").alias("venue"), F.lit("https://x.org/p").alias("url"), F.array(F.struct(F.col("lang").alias("name"), F.lit("").alias("author"))).alias("authors"),
        F.struct(F.lit(None).cast("string").alias("url")).alias("openAccessPdf")).alias("item"))
    rec = papers.from_scholar(i)
    c = papers.card(rec)
    return c.select("title", "authors", "abstract", F.array_join("tags", "|").alias("tags"), "action_key")


# ---- sections ----


def _outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Simulated task results: labels say what fails."""
    labels = table(spark, d, "labels")
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(k).alias("k")) for k, n in enumerate(sections.NAMES)])
    each = labels.select("doc_id", "quality", "toxic", F.inline(names))
    kind = (F.col("doc_id") * 7 + F.col("k") * F.col("quality")) % 5
    error = F.when((kind == 0) | ((F.col("quality") == 0) & (F.col("doc_id") % 2 == 0)), F.concat(F.lit("HTTP 50"), F.col("k").cast("string")))
    reply = F.when(kind == 1, " ").otherwise(F.concat(F.col("name"), F.lit(" text")))
    enabled = ~((F.col("name") == "evaluation") & (F.col("toxic") == 1))
    return each.select("doc_id", "name", sections.outcome(enabled, reply, error).alias("section"))


_OUTCOMES = """each AS (
  SELECT doc_id, quality, toxic, name, k, (doc_id * 7 + k * quality) % 5 AS kind FROM labels, (VALUES ('summary',0),('quotes',1),('mindmap',2),('mermaid',3),('evaluation',4)) n(name, k)
), outcomes AS (
  SELECT doc_id, name, CASE WHEN name = 'evaluation' AND toxic = 1 THEN 'disabled' WHEN kind = 0 OR (quality = 0 AND doc_id % 2 = 0) THEN 'failed' WHEN kind = 1 THEN 'empty' ELSE 'success' END AS status, k FROM each
), full_ AS (
  SELECT doc_id, name, status, CASE WHEN status = 'success' THEN name || ' text' ELSE '' END AS content, CASE WHEN status = 'failed' THEN 'HTTP 50' || k ELSE '' END AS error, status = 'failed' AND k IN (2, 3, 4) AS retryable FROM outcomes)"""


def section_status(spark, d):
    return _outcomes(spark, d).select("doc_id", "name", "section.status", "section.content", "section.error", "section.retryable")


def section_pivot(spark, d):
    return sections.results(_outcomes(spark, d)).select("doc_id", *sections.NAMES)


def all_failed_rule(spark, d):
    return sections.results(_outcomes(spark, d)).where("error IS NOT NULL").select("doc_id", "error")


def offline_summary(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return sections.summaries(docs, OfflineProvider()).select("doc_id", "reply", "error")


def offline_quotes(spark, d):
    prompts = sections.window_prompts(table(spark, d, "documents"), ["quotes"])
    return answered(prompts, OfflineProvider()).select("doc_id", "reply", "error")


def analyse_documents(spark, d):
    out = pipelines.analyse(table(spark, d, "documents").select("doc_id", "text"), OfflineProvider(), mermaid=True)
    return out.select("doc_id", "char_count", *sections.NAMES, "error")


# ---- sessions ----


def _writes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("session_id"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"), "event_type", "value")


def session_ttl_windows(spark, d):
    return sessions.lifetimes(_writes(spark, d), "session_id", "updated_at").select("session_id", "first_write", "last_write", "expires_at", "n_writes")


def session_window_counts(spark, d):
    w = streams.session_windows(_writes(spark, d).withColumn("updated_at", F.col("updated_at").cast("timestamp")), "session_id", "updated_at")
    return w.groupBy("session_id").agg(F.count(F.lit(1)).alias("lives"), F.sum("n_writes").alias("writes"))


def latest_session(spark, d):
    return sessions.latest(_writes(spark, d)).select("session_id", "updated_at", "event_type", "value")


def expired_sessions(spark, d):
    newest = sessions.latest(_writes(spark, d)).withColumn("expires_at", F.when(F.col("session_id") % 7 > 0, sessions.expiry(F.col("updated_at"))))
    now = table(spark, d, "events").agg(F.max("ts")).scalar()
    return sessions.alive(newest, now).select("session_id", "updated_at")


def session_lookup_missing(spark, d):
    known = table(spark, d, "events").select(F.col("user_id").cast("string").alias("session_id")).distinct().withColumn("token_hash", F.sha2(F.concat(F.lit("t"), "session_id"), 256))
    c = table(spark, d, "customer")
    token = F.when(F.col("c_custkey") % 3 == 0, "bad").otherwise(F.concat(F.lit("t"), F.col("c_custkey").cast("string")))
    asked = c.select(F.col("c_custkey").alias("request_id"), F.when(F.col("c_custkey") % 11 > 0, F.col("c_custkey").cast("string")).alias("session_id"), token.alias("token"))
    return sessions.validated(asked, known).select("request_id", "error")


def token_check(spark, d):
    c = table(spark, d, "conversations")
    token = F.when(F.col("turn") % 4 == 0, "").when(F.col("turn") % 4 == 1, F.lit(None)).otherwise(F.col("text"))
    return c.select("conv_id", "turn", sessions.token_matches(F.sha2(F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise("x"), 256), token).alias("valid"))


# ---- events ----


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("request_id"), F.when(F.col("event_id") % 5 == 0, 1).otherwise(2).alias("attempt"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"))


def delta_accumulate(spark, d):
    done = table(spark, d, "events").select(F.col("user_id").alias("request_id")).distinct().withColumn("answer", F.when(F.col("request_id") % 4 == 0, "final").otherwise(""))
    return streams.completed(_deltas(spark, d), done)


def completion_order(spark, d):
    e = table(spark, d, "events")
    by = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = e.withColumn("seq", F.row_number().over(by))
    return streams.protocol(rows.select(F.col("user_id").alias("request_id"), "seq", F.col("event_type").alias("event"), F.col("props").alias("payload"))).select("request_id", "seq", "frame")


def latest_requests(spark, d):
    return streams.latest_request(table(spark, d, "events").select(F.col("user_id").alias("client_id"), F.col("event_id").alias("request_id")))


def stream_sections(spark, d):
    """The batch twin of the streamed analysis; a test holds the stream against it."""
    out = streams.section_events(table(spark, d, "documents").select("doc_id", "text"), OfflineProvider())
    return out.select("doc_id", "seq", "name", "section.status", F.sha2("section.content", 256).alias("content"), "char_count")


QUERIES = {f.__name__: f for f in [
    history_block, history_block_tight, prompt_build, session_markdown, report_markdown, turn_numbers, dedup_titles, search_union_limit, paper_cards, section_status,
    section_pivot, all_failed_rule, offline_summary, offline_quotes, analyse_documents, session_ttl_windows, session_window_counts, latest_session, expired_sessions,
    session_lookup_missing, token_check, delta_accumulate, completion_order, latest_requests, stream_sections,
]}

_NL = "chr(10)"
_QA = """qa AS (SELECT session_id, string_agg('### Q' || n || chr(10)||chr(10) || q || chr(10)||chr(10) || '### A' || n || chr(10)||chr(10) || a || chr(10), chr(10) ORDER BY n) AS qa FROM (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY turn) AS n, coalesce(nullif(question, ''), '_No question text._') AS q, coalesce(nullif(answer, ''), '_No answer text._') AS a FROM turns) GROUP BY session_id)"""
_GAPS = """gaps AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 24 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
lives AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS life FROM gaps)"""


def _sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.。!?])\s+', '\1' || chr(1), 'g')"
    return rf"list_filter(list_transform(string_split_regex({marked}, '\x01|\n+'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def _points(s: str) -> str:
    return f"coalesce(array_to_string(list_transform({s}[1:3], lambda x: '- ' || x), chr(10)), '')"


#: What the offline provider replies, as tables over docs (doc_id, t) and chunks.
_REPLIES = rf"""
, points AS (SELECT doc_id, chunk_idx, {_points(_sentences('text'))} AS p FROM chunks),
joined AS (SELECT doc_id, count(*) FILTER (p <> '') AS n, coalesce(string_agg(p, chr(10)||chr(10)||'--- part ---'||chr(10)||chr(10) ORDER BY chunk_idx) FILTER (p <> ''), '') AS p FROM points GROUP BY doc_id),
summary AS (SELECT doc_id, CASE WHEN n = 0 THEN 'no summary could be made' WHEN n = 1 THEN p ELSE {_points(_sentences('p'))} END AS reply FROM joined),
found AS (SELECT doc_id, {_sentences('left(t, 15000)')} AS q, {_sentences('left(t, 10000)')} AS m, {_sentences('left(t, 4000)')} AS d FROM docs),
picked AS (SELECT doc_id, q, list_sort(list_transform(list_sort(list_transform(range(1, len(q) + 1), lambda i: {{'l': -length(q[i]), 'i': i}}))[1:3], lambda x: x.i)) AS k FROM found),
quotes AS (SELECT doc_id, coalesce(array_to_string(list_transform(range(1, len(k) + 1), lambda j: j || '. "' || q[k[j]] || '"'), chr(10)), '') AS reply FROM picked),
heads AS (SELECT doc_id, list_transform(m[1:3], lambda x: array_to_string(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')[1:6], ' ')) AS h,
  list_transform(d[1:3], lambda x: coalesce(nullif(regexp_replace(array_to_string(list_filter(string_split_regex(x, '\s+'), lambda w: w <> '')[1:6], ' '), '[^\p{{L}}\p{{N}}_ ]', '', 'g'), ''), 'part')) AS g FROM found),
mindmap AS (SELECT doc_id, coalesce(array_to_string(list_transform(range(1, len(h) + 1), lambda j: CASE WHEN j = 1 THEN h[j] ELSE '  - ' || h[j] END), chr(10)), '') AS reply FROM heads),
mermaid AS (SELECT doc_id, CASE WHEN len(g) > 0 THEN 'graph TD' || chr(10) || array_to_string(list_transform(range(1, len(g) + 1), lambda j: CASE WHEN j = 1 THEN '    A[' || g[j] || ']' ELSE '    A --> B' || (j - 1) || '[' || g[j] || ']' END), chr(10)) ELSE '' END AS reply FROM heads)
"""
_CLEAN = windows_sql(cleaned_sql("coalesce(text, '')")) + _REPLIES
_RULE = "chr(10)||chr(10)||'---'||chr(10)||chr(10)"

ORACLES = {
    "history_block": _history(8000) + " SELECT session_id, n_turns, sha256(history) AS sha256 FROM blocks",
    "history_block_tight": _history(1500) + " SELECT session_id, n_turns, sha256(history) AS sha256 FROM blocks",
    "prompt_build": _history(1500) + """, p AS (SELECT d.doc_id AS session_id, 'Document (excerpt):' || chr(10) || left(text, 12000) || chr(10)||chr(10)
        || coalesce('Recent questions and answers:' || chr(10) || history || chr(10)||chr(10), '') || 'Question:' || chr(10) || 'What of ' || d.doc_id || '?' || chr(10)||chr(10)
        || 'Answer briefly and exactly; for a follow-up keep the thread without repeating long passages.' AS prompt FROM documents d LEFT JOIN blocks ON session_id = doc_id)
        SELECT session_id, sha256(prompt) AS sha256, CAST(length(prompt) AS INTEGER) AS chars FROM p""",
    "session_markdown": f"WITH {_TURNS}, {_QA} " + f"""SELECT doc_id AS session_id, sha256('# Session report'||{_NL}||{_NL}||'## Session'||{_NL}||{_NL}||'| Item | Value |'||{_NL}||'| --- | --- |'||{_NL}||'| Source file | '||source||' |'||{_NL}||'| Session ID | '||doc_id||' |'||{_NL}||'| Character count | '||n_chars||' |'
        ||{_RULE}||'## Overview'||{_NL}||{_NL}||coalesce(nullif(text, ''), '_No summary generated._')||{_RULE}||'## Citations'||{_NL}||{_NL}||'_No citations generated._'||{_RULE}||'## Structure'||{_NL}||{_NL}||CASE WHEN doc_id % 2 = 0 THEN 'tree' ELSE '_No structure generated._' END
        ||CASE WHEN doc_id % 3 = 0 THEN {_RULE}||'## Diagram'||{_NL}||{_NL}||'```mermaid'||{_NL}||'graph TD'||{_NL}||'```' ELSE '' END||coalesce({_RULE}||'## Questions'||{_NL}||{_NL}||qa, '')) AS sha256 FROM documents LEFT JOIN qa ON session_id = doc_id""",
    "report_markdown": f"""SELECT doc_id, sha256('# Analysis report'||{_NL}||{_NL}||'> Generated: 2024-05-06 07:08:09'||{_NL}||'> Source: '||source||{_NL}||'> Elapsed: 1.5s'||{_RULE}||'## Summary'||{_NL}||{_NL}||coalesce(text, '')||{_RULE}||'## Quotes'||{_NL}||{_NL}||lang||{_RULE}||'## Structure'||{_NL}||{_NL}||'m'||{_RULE}
        ||'## Evaluation'||{_NL}||{_NL}||'e'||{_NL}||{_NL}||'---'||{_NL}||'## About'||{_NL}||{_NL}||'- Version: 1'||{_NL}||'- Characters: '||n_chars||{_NL}) AS sha256 FROM documents""",
    "turn_numbers": f"WITH {_TURNS}, {_QA} SELECT session_id, CAST(length(qa) AS INTEGER) AS chars FROM qa",
    "dedup_titles": f"WITH {_RECORDS} SELECT src_ord, pos, title FROM keyed WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY src_ord, pos) = 1",
    "search_union_limit": f"""WITH {_RECORDS}, top AS (SELECT range AS query_id, CASE WHEN range BETWEEN 1 AND 9 THEN range ELSE 8 END AS top FROM range(20)),
        cut AS (SELECT keyed.*, top FROM keyed JOIN top USING (query_id) QUALIFY row_number() OVER (PARTITION BY query_id, src_ord ORDER BY pos) <= top),
        one AS (SELECT * FROM cut WHERE k <> '' QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY src_ord, pos) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src_ord, pos) AS rank FROM one)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, src_ord, pos, title FROM ranked WHERE rank <= top""",
    "paper_cards": f"""SELECT coalesce(nullif({_compact('text', 300)}, ''), 'Untitled') AS title, lang AS authors, 'No abstract' AS abstract,
        'Semantic Scholar|' || (1990 + doc_id % 40) || '|' || CASE WHEN doc_id % 2 = 0 THEN 'Venue' ELSE 'Semantic Scholar' END AS tags, source AS action_key FROM documents""",
    "section_status": f"WITH {_OUTCOMES} SELECT * FROM full_",
    "section_pivot": f"WITH {_OUTCOMES} SELECT doc_id, " + ", ".join(f"max(content) FILTER (name = '{n}') AS {n}" for n in sections.NAMES) + " FROM full_ GROUP BY doc_id",
    "all_failed_rule": f"WITH {_OUTCOMES} SELECT doc_id, min(error) FILTER (name = 'summary') AS error FROM full_ GROUP BY doc_id HAVING count(*) FILTER (status = 'failed' AND name IN ('summary','quotes','mindmap')) = 3",
    "offline_summary": windows_sql() + _REPLIES + "SELECT doc_id, reply, CAST(NULL AS VARCHAR) AS error FROM summary",
    "offline_quotes": windows_sql("text") + _REPLIES + "SELECT doc_id, reply, CAST(NULL AS VARCHAR) AS error FROM quotes",
    "analyse_documents": _CLEAN + """SELECT docs.doc_id, CAST(n AS INTEGER) AS char_count, summary.reply AS summary, quotes.reply AS quotes, mindmap.reply AS mindmap, mermaid.reply AS mermaid,
        '' AS evaluation, CAST(NULL AS VARCHAR) AS error FROM docs JOIN summary USING (doc_id) JOIN quotes USING (doc_id) JOIN mindmap USING (doc_id) JOIN mermaid USING (doc_id)""",
    "stream_sections": _CLEAN + """, events AS (
        SELECT doc_id, 1 AS seq, 'summary' AS name, reply FROM summary UNION ALL SELECT doc_id, 2, 'quotes', reply FROM quotes UNION ALL SELECT doc_id, 3, 'mindmap', reply FROM mindmap)
        SELECT doc_id, seq, name, CASE WHEN reply = '' THEN 'empty' ELSE 'success' END AS status, sha256(reply) AS content, CAST(NULL AS INTEGER) AS char_count FROM events
        UNION ALL SELECT doc_id, 4, 'mermaid', 'disabled', sha256(''), NULL FROM docs UNION ALL SELECT doc_id, 5, 'evaluation', 'disabled', sha256(''), NULL FROM docs
        UNION ALL SELECT doc_id, 6, 'done', NULL, NULL, CAST(n AS INTEGER) FROM docs""",
    "session_ttl_windows": f"WITH {_GAPS} SELECT user_id AS session_id, min(ts) AS first_write, max(ts) AS last_write, max(ts) + INTERVAL 24 HOUR AS expires_at, count(*) AS n_writes FROM lives GROUP BY user_id, life",
    "session_window_counts": f"WITH {_GAPS} SELECT user_id AS session_id, count(DISTINCT life) AS lives, count(*) AS writes FROM lives GROUP BY user_id",
    "latest_session": "SELECT user_id AS session_id, ts AS updated_at, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1",
    "expired_sessions": """WITH newest AS (SELECT user_id AS session_id, ts AS updated_at FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
        SELECT session_id, updated_at FROM newest WHERE session_id % 7 = 0 OR date_trunc('second', updated_at) + INTERVAL 24 HOUR >= (SELECT max(ts) FROM events)""",
    "session_lookup_missing": """SELECT c_custkey AS request_id, CASE WHEN c_custkey % 11 = 0 THEN 'session id required' WHEN c_custkey NOT IN (SELECT user_id FROM events) THEN 'session not found' WHEN c_custkey % 3 = 0 THEN 'session token invalid' END AS error FROM customer""",
    "token_check": "SELECT conv_id, turn, turn % 4 = 2 AND text <> '' OR turn % 4 = 3 AND text = 'x' AS valid FROM conversations",
    "delta_accumulate": """WITH d AS (SELECT user_id, CASE WHEN event_id % 5 = 0 THEN 1 ELSE 2 END AS attempt, event_id, event_type AS text FROM events),
        n AS (SELECT * FROM d QUALIFY attempt = max(attempt) OVER (PARTITION BY user_id))
        SELECT user_id AS request_id, CASE WHEN user_id % 4 = 0 THEN 'final' ELSE string_agg(text, '' ORDER BY event_id) END AS answer FROM n GROUP BY user_id""",
    "completion_order": """SELECT user_id AS request_id, CAST(seq AS INTEGER) AS seq, 'event: ' || event_type || chr(10) || 'data: ' || coalesce(props, '{}') || chr(10) || chr(10) AS frame
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events)""",
    "latest_requests": "SELECT user_id AS client_id, max(event_id) AS request_id FROM events GROUP BY user_id",
}
