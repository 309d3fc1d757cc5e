"""Whole flows: analyse documents, answer questions, search, recommend, import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import __version__
from lectern.config import Settings
from lectern.functions.render import analysis_report
from lectern.functions.text import cleaned, compacted, excerpt, filled, json_object, window
from lectern.operators.chunking import Chunking
from lectern.operators.history import ask_prompts
from lectern.operators.papers import clamped_limit, federated, source_error
from lectern.operators.providers import Provider, concurrency_of, streamed
from lectern.operators.replies import ReplyStore, answered_once
from lectern.operators.sections import analysed, results
from lectern.operators.sessions import session_text, validated
from lectern.streaming.events import section_events

REWRITE = "struct<original_query:string,rewritten_query:string,topics:array<string>,why:string>"
REWRITE_TASK = (
    "Rewrite this literature search as a concise English query. Resolve nicknames of known papers to their titles; "
    "widen only what is unclear. Answer with a JSON object of original_query, rewritten_query, topics and why.\n\nQuery:\n"
)


def analyse(docs: DataFrame, provider: Provider, settings: Settings = Settings(), mermaid: bool = False, evaluation: bool = False) -> DataFrame:
    """Per document: sections, char_count, elapsed_seconds (null where calls are spread), error. Tasks that are off cost nothing; a metered provider is
    called so often at once as the settings say. One pass over the texts: all prompts of a document
    follow each other in its partition, and only replies are shuffled. With a metered provider chunks and
    windows are spread over its open calls instead, and joined again."""
    how = Chunking(settings.chunk_size, settings.overlap)
    open_calls = concurrency_of(provider, settings.max_concurrency)
    clean = docs.withColumn("text", cleaned(F.col("text")))
    if open_calls is not None:
        wide = results(analysed(clean, provider, mermaid, evaluation, how, concurrency=open_calls))
        counts = clean.select("doc_id", F.length("text").alias("char_count"), F.lit(None).cast("double").alias("elapsed_seconds"))
        return counts.join(wide, "doc_id")
    return results(section_events(docs, provider, mermaid, evaluation, how), char_count=F.max("char_count"), elapsed_seconds=F.max("elapsed_seconds"))


def reports(analyses: DataFrame, generated_at: Column, evaluation: bool = False) -> DataFrame:
    """(doc_id, markdown) of the analyses that succeeded."""
    good = analyses.where("error IS NULL")
    return good.select("doc_id", analysis_report(good, __version__, generated_at, evaluation, good["elapsed_seconds"] if "elapsed_seconds" in good.columns else None).alias("markdown"))


def _asked(requests: DataFrame, sessions: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests that may not ask (request_id, answer, error), and the prompts of the others."""
    checked = validated(requests, sessions).where("error IS NOT NULL").select("request_id", F.lit(None).cast("string").alias("answer"), "error")
    passed = requests.join(checked.select("request_id"), "request_id", "left_anti")
    return checked, ask_prompts(passed, sessions.select("session_id", "document"), turns)


def ask_stream(requests: DataFrame, sessions: DataFrame, turns: DataFrame, provider, settings: Settings = Settings()) -> DataFrame:
    """``ask`` as events (request_id, event, attempt, seq, text): pieces of answers as they come, then
    ``done`` or ``error``; ``streaming.answers_stream`` puts them together."""
    checked, prompts = _asked(requests, sessions, turns)
    refused = checked.select("request_id", F.lit(None).cast("string").alias("prompt"), "error")
    both = refused.unionByName(prompts.select("request_id", "prompt", "error"))
    return streamed(both, provider, settings.max_retries, concurrency_of(provider, settings.max_concurrency))


def ask(requests: DataFrame, sessions: DataFrame, turns: DataFrame, provider: Provider, settings: Settings = Settings(), store: ReplyStore | None = None) -> DataFrame:
    """request_id, answer, error. ``requests``: request_id, session_id, token, question; ``sessions``:
    session_id, token_hash, document. Prompts are asked here, once each, and answers read from ``store``."""
    checked, prompts = _asked(requests, sessions, turns)
    asked = prompts.select("request_id", F.lit("answer").alias("task"), "prompt", F.col("error").alias("refused"))
    replies = answered_once(asked, provider, store or ReplyStore(requests.sparkSession), settings.max_concurrency)
    return checked.unionByName(replies.select("request_id", F.col("reply").alias("answer"), F.coalesce("refused", "error").alias("error")))


def rewrite_prompts(queries: DataFrame) -> DataFrame:
    """query_id, task, prompt, error; a blank query has no prompt. ``queries``: query_id, query, context."""
    q = compacted(F.col("query"), 240)
    prompt = F.concat(F.lit(REWRITE_TASK), q, F.lit("\n\nContext:\n"), window(F.col("context"), "rewrite"))
    return queries.select("query_id", F.lit("rewrite").alias("task"), F.when(q != "", prompt).alias("prompt"), F.when(q == "", "empty query").alias("error"))


def rewritten(replies: DataFrame) -> DataFrame:
    """query_id, query, topics, reason, error from replies (query_id, reply)."""
    r = F.from_json(json_object(F.col("reply")), REWRITE)
    bad = F.btrim(filled(r["rewritten_query"])) == ""
    return replies.select("query_id", F.when(~bad, r["rewritten_query"]).alias("query"), r["topics"].alias("topics"), r["why"].alias("reason"), F.when(bad, "no query in reply").alias("error"))


def search(records: DataFrame, queries: DataFrame) -> DataFrame:
    """Ranked results of (query_id, limit) over the records of all sources."""
    return federated(records, queries)


def recommendation_queries(sessions: DataFrame, query: str = "papers closely related to this document") -> DataFrame:
    """Search requests made from sessions: a fixed query with the document's beginning as its context."""
    return sessions.select(F.col("session_id").alias("query_id"), F.lit(query).alias("query"), excerpt(F.col("document")).alias("context"))


def with_reason(items: DataFrame, meta: DataFrame) -> DataFrame:
    """Each recommended item with its query's shared reason."""
    return items.join(meta.select("query_id", "reason"), "query_id", "left")


def search_errors(replies: DataFrame) -> DataFrame:
    """(query_id, errors): a line for each source that failed. ``replies``: query_id, source, status, reason,
    of the failed calls only."""
    line = source_error(F.col("source"), F.col("status"), F.col("reason"))
    return replies.groupBy("query_id").agg(F.array_sort(F.collect_list(line)).alias("errors"))


def searched(queries: DataFrame, fetch: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(items, outcomes) of ``queries`` (query_id, query, limit). items: ranked records; outcomes: query_id,
    query, errors for every query, blank ones with the error alone and no call. ``fetch`` takes queries
    with clamped limits and gives the records of all sources and their failed calls (as ``search_errors``
    reads them)."""
    clean = queries.select("query_id", compacted(F.col("query"), 240).alias("query"), clamped_limit(F.col("limit")).alias("limit"))
    records, failed = fetch(clean.where("query <> ''"))
    errors = F.when(F.col("query") == "", F.array(F.lit("empty query"))).otherwise(F.coalesce("errors", F.array().cast("array<string>")))
    outcomes = clean.join(search_errors(failed), "query_id", "left").select("query_id", "query", errors.alias("errors"))
    return federated(records, clean.select("query_id", F.col("limit").cast("string").alias("limit"))), outcomes


def recommended(sessions: DataFrame, provider: Provider, fetch: Callable[[DataFrame], tuple[DataFrame, DataFrame]], settings: Settings = Settings(), store: ReplyStore | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, outcomes) per session (session_id, document_content, document_excerpt): its text makes a
    query, a provider rewrites it, the search runs, and each item has the query's reason. outcomes:
    query_id, query, topics, reason, errors; a session without text, or whose rewriting failed, has no items.
    Each session is one call of the provider, made here, whatever is read of the results: replies are in
    ``store`` before any plan reads them, and one that is there already is not asked for again."""
    held = sessions.select("session_id", session_text(F.col("document_content"), F.col("document_excerpt")).alias("document"))
    asked = rewrite_prompts(recommendation_queries(held.where("document <> ''")))
    replies = answered_once(asked.select("query_id", "task", "prompt"), provider, store or ReplyStore(sessions.sparkSession), settings.max_concurrency)
    made = rewritten(replies.select("query_id", "reply")).withColumnRenamed("error", "unread").join(replies.select("query_id", F.col("error").alias("failed")), "query_id")
    good = made.where("failed IS NULL AND unread IS NULL")
    items, found = searched(good.select("query_id", "query", F.lit(settings.recommendation_limit).alias("limit")), fetch)
    meta = made.select("query_id", "query", "topics", "reason", F.coalesce("failed", "unread").alias("error"))
    empty = held.where("document = ''").select(F.col("session_id").alias("query_id"), F.lit("no document").alias("error"))
    whole = meta.unionByName(empty, allowMissingColumns=True).join(found.select("query_id", "errors"), "query_id", "left")
    outcomes = whole.select("query_id", "query", "topics", "reason", F.coalesce(F.array_compact(F.array("error")), F.array().cast("array<string>")).alias("own"), "errors")
    outcomes = outcomes.select("query_id", "query", "topics", "reason", F.concat("own", F.coalesce("errors", F.array().cast("array<string>"))).alias("errors"))
    return with_reason(items, meta.select("query_id", "reason")), outcomes
