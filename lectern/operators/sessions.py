"""Analysis sessions as an append-only log: the latest version counts, and each write extends its life."""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import EXCERPT, excerpt, filled
from lectern.functions.urls import secure_name

TTL_SECONDS = 86400
PAPER = "struct<source:string,paper_id:string,title:string,abstract:string,authors:array<string>,year:string,venue:string,url:string,pdf_url:string>"
SECTION = "struct<status:string,content:string,error:string,retryable:boolean>"
SESSION_SCHEMA = (
    "session_id string, source_filename string, generated_at timestamp_ntz, created_at timestamp_ntz, updated_at timestamp_ntz,"
    " expires_at timestamp_ntz, document_content string, document_excerpt string,"
    " qa_history array<struct<question:string,answer:string,timestamp:string>>,"
    f" paper_search struct<last_query:string,last_results:array<{PAPER}>,last_recommendation:struct<original_query:string,query:string,"
    f"topics:array<string>,reason:string,rewrite_model:string,items:array<{PAPER}>,errors:array<string>,generated_at:string>>,"
    " session_auth struct<token_hash:string>,"
    f" analysis struct<summary:string,quotes:string,mindmap:string,mermaid:string,evaluation:string,sections:map<string,{SECTION}>,"
    "char_count:int,elapsed_seconds:double,output_file:string>"
)


def parsed_time(c: Column) -> Column:
    """ISO text as time without zone; what doesn't parse is null."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def expiry(written: Column, ttl: int = TTL_SECONDS) -> Column:
    """Seconds are whole, as they are stored."""
    return F.date_trunc("second", written).cast("timestamp_ntz") + F.make_dt_interval(secs=F.lit(ttl))


def new_token() -> str:
    return secrets.token_urlsafe(32)


def token_hash(token: Column) -> Column:
    return F.sha2(token, 256)


def token_matches(stored: Column, token: Column) -> Column:
    """Both given, and the hash equal."""
    return (filled(token) != "") & (filled(stored) != "") & F.coalesce(token_hash(token) == stored, F.lit(False))


def sessions_of(analyses: DataFrame, now: Column, ttl: int = TTL_SECONDS, keep_document: bool = True) -> DataFrame:
    """Fresh sessions: session_id, source_filename, document, token -> the stored fields."""
    return analyses.select(
        "session_id", "source_filename", now.alias("created_at"), now.alias("updated_at"), expiry(now, ttl).alias("expires_at"),
        F.when(F.lit(keep_document), F.col("document")).otherwise("").alias("document_content"),
        excerpt(F.col("document")).alias("document_excerpt"), F.struct(token_hash(F.col("token")).alias("token_hash")).alias("session_auth"),
    )


def latest(log: DataFrame, key: str = "session_id", at: str = "updated_at", seq: str = "seq") -> DataFrame:
    """The newest version per key; ``seq`` decides within a second. One aggregation, combined before the shuffle."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(at, seq)).alias("v")).select(key, *[f"v.{c}" for c in rest])


def alive(sessions: DataFrame, now: Column) -> DataFrame:
    """Expired is strictly past; a session without a readable expiry never is."""
    return sessions.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))


def cleanup_due(last_run: Column, now: Column, interval: int = 600, force: bool = False) -> Column:
    return F.lit(force) | last_run.isNull() | (now >= last_run + F.make_dt_interval(secs=F.lit(interval)))


def _member(column: str, field: str, kind: str, sessions: DataFrame) -> Column:
    """A field of a struct column that may lack it, or be missing itself."""
    have = column in sessions.columns and field in sessions.schema[column].dataType.names
    return (F.col(column)[field] if have else F.lit(None)).cast(kind)


def with_defaults(sessions: DataFrame, now: Column, ttl: int = TTL_SECONDS) -> DataFrame:
    """All fields of SESSION_SCHEMA; those that older versions lack are filled in on reading: empty texts,
    lists and structs, the excerpt from the content, times from ``generated_at`` or ``now``, a full life."""
    schema = T.StructType.fromDDL(SESSION_SCHEMA)
    held = {f.name: (F.col(f.name) if f.name in sessions.columns else F.lit(None)).cast(f.dataType) for f in schema.fields}
    made = F.coalesce(held["generated_at"], now)
    content = filled(held["document_content"])

    def struct(name: str, empty: dict[str, Column]) -> Column:
        kinds = {f.name: f.dataType.simpleString() for f in schema[name].dataType.fields}
        return F.struct(*[F.coalesce(_member(name, k, kind, sessions), empty[k].cast(kind)).alias(k) if k in empty else _member(name, k, kind, sessions).alias(k) for k, kind in kinds.items()])

    filled_in = {
        "session_id": filled(held["session_id"]), "source_filename": filled(held["source_filename"]), "generated_at": made,
        "created_at": F.coalesce(held["created_at"], made), "updated_at": F.coalesce(held["updated_at"], made), "expires_at": F.coalesce(held["expires_at"], expiry(now, ttl)),
        "document_content": content, "document_excerpt": F.coalesce(held["document_excerpt"], F.left(content, F.lit(EXCERPT))),
        "qa_history": F.coalesce(held["qa_history"], F.array().cast(schema["qa_history"].dataType)),
        "paper_search": struct("paper_search", {"last_query": F.lit(""), "last_results": F.array()}),
        "session_auth": struct("session_auth", {"token_hash": F.lit("")}), "analysis": struct("analysis", {"sections": F.create_map()}),
    }
    rest = [c for c in sessions.columns if c not in filled_in]
    return sessions.select(*[c.alias(k) for k, c in filled_in.items()], *rest)


def with_last_search(sessions: DataFrame, items: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Sessions with their last search kept: items (query_id, rank and the fields of a paper) and outcomes
    (query_id, query), where query_id is the session's. Sessions that didn't search stay as they are.
    The results of a query are bounded by the limit, so a session's fit one row."""
    kind = T.DataType.fromDDL(f"array<{PAPER}>")
    paper = F.struct(*[F.col(f.name) for f in kind.elementType.fields])
    results = items.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", paper.alias("p")))), lambda x: x["p"]).alias("found"))
    last = outcomes.select("query_id", F.col("query").alias("asked")).join(results, "query_id", "left")
    joined = sessions.join(last, sessions["session_id"] == last["query_id"], "left")
    kept = F.col("paper_search").withField("last_query", F.col("asked")).withField("last_results", F.coalesce("found", F.array().cast(kind)))
    return joined.withColumn("paper_search", F.when(F.col("asked").isNotNull(), kept).otherwise(F.col("paper_search"))).select(*sessions.columns)


def with_last_recommendation(sessions: DataFrame, items: DataFrame, outcomes: DataFrame, now: Column, model: str = "") -> DataFrame:
    """Sessions with their last recommendation kept, from ``pipelines.recommended``."""
    kind = T.DataType.fromDDL(f"array<{PAPER}>")
    paper = F.struct(*[F.col(f.name) for f in kind.elementType.fields])
    results = items.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", paper.alias("p")))), lambda x: x["p"]).alias("found"))
    last = outcomes.where("query IS NOT NULL").join(results, "query_id", "left").select(
        "query_id",
        F.struct(
            F.lit("").alias("original_query"), F.col("query").alias("query"), F.coalesce("topics", F.array().cast("array<string>")).alias("topics"), filled(F.col("reason")).alias("reason"),
            F.lit(model).alias("rewrite_model"), F.coalesce("found", F.array().cast(kind)).alias("items"), F.col("errors").alias("errors"), now.cast("string").alias("generated_at"),
        ).alias("made"),
    )
    joined = sessions.join(last, sessions["session_id"] == last["query_id"], "left")
    kept = F.col("paper_search").withField("last_recommendation", F.col("made"))
    return joined.withColumn("paper_search", F.when(F.col("made").isNotNull(), kept).otherwise(F.col("paper_search"))).select(*sessions.columns)


def session_text(content: Column, short: Column) -> Column:
    return F.coalesce(F.nullif(content, F.lit("")), short, F.lit(""))


def validated(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """Requests (request_id, session_id, token) with ``error``: no id, no such session, wrong token, or null."""
    asked = requests.withColumn("session_id", secure_name(F.col("session_id")))
    found = sessions.select("session_id", F.col("token_hash").alias("stored"), F.lit(True).alias("known"))
    joined = asked.join(found, "session_id", "left")
    error = (
        F.when(filled(F.col("session_id")) == "", "session id required")
        .when(F.col("known").isNull(), "session not found")
        .when(~token_matches(F.col("stored"), F.col("token")), "session token invalid")
    )
    return joined.select("request_id", "session_id", error.alias("error"))


def lifetimes(writes: DataFrame, key: str, at: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """Each stretch of a session's life: (key, first_write, last_write, expires_at, n_writes). A write
    at the very moment of expiry still extends it."""
    times = W.partitionBy(key).orderBy(at)
    gap = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.lag(at).over(times).cast("timestamp"))
    marked = writes.withColumn("fresh", F.coalesce((gap > ttl * 1_000_000).cast("int"), F.lit(1)))
    lives = marked.withColumn("life", F.sum("fresh").over(times.rowsBetween(W.unboundedPreceding, 0)))
    return lives.groupBy(key, "life").agg(
        F.min(at).alias("first_write"), F.max(at).alias("last_write"), (F.max(at) + F.make_dt_interval(secs=F.lit(ttl))).alias("expires_at"),
        F.count(F.lit(1)).alias("n_writes"),
    )


def appended_turns(log: DataFrame, new: DataFrame) -> DataFrame:
    """Turns (session_id, question, answer, ts) numbered after those a session has; failed ones don't come here."""
    last = log.groupBy("session_id").agg(F.max("turn").alias("last"))
    order = W.partitionBy("session_id").orderBy("ts", "question")
    return new.join(last, "session_id", "left").withColumn("turn", (F.coalesce("last", F.lit(0)) + F.row_number().over(order)).cast("long")).drop("last")
