"""Analysis and answers as event streams, and their batch twins."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.functions.sse import frame
from lectern.functions.text import cleaned, diagram_source
from lectern.operators.chunking import Chunking
from lectern.operators.providers import Provider
from lectern.operators.sections import NAMES, enabled_tasks, outcome, streamed_replies


def section_events(docs: DataFrame, provider: Provider, mermaid: bool = False, evaluation: bool = False, how: Chunking = Chunking(), start: bool = False) -> DataFrame:
    """(doc_id, seq, name, section, char_count, elapsed_seconds), the events of each document of a stream (or table) in
    the order of ``seq``: with ``start`` that first, numbered 0; its sections as they complete, then those that
    are off, then ``done``, which has the cleaned text's length, the seconds spent and no section; where all
    required sections failed, ``error`` with the first one's error in its place.
    Texts are cleaned, and the summary reads all chunks. Stateless, so it runs on unbounded input."""
    tasks = enabled_tasks(mermaid, evaluation)
    clean = docs.select("doc_id", cleaned(F.col("text")).alias("text"))
    replies = streamed_replies(clean, provider, tasks, how)
    if not start:
        replies = replies.where("name <> 'start'")
    reply = F.when(F.col("name") == "mermaid", diagram_source(F.col("reply"))).otherwise(F.col("reply"))
    off = [n for n in NAMES if n not in tasks]
    error, nothing = F.col("error"), (F.lit(None).cast("int"), F.lit(None).cast("double"))

    def event(seq, name, result, count=nothing[0], spent=nothing[1]):
        return F.struct(seq.cast("int").alias("seq"), name.alias("name"), result.alias("section"), count.alias("char_count"), spent.alias("elapsed_seconds"))

    result = outcome(F.lit(True), reply, error)
    last = F.array(
        *[event(F.col("seq") + k, F.lit(n), outcome(F.lit(False), reply, error)) for k, n in enumerate(off)],
        event(F.col("seq") + len(off), F.when(error.isNull(), "done").otherwise("error"), F.when(error.isNotNull(), result), F.col("char_count"), F.round("elapsed", 1)),
    )
    one = F.array(event(F.col("seq"), F.col("name"), F.when(F.col("name") != "start", result)))
    return replies.select("doc_id", F.inline(F.when(F.col("name") == "done", last).otherwise(one)))


def analysis_protocol(docs: DataFrame, provider: Provider, mermaid: bool = False, evaluation: bool = False, how: Chunking = Chunking()) -> DataFrame:
    """(doc_id, seq, event, payload) of each document of a stream or table, as clients read them: start,
    section, ..., then done or error. Payloads are JSON: the document, a section with its name, the length, the
    error."""
    rows = section_events(docs, provider, mermaid, evaluation, how, start=True)
    name, known = F.col("name"), F.col("name").isin(*NAMES)
    payload = (
        F.when(name == "start", F.to_json(F.struct("doc_id"))).when(known, F.to_json(F.struct("name", "section")))
        .when(name == "error", F.to_json(F.struct(F.col("section.error").alias("error")))).otherwise(F.to_json(F.struct("doc_id", "char_count")))
    )
    return rows.select("doc_id", "seq", F.when(known, "section").otherwise(name).alias("event"), payload.alias("payload"))


def run_available(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Process what is there once, by batches, resuming from the checkpoint."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def protocol(events: DataFrame, key: str = "request_id") -> DataFrame:
    """Adds ``frame``, the text of each (event, payload) row, in the form clients read."""
    return events.withColumn("frame", frame(F.col("event"), F.col("payload")))


def completed(deltas: DataFrame, finals: DataFrame) -> DataFrame:
    """(request_id, answer): pieces of the last attempt in order, unless the final event has a text.
    A retried attempt restarts its answer, so earlier attempts' pieces don't count."""
    last = F.max("attempt")
    per = deltas.groupBy("request_id", "attempt").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    newest = per.groupBy("request_id").agg(F.max_by("parts", "attempt").alias("parts"), last.alias("attempt"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    joined = newest.select("request_id", text.alias("built")).join(finals, "request_id", "full")
    return joined.select("request_id", F.coalesce(F.nullif("answer", F.lit("")), "built", F.lit("")).alias("answer"))


_STATE = "parts array<struct<attempt:int,seq:int,text:string>>, newest long"


#: Silence after which an open request is forgotten, in milliseconds.
SILENCE = 3_600_000


def _gather(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    held = [tuple(p) for p in state.get[0]] if state.exists else []
    done, newest = None, state.get[1] if state.exists else 0
    for f in frames:
        newest = max(newest, int(f["at"].max().timestamp() * 1000))
        for r in f.itertuples():
            if r.event == "delta":
                held.append((int(r.attempt), int(r.seq), r.text))
            elif r.event in ("done", "error"):
                done = r
    if done is None:
        state.update((held, newest))
        state.setTimeoutTimestamp(max(newest + SILENCE, state.getCurrentWatermarkMs() + 1))
        return
    if state.exists:
        state.remove()
    last = max((p[0] for p in held), default=0)
    built = "".join(t for _, _, t in sorted(p for p in held if p[0] == last))
    failed = done.event == "error"
    yield pd.DataFrame({"request_id": [key[0]], "status": [done.event], "answer": [None if failed else (done.text or built)]})


def answers_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """request_id, status, answer once a request's ``done`` or ``error`` arrives. ``events``:
    request_id, event, attempt, seq, text, at. State per open request; by the events' own time ``at``, an
    hour's silence drops it."""
    return events.withWatermark("at", late).groupBy("request_id").applyInPandasWithState(
        _gather, "request_id long, status string, answer string", _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )


def latest_request(requests: DataFrame, key: str = "client_id") -> DataFrame:
    """A newer request of a client supersedes its older ones."""
    return requests.groupBy(key).agg(F.max("request_id").alias("request_id"))


def session_windows(writes: DataFrame, key: str, at: str, ttl: str = "24 hours", late: str | None = None) -> DataFrame:
    """Lives of sessions by writes, batch or stream; a stream needs ``late``, how long it waits."""
    if late is not None:
        writes = writes.withWatermark(at, late)
    return writes.groupBy(key, F.session_window(at, ttl).alias("life")).agg(F.count(F.lit(1)).alias("n_writes"))
