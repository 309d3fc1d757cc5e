"""Analysis sections: tasks per document, their prompts, results, and the result table."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import WINDOWS, diagram_source, filled, is_retryable, window
from lectern.operators.batches import pieces
from lectern.operators.chunking import Chunking, chunk_arrays, chunks
from lectern.operators.providers import Provider, answered, reply_or_error

NAMES = ("summary", "quotes", "mindmap", "mermaid", "evaluation")
REQUIRED = ("summary", "quotes", "mindmap")
OPTIONAL = ("mermaid", "evaluation")
MERGE_RULE = "\n\n--- part ---\n\n"
NO_SUMMARY = "no summary could be made"


def section(status: Column, content: Column | None = None, error: Column | None = None, retryable: Column | None = None) -> Column:
    return F.struct(
        status.alias("status"), filled(content if content is not None else F.lit("")).alias("content"),
        filled(error if error is not None else F.lit("")).alias("error"),
        F.coalesce(retryable if retryable is not None else F.lit(False), F.lit(False)).alias("retryable"),
    )


def outcome(enabled: Column, reply: Column, error: Column) -> Column:
    """disabled, failed (retryable or not), empty, or success."""
    return (
        F.when(~enabled, section(F.lit("disabled")))
        .when(error.isNotNull(), section(F.lit("failed"), error=error, retryable=is_retryable(error)))
        .when(F.btrim(filled(reply)) == "", section(F.lit("empty")))
        .otherwise(section(F.lit("success"), reply))
    )


def enabled_tasks(mermaid: bool, evaluation: bool) -> list[str]:
    return [*REQUIRED, *(["mermaid"] if mermaid else []), *(["evaluation"] if evaluation else [])]


def window_prompts(docs: DataFrame, tasks: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document and windowed task; the text is cut before it leaves the JVM."""
    cuts = F.array(*[F.struct(F.lit(t).alias("task"), window(F.col(text), t).alias("prompt")) for t in tasks if t in WINDOWS])
    return docs.select(key, F.inline(cuts))


def summaries(docs: DataFrame, provider: Provider, how: Chunking = Chunking(), key: str = "doc_id", concurrency: int | None = None) -> DataFrame:
    """(key, reply, error): chunk summaries, merged in order by a second call where there is more than
    one. A failed chunk fails its document."""
    parts = chunks(docs, how, key=key).select(key, "chunk_idx", F.lit("summary").alias("task"), F.col("text").alias("prompt"))
    mapped = answered(parts, provider, concurrency)
    ordered = F.array_sort(F.collect_list(F.when(filled(F.col("reply")) != "", F.struct("chunk_idx", "reply"))))
    gathered = mapped.groupBy(key).agg(F.transform(ordered, lambda x: x["reply"]).alias("parts"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("chunk_idx"))).alias("error"))
    joined = gathered.withColumn("prompt", F.when((F.size("parts") > 1) & F.col("error").isNull(), F.array_join("parts", MERGE_RULE)))
    merged = answered(joined.select(key, F.lit("summary").alias("task"), "prompt", "parts", F.col("error").alias("failed")), provider, concurrency)
    reply = F.when(F.size("parts") > 1, F.col("reply")).when(F.size("parts") == 1, F.get("parts", F.lit(0))).otherwise(F.lit(NO_SUMMARY))
    return merged.select(key, reply.alias("reply"), F.coalesce("failed", "error").alias("error"))


STREAMED = "seq int, name string, reply string, error string, char_count int, elapsed double"


def streamed_replies(docs: DataFrame, provider: Provider, tasks: list[str], how: Chunking = Chunking(), key: str = "doc_id") -> DataFrame:
    """(key, seq, name, reply, error, char_count, elapsed): a row ``start`` numbered 0, one for each task of each
    document as they complete, then a row ``done``, which alone has the text's length, the seconds since the
    start, and as its error the first one if all required tasks failed; without a shuffle or state, so of streams too. The prompts of a document follow each other in its
    partition: its chunks first, whose merge is asked when the last is answered, then the windows."""
    one = lambda task, prompt: F.struct(F.lit(task).alias("task"), prompt.alias("prompt"))
    asked = F.concat(
        F.transform("chunks", lambda c: one("summary", c["raw"])),
        F.array(*[one(t, window(F.col("t"), t)) for t in tasks if t in WINDOWS], one("done", F.length("t").cast("string"))),
    )
    rows = chunk_arrays(docs, how, key=key).select(key, F.posexplode_outer(asked).alias("at", "p")).select(key, "at", "p.task", "p.prompt")

    def merged(replies: list[str], error: str | None) -> tuple[str | None, str | None]:
        if error is not None or len(replies) < 2:
            return None if error is not None else (replies or [NO_SUMMARY])[0], error
        return reply_or_error(provider, "summary", MERGE_RULE.join(replies))

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replies, error, seq, begun, failures = [], None, 0, 0.0, {}
        for part in pieces(batches):
            done = []

            def note(k, name: str, reply: str | None, error: str | None) -> None:
                failures[name] = error
                done.append((k, seq, name, reply, error, None, None))

            for k, at, task, prompt in zip(*(part.column(c).to_pylist() for c in (key, "at", "task", "prompt"))):
                if at == 0:
                    replies, error, seq, begun, failures = [], None, 0, time.monotonic(), {}
                    done.append((k, 0, "start", None, None, None, None))
                if task == "summary":
                    reply, failed = reply_or_error(provider, task, prompt)
                    replies += [reply] if reply else []
                    error = failed if error is None else error
                    continue
                if seq == 0:
                    seq = 1
                    note(k, "summary", *merged(replies, error))
                seq += 1
                if task == "done":
                    wrong = [failures.get(n) for n in REQUIRED]
                    first = None if None in wrong else next(filter(None, wrong), "")
                    done.append((k, seq, task, None, first, int(prompt), time.monotonic() - begun))
                else:
                    note(k, task, *reply_or_error(provider, task, prompt))
            if done:
                text = part.column("prompt").type
                types = (part.column(key).type, pa.int32(), text, text, text, pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names=[key, "seq", "name", "reply", "error", "char_count", "elapsed"])

    return rows.mapInArrow(fn, f"`{key}` {docs.schema[key].dataType.simpleString()}, {STREAMED}")


def analysed(docs: DataFrame, provider: Provider, mermaid: bool = False, evaluation: bool = False, how: Chunking = Chunking(), key: str = "doc_id", concurrency: int | None = None) -> DataFrame:
    """(key, name, section) for all five sections of each document."""
    tasks = enabled_tasks(mermaid, evaluation)
    done = summaries(docs, provider, how, key, concurrency).select(key, F.lit("summary").alias("name"), "reply", "error")
    other = answered(window_prompts(docs, tasks, key), provider, concurrency).select(key, F.col("task").alias("name"), "reply", "error")
    reply = F.when(F.col("name") == "mermaid", diagram_source(F.col("reply"))).otherwise(F.col("reply"))
    asked = done.unionByName(other).select(key, "name", outcome(F.lit(True), reply, F.col("error")).alias("section"))
    off = docs.select(key, F.explode(F.array(*[F.lit(n) for n in NAMES if n not in tasks] or [F.lit(None).cast("string")])).alias("name"))
    return asked.unionByName(off.where("name IS NOT NULL").select(key, "name", section(F.lit("disabled")).alias("section")))


def results(sections: DataFrame, key: str = "doc_id", **more: Column) -> DataFrame:
    """One row per document: a column and a section per name, and ``error`` if all required ones failed.
    ``more``: further aggregates by name. Rows of other names only count for those."""
    each = [F.first(F.when(F.col("name") == n, F.col("section")), ignorenulls=True).alias(n) for n in NAMES]
    wide = sections.groupBy(key).agg(*each, *[c.alias(k) for k, c in more.items()])
    failed = F.lit(True)
    for n in REQUIRED:
        failed = failed & F.coalesce(F.col(n)["status"] == "failed", F.lit(False))
    first = F.coalesce(*[F.nullif(F.col(n)["error"], F.lit("")) for n in REQUIRED])
    return wide.select(
        key, *more, *[filled(F.col(n)["content"]).alias(n) for n in NAMES],
        F.map_from_arrays(F.array(*map(F.lit, NAMES)), F.array(*[F.col(n) for n in NAMES])).alias("sections"),
        F.when(failed, first).alias("error"),
    )


def section_of(sections: Column, name: str, flat: Column) -> Column:
    """A section, or one made from the flat field that older results have."""
    return F.coalesce(F.try_element_at(sections, F.lit(name)), section(F.lit("success"), flat))
