"""Providers answer prompts. The offline one is deterministic and extractive; the HTTP one talks to a
chat-completions endpoint with bounded retries. Both run inside Spark tasks, batch by batch."""

from __future__ import annotations

import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators.batches import pieces

#: Calls that a task of a metered provider has open at once.
CALLS_PER_TASK = 4
#: Pieces of streamed answers that are handed on together, and seconds after which fewer are.
HAND_ON, HAND_ON_SECONDS = 100, 0.5


class Provider(Protocol):
    def __call__(self, task: str, prompt: str) -> str: ...


def sentences(text: str) -> list[str]:
    return [s.strip() for s in re.split(r"(?<=[.。!?])\s+|\n+", text) if s.strip()]


@dataclass(frozen=True)
class OfflineProvider:
    """Summary: the first sentences; quotes: the longest; structure: a tree of openings; diagram: a
    chain of them; evaluation: counts. Same prompt, same reply."""

    points: int = 3

    def __call__(self, task: str, prompt: str) -> str:
        found = sentences(prompt)
        if not found:
            return ""
        if task == "quotes":
            best = sorted(sorted(range(len(found)), key=lambda i: (-len(found[i]), i))[: self.points])
            return "\n".join(f'{k}. "{found[i]}"' for k, i in enumerate(best, 1))
        heads = [" ".join(s.split()[:6]) for s in found[: self.points]]
        if task == "mindmap":
            return "\n".join([heads[0], *(f"  - {h}" for h in heads[1:])])
        if task == "mermaid":
            names = [re.sub(r"[^\w ]", "", h) or "part" for h in heads]
            return "\n".join(["graph TD", f"    A[{names[0]}]", *(f"    A --> B{k}[{n}]" for k, n in enumerate(names[1:], 1))])
        if task == "evaluation":
            return f"## Extent\n{len(found)} sentences, {len(prompt)} characters"
        return "\n".join(f"- {s}" for s in found[: self.points])


@dataclass(frozen=True)
class HttpProvider:
    """Metered: flows bound how many calls are open at once."""

    base_url: str
    api_key: str
    model: str
    timeout: int = 60
    attempts: int = 3
    temperature: float = 0.7
    max_tokens: int = 4000
    system: str = "You are an assistant for scholarly documents."
    #: Whether a call that is refused for coming too often is repeated here; a store repeats it for all tasks.
    retry_limited: bool = True

    metered = True

    def _request(self, prompt: str, stream: bool) -> urllib.request.Request:
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": prompt}]
        body = {"model": self.model, "temperature": self.temperature, "max_tokens": self.max_tokens, "messages": messages} | ({"stream": True} if stream else {})
        return urllib.request.Request(
            f"{self.base_url.rstrip('/')}/chat/completions", json.dumps(body).encode(),
            {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"},
        )

    def __call__(self, task: str, prompt: str) -> str:
        request = self._request(prompt, False)
        return _with_retries(lambda: self._once(request), self.attempts, retry_limited=self.retry_limited)

    def deltas(self, prompt: str) -> Iterator[str]:
        """The pieces of one streamed reply as they come; one attempt."""
        with urllib.request.urlopen(self._request(prompt, True), timeout=self.timeout) as reply:
            yield from stream_deltas(reply)

    def _once(self, request: urllib.request.Request) -> str:
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            raw = reply.read().decode("utf-8", "replace")
        if raw.lstrip().lower().startswith(("<!doctype html", "<html")):
            raise ValueError("the address answers with a web page")
        choices = json.loads(raw).get("choices") or []
        content = choices[0].get("message", {}).get("content") if choices else None
        if isinstance(content, list):
            content = "\n".join(p.get("text", "") for p in content if p.get("type") == "text")
        if not (content or "").strip():
            raise ValueError("empty reply")
        return content.strip()


def _with_retries(call: Callable[[], str], attempts: int, cap: int = 8, retry_limited: bool = True) -> str:
    """Any failure is repeated, each time after a longer wait; a 429 only with ``retry_limited``."""
    for attempt in range(attempts):
        try:
            return call()
        except (urllib.error.URLError, TimeoutError, OSError, ValueError) as e:
            if attempt + 1 == attempts or (getattr(e, "code", None) == 429 and not retry_limited):
                raise
            time.sleep(min(2 * (attempt + 1), cap))
    raise AssertionError("attempts must be positive")


def stream_deltas(lines) -> Iterator[str]:
    """Texts of a provider's streamed lines: ``data:`` lines with JSON whose first choice has a delta with
    content. Comments, blanks, the closing mark and what isn't JSON are skipped; a reply without any text
    is an error."""
    found = False
    for line in lines:
        line = (line.decode("utf-8") if isinstance(line, bytes) else line).strip()
        data = line[5:].strip() if line.startswith("data:") else ""
        if not data or data == "[DONE]":
            continue
        try:
            choices = json.loads(data).get("choices") or []
        except (ValueError, AttributeError):
            continue
        text = (choices[0].get("delta") or {}).get("content") if choices else None
        if text:
            found = True
            yield str(text)
    if not found:
        raise ValueError("empty reply")


def streamed(prompts: DataFrame, provider, attempts: int = 3, max_concurrency: int | None = None, pause: float = 2.0) -> DataFrame:
    """request_id, event, attempt, seq, text: the pieces of each answer as they come, then ``done`` with no
    text or ``error`` with the reason. A failed attempt is repeated, and its pieces count no more: readers
    take those of the last attempt. ``prompts``: request_id, prompt, error; rows with an error or without
    a prompt are that error. ``provider`` has ``deltas``."""

    def events(request_id, prompt, refused) -> Iterator[tuple]:
        if refused is not None or prompt is None:
            yield request_id, "error", 1, 1, refused or "no prompt"
            return
        for attempt in range(1, attempts + 1):
            seq = 0
            try:
                for text in provider.deltas(prompt):
                    seq += 1
                    yield request_id, "delta", attempt, seq, text
                yield request_id, "done", attempt, seq + 1, ""
                return
            except Exception as e:  # as in reply_or_error
                if attempt == attempts:
                    yield request_id, "error", attempt, seq + 1, str(e) or type(e).__name__
                else:
                    time.sleep(min(pause * attempt, 8))

    kind = prompts.schema["request_id"].dataType.simpleString()
    schema = f"request_id {kind}, event string, attempt int, seq int, text string"

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces are handed on by the hundred, or as many as came in half a second."""
        held, begun, types = [], time.monotonic(), None

        def handed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=["request_id", "event", "attempt", "seq", "text"])

        for rows in pieces(batches):
            ids, asked = rows.column("request_id"), rows.column("prompt")
            types = (ids.type, asked.type, pa.int32(), pa.int32(), asked.type)
            for row in zip(ids.to_pylist(), asked.to_pylist(), rows.column("error").to_pylist()):
                for event in events(*row):
                    held.append(event)
                    if len(held) >= HAND_ON or time.monotonic() - begun > HAND_ON_SECONDS:
                        yield handed()
                        held, begun = [], time.monotonic()
        if held:
            yield handed()

    spread = prompts if max_concurrency is None else prompts.repartition(max_concurrency)
    return spread.select("request_id", "prompt", "error").mapInArrow(fn, schema)


def concurrency_of(provider: Provider, configured: int) -> int | None:
    """How many calls may be open at once: only metered providers have a bound."""
    return configured if getattr(provider, "metered", False) else None


def reply_or_error(provider: Provider, task: str, prompt: str) -> tuple[str | None, str | None]:
    try:
        return provider(task, prompt), None
    except Exception as e:  # a provider may fail in any way; each is one row's result
        return None, str(e) or type(e).__name__


def answered(prompts: DataFrame, provider: Provider, max_concurrency: int | None = None) -> DataFrame:
    """Adds reply and error to rows with task and prompt; null prompts pass unanswered. A failed call is
    data. ``max_concurrency`` bounds how many calls are open at once: so many tasks, with so many threads
    each; without it, a task answers row by row."""
    names = prompts.columns
    tasks = None if max_concurrency is None else -(-max_concurrency // CALLS_PER_TASK)
    threads = 1 if tasks is None else max(1, max_concurrency // tasks)

    def one(task: str, prompt: str | None) -> tuple[str | None, str | None]:
        return (None, None) if prompt is None else reply_or_error(provider, task, prompt)

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(threads) as pool:
            for rows in pieces(batches):
                asked = rows.column("prompt")
                done = list((map if threads == 1 else pool.map)(one, rows.column("task").to_pylist(), asked.to_pylist()))
                replies, errors = (pa.array([d[i] for d in done], asked.type) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), replies, errors], names=[*names, "reply", "error"])

    spread = prompts if tasks is None else prompts.repartition(tasks)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema) + ", reply string, error string"
    return spread.mapInArrow(fn, schema)


def idempotency_key(prompt="prompt", task="task"):
    """Keys a table of replies, so that a repeated Spark task finds its answers instead of asking again."""
    return F.sha2(F.concat_ws("\x1f", F.col(task), F.col(prompt)), 256)


def cached(prompts: DataFrame, replies: DataFrame, provider: Provider, max_concurrency: int | None = None) -> DataFrame:
    """Answers from ``replies`` (key, reply) where they are known; only the others are asked, each once."""
    keyed = prompts.withColumn("key", idempotency_key())
    known = keyed.join(replies.select("key", "reply"), "key").withColumn("error", F.lit(None).cast("string"))
    open_ = keyed.join(replies.select("key"), "key", "left_anti")
    asked = answered(open_.select("key", "task", "prompt").dropDuplicates(["key"]), provider, max_concurrency)
    return known.unionByName(open_.join(asked.select("key", "reply", "error"), "key", "left"))
