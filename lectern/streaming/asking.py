"""The protocol of an asked question: ``start``, its pieces, then ``done`` or ``error``.

Each open request has keyed state: what was sent, a list of the last attempt's pieces, and a timer by the
events' own time. A piece is appended to the list, which is read only once, when the answer is whole. The
turn is stored before its ``done`` is sent: a batch is written down once, its turns are put into their log,
then its events into theirs, each under the batch's number, so a run that is broken off between the two and
started again leaves every turn and every event once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Silence after which an open request is given up, and a closed one forgotten, in milliseconds.
SILENCE = 3_600_000
EVENTS = "request_id long, seq int, event string, payload string, session_id string, question string, answer string, at timestamp"
SILENT = "no more pieces came"


class _Ask(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "session_id string, question string, sent int, attempt int, closed boolean, timer long")
        self.pieces = handle.getListState("pieces", "seq int, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(rows)
        ends = every["event"].isin(["done", "error"])
        every = every.assign(ends=ends).sort_values(["ends", "attempt", "seq"], kind="stable")
        session, question, sent, attempt, closed, timer = self.open.get() if self.open.exists() else (None, None, 0, 0, False, 0)
        newest = int(every["at"].max().timestamp() * 1000)
        out: list[tuple] = []

        def send(event: str, payload: dict, answer: str | None = None, at=None) -> None:
            nonlocal sent
            sent += 1
            out.append((key[0], sent, event, json.dumps(payload, ensure_ascii=False), session, question, answer, at))

        if not closed:
            for r in every.itertuples():
                if not sent:
                    session, question = r.session_id, r.question
                    send("start", {"session_id": session}, at=r.at)
                if r.event == "delta" and r.attempt >= attempt:
                    if r.attempt > attempt:  # an attempt that begins anew makes the one before void
                        self.pieces.clear()
                        attempt = int(r.attempt)
                    self.pieces.appendValue((int(r.seq), r.text))
                    send("delta", {"text": r.text}, at=r.at)
                elif r.event == "done":
                    answer = r.text or "".join(t for _, t in sorted((p[0], p[1]) for p in self.pieces.get()))
                    send("done", {"answer": answer}, answer, r.at)
                    closed = True
                elif r.event == "error":
                    send("error", {"error": r.text}, at=r.at)
                    closed = True
                if closed:
                    self.pieces.clear()
                    break
        if timer:
            self.handle.deleteTimer(timer)
        timer = max(newest, timerValues.getCurrentWatermarkInMs()) + SILENCE
        self.handle.registerTimer(timer)
        self.open.update((session, question, sent, attempt, closed, timer))
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.open.exists():
            session, question, sent, _, closed, _ = self.open.get()
            if not closed:
                at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
                out.append((key[0], sent + 1, "error", json.dumps({"error": SILENT}), session, question, None, at))
        self.open.clear()
        self.pieces.clear()
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["request_id", "seq", "event", "payload", "session_id", "question", "answer", "at"])
    return out.astype({"request_id": "int64", "seq": "int32"}).assign(at=pd.to_datetime(out["at"]))


def protocol_stream(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """EVENTS of each request, as its rows come. ``rows``: request_id, session_id, question, event (delta, done,
    error), attempt, seq, text, at. Within a batch pieces are sent in order of attempt and seq, the end after
    them; pieces of an attempt that a later one has replaced, and whatever follows the end, are dropped. A
    request that is silent for an hour ends with an error. Needs the state store that ``frames.STATE_STORE`` names."""
    keyed = rows.withWatermark("at", late).groupBy("request_id")
    return keyed.transformWithStateInPandas(statefulProcessor=_Ask(), outputStructType=EVENTS, outputMode="Append", timeMode="EventTime")


def protocol_batch(rows: DataFrame) -> DataFrame:
    """request_id, seq, event, text, session_id, question of requests that have all their rows: the batch twin. text: of a
    delta its piece, of ``done`` the answer, of ``error`` the reason."""
    delta = F.col("event") == "delta"
    held = rows.groupBy("request_id").agg(
        F.array_sort(F.collect_list(F.when(delta, F.struct("attempt", "seq", "text")))).alias("pieces"), F.min(F.when(~delta, F.struct("attempt", "seq", "event", "text"))).alias("end"),
        F.min_by("session_id", F.struct("attempt", "seq")).alias("session_id"), F.min_by("question", F.struct("attempt", "seq")).alias("question"),
    )
    # All rows of a request are put together from its one row, so ``rows`` is read, and its calls made, once.
    last = F.filter("pieces", lambda p: p["attempt"] == F.try_element_at("pieces", F.lit(-1))["attempt"])
    built = F.array_join(F.transform(last, lambda p: p["text"]), "")
    shown = F.when(F.col("end.event") == "done", F.coalesce(F.nullif("end.text", F.lit("")), built)).otherwise(F.col("end.text"))
    one = lambda event, text: F.struct(event.alias("event"), text.alias("text"))
    sent = F.concat(F.array(one(F.lit("start"), F.lit(None).cast("string"))), F.transform("pieces", lambda p: one(F.lit("delta"), p["text"])), F.array(one(F.col("end.event"), shown)))
    numbered = held.where("end IS NOT NULL AND request_id IS NOT NULL").select("request_id", "session_id", "question", F.posexplode(sent).alias("at", "e"))
    return numbered.select("request_id", (F.col("at") + 1).alias("seq"), "e.event", "e.text", "session_id", "question")


def turns_first(folder: str, between: Callable[[int], None] | None = None) -> Callable[[DataFrame, int], None]:
    """What a stream's ``foreachBatch`` does with EVENTS: turns of ``done`` events go to ``folder``/turns, then
    all events to ``folder``/events, each below its batch's number, which a repeated batch overwrites. Nothing
    is stored of requests that end in an error. ``between`` is called between the two writes."""

    def write(batch: DataFrame, number: int) -> None:
        spark, held = batch.sparkSession, f"{folder}/batches/batch={number}"
        batch.write.mode("overwrite").parquet(held)
        rows = spark.read.schema(EVENTS).parquet(held)
        turns = rows.where("event = 'done'").select("session_id", "request_id", "question", "answer", F.col("at").alias("ts"))
        turns.write.mode("overwrite").parquet(f"{folder}/turns/batch={number}")
        if between is not None:
            between(number)
        rows.select("request_id", "seq", "event", "payload").write.mode("overwrite").parquet(f"{folder}/events/batch={number}")

    return write
