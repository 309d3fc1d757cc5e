"""Frames from pieces of byte streams, in batches and as they come."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.functions.sse import FrameFold

#: The state store that keyed state with timers needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
FRAMES = "stream_id long, nth long, event string, data string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by stream and place; a task holds one unfinished frame."""
    fold, stream, nth = FrameFold(), None, 0
    rows: list[tuple] = []

    def end() -> None:
        nonlocal nth
        for event, data in fold.feed(b"", last=True):
            nth += 1
            rows.append((stream, nth, event, data))

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*rows)) or [[], [], [], []]
        rows.clear()
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["stream_id", "nth", "event", "data"])

    for batch in batches:
        pieces = batch.column("piece")
        for i, key in enumerate(batch.column("stream_id").to_pylist()):
            if key != stream:
                end()
                fold, stream, nth = FrameFold(), key, 0
            for event, data in fold.feed(pieces[i].as_py() or b""):
                nth += 1
                rows.append((stream, nth, event, data))
        yield flushed()
    end()
    yield flushed()


def frames_of(pieces: DataFrame) -> DataFrame:
    """stream_id, nth, event, data: the frames of each stream, numbered. ``pieces``: stream_id, at (their order)
    and piece (bytes; null is none). A stream is read in order by one task, which holds no more of it than a
    frame. Streams with a null id are one stream; comments, frames without data and empty streams give none."""
    dealt = pieces.select(F.col("stream_id").cast("long").alias("stream_id"), "at", F.col("piece").cast("binary").alias("piece"))
    return dealt.repartition("stream_id").sortWithinPartitions("stream_id", "at").select("stream_id", "piece").mapInArrow(_fold, FRAMES)


class _Frames(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "rest binary, nth long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        rest, nth = self.held.get() if self.held.exists() else (b"", 0)
        fold, out = FrameFold(bytes(rest or b"")), []
        every = pd.concat(rows).sort_values("at", kind="stable")
        for piece, last in zip(every["piece"], every["last"]):
            for event, data in fold.feed(bytes(piece or b""), bool(last)):
                nth += 1
                out.append((key[0], nth, event, data))
        if every["last"].any():
            self.held.clear()
        else:
            self.held.update((fold.rest, nth))
        yield pd.DataFrame(out, columns=["stream_id", "nth", "event", "data"])

    def close(self) -> None:
        pass


def frames_stream(pieces: DataFrame) -> DataFrame:
    """``frames_of`` over a stream: ``pieces`` also has ``last``, true for what ends a stream. Pieces of one
    stream come in order; between batches each open stream keeps one unfinished frame."""
    return pieces.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=_Frames(), outputStructType=FRAMES, outputMode="Append", timeMode="None")
