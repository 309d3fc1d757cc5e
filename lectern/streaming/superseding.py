"""A newer request of a client supersedes its older ones: their pieces are withheld from then on.

What counts is the rows' own time, not when they come: a piece is shown if no newer request of its client
had begun by its time. A stream therefore keeps pieces until the watermark has passed their time, when all
beginnings that could supersede them are known; so it shows what the batch shows, in whatever order rows
come within the watermark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SHOWN = "client_id long, request_id long, seq int, text string, at timestamp"


def shown_batch(rows: DataFrame) -> DataFrame:
    """SHOWN: the pieces that are not withheld. ``rows``: client_id, request_id, event (start, or anything else
    for a piece), seq, text, at. Larger request ids are newer; a beginning counts from its own time on. Pieces
    of requests without a beginning are shown while no newer request has one. Rows without a time are not."""
    piece = ~F.coalesce(F.col("event") == "start", F.lit(False))
    before = W.partitionBy("client_id").orderBy("at", piece).rowsBetween(W.unboundedPreceding, 0)
    newest = F.max(F.when(~piece, F.col("request_id"))).over(before)
    kept = rows.where("at IS NOT NULL").withColumn("newest", newest).where(piece & (F.col("request_id") >= F.coalesce("newest", "request_id")))
    return kept.select("client_id", "request_id", F.col("seq").cast("int").alias("seq"), "text", "at")


class _Superseding(StatefulProcessor):
    """Pieces and beginnings whose time the watermark hasn't passed, and the newest request before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "request_id long, seq int, text string, at long")
        self.starts = handle.getListState("starts", "request_id long, at long")
        self.newest = handle.getValueState("newest", "request_id long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        times = set()
        for frame in rows:
            at = frame["at"].map(lambda t: t.value // 1000)
            starts = frame["event"] == "start"
            if starts.any():
                self.starts.appendList([(int(r), int(t)) for r, t in zip(frame["request_id"][starts], at[starts])])
            if not starts.all():
                held = frame[~starts]
                self.pieces.appendList([(int(r), int(s), x, int(t)) for r, s, x, t in zip(held["request_id"], held["seq"], held["text"], at[~starts])])
            times |= {-(-int(t) // 1_000_000) for t in at}
        for t in times:  # whole seconds, rounded up: by then the row's time has passed
            self.handle.registerTimer(t * 1000)
        yield _shown(key, [])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        until = expiredTimerInfo.getExpiryTimeInMs() * 1000
        pieces, starts = [tuple(p) for p in self.pieces.get()], sorted((s[1], s[0]) for s in self.starts.get())
        newest = self.newest.get()[0] if self.newest.exists() else None
        out, at_start = [], 0
        for request_id, seq, text, at in sorted((p for p in pieces if p[3] <= until), key=lambda p: p[3]):
            while at_start < len(starts) and starts[at_start][0] <= at:
                newest = max(starts[at_start][1], starts[at_start][1] if newest is None else newest)
                at_start += 1
            if newest is None or request_id >= newest:
                out.append((request_id, seq, text, at))
        for at, request_id in starts[at_start:]:
            if at <= until:
                newest = request_id if newest is None else max(newest, request_id)
        for state, left in ((self.pieces, [p for p in pieces if p[3] > until]), (self.starts, [(r, at) for at, r in starts if at > until])):
            state.put(left) if left else state.clear()
        if newest is not None:
            self.newest.update((newest,))
        yield _shown(key, out)

    def close(self) -> None:
        pass


def _shown(key: tuple, rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["request_id", "seq", "text", "at"]).astype({"request_id": "int64", "seq": "int32", "at": "int64"})
    return out.assign(client_id=pd.Series([key[0]] * len(out), dtype="int64"), at=pd.to_datetime(out["at"], unit="us"))[["client_id", "request_id", "seq", "text", "at"]]


def shown_stream(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """``shown_batch`` of a stream: each piece once the watermark, ``late`` behind the newest row, has passed it.
    A client keeps the rows of that stretch and one number. Needs the state store that ``frames.STATE_STORE`` names."""
    return rows.withWatermark("at", late).groupBy("client_id").transformWithStateInPandas(statefulProcessor=_Superseding(), outputStructType=SHOWN, outputMode="Append", timeMode="EventTime")
