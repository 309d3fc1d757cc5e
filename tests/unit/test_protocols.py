"""Frames from pieces cut anywhere; questions from start to stored turn, through restarts."""

import json
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import sse
from lectern.streaming import asking, frames

STREAM = "event: a\r\ndata: één\r\n\r\n: comment\n\ndata: two\ndata:  lines \n\nevent:b \ndata: {\"k\": 1}\r\rdata\n\n\n\nevent: c\ndata: 数😀\n\r\ndata: end"


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="da:tevn \r\n😀é", max_size=60), st.lists(st.integers(0, 200), max_size=8))
def test_pieces_give_the_frames_of_the_whole(tail, cuts):
    raw = (STREAM + "\n\n" + tail).encode()
    want = sse.FrameFold().feed(raw, last=True)
    fold, got, at = sse.FrameFold(), [], 0
    for cut in sorted(cuts):
        got += fold.feed(raw[at : max(at, cut)])
        at = max(at, min(cut, len(raw)))
    assert got + fold.feed(raw[at:], last=True) == want


def test_folded_frames_equal_the_expression(spark):
    rng = random.Random(4)
    texts = [STREAM, "", "data: x", "\n\n\n", "data: a\r"] + ["".join(rng.choice(["data: ", "event: ", "x", "é", "\n", "\r\n", "\n\n", "\r", ":", " "]) for _ in range(80)) for _ in range(60)]
    whole = spark.createDataFrame(list(enumerate(texts)), "stream_id long, t string")
    want = [(r.stream_id, k, e.event, e.data) for r in whole.select("stream_id", sse.frames(F.col("t")).alias("f")).collect() for k, e in enumerate(r.f, 1)]
    raw = F.encode("t", "UTF-8")
    pieces = whole.withColumn("b", raw).select("stream_id", F.explode(F.sequence(F.lit(0), F.octet_length("b"))).alias("at"), "b").where("at % 3 = 0").select("stream_id", "at", F.expr("substring(b, at + 1, 3)").alias("piece"))
    assert sorted(tuple(r) for r in frames.frames_of(pieces).collect()) == sorted(want)


@pytest.fixture
def keyed_state(spark):
    old = spark.conf.get(frames.STATE_STORE[0], None)
    spark.conf.set(*frames.STATE_STORE)
    yield
    spark.conf.unset(frames.STATE_STORE[0]) if old is None else spark.conf.set(frames.STATE_STORE[0], old)


def run(out, write, checkpoint, seconds=120):
    query = out.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not query.awaitTermination(seconds):
        query.stop()
        raise AssertionError("the stream does not end")


def test_frames_of_a_stream(spark, tmp_path, keyed_state):
    raw = STREAM.encode()
    schema = "stream_id long, at int, piece binary, last boolean"
    cut = [(k, at, bytearray(raw[at : at + 5]), at + 5 >= len(raw)) for k in (1, 2) for at in range(0, len(raw), 5)]
    want = {(k, n, e, d) for k in (1, 2) for n, (e, d) in enumerate(sse.FrameFold().feed(raw, last=True), 1)}
    for part in (cut[: len(cut) // 3], cut[len(cut) // 3 :]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = frames.frames_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        run(out, lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"))
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want


AT = datetime(2024, 1, 2, 3, 0, 0)
ROWS = "request_id long, session_id string, question string, event string, attempt int, seq int, text string, at timestamp"


def asked(k, *events, at=AT):
    return [(k, f"s{k}", f"q{k}?", e, attempt, seq, text, at) for e, attempt, seq, text in events]


FIRST = [
    *asked(1, ("delta", 1, 1, "bad"), ("delta", 2, 1, "a"), ("delta", 2, 2, "b\"é"), ("done", 2, 3, "")),
    *asked(2, ("delta", 1, 1, "half"), ("error", 1, 2, "HTTP 503")), *asked(3, ("delta", 1, 1, "open ")), *asked(4, ("done", 1, 1, "whole")),
]
LATER = asked(3, ("delta", 1, 2, "and "), ("delta", 1, 3, "shut"), ("done", 1, 4, None), at=AT + timedelta(minutes=5)) + asked(1, ("delta", 2, 9, "late"), at=AT + timedelta(minutes=5))


def feed(spark, tmp_path, rows, write):
    spark.createDataFrame(rows, ROWS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = asking.protocol_stream(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")))
    run(out, write, str(tmp_path / "cp"))


def stored(spark, tmp_path):
    read = lambda name, schema: spark.read.schema(schema).parquet(f"{tmp_path}/log/{name}")
    turns = sorted(tuple(r) for r in read("turns", "session_id string, request_id long, question string, answer string").select("session_id", "question", "answer").collect())
    events: dict = {}
    for r in sorted(read("events", "request_id long, seq int, event string, payload string").select("request_id", "seq", "event", "payload").collect()):
        events.setdefault(r.request_id, []).append((r.seq, r.event, next(iter(json.loads(r.payload).values()))))
    return turns, events


def test_a_turn_is_stored_before_done_through_a_restart(spark, tmp_path, keyed_state):
    log = f"{tmp_path}/log"
    feed(spark, tmp_path, FIRST, asking.turns_first(log))

    def breaks(number):
        raise RuntimeError("broken off between the two writes")

    with pytest.raises(Exception, match="broken off"):
        feed(spark, tmp_path, LATER, asking.turns_first(log, breaks))
    turns, events = stored(spark, tmp_path)
    assert ("s3", "q3?", "open and shut") in turns and events[3] == [(1, "start", "s3"), (2, "delta", "open ")]  # stored, not yet told
    out = asking.protocol_stream(spark.readStream.schema(ROWS).parquet(str(tmp_path / "in")))
    run(out, asking.turns_first(log), str(tmp_path / "cp"))
    turns, events = stored(spark, tmp_path)
    assert turns == [("s1", "q1?", 'ab"é'), ("s3", "q3?", "open and shut"), ("s4", "q4?", "whole")]
    assert events == {
        1: [(1, "start", "s1"), (2, "delta", "bad"), (3, "delta", "a"), (4, "delta", 'b"é'), (5, "done", 'ab"é')], 2: [(1, "start", "s2"), (2, "delta", "half"), (3, "error", "HTTP 503")],
        3: [(1, "start", "s3"), (2, "delta", "open "), (3, "delta", "and "), (4, "delta", "shut"), (5, "done", "open and shut")], 4: [(1, "start", "s4"), (2, "done", "whole")],
    }
    whole = spark.createDataFrame(FIRST + LATER[:3], ROWS)
    batch: dict = {}
    for r in sorted(asking.protocol_batch(whole).collect()):
        batch.setdefault(r.request_id, []).append((r.seq, r.event, r.session_id if r.event == "start" else r.text))
    assert batch == events
    # An hour and more of silence: what is open ends with an error, and nothing is stored of it.
    feed(spark, tmp_path, asked(5, ("delta", 1, 1, "x"), at=AT + timedelta(minutes=6)), asking.turns_first(log))
    feed(spark, tmp_path, asked(6, ("done", 1, 1, "y"), at=AT + timedelta(hours=9)), asking.turns_first(log))
    feed(spark, tmp_path, asked(7, ("done", 1, 1, "z"), at=AT + timedelta(hours=9)), asking.turns_first(log))
    turns, events = stored(spark, tmp_path)
    assert events[5] == [(1, "start", "s5"), (2, "delta", "x"), (3, "error", asking.SILENT)] and "s5" not in {t[0] for t in turns}


def test_formulas_come_back_unchanged(spark):
    from lectern.functions.text import math_delimiters, protected_math, restored_math

    texts = [
        "a $$x_1\n*y*$$ b $c<d$ e", r"\[p\] and \(q\)" + "\r\n$ 5 and $6", "no math", "", None, "@@MATHBLOCK0@@ $$z$$ @@MATHINLINE7@@", "\n\n$$x$$\n\n$$y$$$z$", "$$open $a$", "$a$$b$$c$",
        "<p>@@MATHBLOCK0@@</p> $$q$$", "price $5 and $6", "$$$$ $x $",
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "n long, t string").select("n", math_delimiters(F.col("t")).alias("plain"), protected_math(F.col("t")).alias("p"))
    out = rows.select("n", "plain", "p.*", restored_math(F.col("p.text"), F.col("p.blocks"), F.col("p.inline")).alias("back")).collect()
    assert all(r.back == r.plain for r in out)
    first = min(out)
    assert (first.text, first.blocks, first.inline) == ("a \n\n@@MATHBLOCK0@@\n\n b @@MATHINLINE0@@ e", ["$$x_1\n*y*$$"], ["$c<d$"])
    html = spark.range(1).select(F.lit("<p>@@MATHBLOCK0@@</p><b>@@MATHINLINE0@@</b>").alias("h"), F.array(F.lit("$$a$$")).alias("b"), F.array(F.lit("$b$")).alias("i"))
    assert html.select(restored_math(F.col("h"), F.col("b"), F.col("i"))).first()[0] == "$$a$$<b>$b$</b>"


def test_an_analysis_starts_and_ends(spark):
    """All required tasks of the second document fail: its stream ends with the first one's error."""
    from lectern.operators.providers import OfflineProvider
    from lectern.plans import pipelines
    from lectern.streaming import events

    def provider(task, prompt):
        if "bad" in prompt:
            raise ValueError(f"HTTP 503 in {task}")
        return OfflineProvider()(task, prompt)

    docs = spark.createDataFrame([(1, "One two. Three."), (2, "bad text"), (3, "")], "doc_id long, text string")
    got: dict = {}
    for r in sorted(events.analysis_protocol(docs, provider, mermaid=True).collect()):
        got.setdefault(r.doc_id, []).append((r.seq, r.event, json.loads(r.payload)))
    assert [e for _, e, _ in got[1]] == ["start"] + ["section"] * 5 + ["done"] and got[1][0][2] == {"doc_id": 1}
    assert got[2][-1] == (6, "error", {"error": "HTTP 503 in summary"}) and got[3][-1] == (6, "done", {"doc_id": 3, "char_count": 0})
    assert [p["name"] for _, e, p in got[2] if e == "section"] == ["summary", "quotes", "mindmap", "mermaid", "evaluation"]
    out = {r.doc_id: r for r in pipelines.analyse(docs, provider).collect()}
    assert out[2].error == "HTTP 503 in summary" and out[1].error is None and all(0 <= r.elapsed_seconds < 60 and r.elapsed_seconds == round(r.elapsed_seconds, 1) for r in out.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_superseded_pieces_are_withheld_in_any_order_of_arrival(spark, tmp_path, keyed_state, seed):
    from lectern.streaming import superseding

    rng = random.Random(seed)
    schema = "client_id long, request_id long, event string, seq int, text string, at timestamp"
    rows = []
    for client in (1, 2, 3):
        for k in range(40):
            request = rng.randrange(5)
            at = AT + timedelta(seconds=rng.randrange(400), microseconds=rng.choice([0, 1, 999]))
            rows.append((client, request, "start" if rng.random() < 0.2 else "delta", k, f"{client}-{k}", at))
    rows += [(1, 9, "start", 0, "", rows[3][5]), (1, 8, "delta", 99, "same moment", rows[3][5]), (1, 9, "delta", 98, "newest", rows[3][5])]
    rng.shuffle(rows)
    far = [[(7, 1, "delta", 0, "flush", AT + timedelta(hours=h))] for h in (2, 4, 6)]
    for k, part in enumerate([rows[i::5] for i in range(5)] + far):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    import os

    for k in range(8):  # one batch for each, in this order
        for name in os.listdir(tmp_path / "in" / str(k)):
            os.utime(tmp_path / "in" / str(k) / name, (1_700_000_000 + k * 100, 1_700_000_000 + k * 100))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    run(superseding.shown_stream(stream), lambda df, _: df.write.mode("append").parquet(str(tmp_path / "out")), str(tmp_path / "cp"), 240)
    seen = lambda df: sorted((r.client_id, r.request_id, r.seq, r.text, r.at) for r in df.collect() if r.client_id != 7)
    want = seen(superseding.shown_batch(spark.createDataFrame(rows, schema)))
    assert seen(spark.read.parquet(str(tmp_path / "out"))) == want and 0 < len(want) < len(rows)
