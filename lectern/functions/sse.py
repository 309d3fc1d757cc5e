"""Server-sent events as text: one event per frame, data as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import filled


def frame(name: Column, payload: Column) -> Column:
    """``payload`` is JSON text; null is an empty object."""
    return F.concat(F.lit("event: "), name, F.lit("\ndata: "), F.coalesce(payload, F.lit("{}")), F.lit("\n\n"))


def frames(stream: Column) -> Column:
    """array<struct<event, data>> of all frames in a text: comments are skipped, data lines of a frame
    are joined by a break, an unnamed event is ``message``, and a last frame needs no blank line after it."""
    blocks = F.split(F.regexp_replace(filled(stream), "\r\n?", "\n"), "\n\n+")

    def value(line: Column, field: str) -> Column:
        return F.regexp_replace(F.substring(line, F.lit(len(field) + 2), F.length(line)), "^ ", "")

    def parsed(block: Column) -> Column:
        lines = F.split(block, "\n")
        data = F.transform(F.filter(lines, lambda x: x.startswith("data:")), lambda x: value(x, "data"))
        names = F.transform(F.filter(lines, lambda x: x.startswith("event:")), lambda x: F.coalesce(F.nullif(F.btrim(value(x, "event")), F.lit("")), F.lit("message")))
        return F.struct(F.coalesce(F.element_at(F.nullif(names, F.array().cast("array<string>")), -1), F.lit("message")).alias("event"), F.nullif(F.array_join(data, "\n"), F.lit("")).alias("data"))

    return F.filter(F.transform(blocks, parsed), lambda e: e["data"].isNotNull())


def payload(data: Column) -> Column:
    """JSON data as it is; other data wrapped as {"raw": ...}."""
    return F.when(F.try_parse_json(data).isNotNull(), data).otherwise(F.to_json(F.struct(data.alias("raw"))))


class FrameFold:
    """Frames of a stream that comes in pieces of bytes, cut anywhere: what is not yet a whole frame, half a
    line break or half a letter waits for the next piece. The frames of all pieces are those of ``frames``
    over the whole. ``rest`` is all there is to keep between pieces."""

    def __init__(self, rest: bytes = b""):
        self.rest = rest

    def feed(self, piece: bytes, last: bool = False) -> list[tuple[str, str]]:
        """(event, data) of the frames that this piece completes; the ``last`` one ends the stream."""
        known = max(0, len(self.rest) - 2)  # a blank line may begin with the last break, before a break held back
        text = self.rest + piece
        held = b""
        if not last and text.endswith(b"\r"):
            text, held = text[:-1], b"\r"
        text = text.replace(b"\r\n", b"\n").replace(b"\r", b"\n")
        out: list[tuple[str, str]] = []
        begin, end = 0, text.find(b"\n\n", min(known, len(text)))
        while end >= 0:
            out += _frame_in(text[begin:end])
            begin = end + 2
            end = text.find(b"\n\n", begin)
        if last:
            out += _frame_in(text[begin:])
            self.rest = b""
        else:
            self.rest = text[begin:] + held
        return out


def _frame_in(block: bytes) -> list[tuple[str, str]]:
    name, data = "message", []
    for line in block.decode("utf-8", "replace").split("\n"):
        if line.startswith("data:"):
            data.append(line[5:].removeprefix(" "))
        elif line.startswith("event:"):
            name = line[6:].strip(" ") or "message"
    text = "\n".join(data)
    return [(name, text)] if text else []
