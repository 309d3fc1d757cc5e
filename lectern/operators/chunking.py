"""Overlapping, sentence-aware chunks of long texts, in one array expression per document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import filled, stripped

#: A window ends after the last of these in it, if that lies beyond its middle.
BREAKS = ("。", ". ", "\n")


@dataclass(frozen=True)
class Chunking:
    size: int = 4000
    overlap: int = 200

    def __post_init__(self):
        if self.size <= 0 or self.overlap < 0:
            raise ValueError("size must be positive and overlap must not be negative")
        # A window may end as early as size // 2 + 2; a longer overlap would never get on.
        if self.overlap >= self.size // 2 + 2:
            raise ValueError("overlap must be less than size // 2 + 2")


def _last_break(part: Column) -> Column:
    """0-based place of the rightmost break in ``part``, or -1."""
    at = [F.length(part) - F.locate(mark[::-1], F.reverse(part)) - (len(mark) - 1) for mark in BREAKS]
    return F.greatest(*[F.when(part.contains(mark), a).otherwise(-1) for mark, a in zip(BREAKS, at)])


def _strips(text: Column, how: Chunking) -> Column:
    """The text cut into strips of four windows, so that no window walks the text from its beginning."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{4 * how.size}}}"), F.lit(0))


def _piece(strips: Column, at: Column, size: Column, how: Chunking) -> Column:
    """Up to a window's size of the text from ``at`` on: of one strip and the next."""
    k = F.floor(at / (4 * how.size)).cast("int")
    two = F.concat(F.get(strips, k), F.coalesce(F.get(strips, k + 1), F.lit("")))
    return F.substring(two, at % (4 * how.size) + 1, size)


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once; Spark repeats it within lambdas otherwise."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def spans(n: Column, strips: Column, how: Chunking = Chunking()) -> Column:
    """array<struct<start, len>> of the windows of a text of ``n`` code points cut into ``strips``, in
    order, 0-based in code points. Linear in the text's length."""
    half = how.size // 2
    kind = "array<struct<start:int,len:int>>"

    def step(state: Column, _: Column) -> Column:
        at = state["at"]
        inner = at + how.size < n
        cut = F.when(inner, _once(_piece(strips, at, F.lit(how.size), how), _last_break)).otherwise(F.lit(-1))

        def grown(cut: Column) -> Column:
            # The next start follows from where the window would end, text or not.
            taken = F.when(~inner, n - at).when(cut > half, cut + 1).otherwise(how.size)
            end = F.when(cut > half, at + cut + 1).otherwise(at + how.size)
            out = F.concat(state["out"], F.array(F.struct(at.alias("start"), taken.cast("int").alias("len"))))
            return F.struct((end - how.overlap).cast("int").alias("at"), out.alias("out"))

        return F.when(at < n, _once(cut, grown)).otherwise(state)

    least = half + 2 - how.overlap
    steps = F.sequence(F.lit(1), F.ceil(n / least).cast("int") + 1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kind).alias("out"))
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("len")))
    return F.when(n <= how.size, whole).otherwise(F.aggregate(steps, start, step, lambda s: s["out"]))


def chunk_arrays(docs: DataFrame, how: Chunking = Chunking(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, t, chunks: each text and the array<struct<start, len, raw>> of its chunks, as in ``chunks``."""
    t, strips, n = F.col("t"), F.col("strips"), F.col("n")
    cut = docs.select(F.col(key), filled(F.col(text)).alias("t")).withColumns({"n": F.length(t), "strips": _strips(t, how)})
    cut = cut.withColumn("spans", spans(n, strips, how))
    whole = F.array(F.struct(F.lit(0).alias("start"), n.alias("len"), t.alias("raw")))
    part = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["len"].alias("len"), stripped(_piece(strips, s["start"], s["len"], how)).alias("raw")))
    kept = F.when(n <= how.size, whole).otherwise(F.filter(part, lambda p: p["raw"] != ""))
    return cut.select(key, "t", kept.alias("chunks"))


def chunks(docs: DataFrame, how: Chunking = Chunking(), text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, chunk_idx, start, len, text. A text within one window is one chunk as it is, even empty;
    those of longer texts are stripped, and blank ones left out before numbering. No shuffle."""
    # The outer form, as of the other the optimiser makes a filter that works all chunks out once more.
    out = chunk_arrays(docs, how, text, key).select(key, F.posexplode_outer("chunks").alias("chunk_idx", "c")).where("chunk_idx IS NOT NULL")
    return out.select(key, "chunk_idx", "c.start", "c.len", F.col("c.raw").alias("text"))
