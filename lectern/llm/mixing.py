"""Mixing sources to target weights by entropy balancing.

Among all document rates in [0, cap], the ones closest to 1 in relative entropy that give each source
its target of words are min(cap, exp(lambda * x)), x the document's size over its source's mean size
and lambda the source's dual variable. Newton iterations find all lambdas together; since a document
enters only by its source and size, they run over the counts of (source, size), not over documents.
Rates then become whole copies: error diffusion over sizes, largest first, fixes how many copies each
(source, size) takes in all, so that a source misses its target by about its smallest document; these
are dealt to documents in the order of a hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import dropped, n_words, scratch, stored, table

WEIGHTS = (5.0, 2.0, 1.0)
CAP = 3
#: Documents of one source and size are dealt in buckets: so many at least, and one for each BUCKET_ROWS documents.
N_BUCKETS, BUCKET_ROWS = 256, 50_000
MAX_STEPS = 60


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Adds ``target`` to (source, source_size). Weights repeat over sources by code point, null last.
    A source is full once its cap over its weight is below the water level; filling in that order
    gives what resharing the excess again and again ends in. One row per source."""
    by_name = W.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("weight", weight).withColumn("full_at", cap * F.col("source_size") / F.col("weight"))
    before = W.orderBy("full_at", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy()
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0))) / (
        F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    # A source is full if it would be at the level left when all that fill up sooner are full.
    leveled = ranked.withColumn("level", level).withColumn("full", F.col("full_at") < F.col("level"))
    last = F.max(F.when(~F.col("full"), F.col("level"))).over(whole)
    return leveled.withColumn("last", last).select(
        "source",
        "source_size",
        F.when(F.col("full"), cap * F.col("source_size").cast("double")).otherwise(F.col("last") * F.col("weight")).alias("target"),
    )


def _rate(x: Column, dual: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(dual * x, F.lit(50.0))))


def duals(counts: DataFrame, goals: DataFrame, cap: float = CAP, tol: float = 1e-9, max_steps: int = MAX_STEPS) -> DataFrame:
    """(source_key, dual) by safeguarded Newton: a step that leaves the bracket is replaced by its
    middle. counts: source_key, x, mass (words); goals: source_key, target. Each round is a job over
    the counts with sums before the shuffle; only how many sources are still off goes to the driver."""
    state = goals.select("source_key", "target", F.lit(0.0).alias("dual"), F.lit(-64.0).alias("low"), F.lit(2.0**40).alias("high"), F.lit(False).alias("done"))
    held: list[DataFrame] = []
    for _ in range(max_steps):
        r = _rate(F.col("x"), F.col("dual"), cap)
        slope = F.when(r < cap, r * F.col("x")).otherwise(0.0)
        sums = (
            counts.join(state.where("NOT done").select("source_key", "dual"), "source_key")
            .groupBy("source_key")
            .agg(F.sum(r * F.col("mass")).alias("got"), F.sum(slope * F.col("mass")).alias("slope"))
        )
        moved = state.join(sums, "source_key", "left")
        gap = F.col("got") - F.col("target")
        low = F.when(gap < 0, F.col("dual")).otherwise(F.col("low"))
        high = F.when(gap < 0, F.col("high")).otherwise(F.col("dual"))
        newton = F.col("dual") - F.when(F.col("slope") > 0, gap / F.col("slope"))
        middle = F.when(high >= 2.0**40, F.greatest(2 * F.col("dual"), F.lit(1.0))).otherwise((low + high) / 2)
        step = F.when((newton > low) & (newton < high), newton).otherwise(middle)
        near = F.coalesce(F.abs(gap) <= tol * F.greatest(F.col("target"), F.lit(1.0)), F.lit(True)) | (high - low < 1e-13)
        state = stored(
            moved.select(
                "source_key",
                "target",
                F.when(F.col("done") | near, F.col("dual")).otherwise(step).alias("dual"),
                F.when(F.col("done"), F.col("low")).otherwise(low).alias("low"),
                F.when(F.col("done"), F.col("high")).otherwise(high).alias("high"),
                (F.col("done") | near).alias("done"),
            )
        )
        if held:
            dropped(held.pop())
        held.append(state)
        if state.where("NOT done").isEmpty():
            break
    return state.select("source_key", "dual")


def _diffused(cap: int):
    def fn(group: pd.DataFrame) -> pd.DataFrame:
        """Whole copies per size of one source, largest size first, carrying the words over or under."""
        group = group.sort_values("size", ascending=False)
        carry, copies = 0.0, []
        for size, n, rate in zip(group["size"], group["n"], group["rate"]):
            want = n * rate + (carry / size if size else 0.0)
            k = int(min(cap * n, max(0, np.floor(want + 0.5))))
            carry += size * (n * rate - k)
            copies.append(k)
        return pd.DataFrame({"source_key": group["source_key"], "size": group["size"], "k": copies, "group_n": group["n"]})

    return fn


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, cap: int = CAP, n_buckets: int = N_BUCKETS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, source): doc_id, text_hash, size, source, source_size, target, copies.

    Size is the number of words; null texts have 0 and, like all of size 0, one copy unless their
    source has no target. Null sources are one source, last in order. Equal rows are told apart by
    nothing and may get different copies; reruns agree as multisets. Ties in the order of dealing go
    by doc_id, then text. Empty tables give no rows; other columns don't matter.
    The widest group a task holds is the sizes of one source: bounded by the longest text, not by rows.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    n_buckets = max(n_buckets, docs.count() // BUCKET_ROWS)
    sized = stored(
        docs.select(
            "doc_id", "source", key.alias("source_key"), n_words(F.col("text")).alias("size"), F.xxhash64("text").alias("text_hash")
        ).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(n_buckets)).cast("int"))
    )
    parts = stored(sized.groupBy("source_key", "source", "size", "bucket").agg(F.count(F.lit(1)).alias("part_n")))
    totals = stored(targets(parts.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("part_n")).alias("source_size"), F.sum("part_n").alias("docs")).select("source", "source_size"), weights, cap).withColumn("source_key", key))
    by_size = parts.groupBy("source_key", "size").agg(F.sum("part_n").alias("n"))
    means = parts.groupBy("source_key").agg((F.sum(F.col("size") * F.col("part_n")) / F.sum("part_n")).alias("mean"))
    counts = stored(
        by_size.where("size > 0")
        .join(means, "source_key")
        .select("source_key", "size", "n", (F.col("size") / F.col("mean")).alias("x"), (F.col("size") * F.col("n")).cast("double").alias("mass"))
    )
    solved = duals(counts, totals.where("source_size > 0"), cap)
    rates = counts.join(solved, "source_key").select("source_key", "size", "n", _rate(F.col("x"), F.col("dual"), cap).alias("rate"))
    chosen = rates.groupBy("source_key").applyInPandas(_diffused(cap), "source_key string, size long, k long, group_n long")
    upto = W.partitionBy("source_key", "size").orderBy("bucket")
    share = F.floor(F.col("k") * F.sum("part_n").over(upto) / F.col("group_n"))
    dealt = (
        parts.join(chosen, ["source_key", "size"], "left")
        .withColumn("upto", share)
        .withColumn("part_k", F.col("upto") - F.coalesce(F.lag("upto").over(upto), F.lit(0)))
        .join(totals.select("source_key", "source_size", F.coalesce("target", F.lit(0.0)).alias("target")), "source_key")
        .select("source_key", "size", "bucket", "part_n", "part_k", "source_size", "target")
    )
    order = W.partitionBy("source_key", "size", "bucket").orderBy(F.xxhash64("doc_id", F.lit("deal")), "doc_id", "text_hash")
    copies = F.floor(F.col("part_k") / F.col("part_n")) + (F.col("rank") <= F.col("part_k") % F.col("part_n")).cast("int")
    return (
        sized.withColumn("rank", F.row_number().over(order))
        .join(dealt, ["source_key", "size", "bucket"])
        .withColumn("copies", F.coalesce(copies, F.lit(1)).cast("int"))
        .select("doc_id", "text_hash", "source", "size", "source_size", "target", "copies")
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Equal rows share what they take in all: rows
    that nothing tells apart are numbered to hand it out, all others need no numbering."""
    with scratch() as held:
        taken = stored(
            mix(docs).groupBy(F.col("doc_id").alias("took_id"), F.col("text_hash").alias("took_hash"))
            .agg(F.sum("copies").alias("took"), F.count(F.lit(1)).alias("n_rows"))
        )
        held.append(taken)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("row_id"), F.xxhash64("text").alias("row_hash"))
    same = F.col("row_id").eqNullSafe(F.col("took_id")) & (F.col("row_hash") == F.col("took_hash"))
    once = rows.join(taken.where("n_rows = 1"), same).select("row", F.col("took").alias("copies"))
    number = F.row_number().over(W.partitionBy("row_id", "row_hash").orderBy(F.col("row.source")))
    share = F.floor(F.col("took") / F.col("n_rows")) + (number <= F.col("took") % F.col("n_rows")).cast("int")
    more = rows.join(taken.where("n_rows > 1"), same).select("row", share.alias("copies"))
    both = once.unionByName(more).select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))))
    return both.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


QUERIES = {"op6_mixing": op6_mixing}
ORACLES: dict = {}
