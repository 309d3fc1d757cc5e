"""Target-distribution importance resampling with segments told apart once.

Newlines separate words, so a text's runs of one to three words are those of its lines and those that
lie across lines. Lines are grouped over all texts: what a distinct line holds is worked out once and
counts as often as the line occurs; the runs across lines are added text by text. The same split serves
both passes: the counts of all buckets, from which each bucket's gain follows, and the weights, which
are sums of the gains of a text's lines and of its runs across.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import partitions, scratch, stored, table
from lectern.llm.features import N_BUCKETS, Words, bucket_lists, flat_lists, runs, sliced

SEED = "42"
MIN_WORDS, PERCENT = 20, 5
#: A line with more than a HOT_SHARE-th of all lines is hot; so there are fewer than HOT_SHARE of them.
HOT_SHARE = 10_000


def _keys(lines: list[bytes]) -> tuple[pa.Array, pa.Array]:
    halves = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, lines)), np.int64).reshape(-1, 2)
    return pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1]))


def _line_features(n_buckets: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data, offsets in sliced(batch.column("line")):
                words = Words(data, offsets)
                rows = np.unique(words.text)  # lines without a word have no features
                owner, crc = runs(words, words.text)
                h1, h2 = _keys([data[offsets[i] : offsets[i + 1]].tobytes() for i in rows])
                buckets = bucket_lists(owner, crc, len(offsets) - 1, n_buckets)
                yield pa.RecordBatch.from_arrays([h1, h2, batch.column("n").take(pa.array(rows + begin)), buckets.take(pa.array(rows))], names=["h1", "h2", "n", "buckets"])

    return fn


_LINE = pa.struct([("h1", pa.int64()), ("h2", pa.int64()), ("k", pa.int64())])


def _text_features(n_buckets: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, data, offsets in sliced(batch.column("text")):
                words, n = Words(data, offsets), len(offsets) - 1
                starts = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
                line = np.searchsorted(starts, words.start, "right") - 1
                owner, crc = runs(words, words.text, across=line)
                # The lines that hold words, each with its text and how often that text has it.
                used = np.unique(line)
                of = np.searchsorted(offsets, starts[used], "right") - 1
                upto = np.append(starts, len(data))
                counted: list[dict] = [{} for _ in range(n)]
                for k, text in zip(used, of):
                    stop = upto[k + 1]
                    if stop > starts[k] and data[stop - 1] == 10:
                        stop -= 1
                    digest = xxhash.xxh3_128_digest(data[starts[k] : stop])
                    counted[text][digest] = counted[text].get(digest, 0) + 1
                digests = b"".join(d for c in counted for d in c)
                halves = np.frombuffer(digests, np.int64).reshape(-1, 2)
                flat = pa.StructArray.from_arrays(
                    [pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])), pa.array([v for c in counted for v in c.values()], pa.int64())], fields=list(_LINE)
                )
                ends = np.concatenate([[0], np.cumsum([len(c) for c in counted])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(begin, n), pa.array(np.bincount(words.text, minlength=n).astype(np.int64)),
                        bucket_lists(owner, crc, n, n_buckets), pa.ListArray.from_arrays(pa.array(ends), flat),
                    ],
                    names=["doc_id", "n_words", "buckets", "lines"],
                )

    return fn


def _tallies(n_buckets: int):
    """Bucket counts of rows (buckets, n), added up by each task."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            flat, offsets = flat_lists(batch.column("buckets"))
            each = np.repeat(batch.column("n").to_numpy(), np.diff(offsets))
            for k in np.unique(each):  # one multiplicity at a time, so that all numbers stay whole
                total += k * np.bincount(flat[each == k], minlength=n_buckets)
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit.astype(np.int32)), pa.array(total[hit])], names=["bucket", "c"])

    return fn


def _weights(gains: np.ndarray, kept: list[str]):
    """Replaces ``buckets`` by ``weight``, the sum of their gains."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, offsets = flat_lists(batch.column("buckets"))
            upto = np.concatenate([[0], np.cumsum(gains[flat])]).astype(np.int64)
            weight = upto[offsets[1:]] - upto[offsets[:-1]]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], pa.array(weight, pa.int64())], names=[*kept, "weight"])

    return fn


def _counted(rows: DataFrame, n_buckets: int) -> np.ndarray:
    """How often each bucket occurs; one number a bucket comes to the driver."""
    tallies = rows.select("buckets", F.col("n").cast("long").alias("n")).mapInArrow(_tallies(n_buckets), "bucket int, c long")
    out = np.zeros(n_buckets, np.int64)
    for bucket, c in tallies.groupBy("bucket").agg(F.sum("c")).collect():
        out[bucket] = c
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket the thousandfold logarithm of its smoothed share in the target over that in the source, floored."""
    n, big_s, big_t = len(source), int(source.sum()), int(target.sum())
    ratio = ((float(t) + 1) * (float(big_s) + n) / ((float(s) + 1) * (float(big_t) + n)) for s, t in zip(source.tolist(), target.tolist()))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio], np.int64)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        place = np.arange(at, at + batch.num_rows, dtype=np.int64)
        at += batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(place)], names=[*batch.schema.names, "part", "place"])


def _lines(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Distinct lines with the number of their occurrences, as (h1, h2, n, buckets)."""
    lines = docs.select(F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line")).where("line <> ''")
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n")).mapInArrow(_line_features(n_buckets), "h1 long, h2 long, n long, buckets binary")


_TEXT = "n_words long, buckets binary, lines array<struct<h1:long,h2:long,k:long>>"


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, n_buckets: int = N_BUCKETS, seed: str = SEED, hot_share: int = HOT_SHARE) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for each row of ``docs`` (doc_id, text); ``target`` has text.

    Features are the runs of one to three words (digits, a-z after lower-casing A-Z, and all that is not
    ASCII), repeats counted, hashed to ``n_buckets`` (65,536 at most). A text's weight is the sum of its
    buckets' gains in the target over the source; its score adds Gumbel noise from a hash of its doc_id, so
    the highest scores are a weighted draw without replacement. Of the rows with ``min_words`` or more,
    ``percent`` per cent (rounded down) are drawn and ranked; the others have no rank. Ties go to the smaller
    doc_id (null first), then to fewer features and less weight. Null texts and texts without words have no
    feature and weight 0; a null doc_id hashes as nothing. Rows that repeat a doc_id are documents of their
    own. Either table may be empty. Other columns are ignored. Exact up to 128-bit hashes of lines.

    Only lines, each once, and their weights are shuffled. Lines that are a good part of all lines would
    meet in one task when weights come back to the texts: those few are broadcast instead, fewer than
    ``hot_share`` of them whatever the input.
    """
    spark, key = docs.sparkSession, dict(docs.dtypes)["doc_id"]
    with scratch() as held:
        lines = stored(_lines(docs, n_buckets))
        texts = stored(docs.select("doc_id", "text").mapInArrow(_text_features(n_buckets), f"doc_id {key}, {_TEXT}").withColumn("row", F.monotonically_increasing_id()))
        wanted = target.select(F.lit(0).alias("doc_id"), "text")
        source = _counted(lines, n_buckets) + _counted(texts.withColumn("n", F.lit(1)), n_buckets)
        aim = _counted(_lines(wanted, n_buckets), n_buckets) + _counted(wanted.mapInArrow(_text_features(n_buckets), f"doc_id int, {_TEXT}").withColumn("n", F.lit(1)), n_buckets)
        gain = gains(source, aim)

        weighed = stored(lines.select("h1", "h2", "n", "buckets").mapInArrow(_weights(gain, ["h1", "h2", "n"]), "h1 long, h2 long, n long, weight long"))
        total = weighed.agg(F.sum("n")).first()[0] or 0
        is_hot = F.col("n") * hot_share > total
        hot = F.broadcast(weighed.where(is_hot).select("h1", "h2", "weight"))
        own = texts.drop("lines").mapInArrow(_weights(gain, ["row", "doc_id", "n_words"]), f"row long, doc_id {key}, n_words long, weight long")
        each = texts.select("row", F.inline("lines"))
        common = each.join(hot, ["h1", "h2"])
        others = each.join(hot, ["h1", "h2"], "left_anti").join(weighed.where(~is_hot).select("h1", "h2", "weight").hint("merge"), ["h1", "h2"])
        parts = common.unionByName(others).select("row", (F.col("k") * F.col("weight")).alias("weight"))
        sums = parts.unionByName(own, allowMissingColumns=True).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.sum("weight").alias("weight"))

        n = F.col("n_words")
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
        noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
        scored = sums.select(
            "doc_id", "n_words", F.when(n < 2, n).otherwise(3 * n - 3).alias("n_features"), "weight", (F.col("weight") + noise).alias("score")
        )
        # Ranks without one task that sees all: rows in ranges of their order, numbered in each, and the
        # numbers of rows in the ranges before added.
        able = F.coalesce(n >= min_words, F.lit(False))
        order = [(~F.col("able")).asc(), F.desc("score"), F.asc("doc_id"), F.asc("n_features"), F.asc("weight")]
        ranged = scored.withColumn("able", able).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
        names = ["doc_id", "n_words", "n_features", "weight", "score", "able"]
        placed = stored(ranged.select(*names).mapInArrow(_numbered, f"doc_id {key}, n_words long, n_features long, weight long, score long, able boolean, part int, place long"))
        held.append(placed)
    sizes = sorted((p, c, a) for p, c, a in placed.groupBy("part").agg(F.count(F.lit(1)), F.count_if("able")).collect())
    drawn = percent * sum(a for *_, a in sizes) // 100
    before, rows = 0, []
    for part, count, _ in sizes:
        rows.append((part, before))
        before += count
    offsets = F.broadcast(spark.createDataFrame(rows, "part int, before long"))
    rank = F.col("before") + F.col("place") + 1
    return placed.join(offsets, "part").select("doc_id", "n_words", "n_features", "weight", "score", F.when(F.col("able") & (rank <= drawn), rank).alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {"op13_importance_resampling": op13_importance_resampling}
#: The crc of runs of words is beyond SQL: a test works all out anew, run by run.
ORACLES: dict = {}
