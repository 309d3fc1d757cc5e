"""Line dedup: lines that many documents share are dropped from all of them but one.

Lines are exploded with their place, normalised and hashed to 128 bits; documents are counted per
hash; what is over the threshold comes back to its documents as places to drop; the rest is joined
in order. Only hashes and places are shuffled per line, texts once per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import scratch, stored, table

SPACE_BYTES = b" \t\n\x0b\x0c\r"
MIN_CHARS = 20
MIN_DOCS = 3
#: Salts of the join that brings shared lines back to their documents.
PARTS = 16


def _line_hashes(min_chars: int):
    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, digests = [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for place, line in enumerate((text or "").encode().split(b"\n")):
                    key = line.strip(SPACE_BYTES).lower()  # of bytes: A-Z only
                    # code points: bytes that don't continue one
                    if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
                        at.append(i)
                        places.append(place)
                        digests.append(xxhash.xxh3_128_digest(key))
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            rows = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(rows), batch.column("text_hash").take(rows), pa.array(places, pa.int32()),
                    pa.array(np.ascontiguousarray(halves[:, 0])), pa.array(np.ascontiguousarray(halves[:, 1])),
                ],
                names=["doc_id", "text_hash", "place", "h1", "h2"],
            )

    return fn


def line_table(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_hash, place and the 128-bit hash of each line's key, for keys of min_chars or more."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return named.mapInArrow(_line_hashes(min_chars), "doc_id long, text_hash long, place int, h1 long, h2 long")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """All rows and columns of ``docs`` with ``text`` rewritten, and a struct column ``lectern_lines``
    (n_lines, n_dropped).

    A key (line stripped of SPACE, A-Z lower-cased) of at least min_chars code points found in at least
    min_docs documents stays only in the largest doc_id that holds it, there as often as it stood.
    Null text counts as one empty line and stays null; a text all of whose lines go becomes empty.
    Rows with one doc_id are one document, whatever their texts; a null doc_id is the smallest.
    Repeated rows are treated alike; extra columns of any name come back as they were.
    """
    with scratch() as held:
        lines = stored(line_table(docs, min_chars))
        shared = stored(
            lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
            .groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
            .where(F.col("n") >= min_docs).drop("n")
        )
        # Each line has one of PARTS salts, and each shared key a row for each: a line of very many
        # documents is met in as many places.
        spread = shared.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        salted = lines.withColumn("part", F.pmod(F.xxhash64("doc_id", "place"), F.lit(PARTS)).cast("int"))
        drops = stored(
            salted.join(spread, ["h1", "h2", "part"])
            .where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
            .groupBy(F.col("doc_id").alias("drop_id"), F.col("text_hash").alias("drop_hash"))
            .agg(F.collect_set("place").alias("places"))
        )
        held.append(drops)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").cast("long").alias("row_id"), F.xxhash64("text").alias("row_hash"),
    )
    # Sorted and merged at every size: a plan that broadcasts small inputs would only hold for those.
    found = rows.join(drops.hint("merge"), F.col("row_id").eqNullSafe(F.col("drop_id")) & (F.col("row_hash") == F.col("drop_hash")), "left")
    split = found.select("row", "places", F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("places"))
    text = F.when(F.col("places").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n")
    )
    tallies = F.struct(
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.array_size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )
    return split.select(
        *[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns], tallies.alias("lectern_lines")
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id", "lectern_lines.n_lines", "lectern_lines.n_dropped",
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage; n_chars follows the text."""
    out = dedup_lines(docs).drop("lectern_lines")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


QUERIES = {"op4_line_dedup": op4_line_dedup}

ORACLES = {
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place
  FROM documents
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), shared AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN shared USING (key) GROUP BY doc_id""",
}
