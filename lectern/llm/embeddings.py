"""Embedding near-dedup: random-hyperplane signs in several tables, exact cosines, components.

Equal vectors of one label fall into one class first. A vector's sketch holds the signs of its products
with a pool of random hyperplanes, and each table picks a few of them for its buckets: so the sketch
gives the buckets of all tables, and it alone travels to each table. Classes of one label that share a
bucket are compared by their sketches, in blocks of bounded size, however large the bucket; vectors go
only where a row has a partner whose sketch may link and which no earlier table has met. There cosines
are exact. A pair is counted in the first table where it meets, so counts need no list of pairs: blocks
emit sums per class and a spanning forest. How many tables there are, and how far sketches of a pair at
the threshold may differ, follows from the wanted probability of missing it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.llm.common import dropped, stored, table
from lectern.llm.graph import components

THRESHOLD = 0.93
#: Probability that a pair exactly at the threshold shares no bucket; nearer pairs miss far less often.
MISS = 1e-5
#: Hyperplanes of the pool: a sketch has so many bits.
POOL = 512
#: Classes per bucket aimed at, and most rows of a block.
PER_BUCKET, BLOCK = 64, 1024
MAX_BITS = 30
SEED = 20


def _spread(threshold: float) -> np.ndarray:
    """The chances that the sketches of a pair at the threshold differ in 0 to POOL bits."""
    apart = math.acos(threshold) / math.pi
    if apart == 0:
        return np.eye(1, POOL + 1)[0]
    log = [math.lgamma(POOL + 1) - math.lgamma(h + 1) - math.lgamma(POOL - h + 1) + h * math.log(apart) + (POOL - h) * math.log1p(-apart) for h in range(POOL + 1)]
    return np.exp(log)


def most_flips(threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """In more bits the sketches of a pair at the threshold differ with a tenth of ``miss`` at most."""
    tail = np.cumsum(_spread(threshold)[::-1])[::-1]  # of h bits or more
    return int(np.argmax(np.append(tail, 0)[1:] <= miss / 10))


def n_tables(bits: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """The fewest tables of ``bits`` planes of the pool each that leave a pair at the threshold unmet with
    nine tenths of ``miss`` at most."""
    flips = np.arange(most_flips(threshold, miss) + 1)
    meet = np.prod([(POOL - flips - k) / (POOL - k) for k in range(bits)], axis=0).clip(0, 1)
    chance = _spread(threshold)[: len(flips)]
    unmet = lambda tables: float(chance @ (1 - meet) ** tables)
    high = 1
    while unmet(high) > 0.9 * miss:
        high *= 2
    low = high // 2
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if unmet(mid) > 0.9 * miss else (low, mid)
    return high


@lru_cache(maxsize=64)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim]).standard_normal((dim, POOL))


@lru_cache(maxsize=8)
def _picks(bits: int, tables: int) -> np.ndarray:
    """The planes of each table."""
    return np.stack([np.random.default_rng([SEED, bits, t]).choice(POOL, bits, replace=False) for t in range(tables)])


def _codes(signs: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The buckets in the first ``tables`` tables of the rows of ``signs``, of POOL bits each."""
    weights = (1 << np.arange(bits)).astype(np.int32)
    return np.stack([signs[:, picked] @ weights for picked in _picks(bits, tables)], axis=1)


def _buckets(bits: int, tables: int):
    """Adds the sketch and the buckets of all tables."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            n = batch.column("dim").to_numpy()
            starts = np.cumsum(n) - n
            signs = np.zeros((batch.num_rows, POOL), np.int32)
            for dim in np.unique(n).tolist():
                own = np.flatnonzero(n == dim)
                v = values[starts[own, None] + np.arange(dim)]
                v /= np.abs(v).max(axis=1, keepdims=True)  # no sum overflows
                signs[own] = v @ _planes(dim) > 0
            sketches = pa.array([row.tobytes() for row in np.packbits(signs.astype(np.uint8), axis=1)], pa.binary())
            codes = pa.array(_codes(signs, bits, tables).astype(np.int32).ravel())
            codes = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * tables), codes)
            yield pa.RecordBatch.from_arrays([*batch.columns, sketches, codes], names=[*batch.schema.names, "sketch", "codes"])

    return fn


def _signs(rows: pa.Table) -> np.ndarray:
    raw = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8)
    return np.unpackbits(raw.reshape(rows.num_rows, POOL // 8), axis=1)


def _new(signs: np.ndarray, a: np.ndarray, b: np.ndarray, bits: int, at_table: int) -> np.ndarray:
    """Whether no earlier table has met the rows a[k] and b[k]."""
    new = np.ones(len(a), bool)
    if at_table and len(a):
        hit, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        codes = _codes(signs[hit].astype(np.int32), bits, at_table)
        for t in range(at_table):
            new &= codes[place[: len(a)], t] != codes[place[len(a) :], t]
    return new


def _may_link(bits: int, flips: int):
    """The rows of a block that have a partner in it by their sketches."""

    def fn(key: tuple, rows: pa.Table) -> pa.Table:
        _, _, at_table, _, i, j = (k.as_py() for k in key)
        block = rows.column("block").to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right) or (i == j and len(left) < 2):
            return rows.slice(0, 0).drop_columns(["sketch"])
        signs = _signs(rows)
        turned = signs.astype(np.float32) * 2 - 1
        near = turned[left] @ turned[right].T >= POOL - 2 * flips  # whole numbers, exact as floats
        if i == j:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        new = _new(signs, a, b, bits, at_table)
        hit = np.unique(np.concatenate([a[new], b[new]]))
        return rows.drop_columns(["sketch"]).take(pa.array(hit))

    return fn


def _matrix(rows: pa.Table, column: str, kind: type) -> np.ndarray:
    """A column of lists of one length as the rows of a matrix."""
    values = rows.column(column).combine_chunks().flatten().to_numpy()
    return values.reshape(rows.num_rows, -1).astype(kind, copy=False)


def _compare(threshold: float, bits: int):
    def fn(key: tuple, rows: pa.Table) -> pa.Table:
        _, _, at_table, _, i, j = (k.as_py() for k in key)
        block = rows.column("block").to_numpy()
        v = _matrix(rows, "embedding", np.float64)
        v = v / np.abs(v).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        norms = np.sqrt(np.einsum("ij,ij->i", v, v))
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        near = (v[left] @ v[right].T) / np.outer(norms[left], norms[right]) >= threshold
        if i == j:
            near = np.triu(near, 1)
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        new = _new(_signs(rows), a, b, bits, at_table)
        a, b = a[new], b[new]
        weight, ids, keys = (rows.column(c).to_numpy() for c in ("weight", "class_id", "key"))
        n = np.zeros(rows.num_rows, np.int64)
        np.add.at(n, a, weight[b])
        np.add.at(n, b, weight[a])
        # Least id reached inside the block: enough edges to connect what links here.
        ranked, root = np.unique(ids, return_inverse=True)
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            np.minimum.at(low, b, root[a])
            if (low == root).all():
                break
            root = low
        hit = np.flatnonzero(n > 0)
        return pa.table({"key": keys[hit], "class_id": ids[hit], "n": n[hit], "to": ranked[root[hit]]})

    return fn


def _is_usable() -> Column:
    """Whether a row can link at all; never null."""
    v = F.filter("embedding", lambda x: x.isNotNull())
    whole = F.size(v) == F.size("embedding")
    finite = ~F.exists(v, lambda x: F.isnan(x) | (F.abs(x) == float("inf")))
    good = whole & finite & F.exists(v, lambda x: x != 0)
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & good, F.lit(False))


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD, miss: float = MISS, per_bucket: int = PER_BUCKET, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of ``embeddings`` (vec_id, embedding, label).

    Vectors link when labels are equal, lengths are equal and the cosine in double precision is at
    least ``threshold``. Null labels or ids, null or zero vectors and vectors with null or non-finite
    components have no links and stand alone. Rows that repeat a vec_id are vectors of their own and
    link as such, under the one id. Other columns are ignored; an empty table gives no rows.
    ``miss`` bounds the chance that a pair at the threshold is not found.
    """
    # Floats travel as floats, half the bytes, and become doubles where products are taken.
    kind = "array<float>" if dict(embeddings.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = embeddings.select("vec_id", F.col("embedding").cast(kind).alias("embedding"), "label")
    good = rows.where(_is_usable())
    # NaN and -0.0 aside, equal arrays group; the class is named by its smallest id. Classes of rows that
    # repeat a vec_id may share that, so a key that is written with them tells them apart.
    grouped = good.groupBy("label", "embedding").agg(F.min("vec_id").alias("class_id"), F.count(F.lit(1)).alias("weight"))
    classes = stored(grouped.withColumns({"dim": F.size("embedding"), "key": F.monotonically_increasing_id()}))
    largest = classes.groupBy("label", "dim").count().agg(F.max("count")).first()[0] or 1
    bits = max(4, min(MAX_BITS, math.ceil(math.log2(max(1, largest / per_bucket)))))
    tables = n_tables(bits, threshold, miss)
    made = StructType([*classes.schema.fields, *StructType.fromDDL("sketch binary, codes array<int>").fields])
    coded = stored(classes.mapInArrow(_buckets(bits, tables), made))
    spots = coded.select("key", "label", "dim", "sketch", F.posexplode("codes").alias("t", "bucket"))
    sizes = spots.groupBy("label", "dim", "t", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    spread = sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).drop("n")
    placed = spots.join(spread, ["label", "dim", "t", "bucket"]).withColumn("block", F.pmod(F.xxhash64("key", F.lit(1)), F.col("blocks")).cast("int"))
    # A row goes to each pair of blocks that has its own; a bucket of one block is one pair.
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")),
    )
    place = ["label", "dim", "t", "bucket", "i", "j"]
    dealt = placed.withColumn("pair", F.explode(pairs)).select("key", "label", "dim", "t", "bucket", "block", "pair.i", "pair.j", "sketch")
    wanted = stored(dealt.groupBy(*place).applyInArrow(_may_link(bits, most_flips(threshold, miss)), dealt.drop("sketch").schema))
    full = wanted.join(coded.select("key", "class_id", "weight", "embedding", "sketch"), "key")
    found = stored(full.groupBy(*place).applyInArrow(_compare(threshold, bits), "key long, class_id long, n long, to long"))
    dropped(coded, wanted)
    sums = found.groupBy("key").agg(F.sum("n").alias("n"))
    same_id = good.groupBy("vec_id").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    named = good.join(classes.select("label", "embedding", "key", "class_id", "weight"), ["label", "embedding"]).select("vec_id", "key", "class_id", "weight")
    tied = named.join(same_id, "vec_id").select(F.col("vec_id").alias("u"), F.col("class_id").alias("v"))
    roots = components(found.select(F.col("class_id").alias("u"), F.col("to").alias("v")).unionByName(tied))
    linked = (
        named.join(sums, "key", "left")
        .join(roots.select(F.col("node").alias("class_id"), "root"), "class_id", "left")
        .select("vec_id", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("root", "class_id").alias("component_id"))
    )
    alone = rows.where(~_is_usable()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES = {"op3_embedding_dedup": op3_embedding_dedup}

ORACLES = {
    "op3_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND NOT list_contains(list_transform(e, lambda x: x IS NULL OR NOT isfinite(x)), true)
    AND list_sum(list_transform(e, lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.93
), reach AS (
  SELECT vec_id AS node, vec_id AS seen FROM v
  UNION SELECT r.node, l.v FROM reach r JOIN links l ON l.u = r.seen
), roots AS (SELECT node, min(seen) AS component_id FROM reach GROUP BY node),
degrees AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT v.vec_id, coalesce(n, 0) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN roots ON node = v.vec_id LEFT JOIN degrees ON u = v.vec_id""",
}
