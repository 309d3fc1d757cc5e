"""Sharding over fixed virtual slots.

Records hash into a fixed number of slots (thousands); bytes are added up per slot; a versioned table
(version, virtual_slot, shard) says where each slot lives, and rebalancing writes a new version of
that table in which as few slots as needed have moved. Records are never looked at again to move.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.llm.common import dropped, stored, table

N_SLOTS = 4096
#: A group of equal texts is spread beyond so many slots' mean bytes, or so many slots' mean rows and HOT_ROWS.
HOT_SLOTS, HOT_ROWS = 8, 1000
MAP_SCHEMA = "version int, virtual_slot int, shard int"


def virtual_slot(*keys: Column, n_slots: int = N_SLOTS) -> Column:
    """The slot of a record; null keys hash like any other value."""
    return F.pmod(F.xxhash64(*keys), F.lit(n_slots)).cast("int")


def slot_stats(records: DataFrame, size: str = "size", slot: str = "virtual_slot") -> DataFrame:
    """Bytes and rows per slot: at most n_slots rows, summed before the shuffle."""
    return records.groupBy(F.col(slot).alias("virtual_slot")).agg(
        F.sum(size).alias("bytes"), F.count(F.lit(1)).alias("rows")
    )


def _weights(stats: DataFrame, n_slots: int) -> list[int]:
    """Bytes per slot on the driver: n_slots numbers, however large the data."""
    out = [0] * n_slots
    for row in stats.select("virtual_slot", "bytes").limit(n_slots).collect():
        out[row.virtual_slot] = int(row.bytes or 0)
    return out


def build_map(stats: DataFrame, n_shards: int, n_slots: int = N_SLOTS, version: int = 1) -> DataFrame:
    """Heaviest slot first to the lightest shard; ties by slot and shard number, so reruns agree.
    Slots without rows are placed too, so that later records find a home."""
    if n_shards < 1 or n_slots < n_shards:
        raise ValueError("need 1 <= n_shards <= n_slots")
    weights = _weights(stats, n_slots)
    shards = [(0, 0, k) for k in range(n_shards)]
    rows = []
    for slot in sorted(range(n_slots), key=lambda s: (-weights[s], s)):
        load, held, shard = heapq.heappop(shards)
        rows.append((version, slot, shard))
        heapq.heappush(shards, (load + weights[slot], held + 1, shard))
    return stats.sparkSession.createDataFrame(sorted(rows), MAP_SCHEMA)


def rebalance(current: DataFrame, stats: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """The next version of a map: slots leave shards that no longer exist or hold more than the mean,
    smallest surplus first, and go to the shard with the least bytes; all others stay."""
    weights = _weights(stats, n_slots)
    rows = current.limit(n_slots + 1).collect()
    if len(rows) != n_slots:
        raise ValueError("current must be one version of a map, with a row for each slot")
    version = max(r.version for r in rows) + 1
    home = {r.virtual_slot: r.shard for r in rows}
    load = [0] * n_shards
    for slot, shard in home.items():
        if shard < n_shards:
            load[shard] += weights[slot]
    mean = sum(weights) / n_shards
    moving = [s for s in sorted(home) if home[s] >= n_shards]
    for slot in sorted(home, key=lambda s: (-weights[s], s)):
        shard = home[slot]
        if shard < n_shards and weights[slot] and load[shard] - weights[slot] >= mean:
            load[shard] -= weights[slot]
            moving.append(slot)
    lightest = [(x, k) for k, x in enumerate(load)]
    heapq.heapify(lightest)
    for slot in sorted(moving, key=lambda s: (-weights[s], s)):
        x, shard = heapq.heappop(lightest)
        home[slot] = shard
        heapq.heappush(lightest, (x + weights[slot], shard))
    return current.sparkSession.createDataFrame([(version, s, k) for s, k in sorted(home.items())], MAP_SCHEMA)


def save_map(slot_map: DataFrame, path: str) -> None:
    """Append a version; older ones stay readable."""
    slot_map.write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One stored version, by default the newest."""
    maps = spark.read.parquet(path)
    newest = maps.agg(F.max("version")).first()[0] if version is None else version
    return maps.where(F.col("version") == newest).select("version", "virtual_slot", "shard")


def assign(records: DataFrame, slot_map: DataFrame, slot: str = "virtual_slot") -> DataFrame:
    """``records`` with ``shard`` looked up; the map has a row for each slot, so it is broadcast."""
    lookup = slot_map.select(F.col("virtual_slot").alias(slot), "shard")
    return records.drop("shard").join(F.broadcast(lookup), slot)


def numbered(records: DataFrame, stats: DataFrame, slot_map: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``slot``, the record's place in its shard, gapless from 0. Rows are counted off within
    virtual slots only and shifted by the slots before theirs, so no task gathers a shard."""
    before = W.partitionBy("shard").orderBy("virtual_slot").rowsBetween(W.unboundedPreceding, -1)
    starts = assign(stats, slot_map).select(
        "virtual_slot", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    inside = W.partitionBy("virtual_slot").orderBy(*order)
    return (
        records.withColumn("inside", F.row_number().over(inside) - 1)
        .join(F.broadcast(starts), "virtual_slot")
        .withColumn("slot", (F.col("start") + F.col("inside")).cast("long"))
        .drop("start", "inside")
    )


def grouped_slots(sized: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """Adds ``virtual_slot`` to rows of doc_id, size, text_crc32: equal texts get one slot, but for groups with
    more bytes or rows than HOT_SLOTS slots have on average, whose rows are spread over all slots by their
    doc_id. There are fewer than n_slots / 4 such groups, so they are broadcast."""
    groups = sized.groupBy("size", "text_crc32").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    total = sized.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    hot = groups.where((F.col("bytes") * n_slots > HOT_SLOTS * (total.bytes or 0)) | (F.col("rows") > max(HOT_ROWS, HOT_SLOTS * total.rows // n_slots)))
    spread = hot.where("rows > 1").select("size", "text_crc32", F.lit(True).alias("spread"))
    own, salt = [F.col("size"), F.col("text_crc32")], F.when(F.col("spread"), F.xxhash64("doc_id", F.lit(9)))
    return sized.join(F.broadcast(spread), ["size", "text_crc32"], "left").withColumn("virtual_slot", virtual_slot(*own, salt, n_slots=n_slots)).drop("spread")


def shard_documents(docs: DataFrame, n_shards: int = 8, n_slots: int = N_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(placed, map): per document doc_id, size, text_crc32, virtual_slot, shard, slot; and the map used.

    Size is the UTF-8 bytes of the text (null: none) plus 1; shards hold nearly equal bytes. Equal texts
    (by size and crc) share a slot and so a shard, unless their group is larger than HOT_SLOTS slots are on
    average (``grouped_slots``): those spread over all slots, or shards would be uneven.
    Null ids and repeated rows are placed like others, with places of their own. Other columns don't
    matter. An empty table gives no rows and a full map.
    """
    text = F.coalesce("text", F.lit(""))
    sized = stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32")))
    placed = stored(grouped_slots(sized, n_slots))
    dropped(sized)
    stats = stored(slot_stats(placed))
    slot_map = stored(build_map(stats, n_shards, n_slots))
    out = assign(numbered(placed, stats, slot_map, ["doc_id", "text_crc32", "size"]), slot_map)
    return out.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", "slot"), slot_map


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed, _ = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
        "virtual_slot",
    )


QUERIES = {"op9_sharding": op9_sharding}
ORACLES: dict = {}
