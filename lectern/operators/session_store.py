"""Sessions on disk: a log of writes in buckets of the id, snapshots, and a manifest that names what counts.

Each append is one folder of files by bucket, each compaction one snapshot of the sessions that are alive.
The manifest is a numbered file that lists the folders which count; a new number is taken by one writer
only, and a writer that comes too late reads the newer list and tries again, so appends and compactions
that overlap lose nothing. Readers see the folders of one manifest: all of a write or none of it.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.sessions import SESSION_SCHEMA, TTL_SECONDS, alive, expiry, latest
from lectern.operators.storage import content, created, entries, removed

BUCKETS = 64
MAX_TRIES = 100


class SessionStore:
    """``schema``: the columns of a session, DDL; session_id, updated_at and expires_at are among them."""

    def __init__(self, spark: SparkSession, path: str, schema: str = SESSION_SCHEMA, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.fields = T.StructType.fromDDL(schema)
        self.schema = T.StructType([*self.fields.fields, T.StructField("written", T.LongType()), T.StructField("bucket", T.IntegerType())])

    def manifest(self) -> tuple[int, dict]:
        """The newest number and its contents; 0 and nothing before the first write."""
        numbers = [int(n.removesuffix(".json")) for n in entries(self.spark, f"{self.path}/manifest") if n.endswith(".json")]
        if not numbers:
            return 0, {"folders": [], "cleaned_at": None, "buckets": self.buckets}
        newest = max(numbers)
        return newest, json.loads(content(self.spark, self._manifest(newest)))

    def _manifest(self, number: int) -> str:
        return f"{self.path}/manifest/{number:012d}.json"

    def _switch(self, change: Callable[[dict], dict]) -> int:
        for _ in range(MAX_TRIES):
            number, held = self.manifest()
            if created(self.spark, self._manifest(number + 1), json.dumps(change(held))):
                return number + 1
        raise RuntimeError("other writers took each number first")

    def _bucket(self, session_id: Column) -> Column:
        return F.pmod(F.xxhash64(session_id), F.lit(self.manifest()[1]["buckets"])).cast("int")

    def _put(self, rows: DataFrame, written: Column) -> str:
        name = uuid.uuid4().hex
        shaped = rows.select(*[F.col(f"`{f.name}`").cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.fields.fields], written.alias("written"))
        placed = shaped.withColumn("bucket", self._bucket(F.col("session_id")))
        placed.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/write={name}")
        return name

    def append(self, rows: DataFrame, now: Column | None = None, ttl: int = TTL_SECONDS) -> None:
        """Write versions of sessions. With ``now`` each is updated then and lives for ``ttl`` seconds more;
        without, the rows' own times stand. Of versions of one time the later append counts; of rows of one
        session in one append, the one with the greater updated_at, then expires_at."""
        if now is not None:
            rows = rows.withColumn("updated_at", now.cast("timestamp_ntz")).withColumn("expires_at", expiry(now, ttl))
        name = self._put(rows, F.lit(time.time_ns()).cast("long"))
        self._switch(lambda held: held | {"folders": [*held["folders"], name]})

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        data = f"{self.path}/data"
        return self.spark.read.schema(self.schema).option("basePath", data).parquet(*[f"{data}/write={f}" for f in folders])

    def versions(self) -> DataFrame:
        """All versions that count, with ``written`` and ``bucket``."""
        return self._read(self.manifest()[1]["folders"])

    @staticmethod
    def _latest(versions: DataFrame) -> DataFrame:
        return latest(versions.withColumn("order", F.struct("written", "expires_at")), seq="order").drop("order", "written", "bucket")

    def sessions(self) -> DataFrame:
        """The newest version of each session, expired or not."""
        return self._latest(self.versions())

    def session(self, session_id: str) -> DataFrame:
        """One session's newest version: only its bucket's files are read."""
        number = self.spark.range(1).select(self._bucket(F.lit(session_id))).first()[0]
        return self._latest(self.versions().where((F.col("bucket") == number) & (F.col("session_id") == session_id)))

    def bucketed(self, table: str, n: int | None = None) -> DataFrame:
        """The newest sessions as a table of the catalogue in ``n`` buckets of session_id: lookups of many
        requests (``sessions.validated``, joins with turns) shuffle the requests alone. A snapshot of now."""
        rows = self.sessions()
        n = n or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        place = f"{self.path}/tables/{table}"
        rows.repartition(n, "session_id").write.bucketBy(n, "session_id").sortBy("session_id").option("path", place).mode("overwrite").format("parquet").saveAsTable(table)
        return self.spark.table(table)

    def cleanup(self, now: datetime, interval: int = 600, force: bool = False) -> bool:
        """Compact: sessions that ended before ``now`` go, those that end just now or never stay, each with its
        newest version only. Not more often than every ``interval`` seconds but by ``force``; says whether it
        ran. What is appended meanwhile stays beside the snapshot."""
        held = self.manifest()[1]
        last = held["cleaned_at"]
        if not force and last is not None and (now - datetime.fromisoformat(last)).total_seconds() < interval:
            return False
        old = held["folders"]
        # A snapshot's versions keep their time of writing: what was appended later must still win.
        whole = self._read(old)
        newest = latest(whole.withColumn("order", F.struct("written", "expires_at")), seq="order").drop("order", "bucket")
        name = self._put(alive(newest, F.lit(now).cast("timestamp_ntz")), F.col("written"))
        self._switch(lambda m: m | {"folders": [name, *[f for f in m["folders"] if f not in old]], "cleaned_at": now.isoformat()})
        return True

    def vacuum(self) -> None:
        """Delete the folders and manifests that count no more; readers of older manifests must be done."""
        number, held = self.manifest()
        for name in entries(self.spark, f"{self.path}/data"):
            if name.removeprefix("write=") not in held["folders"]:
                removed(self.spark, f"{self.path}/data/{name}")
        for name in entries(self.spark, f"{self.path}/manifest"):
            if name.endswith(".json") and int(name.removesuffix(".json")) < number:
                removed(self.spark, f"{self.path}/manifest/{name}")
