"""A store of replies: what was asked of a provider or an interface is asked once.

Requests go by key. Those that no committed run has answered are asked in tasks; a task puts each reply
into a journal as soon as it has it, before the next request, so an attempt that fails and is repeated,
or a job that is started again, finds it there. The replies of a run are then written as one folder,
which counts once Spark has marked it complete, and every branch of a plan reads that folder. Failures
are kept for the run that met them, so its branches agree, and are asked anew by the next.
"""

from __future__ import annotations

import dataclasses
import json
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import pandas as pd
from pyspark import BarrierTaskContext, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.providers import CALLS_PER_TASK, HttpProvider, Provider, concurrency_of, idempotency_key
from lectern.operators.storage import entries, exists, opened, put_whole, removed, shared_folder

#: What a call yields: values of the store's fields, and whether they may answer later runs too.
Call = Callable[[dict], tuple[dict, bool]]
#: Calls that each thread makes between two looks at what the other tasks have met, and times that a refused
#: one is made in all.
PER_ROUND, ATTEMPTS = 4, 3


class Limited(Exception):
    """Raised by a call that was refused because too many came; ``values`` are its outcome if that goes on."""

    def __init__(self, values: dict):
        super().__init__("too many calls")
        self.values = values


def is_limit(error: BaseException) -> bool:
    return getattr(error, "code", None) == 429


class ReplyStore:
    """``fields``: the columns a reply has, as DDL. One store holds one kind of replies. Tasks under a common
    limit look at each other's refusals after ``per_round`` calls of each thread."""

    def __init__(self, spark: SparkSession, fields: str = "reply string, error string", path: str | None = None, per_round: int = PER_ROUND):
        self.spark, self.fields, self.per_round = spark, fields, per_round
        self.path = (path or shared_folder(spark, "replies")).rstrip("/")
        self.schema = T.StructType.fromDDL(f"key string, lasting boolean, {fields}")

    def runs(self) -> list[str]:
        """The folders of complete runs."""
        names = [f"{self.path}/runs/{n}" for n in entries(self.spark, f"{self.path}/runs")]
        return [n for n in names if exists(self.spark, f"{n}/_SUCCESS")]

    def known(self) -> DataFrame:
        """key and fields of all replies that last; each key once."""
        runs = self.runs()
        if not runs:
            return self.spark.createDataFrame([], self.schema).drop("lasting")
        return self.spark.read.schema(self.schema).parquet(*runs).where("lasting").drop("lasting")

    def evaluated(self, requests: DataFrame, call: Call, max_concurrency: int | None = None) -> DataFrame:
        """``requests`` (key and any columns ``call`` reads) with the reply's fields. Keys that repeat are one
        request. All calls are made now, before this returns. ``max_concurrency`` bounds how many are open in the cluster:
        the tasks run together, as one barrier stage, share that number out, and tell each other after each
        round of calls when one was refused for coming too often; then all of them pause. Such calls are made
        again, ``ATTEMPTS`` times in all. Without a bound a refused call is that row's outcome."""
        found = self.known().join(requests.select("key").distinct(), "key", "left_semi")
        columns = [c for c in requests.columns if c not in T.StructType.fromDDL(self.fields).names]
        open_ = requests.select(*columns).dropDuplicates(["key"]).join(self.known().select("key"), "key", "left_anti")
        run = f"{self.path}/runs/{uuid.uuid4().hex}"
        if max_concurrency is None:
            asked = open_.mapInPandas(self._asking(call), self.schema)
        else:
            tasks = -(-max_concurrency // CALLS_PER_TASK)
            together = self.spark.conf.get("spark.dynamicAllocation.enabled", "false") != "true"  # such clusters have no barriers
            asked = open_.repartition(tasks, "key").mapInPandas(self._asking(call, max_concurrency, tasks, together), self.schema, barrier=together)
        asked.write.parquet(run)
        made = self.spark.read.schema(self.schema).parquet(run)
        journal = f"{self.path}/journal"
        if exists(self.spark, journal):
            made.select("key").foreachPartition(_forgetting(journal))
        replies = made.drop("lasting").unionByName(found)
        return requests.select(*columns).join(replies, "key")

    def compact(self) -> None:
        """All lasting replies in one run; failures and the older folders go."""
        old = self.runs()
        if len(old) > 1:
            self.spark.read.schema(self.schema).parquet(*old).where("lasting").write.parquet(f"{self.path}/runs/{uuid.uuid4().hex}")
            for folder in old:
                removed(self.spark, folder)

    def _asking(self, call: Call, limit: int = 1, tasks: int = 1, together: bool = False):
        journal, names = f"{self.path}/journal", [f.name for f in self.schema.fields]
        kinds = {f.name: f.dataType.simpleString() for f in self.schema.fields}
        per_round = self.per_round

        def one(row: dict, final: bool) -> dict | None:
            """The reply, from the journal or by a call; None if the call is to be made again."""
            fs, base = opened(journal)
            place = _place(base, row["key"])
            try:
                with fs.open_input_stream(place) as f:
                    return json.loads(f.readall())
            except FileNotFoundError:
                pass
            try:
                values, lasting = call(row)
            except Limited as refused:
                if not final:
                    return None
                values, lasting = refused.values, False
            out = {"key": row["key"], "lasting": lasting, **values}
            put_whole(fs, place, json.dumps(out).encode())
            return out

        def rows_of(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[dict, int]]:
            for frame in frames:
                for r in frame.to_dict("records"):
                    yield {k: None if v is pd.NA or v != v else v for k, v in r.items()}, 1

        def framed(done: list[dict]) -> pd.DataFrame:
            return pd.DataFrame({n: pd.array([d.get(n) for d in done], _PANDAS.get(kinds[n], "object")) for n in names})

        def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            context = BarrierTaskContext.get() if together else None
            part = TaskContext.get().partitionId()
            threads = max(1, limit // tasks + (part % tasks < limit % tasks))
            source, again, left, pause = rows_of(frames), [], True, 0.0
            if context is not None:
                context.barrier()  # rounds begin together
            with ThreadPoolExecutor(threads) as pool:
                while left:
                    batch = again[: threads * per_round]
                    again = again[len(batch) :]
                    batch += list(islice(source, threads * per_round - len(batch)))
                    done = list(pool.map(lambda x: one(x[0], x[1] >= ATTEMPTS), batch)) if threads > 1 else [one(r, n >= ATTEMPTS) for r, n in batch]
                    refused = [(r, n + 1) for (r, n), d in zip(batch, done) if d is None]
                    again += refused
                    left, pause = bool(batch), max((PAUSE * (n - 1) for _, n in refused), default=0.0)
                    yield framed([d for d in done if d is not None])
                    if context is not None:
                        told = [json.loads(x) for x in context.allGather(json.dumps([left, pause]))]
                        left, pause = any(x for x, _ in told), max(x for _, x in told)
                    time.sleep(pause)

        return fn


#: Seconds that all tasks pause after a first refusal; after the second twice that.
PAUSE = 2.0
_PANDAS = {"string": "string", "bigint": "Int64", "int": "Int32", "boolean": "boolean", "double": "Float64"}


def _place(base: str, key: str) -> str:
    return f"{base}/{key[:2]}/{key}.json"


def _forgetting(journal: str):
    def fn(rows) -> None:
        fs, base = opened(journal)
        for row in rows:
            try:
                fs.delete_file(_place(base, row["key"]))
            except FileNotFoundError:
                pass

    return fn


def answered_once(prompts: DataFrame, provider: Provider, store: ReplyStore, configured: int) -> DataFrame:
    """As ``providers.answered``, but each task and prompt is asked once, and not at all where the store has
    its reply. Null prompts pass unanswered."""

    # The store repeats what was refused for coming too often; the provider need not.
    shared = dataclasses.replace(provider, retry_limited=False) if isinstance(provider, HttpProvider) else provider
    bound = concurrency_of(provider, configured)

    def call(row: dict) -> tuple[dict, bool]:
        try:
            return {"reply": shared(row["task"], row["prompt"]), "error": None}, True
        except Exception as e:  # a provider may fail in any way; each is one row's result
            values = {"reply": None, "error": str(e) or type(e).__name__}
            if bound is not None and is_limit(e):
                raise Limited(values) from None
            return values, False

    asked = prompts.where("prompt IS NOT NULL").withColumn("key", idempotency_key())
    replies = store.evaluated(asked.select("key", "task", "prompt").distinct(), call, bound).select("key", "reply", "error")
    keyed = prompts.withColumn("key", F.when(F.col("prompt").isNotNull(), idempotency_key()))
    return keyed.join(replies, "key", "left").drop("key")
