"""Literature searches as a Spark source: ``spark.read.format("lectern_papers")``.

The queries and the limit are filters on the columns ``query`` and ``limit``, which the source takes over:
one call for each query, in tasks, as many as ``calls`` at once. Options: source (scholar or atom), timeout,
attempts, api_key, url (another address of the same interface), calls. Spark hands filters to Python sources
where spark.sql.python.filterPushdown.enabled is set. A scan is one set of calls; what is to be read more
than once is read through ``papers_api.fetched``, which keeps the replies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from lectern.config import Settings
from lectern.operators.papers import DEFAULT_LIMIT, MAX_LIMIT
from lectern.sources.papers_api import atom_records, outcome_of, request_of, scholar_records

PUSHDOWN = ("spark.sql.python.filterPushdown.enabled", "true")


@dataclass
class Queries(InputPartition):
    queries: list[str]


class PaperSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_papers"

    def schema(self) -> str:
        return "query string, limit int, body string, status long, reason string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        defaults = Settings()
        self.source, self.url, self.api_key = options.get("source", "scholar"), options.get("url"), options.get("api_key", "")
        self.timeout, self.attempts = int(options.get("timeout", defaults.scholar_timeout)), int(options.get("attempts", defaults.scholar_retries))
        self.calls = int(options.get("calls", defaults.max_concurrency))
        self.queries: set[str] | None = None
        self.limit: int | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("query",):
                self._only({f.value})
            elif isinstance(f, In) and f.attribute == ("query",):
                self._only(set(f.value))
            elif isinstance(f, EqualTo) and f.attribute == ("limit",) and self.limit in (None, f.value):
                self.limit = f.value
            else:
                yield f

    def _only(self, queries: set) -> None:
        queries = {q for q in queries if q is not None}
        self.queries = queries if self.queries is None else self.queries & queries

    def partitions(self) -> list[InputPartition]:
        if self.queries is None:
            raise ValueError("lectern_papers needs a filter: query = ... or query in (...)")
        each = sorted(q for q in self.queries if q.strip())
        return [Queries(each[k :: self.calls]) for k in range(min(self.calls, len(each)))] or [Queries([])]

    def read(self, partition: Queries) -> Iterator[tuple]:
        limit = DEFAULT_LIMIT if self.limit is None else self.limit
        for query in partition.queries:
            asked = max(1, min(MAX_LIMIT, limit))
            yield query, limit, *outcome_of(*request_of(self.source, query, asked, self.api_key, self.url), self.timeout, self.attempts)


def papers_of(spark: SparkSession, queries: list[str], limit: int = DEFAULT_LIMIT, **options: str) -> tuple[DataFrame, DataFrame]:
    """(records with ``query``, failed calls) of a few searches, each called once a scan of either."""
    spark.dataSource.register(PaperSource)
    spark.conf.set(*PUSHDOWN)
    rows = spark.read.format("lectern_papers").options(**options).load().where(F.col("query").isin(queries) & (F.col("limit") == limit))
    parse = atom_records if options.get("source") == "atom" else scholar_records
    return parse(rows.select(F.col("query").alias("query_id"), "body")).withColumnRenamed("query_id", "query"), rows.where("body IS NULL").select("query", "status", "reason")
