"""Helpers the training-data operators share: tables, cuts of lineage, fixed text rules."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word or is stripped from a line: space, \t, \n, \v, \f, \r.
SPACE = r"\x20\x09-\x0D"


_scopes: list[list[DataFrame]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the cluster names it; a temporary one only where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
    return sc._jsc.sc().getCheckpointDir().get()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder and read back: later jobs neither recompute it nor
    lose it with an executor. The folder goes when ``dropped`` is called on the result."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lectern/{uuid.uuid4().hex}"
    df.write.parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    if _scopes:
        _scopes[-1].append(out)
    return out


def bucketed(df: DataFrame, key: str) -> DataFrame:
    """``df`` as a table in the shared folder with one file for each bucket of ``key``: joins on the key
    read it in place. A temporary name in the session's catalogue stands for it."""
    spark = df.sparkSession
    n, name = partitions(spark), f"lectern_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/lectern/{name}"
    df.repartition(n, key).write.bucketBy(n, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._lectern_path, out._lectern_table = path, name
    if _scopes:
        _scopes[-1].append(out)
    return out


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """What is ``stored`` or ``bucketed`` inside goes at the end, but for the frames put in the list."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.pop()
        dropped(*[df for df in made if not any(df is k for k in kept)])
        if _scopes:
            _scopes[-1].extend(kept)


def dropped(*frames: DataFrame) -> None:
    """Delete what ``stored`` or ``bucketed`` wrote for these; nothing may read them afterwards."""
    for df in frames:
        if name := getattr(df, "_lectern_table", None):
            df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._lectern_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """Runs of anything but SPACE, in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def crc_mod(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % n
