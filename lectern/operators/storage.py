"""Folders that driver and executors share, reached by Spark on the driver and by pyarrow in tasks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs as afs
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str = "") -> str:
    """A new folder's path below the one the cluster names in spark.checkpoint.dir; a temporary place only
    where none is named, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not base:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            base = held.get()
        elif sc.master.startswith("local[") or sc.master == "local":
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lectern-"))
            base = sc._jsc.sc().getCheckpointDir().get()
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base.rstrip('/')}/lectern/{name or 'flow'}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(sc._jsc.hadoopConfiguration()), p


def entries(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none where there is no such folder."""
    fs, p = _hadoop(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _hadoop(spark, path)
    return fs.exists(p)


def removed(spark: SparkSession, path: str) -> None:
    fs, p = _hadoop(spark, path)
    fs.delete(p, True)


def created(spark: SparkSession, path: str, text: str) -> bool:
    """Put a small file in place whole, unless one of that name is there; says whether it did."""
    fs, p = _hadoop(spark, path)
    fs.mkdirs(p.getParent())
    aside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    out.write(bytearray(text.encode()))
    out.close()
    folder = fs.resolvePath(p.getParent()).toUri()
    linked = _linked(folder.getPath(), aside.getName(), p.getName()) if folder.getScheme() == "file" else None
    # A rename onto a name that is taken fails, here or, where a store lets it pass, by the check before.
    if linked is None and not fs.exists(p) and fs.rename(aside, p):
        return True
    fs.delete(aside, False)
    return bool(linked)


def _linked(folder: str, name: str, other: str) -> bool | None:
    """Give a local file another name, unless that is taken, which a local rename would overwrite; none
    where a file has only one name."""
    try:
        os.link(f"{folder}/{name}", f"{folder}/{other}")
    except FileExistsError:
        return False
    except OSError:
        return None
    return True


def content(spark: SparkSession, path: str) -> str:
    fs, p = _hadoop(spark, path)
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def opened(path: str) -> tuple[afs.FileSystem, str]:
    """The file system of a path or address, for use in tasks."""
    if "://" in path or path.startswith("file:"):
        return afs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return afs.LocalFileSystem(), path


def put_whole(fs: afs.FileSystem, path: str, data: bytes) -> None:
    """A file that is there whole or not at all."""
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    aside = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(aside) as out:
        out.write(data)
    fs.move(aside, path)


@contextmanager
def kept(df: DataFrame, path: str) -> Iterator[DataFrame]:
    """``df`` written once and read back for what is done inside; the folder goes at the end."""
    spark = df.sparkSession
    df.write.parquet(path)
    try:
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        removed(spark, path)
