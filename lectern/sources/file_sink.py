"""A sink of files: one for each row, put in place only when the whole write is committed.

``df.write.format("lectern_files").mode("append").save(path)`` takes rows of name and content. Tasks write
below a staging folder of their own; the commit moves what the tasks that counted have written, and an
abort deletes the folder, so a write that fails leaves nothing, and one that is repeated puts the same
files in the same places. What a task tells the driver is one path, however many files it wrote.

With ``option("spread", True)`` files lie in 256 folders by a hash of their names. Those are read back by
``stored``, whose tasks list the folders; Spark's own scan of files holds all their addresses on the driver.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as afs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from lectern.functions.urls import MAX_FILE_BYTES
from lectern.operators.batches import PIECE_BYTES
from lectern.operators.storage import opened

STAGING = ".staging"
STEP = 64 * 1024
#: Of a spread write; fixed, so that a name has one place.
FOLDERS = [f"{k:02x}" for k in range(256)]
#: How many files at most are read into one batch.
PIECE_FILES = 1000


@dataclass
class Staged(WriterCommitMessage):
    folder: str
    n: int


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lectern_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.limit = int(options.get("limit", MAX_FILE_BYTES))
        self.spread = options.get("spread", "false").lower() == "true"
        self.overwrite, self.job = overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        """Contents are written from the batches as they came: as rows they would be copied, a batch at a time."""
        fs, base = opened(self.path)
        folder, made, n = f"{base}/{STAGING}/{self.job}/{uuid.uuid4().hex}", set(), 0
        for batch in iterator:
            for held, raw in zip(batch.column("name"), batch.column("content")):
                name, content = held.as_py(), memoryview(raw.as_buffer() if raw.is_valid else b"")
                problem = _problem(name, content, self.limit)
                if problem:
                    raise ValueError(f"{name}: {problem}")
                place = f"{folder}/{_folder(name)}" if self.spread else folder
                if place not in made:
                    fs.create_dir(place, recursive=True)
                    made.add(place)
                with fs.open_output_stream(f"{place}/{name}", compression=None) as out:
                    for at in range(0, len(content), STEP):
                        out.write(content[at : at + STEP])
                n += 1
        return Staged(folder, n)

    def commit(self, messages: list) -> None:
        fs, base = opened(self.path)
        places = {f"/{k}": f"{base}/{k}" for k in FOLDERS} if self.spread else {"": base}
        for place in places.values():
            fs.create_dir(place, recursive=True)
        if self.overwrite:
            for place in {base, *places.values()}:
                for old in _files(fs, place):
                    fs.delete_file(old.path)
        for message in messages:
            if message is not None and message.n:
                for sub, place in places.items():
                    for made in _files(fs, message.folder + sub):
                        fs.move(made.path, f"{place}/{made.base_name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, base = opened(self.path)
        for folder, keep in ((f"{base}/{STAGING}/{self.job}", False), (f"{base}/{STAGING}", True)):
            info = fs.get_file_info(folder)
            if info.type == afs.FileType.Directory and not (keep and fs.get_file_info(afs.FileSelector(folder))):
                fs.delete_dir(folder)


def _folder(name: str) -> str:
    return FOLDERS[zlib.crc32(name.encode()) % len(FOLDERS)]


def _files(fs: afs.FileSystem, folder: str) -> list[afs.FileInfo]:
    return [x for x in fs.get_file_info(afs.FileSelector(folder, allow_not_found=True)) if x.type == afs.FileType.File]


def _problem(name: str | None, content: memoryview, limit: int) -> str | None:
    if not name or "/" in name or name in (".", "..", STAGING):
        return "not a file name"
    if not content:
        return "empty file"
    return f"larger than {limit} bytes" if len(content) > limit else None


def file_problem(name: Column, content: Column, limit: int = MAX_FILE_BYTES) -> Column:
    """Why a row can't be a file, or null; as the sink itself sees it."""
    size = F.octet_length(content)
    bad = F.coalesce(name, F.lit("")).isin("", ".", "..", STAGING) | F.contains(name, F.lit("/"))
    return F.when(bad, "not a file name").when(F.coalesce(size, F.lit(0)) == 0, "empty file").when(size > limit, f"larger than {limit} bytes")


def saved(files: DataFrame, path: str, limit: int = MAX_FILE_BYTES, spread: bool = False) -> DataFrame:
    """Puts the rows of ``files`` (name, content) that can be files in place and returns the others, with
    ``error``. Names should differ: of rows of one name, one is kept."""
    spark: SparkSession = files.sparkSession
    spark.dataSource.register(FileSink)
    checked = files.withColumn("error", file_problem(F.col("name"), F.col("content"), limit))
    good = checked.where("error IS NULL").select("name", "content")
    good.write.format("lectern_files").option("limit", limit).option("spread", spread).mode("append").save(path)
    return checked.where("error IS NOT NULL").drop("content")


def saved_texts(texts: DataFrame, path: str, name: Column, text: Column, spread: bool = False) -> DataFrame:
    """One UTF-8 file for each row: reports, sessions and diagrams as files. Returns the rows that can't be."""
    return saved(texts.select(name.alias("name"), F.encode(text, "UTF-8").alias("content")), path, spread=spread)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """name, length, content of every file that spread writes put in place. A task lists one folder at a time
    and holds about 2 MB of contents, or one file; the driver knows of no file."""
    path = path.rstrip("/")

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = opened(path)
        if fs.get_file_info(base).type != afs.FileType.Directory:
            raise FileNotFoundError(path)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                yield from _read(fs, _files(fs, f"{base}/{FOLDERS[k]}"))

    tasks = min(len(FOLDERS), 4 * spark.sparkContext.defaultParallelism)
    return spark.range(0, len(FOLDERS), 1, tasks).mapInArrow(fn, "name string, length long, content binary")


def _read(fs: afs.FileSystem, files: list[afs.FileInfo]) -> Iterator[pa.RecordBatch]:
    names, contents, held = [], [], 0

    def batch() -> pa.RecordBatch:
        lengths = pa.array([len(c) for c in contents], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), lengths, pa.array(contents, pa.binary())], names=["name", "length", "content"])

    for file in files:
        if names and (held + file.size > PIECE_BYTES or len(names) == PIECE_FILES):
            yield batch()
            names, contents, held = [], [], 0
        with fs.open_input_file(file.path) as raw:
            contents.append(raw.read())
        names.append(file.base_name)
        held += len(contents[-1])
    if names:
        yield batch()
