"""What tasks hold at once, and what plans do only once."""

import tracemalloc
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern import catalog
from lectern.functions import urls
from lectern.operators import batches, providers, sections, storage
from lectern.sources import file_sink, files

DATA = "/root/testdata/sf0.001"
MB = 1 << 20


class Traced:
    """Replies with the most bytes that Python's objects have taken since the first call in its process."""

    def __call__(self, task, prompt):
        if not tracemalloc.is_tracing():
            tracemalloc.start()
        peak = tracemalloc.get_traced_memory()[1]
        if prompt.startswith("last"):
            tracemalloc.stop()
        return str(peak)


def long_texts(spark, n=20000, chars=2000):
    """One task's texts, in two of Spark's batches of 20 MB; those of the second are traced, with what is made of it."""
    return spark.range(0, n, 1, 1).select(F.col("id").alias("doc_id"), F.when(F.col("id") == n - 1, "last").otherwise(F.concat("id", F.repeat(F.lit("x"), F.lit(chars)))).alias("text"))


def peak(replies, column="reply"):
    return replies.agg(F.max(F.col(column).cast("long"))).first()[0]


def test_pieces_keep_every_row_in_order():
    whole = [pa.record_batch({"x": pa.array(["a" * (i % 7) for i in range(n)], pa.string())}) for n in (0, 1, 1000)]
    got = list(batches.pieces(whole, 500))
    assert pa.Table.from_batches(got) == pa.Table.from_batches(whole) and max(b.num_rows for b in got) < 1000


def test_answering_holds_few_prompts(spark):
    prompts = long_texts(spark).select(F.lit("quotes").alias("task"), F.col("text").alias("prompt"))
    assert peak(providers.answered(prompts, Traced())) < 32 * MB


def test_upload_names_walk_each_text_once(spark):
    plan = catalog.queries()["upload_names"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("regexp_replace(") <= 2 and plan.count("_ascii_only(") <= 1


@pytest.mark.parametrize("raw", ["a b.PDF", " ./é ü/..c d_ _(x).txt", "..pdf", ".a.pdf", "a/.pdf", "", None, "a.b/c", "x\x1c\x85y\\z.docx", "___.txt", "日本.pptx", "a\n.pdf", "a.tar.docx.", "..a.txt"])
def test_upload_names_by_steps_are_those_of_one_expression(spark, raw):
    df = spark.createDataFrame([(raw,)], "raw string")
    shown = lambda n: F.regexp_replace(n, "^file_[0-9a-f]{32}", "made up")
    one = df.select(urls.extension(F.col("raw")).alias("ext"), shown(urls.upload_name(F.col("raw"))).alias("name")).first()
    assert urls.with_upload_name(df, "raw").select("ext", shown(F.col("name")).alias("name")).first() == one
    rule = F.lower(F.regexp_extract(F.coalesce("raw", F.lit("")), r"(?s)^(?:.*/)?\.*[^./][^/]*?(\.[^./]*)\z", 1))
    assert df.select(rule.alias("ext")).first().ext == one.ext


def test_ask_protocol_asks_once_and_shuffles_once(spark):
    plan = catalog.queries()["ask_protocol"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapIn") == 1 and "Join" not in plan and "Window" not in plan


def test_summaries_hold_few_texts(spark):
    assert peak(sections.summaries(long_texts(spark), Traced())) < 32 * MB


def test_sink_copies_no_batch(tmp_path):
    texts = [b"x" * 4000] * 5000
    batch = pa.record_batch({"name": [f"{i}.txt" for i in range(len(texts))], "content": pa.array(texts, pa.binary())})
    sink = file_sink.FileSink({"path": str(tmp_path)}).writer(None, False)
    tracemalloc.start()
    try:
        sink.commit([sink.write(iter([batch]))])
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 12 * MB and {Path(tmp_path, f"{i}.txt").read_bytes() for i in (0, 4999)} == {texts[0]}


def test_the_driver_knows_of_no_saved_file(spark):
    """A scan of files holds each one's address there, nearly a kilobyte."""
    made = catalog.queries()["saved_files"](spark, DATA)
    assert made.count() > 150 and len(made.inputFiles()) < 10


def test_files_are_read_back_by_pieces(tmp_path):
    for i in range(500):
        Path(tmp_path, f"{i}.txt").write_bytes(b"%d" % i * 20_000)
    fs, base = storage.opened(str(tmp_path))
    tracemalloc.start()
    try:
        n = sum(batch.num_rows for batch in file_sink._read(fs, file_sink._files(fs, base)))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 500 and most < 6 * MB


def test_extraction_holds_few_files(spark):
    traced = Traced()
    rows = long_texts(spark).select(F.col("doc_id").cast("string").alias("path"), F.lit(".txt").alias("ext"), F.encode("text", "UTF-8").alias("content"))
    assert peak(files.extracted(rows, {".txt": lambda raw: traced("", raw.decode())}), "raw_text") < 32 * MB


def test_streamed_sections_hold_few_prompts(spark):
    replies = sections.streamed_replies(long_texts(spark), Traced(), ["summary", "quotes"])
    assert peak(replies.where("name <> 'done'")) < 32 * MB
