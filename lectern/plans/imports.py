"""Import of found papers: guards, download, extraction, analysis, and a session for each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.config import Settings
from lectern.functions.text import cleaned, filled, is_true, stripped
from lectern.functions.urls import extension, with_import_name
from lectern.operators.providers import Provider
from lectern.operators.storage import shared_folder
from lectern.plans import pipelines
from lectern.sources.file_sink import saved
from lectern.sources.files import extracted
from lectern.sources.papers_api import downloaded, resolved

#: Status codes of requests that are refused or fail.
BAD_REQUEST, FORBIDDEN, BROKEN = 400, 403, 500


def request_status(error: Column) -> Column:
    """The status a request with this error gets; null error: 200. Missing or wrong tokens are forbidden, what
    the caller can mend is a bad request, and the rest is ours."""
    mendable = r"^(session id required|session not found|no question|no document|empty query|address required|no API key|.*not (?:a direct file|public|a file).*|empty file|larger than .*|unknown file type|unsupported .*|could not read .*|the (?:file|source|download) .*|secure connection failed.*)$"
    return F.when(error.isNull(), 200).when(error == "session token invalid", FORBIDDEN).when(error.rlike(mendable), BAD_REQUEST).otherwise(BROKEN)


def imported(papers: DataFrame, provider: Provider, settings: Settings = Settings(), folder: str | None = None, fetch: Callable[[DataFrame], DataFrame] = downloaded) -> DataFrame:
    """paper_id, source_filename, char_count, summary, quotes, mindmap, mermaid, evaluation, sections, error,
    status for every row of ``papers`` (paper_id, title, url, pdf_url, and optionally generate_mermaid and
    generate_evaluation, on unless they say no).

    A paper's addresses are tried in order until one gives a usable file (``resolved``); files are put into
    ``folder`` under their paper's name by a write that commits as a whole, read back, extracted and analysed.
    Papers without an address, without a usable file or with one that can't be read have only ``error`` and
    ``status``. Rows of one paper_id are one paper."""
    spark = papers.sparkSession
    folder = (folder or shared_folder(spark, "imports")).rstrip("/")
    one = papers.groupBy("paper_id").agg(F.min_by(F.struct(*papers.columns), F.struct("pdf_url", "url", "title")).alias("p")).select("p.*")
    linked = (stripped(filled(F.col("pdf_url"))) != "") | (stripped(filled(F.col("url"))) != "")
    got = resolved(one.where(linked).select("paper_id", "pdf_url", "url"), folder=f"{folder}/tries", fetch=fetch)
    # Names are made of what little they need and written before any content moves.
    files = got.where("error IS NULL")
    titled = files.select("paper_id", "link", "content_type", "disposition").join(one.select("paper_id", "title"), "paper_id")
    ext = extension(F.col("source_filename"))
    # Files are named by paper: two papers may have files of one name.
    named = with_import_name(titled).select("paper_id", "source_filename", ext.alias("ext"), F.concat(F.sha2(F.col("paper_id").cast("string"), 256), ext).alias("name"))
    named.write.parquet(f"{folder}/names")
    held = files.select("paper_id", "content").join(spark.read.schema(named.schema).parquet(f"{folder}/names"), "paper_id")
    held.write.parquet(f"{folder}/named")
    held = spark.read.schema(held.schema).parquet(f"{folder}/named")
    saved(held.select("name", "content"), f"{folder}/files")
    read = extracted(held.select(F.col("paper_id").cast("string").alias("path"), "ext", "content")).select("path", cleaned(F.col("raw_text")).alias("text"), "error")
    read.write.parquet(f"{folder}/texts")
    read = spark.read.schema(read.schema).parquet(f"{folder}/texts")
    wanted = lambda c: is_true(F.col(c).cast("string"), True) if c in papers.columns else F.lit(True)
    flags = one.select(F.col("paper_id").cast("string").alias("path"), wanted("generate_mermaid").alias("mermaid"), wanted("generate_evaluation").alias("evaluation"))
    docs = read.where("error IS NULL").join(flags, "path").select(F.col("path").alias("doc_id"), "text", "mermaid", "evaluation")
    # One analysis for each pair of wishes that there is, four at most.
    done = None
    for mermaid, evaluation in sorted(tuple(r) for r in flags.select("mermaid", "evaluation").distinct().collect()):
        part = docs.where((F.col("mermaid") == mermaid) & (F.col("evaluation") == evaluation)).select("doc_id", "text")
        made = pipelines.analyse(part, provider, settings, mermaid, evaluation)
        done = made if done is None else done.unionByName(made)
    failed = got.select(F.col("paper_id").cast("string").alias("doc_id"), "error").where("error IS NOT NULL").unionByName(read.where("error IS NOT NULL").select(F.col("path").alias("doc_id"), "error"))
    none = one.where(~linked).select(F.col("paper_id").cast("string").alias("doc_id"), F.lit("address required").alias("error"))
    refused = failed.unionByName(none)
    done = pipelines.analyse(docs.select("doc_id", "text"), provider, settings) if done is None else done
    every = done.unionByName(refused, allowMissingColumns=True)
    back = one.select("paper_id").join(held.select("paper_id", "source_filename"), "paper_id", "left").withColumn("doc_id", F.col("paper_id").cast("string"))
    return back.join(every, "doc_id").drop("doc_id").withColumn("status", request_status(F.col("error")))
