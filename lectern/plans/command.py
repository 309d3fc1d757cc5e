"""The command-line run, for spark-submit or ``python -m lectern``: files in, reports and sessions out."""

from __future__ import annotations

import argparse
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import __version__
from lectern.config import Settings, api_key
from lectern.functions.render import analysis_report, command_report
from lectern.operators.providers import HttpProvider, OfflineProvider, Provider
from lectern.operators.session_store import SessionStore
from lectern.operators.sessions import new_token, sessions_of
from lectern.plans import pipelines
from lectern.sources.file_sink import saved_texts
from lectern.sources.files import read_documents
from lectern.operators.storage import shared_folder


def analysed_files(spark: SparkSession, path: str, provider: Provider, settings: Settings = Settings(), mermaid: bool = False, evaluation: bool = False) -> tuple[DataFrame, DataFrame]:
    """(analyses by path, rejects) of the files below a path, which are read and analysed once, here. Files
    without text are rejects."""
    good, bad = read_documents(spark, path, reject_empty=True)
    folder = shared_folder(spark, "run")
    for name, df in (("texts", good), ("rejects", bad)):
        df.write.parquet(f"{folder}/{name}")
    texts = spark.read.schema(good.schema).parquet(f"{folder}/texts")
    rejects = spark.read.schema(bad.schema).parquet(f"{folder}/rejects")
    made = pipelines.analyse(texts.select(F.col("path").alias("doc_id"), "text"), provider, settings, mermaid, evaluation)
    made = made.join(texts.select(F.col("path").alias("doc_id"), "source_filename", "text"), "doc_id").withColumnRenamed("doc_id", "path")
    made.write.parquet(f"{folder}/made")
    done = spark.read.schema(made.schema).parquet(f"{folder}/made")
    return done.where("error IS NULL"), rejects.unionByName(done.where("error IS NOT NULL").select("path", "error"))


def run(spark: SparkSession, path: str, out: str | None, provider: Provider, settings: Settings = Settings(), now: datetime | None = None) -> tuple[DataFrame, DataFrame]:
    """The offline command's run: summary, quotes and structure of each file; with ``out`` a report for each."""
    now = now or datetime.now()
    done, rejects = analysed_files(spark, path, provider, settings)
    if out is not None:
        mode, model = ("offline", "none") if isinstance(provider, OfflineProvider) else ("full", settings.model)
        text = command_report(done, __version__, F.lit(now).cast("timestamp_ntz"), mode, model, settings.max_concurrency)
        saved_texts(done, out, _report_name(now), text)
    return done, rejects


def run_sessions(spark: SparkSession, path: str, store: SessionStore, out: str, provider: Provider, settings: Settings = Settings(), now: datetime | None = None, mermaid: bool = True, evaluation: bool = True) -> tuple[DataFrame, DataFrame]:
    """The service's way with saved files: expired sessions are cleaned up first, each file is analysed, its
    report put into ``out``, and a fresh session with a token appended. (path, session_id, token) of the new
    sessions, and rejects. Only the tokens' hashes are stored."""
    now = now or datetime.now()
    at = F.lit(now).cast("timestamp_ntz")
    store.cleanup(now, settings.cleanup_interval)
    done, rejects = analysed_files(spark, path, provider, settings, mermaid, evaluation)
    saved_texts(done, out, _report_name(now), analysis_report(done, __version__, at, evaluation, done["elapsed_seconds"]))
    # Tokens are made in tasks and kept, so that what is stored is the hash of what is returned.
    token = F.udf(lambda _: new_token(), "string").asNondeterministic()
    named = done.select("path", F.replace(F.uuid(), F.lit("-"), F.lit("")).alias("session_id"), token(F.col("path")).alias("token"), "source_filename", F.col("text").alias("document"),
                        F.struct("summary", "quotes", "mindmap", "mermaid", "evaluation", "sections", "char_count", "elapsed_seconds").alias("made"))
    folder = shared_folder(spark, "sessions")
    named.write.parquet(folder)
    named = spark.read.schema(named.schema).parquet(folder)
    fresh = sessions_of(named, at, settings.session_ttl, settings.persist_full_document)
    kind = store.fields["analysis"].dataType
    analysis = F.struct(*[(F.col(f"made.{f.name}") if f.name in named.schema["made"].dataType.names else F.lit(None)).cast(f.dataType).alias(f.name) for f in kind.fields])
    store.append(fresh.join(named.select("session_id", analysis.alias("analysis")), "session_id").withColumn("generated_at", at), now=at, ttl=settings.session_ttl)
    return named.select("path", "session_id", "token"), rejects


def _report_name(now: datetime):
    """Reports differ in name however many are made of one name in one second."""
    stem = F.regexp_replace("source_filename", r"\.[^.]+$", "")
    return F.concat(stem, F.lit(f"_{now:%Y%m%d_%H%M%S}_"), F.left(F.sha2("path", 256), F.lit(8)), F.lit(".md"))


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser("lectern", description="Analyse documents: summary, quotes and structure of each.")
    parser.add_argument("path", help="file or folder of txt, docx, pptx or pdf")
    parser.add_argument("--out", help="folder for one report each")
    parser.add_argument("--offline", action="store_true", help="the deterministic provider, whatever the environment says")
    given = parser.parse_args(args)
    settings, key = Settings.load(), api_key(None)
    metered = bool(key and settings.base_url) and not given.offline
    provider = HttpProvider(settings.base_url, key, settings.model, settings.request_timeout, settings.max_retries) if metered else OfflineProvider()
    spark = SparkSession.builder.appName("lectern").getOrCreate()
    done, rejects = run(spark, given.path, given.out, provider, settings)
    done.select("path", "char_count", "summary").show(truncate=120)
    bad = rejects.count()
    rejects.show(truncate=120) if bad else None
    return int(bad > 0)
