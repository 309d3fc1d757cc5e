"""Paper sources: replies staged as files, or fetched in tasks; parsed by Spark either way."""

from __future__ import annotations

import ssl
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.urls import MAX_FILE_BYTES, content_type, download_candidates, is_direct_file, is_inner, is_public_http, looks_like_html, type_extension
from lectern.operators.papers import ATOM_ITEM, SCHOLAR_ITEM, download_error, from_atom, from_scholar
from lectern.operators.replies import Limited, ReplyStore
from lectern.operators.storage import shared_folder

SCHOLAR_URL = "https://api.semanticscholar.org/graph/v1/paper/search"
ATOM_URL = "http://export.arxiv.org/api/query"
#: Fixed value: the fields a search asks for.
SCHOLAR_FIELDS = "title,abstract,year,venue,url,authors,openAccessPdf,paperId"


def trusted_context() -> ssl.SSLContext:
    try:
        import certifi

        return ssl.create_default_context(cafile=certifi.where())
    except ImportError:
        return ssl.create_default_context()


def get(url: str, timeout: int, headers: dict[str, str] | None = None, attempts: int = 3, retry_limited: bool = True) -> str:
    """Repeats after 429 (with ``retry_limited``) and after failures to connect, waiting longer each time; other replies raise."""
    for attempt in range(attempts):
        try:
            with urllib.request.urlopen(urllib.request.Request(url, headers=headers or {}), timeout=timeout, context=trusted_context()) as reply:
                return reply.read().decode("utf-8", "replace")
        except urllib.error.HTTPError as error:
            if error.code != 429 or not retry_limited or attempt + 1 == attempts:
                raise
        except (urllib.error.URLError, TimeoutError, OSError):
            if attempt + 1 == attempts:
                raise
        time.sleep(min(2 * (attempt + 1), 6))
    raise AssertionError("attempts must be positive")


#: The columns of a call's outcome.
OUTCOME = "body string, status long, reason string"
AGENT = {"User-Agent": "lectern"}


def request_of(source: str, query: str, limit: int, api_key: str = "", base: str | None = None) -> tuple[str, dict[str, str]]:
    """Address and headers of one search."""
    if source == "scholar":
        args = {"query": query, "limit": limit, "fields": SCHOLAR_FIELDS}
        return f"{base or SCHOLAR_URL}?{urllib.parse.urlencode(args)}", AGENT | ({"x-api-key": api_key} if api_key else {})
    return f"{base or ATOM_URL}?{urllib.parse.urlencode({'search_query': f'all:{query}', 'start': 0, 'max_results': limit})}", AGENT


def outcome_of(url: str, headers: dict[str, str], timeout: int, attempts: int, retry_limited: bool = True) -> tuple[str | None, int | None, str | None]:
    """(body, status, reason); a source that can't be reached or refuses is data too."""
    try:
        return get(url, timeout, headers, attempts, retry_limited), None, None
    except urllib.error.HTTPError as e:
        return None, e.code, str(e.reason)
    except Exception as e:  # whatever keeps a reply from coming is its row's result
        return None, None, str(e) or type(e).__name__


def fetched(queries: DataFrame, source: str, timeout: int = 20, attempts: int = 3, api_key: str = "", store: ReplyStore | None = None, base: str | None = None, max_concurrency: int | None = None) -> DataFrame:
    """query_id, body, status, reason for rows of query_id, query, limit. Queries alike are one call; what the
    store has of earlier runs is not called again, and what is read here comes from the store, however many
    plans read it."""
    store = store or ReplyStore(queries.sparkSession, OUTCOME)

    def call(row: dict) -> tuple[dict, bool]:
        url, headers = request_of(source, row["query"], int(row["limit"]), api_key, base)
        body, status, reason = outcome_of(url, headers, timeout, attempts, retry_limited=max_concurrency is None)
        values = {"body": body, "status": status, "reason": reason}
        if status == 429 and max_concurrency is not None:
            raise Limited(values)
        return values, body is not None

    key = F.sha2(F.concat_ws("\x1f", F.lit(source), F.col("limit").cast("string"), "query"), 256)
    keyed = queries.select("query_id", "query", "limit", key.alias("key"))
    replies = store.evaluated(keyed.select("key", "query", "limit").distinct(), call, max_concurrency)
    return keyed.select("query_id", "key").join(replies.select("key", "body", "status", "reason"), "key").drop("key")


def scholar_records(replies: DataFrame, src_ord: int = 0) -> DataFrame:
    """Paper records of JSON replies (query_id, body), in reply order; bad JSON has none."""
    parsed = F.from_json("body", f"struct<data:array<{SCHOLAR_ITEM}>>")["data"]
    items = replies.select("query_id", F.posexplode(parsed).alias("pos", "item"))
    return from_scholar(items).withColumn("src_ord", F.lit(src_ord))


def atom_records(replies: DataFrame, src_ord: int = 1) -> DataFrame:
    """Paper records of Atom replies (query_id, body)."""
    plain = F.regexp_replace("body", r"(?s)<\?xml.*?\?>", "")
    parsed = F.from_xml(plain, f"struct<entry:array<{ATOM_ITEM}>>", {"ignoreNamespace": "true"})["entry"]
    items = replies.select("query_id", F.posexplode(parsed).alias("pos", "item"))
    return from_atom(items).withColumn("src_ord", F.lit(src_ord))


def live_sources(timeout: int = 20, attempts: int = 3, api_key: str = "", store: ReplyStore | None = None, bases: dict[str, str] | None = None, max_concurrency: int | None = None):
    """The two sources as ``pipelines.searched`` fetches them: records, and failed calls by source. Each is
    called once for a query and limit."""

    def fetch(queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        held = store or ReplyStore(queries.sparkSession, OUTCOME)
        # Fixed value: the second source is tried twice only.
        tries = {"scholar": attempts, "atom": min(attempts, 2)}
        one, two = (fetched(queries, s, timeout, tries[s], api_key if s == "scholar" else "", held, (bases or {}).get(s), max_concurrency) for s in tries)
        records = scholar_records(one).unionByName(atom_records(two))
        failed = one.withColumn("source", F.lit("Semantic Scholar")).unionByName(two.withColumn("source", F.lit("arXiv")))
        return records, failed.where("body IS NULL").select("query_id", "source", "status", "reason")

    return fetch


def staged(spark: SparkSession, path: str) -> DataFrame:
    """Replies kept as files named <query_id>.json or .xml."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.regexp_extract("path", r"(\d+)\.[a-z]+$", 1).cast("long").alias("query_id"), F.decode("content", "UTF-8").alias("body"))


def import_candidates(papers: DataFrame) -> DataFrame:
    """One row per address to try, in order: guards run here, before any call. ``refused`` says why not."""
    each = papers.select("*", F.posexplode(download_candidates(F.col("pdf_url"), F.col("url"))).alias("ord", "c")).select("*", "c.link", "c.direct_only").drop("c")
    refused = F.when(~is_public_http(F.col("link")), "address not public").when(F.col("direct_only") & ~is_direct_file(F.col("link")), "not a direct file")
    return each.withColumn("refused", refused)


class _Guarded(urllib.request.HTTPRedirectHandler):
    """Redirects only lead to public http(s) addresses, as the first address had to."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        parts = urllib.parse.urlparse(newurl)
        name = (parts.hostname or "").lower()
        if parts.scheme not in ("http", "https") or not name or name in ("localhost", "localhost.localdomain") or is_inner(name):
            raise ValueError("redirected to an address that is not public")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def capped(reply, limit: int, step: int = 64 * 1024) -> bytes:
    """A reply's bytes by chunks; what is larger than ``limit`` or empty raises."""
    parts, total = [], 0
    while part := reply.read(step):
        total += len(part)
        if total > limit:
            raise ValueError("larger than 16 MiB")
        parts.append(part)
    if not total:
        raise ValueError("empty file")
    return b"".join(parts)


def downloaded(candidates: DataFrame, timeout: int = 30, limit: int = MAX_FILE_BYTES, key: str = "paper_id", open_url=None) -> DataFrame:
    """(key, ord, link, content_type, disposition, content, error) of ``import_candidates``, each address
    tried in a task. Refused ones stay errors; a file is held up to ``limit`` bytes."""
    kind = candidates.schema[key].dataType.simpleString()

    def opened(link: str):
        opener = urllib.request.build_opener(_Guarded(), urllib.request.HTTPSHandler(context=trusted_context()))
        return opener.open(urllib.request.Request(link, headers={"User-Agent": "lectern"}), timeout=timeout)

    def one(link: str, refused: str | None) -> tuple:
        if refused is not None:
            return link, None, None, None, None, refused
        try:
            with (open_url or opened)(link) as reply:
                ctype = reply.headers.get("Content-Type") or ""
                if ctype.lower().startswith("text/html"):
                    raise ValueError("a web page, not a file")
                return reply.geturl() or link, ctype, reply.headers.get("Content-Disposition"), capped(reply, limit), None, None
        except urllib.error.HTTPError as e:
            return link, None, None, None, e.code, str(e.reason)
        except Exception as e:  # a file that can't be had is an error row
            return link, None, None, None, None, str(e) or type(e).__name__

    def fn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for k, ord_, link, refused in zip(f[key], f["ord"], f["link"], f["refused"]):
                row = pd.DataFrame([(k, ord_, *one(link, refused))], columns=[key, "ord", "link", "content_type", "disposition", "content", "status", "reason"])
                yield row.astype({"status": "Int64", "content_type": "string", "disposition": "string", "reason": "string"})

    got = candidates.select(key, "ord", "link", "refused").mapInPandas(fn, f"`{key}` {kind}, ord int, link string, content_type string, disposition string, content binary, status long, reason string")
    own = F.when(F.col("status").isNotNull() | F.upper("reason").contains("CERTIFICATE"), download_error(F.col("status"), F.col("reason"))).otherwise(F.col("reason"))
    return got.select(key, "ord", "link", "content_type", "disposition", "content", own.alias("error"))


def usable_download(reply: DataFrame) -> DataFrame:
    """Replies (link, content_type, content) with ``error`` where they can't be a document."""
    ext = F.coalesce(F.nullif(F.lower(F.regexp_extract("link", r"(?i)\.(?:txt|pdf|docx|pptx)(?=$|[?#])", 0)), F.lit("")), F.nullif(type_extension(F.col("content_type")), F.lit("")))
    size = F.octet_length("content")
    error = (
        F.when(size == 0, "empty file").when(size > MAX_FILE_BYTES, "larger than 16 MiB")
        .when(content_type(F.col("content_type")).isin("text/html", "application/xhtml+xml") | looks_like_html(F.decode(F.substring("content", 1, 64), "ISO-8859-1")), "a web page, not a file")
        .when(ext.isNull(), "unknown file type")
    )
    return reply.withColumn("error", error)


def first_usable(tries: DataFrame, key: str = "paper_id") -> DataFrame:
    """Per paper the first address without error; where all failed, the last error."""
    best = F.min_by("link", F.when(F.col("error").isNull(), F.col("ord")))
    return tries.groupBy(key).agg(best.alias("link"), F.max_by("error", "ord").alias("last_error")).select(key, "link", F.when(F.col("link").isNull(), F.col("last_error")).alias("error"))


def resolved(papers: DataFrame, key: str = "paper_id", folder: str | None = None, fetch: Callable[[DataFrame], DataFrame] = downloaded) -> DataFrame:
    """(key, link, content_type, disposition, content, error) per paper with an address: its addresses are
    tried in order, the next only where all before failed. Round by round, as many as one paper has
    addresses; each round's outcomes are written once, and the next leaves out what they resolved. Where all
    failed, the last error. ``papers``: key, pdf_url, url; rows of one key are one paper, the first row's."""
    spark = papers.sparkSession
    folder = folder or shared_folder(spark, "imports")
    one = papers.groupBy(key).agg(F.min_by(F.struct("pdf_url", "url"), F.struct("pdf_url", "url")).alias("p")).select(key, "p.*")
    tries = import_candidates(one).select(key, "ord", "link", "refused")
    schema = f"`{key}` {papers.schema[key].dataType.simpleString()}, ord int, link string, content_type string, disposition string, content binary, error string"
    seen = lambda n: spark.read.schema(schema).parquet(*[f"{folder}/round={k}" for k in range(n)])
    for at in range((tries.agg(F.max("ord")).first()[0] or 0) + 1):
        now = tries.where(F.col("ord") == at)
        if at:
            now = now.join(seen(at).where("error IS NULL").select(key), key, "left_anti")
        checked = usable_download(fetch(now).withColumnRenamed("error", "failed")).withColumn("error", F.coalesce("failed", "error"))
        content = F.when(F.col("error").isNull(), F.col("content")).alias("content")
        checked.select(key, "ord", "link", "content_type", "disposition", content, "error").write.parquet(f"{folder}/round={at}")
    rounds = seen(at + 1)
    good = rounds.where("error IS NULL").drop("ord")
    bad = rounds.groupBy(key).agg(F.count_if(F.col("error").isNull()).alias("n"), F.max_by(F.struct("link", "content_type", "disposition", "error"), "ord").alias("last")).where("n = 0")
    return good.unionByName(bad.select(key, "last.*"), allowMissingColumns=True)
