"""Paper records of several sources: one layout, first-wins dedup, and limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import collapsed, compacted, filled, stripped, year

FIELDS = ("source", "paper_id", "title", "abstract", "authors", "year", "venue", "url", "pdf_url")
MAX_LIMIT, DEFAULT_LIMIT, MAX_AUTHORS = 20, 8, 8
SCHOLAR_ITEM = (
    "struct<paperId:string,title:string,abstract:string,year:int,venue:string,url:string,"
    "authors:array<struct<name:string,author:string>>,openAccessPdf:struct<url:string>>"
)
ATOM_ITEM = (
    "struct<id:string,title:string,summary:string,published:string,"
    "author:array<struct<name:string>>,link:array<struct<_title:string,_href:string>>>"
)


def author_names(authors: Column, limit: int = MAX_AUTHORS) -> Column:
    """Names of array<struct<name,author>>, blanks left out, the first ``limit``."""
    names = F.transform(authors, lambda a: stripped(filled(F.coalesce(F.nullif(a["name"], F.lit("")), a["author"]))))
    return F.slice(F.coalesce(F.filter(names, lambda x: x != ""), F.array().cast("array<string>")), 1, limit)


def _record(source: str, **parts: Column) -> list[Column]:
    venue = compacted(parts["venue"], 120)
    shown = parts | {
        "source": F.lit(source), "title": compacted(parts["title"], 300), "abstract": compacted(parts["abstract"], 2000),
        "venue": F.when(venue == "", F.lit(source)).otherwise(venue), "year": year(parts["year"]),
    }
    return [(shown[f] if f in ("authors", "source") else filled(shown[f])).alias(f) for f in FIELDS]


def from_scholar(items: DataFrame, column: str = "item", source: str = "Semantic Scholar") -> DataFrame:
    """Records of SCHOLAR_ITEM structs; other columns of ``items`` stay."""
    i = F.col(column)
    record = _record(
        source, paper_id=i["paperId"], title=i["title"], abstract=i["abstract"], authors=author_names(i["authors"]),
        year=i["year"].cast("string"), venue=i["venue"], url=i["url"], pdf_url=i["openAccessPdf"]["url"],
    )
    return items.select(*[c for c in items.columns if c != column], *record)


def from_atom(items: DataFrame, column: str = "item", source: str = "arXiv") -> DataFrame:
    """Records of ATOM_ITEM structs; the file link is the first one titled pdf."""
    i = F.col(column)
    pdf = F.get(F.filter(i["link"], lambda x: x["_title"] == "pdf"), F.lit(0))["_href"]
    names = F.transform(i["author"], lambda a: F.struct(a["name"].alias("name"), F.lit(None).cast("string").alias("author")))
    record = _record(
        source, paper_id=i["id"], title=i["title"], abstract=i["summary"], authors=author_names(names),
        year=i["published"], venue=F.lit(""), url=i["id"], pdf_url=pdf,
    )
    return items.select(*[c for c in items.columns if c != column], *record)


def title_key(title: Column) -> Column:
    return F.lower(collapsed(filled(title)))


def clamped_limit(limit: Column, default: int = DEFAULT_LIMIT) -> Column:
    """Whole number within 1 to MAX_LIMIT; null, zero and what isn't a number are the default."""
    n = F.coalesce(F.nullif(limit.cast("string").try_cast("int"), F.lit(0)), F.lit(default))
    return F.greatest(F.lit(1), F.least(F.lit(MAX_LIMIT), n))


def first_wins(records: DataFrame, by: list[str]) -> DataFrame:
    """Per ``by`` and title key the first record by (src_ord, pos); records without title go."""
    keyed = records.withColumn("title_key", title_key(F.col("title"))).where("title_key <> ''")
    # An aggregation keeps one record per task and title before anything is shuffled, however common a title.
    first = F.min_by(F.struct(*[F.col(f"`{c}`") for c in records.columns]), F.struct("src_ord", "pos"))
    return keyed.groupBy(*by, "title_key").agg(first.alias("first")).select("first.*")


def federated(records: DataFrame, limits: DataFrame, by: str = "query_id") -> DataFrame:
    """Search results: ``limits`` has (by, limit), one row per query. Each source gives its first
    ``limit`` records, equal titles keep the first, and of what is left the first ``limit`` are
    ranked; so a later source fills what the earlier ones leave. Both windows are per query, with
    at most MAX_LIMIT rows of each source, so no query can grow a task."""
    ranked = W.partitionBy(by, "src_ord").orderBy("pos")
    per_source = records.withColumn("nth", F.row_number().over(ranked)).where(F.col("nth") <= MAX_LIMIT)
    cut = per_source.join(limits.select(by, clamped_limit(F.col("limit")).alias("top")), by).where("nth <= top").drop("nth")
    ordered = W.partitionBy(by).orderBy("src_ord", "pos")
    return first_wins(cut, [by]).withColumn("rank", F.row_number().over(ordered)).where("rank <= top").drop("top")


def action_key(item: dict[str, Column]) -> Column:
    """What names a record for actions: the first of id, file link, link and title that isn't empty."""
    return stripped(filled(F.coalesce(*[F.nullif(item[k], F.lit("")) for k in ("paper_id", "pdf_url", "url", "title")])))


def card(records: DataFrame) -> DataFrame:
    """What a result list shows, with words for what is missing."""
    tags = F.array(F.col("source"), F.col("year"), F.col("venue"))
    return records.select(
        F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"),
        F.coalesce(F.nullif(F.array_join("authors", ", "), F.lit("")), F.lit("Unknown authors")).alias("authors"),
        F.coalesce(F.nullif("abstract", F.lit("")), F.lit("No abstract")).alias("abstract"),
        F.filter(tags, lambda x: filled(x) != "").alias("tags"),
        action_key({k: F.col(k) for k in FIELDS}).alias("action_key"),
    )


def meta_line(*bits: Column) -> Column:
    return F.concat_ws(" · ", *[F.nullif(b, F.lit("")) for b in bits])


def source_error(source: Column, status: Column, reason: Column) -> Column:
    """One line for a source that failed."""
    return (
        F.when(status == 429, F.concat(source, F.lit(": rate limited, try again later")))
        .when(status.isNotNull(), F.concat(source, F.lit(": HTTP "), status.cast("string")))
        .when(F.lower(filled(reason)).contains("ssl"), F.concat(source, F.lit(": secure connection failed")))
        .otherwise(F.concat(source, F.lit(": "), filled(reason)))
    )


def download_error(status: Column, reason: Column) -> Column:
    """What to tell of a download that failed with an HTTP status, or before any."""
    return (
        F.when(status == 404, "the file is not at its source")
        .when(status == 403, "the source refuses access to the file")
        .when(status == 429, "the source limits downloads, try again later")
        .when(status.isNotNull(), F.concat(F.lit("the download failed with HTTP "), status.cast("string")))
        .when(F.upper(filled(reason)).contains("CERTIFICATE_VERIFY_FAILED"), "secure connection failed during the download")
        .otherwise(F.concat(F.lit("the download failed: "), filled(reason)))
    )
