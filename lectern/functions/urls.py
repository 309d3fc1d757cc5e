"""Names, content types and addresses of files. Spark expressions, but for what only Python's Unicode
and IP tables know, which run as Arrow-batched functions."""

from __future__ import annotations

import ipaddress
import unicodedata
import urllib.parse

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import filled, lstripped, stripped

EXTENSIONS = (".txt", ".pdf", ".docx", ".pptx")
#: Content types with a known extension.
TYPE_EXTENSIONS = {
    "application/pdf": ".pdf",
    "text/plain": ".txt",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": ".pptx",
}
MAX_FILE_BYTES = 16 * 1024 * 1024


@F.pandas_udf(T.StringType())
def _ascii_only(names: pd.Series) -> pd.Series:
    return names.map(lambda x: None if x is None else unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode())


def secure_name(c: Column) -> Column:
    """A name safe as a file's: ASCII letters, digits, ``_ . -``, no edge dots or runs of ``_``."""
    return _as_name(_in_ascii(filled(c)))


def _in_ascii(c: Column) -> Column:
    """Names that are ASCII already don't leave the JVM."""
    plain = c.rlike(r"^\p{ASCII}*\z")
    return F.coalesce(F.when(plain, c), _ascii_only(F.when(~plain, c)))


#: What is taken out of ASCII names, and what becomes ``_``; by ranges, as Java is several times slower on
#: negated classes.
_DROPPED = r"[\x00-\x08\x0e-\x1b\x21-\x2c\x3a-\x40\x5b\x5d\x5e\x60\x7b-\x7f]+"
_PARTED = r"[\x09-\x0d\x1c-\x20/\x5c_]+"


def _as_name(c: Column) -> Column:
    # Blanks at the ends become edges, which the trim takes off.
    return F.btrim(F.regexp_replace(F.regexp_replace(c, _DROPPED, ""), _PARTED, "_"), F.lit("._"))


def extension(c: Column) -> Column:
    """The lower-cased extension; names that only begin with dots have none."""
    return F.lower(_own_extension(filled(c)))


def is_allowed_file(c: Column) -> Column:
    return extension(c).isin(*EXTENSIONS)


def identifier(c: Column, prefix: str) -> Column:
    fresh = F.concat(F.lit(f"{prefix}_"), F.replace(F.uuid(), F.lit("-"), F.lit("")))
    return F.coalesce(F.nullif(secure_name(stripped(filled(c))), F.lit("")), fresh)


def upload_name(c: Column) -> Column:
    """A safe name with its extension, one made up where nothing safe is left, null where not allowed."""
    return _uploaded(secure_name(c), extension(c))


def _uploaded(safe: Column, ext: Column) -> Column:
    fresh = F.concat(F.lit("file_"), F.replace(F.uuid(), F.lit("-"), F.lit("")), ext)
    return F.when(ext.isin(*EXTENSIONS), F.when((safe != "") & F.endswith(F.lower(safe), ext), safe).otherwise(fresh))


def content_type(c: Column) -> Column:
    return F.lower(stripped(F.split_part(filled(c), F.lit(";"), F.lit(1))))


def type_extension(c: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TYPE_EXTENSIONS.items() for x in pair])
    return filled(F.try_element_at(known, content_type(c)))


def disposition_name(c: Column) -> Column:
    c = filled(c)
    # The two ways a header names its file.
    encoded = F.regexp_extract(c, r"(?i)filename\*=UTF-8''([^;]+)", 1)
    # The decoder takes + for a space, which this form does not.
    decoded = F.try_url_decode(F.replace(encoded, F.lit("+"), F.lit("%2B")))
    plain = F.regexp_extract(c, r'(?i)filename="?([^";]+)"?', 1)
    return F.when(encoded != "", F.btrim(F.coalesce(decoded, encoded), F.lit('" '))).otherwise(stripped(plain))


def scheme(c: Column) -> Column:
    return F.lower(F.regexp_extract(stripped(filled(c)), r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def path(c: Column) -> Column:
    return F.regexp_extract(stripped(filled(c)), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def host(c: Column) -> Column:
    netloc = F.regexp_extract(stripped(filled(c)), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    netloc = F.regexp_replace(netloc, "^.*@", "")
    bracketed = F.regexp_extract(netloc, r"^\[([^\]]*)\]", 1)
    return F.lower(F.when(netloc.startswith("["), bracketed).otherwise(F.split_part(netloc, F.lit(":"), F.lit(1))))


def is_inner(name: str) -> bool:
    """Whether a host is the literal address of an inner network."""
    try:
        ip = ipaddress.ip_address(name)
    except ValueError:
        return False
    return ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified


@F.pandas_udf(T.BooleanType())
def _is_inner_address(hosts: pd.Series) -> pd.Series:
    return hosts.map(lambda x: bool(x) and is_inner(x)).astype(bool)


def is_public_http(c: Column) -> Column:
    """http(s), with a host that is neither this machine by name nor a literal inner address. Host
    names are not resolved; ``is_strictly_public`` is the narrower guard."""
    h = host(c)
    return scheme(c).isin("http", "https") & (h != "") & ~h.isin("localhost", "localhost.localdomain") & ~_is_inner_address(h)


def is_strictly_public(c: Column) -> Column:
    """Also refuses numeric host spellings, dotless names and inner suffixes."""
    h = F.regexp_replace(host(c), r"\.+$", "")
    return is_public_http(c) & h.rlike(r"[a-z:]") & (h.contains(".") | h.contains(":")) & ~h.rlike(r"(^|\.)(local|internal|localhost|lan|home|corp)$") & ~h.rlike(r"^0x")


def is_direct_file(c: Column) -> Column:
    return F.lower(path(c)).rlike(r"\.(txt|pdf|docx|pptx)$")


def looks_like_html(c: Column) -> Column:
    # How a web page begins.
    return F.lower(F.left(lstripped(filled(c)), F.lit(20))).rlike("^(<!doctype html|<html|<head|<body|<meta )")


def safe_link(c: Column, base: str = "https://localhost/") -> Column:
    """http, https and mailto addresses, relative ones made whole against ``base``; else ``#``."""
    text = stripped(filled(c))
    whole = F.when(text.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), text).otherwise(_joined(text, F.lit(base)))
    return F.when((text != "") & scheme(whole).isin("http", "https", "mailto"), whole).otherwise("#")


@F.pandas_udf(T.StringType())
def _joined(links: pd.Series, bases: pd.Series) -> pd.Series:
    return pd.Series([urllib.parse.urljoin(b, a) for a, b in zip(links, bases)])


def _first_name(slug: Column, url: Column, disposition: Column) -> Column:
    """By header, else by address, else by title."""
    base = F.regexp_extract(path(url), r"([^/]*)$", 1)
    # Fixed value: the name where nothing else gives one.
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (disposition_name(disposition), base, slug)], F.lit("imported_paper"))


def _own_extension(name: Column) -> Column:
    """As it is written: the last dot that is not among leading ones, and what follows."""
    last = F.substring_index(name, "/", -1)
    after = F.substring_index(last, ".", -1)
    before = F.left(last, F.length(last) - F.length(after) - 1)
    return F.when(last.contains(".") & (F.ltrim(before, F.lit(".")) != ""), F.concat(F.lit("."), after)).otherwise("")


def _file_name(root: Column, own: Column, slug: Column, ctype: Column) -> Column:
    """root: the name before its own extension, made safe."""
    ext = F.when(F.lower(own).isin(*EXTENSIONS), F.lower(own)).otherwise(F.coalesce(F.nullif(type_extension(ctype), F.lit("")), F.lit(".pdf")))
    safe = F.coalesce(F.nullif(root, F.lit("")), F.nullif(slug, F.lit("")), F.lit("imported_paper"))
    return F.concat(safe, ext)


def import_name(title: Column, url: Column, disposition: Column, ctype: Column) -> Column:
    """Name by header, else by address, else by title; extension by name, else by content type, else .pdf."""
    slug = secure_name(title)
    name = _first_name(slug, url, disposition)
    own = _own_extension(name)
    return upload_name(_file_name(secure_name(F.left(name, F.length(name) - F.length(own))), own, slug, ctype))


def _step(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is worked out once: the optimiser puts projections together again, but not what a
    generator makes."""
    return df.select("*", F.inline_outer(F.array(F.struct(value.alias(name)))))


def _secured(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds ``secure_name`` of ``value``."""
    whole = _step(df, f"{name}_raw", filled(value))
    return _step(whole.withColumn(f"{name}_in", _in_ascii(F.col(f"{name}_raw"))), name, _as_name(F.col(f"{name}_in")))


def with_upload_name(files: DataFrame, raw: str, column: str = "name", ext: str = "ext") -> DataFrame:
    """Adds ``upload_name`` and ``extension`` of the column ``raw``, each part worked out once: as one
    expression they walk it some ten times, which counts for long ones."""
    made = _step(_secured(files, "_safe", F.col(raw)), ext, extension(F.col(raw)))
    return made.withColumn(column, _uploaded(F.col("_safe"), F.col(ext))).select(*files.columns, ext, column)


def with_import_name(files: DataFrame, column: str = "source_filename") -> DataFrame:
    """``import_name`` of rows with title, link, disposition and content_type, step by step: as one expression
    it repeats its parts until the code for it is too long to compile."""
    made = _secured(files, "_slug", F.col("title"))
    made = _step(made, "_name", _first_name(F.col("_slug"), F.col("link"), F.col("disposition")))
    made = _step(made, "_own", _own_extension(F.col("_name")))
    made = _secured(made, "_root", F.left("_name", F.length("_name") - F.length("_own")))
    made = _step(made, "_file", _file_name(F.col("_root"), F.col("_own"), F.col("_slug"), F.col("content_type")))
    made = _step(_secured(made, "_safe", F.col("_file")), "_ext", extension(F.col("_file")))
    return made.withColumn(column, _uploaded(F.col("_safe"), F.col("_ext"))).select(*files.columns, column)


def download_candidates(pdf_url: Column, url: Column) -> Column:
    """array<struct<link, direct_only>>: distinct non-blank addresses, the file link first."""
    one, two = stripped(filled(pdf_url)), stripped(filled(url))
    both = F.array(
        F.when(one != "", F.struct(one.alias("link"), F.lit(False).alias("direct_only"))),
        F.when((two != "") & (two != one), F.struct(two.alias("link"), F.lit(True).alias("direct_only"))),
    )
    return F.array_compact(both)
