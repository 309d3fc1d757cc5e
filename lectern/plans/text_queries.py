"""Registered queries over text, names and addresses, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import sse, text, urls
from lectern.operators.chunking import chunks
from lectern.operators.papers import action_key, author_names, clamped_limit, meta_line


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _rstrip(x: str) -> str:
    return rf"regexp_replace({x}, '\s+$', '')"


def _compact(x: str, n: int) -> str:
    one = _strip(rf"regexp_replace(coalesce({x}, ''), '\s+', ' ', 'g')")
    return f"(CASE WHEN length({one}) > {n} THEN {_rstrip(f'left({one}, {n})')} || '...' ELSE {one} END)"


def _trim(x: str, n: int) -> str:
    one = _strip(f"coalesce({x}, '')")
    return f"(CASE WHEN length({one}) > {n} THEN {_rstrip(f'left({one}, {n})')} || chr(10) || '...[truncated]' ELSE {one} END)"


# ---- chunks ----


def chunk_documents(spark, d):
    return chunks(table(spark, d, "documents")).select("doc_id", "chunk_idx", "start", "len", F.sha2("text", 256).alias("text_sha256"))


def chunk_stats(spark, d):
    per = chunks(table(spark, d, "documents")).groupBy("doc_id")
    return per.agg(F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).cast("long").alias("chars"), F.max("len").alias("longest"))


def cleaned_sql(x: str) -> str:
    return (
        rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10)||chr(10), 'g'), '[ \t]+', ' ', 'g'), '(?m)^ +| +$', '', 'g'), '^\n+|\n+$', '', 'g')"
    )


def windows_sql(x: str = "coalesce(text, '')") -> str:
    """The tables docs (doc_id, t, n) and chunks of the documents' texts ``x``."""
    return f"WITH RECURSIVE docs AS (SELECT doc_id, t, length(t) AS n FROM (SELECT doc_id, {x} AS t FROM documents)),\n" + _CHUNKS


_CHUNKS = r"""cuts AS (
  SELECT doc_id, t, n, 0 AS k, 0 AS start, CAST(NULL AS BIGINT) AS cut FROM docs WHERE n > 4000
  UNION ALL
  SELECT doc_id, t, n, k + 1, CAST(start + stop - 200 AS INTEGER), cut FROM (
    SELECT *, CASE WHEN start + 4000 < n AND best > 2000 THEN best + 1 ELSE 4000 END AS stop FROM (
      SELECT *, greatest(
        CASE WHEN contains(w, '。') THEN length(w) - instr(reverse(w), '。') ELSE -1 END,
        CASE WHEN contains(w, '. ') THEN length(w) - instr(reverse(w), ' .') - 1 ELSE -1 END,
        CASE WHEN contains(w, chr(10)) THEN length(w) - instr(reverse(w), chr(10)) ELSE -1 END) AS best
      FROM (SELECT *, substr(t, start + 1, 4000) AS w FROM cuts)))
  WHERE start + stop - 200 < n
), parts AS (
  SELECT doc_id, k, start, CASE WHEN start + 4000 < n AND best > 2000 THEN best + 1 ELSE length(w) END AS len, w FROM (
    SELECT *, greatest(
        CASE WHEN contains(w, '。') THEN length(w) - instr(reverse(w), '。') ELSE -1 END,
        CASE WHEN contains(w, '. ') THEN length(w) - instr(reverse(w), ' .') - 1 ELSE -1 END,
        CASE WHEN contains(w, chr(10)) THEN length(w) - instr(reverse(w), chr(10)) ELSE -1 END) AS best
    FROM (SELECT *, substr(t, start + 1, 4000) AS w FROM cuts))
), shown AS (
  SELECT doc_id, k, start, len, regexp_replace(left(w, len), '^\s+|\s+$', '', 'g') AS text FROM parts
), chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INTEGER) AS chunk_idx, CAST(start AS INTEGER) AS start, CAST(len AS INTEGER) AS len, text
  FROM shown WHERE text <> ''
  UNION ALL SELECT doc_id, 0, 0, CAST(n AS INTEGER), t FROM docs WHERE n <= 4000
)
"""


def clean_perturbed(spark, d):
    t = "concat(char(10),'  ',replace(replace(text,'. ',concat('.',char(9),' ',char(10),' ',char(10),char(10),char(10),char(10))),', ',concat(',  ',char(9))),' ',char(10))"
    out = table(spark, d, "documents").select("doc_id", text.cleaned(F.expr(t)).alias("t"))
    return out.select("doc_id", F.length("t").cast("long").alias("chars"), F.sha2("t", 256).alias("sha256"))


def excerpt_windows(spark, d):
    docs = table(spark, d, "documents")
    cols = [F.sha2(text.window(F.col("text"), k), 256).alias(k) for k in text.WINDOWS]
    return docs.select("doc_id", F.sha2(text.excerpt(F.col("text")), 256).alias("excerpt"), *cols)


def compact_abstract(spark, d):
    return table(spark, d, "documents").select("doc_id", text.compacted(F.col("text")).alias("abstract"), text.compacted(F.col("text"), 120).alias("venue"))


def trim_log(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.trimmed(F.col("text"), 400).alias("shown"))


def parse_year(spark, d):
    orders = table(spark, d, "orders")
    return orders.select("o_orderkey", text.year(F.col("o_orderdate").cast("string")).alias("year"), text.year(F.concat(F.lit("1"), F.col("o_orderkey").cast("string"))).alias("odd_year"))


def clamped_limits(spark, d):
    raw = F.when(F.col("l_linenumber") == 7, "x").otherwise((F.col("l_linenumber") * 9 - 10).cast("string"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", clamped_limit(raw).alias("top"))


def flag_words(spark, d):
    word = F.element_at(F.array(*map(F.lit, ["1", " TRUE ", "yes", "On", "0", "off", "", "maybe"])), (F.col("event_id") % 8 + 1).cast("int"))
    word = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit(" "), (F.col("event_id") % 50 - 9).cast("string"))).when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(word)
    return table(spark, d, "events").select("event_id", text.is_true(word).alias("flag"), text.int_or(word, 5, 1, 32).alias("number"))


def json_salvage(spark, d):
    wrapped = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))).when(
        F.col("event_id") % 3 == 1, F.concat(F.lit("Here: "), F.col("props"), F.lit(" done"))).otherwise(F.lit(" } { "))
    found = text.json_object(wrapped)
    return table(spark, d, "events").select("event_id", found.alias("found"), F.get_json_object(found, "$.k").alias("k"))


def message_parts(spark, d):
    part = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("text"))
    parts = F.array(part("text", F.col("role")), part("image", F.lit("x")), part("text", F.lit("")), part("text", F.col("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", F.sha2(text.message_text(parts), 256).alias("sha256"))


def mermaid_salvage(spark, d):
    kind = F.col("doc_id") % 4
    reply = (
        F.when(kind == 0, F.concat(F.col("text"), F.lit("\n  graph LR\n  A[x] --> B\n")))
        .when(kind == 1, F.concat(F.lit("Sure:\n```mermaid\nA --> B\n```"), F.lit("\nbye")))
        .when(kind == 2, F.lit("A --> B")).otherwise(F.lit("pie title x"))
    )
    shown = text.diagram_source(reply)
    return table(spark, d, "documents").select("doc_id", shown.alias("source"), text.unfenced_diagram(reply).alias("unfenced"))


def html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", F.sha2(text.html_escaped(F.col("html")), 256).alias("sha256"), F.length(text.html_escaped(F.col("html"))).alias("chars"))


def file_stem(spark, d):
    return table(spark, d, "documents").select("doc_id", text.file_stem(F.concat(F.col("text"), F.lit(".v1.pdf"))).alias("stem"))


def human_size(spark, d):
    size = F.col("n_chars") * F.pow(F.lit(10.0), F.col("doc_id") % 7).cast("long")
    return table(spark, d, "documents").select("doc_id", text.human_size(size).alias("size"))


def math_text(spark, d):
    raw = F.concat(F.lit("\\["), F.col("text"), F.lit("\\]\r\n\\(x_1\\) and $y$"))
    return table(spark, d, "documents").select("doc_id", text.math_delimiters(raw).alias("math"))


def retryable_flag(spark, d):
    word = F.element_at(F.array(*map(F.lit, ["HTTP 503", "Connection reset", "请求超时", "HTTP 401", "Timeout", "bad key"])), (F.col("event_id") % 6 + 1).cast("int"))
    word = F.concat_ws(" ", "event_type", F.when(F.col("event_id") % 4 > 0, word), "props", (F.lit(395) + F.col("event_id") % 110).cast("string"))
    e = table(spark, d, "events")
    return e.select("event_id", text.is_retryable(word).alias("retryable"), F.array_join(text.error_hints(word), ";").alias("hints"))


def status_message(spark, d):
    return table(spark, d, "events").select("event_id", text.status_message(F.lit(399) + F.col("event_id") % 110).alias("message"))


# ---- names and addresses ----


def secure_filename(spark, d):
    return table(spark, d, "documents").select("doc_id", urls.secure_name(F.col("text")).alias("name"))


def upload_names(spark, d):
    raw = F.concat(F.col("text"), F.element_at(F.array(*map(F.lit, [".PDF", ".txt", ".exe", "", ".tar.docx"])), (F.col("doc_id") % 5 + 1).cast("int")))
    named = urls.with_upload_name(table(spark, d, "documents").select("doc_id", raw.alias("raw")), "raw")
    made_up = F.col("name").rlike(r"^file_[0-9a-f]{32}\.\w+$")  # where the text leaves nothing safe
    return named.select("doc_id", F.col("ext").isin(*urls.EXTENSIONS).alias("allowed"), "ext", F.when(made_up, "made up").otherwise(F.col("name")).alias("name"))


_LINK = "concat(url, element_at(array('', '/a.PDF', '/b.docx?x=1', '#f.pdf'), cast(page_id % 4 + 1 as int)))"


def direct_file(spark, d):
    link = F.expr(_LINK)
    return table(spark, d, "pages").select("page_id", urls.is_direct_file(link).alias("direct"), urls.scheme(link).alias("scheme"), urls.host(link).alias("host"))


_HOSTS = ["http://127.0.0.1/x", "https://169.254.169.254", "http://[::ffff:10.0.0.1]/", "http://198.18.0.1", "http://203.0.113.5", "http://8.8.8.8", "http://2130706433", "http://0x7f.1", "http://100.64.0.1", "http://localhost./", "https://foo.internal/a", "http://LOCALHOST", "ftp://example.org", "", "https://user@10.1.2.3:80/"]
_PUBLIC = [False, False, False, False, False, True, True, True, True, True, True, False, False, False, False]


def public_url(spark, d):
    odd = F.get(F.array(*map(F.lit, _HOSTS)), (F.col("page_id") % len(_HOSTS)).cast("int"))
    ip = F.concat_ws(".", *[(F.col("page_id") * k % 256).cast("string") for k in (37, 101, 7, 1)])
    numbered = F.concat(F.lit("http://"), ip, F.when(F.col("page_id") % 2 == 0, ":8080").otherwise(""), F.lit("/a.pdf"))
    return table(spark, d, "pages").select(
        "page_id", urls.is_public_http(F.col("url")).alias("page_public"), urls.is_public_http(odd).alias("odd_public"), urls.is_public_http(numbered).alias("ip_public"))


def url_candidates(spark, d):
    pdf = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" "), F.col("url"))).when(F.col("page_id") % 3 == 1, F.concat(F.col("url"), F.lit(".pdf")))
    c = table(spark, d, "pages").select("page_id", F.posexplode(urls.download_candidates(pdf, F.col("url"))).alias("ord", "c"))
    return c.select("page_id", "ord", "c.link", "c.direct_only")


def content_type_ext(spark, d):
    raw = F.element_at(F.array(*map(F.lit, ["Application/PDF; q=1", " text/plain ", "image/png", ""])), (F.col("page_id") % 4 + 1).cast("int"))
    raw = F.when(F.col("page_id") % 5 < 3, raw).otherwise(F.concat(F.lit(" Text/X"), (F.col("page_id") % 7).cast("string"), F.lit(" ;"), F.col("url")))
    return table(spark, d, "pages").select("page_id", urls.content_type(raw).alias("ctype"), urls.type_extension(raw).alias("ext"))


_DISP = ["attachment; filename*=UTF-8''a%20b+c.pdf", 'attachment; filename="d e.docx"', "inline; FILENAME=f.txt; x=1", "inline"]
#: The headers' names in pages carry the page's number.
_NUMBERED = [("c.pdf", "c{}.pdf"), ("e.docx", "e{}.docx"), ("f.txt", "f{}.txt")]


def disposition_name(spark, d):
    raw = F.get(F.array(*map(F.lit, _DISP)), (F.col("page_id") % 4).cast("int"))
    for name, numbered in _NUMBERED:
        raw = F.replace(raw, F.lit(name), F.concat(*[F.col("page_id").cast("string") if x == "{}" else F.lit(x) for x in numbered.partition("{}")]))
    p = table(spark, d, "pages")
    return p.select("page_id", urls.disposition_name(raw).alias("name"), urls.import_name(F.lit("My Title"), F.lit("https://x.org/p/q.v2?z"), raw, F.lit("application/pdf")).alias("saved"))


def html_flag(spark, d):
    odd = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" \n"), F.col("html"))).otherwise(F.concat(F.lit("x"), F.col("html")))
    return table(spark, d, "pages").select("page_id", urls.looks_like_html(F.col("html")).alias("html"), urls.looks_like_html(odd).alias("odd"))


# ---- frames and small records ----


def sse_roundtrip(spark, d):
    e = table(spark, d, "events")
    two = F.concat(F.lit(": note\n\n"), sse.frame(F.col("event_type"), F.col("props")), F.lit("data: not json\ndata: two"))
    each = e.select("event_id", F.posexplode(sse.frames(two)).alias("nth", "f"))
    return each.select("event_id", "nth", "f.event", F.get_json_object(sse.payload(F.col("f.data")), "$.k").alias("k"), F.get_json_object(sse.payload(F.col("f.data")), "$.raw").alias("raw"))


def author_list(spark, d):
    person = lambda a, b: F.struct(a.alias("name"), b.alias("author"))
    none = F.lit(None).cast("string")
    people = F.array(person(F.concat(F.lit(" "), F.col("c_name")), none), person(F.lit(""), F.col("c_mktsegment")), person(F.lit(" "), none), *[person(F.lit(f"p{i}"), none) for i in range(8)])
    return table(spark, d, "customer").select("c_custkey", F.array_join(author_names(people), "|").alias("authors"))


def record_keys(spark, d):
    p = table(spark, d, "part")
    item = {"paper_id": F.when(F.col("p_partkey") % 3 == 0, ""), "pdf_url": F.when(F.col("p_partkey") % 3 == 1, F.col("p_type")), "url": F.when(F.col("p_partkey") % 3 == 2, F.col("p_brand")), "title": F.concat(F.lit(" "), F.col("p_name"))}
    return p.select("p_partkey", action_key(item).alias("action_key"), meta_line(F.col("p_brand"), F.when(F.col("p_size") > 25, F.col("p_type")), F.lit("")).alias("line"))


QUERIES = {f.__name__: f for f in [
    chunk_documents, chunk_stats, clean_perturbed, excerpt_windows, compact_abstract, trim_log, parse_year, clamped_limits, flag_words, json_salvage, message_parts,
    mermaid_salvage, html_escape, file_stem, human_size, math_text, retryable_flag, status_message, secure_filename, upload_names, direct_file, public_url,
    url_candidates, content_type_ext, disposition_name, html_flag, sse_roundtrip, author_list, record_keys,
]}

_PICK = lambda values, at: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][{at}]"
_PERTURBED = "concat(chr(10),'  ',replace(replace(text,'. ','.'||chr(9)||' '||chr(10)||' '||chr(10)||chr(10)||chr(10)||chr(10)),', ',',  '||chr(9)),' ',chr(10))"


def _secure(x: str) -> str:
    return (
        rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents({x}), '[^\x00-\x7f]', '', 'g'), '[/\\]', ' ', 'g'), "
        r"'^\s+|\s+$', '', 'g'), '\s+', '_', 'g'), '[^A-Za-z0-9_.-]', '', 'g'), '_+', '_', 'g').trim('._')"
    )


_BREAK, _BLANK, _STARTS = r"\n", r"\s", "|".join(text.DIAGRAM_STARTS)

ORACLES = {
    "chunk_documents": windows_sql() + "SELECT doc_id, chunk_idx, start, len, sha256(text) AS text_sha256 FROM chunks",
    "chunk_stats": windows_sql() + "SELECT doc_id, count(*) AS n_chunks, CAST(sum(length(text)) AS BIGINT) AS chars, max(len) AS longest FROM chunks GROUP BY doc_id",
    "clean_perturbed": rf"""SELECT doc_id, length(t) AS chars, sha256(t) AS sha256 FROM (SELECT doc_id,
        {cleaned_sql(_PERTURBED)} AS t FROM documents)""",
    "excerpt_windows": "SELECT doc_id, sha256(left(coalesce(text,''),12000)) AS excerpt, " + ", ".join(f"sha256(left(coalesce(text,''),{n})) AS {k}" for k, n in text.WINDOWS.items()) + " FROM documents",
    "compact_abstract": f"SELECT doc_id, {_compact('text', 400)} AS abstract, {_compact('text', 120)} AS venue FROM documents",
    "trim_log": f"SELECT conv_id, turn, {_trim('text', 400)} AS shown FROM conversations",
    "parse_year": r"SELECT o_orderkey, regexp_extract(CAST(o_orderdate AS VARCHAR), '(19|20)\d{2}') AS year, regexp_extract('1' || o_orderkey, '(19|20)\d{2}') AS odd_year FROM orders",
    "clamped_limits": "SELECT l_orderkey, l_linenumber, CAST(CASE WHEN l_linenumber = 7 OR l_linenumber * 9 = 10 THEN 8 ELSE greatest(1, least(20, l_linenumber * 9 - 10)) END AS INTEGER) AS top FROM lineitem",
    "flag_words": r"""SELECT event_id, lower(trim(word)) IN ('1', 'true', 'yes', 'on') AS flag, CAST(greatest(1, least(32, coalesce(TRY_CAST(trim(word) AS INTEGER), 5))) AS INTEGER) AS number FROM (
        SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' ' || (event_id % 50 - 9) WHEN 1 THEN event_type ELSE ['1', ' TRUE ', 'yes', 'On', '0', 'off', '', 'maybe'][event_id % 8 + 1] END AS word FROM events)""",
    "json_salvage": "SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '} {' ELSE props END AS found, CASE WHEN event_id % 3 < 2 THEN props ->> '$.k' END AS k FROM events",
    "message_parts": f"SELECT conv_id, turn, sha256({_strip('''role || chr(10) || text''')}) AS sha256 FROM conversations",
    "mermaid_salvage": f"""SELECT doc_id,
        CASE doc_id % 4 WHEN 0 THEN {_rstrip(f"regexp_extract(text || chr(10) || '  graph LR' || chr(10) || '  A[x] --> B', '(?s)(?:^|{_BREAK}){_BLANK}*((?:{_STARTS}).*)$', 1)")} WHEN 1 THEN 'graph TD'||chr(10)||'A --> B' WHEN 2 THEN 'graph TD'||chr(10)||'A --> B' ELSE 'pie title x' END AS source,
        CASE doc_id % 4 WHEN 0 THEN {_strip(r"regexp_replace(text || chr(10) || '  graph LR' || chr(10) || '  A[x] --> B', '```mermaid\n?|```\n?', '', 'gi')")} WHEN 1 THEN 'Sure:'||chr(10)||'A --> B'||chr(10)||'bye' WHEN 2 THEN 'A --> B' ELSE 'pie title x' END AS unfenced FROM documents""",
    "html_escape": "SELECT page_id, sha256(t) AS sha256, CAST(length(t) AS INTEGER) AS chars FROM (SELECT page_id, replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#39;') AS t FROM pages)",
    "file_stem": r"SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(text || '.v1', '[^A-Za-z0-9_\x{4e00}-\x{9fa5}-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'session') AS stem FROM documents",
    "human_size": """WITH s AS (SELECT doc_id, CAST(n_chars * CAST(pow(10, doc_id % 7) AS BIGINT) AS DOUBLE) AS n FROM documents),
        u AS (SELECT doc_id, n, CASE WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS p FROM s)
        SELECT doc_id, CASE WHEN p = 0 OR n / pow(1024, p) >= 10 THEN CAST(CAST(floor(n / pow(1024, p) + 0.5) AS BIGINT) AS VARCHAR) ELSE printf('%.1f', n / pow(1024, p)) END || ' ' || ['B','KB','MB','GB'][p + 1] AS size FROM u""",
    "math_text": r"""SELECT doc_id, regexp_replace(regexp_replace(replace('\[' || text || '\]' || chr(10) || '\(x_1\) and $y$', chr(13) || chr(10), chr(10)),
        '(?s)\\\[(.*?)\\\]', '$$\1$$', 'g'), '(?s)\\\((.*?)\\\)', '$\1$', 'g') AS math FROM documents""",
    "retryable_flag": """SELECT event_id, regexp_matches(lower(word), '""" + "|".join(text.RETRY_MARKERS) + """') AS retryable, concat_ws(';',
        CASE WHEN regexp_matches(lower(word), 'api key|认证失败|401') THEN 'check the API key' END, CASE WHEN regexp_matches(lower(word), 'openai_base_url|网页内容|html 页面|网页地址') THEN 'check the base URL' END,
        CASE WHEN regexp_matches(lower(word), '429|限流') THEN 'slow down and retry' END) AS hints FROM (
        SELECT event_id, concat_ws(' ', event_type, CASE WHEN event_id % 4 > 0 THEN ['HTTP 503', 'Connection reset', '请求超时', 'HTTP 401', 'Timeout', 'bad key'][event_id % 6 + 1] END, props, 395 + event_id % 110) AS word FROM events)""",
    "status_message": "SELECT event_id, CASE 399 + event_id % 110 " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in text.STATUS_MESSAGES.items()) + " ELSE 'request failed with status ' || (399 + event_id % 110) END AS message FROM events",
    "secure_filename": f"SELECT doc_id, {_secure('text')} AS name FROM documents",
    "upload_names": rf"""SELECT doc_id, ext IN ('.txt', '.pdf', '.docx', '.pptx') AS allowed, ext, CASE WHEN ext IN ('.txt', '.pdf', '.docx', '.pptx') THEN
        CASE WHEN safe <> '' AND ends_with(lower(safe), ext) THEN safe ELSE 'made up' END END AS name FROM (
        SELECT doc_id, {_secure("coalesce(text || ['.PDF','.txt','.exe','','.tar.docx'][doc_id % 5 + 1], '')")} AS safe, coalesce(lower(regexp_extract(text || ['.PDF','.txt','.exe','','.tar.docx'][doc_id % 5 + 1], '(?s)^(?:.*/)?[^/]*[^./][^/]*(\.[^./]*)$', 1)), '') AS ext FROM documents)""",
    "direct_file": r"""SELECT page_id, regexp_matches(lower(regexp_extract(link, '^[a-z]+://[^/?#]*([^?#]*)', 1)), '\.(txt|pdf|docx|pptx)$') AS direct, lower(regexp_extract(link, '^([A-Za-z]+):', 1)) AS scheme, lower(regexp_extract(link, '://([^/:?#]*)', 1)) AS host
        FROM (SELECT page_id, url || ['', '/a.PDF', '/b.docx?x=1', '#f.pdf'][page_id % 4 + 1] AS link FROM pages)""",
    "public_url": "SELECT page_id, regexp_matches(url, '^https?://[^/]') AS page_public, [" + ", ".join(str(x).lower() for x in _PUBLIC) + f"""][page_id % {len(_PUBLIC)} + 1] AS odd_public,
        NOT (a IN (0, 10, 127) OR a >= 224 OR a = 172 AND b BETWEEN 16 AND 31 OR a = 192 AND b = 168 OR a = 169 AND b = 254 OR a = 198 AND b IN (18, 19)
          OR a = 192 AND b = 0 AND c IN (0, 2) OR a = 198 AND b = 51 AND c = 100 OR a = 203 AND b = 0 AND c = 113) AS ip_public
        FROM (SELECT *, page_id * 37 % 256 AS a, page_id * 101 % 256 AS b, page_id * 7 % 256 AS c FROM pages)""",
    "url_candidates": """SELECT page_id, CAST(0 AS INTEGER) AS ord, CASE WHEN page_id % 3 = 1 THEN url || '.pdf' ELSE url END AS link, page_id % 3 = 2 AS direct_only FROM pages
        UNION ALL SELECT page_id, 1, url, true FROM pages WHERE page_id % 3 = 1""",
    "content_type_ext": """SELECT page_id, ctype, CASE ctype """ + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in urls.TYPE_EXTENSIONS.items()) + """ ELSE '' END AS ext FROM (
        SELECT page_id, lower(trim(split_part(CASE WHEN page_id % 5 < 3 THEN ['Application/PDF; q=1', ' text/plain ', 'image/png', ''][page_id % 4 + 1] ELSE ' Text/X' || page_id % 7 || ' ;' || url END, ';', 1))) AS ctype FROM pages)""",
    "disposition_name": """SELECT page_id, ['a b+c' || page_id || '.pdf', 'd e' || page_id || '.docx', 'f' || page_id || '.txt', ''][page_id % 4 + 1] AS name,
        ['a_bc' || page_id || '.pdf', 'd_e' || page_id || '.docx', 'f' || page_id || '.txt', 'q.pdf'][page_id % 4 + 1] AS saved FROM pages""",
    "html_flag": r"SELECT page_id, regexp_matches(lower(ltrim(html)), '^(<!doctype html|<html|<head|<body|<meta )') AS html, regexp_matches(lower(regexp_replace(CASE WHEN page_id % 2 = 0 THEN html ELSE 'x' || html END, '^\s+', '')), '^(<!doctype html|<html|<head|<body|<meta )') AS odd FROM pages",
    "sse_roundtrip": "SELECT event_id, CAST(0 AS INTEGER) AS nth, event_type AS event, props ->> '$.k' AS k, CAST(NULL AS VARCHAR) AS raw FROM events UNION ALL SELECT event_id, 1, 'message', NULL, 'not json' || chr(10) || 'two' FROM events",
    "author_list": "SELECT c_custkey, c_name || '|' || c_mktsegment || '|p0|p1|p2|p3|p4|p5' AS authors FROM customer",
    "record_keys": "SELECT p_partkey, CASE p_partkey % 3 WHEN 1 THEN p_type WHEN 2 THEN p_brand ELSE p_name END AS action_key, concat_ws(' · ', p_brand, CASE WHEN p_size > 25 THEN p_type END) AS line FROM part",
}
