"""Text expressions over columns. White space means Python's, which Java's classes only partly match."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Java pattern of one character that ``str.isspace`` holds true.
SPACE = r"(?U)[\s\x1c-\x1f]"
ELLIPSIS, CUT_MARK = "...", "\n...[truncated]"
#: Prompt windows in code points.
WINDOWS = {"quotes": 15000, "mindmap": 10000, "mermaid": 4000, "evaluation": 15000, "answer": 12000, "rewrite": 6000}
EXCERPT = 12000


def filled(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def lstripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+", "")


def rstripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+\z", "")


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def collapsed(c: Column) -> Column:
    return stripped(F.regexp_replace(c, SPACE + "+", " "))


def cleaned(c: Column) -> Column:
    """Blank-line runs shortened, other white space squeezed, lines and whole text stripped; one pass,
    so a line of blanks between two breaks may leave three breaks."""
    c = F.regexp_replace(filled(c), r"\n{3,}", "\n\n")
    c = F.regexp_replace(c, r"(?U)[[\s\x1c-\x1f]&&[^\n]]+", " ")
    return F.regexp_replace(F.regexp_replace(c, r"(?m)^ +| +$", ""), r"^\n+|\n+\z", "")


def compacted(c: Column, limit: int = 400) -> Column:
    c = collapsed(filled(c))
    return F.when(F.length(c) > limit, F.concat(rstripped(F.left(c, F.lit(limit))), F.lit(ELLIPSIS))).otherwise(c)


def trimmed(c: Column, limit: int = 2000) -> Column:
    c = stripped(filled(c))
    return F.when(F.length(c) > limit, F.concat(rstripped(F.left(c, F.lit(limit))), F.lit(CUT_MARK))).otherwise(c)


def excerpt(c: Column, limit: int = EXCERPT) -> Column:
    return F.left(filled(c), F.lit(limit))


def window(c: Column, task: str) -> Column:
    """What a task reads of a text, cut before anything leaves the JVM."""
    return excerpt(c, WINDOWS[task])


def year(c: Column) -> Column:
    return F.regexp_extract(filled(c), r"(19|20)\d{2}", 0)


def int_or(c: Column, default: int, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(F.expr("try_cast(null as int)") if c is None else c.try_cast("int"), F.lit(default))))


def is_true(c: Column, default: bool = False) -> Column:
    word = F.lower(stripped(filled(c)))
    return F.when(word == "", F.lit(default)).otherwise(word.isin("1", "true", "yes", "on"))


def json_object(c: Column) -> Column:
    """From the first { to the last } once a code fence is off; without such a pair, all of it."""
    raw = stripped(filled(c))
    fenced = F.regexp_replace(F.regexp_replace(raw, r"(?iU)^```(?:json)?\s*", ""), r"(?U)\s*```\z", "")
    text = F.when(raw.startswith("```"), fenced).otherwise(raw)
    found = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.when(found != "", found).otherwise(text)


def message_text(parts: Column) -> Column:
    """Text of a message given as array<struct<type,text>>; null is empty."""
    kept = F.filter(parts, lambda p: (p["type"] == "text") & (filled(p["text"]) != ""))
    return stripped(filled(F.array_join(F.transform(kept, lambda p: p["text"]), "\n")))


#: Fixed value: how a diagram source may begin.
DIAGRAM_STARTS = ("graph ", "mindmap", "flowchart ", "pie", "sequenceDiagram", "stateDiagram", "classDiagram")


def diagram_source(c: Column) -> Column:
    """The diagram in a reply: from the first line that begins one, else what a fence holds, else all,
    with a default heading where none is."""
    begins = "^(?:" + "|".join(DIAGRAM_STARTS) + ")"
    lines = F.split(stripped(c), "\n", -1)
    starts = F.array_compact(F.transform(lines, lambda x, i: F.when(stripped(x).rlike(begins), i)))
    tail = stripped(F.array_join(F.slice(lines, F.get(starts, F.lit(0)) + 1, F.size(lines)), "\n"))
    fence = F.regexp_extract(c, r"(?is)```(?:mermaid)?\s*\n(.*?)\n```", 1)
    fenced = c.rlike(r"(?is)```(?:mermaid)?\s*\n.*?\n```")
    found = F.when(F.size(starts) > 0, tail).when(fenced, stripped(fence)).otherwise(F.concat(F.lit("graph TD\n"), c))
    headed = F.when(found.rlike(begins), found).otherwise(F.concat(F.lit("graph TD\n"), found))
    return F.when(filled(c) != "", headed)


def unfenced_diagram(c: Column) -> Column:
    return stripped(F.regexp_replace(filled(c), r"(?i)```mermaid\n?|```\n?", ""))


def html_escaped(c: Column) -> Column:
    for raw, shown in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        c = F.replace(c, F.lit(raw), F.lit(shown))
    return c


def file_stem(c: Column, default: str = "session") -> Column:
    stem = F.regexp_replace(F.coalesce(F.nullif(c, F.lit("")), F.lit(default)), r"\.[^.]+$", "")
    stem = F.regexp_replace(F.regexp_replace(stem, r"[^\w一-龥-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(stem, F.lit("")), F.lit(default))


def human_size(n: Column) -> Column:
    """Bytes in the largest unit that leaves at least one; one decimal under ten, but never of bytes. Halves
    go up in whole numbers and to the even digit in decimals, as printf has them."""
    n = n.cast("double")
    out = F.format_string("%.0f B", n)
    for power, unit in ((1, "KB"), (2, "MB"), (3, "GB")):
        size = n / 1024.0**power
        # Java's formatter would take halves up here too.
        tenth = F.format_string(f"%.1f {unit}", F.bround(size, 1))
        shown = F.when(size >= 10, F.format_string(f"%.0f {unit}", size)).otherwise(tenth)
        out = F.when(size >= 1, shown).otherwise(out)
    return out


def math_delimiters(c: Column) -> Column:
    r"""CRLF to LF, \[..\] to $$..$$ and \(..\) to $..$; both dollars stay."""
    c = F.regexp_replace(filled(c), "\r\n", "\n")
    c = F.regexp_replace(c, r"(?s)\\\[(.*?)\\\]", r"\$\$$1\$\$")
    return F.regexp_replace(c, r"(?s)\\\((.*?)\\\)", r"\$$1\$")


#: Marks that stand for formulas while a text is rendered; what is a formula.
_MARK = r"@@MATH(?:BLOCK|INLINE)\d+@@"
_BLOCK = r"(?s)\$\$.*?\$\$|" + _MARK
_INLINE = r"(?U)\$(?!\s)(?:(?!@@MATH)[^$])+?\$"


def protected_math(c: Column) -> Column:
    """struct<text, blocks, inline>: each formula replaced by a numbered mark and kept under its number, those
    in $$..$$ in ``blocks``, their marks as paragraphs of their own, then those in $..$ in ``inline``.
    Delimiters are made alike before, by ``math_delimiters``. What looks like a mark already counts as a
    formula, and no formula in a line holds a mark, so ``restored_math`` is exact."""

    def marked(text: Column, pattern: str, before: str, after: str) -> Column:
        pieces = F.split(text, pattern, -1)
        shown = F.transform(pieces, lambda p, i: F.when(i > 0, F.concat(F.lit(before), (i - 1).cast("string"), F.lit(after), p)).otherwise(p))
        return F.array_join(shown, "")

    found = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    c = math_delimiters(c)
    shown = marked(c, _BLOCK, "\n\n@@MATHBLOCK", "@@\n\n")
    return F.struct(marked(shown, _INLINE, "@@MATHINLINE", "@@").alias("text"), found(c, _BLOCK).alias("blocks"), found(shown, _INLINE).alias("inline"))


def restored_math(text: Column, blocks: Column, inline: Column) -> Column:
    """A text with its marks replaced by their formulas: marks in line, as paragraphs, or as the HTML
    paragraphs a renderer has made of those. In one pass, however many there are; ``blocks`` and ``inline``
    should be plain columns."""
    pattern = r"\n\n@@MATHBLOCK\d+@@\n\n|<p>@@MATHBLOCK\d+@@</p>|" + _MARK

    def formula(mark: Column) -> Column:
        number = F.regexp_extract(mark, r"(\d+)@@", 1).try_cast("int")
        return F.when(mark.contains("MATHBLOCK"), F.get(blocks, number)).otherwise(F.get(inline, number))

    found = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), formula)
    return F.array_join(F.zip_with(F.split(text, pattern, -1), found, lambda p, f: F.concat(p, F.coalesce(f, F.lit("")))), "")


def error_hints(c: Column) -> Column:
    """Which of three hints an error message calls for."""
    text = stripped(filled(c))
    # What each hint goes by.
    return F.array_compact(
        F.array(
            F.when(text.rlike("(?i)API Key|认证失败|401"), "check the API key"),
            F.when(text.rlike("(?i)OPENAI_BASE_URL|网页内容|HTML 页面|网页地址"), "check the base URL"),
            F.when(text.rlike("(?i)429|限流"), "slow down and retry"),
        )
    )


#: What makes a failed call worth repeating.
RETRY_MARKERS = ("超时", "timeout", "连接失败", "connection", "429", "限流", "502", "503", "504", "网关")


def is_retryable(c: Column) -> Column:
    return F.lower(filled(c)).rlike("|".join(RETRY_MARKERS))


#: Reply codes that have a message of their own.
STATUS_MESSAGES = {
    400: "bad request: check model, parameters and interface",
    401: "not authenticated: check the API key",
    403: "refused: the key may not use this model or interface",
    404: "no such address or model",
    408: "the request timed out, try again later",
    409: "the request conflicts with another, try again later",
    415: "media type not supported by the provider",
    422: "the request cannot be processed: check its content",
    429: "rate limited: try later or lower the concurrency",
    500: "internal error of the provider, try again later",
    502: "bad gateway, try again later",
    503: "unavailable for now, try again later",
    504: "gateway timed out, try again later",
}


def status_message(code: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in STATUS_MESSAGES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, code.cast("int")), F.format_string("request failed with status %d", code.cast("int")))


def json_or_error(content_type: Column, body: Column) -> Column:
    """A reply body as JSON text: unreadable JSON is {}, other content an object with ``error``."""
    is_json = F.lower(filled(content_type)).contains("application/json")
    good = F.try_parse_json(body).isNotNull()
    return F.when(is_json, F.when(good, body).otherwise("{}")).otherwise(F.to_json(F.struct(filled(body).alias("error"))))
