"""Reports as Markdown columns, and sanitising of generated HTML."""

from __future__ import annotations

import html
import re
import urllib.parse
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import filled

#: Tags of prompts shown as blocks.
PROMPT_TAGS = ("role", "context", "task", "constraints", "output_format", "input", "self_check")
_TAGS = re.compile(rf"<({'|'.join(PROMPT_TAGS)})>\s*(.*?)\s*</\1>", re.IGNORECASE | re.DOTALL)
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


def _escaped(text: str) -> str:
    return html.escape(text, quote=True).replace("&#x27;", "&#39;")


@F.pandas_udf(T.StringType())
def prompt_blocks(texts: pd.Series) -> pd.Series:
    """Tagged parts of prompts as titled blocks with their bodies escaped."""

    def block(m: re.Match) -> str:
        title, body = _escaped(m[1].replace("_", " ")), _escaped(m[2].strip())
        # Fixed value: the markup that style sheets know.
        return f'\n\n<div class="prompt-block"><div class="prompt-block-title">{title}</div><div class="prompt-block-body">{body}</div></div>\n\n'

    return texts.map(lambda t: None if t is None else _TAGS.sub(block, t))


class _Sanitiser(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=False)
        self.base, self.out = base, []

    def link(self, raw: str | None) -> str:
        whole = urllib.parse.urljoin(self.base, (raw or "").strip()) if raw else ""
        return whole if urllib.parse.urlparse(whole).scheme in ("http", "https", "mailto") else "#"

    def handle_starttag(self, tag, attrs):
        kept = {k: v for k, v in attrs if not k.startswith("on")}
        if tag == "a":
            kept |= {"href": self.link(kept.get("href")), "target": "_blank", "rel": "noopener noreferrer"}
        if tag == "img":
            kept |= {"src": self.link(kept.get("src")), "loading": "lazy"}
        self.out.append("<" + tag + "".join(f' {k}="{_escaped(v or "")}"' for k, v in kept.items()) + ">")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.out.append(f"</{tag}>")

    def handle_endtag(self, tag):
        if tag not in _VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        self.out.append(data)

    def handle_entityref(self, name):
        self.out.append(f"&{name};")

    def handle_charref(self, name):
        self.out.append(f"&#{name};")


@F.pandas_udf(T.StringType())
def sanitised_html(pages: pd.Series) -> pd.Series:
    """HTML without handlers, with links and images limited to safe addresses; comments go."""

    def clean(text: str) -> str:
        p = _Sanitiser("https://localhost/")
        p.feed(text)
        p.close()
        return "".join(p.out)

    return pages.map(lambda t: None if t is None else clean(t))


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(filled(c.cast("string")), F.lit("")), F.lit(default))


def analysis_report(r: DataFrame, version: str, generated_at: Column, with_evaluation: bool = False, elapsed: Column | None = None) -> Column:
    """The Markdown report of one analysis row: source_filename, char_count and the sections' contents."""
    evaluation = [F.lit("## Evaluation\n\n"), filled(r["evaluation"]), F.lit("\n\n---\n")] if with_evaluation else []
    return F.concat(
        F.lit("# Analysis report\n\n> Generated: "), F.date_format(generated_at, "yyyy-MM-dd HH:mm:ss"), F.lit("\n> Source: "), filled(r["source_filename"]),
        F.lit("\n> Elapsed: "), _or(elapsed if elapsed is not None else F.lit(None), "N/A"), F.lit("s\n\n---\n\n## Summary\n\n"), filled(r["summary"]),
        F.lit("\n\n---\n\n## Quotes\n\n"), filled(r["quotes"]), F.lit("\n\n---\n\n## Structure\n\n"), filled(r["mindmap"]), F.lit("\n\n---\n\n"),
        *evaluation, F.lit(f"## About\n\n- Version: {version}\n- Characters: "), filled(r["char_count"].cast("string")), F.lit("\n"),
    )


def command_report(r: DataFrame, version: str, generated_at: Column, mode: str, model: str, concurrency: int) -> Column:
    """The report of the command-line run, which names its source path and how it ran."""
    return F.concat(
        F.lit("# Analysis report\n\n> Generated: "), F.date_format(generated_at, "yyyy-MM-dd HH:mm:ss"), F.lit("\n> Source: "), filled(r["path"]),
        F.lit(f"\n> Version: {version}\n> Mode: {mode}\n> Model: {model}\n> Concurrency: {concurrency}\n\n---\n\n## Summary\n\n"), filled(r["summary"]),
        F.lit("\n\n---\n\n## Quotes\n\n"), filled(r["quotes"]), F.lit("\n\n---\n\n## Structure\n\n"), filled(r["mindmap"]), F.lit("\n"),
    )


def turns_markdown(turns: DataFrame) -> DataFrame:
    """(session_id, qa): numbered questions and answers in order of turn."""
    q, a = _or(F.col("question"), "_No question text._"), _or(F.col("answer"), "_No answer text._")
    ordered = F.array_sort(F.collect_list(F.struct("turn", q.alias("q"), a.alias("a"))))
    shown = F.transform(
        ordered, lambda t, i: F.concat(F.lit("### Q"), (i + 1).cast("string"), F.lit("\n\n"), t["q"], F.lit("\n\n### A"), (i + 1).cast("string"), F.lit("\n\n"), t["a"], F.lit("\n"))
    )
    return turns.groupBy("session_id").agg(F.array_join(shown, "\n").alias("qa"))


def session_markdown(sessions: DataFrame, turns: DataFrame) -> DataFrame:
    """(session_id, markdown): overview, sections with words for what is missing, optional evaluation,
    diagram and conversation. ``sessions`` has session_id, source_filename, char_count and the sections."""
    s = sessions.join(turns_markdown(turns), "session_id", "left")
    rule = "\n\n---\n\n"
    parts = [
        F.concat(
            F.lit("# Session report\n\n## Session\n\n| Item | Value |\n| --- | --- |\n| Source file | "), _or(s["source_filename"], "N/A"),
            F.lit(" |\n| Session ID | "), s["session_id"].cast("string"), F.lit(" |\n| Character count | "), _or(s["char_count"], "N/A"), F.lit(" |"),
        ),
        F.concat(F.lit("## Overview\n\n"), _or(s["summary"], "_No summary generated._")),
        F.concat(F.lit("## Citations\n\n"), _or(s["quotes"], "_No citations generated._")),
        F.concat(F.lit("## Structure\n\n"), _or(s["mindmap"], "_No structure generated._")),
        F.when(filled(s["evaluation"]) != "", F.concat(F.lit("## Evaluation\n\n"), s["evaluation"])),
        F.when(filled(s["mermaid"]) != "", F.concat(F.lit("## Diagram\n\n```mermaid\n"), s["mermaid"], F.lit("\n```"))),
        F.when(s["qa"].isNotNull(), F.concat(F.lit("## Questions\n\n"), s["qa"])),
    ]
    return s.select("session_id", F.concat_ws(rule, *parts).alias("markdown"))


def standalone_svg(svg: Column) -> Column:
    """An SVG as a file of its own: namespace and prolog added where missing."""
    named = F.when(svg.contains("xmlns="), svg).otherwise(F.regexp_replace(svg, r"^\s*<svg", '<svg xmlns="http://www.w3.org/2000/svg"'))
    return F.when(named.startswith("<?xml"), named).otherwise(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n'), named))


def export_timestamp(at: Column, now: Column | None = None) -> Column:
    """A time as exports show it; one that can't be read is ``now``."""
    read = F.coalesce(at.try_cast("timestamp_ntz"), (now if now is not None else F.current_timestamp()).cast("timestamp_ntz"))
    return F.date_format(read, "M/d/yyyy, h:mm:ss a")
