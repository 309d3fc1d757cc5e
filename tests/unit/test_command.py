"""The command's run over files, sessions of saved files, and literature as a source."""

import os
import subprocess
import sys
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lectern.operators.providers import OfflineProvider
from lectern.operators.session_store import SessionStore
from lectern.operators.sessions import token_matches
from lectern.plans import command
from lectern.sources import paper_source
from tests.unit.test_flows import DOCX
from tests.unit.test_replies import interface  # noqa: F401

NOW = datetime(2024, 5, 6, 7, 8, 9)


def given_files(folder):
    os.makedirs(folder / "sub")
    (folder / "a.txt").write_text("One here. Two there.\n\n\n\nThree.")
    (folder / "sub" / "a.docx").write_bytes(DOCX)
    (folder / "blank.txt").write_text(" \n ")
    (folder / "odd.exe").write_text("x")


def test_reports_of_a_run(spark, tmp_path):
    given_files(tmp_path / "in")
    done, rejects = command.run(spark, str(tmp_path / "in"), str(tmp_path / "out"), OfflineProvider(), now=NOW)
    assert {r.source_filename: r.char_count for r in done.collect()} == {"a.txt": 28, "a.docx": 25}
    assert {r.path.rsplit("/", 1)[1]: r.error for r in rejects.collect()} == {"blank.txt": "no text in file", "odd.exe": "unsupported file type .exe"}
    names = sorted(os.listdir(tmp_path / "out"))
    assert len(names) == 2 and all(n.startswith("a_20240506_070809_") and n.endswith(".md") for n in names)  # one name, one second, two reports
    text = "".join((tmp_path / "out" / n).read_text() for n in names)
    assert text.count("# Analysis report") == 2 and "> Mode: offline" in text and "- One here." in text


def test_sessions_of_saved_files(spark, tmp_path):
    given_files(tmp_path / "in")
    store = SessionStore(spark, str(tmp_path / "sessions"), buckets=4)
    store.append(spark.createDataFrame([("gone", NOW - timedelta(seconds=1))], "session_id string, expires_at timestamp_ntz"))
    made, rejects = command.run_sessions(spark, str(tmp_path / "in"), store, str(tmp_path / "out"), OfflineProvider(), now=NOW)
    given = {r.session_id: r for r in made.collect()}
    held = {r.session_id: r for r in store.sessions().collect()}
    assert set(held) == set(given) and len(held) == 2 and rejects.count() == 2 and len(os.listdir(tmp_path / "out")) == 2
    for r in held.values():
        assert (r.updated_at, r.expires_at - r.updated_at) == (NOW, timedelta(days=1))
        assert r.analysis.sections["evaluation"].status == "success" and r.analysis.mermaid.startswith("graph TD")
    both = store.sessions().join(made.select("session_id", "token"), "session_id")
    assert both.where(token_matches(F.col("session_auth.token_hash"), F.col("token"))).count() == 2
    assert "token" not in {f.name for f in store.fields} and len({r.token for r in given.values()}) == 2


def test_the_command(tmp_path):
    given_files(tmp_path / "in")
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-m", "lectern", str(tmp_path / "in"), "--out", str(tmp_path / "out"), "--offline"], capture_output=True, text=True, timeout=300, cwd=repo)
    assert done.returncode == 1, done.stderr[-2000:]  # there were rejects
    assert "no text in file" in done.stdout and len(os.listdir(tmp_path / "out")) == 2


def test_filters_reach_the_source(spark, interface, capsys):  # noqa: F811
    calls, base = interface
    records, failed = paper_source.papers_of(spark, ["one", "two", "down", " "], limit=3, source="scholar", url=f"{base}/scholar")
    records.explain("formatted")
    pushed = next(line for line in capsys.readouterr().out.splitlines() if line.startswith("PushedFilters"))
    assert "In(query, [" in pushed and "EqualTo(limit,3)" in pushed
    assert not calls
    assert {(r.query, r.title) for r in records.collect()} == {("one", "A"), ("two", "A")}
    seen = {k: v for k, v in calls.items() if k.startswith("/")}
    assert set(seen.values()) == {1} and len(seen) == 3 and all("limit=3" in k for k in seen)
    assert [(r.query, r.status) for r in failed.collect()] == [("down", 404)]
