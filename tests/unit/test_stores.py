"""Files that are there whole or not at all, addresses tried in order, sessions that outlive their compaction."""

import os
import threading
import urllib.error
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators import storage
from lectern.operators.providers import OfflineProvider
from lectern.operators.session_store import SessionStore
from lectern.plans.imports import imported, request_status
from lectern.sources import file_sink, papers_api
from tests.unit.test_flows import DOCX, _Reply


def files_in(path):
    return {n: open(f"{path}/{n}", "rb").read() for n in os.listdir(path)} if os.path.exists(path) else {}


def test_files_are_put_in_place_at_commit(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([(f"{k}.txt", bytearray(b"x" * k)) for k in range(0, 40)] + [("a/b", bytearray(b"y")), (None, bytearray(b"y")), ("none", None), ("..", bytearray(b"y"))], "name string, content binary")
    left = file_sink.saved(rows, path, limit=30)
    want = {f"{k}.txt": b"x" * k for k in range(1, 31)}
    assert files_in(path) == want
    assert sorted(r.error for r in left.collect()) == sorted(["empty file"] * 2 + ["not a file name"] * 3 + ["larger than 30 bytes"] * 9)
    file_sink.saved(rows, path, limit=30)  # again: the same files
    assert files_in(path) == want


def test_a_write_that_fails_leaves_nothing(spark, tmp_path):
    path = str(tmp_path / "out")
    spark.dataSource.register(file_sink.FileSink)
    rows = spark.range(100).select(F.concat("id", F.lit(".txt")).alias("name"), F.when(F.col("id") < 99, F.encode(F.lit("text"), "UTF-8")).alias("content"))
    with pytest.raises(Exception, match="empty file"):
        rows.write.format("lectern_files").mode("append").save(path)
    assert files_in(path) == {}
    file_sink.saved_texts(spark.range(3), path, F.concat("id", F.lit(".md")), F.lit("té"))
    assert files_in(path) == {f"{k}.md": "té".encode() for k in range(3)}


def test_spread_files_are_read_back(spark, tmp_path):
    path = str(tmp_path / "out")
    want = {f"{k}.txt": b"x" * k for k in range(1, 300)} | {n: n.encode() for n in ("a b.txt", "_x.md", ".y", "%20é.txt", "z.gz", "00")} | {"large.txt": b"y" * 5_000_000}
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in want.items()] + [("empty", bytearray())], "name string, content binary")
    for _ in range(2):  # again: the same files
        assert [r.error for r in file_sink.saved(rows, path, spread=True).collect()] == ["empty file"]
        got = file_sink.stored(spark, path).collect()
        assert len(got) == len(want) and {r.name: bytes(r.content) for r in got} == want and all(r.length == len(want[r.name]) for r in got)
    assert os.listdir(path) and set(os.listdir(path)) <= set(file_sink.FOLDERS)
    rows.where("name = 'z.gz'").write.format("lectern_files").option("spread", True).mode("overwrite").save(path)
    assert [r.name for r in file_sink.stored(spark, path).collect()] == ["z.gz"]
    file_sink.saved(rows.where("name = 'z.gz'"), str(tmp_path / "flat"))
    assert files_in(str(tmp_path / "flat")) == {"z.gz": b"z.gz"}
    with pytest.raises(Exception, match="FileNotFoundError"):
        file_sink.stored(spark, str(tmp_path / "none")).collect()


def opener(folder):
    def open_url(link):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(link)
        if "404" in link:
            raise urllib.error.HTTPError(link, 404, "Not Found", {}, None)
        kind = "text/html" if "page" in link else "text/plain" if link.endswith("txt") else ""
        body = DOCX if link.endswith("docx") else b"broken" if link.endswith("pptx") else b"First one. Second\ttwo.\n\n\n\nThird."
        return _Reply(body, {"Content-Type": kind, "Content-Disposition": 'filename="given name.txt"' if "named" in link else None}, link)

    return open_url


PAPERS = [
    ("a", "A title", "http://x.org/a.txt", "http://x.org/unused.txt"), ("b", "B", "http://x.org/404.pdf", "http://x.org/b.docx"), ("c", "C", "http://x.org/page1", "http://x.org/404.txt"),
    ("d", "D", "http://10.0.0.1/d.txt", "http://x.org/not-direct"), ("e", "E", None, "http://x.org/named.txt"), ("f", "F", " ", None), ("g", "G", "http://x.org/g.pptx", None),
    ("h", "H", "http://x.org/odd.bin", "http://x.org/h.txt"), ("a", "A title", "http://x.org/a.txt", "http://x.org/unused.txt"),
]


def calls(folder):
    return sorted(open(f"{folder}/{n}").read().rsplit("/", 1)[1] for n in os.listdir(folder))


def test_addresses_are_tried_until_one_is_good(spark, tmp_path):
    os.makedirs(tmp_path / "calls")
    rows = spark.createDataFrame(PAPERS, "paper_id string, title string, pdf_url string, url string")
    fetch = lambda c: papers_api.downloaded(c, open_url=opener(str(tmp_path / "calls")))
    out = papers_api.resolved(rows.where("paper_id <> 'f'"), fetch=fetch)
    got = {r.paper_id: (r.link.rsplit("/", 1)[1], r.error) for r in out.collect()}
    assert got == {
        "a": ("a.txt", None), "b": ("b.docx", None), "c": ("404.txt", "the file is not at its source"), "d": ("not-direct", "not a direct file"), "e": ("named.txt", None),
        "g": ("g.pptx", None), "h": ("h.txt", None),
    }
    out.count()
    assert calls(tmp_path / "calls") == sorted(["a.txt", "404.pdf", "b.docx", "page1", "404.txt", "named.txt", "g.pptx", "odd.bin", "h.txt"])


def test_papers_are_imported(spark, tmp_path):
    os.makedirs(tmp_path / "calls")
    rows = spark.createDataFrame([(*p, "no" if p[0] == "b" else None) for p in PAPERS], "paper_id string, title string, pdf_url string, url string, generate_mermaid string")
    fetch = lambda c: papers_api.downloaded(c, open_url=opener(str(tmp_path / "calls")))
    out = imported(rows, OfflineProvider(), folder=str(tmp_path / "in"), fetch=fetch).collect()
    assert {r.paper_id: (r.source_filename, r.char_count, r.status, r.error) for r in out} == {
        "a": ("a.txt", 30, 200, None), "b": ("b.docx", 25, 200, None), "c": (None, None, 400, "the file is not at its source"), "d": (None, None, 400, "not a direct file"),
        "e": ("given_name.txt", 30, 200, None), "f": (None, None, 400, "address required"), "g": ("g.pptx", None, 400, next(r.error for r in out if r.paper_id == "g")), "h": ("h.txt", 30, 200, None),
    }
    made = {r.paper_id: r for r in out}
    assert made["a"].mermaid.startswith("graph TD") and made["a"].evaluation and made["a"].sections["evaluation"].status == "success"
    assert made["b"].sections["mermaid"].status == "disabled" and made["g"].error.startswith("could not read .pptx")
    assert len(files_in(tmp_path / "in" / "files")) == 5 and len(calls(tmp_path / "calls")) == 9


def test_status_of_requests(spark):
    errors = [None, "session token invalid", "session not found", "no question", "HTTP 503", "empty file", "address not public"]
    got = spark.createDataFrame([(e,) for e in errors], "e string").select(request_status(F.col("e"))).collect()
    assert [r[0] for r in got] == [200, 403, 400, 400, 500, 400, 400]


AT = datetime(2024, 1, 2, 3, 0, 0)
FIELDS = "session_id string, updated_at timestamp_ntz, expires_at timestamp_ntz, note string"


def rows(spark, *given):
    return spark.createDataFrame(list(given), FIELDS)


def held(df):
    return {r.session_id: r.note for r in df.collect()}


def test_sessions_are_written_cleaned_and_read_back(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "s"), FIELDS, buckets=8)
    assert store.sessions().count() == 0 and store.cleanup(AT, force=True)
    hour = timedelta(hours=1)
    store.append(rows(spark, ("old", AT, AT + hour, "1"), ("never", AT, None, "1"), ("edge", AT, AT + 2 * hour, "1"), ("twice", AT, AT + hour, "1")))
    store.append(rows(spark, ("twice", AT, AT + 5 * hour, "2"), ("late", AT + hour, AT + hour, "1")))
    store.append(rows(spark, ("slid", None, None, "1")), now=F.lit(AT + hour), ttl=7200)
    assert held(store.sessions()) == {"old": "1", "never": "1", "edge": "1", "twice": "2", "late": "1", "slid": "1"}
    assert not store.cleanup(AT + timedelta(seconds=599)) and store.cleanup(AT + 2 * hour)
    alive = {"never": "1", "edge": "1", "twice": "2", "slid": "1"}
    assert held(store.sessions()) == alive and store.versions().count() == 4
    # An older version that comes after a compaction doesn't win by its place, a newer one does.
    store.append(rows(spark, ("twice", AT - hour, AT + 9 * hour, "older"), ("edge", AT + hour, AT + 9 * hour, "newer"), ("old", AT + hour, AT + 9 * hour, "back")))
    assert held(store.sessions()) == alive | {"edge": "newer", "old": "back"}
    store.vacuum()
    assert held(store.sessions()) == alive | {"edge": "newer", "old": "back"} and len(os.listdir(tmp_path / "s" / "data")) == 2


def test_a_point_read_touches_one_bucket(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "s"), FIELDS, buckets=8)
    store.append(spark.range(200).select(F.concat(F.lit("s"), "id").alias("session_id"), F.lit(AT).cast("timestamp_ntz").alias("updated_at"), F.col("id").cast("string").alias("note")))
    one = store.session("s17")
    assert held(one) == {"s17": "17"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan
    paths = [p for p in store.versions().where("session_id = 's17'").select("bucket").distinct().collect()]
    assert len(paths) == 1
    assert store.session("none").count() == 0


def test_writers_that_overlap_lose_nothing(spark, tmp_path):
    store = SessionStore(spark, str(tmp_path / "s"), FIELDS, buckets=2)
    store.append(rows(spark, ("first", AT, None, "1")))
    threads = [threading.Thread(target=store.append, args=(rows(spark, (f"t{k}", AT, None, str(k))),)) for k in range(5)]
    threads.append(threading.Thread(target=store.cleanup, args=(AT,), kwargs={"force": True}))
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert held(store.sessions()) == {"first": "1"} | {f"t{k}": str(k) for k in range(5)}
    assert store.manifest()[0] == 7


@pytest.mark.parametrize("links", [True, False])
def test_a_name_is_taken_by_one_writer(spark, tmp_path, monkeypatch, links):
    writers, wins = 8 if links else 1, []
    if not links:
        monkeypatch.setattr(os, "link", lambda *a: (_ for _ in ()).throw(PermissionError("no hard links")))
    start = threading.Barrier(writers)

    def write(k):
        for n in range(20):
            start.wait()
            if storage.created(spark, f"{tmp_path}/m/{n}.json", f"writer {k}"):
                wins.append((n, f"writer {k}"))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(writers)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(n for n, _ in wins) == list(range(20))
    assert all(storage.content(spark, f"{tmp_path}/m/{n}.json") == text for n, text in wins)
    assert storage.entries(spark, f"{tmp_path}/m") == sorted(f"{n}.json" for n in range(20))
    assert not storage.created(spark, f"{tmp_path}/m/0.json", "late")


def test_lookups_shuffle_the_requests_alone(spark, tmp_path):
    from lectern.operators.sessions import token_hash, validated

    store = SessionStore(spark, str(tmp_path / "s"), "session_id string, updated_at timestamp_ntz, expires_at timestamp_ntz, token_hash string", buckets=4)
    for k in (0, 1):  # the second write has the token that counts
        store.append(spark.range(300).select(F.concat(F.lit("s"), "id").alias("session_id"), F.lit(AT + timedelta(k)).cast("timestamp_ntz").alias("updated_at"), token_hash(F.concat(F.lit(f"t{k}-"), "id")).alias("token_hash")))
    name = f"sessions_{uuid.uuid4().hex}"
    held_back = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = store.bucketed(name, 6)
        requests = spark.range(400).select(F.col("id").alias("request_id"), F.concat(F.lit("s"), "id").alias("session_id"), F.concat(F.lit("t"), (F.col("id") % 2).cast("string"), F.lit("-"), "id").alias("token"))
        out = validated(requests, table)
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {r.request_id: r.error for r in out.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held_back)
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in plan[plan.index("FileScan parquet") - 400 : plan.index("FileScan parquet")].split("SortMergeJoin")[-1].split(":- ")[-1]
    assert got == {k: "session not found" if k >= 300 else None if k % 2 else "session token invalid" for k in range(400)}
