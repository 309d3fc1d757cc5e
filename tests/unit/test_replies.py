"""Each request is one call: of providers and of interfaces, whatever is read and whatever fails."""

import http.server
import json
import os
import subprocess
import sys
import threading
import uuid
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.operators.replies import ReplyStore, answered_once
from lectern.plans import pipelines
from lectern.sources import papers_api


class Counting:
    """Notes each call in a folder; prompts with a word in ``broken`` end their worker, once each."""

    def __init__(self, folder, broken=()):
        self.folder, self.broken = str(folder), tuple(broken)
        os.makedirs(self.folder, exist_ok=True)

    def __call__(self, task, prompt):
        for word in self.broken:
            mark = f"{self.folder}/broke-{word}"
            if word in prompt and not os.path.exists(mark):
                open(mark, "w").close()
                os._exit(7)
        with open(f"{self.folder}/call-{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        if "refuse" in prompt:
            raise ValueError("HTTP 503")
        return json.dumps({"rewritten_query": prompt.split("Context:\n")[-1][:20], "topics": ["t"], "why": uuid.uuid4().hex})

    def calls(self):
        return Counter(open(f"{self.folder}/{n}").read() for n in os.listdir(self.folder) if n.startswith("call-"))


def test_one_call_a_session_for_items_and_outcomes(spark, tmp_path):
    held = spark.createDataFrame([(f"s{k}", f"text {k}", None) for k in range(10)], "session_id string, document_content string, document_excerpt string")

    def fetch(queries):
        found = queries.select("query_id", F.lit(json.dumps({"data": [{"paperId": "p", "title": "T"}]})).alias("body"))
        none = queries.where("false").select("query_id", F.lit("arXiv").alias("source"), F.lit(1).cast("long").alias("status"), F.lit("").alias("reason"))
        return papers_api.scholar_records(found), none

    provider, store = Counting(tmp_path / "calls"), ReplyStore(spark, path=str(tmp_path / "store"))
    items, outcomes = pipelines.recommended(held, provider, fetch, store=store)
    shown = {r.query_id: r.reason for r in items.collect()}
    assert len(shown) == 10 and {r.query_id: r.reason for r in outcomes.collect()} == shown  # the branches agree
    assert items.count() == 10 and outcomes.count() == 10
    assert sum(provider.calls().values()) == 10
    again, _ = pipelines.recommended(held, provider, fetch, store=store)
    assert {r.query_id: r.reason for r in again.collect()} == shown and sum(provider.calls().values()) == 10


def prompts(spark, texts):
    return spark.createDataFrame([(k, "quotes", t) for k, t in enumerate(texts)], "n long, task string, prompt string")


def test_a_failed_job_resumes(spark, tmp_path):
    provider, store = Counting(tmp_path / "calls", ["number 7"]), ReplyStore(spark, path=str(tmp_path / "store"))
    rows = prompts(spark, [f"number {k}" for k in range(12)]).coalesce(1)
    with pytest.raises(Exception):
        answered_once(rows, provider, store, 5)
    begun = sum(provider.calls().values())
    assert 0 < begun < 12 and store.runs() == []
    assert answered_once(rows, provider, store, 5).where("reply IS NOT NULL").count() == 12
    assert set(provider.calls().values()) == {1} and len(provider.calls()) == 12
    left = [f for _, _, files in os.walk(tmp_path / "store" / "journal") for f in files]
    assert left == [] and len(store.runs()) == 1


def test_failures_hold_for_their_run_only(spark, tmp_path):
    provider, store = Counting(tmp_path / "calls"), ReplyStore(spark, path=str(tmp_path / "store"))
    rows = prompts(spark, ["good", "refuse", "good", None])
    out = answered_once(rows, provider, store, 5)
    for _ in range(2):
        assert [(r.n, r.reply is not None, r.error) for r in out.orderBy("n").collect()] == [(0, True, None), (1, False, "HTTP 503"), (2, True, None), (3, False, None)]
    assert provider.calls() == {"good": 1, "refuse": 1}
    answered_once(rows, provider, store, 5)
    assert provider.calls() == {"good": 1, "refuse": 2}
    store.compact()
    assert len(store.runs()) == 1 and store.known().count() == 1


RETRIED = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from lectern.operators.replies import ReplyStore, answered_once
from tests.unit.test_replies import Counting, prompts
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "1g").getOrCreate()
provider = Counting({calls!r}, ["number 5", "number 9"])
out = answered_once(prompts(spark, [f"number {{k}}" for k in range(12)]), provider, ReplyStore(spark, path={store!r}), 5)
assert out.where("reply IS NOT NULL").count() == 12
spark.stop()
"""


def test_a_failed_task_is_repeated_without_new_calls(tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = RETRIED.format(repo=repo, calls=str(tmp_path / "calls"), store=str(tmp_path / "store"))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300, cwd=repo)
    assert done.returncode == 0, done.stderr[-2000:]
    calls = Counting(tmp_path / "calls")
    assert set(calls.calls().values()) == {1} and len(calls.calls()) == 12
    assert {n for n in os.listdir(tmp_path / "calls") if n.startswith("broke")} == {"broke-number 5", "broke-number 9"}


@pytest.fixture
def interface():
    """A local interface of both kinds that counts its calls by path and query."""
    calls = Counter()

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            calls[self.path] += 1
            calls["agent:" + self.headers.get("User-Agent", "")] += 1
            if "down" in self.path:
                self.send_error(404)
                return
            atom = self.path.startswith("/atom")
            body = "<feed><entry><id>a</id><title>B</title></entry></feed>" if atom else '{"data":[{"paperId":"p","title":"A"}]}'
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body.encode())

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield calls, f"http://127.0.0.1:{server.server_port}"
    server.shutdown()


def test_one_call_a_query_and_source(spark, tmp_path, interface):
    calls, base = interface
    store = ReplyStore(spark, papers_api.OUTCOME, str(tmp_path / "store"))
    fetch = papers_api.live_sources(store=store, bases={"scholar": f"{base}/scholar", "atom": f"{base}/atom"}, max_concurrency=5)
    queries = spark.createDataFrame([(k, f"query {k % 9}" if k else "down", "5") for k in range(10)] + [(10, " ", "5")], "query_id long, query string, limit string")
    items, outcomes = pipelines.searched(queries, fetch)
    found, told = items.collect(), outcomes.collect()
    assert items.count() == len(found) == 18 and outcomes.count() == len(told) == 11
    assert {r.query_id: r.errors for r in told if r.errors} == {0: ["Semantic Scholar: HTTP 404", "arXiv: HTTP 404"], 10: ["empty query"]}
    seen = {k: v for k, v in calls.items() if k.startswith("/")}
    assert set(seen.values()) == {1} and len(seen) == 20  # nine queries that differ and the one that fails, two sources
    assert calls["agent:lectern"] == 20


def test_one_limit_for_all_tasks_and_a_pause_all_keep(spark, tmp_path):
    """A local interface never has more calls open than the limit, and after it refuses one, none comes but
    those of the same round for the length of the pause."""
    import time

    from lectern.operators import replies
    from lectern.operators.providers import HttpProvider

    lock, state, starts = threading.Lock(), {"open": 0, "most": 0, "refused": None, "calls": Counter()}, []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            prompt = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["messages"][1]["content"]
            with lock:
                starts.append(time.time())
                state["open"] += 1
                state["most"] = max(state["most"], state["open"])
                state["calls"][prompt] += 1
                first = prompt == "number 3" and state["calls"][prompt] == 1
            time.sleep(0.2)
            with lock:
                state["open"] -= 1
                if first or prompt == "number 5":
                    state["refused"] = state["refused"] or time.time()
            body = json.dumps({"choices": [{"message": {"content": "ok " + prompt}}]}).encode()
            self.send_response(429 if first or prompt == "number 5" else 200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        provider = HttpProvider(f"http://127.0.0.1:{server.server_port}", "key", "m")
        out = answered_once(prompts(spark, [f"number {k}" for k in range(24)]), provider, ReplyStore(spark, path=str(tmp_path / "store"), per_round=1), 5)
        got = {r.prompt: (r.reply, r.error) for r in out.collect()}
    finally:
        server.shutdown()
    assert got["number 3"] == ("ok number 3", None) and got["number 5"] == (None, "HTTP Error 429: Too Many Requests") and sum(r is not None for r, _ in got.values()) == 23
    assert state["most"] <= 5 and state["calls"]["number 3"] == 2 and state["calls"]["number 5"] == replies.ATTEMPTS
    after = sorted(t for t in starts if t > state["refused"])
    gaps = [b - a for a, b in zip([state["refused"], *after], after)]
    pause = next(i for i, gap in enumerate(gaps) if gap > 0.7 * replies.PAUSE)
    assert pause <= 5  # what had begun with the refused call's round, and no more
