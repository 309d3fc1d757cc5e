import io
import urllib.error

import pytest

from lectern import config
from lectern.operators import providers
from lectern.plans import flow_queries, service_queries, text_queries
from lectern.sources import papers_api


class Body(io.BytesIO):
    pass


def test_get_repeats_after_limits_and_lost_connections(monkeypatch):
    waits, replies = [], []
    monkeypatch.setattr(papers_api.time, "sleep", waits.append)

    def opened(request, timeout, context):
        got = replies.pop(0)
        if isinstance(got, Exception):
            raise got
        return Body(got)

    monkeypatch.setattr(papers_api.urllib.request, "urlopen", opened)
    limited = urllib.error.HTTPError("u", 429, "slow down", {}, None)
    replies[:] = [limited, urllib.error.URLError("lost"), "é".encode()]
    assert papers_api.get("https://x.org", 5) == "é" and waits == [2, 4]
    replies[:] = [urllib.error.HTTPError("u", 500, "broken", {}, None), b"never"]
    with pytest.raises(urllib.error.HTTPError):
        papers_api.get("https://x.org", 5)
    replies[:] = [limited] * 3
    with pytest.raises(urllib.error.HTTPError):
        papers_api.get("https://x.org", 5)


def test_providers_repeat_any_failure(monkeypatch):
    waits = []
    monkeypatch.setattr(providers.time, "sleep", waits.append)
    replies = [b"<!DOCTYPE html>", b'{"choices": []}', b'{"choices": [{"message": {"content": [{"type": "text", "text": " a "}]}}]}']
    monkeypatch.setattr(providers.urllib.request, "urlopen", lambda request, timeout: Body(replies.pop(0)))
    ask = providers.HttpProvider("https://x.org/v1/", "k", "m")
    assert ask("quotes", "p") == "a" and waits == [2, 4]
    replies[:] = [b'{"choices": []}'] * 3
    with pytest.raises(ValueError, match="empty reply"):
        ask("quotes", "p")
    streamed = b'data: {"choices":[{"delta":{"content":"a"}}]}\n\ndata: [DONE]\n'
    replies[:] = [streamed]
    assert list(ask.deltas("p")) == ["a"]
    assert providers.concurrency_of(ask, 7) == 7 and providers.concurrency_of(providers.OfflineProvider(), 7) is None


def test_settings_and_keys(tmp_path, monkeypatch):
    (tmp_path / ".env").write_text("# c\nexport OPENAI_MODEL='m'\nOPENAI_MAX_CONCURRENCY=99\nOPENAI_API_KEY=file\n")
    monkeypatch.setenv("OPENAI_API_KEY", "real")
    env = config.env_file(tmp_path / ".env")
    held = config.Settings.load(env)
    assert (held.model, held.max_concurrency, config.api_key(" ", env), config.api_key(" own ", env)) == ("m", 32, "real", "own")
    assert [config.worker_count(n, 3) for n in (0, 2, 9)] == [1, 2, 3]


def test_every_query_has_sql_or_a_test():
    modules = (flow_queries, service_queries, text_queries)
    without = {k for m in modules for k in m.QUERIES if k not in m.ORACLES}
    assert without == set()
