"""Settings, read from the environment with clamped numbers and lenient booleans."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields
from pathlib import Path

TRUE_WORDS = frozenset({"1", "true", "yes", "on"})


def parse_int(raw: str | None, default: int, low: int, high: int) -> int:
    """``raw`` as a whole number within [low, high]; what doesn't parse is ``default``."""
    try:
        value = int(str(raw).strip())
    except ValueError:
        value = default
    return max(low, min(high, value))


def parse_bool(raw: str | None, default: bool) -> bool:
    return default if raw is None or not raw.strip() else raw.strip().lower() in TRUE_WORDS


def _number(env: str, default: int, low: int, high: int):
    return field(default=default, metadata={"env": env, "range": (low, high)})


@dataclass(frozen=True)
class Settings:
    max_concurrency: int = _number("OPENAI_MAX_CONCURRENCY", 5, 1, 32)
    request_timeout: int = _number("OPENAI_REQUEST_TIMEOUT_SECONDS", 60, 5, 600)
    max_retries: int = _number("OPENAI_MAX_RETRIES", 3, 1, 10)
    scholar_timeout: int = _number("SEMANTIC_SCHOLAR_TIMEOUT_SECONDS", 20, 5, 120)
    scholar_retries: int = _number("SEMANTIC_SCHOLAR_MAX_RETRIES", 3, 1, 6)
    search_limit: int = _number("PAPER_SEARCH_RESULT_LIMIT", 8, 1, 20)
    recommendation_limit: int = _number("PAPER_RECOMMENDATION_RESULT_LIMIT", 6, 1, 20)
    import_timeout: int = _number("REMOTE_IMPORT_TIMEOUT_SECONDS", 30, 5, 180)
    session_ttl: int = _number("SESSION_TTL_SECONDS", 86400, 60, 2592000)
    cleanup_interval: int = _number("SESSION_CLEANUP_INTERVAL_SECONDS", 600, 60, 86400)
    enable_rewrite: bool = field(default=True, metadata={"env": "PAPER_SEARCH_ENABLE_REWRITE"})
    persist_full_document: bool = field(default=True, metadata={"env": "SESSION_PERSIST_FULL_DOCUMENT"})
    model: str = field(default="", metadata={"env": "OPENAI_MODEL"})
    rewrite_model: str = field(default="", metadata={"env": "PAPER_SEARCH_REWRITE_MODEL"})
    base_url: str = field(default="", metadata={"env": "OPENAI_BASE_URL"})
    chunk_size: int = 4000
    overlap: int = 200

    @classmethod
    def load(cls, env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        out = {}
        for f in fields(cls):
            name = f.metadata.get("env")
            if name is None or name not in env:
                continue
            if "range" in f.metadata:
                out[f.name] = parse_int(env[name], f.default, *f.metadata["range"])
            elif isinstance(f.default, bool):
                out[f.name] = parse_bool(env[name], f.default)
            else:
                out[f.name] = env[name].strip()
        return cls(**out)


def env_file(path: str | Path) -> dict[str, str]:
    """Variables of a ``.env`` file overlaid by the real environment, which always wins."""
    out = {}
    if Path(path).is_file():
        for line in Path(path).read_text("utf-8").splitlines():
            name, eq, value = line.strip().removeprefix("export ").partition("=")
            if eq and not name.startswith("#"):
                out[name.strip()] = value.strip().strip("'\"")
    return out | dict(os.environ)


def worker_count(tasks: int, configured: int) -> int:
    return max(1, min(tasks, configured))


def api_key(explicit: str | None, env: dict[str, str] | None = None) -> str:
    return (explicit or "").strip() or (os.environ if env is None else env).get("OPENAI_API_KEY", "").strip()
