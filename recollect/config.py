"""Settings with their defaults, and the reader of environment files."""

from __future__ import annotations

import math
import os
import re
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Config:
    search_mode: str = "hybrid"
    rrf_k: float = 60.0
    vector_cache_warn_mb: int = 256
    max_file_mb: float = 10.0
    allowed_dirs: tuple[str, ...] = ()
    memory_half_life_days: float = 14.0
    dedup_max_vectors: int = 500
    prune: bool = False
    prune_importance: float = 0.2
    prune_age_days: float = 90.0
    session_max_msgs: int = 500
    session_max_log_bytes: int = 64 << 20
    condense: bool = True
    condense_min_chars: int = 120
    condense_ratio: float = 0.35
    embedding_provider: str = "local"
    embedding_model: str = "local-lexical-v2"
    db_dir: str = ".rag-data"
    max_text_units: int = 1_000_000
    extra: dict = field(default_factory=dict)


def number(raw: str | None, fallback: float, valid=lambda n: True) -> float:
    """A finite number that is valid, else the fallback."""
    try:
        n = float(raw) if raw not in (None, "") else math.nan
    except ValueError:
        return fallback
    return n if math.isfinite(n) and valid(n) else fallback


def from_env(env: dict[str, str] | None = None) -> Config:
    e = os.environ if env is None else env
    c = Config()
    mode = e.get("SEARCH_MODE", "").lower()
    return replace(
        c,
        search_mode=mode if mode in ("hybrid", "vector", "keyword") else c.search_mode,
        rrf_k=number(e.get("RAG_RRF_K"), c.rrf_k, lambda n: n > 0),
        vector_cache_warn_mb=int(number(e.get("RAG_VECTOR_CACHE_WARN_MB"), c.vector_cache_warn_mb, lambda n: n > 0)),
        max_file_mb=number(e.get("RAG_MAX_FILE_MB"), c.max_file_mb, lambda n: n > 0),
        allowed_dirs=tuple(x.strip() for x in re.split(r"[;|,]", e.get("RAG_ALLOWED_DIRS", "")) if x.strip()),
        memory_half_life_days=number(e.get("RAG_MEMORY_HALF_LIFE_DAYS"), c.memory_half_life_days, lambda n: n > 0),
        dedup_max_vectors=int(number(e.get("RAG_DEDUP_MAX_VECTORS"), c.dedup_max_vectors, lambda n: n >= 0)),
        prune=e.get("RAG_PRUNE", "") in ("1", "true"),
        prune_importance=number(e.get("RAG_PRUNE_IMPORTANCE"), c.prune_importance),
        prune_age_days=number(e.get("RAG_PRUNE_AGE_DAYS"), c.prune_age_days),
        session_max_msgs=int(number(e.get("RAG_SESSION_MAX_MSGS"), c.session_max_msgs, lambda n: n > 0)),
        session_max_log_bytes=int(number(e.get("RAG_SESSION_MAX_LOG_BYTES"), c.session_max_log_bytes, lambda n: n > 0)),
        condense=e.get("RAG_SESSION_CONDENSE") != "0",
        condense_min_chars=int(number(e.get("RAG_SESSION_CONDENSE_MIN_CHARS"), c.condense_min_chars, lambda n: n >= 50)),
        condense_ratio=number(e.get("RAG_SESSION_CONDENSE_RATIO"), c.condense_ratio, lambda n: 0 < n <= 1),
        embedding_provider="transformers" if e.get("EMBEDDING_PROVIDER") == "transformers" else c.embedding_provider,
        db_dir=e.get("RAG_DB_DIR") or c.db_dir,
    )


_LINE = re.compile(r"\s*(?:export\s+)?([A-Za-z_]\w*)\s*=\s*(.*?)\s*$")


def parse_env_file(text: str, allowed: set[str]) -> dict[str, str]:
    """KEY=VALUE lines with ``export``, quotes and `` #`` comments; allowed keys only."""
    out = {}
    for line in text.splitlines():
        m = _LINE.match(line)
        if not m or line.lstrip().startswith("#") or m[1] not in allowed:
            continue
        value = m[2]
        if value[:1] in "\"'" and (end := value.find(value[0], 1)) > 0:
            value = value[1:end]
        else:
            value = value.split(" #", 1)[0].rstrip()
        out[m[1]] = value
    return out


#: Names that a file of settings may set.
_OURS = re.compile(r"\b(?:RAG_|OPENCODE_|EMBEDDING_)[A-Z0-9_]+|\bSEARCH_MODE\b")


def environment(env: dict[str, str] | None = None, folder: str = ".") -> dict[str, str]:
    """The environment with what the file ``RAG_ENV_FILE``, or ``.env`` in the
    folder, adds; a name that is set already keeps its value.  A file that was
    named and cannot be read is an error, a ``.env`` that is not there is none."""
    e = dict(os.environ if env is None else env)
    path = e.get("RAG_ENV_FILE") or os.path.join(folder, ".env")
    if "RAG_ENV_FILE" not in e and not os.path.isfile(path):
        return e
    with open(path, encoding="utf-8") as f:
        text = f.read()
    return parse_env_file(text, set(_OURS.findall(text))) | e
