"""Settings, from environment variables that begin with ``TESSERA_``."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Settings:
    repo_path: str = "."
    store: str = ".tessera"
    log_level: str = "INFO"
    master: str = "local[*]"
    collection: str = "code"
    vector_dimension: int | None = None
    embedding_provider: str = "hashing"
    embedding_url: str = ""
    embedding_model: str = ""
    embedding_key: str | None = field(default=None, repr=False)
    embedding_batch_size: int = 32
    embedding_timeout: float = 60.0
    embedding_max_retries: int = 3
    embedding_retry_min_wait: float = 1.0
    embedding_retry_max_wait: float = 10.0
    sync_fallback_threshold: float = 0.20
    sync_max_age_seconds: float = 259_200
    sync_update_embeddings: bool = True

    def __post_init__(self) -> None:
        if not 0 <= self.sync_fallback_threshold <= 1:
            raise ValueError("sync_fallback_threshold must lie between 0 and 1")
        if self.sync_max_age_seconds < 0:
            raise ValueError("sync_max_age_seconds must not be negative")
        if self.log_level not in ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL"):
            raise ValueError(f"unknown log level {self.log_level}")


def load(environ: dict[str, str] | None = None) -> Settings:
    """Settings as the environment gives them, else their defaults."""
    environ = {k.upper(): v for k, v in (os.environ if environ is None else environ).items()}
    given = {}
    for f in fields(Settings):
        raw = environ.get(f"TESSERA_{f.name.upper()}")
        if raw is not None:
            kind = str(f.type)
            given[f.name] = raw.lower() in ("1", "true", "yes", "on") if kind == "bool" else int(raw) if "int" in kind else float(raw) if kind == "float" else raw
    return Settings(**given)


def provider(s: Settings):
    """The embedding provider that the settings name: a registered one, or ``http``."""
    from .functions import embedding

    if s.embedding_provider != "http":
        return embedding.provider(s.embedding_provider)
    return embedding.HttpProvider(s.embedding_url, s.embedding_model, s.embedding_key, s.embedding_batch_size, s.embedding_timeout, s.embedding_max_retries, s.embedding_retry_min_wait, s.embedding_retry_max_wait)
