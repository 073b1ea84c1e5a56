"""Settings with their bounds."""

from __future__ import annotations

import logging.config
import os
import tempfile
from dataclasses import dataclass, fields
from functools import cache


@dataclass(frozen=True)
class Settings:
    embedding_dim: int = 2560
    embedding_batch_size: int = 32
    embedding_query_instruction: str = ""
    #: without a base there is no client, and searches go by words alone
    embedding_api_base: str = ""
    embedding_api_key: str = ""
    embedding_model: str = ""
    embedding_timeout_seconds: float = 60.0
    embedding_attempts: int = 3
    log_level: str = "INFO"
    chunk_tokens: int = 384
    chunk_token_overlap: int = 32
    fetch_delay_seconds: float = 2.0
    fetch_concurrency: int = 16
    site_poll_interval_seconds: int = 43_200
    site_poll_concurrency: int = 16
    ingest_concurrency: int = 8
    history_post_limit: int = 2000
    pool_max_size: int = 40
    retriever_limit: int = 64
    result_limit: int = 64
    rrf_k: int = 60

    def __post_init__(self) -> None:
        for field in fields(self):
            value = getattr(self, field.name)
            if field.type == "int" and (isinstance(value, bool) or not isinstance(value, int)):
                raise ValueError(f"{field.name} must be a whole number")
        least_zero = {"chunk_token_overlap", "fetch_delay_seconds"}
        for field in fields(self):
            value = getattr(self, field.name)
            if field.type in ("int", "float") and (value < 0 or value == 0 and field.name not in least_zero):
                raise ValueError(f"{field.name} is out of bounds: {value}")
        if self.chunk_token_overlap >= self.chunk_tokens:
            raise ValueError("chunk_token_overlap must be less than chunk_tokens")

    @classmethod
    def from_env(cls, prefix: str = "FERNWEAVE_", env: dict[str, str] | None = None) -> Settings:
        env = dict(os.environ) if env is None else env
        kinds = {"int": int, "float": float, "str": str}
        found = {f.name: kinds[f.type](env[key]) for f in fields(cls) if (key := prefix + f.name.upper()) in env}
        return cls(**found)


def configure_logging(level: str = "INFO") -> None:
    """One handler on stderr with ISO times; the package logs from level on, everything else warnings."""
    logging.config.dictConfig(
        {
            "version": 1,
            "disable_existing_loggers": False,
            "formatters": {"plain": {"format": "%(asctime)s %(levelname)s %(name)s: %(message)s", "datefmt": "%Y-%m-%dT%H:%M:%S%z"}},
            "handlers": {"stderr": {"class": "logging.StreamHandler", "formatter": "plain", "stream": "ext://sys.stderr"}},
            "loggers": {"fernweave": {"level": level}},
            "root": {"handlers": ["stderr"], "level": "WARNING"},
        }
    )


def shared_folder(spark) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it; one of this machine only where all runs on it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = _local_folder()
    return found.rstrip("/")


@cache
def _local_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="fernweave-")


class EngineError(Exception):
    """Base of all errors that the command line reports by message."""


class FetchError(EngineError):
    def __init__(self, message: str, status: int | None = None, permanent: bool = False) -> None:
        super().__init__(message)
        self.status, self.permanent = status, permanent


class FeedError(EngineError): ...


class SitemapError(EngineError): ...


class TokenizerError(EngineError): ...


class EmbeddingError(EngineError): ...


class SiteError(EngineError): ...


class HistoryLimitError(SiteError): ...


class HistoryUnavailableError(SiteError): ...


class LeaseLostError(EngineError): ...


class AlreadyRunningError(EngineError): ...
