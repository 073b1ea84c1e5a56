"""Client of an embedding service: ordered batches, retries, checked vectors.

The service takes {model, input} at /embeddings and answers {data: [{index, embedding}]}.
"""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.request
from collections.abc import Callable

from fernweave.config import EmbeddingError, Settings
from fernweave.functions.text import RETRYABLE, query_text

#: posts a body and gives status, headers and body; OSError if there is no answer
Post = Callable[[str, bytes, dict[str, str], float], tuple[int, dict[str, str], bytes]]
SHOWN = 500


def post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> tuple[int, dict[str, str], bytes]:
    request = urllib.request.Request(url, body, {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as got:
            return got.status, {k.lower(): v for k, v in got.headers.items()}, got.read()
    except urllib.error.HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()


def summary(payload: object) -> str:
    """What an unusable answer looks like: its keys in order and its error, 500 characters at most."""
    if not isinstance(payload, dict):
        return f"a {type(payload).__name__}"
    told = f"keys {', '.join(sorted(map(str, payload)))}"
    return (f"{told}; error {payload['error']}" if "error" in payload else told)[:SHOWN]


def vectors_of(payload: object, count: int, dim: int | None) -> list[list[float]]:
    """The vectors of an answer in order of their indexes, which must be 0 to count - 1; all values finite numbers, dim of them."""
    data = payload.get("data") if isinstance(payload, dict) else None
    if not isinstance(data, list) or len(data) != count:
        raise EmbeddingError(f"{count} vectors were asked for")
    found: dict[int, list[float]] = {}
    for item in data:
        index, vector = (item.get("index"), item.get("embedding")) if isinstance(item, dict) else (None, None)
        if type(index) is not int or index in found or not 0 <= index < count:
            raise EmbeddingError(f"bad index {index!r}")
        if not isinstance(vector, list) or any(type(x) not in (int, float) or not math.isfinite(x) for x in vector):
            raise EmbeddingError(f"vector {index} is no list of finite numbers")
        if dim is not None and len(vector) != dim:
            raise EmbeddingError(f"vector {index} has {len(vector)} values and not {dim}; check the model and embedding_dim")
        found[index] = [float(x) for x in vector]
    return [found[k] for k in range(count)]


class EmbeddingClient:
    """Holds no connection, so it can go to executors; sleep and send are for tests."""

    def __init__(self, settings: Settings, send: Post = post, sleep: Callable[[float], None] = time.sleep) -> None:
        if not settings.embedding_api_base:
            raise EmbeddingError("embedding_api_base is not set")
        self.settings, self.send, self.sleep = settings, send, sleep

    def documents(self, texts: list[str]) -> list[list[float]]:
        size = self.settings.embedding_batch_size
        return [v for at in range(0, len(texts), size) for v in self._batch(texts[at : at + size])]

    def query(self, text: str) -> list[float]:
        return self._batch([query_text(text, self.settings.embedding_query_instruction)])[0]

    def _batch(self, texts: list[str]) -> list[list[float]]:
        s = self.settings
        headers = {"Authorization": f"Bearer {s.embedding_api_key}"} if s.embedding_api_key else {}
        body = json.dumps({"model": s.embedding_model, "input": texts}).encode()
        told = ""
        for attempt in range(s.embedding_attempts):
            if attempt:
                self.sleep(2**attempt)
            try:
                status, got, answer = self.send(s.embedding_api_base.rstrip("/") + "/embeddings", body, headers, s.embedding_timeout_seconds)
            except OSError as e:
                told = f"no answer: {e}"
                continue
            where = f"HTTP {status}, model {s.embedding_model}, {len(texts)} texts" + "".join(f", request {got[k]}" for k in ("x-request-id", "cf-ray") if k in got)[:100]
            if status == 200:
                return self._read(answer, len(texts), where)
            told = f"{where}: {answer[:SHOWN].decode('utf-8', 'replace')}"
            if status not in RETRYABLE:
                raise EmbeddingError(told)
        raise EmbeddingError(f"{s.embedding_attempts} attempts failed, the last one with {told}")

    def _read(self, answer: bytes, count: int, where: str) -> list[list[float]]:
        try:
            payload = json.loads(answer)
        except ValueError as e:
            raise EmbeddingError(f"the answer is no JSON ({where}: {answer[:SHOWN].decode('utf-8', 'replace')})") from e
        try:
            return vectors_of(payload, count, self.settings.embedding_dim)
        except EmbeddingError as e:
            raise EmbeddingError(f"{e} ({where}; {summary(payload)})") from e
