"""Scalar functions on text, dates, hashes and schedules."""

from __future__ import annotations

import hashlib
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

SNIPPET = 500
#: fixed values
RETRY_DELAYS = (300, 1800, 7200, 21600, 86400)
RETRYABLE = (429, 500, 502, 503, 504)
HIGH, MID = 0.65, 0.50
TERM = r"[\p{L}\p{N}]+"
NO_TERM = r"[^\p{L}\p{N}]+"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def snippet(content: Column) -> Column:
    return F.substring(content, 1, SNIPPET)


def is_truncated(content: Column) -> Column:
    return F.length(content) > SNIPPET


def confidence(score: Column) -> Column:
    return F.when(score >= HIGH, "high").when(score >= MID, "mid").otherwise("low")


def parse_date(text: Column) -> Column:
    """Midnight UTC of YYYY-MM-DD, null for anything else."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def parse_range(start: str, end: str) -> tuple[date | None, date | None]:
    """Request parameters: empty is open, only YYYY-MM-DD passes, start must not be after end."""
    found = []
    for text in (start.strip(), end.strip()):
        day = date.fromisoformat(text) if text else None
        if day and day.isoformat() != text:
            raise ValueError(f"not a date of the form YYYY-MM-DD: {text}")
        found.append(day)
    if all(found) and found[0] > found[1]:
        raise ValueError("the range ends before it starts")
    return found[0], found[1]


def is_language_code(text: Column) -> Column:
    return text.rlike("^[a-z]{2}$")


def embedding_text(title: Column, content: Column) -> Column:
    return F.when(title.isNotNull() & (title != ""), F.concat(title, F.lit("\n\n"), content)).otherwise(content)


def query_text(query: str, instruction: str = "") -> str:
    return f"Instruct: {instruction}\nQuery: {query}" if instruction else query


def poll_offset(base_url: Column, interval: int) -> Column:
    """First 8 bytes of SHA-256, big-endian, modulo the interval."""
    head = F.conv(F.substring(F.sha2(base_url, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (head % F.lit(interval)).cast("long")


def poll_offset_of(base_url: str, interval: int) -> int:
    return int.from_bytes(hashlib.sha256(base_url.encode()).digest()[:8], "big") % interval


def fingerprint(body: Column) -> Column:
    return F.sha2(body, 256)


def poll_backoff(failures_before: Column, interval: int) -> Column:
    return F.least(F.lit(interval).cast("long"), (F.lit(300) * F.pow(F.lit(2), F.least(failures_before, F.lit(10)))).cast("long"))


def retry_delay(attempts: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, RETRY_DELAYS)), (F.least(attempts, F.lit(len(RETRY_DELAYS) - 1)) + 1).cast("int"))


def attempt_budget(error_kind: Column) -> Column:
    """content: one attempt; permanent fetch error: three; anything else: ten."""
    return F.when(error_kind == "content", 1).when(error_kind == "permanent", 3).otherwise(10)


def next_state(attempts: Column, error_kind: Column) -> Column:
    return F.when(attempts + 1 >= attempt_budget(error_kind), "failed").otherwise("retrying")


def scatter_offset(interval: int, position: Column, total: Column) -> Column:
    """Whole-number division of longs: the product passes 2**31 at 50,000 positions of half a day."""
    return F.call_function("div", F.lit(interval).cast("long") * position, F.greatest(total, F.lit(1))).cast("long")


def is_retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def retry_wait(attempt: Column) -> Column:
    return F.pow(F.lit(2), attempt).cast("long")


def error_summary(model: Column, inputs: Column, request_id: Column, body: Column) -> Column:
    """Context of a failed request: sorted keys of the body, 500 characters at most."""
    keys = F.concat_ws(",", F.array_sort(F.json_object_keys(body)))
    told = F.concat_ws("; ", F.concat(F.lit("model="), model), F.concat(F.lit("inputs="), inputs.cast("string")), F.concat(F.lit("request="), request_id), F.concat(F.lit("keys="), keys))
    return F.substring(told, 1, 500)


def embeddings_payload(body: Column, count: Column, dim: int) -> Column:
    """Vectors of a {data: [{index, embedding}]} payload in index order, or null if anything is wrong."""
    parsed = F.from_json(body, "struct<data: array<struct<index: string, embedding: array<double>>>>")
    data = F.transform(parsed["data"], lambda d: F.struct(F.when(d["index"].rlike(r"^\d{1,9}$"), d["index"].cast("int")).alias("index"), d["embedding"].alias("embedding")))
    data = F.array_sort(data, lambda a, b: F.coalesce(a["index"] - b["index"], F.lit(0)))
    finite = F.forall(data, lambda d: F.coalesce((F.size(d["embedding"]) == dim) & F.forall(d["embedding"], lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))
    whole = F.transform(data, lambda d: d["index"]) == F.sequence(F.lit(0), F.size(data) - 1)
    good = (F.size(data) == count) & (F.size(data) > 0) & finite & F.coalesce(whole, F.lit(False))
    return F.when(F.coalesce(good, F.lit(False)), F.transform(data, lambda d: d["embedding"]))


@F.pandas_udf(StringType())
def decoded(body: pd.Series) -> pd.Series:
    """UTF-8 with replacement."""
    return body.map(lambda b: bytes(b).decode("utf-8", "replace"), na_action="ignore")


#: fixed values: frequent short words of the languages of the test tables
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "in", "that", "is", "was", "for", "with", "as", "on", "be", "by", "this"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "que", "dans", "est", "pour", "pas", "sur", "qui"),
    "de": ("der", "die", "das", "und", "ist", "nicht", "von", "mit", "ein", "zu", "den", "sich", "auf", "für", "im"),
    "es": ("el", "la", "los", "las", "y", "que", "de", "en", "por", "del", "una", "con", "no", "se", "es"),
}
LANGUAGE_SAMPLE = 1600


def detect_language(text: Column, title: Column) -> Column:
    """Two-letter code by stop words in the title and the first 1600 characters; null if none occurs.

    CJK text is told by its script.
    """
    sample = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit("\n\n"), F.substring(text, 1, LANGUAGE_SAMPLE)))
    words = F.split(sample, r"[^\p{L}]+")
    scores = [F.struct(F.size(F.filter(words, _in(ws))).alias("n"), F.lit(code).alias("code")) for code, ws in STOP_WORDS.items()]
    best = F.greatest(*scores)
    return F.when(sample.rlike(r"\p{IsHan}{2}"), "zh").when(best["n"] > 0, best["code"])


def _in(words: tuple[str, ...]):
    return lambda w: w.isin(*words)


@F.pandas_udf(ArrayType(FloatType()))
def half_precision(vector: pd.Series) -> pd.Series:
    """Values as a 16-bit float holds them."""
    import numpy as np

    return vector.map(lambda v: np.asarray(v, np.float16).astype(np.float32), na_action="ignore")
