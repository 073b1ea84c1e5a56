"""Overlapping token windows with exact character offsets."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fernweave.config import TokenizerError
from fernweave.sources.batches import gathered, rows_of

_WORD = re.compile(r"\S+", re.ASCII)
WINDOWS = "page_id long, chunk_no int, start_offset int, content_length int, content string"


def _windows(pages: DataFrame, offsets: Callable[[], Callable[[str], list[tuple[int, int]]]], size: int, overlap: int) -> DataFrame:
    """page_id, chunk_no, start_offset, content_length, content: one linear pass over each text, within its row. offsets is called in the worker."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = offsets()
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        schema = pa.schema(list(zip(["page_id", "chunk_no", "start_offset", "content_length", "content"], kinds, strict=True)))
        texts = ((page_id, content) for page_id, content in rows_of(batches) if content)
        yield from gathered(((page_id, n, a, b - a, content[a:b]) for page_id, content in texts for n, (a, b) in enumerate(spans_of(cut(content), size, overlap))), schema)

    return pages.select(F.col("page_id").cast("long"), "content").mapInArrow(run, WINDOWS)


def word_windows(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """Windows of white-space-separated words of pages(page_id, content)."""
    return _windows(pages, lambda: lambda text: [m.span() for m in _WORD.finditer(text)], size, overlap)


def spans_of(offsets: list[tuple[int, int]], size: int, overlap: int) -> list[tuple[int, int]]:
    """Character spans of windows over token offsets."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than the window")
    found, first = [], 0
    while offsets:
        last = min(first + size, len(offsets))
        found.append((offsets[first][0], offsets[last - 1][1]))
        if last == len(offsets):
            break
        first += size - overlap
    return found


def token_windows(pages: DataFrame, tokenizer_path: str, size: int = 384, overlap: int = 32) -> DataFrame:
    """As word_windows, over the tokens of a tokenizer file; blank content has no window."""

    def load() -> Callable[[str], list[tuple[int, int]]]:
        from tokenizers import Tokenizer

        try:
            tokenizer = Tokenizer.from_file(tokenizer_path)
        except Exception as e:
            raise TokenizerError(f"no tokenizer at {tokenizer_path}: {e}") from e
        return lambda text: tokenizer.encode(text, add_special_tokens=False).offsets if text.strip() else []

    return _windows(pages, load, size, overlap)


def chunk_text(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """Chunks store no text; it is cut from the page's content."""
    joined = chunks.join(pages.select("page_id", F.col("content").alias("page_content")), "page_id")
    return joined.withColumn("content", F.expr("substring(page_content, start_offset + 1, content_length)")).drop("page_content")
