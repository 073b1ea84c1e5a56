"""Token counts by the whole-token shortcut.

The tokenizer of word_bpe_49k.json never lets a token cross pre-tokens. The vocabulary strings that end
a word are proved offline: each is encoded alone, once, and those that come back as exactly
their own id are the proven set. A pre-token in it counts one without any merging; only other
pre-tokens go through the library's merges.

A text is cut at ASCII white space, which is white space to the tokenizer and composes with no mark; so the pieces
are independent. A piece is cut into pre-tokens here if all its characters are ones whose normal form, case and class are plain.
Pieces with other characters, or with the start of a special token, go to the library whole.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm.common import table

TOKENIZER = "word_bpe_49k.json"
TOKEN_LIMIT = 2048
#: pieces that each half of a worker's memo holds unless told otherwise, and the length of the longest of them in bytes
CACHE_PIECES, CACHE_LENGTH = 120_000, 32
#: fixed values: a space becomes this character in byte-level vocabularies, and words end so
WORD_END = "</w>"

# letters below U+0250 are in normal form C; U+0130 has a two-character lower case, and digits that are not 0-9 are left out
_PLAIN_ASCII = bytes([9, 10, 11, 12, 13, *range(32, 127)])
_ODD = re.compile(r"[^\t-\r -~¡-¬®-±´-¸º»¿-įı-ɏ]")
_PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_alphabet() -> dict[str, int]:
    """Character to byte of the byte-level alphabet: printable bytes stand for themselves, the others follow U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@cache
def load(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def proven(path: str) -> dict[str, int]:
    """Vocabulary strings that, encoded alone, are exactly one token: text to id."""
    tokenizer, alphabet, known = load(path), byte_alphabet(), {}
    for token, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if token.endswith(WORD_END) and all(c in alphabet for c in token[: -len(WORD_END)]):
            try:
                text = bytes(alphabet[c] for c in token[: -len(WORD_END)]).decode()
            except UnicodeDecodeError:
                continue
            if text:
                known[text] = number
    texts = list(known)
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    return {t: known[t] for t, e in zip(texts, found, strict=True) if e.ids == [known[t]]}


def is_plain(data: bytes) -> bool:
    """Whether lower-casing and pre-tokens are the same here as in the library."""
    if b"<|" in data:
        return False
    if data.isascii():
        return not data.translate(None, _PLAIN_ASCII)
    return not _ODD.search(data.decode("utf-8", "replace"))


class Pieces(dict):
    """Bounded memo from a piece of text to its token ids as little-endian unsigned 32-bit integers.

    Pre-tokens that are proven whole tokens need no merging, only others go through the library's merges; a word is
    remembered without the marks around it too. The memo lives as long as the Python worker; when it holds limit entries, it
    becomes the older half, whose entries come back when they are asked for.
    """

    def __init__(self, path: str, limit: int = CACHE_PIECES) -> None:
        super().__init__()
        self.limit = limit
        self.tokenizer = load(path)
        self.merges = self.tokenizer.model.tokenize
        self.shown = {b: c for c, b in byte_alphabet().items()}
        self.known = {text: _packed([number]) for text, number in proven(path).items()}
        self.older: dict[bytes, bytes] = {}

    def __missing__(self, piece: bytes) -> bytes:
        made = self.older.get(piece)
        if made is None:
            made = self._cut(piece)
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[piece] = made
        return made

    def _cut(self, piece: bytes) -> bytes:
        if piece.isalpha():
            return self._pretoken(piece.decode().lower())
        if is_plain(piece):
            parts = _PRETOKEN.findall(piece.decode().lower())
            return self._pretoken(parts[0]) if len(parts) == 1 else b"".join([self[part.encode()] for part in parts])
        return _packed(self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids)

    def _pretoken(self, part: str) -> bytes:
        made = self.known.get(part)
        if made is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.shown)
            made = _packed([t.id for t in self.merges(shown)])
        return made

    def ids(self, data: bytes) -> bytes:
        """The ids of a text."""
        # of other texts special tokens go by case, and capitals may compose otherwise
        return b"".join(map(self.__getitem__, (data.lower() if is_plain(data) else data).split()))


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@cache
def pieces(path: str, limit: int = CACHE_PIECES) -> Pieces:
    return Pieces(path, limit)


def count_tokens(docs: DataFrame, path: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row of docs (doc_id, text).

    Counts are those of the library without added special tokens; special strings in
    a text count as their one token. A null or empty text has 0 bytes and tokens.
    Other columns are ignored, repeated rows and null ids are counted like any other,
    very long texts whole, and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = pieces(path)
        for batch in batches:
            size, count = [], []
            for value in batch.column(1):
                data = value.as_py() or b""
                size.append(len(data))
                count.append(len(memo.ids(data)) // 4)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(size, pa.int64()), pa.array(count, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    raw = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("data"))
    counted = raw.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary_path(TOKENIZER))
