"""Quality classifier by weak labels.

Heuristic labellers each vote good, junk or nothing on a document. Their votes form one of
at most 3^K patterns; the patterns are counted over all documents, and
expectation-maximisation on the counts estimates each labeller's accuracy and the share of
junk without any gold label. The posteriors then are soft labels for a linear scorer over
hashed word shapes, which scores every document, also those on which no labeller votes.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fernweave.llm.common import stored, table, trim

#: documents (in expectation, by hash of the id) that the scorer is fitted on; votes are counted over all
FIT_DOCUMENTS = 20_000
DIMS = 1 << 12
REPEAT = 0  # the feature "same word as before"
ACCEPT = 0.5
FALSE_ALARM = 0.001
CACHE_WORDS = 150_000

_SYMBOLS = b"#$%&*+/<=>@\\^_`{|}~[]"
_ENDS = b".!?"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LETTERS = _UPPER + _UPPER.lower() + bytes(range(128, 256))

#: name, values up to which it votes good, values from which it votes junk, least number of words
LABELLERS = (
    ("repeated", 0.04, 0.10, 4),
    ("symbols", 0.006, 0.025, 20),
    ("lone_marks", 0.02, 0.10, 20),
    ("shouting", 0.15, 0.50, 4),
    ("ends", 0.35, 1.00, 20),
    ("bangs", 0.01, 0.20, 8),
)


def _measures(data: bytes, words: list[bytes]) -> tuple[float, ...]:
    n, size = max(1, len(words)), max(1, len(data))
    letters = len(data) - len(data.translate(None, _LETTERS))
    return (
        sum(map(bytes.__eq__, words[1:], words)) / n,
        (size - len(data.translate(None, _SYMBOLS))) / size if data else 0.0,
        sum(len(w) == 1 and not w.isalnum() for w in words) / n,
        (len(data) - len(data.translate(None, _UPPER))) / max(1, letters),
        (len(data) - len(data.translate(None, _ENDS))) / n,
        data.count(b"!!") / n,
    )


def votes(data: bytes, words: list[bytes]) -> int:
    """The pattern of votes in base 3: 0 none, 1 good, 2 junk."""
    pattern = 0
    for value, (_, good, junk, least) in zip(_measures(data, words), LABELLERS, strict=True):
        vote = 0 if len(words) < least else 1 if value <= good else 2 if value >= junk else 0
        pattern = pattern * 3 + vote
    return pattern


def shape(word: bytes) -> int:
    """Hashed shape: runs of capitals, lower-case letters and digits count as one, marks stay."""
    text = word.decode("utf-8", "replace")
    text = re.sub(r"[^\W\d_]+", lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "T" if m[0][0].isupper() else "a", text)
    text = re.sub(r"(.)\1+", r"\1\1", re.sub(r"\d+", "0", text))
    return 1 + zlib.crc32(text.encode()) % (DIMS - 1)


class Shapes(dict):
    def __missing__(self, word: bytes) -> int:
        made = shape(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = made
        return made


def features(words: list[bytes], shapes: Shapes) -> tuple[np.ndarray, np.ndarray]:
    """Indices and the shares of the document's words that have them."""
    if not words:
        return np.empty(0, np.int64), np.empty(0)
    count = np.bincount(np.fromiter(map(shapes.__getitem__, words), np.int64, len(words)), minlength=DIMS)
    count[REPEAT] = sum(map(bytes.__eq__, words[1:], words))
    at = np.flatnonzero(count)
    return at, count[at] / len(words)


@dataclass(frozen=True)
class Labellers:
    """Shares of the classes (good, then a kind of junk for each labeller), and by labeller and class the odds of its votes.

    Votes are none, good and junk; not to vote tells nothing, its odds are 1 in any class.
    """

    share: np.ndarray
    table: np.ndarray

    def classes(self, patterns: np.ndarray) -> np.ndarray:
        log = np.log(self.share)[:, None] + np.zeros((len(self.share), len(patterns)))
        for k, vote in enumerate(_digits(patterns)):
            log += np.log(self.table[k][:, vote])
        odds = np.exp(log - log.max(0))
        return odds / odds.sum(0)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of junk."""
        return 1 - self.classes(patterns)[0]


def _digits(patterns: np.ndarray) -> list[np.ndarray]:
    return [patterns // 3 ** (len(LABELLERS) - 1 - k) % 3 for k in range(len(LABELLERS))]


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> Labellers:
    """Expectation-maximisation over counted vote patterns; smoothed, so nothing is ever certain.

    Labellers see different kinds of junk, so each starts a class of its own: the documents
    that it calls junk. What none calls junk starts as good. Labellers are specific: that one calls a good
    document junk has a prior rate of FALSE_ALARM, worth half as many votes as there are documents.
    """
    digits = _digits(patterns)
    called = np.array([d == 2 for d in digits], float)
    post = np.vstack([called.sum(0) == 0, called]) * 0.98 + 0.02 / (len(digits) + 1)
    post /= post.sum(0)
    for _ in range(rounds):
        weight = counts * post
        table_ = np.ones((len(digits), len(post), 3))
        for k, vote in enumerate(digits):
            for c in range(len(post)):
                seen = np.bincount(vote, weight[c], 3)[1:] + 0.5
                if c == 0:
                    seen += counts.sum() / 2 * np.array([1 - FALSE_ALARM, FALSE_ALARM])
                table_[k, c, 1:] = seen / seen.sum()
        share = weight.sum(1) + 0.5
        model = Labellers(share / share.sum(), table_)
        new = model.classes(patterns)
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-7:
            break
    return model


def fit_scorer(rows: list[tuple[np.ndarray, np.ndarray]], junk: np.ndarray, rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels; the last weight is the bias. No rows: all zero."""
    weight = np.zeros(DIMS + 1)
    if not rows:
        return weight
    sizes = np.array([len(at) for at, _ in rows])
    at, value = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    row = np.repeat(np.arange(len(rows)), sizes)
    past = np.full(DIMS + 1, 1e-8)
    for _ in range(rounds):
        score = np.bincount(row, value * weight[at], len(rows)) + weight[-1]
        off = 1 / (1 + np.exp(-np.clip(score, -60, 60))) - junk
        grad = np.append(np.bincount(at, value * off[row], DIMS), off.sum()) / len(rows) + decay * np.append(weight[:-1], 0)
        past += grad**2
        weight -= 0.5 * grad / np.sqrt(past)
    return weight


def _look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shapes = Shapes()
    for batch in batches:
        pattern, ats, values = [], [], []
        for chosen, value in zip(batch.column(0), batch.column(1), strict=True):
            data = value.as_py() or b""
            words = data.split()
            pattern.append(votes(data, words))
            at, share = features(words, shapes) if chosen.as_py() else (None, None)
            ats.append(at)
            values.append(share)
        yield pa.RecordBatch.from_arrays([pa.array(pattern, pa.int32()), pa.array(ats, pa.list_(pa.int64())), pa.array(values, pa.list_(pa.float64()))], ["pattern", "at", "share"])


def train(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS) -> tuple[Labellers, np.ndarray]:
    """Vote statistics of all docs (doc_id, text), and the scorer fitted on a bounded sample by hash of the id."""
    part = min(1.0, fit_documents / max(1, docs.count()))
    chosen = F.pmod(F.xxhash64(F.lit("quality"), F.col("doc_id")), F.lit(1_000_000)) < int(part * 1_000_000)
    looked = stored(docs.select(chosen.alias("chosen"), F.col("text").cast("binary").alias("data")).mapInArrow(_look, "pattern int, at array<long>, share array<double>"), "votes")
    # 3^K rows at most
    seen = looked.groupBy("pattern").count().toPandas()
    model = estimate(seen["pattern"].to_numpy(np.int64), seen["count"].to_numpy(float))
    sample = looked.filter("at IS NOT NULL").toArrow()
    rows = [(np.array(a, np.int64), np.array(v, float)) for a, v in zip(sample["at"].to_pylist(), sample["share"].to_pylist(), strict=True)]
    return model, fit_scorer(rows, model.posterior(sample["pattern"].to_numpy().astype(np.int64)))


def score(docs: DataFrame, model: Labellers, weight: np.ndarray) -> DataFrame:
    """row: docs' columns, with posterior (of the labellers) and score (of the scorer), both for good."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            patterns, scores = [], []
            for value in batch.column(1):
                data = value.as_py() or b""
                words = data.split()
                patterns.append(votes(data, words))
                at, share = features(words, shapes)
                scores.append(float(share @ weight[at] + weight[-1]))
            good = 1 - model.posterior(np.array(patterns, np.int64))
            made = 1 / (1 + np.exp(np.clip(np.array(scores, float), -60, 60)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(good), pa.array(made)], ["row", "posterior", "score"])
        shapes.clear()
        trim()

    raw = docs.select(F.struct(*docs.columns).alias("row"), F.col("text").cast("binary").alias("data"))
    schema = StructType([StructField("row", docs.schema), StructField("posterior", DoubleType()), StructField("score", DoubleType())])
    return raw.mapInArrow(run, schema)


def classify(docs: DataFrame, fit_documents: int = FIT_DOCUMENTS, accept: float = ACCEPT) -> DataFrame:
    """row (a struct of docs' columns), posterior, score (both: probability of good) and accepted.

    A null or empty text is scored on no words at all, which the labellers leave alone, and is
    accepted if the corpus is mostly good. Repeated rows and null ids are scored alike, very long texts whole;
    columns other than doc_id and text are passed on as they are, whatever their names. An
    empty table gives no rows.
    """
    model, weight = train(docs, fit_documents)
    return score(docs, model, weight).withColumn("accepted", F.col("score") >= accept)


def accepted(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that classify() accepts."""
    return classify(docs, **settings).filter("accepted").select("row.*")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classify(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "posterior", "score", "accepted")
