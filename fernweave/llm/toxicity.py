"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with the logistic of its words'
weights, the document by a leaky noisy-or of its sentences, and the weights are trained from
document labels alone. The sentences that make a document toxic are then located.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm.common import stored, table

#: labelled documents of each class that the model is fitted on at most
FIT_TOXIC, FIT_CLEAN = 10_000, 30_000
#: word features kept at most, the least toxic documents of one, and its least log-odds
FEATURES, LEAST_DOCUMENTS, LEAST_ODDS = 8192, 3, 1.0
DIMS = 1 << 26
STEMS = (4, 5, 6)
THRESHOLD = 0.3
CACHE_WORDS = 200_000

_SENTENCE = re.compile(r"[^.!?\n]+")
_EDGES = re.compile(r"^\W+|\W+$")


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashes of the bare lower-case word, of stems of a few lengths."""
    bare = _EDGES.sub("", word.decode("utf-8", "replace").lower())
    if not bare:
        return ()
    kinds = [f"w:{bare}"]
    kinds += [f"p:{bare[:n]}" for n in STEMS if len(bare) > n]
    return tuple(zlib.crc32(k.encode()) % DIMS for k in kinds)


class Found(dict):
    """Bounded memo from a word to its places among the chosen features."""

    def __init__(self, places: dict[int, int]) -> None:
        super().__init__()
        self.places = places

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        made = tuple(sorted({self.places[f] for f in word_features(word) if f in self.places}))
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = made
        return made


def bag(text: bytes, found: Found) -> list[tuple[int, int, tuple[int, ...]]]:
    """Sentences with features: start and end (code points) and their distinct features."""
    if not any(map(found.__getitem__, set(text.split()))):
        return []
    sentences = []
    for match in _SENTENCE.finditer(text.decode("utf-8", "replace")):
        here = {f for w in match[0].encode().split() for f in found[w]}
        if here:
            sentences.append((match.start(), match.end(), tuple(sorted(here))))
    return sentences


@dataclass(frozen=True)
class Model:
    places: dict[int, int]
    weight: np.ndarray
    bias: float
    leak: float

    def sentence(self, features: tuple[int, ...]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weight[list(features)].sum() + self.bias, -60, 60))))

    def document(self, sentences: list[float]) -> float:
        return 1 - (1 - self.leak) * float(np.prod([1 - s for s in sentences]))


def fit(bags: list[list[tuple[int, ...]]], toxic: np.ndarray, start: np.ndarray, rounds: int = 400, decay: float = 1e-3) -> tuple[np.ndarray, float, float]:
    """Gradient ascent on the likelihood of document labels under the leaky noisy-or."""
    weight, bias, n = start.copy(), -3.0, len(bags)
    empty = np.array([not b for b in bags], bool)
    leak = (float(toxic[empty].sum()) + 0.1) / (float(empty.sum()) + 20.0)
    flat = [s for b in bags for s in b]
    if not flat:
        return weight, bias, leak
    owner = np.repeat(np.arange(n), [len(b) for b in bags])
    at = np.concatenate([np.array(s, np.int64) for s in flat])
    row = np.repeat(np.arange(len(flat)), [len(s) for s in flat])
    past, past_bias = np.full(len(weight), 1e-6), 1e-6
    for _ in range(rounds):
        score = np.clip(np.bincount(row, weight[at], len(flat)) + bias, -30, 30)
        p = 1 / (1 + np.exp(-score))
        clean = (1 - leak) * np.exp(np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-12)), n))
        pull = np.where(toxic == 1, clean / np.maximum(1 - clean, 1e-9), -1.0)[owner] * p
        grad = np.bincount(at, pull[row], len(weight)) / n - decay * weight / 10
        grad_bias = pull.sum() / n - decay * (bias + 3) / 10
        past += grad**2
        past_bias += grad_bias**2
        weight += 0.3 * grad / np.sqrt(past)
        bias += 0.3 * grad_bias / np.sqrt(past_bias)
    return weight, float(bias), leak


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _documents_with(batches: Iterator[pa.RecordBatch], chosen: frozenset[int] | None) -> Iterator[pa.RecordBatch]:
    """For each feature (of chosen), the number of documents of each class that hold it."""
    seen = (Counter(), Counter())
    for batch in batches:
        for toxic, value in zip(batch.column(0), batch.column(1), strict=True):
            held = {f for w in set((value.as_py() or b"").split()) for f in word_features(w)}
            seen[toxic.as_py()].update(held if chosen is None else held & chosen)
        for label in (0, 1):
            if len(seen[label]) > 1 << 18:
                yield _counted(seen[label], label)
                seen[label].clear()
    for label in (0, 1):
        yield _counted(seen[label], label)


def _counted(seen: Counter, label: int) -> pa.RecordBatch:
    count = pa.array(list(seen.values()), pa.int64())
    none = pa.array([0] * len(seen), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), *((none, count) if label else (count, none))], ["feature", "clean", "toxic"])


def train(docs: DataFrame, labels: DataFrame, fit_toxic: int = FIT_TOXIC, fit_clean: int = FIT_CLEAN) -> Model:
    """Fit on a bounded sample (by hash of the id) of labelled rows that are not held out.

    Of labels that disagree on an id the toxic one counts. The model has FEATURES word features at most, each from LEAST_DOCUMENTS
    toxic documents of the sample or more; no other row or text is left out. Without labels it has no feature.
    """
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.filter(~held_out(F.col("__id"))).withColumn("o", F.xxhash64(F.lit("toxicity"), "__id"))
    chosen = [known.filter(F.col("toxic") == c).orderBy("o", "__id").limit(n).drop("o") for c, n in ((1, fit_toxic), (0, fit_clean))]
    # fit_toxic + fit_clean rows at most
    sample = F.broadcast(stored(chosen[0].unionByName(chosen[1]), "labelled"))
    texts = docs.select(F.col("doc_id").alias("__id"), F.col("text").cast("binary").alias("data"))
    # of rows that share an id, one text
    texts = texts.join(sample, "__id").groupBy("__id", "toxic").agg(F.min_by("data", F.struct(F.xxhash64("data"), "data")).alias("data"))
    texts = stored(texts.select("toxic", "data"), "labelled-texts")
    totals = dict(texts.groupBy("toxic").count().collect())
    n_toxic, n_clean = totals.get(1, 0), totals.get(0, 0)
    schema = "feature long, clean long, toxic long"

    def counted(rows: DataFrame, only: frozenset[int] | None) -> DataFrame:
        made = rows.mapInArrow(lambda it: _documents_with(it, only), schema)
        return made.groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))

    # the features of most toxic documents, a bounded number, then how many clean ones have them
    often = counted(texts.filter("toxic = 1"), None).filter(F.col("toxic") >= LEAST_DOCUMENTS).orderBy(F.desc("toxic"), "feature").limit(8 * FEATURES)
    pos = {r["feature"]: r["toxic"] for r in often.select("feature", "toxic").collect()}
    neg = {r["feature"]: r["clean"] for r in counted(texts.filter("toxic = 0"), frozenset(pos)).collect()} if pos else {}
    odds = {f: float(np.log((p + 0.5) / (n_toxic + 1)) - np.log((neg.get(f, 0) + 0.5) / (n_clean + 1))) for f, p in pos.items()}
    best = sorted((f for f in pos if odds[f] >= LEAST_ODDS), key=lambda f: (-pos[f] * odds[f], f))[:FEATURES]
    places = {f: k for k, f in enumerate(best)}

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(places)
        for batch in batches:
            made = [[list(s[2]) for s in bag(v.as_py() or b"", found)] for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.list_(pa.int32())))], ["toxic", "bag"])

    rows = texts.mapInArrow(bags, "toxic int, bag array<array<int>>").toArrow()
    start = np.array([min(odds[f], 4.0) / 2 for f in best])
    weight, bias, leak = fit([[tuple(s) for s in b] for b in rows["bag"].to_pylist()], rows["toxic"].to_numpy().astype(int), start)
    return Model(places, weight, bias, leak)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, and offending: (start, end, score) of sentences at or over threshold.

    Positions are code points, end exclusive. A null or empty text has no sentence and gets the
    leak, the score of a document without any known word. Rows are scored one by one,
    whatever their ids, and very long texts whole; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Found(model.places)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            scores, offending = [], []
            for value in batch.column(1):
                sentences = [(a, b, model.sentence(f)) for a, b, f in bag(value.as_py() or b"", found)]
                scores.append(model.document([s for _, _, s in sentences]))
                offending.append([{"start": a, "end": b, "score": s} for a, b, s in sentences if s >= threshold])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(offending, kind)], ["doc_id", "score", "offending"])

    raw = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("data"))
    return raw.mapInArrow(run, "doc_id long, score double, offending array<struct<start:long,end:long,score:double>>")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("offending").alias("n_offending"))
