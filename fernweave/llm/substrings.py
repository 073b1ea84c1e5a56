"""Suffix-array dedup: bytes of LENGTH-byte strings that also start in a document of smaller id.

Documents are packed (a few MB each). Every pack sends the anchors of its windows; those that occur in more than
one document come back, and the pack sends the fragments around them, each distinct content once with the least
id that has it. Fragments meet in buckets by anchor. There equal contents of different packs are one string; strings that share
an anchor with other strings form shards, whose Burrows-Wheeler transforms are merged by interleave refinement (bwt.py).
The blocks of suffixes that share LENGTH bytes are the repeated intervals; each has a least id. A pack gets the least id of each
window of its fragments, and cuts.

No bucket or pack holds all of a hot passage: a pack sends it once, however many of its documents hold it.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm import bwt
from fernweave.llm.anchors import LENGTH, Fragments, fragments
from fernweave.llm.common import batches_of, release, stored, table

#: bytes of text in a pack, and of text for each bucket
PACK_BYTES, BUCKET_BYTES = 6 << 20, 4 << 20
#: bytes of a shard, and of shards that are merged at once (whole anchor groups; a larger group is merged alone)
SHARD_BYTES, MERGE_BYTES = 1 << 13, 1 << 16
LEVEL = 5
#: stands for a null id, which is larger than any other
NO_ID = 2**63 - 1

assert LENGTH % bwt.WORD == 0
_ROUNDS = LENGTH // bwt.WORD


def _squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays with their types, compressed."""
    parts = []
    for a in arrays:
        raw = np.ascontiguousarray(a)
        parts.append(struct.pack("<2sQ", raw.dtype.str[1:].encode(), raw.nbytes) + raw.tobytes())
    return zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(parts))


def _arrays(blob: bytes) -> list[np.ndarray]:
    raw, at, found = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        kind, size = struct.unpack_from("<2sQ", raw, at)
        at += 10
        found.append(np.frombuffer(raw, "<" + kind.decode() if kind != b"u1" else np.uint8, count=size // int(chr(kind[1])), offset=at))
        at += size
    return found


def _texts(blob: bytes, sizes: np.ndarray) -> list[bytes]:
    raw, ends = zstandard.ZstdDecompressor().decompress(blob), np.cumsum(sizes)
    return [raw[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _batch(names: list[str], kinds: list[pa.DataType], columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


# --- packs --------------------------------------------------------------------------------------


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids: list[int | None] = []
    texts: list[bytes] = []
    size = number = part = 0

    def pack() -> pa.RecordBatch:
        blob = zstandard.ZstdCompressor(level=LEVEL).compress(b"".join(texts))
        names, kinds = ["part", "number", "ids", "sizes", "blob"], [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return _batch(names, kinds, [[part], [number], [ids], [[len(t) for t in texts]], [blob]])

    for batch in batches:
        part = batch.column(0)[0].as_py() if batch.num_rows else part
        for doc_id, value in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
            data = value.as_py() or b""
            ids.append(doc_id)
            texts.append(data)
            size += len(data)
            if size >= PACK_BYTES:
                yield pack()
                ids, texts, size, number = [], [], 0, number + 1
    if ids:
        yield pack()


PACK = "part int, number int, ids array<long>, sizes array<long>, blob binary"


def _pack_ids(ids: pa.Scalar) -> np.ndarray:
    return np.array([NO_ID if i is None else i for i in ids.as_py()], np.int64)


# --- anchors ------------------------------------------------------------------------------------


def _anchors(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """For each bucket, the pack's distinct anchors; the lowest bit tells that several documents of the pack have it."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, sizes = _pack_ids(batch.column(2)[k]), np.array(batch.column(3)[k].as_py(), np.int64)
            found = fragments(_texts(batch.column(4)[k].as_py(), sizes))
            order = np.lexsort((ids[found.owner], found.anchor))
            anchor, owner = found.anchor[order], ids[found.owner[order]]
            new = np.ones(len(anchor), bool)
            new[1:] = anchor[1:] != anchor[:-1]
            begin = np.flatnonzero(new)
            last = np.concatenate([begin[1:], [len(anchor)]]) - 1 if len(begin) else begin
            marked = anchor[begin] << np.uint64(1) | (owner[begin] != owner[last])
            yield from _by_bucket(batch, k, anchor[begin], buckets, lambda at, m=marked: m[at].tobytes())


def _by_bucket(batch: pa.RecordBatch, k: int, anchor: np.ndarray, buckets: int, payload) -> Iterator[pa.RecordBatch]:
    bucket = (anchor.astype(np.uint32).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    begin = np.searchsorted(bucket[order], np.arange(buckets + 1))
    rows = [(b, payload(order[begin[b] : begin[b + 1]])) for b in range(buckets) if begin[b] < begin[b + 1]]
    if rows:
        part, number = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
        names, kinds = ["bucket", "part", "number", "payload"], [pa.int32(), pa.int32(), pa.int32(), pa.binary()]
        yield _batch(names, kinds, [[b for b, _ in rows], [part] * len(rows), [number] * len(rows), [p for _, p in rows]])


BUCKETED = "bucket int, part int, number int, payload binary"
RETURNED = "part int, number int, payload binary"


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, int, bytes]]]:
    """Rows sorted by bucket to the packs' payloads of one bucket at a time."""
    now, held = None, []
    for batch in batches:
        for b, part, number, payload in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            if b != now and held:
                yield held
                held = []
            now = b
            held.append((part, number, payload))
    if held:
        yield held


def _returned(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return _batch(["part", "number", "payload"], [pa.int32(), pa.int32(), pa.binary()], [list(c) for c in zip(*rows, strict=True)] if rows else [[], [], []])


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each pack, its anchors that are in several documents."""
    for rows in _buckets(batches):
        sent = [np.frombuffer(p, np.uint64) for _, _, p in rows]
        marked = np.concatenate(sent)
        anchor = marked >> np.uint64(1)
        order = np.argsort(anchor, kind="stable")
        sorted_ = anchor[order]
        begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
        size = np.diff(np.concatenate([begin, [len(sorted_)]]))
        several = np.maximum.reduceat((marked[order] & np.uint64(1)).astype(np.int8), begin) > 0
        wanted = np.empty(len(anchor), bool)
        wanted[order] = np.repeat((size > 1) | several, size)
        cuts = np.cumsum([len(x) for x in sent])[:-1]
        parts = zip(rows, np.split(anchor.astype(np.uint32), cuts), np.split(wanted, cuts), strict=True)
        yield _returned([(part, number, own[good].tobytes()) for (part, number, _), own, good in parts if good.any()])


# --- fragments ----------------------------------------------------------------------------------


def _chosen(texts: list[bytes], wanted: np.ndarray) -> tuple[Fragments, np.ndarray]:
    """Fragments whose anchor is wanted (by its low 32 bits), and the number of each one's distinct content."""
    found = fragments(texts)
    found = found._replace(anchor=found.anchor.astype(np.uint32))
    keep = np.flatnonzero(np.isin(found.anchor, wanted))
    found = Fragments(*(c[keep] for c in found))
    # equal bytes have one number, in order of their first place
    parts = [texts[o][a : a + n + LENGTH - 1] for o, a, n in zip(found.owner.tolist(), found.first.tolist(), found.count.tolist(), strict=True)]
    numbers = dict(zip(dict.fromkeys(parts), range(len(parts))))
    distinct = np.fromiter(map(numbers.__getitem__, parts), np.int64, len(keep))
    return found, distinct


def _fragments(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct fragments of the wanted anchors: number within the pack, anchor, windows, least id, bytes."""
    for batch in batches:
        for k in range(batch.num_rows):
            ids, sizes = _pack_ids(batch.column(2)[k]), np.array(batch.column(3)[k].as_py(), np.int64)
            texts = _texts(batch.column(4)[k].as_py(), sizes)
            wanted = np.frombuffer(b"".join(batch.column(5)[k].as_py()), np.uint32)
            found, distinct = _chosen(texts, wanted)
            if not len(distinct):
                continue
            order = np.lexsort((ids[found.owner], distinct))
            rep = order[np.flatnonzero(np.concatenate([[True], distinct[order][1:] != distinct[order][:-1]]))]

            def payload(at: np.ndarray, rep=rep, found=found, ids=ids, texts=texts) -> bytes:
                r = rep[at]
                data = b"".join(texts[o][a : a + n + LENGTH - 1] for o, a, n in zip(found.owner[r].tolist(), found.first[r].tolist(), found.count[r].tolist(), strict=True))
                return _squeezed(at.astype(np.uint32), found.anchor[r], found.count[r].astype(np.uint8), ids[found.owner[r]], np.frombuffer(data, np.uint8))

            yield from _by_bucket(batch, k, found.anchor[rep], buckets, payload)


def _least_ids(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, anchor: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For each byte place of distinct strings, sorted by anchor, the least id of all that have the LENGTH bytes from there."""
    made = np.repeat(least, sizes)
    group = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    many = np.diff(np.concatenate([group, [len(anchor)]])) > 1
    part: list[np.ndarray] = []
    size = 0
    ends = np.concatenate([group[1:], [len(anchor)]])
    todo = list(zip(group[many].tolist(), ends[many].tolist(), strict=True))
    for n, (a, b) in enumerate(todo):
        part.append(np.arange(a, b))
        size += int(sizes[a:b].sum())
        if size >= MERGE_BYTES or n == len(todo) - 1:
            _merge(data, starts, sizes, np.concatenate(part), least, made)
            part, size = [], 0
    return made


def _merge(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, chosen: np.ndarray, least: np.ndarray, made: np.ndarray) -> None:
    own = np.concatenate([data[a : a + n] for a, n in zip(starts[chosen].tolist(), sizes[chosen].tolist(), strict=True)])
    length = sizes[chosen]
    begin = np.concatenate([[0], np.cumsum(length)[:-1]])
    ranks = bwt.words(own, begin, length)
    cut = np.searchsorted(np.cumsum(length), np.arange(SHARD_BYTES, int(length.sum()), SHARD_BYTES))
    shards = [bwt.shard(ranks, begin[c], length[c]) for c in np.split(np.arange(len(chosen)), np.unique(cut)) if len(c)]
    place, block = bwt.merged_blocks(shards, _ROUNDS)
    # string ends stand in block 0; other suffixes count if LENGTH bytes are left
    owner = np.repeat(np.arange(len(chosen)), length)
    good = block > 0
    place, block = place[good], block[good]
    whole = begin[owner[place]] + length[owner[place]] - place >= LENGTH
    place, block = place[whole], block[whole]
    first = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
    best = np.minimum.reduceat(least[chosen[owner[place]]], first)
    value = np.repeat(best, np.diff(np.concatenate([first, [len(block)]])))
    made[starts[chosen[owner[place]]] + place - begin[owner[place]]] = value


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """To each pack, the least id of each window of its fragments."""
    for rows in _buckets(batches):
        sent = [_arrays(p) for _, _, p in rows]
        anchor, count, ids = (np.concatenate([s[k] for s in sent]) for k in (1, 2, 3))
        data = np.concatenate([s[4] for s in sent])
        sizes = count.astype(np.int64) + LENGTH - 1
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        raw = data.tobytes()
        parts = [raw[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        numbers = dict(zip(dict.fromkeys(parts), range(len(parts))))
        string = np.fromiter(map(numbers.__getitem__, parts), np.int64, len(parts))
        del numbers, parts
        order = np.lexsort((ids, string, anchor))
        new = np.ones(len(order), bool)
        new[1:] = string[order][1:] != string[order][:-1]
        string[order] = np.cumsum(new) - 1
        rep = order[new]  # the least id of each distinct string
        length = sizes[rep]
        own = np.concatenate([data[a : a + n] for a, n in zip(starts[rep].tolist(), length.tolist(), strict=True)])
        begin = np.concatenate([[0], np.cumsum(length)[:-1]])
        made = _least_ids(own, begin, length, anchor[rep], ids[rep])
        at, back = 0, []
        for (part, number, _), s in zip(rows, sent, strict=True):
            here = string[at : at + len(s[0])]
            windows = s[2].astype(np.int64)
            first = np.cumsum(windows) - windows
            values = made[np.repeat(begin[here] - first, windows) + np.arange(int(windows.sum()))]
            # fragments with one id for all windows go without their number
            even = np.minimum.reduceat(values, first) == np.maximum.reduceat(values, first)
            back.append((part, number, _squeezed(s[0], s[1], np.where(even, 1, s[2]).astype(np.uint8), values[np.repeat(~even, windows) | np.isin(np.arange(len(values)), first)])))
            at += len(s[0])
        yield _returned(back)


# --- cutting ------------------------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch], with_text: bool) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    for batch in batches:
        for k in range(batch.num_rows):
            raw_ids, ids = batch.column(2)[k].as_py(), _pack_ids(batch.column(2)[k])
            sizes = np.array(batch.column(3)[k].as_py(), np.int64)
            texts = _texts(batch.column(4)[k].as_py(), sizes)
            spans: dict[int, tuple[np.ndarray, np.ndarray]] = {}
            sent = [_arrays(p) for p in batch.column(5)[k].as_py() or []]
            if sent:
                spans = _spans(texts, ids, sent)
            columns: list[list] = [[] for _ in names]
            for d, text in enumerate(texts):
                begin, end = spans.get(d, (np.empty(0, np.int64),) * 2)
                kept = text
                if len(begin):
                    gaps = zip([0, *end.tolist()], [*begin.tolist(), len(text)], strict=True)
                    kept = b"".join(text[a:b] for a, b in gaps)
                row = (raw_ids[d], len(text), len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), kept if with_text else None)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            yield _batch(names, kinds, columns)


def _spans(texts: list[bytes], ids: np.ndarray, sent: list[list[np.ndarray]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Removed spans of each document: begins and ends."""
    number, anchor, count, values = (np.concatenate([s[k] for s in sent]) for k in range(4))
    found, distinct = _chosen(texts, anchor)
    place = np.full(int(distinct.max()) + 1, -1, np.int64)
    windows = count.astype(np.int64)
    place[number] = np.cumsum(windows) - windows
    many = np.zeros(len(place), bool)
    many[number] = windows > 1
    n = found.count
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    gone = values[np.repeat(place[distinct], n) + inner * np.repeat(many[distinct], n)] < np.repeat(ids[found.owner], n)
    owner, at = np.repeat(found.owner, n)[gone], (np.repeat(found.first, n) + inner)[gone]
    if not len(owner):
        return {}
    # windows come in order of document and place; spans that touch are one
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (at[1:] > at[:-1] + LENGTH)
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(owner)]]) - 1
    begin, end, whose = at[first], at[last] + LENGTH, owner[first]
    cuts = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]]))
    stops = np.concatenate([cuts[1:], [len(whose)]])
    return {int(whose[a]): (begin[a:b], end[a:b]) for a, b in zip(cuts, stops, strict=True)}


def _joined(packs: DataFrame, back: DataFrame) -> DataFrame:
    """Packs with the list of what came back to each; one entry for a bucket at most."""
    lists = back.groupBy("part", "number").agg(F.collect_list("payload").alias("back"))
    return packs.join(lists, ["part", "number"], "left").select("part", "number", "ids", "sizes", "blob", F.coalesce("back", F.array().cast("array<binary>")).alias("back"))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of each row of docs (doc_id, text; others are ignored).

    A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id, judged on
    the input; kept holds the rest where with_text is set. A null text counts as empty; a null doc_id as larger
    than any other; rows with equal ids don't take from each other. An empty table gives no rows.
    """
    spark = docs.sparkSession
    raw = docs.select(F.spark_partition_id().alias("part"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("data"))
    with batches_of(spark, 200):
        packs = stored(raw.mapInArrow(_packed, PACK), "packs")
    size = packs.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, n: a + n))).first()[0] or 0
    buckets = min(1 << 16, max(1, -(-size // BUCKET_BYTES)))
    with batches_of(spark, 1):
        sent = packs.mapInArrow(partial(_anchors, buckets=buckets), BUCKETED)
        wanted = stored(sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_repeated, RETURNED), "anchors")
        del sent
        release(spark)
        pieces = _joined(packs, wanted).mapInArrow(partial(_fragments, buckets=buckets), BUCKETED)
        least = stored(pieces.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(_compared, RETURNED), "windows")
        del pieces
        release(spark)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return _joined(packs, least).mapInArrow(partial(_cut, with_text=with_text), schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")
