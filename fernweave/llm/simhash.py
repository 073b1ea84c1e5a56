"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint is cut into segments of 23 bits, the last one padded with zeros. The perfect
Golay code [23, 12, 7] has one codeword within distance 3 of any segment; the keys of a
segment are the 12-bit indices of all codewords within distance 4 (1 or 6 of them). Two segments
that differ in 2 bits or fewer have a common key: the segment between them has a codeword within 3.

Of three segments with 4 differing bits in all, the two best have 2 or fewer between
them. So fingerprints that link share, for some pair of segments, a key of each; rows
(pair of keys, fingerprint) are grouped by the pair and verified bit by bit. Nothing is
lost and nothing is approximate.

A group emits a spanning forest of its links, not all its pairs. A group of very many
fingerprints is dealt to tiles of two chunks each, so every pair still meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, partial
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernweave.llm.common import LOWER, UPPER, fresh, lookup, release, stored, table, text_key, trim
from fernweave.llm.components import components

SEED = 42
SEGMENT = 23
#: fixed value: the generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
GENERATOR = 0b110001110101
#: groups up to this size are compared pair by pair, larger ones by breadth-first search
SMALL_GROUP = 8
#: a group estimated to exceed CHUNK * 2 fingerprints (and a share of all) is cut into chunks
CHUNK, SAMPLE, HOT_SHARE = 1024, 16, 500
#: key rows compared at a time
COMPARE_ROWS = 1 << 17

#: near copies: bits of word fingerprints, differing bits at most
WIDE_BITS, WIDE_LIMIT = 92, 16
#: shingles of texts that a task remembers
MEMO_SHINGLES = 1 << 21
#: buckets that a text's shingles are counted in, up to 255 each
BUCKETS = 128
#: keys and shingles that tell a text's weight, and shingles that come last in prefixes: those of so many texts of a sample, so many at most
COMMON, MOST_COMMON = 3, 1 << 17

_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


# --- fingerprints -----------------------------------------------------------------------------


def shingle_hashes(data: bytes, width: int) -> np.ndarray:
    """XXH64 of the text's shingles, repeats included; A-Z are lower-cased."""
    words = data.translate(_FOLD).split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(width))))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(words) - width + 1)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_signed(majority(shingle_hashes(v.as_py() or b"", width))) for v in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("data")).mapInArrow(run, "doc_id long, fp long")


# --- Golay keys -------------------------------------------------------------------------------


@cache
def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of m * x^11, error patterns up to weight 3 and those of weight 4, by syndrome."""
    remainder = np.zeros(4096, np.uint32)
    for m in range(4096):
        left = m << 11
        for bit in range(22, 10, -1):
            if left >> bit & 1:
                left ^= GENERATOR << (bit - 11)
        remainder[m] = left
    near, far, used = np.zeros(2048, np.uint32), np.zeros((2048, 5), np.uint32), np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(SEGMENT), weight):
            error = sum(1 << b for b in bits)
            syndrome = (error & 0x7FF) ^ int(remainder[error >> 11])
            if weight < 4:
                near[syndrome] = error
            else:
                far[syndrome, used[syndrome]] = error
                used[syndrome] += 1
    return remainder, near, far


def segment_keys(segment: np.ndarray) -> np.ndarray:
    """For 23-bit segments, indices of all codewords within distance 4: one row of 6 each, -1 where fewer."""
    remainder, near, far = _golay()
    segment = segment.astype(np.uint32)
    syndrome = (segment & 0x7FF) ^ remainder[segment >> 11]
    keys = np.full((len(segment), 6), -1, np.int64)
    keys[:, 0] = (segment ^ near[syndrome]) >> 11
    errors = far[syndrome]
    keys[:, 1:] = np.where(errors > 0, ((segment[:, None] ^ errors) >> 11).astype(np.int64), -1)
    return keys


def segments(lo: np.ndarray, hi: np.ndarray, bits: int) -> list[np.ndarray]:
    """Cut bits (lo has the first 64) into segments of 23."""
    whole = []
    for at in range(0, bits, SEGMENT):
        part = lo >> np.uint64(at) if at < 64 else hi >> np.uint64(at - 64)
        if at < 64 < at + SEGMENT and bits > 64:
            part = part | (hi << np.uint64(64 - at))
        whole.append(part & np.uint64((1 << min(SEGMENT, bits - at)) - 1))
    return whole


def _pair_keys(lo: np.ndarray, hi: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each pair of segments, its keys and the position of the point that has each."""
    keys = [segment_keys(s) for s in segments(lo.view(np.uint64), hi.view(np.uint64), bits)]
    for number, (x, y) in enumerate(combinations(range(len(keys)), 2)):
        both = (keys[x][:, :, None] << 12 | keys[y][:, None, :]).reshape(len(lo), 36)
        good = ((keys[x] >= 0)[:, :, None] & (keys[y] >= 0)[:, None, :]).reshape(len(lo), 36)
        row, slot = np.nonzero(good)
        yield both[row, slot] | number << 24, row


def _keyed(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            vid, lo, hi = (part.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            for key, row in _pair_keys(lo, hi, bits):
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c[row]) for c in (vid, lo, hi))], ["key", "vid", "lo", "hi"])


def _times(keys: np.ndarray, common: np.ndarray, often: np.ndarray) -> np.ndarray:
    """How often each of keys came in the sample, 0 if it is not among the common ones, which are sorted."""
    if not len(common):
        return np.zeros(len(keys), np.int64)
    at = np.searchsorted(common, keys).clip(max=len(common) - 1)
    return np.where(common[at] == keys, often[at], 0)


def _weighed(batches: Iterator[pa.RecordBatch], bits: int, common: np.ndarray, often: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The rows of _keyed with the point's weight: how often all its keys came in the sample."""
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            vid, lo, hi = (part.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            made = list(_pair_keys(lo, hi, bits))
            weight = sum(np.bincount(row, _times(key, common, often), len(vid)) for key, row in made).astype(np.int64)
            for key, row in made:
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c[row]) for c in (vid, lo, hi, weight))], ["key", "vid", "lo", "hi", "weight"])


# --- links ------------------------------------------------------------------------------------


def _far(lo: np.ndarray, hi: np.ndarray, lo2, hi2) -> np.ndarray:
    return np.bitwise_count(lo ^ lo2).astype(np.int16) + np.bitwise_count(hi ^ hi2)


def forest(lo: np.ndarray, hi: np.ndarray, limit: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Spanning-forest links (as positions) of points that link at limit or fewer bits."""
    found, open_ = [], np.arange(len(lo))
    while len(open_):
        frontier, open_ = [open_[:1]], open_[1:]
        while frontier and len(open_):
            group = frontier.pop()
            for at in group:
                near = _far(lo[open_], hi[open_], lo[at], hi[at]) <= limit
                if near.any():
                    reached = open_[near]
                    found.append((np.full(len(reached), at), reached))
                    frontier.append(reached)
                    open_ = open_[~near]
                    if not len(open_):
                        break
    return found


def _compare(group: np.ndarray, vid: np.ndarray, lo: np.ndarray, hi: np.ndarray, limits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal group: all of small ones, of others a forest for each limit."""
    left, right = [], []
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])
    small = np.repeat(sizes <= SMALL_GROUP, sizes)
    at = np.flatnonzero(small)
    g, v, a, b = group[at], vid[at], lo[at], hi[at]
    for step in range(1, SMALL_GROUP):
        pos = np.flatnonzero(g[step:] == g[:-step])
        if not len(pos):
            break
        pos = pos[_far(a[pos], b[pos], a[pos + step], b[pos + step]) <= limits[-1]]
        left.append(v[pos])
        right.append(v[pos + step])
    for k in np.flatnonzero(sizes > SMALL_GROUP):
        here = slice(starts[k], starts[k] + sizes[k])
        for limit in limits:
            for p, q in forest(lo[here], hi[here], limit):
                left.append(vid[here][p])
                right.append(vid[here][q])
    return (np.concatenate(left), np.concatenate(right)) if left else (vid[:0], vid[:0])


def _stars(group: np.ndarray, vid: np.ndarray, weight: np.ndarray, near: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Links (as positions) from the heaviest row of each run of equal group to the rows near it, and so on with the rows left: fewer than rows."""
    hubs, rows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    same = group[1:] == group[:-1]
    open_ = np.flatnonzero(np.r_[same, False][: len(group)] | np.r_[False, same][: len(group)])
    open_ = open_[np.lexsort((vid[open_], -weight[open_], group[open_]))]
    while len(open_):
        of = group[open_]
        first = np.r_[True, of[1:] != of[:-1]]
        hub, row = open_[np.flatnonzero(first)[np.cumsum(first) - 1]][~first], open_[~first]
        good = near(hub, row)
        hubs.append(hub[good])
        rows.append(row[good])
        open_ = row[~good]
    return np.concatenate(hubs), np.concatenate(rows)


def _close(group: np.ndarray, vid: np.ndarray, lo: np.ndarray, hi: np.ndarray, weight: np.ndarray, limit: int) -> tuple[np.ndarray, ...]:
    """Stars within runs of equal group of points that differ in limit bits or fewer, and the hubs' weights."""
    hub, row = _stars(group, vid, weight, lambda x, y: _far(lo[x], hi[x], lo[y], hi[y]) <= limit)
    return vid[hub], vid[row], weight[hub]


def _linked(batches: Iterator[pa.RecordBatch], compare: Callable) -> Iterator[pa.RecordBatch]:
    """Rows (key, tile, vid, lo, hi and what else compare takes) come sorted by key and tile; the last group waits for the next batch.

    Pairs are given once with the lesser end first, or, if compare gives the weights of their first ends too, as they are with these.
    """
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, count
        key, tile, vid, lo, hi, *more = (np.concatenate(c) for c in zip(*held, strict=True))
        new = np.r_[True, (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])]
        upto = len(key) if last else int(np.flatnonzero(new)[-1])
        a, b, *weight = compare(np.cumsum(new)[:upto], vid[:upto], lo[:upto].view(np.uint64), hi[:upto].view(np.uint64), *(c[:upto] for c in more))
        ends = [a, b, *weight] if weight else [np.minimum(a, b), np.maximum(a, b)]
        pairs = np.unique(np.stack(ends, 1)[a != b], axis=0)
        held, count = [tuple(c[upto:] for c in (key, tile, vid, lo, hi, *more))], len(key) - upto
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, k]) for k in range(len(ends))], ["a", "b", "weight"][: len(ends)])

    for batch in batches:
        held.append(tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(batch.num_columns)))
        count += batch.num_rows
        if count >= COMPARE_ROWS:
            yield from flush(False)
    if count:
        yield from flush(True)
        held.clear()
    trim()


def links(points: DataFrame, bits: int, limits: tuple[int, ...]) -> DataFrame:
    """Links (a, b), a < b, between points (vid, lo, hi: long) of bits bits that differ in the last of limits or fewer.

    For 64 bits and limit 4 no linked pair is left unconnected; within a larger group only a
    spanning forest of its links is given, one for each of limits. Groups come sorted by vid, so
    that the forests of groups with the same members are much the same.
    """
    return _met(points, partial(_keyed, bits=bits), partial(_compare, limits=limits))


def _met(points: DataFrame, keyed: Callable, compare: Callable) -> DataFrame:
    """What compare finds (a, b) within each key of the rows (key, vid, lo, hi) that keyed makes of points."""
    schema = "key long, vid long, lo long, hi long"
    total = points.count()
    hot = F.greatest(F.lit(2 * CHUNK), F.lit(total / HOT_SHARE))
    sample = points.filter(F.pmod(F.xxhash64("vid"), F.lit(SAMPLE)) == 0).mapInArrow(keyed, schema)
    # only balance hangs on the estimate; Σ counts / threshold bounds the number of hot keys by a constant
    busy = stored(sample.groupBy("key").agg((F.count("*") * SAMPLE).alias("n")).filter(F.col("n") >= hot).select(F.col("key").alias("__key"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "busy")
    rows = points.mapInArrow(keyed, schema).join(F.broadcast(busy), F.col("key") == F.col("__key"), "left")
    chunk = F.pmod(F.xxhash64("vid", F.lit(7)), F.col("chunks")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: F.least(j, chunk) * F.col("chunks") + F.greatest(j, chunk))
    rows = rows.select("key", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(tiles)).alias("tile"), "vid", "lo", "hi")
    rows = rows.repartition("key", "tile").sortWithinPartitions("key", "tile", "vid")
    return rows.mapInArrow(partial(_linked, compare=compare), "a long, b long").distinct()


def _starred(points: DataFrame, keyed: Callable, compare: Callable, schema: str) -> DataFrame:
    """What compare finds within each key of the rows (key, vid, lo, hi, weight) that keyed makes of points.

    A busy key's rows are dealt to chunks once, not to tiles of every two, so rows do not grow with the square of a
    key's; the heaviest row of its sample goes to every chunk, so that a group's chunks have a hub in common.
    """
    made = "key long, vid long, lo long, hi long, weight long"
    hot = F.greatest(F.lit(2 * CHUNK), F.lit(points.count() / HOT_SHARE))
    sample = points.filter(F.pmod(F.xxhash64("vid"), F.lit(SAMPLE)) == 0).mapInArrow(keyed, made)
    counted = sample.groupBy("key").agg((F.count("*") * SAMPLE).alias("n"), F.max(F.struct("weight", "vid")).alias("top")).filter(F.col("n") >= hot)
    busy = stored(counted.select(F.col("key").alias("__key"), F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), F.col("top.vid").alias("hub")), "busy")
    rows = points.mapInArrow(keyed, made).join(F.broadcast(busy), F.col("key") == F.col("__key"), "left")
    own = F.array(F.pmod(F.xxhash64("vid", "key"), F.col("chunks")).cast("int"))
    tiles = F.when(F.col("chunks").isNull(), F.array(F.lit(0))).when(F.col("vid") == F.col("hub"), F.sequence(F.lit(0), F.col("chunks") - 1)).otherwise(own)
    rows = rows.select("key", F.explode(tiles).alias("tile"), "vid", "lo", "hi", "weight")
    rows = rows.repartition("key", "tile").sortWithinPartitions("key", "tile", "vid")
    return rows.mapInArrow(partial(_linked, compare=compare), schema)


def _common(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent of sample's keys, sorted as unsigned numbers, and how often each came."""
    counted = sample.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= COMMON).orderBy(F.desc("n"), "key").limit(MOST_COMMON).toArrow()
    common, often = counted.column("key").to_numpy().view(np.uint64), counted.column("n").to_numpy()
    order = np.argsort(common)
    return common[order], often[order]


def hub_links(points: DataFrame, bits: int, limit: int) -> DataFrame:
    """Of each point (vid, lo, hi) that shares a key with heavier ones of limit or fewer differing bits, the link (a, b) to the heaviest.

    A point's weight is how often its keys came in a sample: that of a group's middle is greatest, so most of a group
    has one hub, whatever the keys. There are fewer links than points.
    """
    sample = points.filter(F.pmod(F.xxhash64("vid"), F.lit(SAMPLE)) == 0).mapInArrow(partial(_keyed, bits=bits), "key long, vid long, lo long, hi long")
    common, often = _common(sample.select("key"))
    keyed = partial(_weighed, bits=bits, common=common.view(np.int64), often=often)
    stars = _starred(points, keyed, partial(_close, limit=limit), "a long, b long, weight long")
    return stars.groupBy("b").agg(F.max(F.struct("weight", "a")).alias("to")).select(F.col("to.a").alias("a"), "b")


def near_groups(docs: DataFrame, width: int = 5, limit: int = 4) -> DataFrame:
    """doc_id, fp and component_id of each row of docs (doc_id, text; other columns are ignored).

    fp is the 64-bit SimHash of width-word shingles (repeats included) as a signed long; a null or
    blank text has 0. Fingerprints link at limit (4 at most) or fewer differing bits, and
    component_id is the smallest doc_id of those reachable, null if all are null. Repeated rows
    are returned as they come, very long texts are read whole; an empty table gives no rows.
    """
    if not 0 <= limit <= 4:
        raise ValueError("the keys find links of 4 bits at most")
    rows = stored(fingerprints(docs, width), "fingerprints")
    fps = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "points")
    points = fps.select(F.col("fp").alias("vid"), F.col("fp").alias("lo"), F.lit(0).cast("long").alias("hi"))
    roots = components(links(points, 64, (limit,)))
    labels = fps.join(roots, fps["fp"] == roots["vertex"], "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    labels = stored(labels, "labels")
    least = labels.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("members"))
    named = lookup(labels, "root", least, F.col("members"), labels.count()).select("fp", "n", "component_id")
    return lookup(rows, "fp", stored(named, "named"), F.col("n"), rows.count()).select("doc_id", "fp", "component_id")


# --- near copies, verified --------------------------------------------------------------------


def _sketched(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "row", "vid", "lo", "hi", "counts", "words"]
    for batch in batches:
        vids, los, his, counts, kept = [], [], [], [], []
        packer = zstandard.ZstdCompressor(level=3)
        for value in batch.column(2):
            data = (value.as_py() or b"").translate(_FOLD)
            words = data.split()
            ones = np.zeros(128, np.int64)
            distinct = list(set(words))
            for at in range(0, len(distinct), 1 << 14):
                part = distinct[at : at + (1 << 14)]
                made = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, part)), np.uint8).reshape(-1, 16)
                ones += np.unpackbits(made, axis=1, bitorder="little").sum(0, dtype=np.int64)
            both = np.packbits(ones * 2 > len(distinct), bitorder="little").view(np.int64)
            vids.append(_signed(xxhash.xxh64_intdigest(b" ".join(words), SEED)))
            los.append(int(both[0]))
            his.append(int(both[1]) & (1 << WIDE_BITS - 64) - 1)
            shingles = np.unique(shingle_hashes(data, width))
            counts.append(np.bincount((shingles % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).clip(max=255).astype(np.uint8).tobytes())
            kept.append(packer.compress(b" ".join(words)))
        values = (batch.column(0), batch.column(1), *(pa.array(v, pa.int64()) for v in (vids, los, his)), *(pa.array(v, pa.binary()) for v in (counts, kept)))
        yield pa.RecordBatch.from_arrays(list(values), names)
    trim()


def _needed(sizes: np.ndarray | int, least: float) -> np.ndarray:
    """Shingles that two sets have in common at least, of so many in both, if their similarity is least or more."""
    return np.ceil(np.asarray(sizes) * (least / (1 + least)) - 1e-6)


class _Sets(dict):
    """Bounded memo from a text (its vid) to the sorted hashes of its shingles, made from its words."""

    def __init__(self, width: int) -> None:
        super().__init__()
        self.width, self.size, self.unpack = width, 0, zstandard.ZstdDecompressor()

    def of(self, vid: int, words: bytes) -> np.ndarray:
        found = self.get(vid)
        if found is None:
            found = np.unique(shingle_hashes(self.unpack.decompress(words), self.width))
            if self.size > MEMO_SHINGLES:
                self.clear()
                self.size = 0
            self[vid] = found
            self.size += len(found)
        return found


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted shingle sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _verified(batches: Iterator[pa.RecordBatch], width: int, least: float) -> Iterator[pa.RecordBatch]:
    sets = _Sets(width)
    for batch in batches:
        good = [similarity(sets.of(a, x), sets.of(b, y)) >= least for a, b, x, y in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)]
        kept = batch.filter(pa.array(good, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])
    sets.clear()
    trim()


def _possible(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose bucket counts allow the similarity: sets differ at least by as much as their counts do."""
    for batch in batches:
        one, other = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int32) for k in (2, 3))
        apart = np.abs(one - other).sum(1)
        # counts of 255 may stand for more, then sizes are not known
        sizes, full = one.sum(1) + other.sum(1), (one == 255).any(1) | (other == 255).any(1)
        kept = batch.filter(pa.array(full | ((sizes - apart) // 2 >= _needed(sizes, least)), pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], ["a", "b"])


def _all_shingles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for value in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(unpack.decompress(value.as_py()), width)).view(np.int64))], ["key"])


def _prefixes(batches: Iterator[pa.RecordBatch], width: int, common: np.ndarray, often: np.ndarray, least: float, weights: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (key, vid, label, size and place, and if asked for weight) for the first shingles of each text: rare ones first, then by hash.

    A text's weight is how often these came in the sample.
    """
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        found: list[tuple[np.ndarray, ...]] = []
        for vid, label, value in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            shingles = np.unique(shingle_hashes(unpack.decompress(value), width))
            if not len(shingles):
                continue
            times = _times(shingles, common, often)
            size = len(shingles)
            upto = size - int(np.ceil(least * size - 1e-6)) + 1
            first = np.argsort(times, kind="stable")[:upto]
            keys = shingles[first].view(np.int64)
            found.append((keys, *(np.full(len(keys), v) for v in (vid, label)), size << 32 | np.arange(len(keys)), np.full(len(keys), times[first].sum())))
        if found:
            values = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
            yield pa.RecordBatch.from_arrays(values if weights else values[:4], ["key", "vid", "lo", "hi", "weight"][: 5 if weights else 4])


def _placed(placed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of texts, and how many of their shingles come from a place on."""
    size = (placed >> np.uint64(32)).astype(np.int64)
    return size, size - (placed & np.uint64(0xFFFFFFFF)).astype(np.int64)


def _meeting(group: np.ndarray, vid: np.ndarray, label: np.ndarray, placed: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of unlike labels within runs of equal group that can be similar if the run's shingle is their first common one."""
    left, right = [], []
    size, rest = _placed(placed)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, len(group)])

    def take(x, y) -> None:
        good = (label[x] != label[y]) & (np.minimum(rest[x], rest[y]) >= _needed(size[x] + size[y], least))
        left.append(np.broadcast_to(vid[x], good.shape)[good])
        right.append(vid[y][good])

    at = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SMALL_GROUP), sizes))
    for step in range(1, SMALL_GROUP):
        pos = np.flatnonzero(group[at[step:]] == group[at[:-step]])
        if not len(pos):
            break
        take(at[pos], at[pos + step])
    for k in np.flatnonzero(sizes > SMALL_GROUP):
        if (label[starts[k] : starts[k] + sizes[k]] == label[starts[k]]).all():
            continue
        for x in range(starts[k], starts[k] + sizes[k] - 1):
            take(x, np.arange(x + 1, starts[k] + sizes[k]))
    return (np.concatenate(left), np.concatenate(right)) if left else (vid[:0], vid[:0])


def _meeting_stars(group: np.ndarray, vid: np.ndarray, label: np.ndarray, placed: np.ndarray, weight: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """As _meeting, but of each run only the pairs of its heaviest texts."""
    size, rest = _placed(placed)
    hub, row = _stars(group, vid, weight, lambda x, y: np.minimum(rest[x], rest[y]) >= _needed(size[x] + size[y], least))
    unlike = label[hub] != label[row]
    return vid[hub[unlike]], vid[row[unlike]]


def common_shingles(sets: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many texts of a sample of sets (vid, words) have, and how often each came."""
    sample = sets.filter(F.pmod(F.xxhash64("vid"), F.lit(SAMPLE)) == 0).select("words")
    return _common(sample.mapInArrow(partial(_all_shingles, width=width), "key long"))


def prefix_links(sets: DataFrame, width: int, least: float, common: np.ndarray, often: np.ndarray, stars: bool = False) -> DataFrame:
    """Pairs (a, b), a < b, of sets (vid, label, words) with unlike labels: all of similarity least or more, and others.

    Whatever the order of shingles, the first one that two such sets share lies among the first 1 - least of
    either. The order is by frequency in a sample, so that few unlike texts meet; only cost hangs on it.
    With stars, only pairs with the heaviest texts that share a shingle: fewer than rows, and most of what connects large groups.
    """
    points = sets.select("vid", "label", "words")
    keyed = partial(_prefixes, width=width, common=common, often=often, least=least, weights=stars)
    if stars:
        return _starred(points, keyed, partial(_meeting_stars, least=least), "a long, b long").distinct()
    return _met(points, keyed, partial(_meeting, least=least))


def _copies(docs: DataFrame, width: int, least: float) -> DataFrame:
    """doc_id, row (text_key) and first (a struct of doc_id and row: those of the group's first row, by id, null last, then row) of each row of docs."""
    raw = docs.select(F.col("doc_id").cast("long"), text_key(F.col("text")).alias("row"), F.col("text").cast("binary").alias("data"))
    schema = "doc_id long, row long, vid long, lo long, hi long, counts binary, words binary"
    rows = stored(raw.mapInArrow(partial(_sketched, width=width), schema).withColumn("rid", F.monotonically_increasing_id()), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    texts = rows.groupBy("vid").agg(F.min(place).alias("rep"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.min("rid").alias("rid"))
    texts = stored(texts, "texts")
    repeats = stored(rows.select("rid").join(texts.select("rid"), "rid", "left_anti"), "repeats")
    sets = rows.select("rid", "vid", "counts", "words").join(repeats, "rid", "left_anti").drop("rid")

    def paired(edges: DataFrame, column: str, run: Callable, label: str) -> DataFrame:
        """What run leaves of edges (a, b) with column of both ends."""
        total = edges.count()
        half = edges
        for end, name in (("a", "one"), ("b", "other")):
            degree = edges.groupBy(end).agg(F.count("*").alias("degree"))
            facts = sets.select(F.col("vid").alias(end), F.col(column).alias(name)).join(degree, end)
            whole = lookup(half, end, facts, F.col("degree"), total).drop("degree")
            half = stored(whole, "half") if name == "one" else whole.select("a", "b", "one", "other").mapInArrow(run, "a long, b long")
        return stored(half, label)

    def decided(edges: DataFrame) -> DataFrame:
        possible = paired(edges, "counts", partial(_possible, least=least), "possible")
        return paired(possible, "words", partial(_verified, width=width, least=least), "similar")

    def labelled(roots: DataFrame) -> DataFrame:
        return sets.join(roots.withColumnRenamed("vertex", "vid"), "vid", "left").select("vid", F.coalesce("root", "vid").alias("label"), "words")

    # candidates number fewer than key rows until groups are known; all pairs are made only between these
    found = stored(hub_links(texts.select("vid", "lo", "hi"), WIDE_BITS, WIDE_LIMIT), "found")
    release(docs.sparkSession)
    roots = components(decided(found))
    common, often = common_shingles(sets, width)
    for stars in (True, False):
        met = stored(prefix_links(labelled(roots), width, least, common, often, stars), "met")
        release(docs.sparkSession)
        roots = components(roots.select(F.col("vertex").alias("a"), F.col("root").alias("b")).unionByName(decided(met)))
    labels = texts.join(roots, texts["vid"] == roots["vertex"], "left").select("vid", "rep", F.coalesce("root", "vid").alias("root"))
    labels = stored(labels, "labels")
    named = labels.groupBy("root").agg(F.min("rep").alias("first"), F.count("*").alias("members"))
    named = stored(lookup(labels, "root", named, F.col("members"), labels.count()).select("vid", "first"), "named")
    sizes = rows.groupBy("vid").agg(F.count("*").alias("n"))
    return lookup(rows.select("doc_id", "row", "vid"), "vid", named.join(sizes, "vid"), F.col("n"), rows.count()).select("doc_id", "row", "first")


def copy_groups(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id and group (the least doc_id) of each row of docs (doc_id, text; others are ignored).

    Texts whose sets of width-word shingles have a Jaccard similarity of least or more share a group, as do
    those that such pairs connect. Every pair is decided on the whole sets, of very long texts too. Candidates are close word
    fingerprints first, each with its heaviest neighbour, then texts with the heaviest that share one of their first shingles: these
    two steps gather most copies in few links. Then come all pairs from different groups that share one, so no pair is lost. Equal word sequences are always grouped, blank and null texts too.
    A null id comes after all others; a group of null ids only has null. An empty table gives no rows.
    """
    return _copies(docs, width, least).select("doc_id", F.col("first.doc_id").alias("group"))


def one_of_each(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near copies, that of the least doc_id, with docs' columns, whatever their names.

    Rows under one id, or without one, are rows of their own: they are told apart by their texts. Of a group without
    ids, or with several texts under its least id, one row stays, by a hash of the text; of rows that repeat id and text, any one.
    """
    key, row = fresh(docs, "kept_id"), fresh(docs, "kept_row")
    found = _copies(docs, width, least)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))).select(F.col("doc_id").alias("of_id"), F.col("row").alias("of_row")).distinct()
    keyed = docs.withColumn(key, F.col("doc_id").cast("long")).withColumn(row, text_key(F.col("text")))
    kept = stored(kept, "kept")
    kept = kept.select(F.col("of_id").alias(fresh(keyed, "of_id")), F.col("of_row").alias(fresh(keyed, "of_row")))
    same = keyed[key].eqNullSafe(kept[kept.columns[0]]) & (keyed[row] == kept[kept.columns[1]])
    return keyed.join(kept, same, "left_semi").dropDuplicates([key, row]).select(*docs.columns)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"), width=4, limit=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
