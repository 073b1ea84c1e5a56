"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks. A block starts from an empty model, has its own CRC-32 and is decoded without any
other. Within it, up to LANES lanes of consecutive ids are coded at once by numpy, each with a range coder of its
own; all lanes share the block's model, which learns from every lane after each step.

The id is predicted in three orders. Order 2: the id that last followed the same two ids, with a confidence that
grows by hits. Order 1: how often each id followed the last id; the most frequent ids have a row of their own and the others
share one. Order 0: how often each id came so far. They are mixed by weights that learn from what was coded. Orders 1
and 0 are summed by weights that depend on how full the row of order 1 is, each moved by the share that the order had in the
probability of the ids that came. Order 2 is weighed against this sum, and against ids that are new in the block, by its
confidence and its last hits.

Weights and rows use IEEE doubles, each operation rounded once, and sums of whole numbers or in a set order; the coder
itself has integers only. So a block reads the same on any machine.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"FWR2"
#: ids of a block, lanes of a block, and ids of a lane at least
BLOCK, LANES, LEAST_IDS = 1 << 21, 4096, 512
MAX_ID = (1 << 18) - 1
#: cells of all order-1 rows together, rows at most, bits of a place in the order-2 table
CELLS, ROWS, TABLE2 = 1 << 20, 1024, 18
#: parts that a class's and an id's probability have
CLASS_BITS, ID_BITS = 15, 20
#: rows are made anew when the steps have grown by this much
RENEW = 1.8
#: a row's frequencies are numbers of so many bits
_ROW_BITS = ID_BITS + 1
#: levels of how often a row's ids came on average, in sixteenths
_FULLNESS = np.array([b << k for k in range(4, 20) for b in (4, 5, 6, 7)]) >> 2
#: classes: hit by order 2, known in the block, new in the block
_KINDS = 3
#: confidences of order 2 times its last three hits
_CONTEXTS = 8 * 8
_PARTS = np.uint64(CLASS_BITS + ID_BITS)
_WORD, _TOP, _LEAST = np.uint64(16), np.uint64(48), np.uint64(1 << 48)


class _Model:
    """Predictions of the ids of all lanes at a step; columns holds the steps that were coded so far."""

    def __init__(self, columns: np.ndarray, size: int) -> None:
        self.columns, self.size = columns, size
        self.lanes = columns.shape[1]
        self.step, self.due, self.counted = 0, 1, 0
        self.two, self.last = np.zeros(self.lanes, np.int64), np.zeros(self.lanes, np.int64)
        self.hits = np.zeros(self.lanes, np.int64)
        self.table2 = np.zeros(1 << TABLE2, np.int32)
        self.classes = np.tile(np.array([2, 12, 2], np.int64), (_CONTEXTS, 1))
        self.new_bits = ID_BITS - max(1, (size - 1).bit_length())
        self.learned = np.ones((len(_FULLNESS) + 1, 2))
        # ids are numbered as they come; the id before the first is number 0
        self.seen, self.at_of = np.empty(0, np.int64), np.full(size, -1, np.int64)
        self.count = np.empty(0, np.int64)
        # with a step of starts in front
        self.numbers = np.zeros(columns.size + self.lanes, np.int64)
        self.old: tuple | None = None
        self._rows()
        self._weights()

    def _mixed(self, begin: int, end: int) -> None:
        """Move the weights of orders 1 and 0 by their shares in the probability of ids that came, of 2 ** 16 or so ids at most."""
        row_at, n, pairs, total, plain, level = self.old
        every = max(1, end - begin >> 16)
        at, before = self.numbers[begin + self.lanes : end + self.lanes : every], self.numbers[begin:end:every]
        known = (at < n) & (before < n)
        at, row = at[known], row_at.take(before[known])
        level = level.take(row)
        weight = (self.learned[:, 0] / self.learned.sum(1)).take(level)
        one = weight * pairs.take(row * n + at) / total.take(row)
        share = one / (one + (1 - weight) * plain.take(at))
        self.learned[:, 0] += np.bincount(level, share, len(self.learned))
        self.learned[:, 1] += np.bincount(level, 1 - share, len(self.learned))

    def _rows(self) -> None:
        """Count the ids of all steps so far into rows of cumulative frequencies."""
        begin, end = self.counted, self.step * self.lanes
        fresh = self.columns[begin // self.lanes : self.step].ravel()
        counts = np.bincount(fresh, minlength=self.size)
        new = np.flatnonzero((counts > 0) & (self.at_of < 0))
        self.at_of[new] = len(self.seen) + np.arange(len(new))
        self.seen = np.concatenate([self.seen, new])
        n = len(self.seen)
        self.numbers[begin + self.lanes : end + self.lanes] = self.at_of.take(fresh, mode="clip")
        if self.old is not None:
            self._mixed(begin, end)
        self.count = counts[self.seen] + np.concatenate([self.count, np.zeros(len(new), np.int64)])
        self.counted = end
        self.width = n + 1
        rows = max(1, min(ROWS, CELLS // self.width))
        row_at = np.full(max(n, 1), rows - 1, np.int64)
        row_at[np.argsort(-self.count, kind="stable")[: rows - 1]] = np.arange(min(n, rows - 1))
        row_of = np.full(self.size, rows - 1, np.int64)
        row_of[self.seen] = row_at[:n]
        self.start_of = row_of * self.width
        # rows stand one after another and each begins above the last, so that a search stays in its row
        self.base_of = (row_of << _ROW_BITS).astype(np.uint32)
        self.cum = np.full(rows * self.width + (1 << n.bit_length()), ~np.uint32(0), np.uint32)
        if n:
            cells = (row_at * n).take(self.numbers[:end], mode="clip")
            cells += self.numbers[self.lanes : end + self.lanes]
            pairs = np.bincount(cells, minlength=rows * n).reshape(rows, n)
            total = np.maximum(pairs.sum(1), 1)
            pairs = pairs.astype(np.float32)
            plain = self.count / end
            level = np.searchsorted(_FULLNESS, (total << 4) // np.maximum(np.count_nonzero(pairs, axis=1), 1), side="right")
            weight = (self.learned[:, 0] / self.learned.sum(1)).take(level)
            parts = (1 << ID_BITS) - 2 * n - 2
            made = pairs * (weight / total * parts).astype(np.float32)[:, None]
            made += (plain * parts).astype(np.float32) * (1 - weight).astype(np.float32)[:, None]
            cum = self.cum[: rows * self.width].reshape(rows, self.width)
            cum[:, 0] = 0
            np.cumsum(made.astype(np.uint32) + np.uint32(1), axis=1, out=cum[:, 1:])
            cum += (np.arange(rows, dtype=np.uint32) << np.uint32(_ROW_BITS))[:, None]
            self.old = (row_at, n, pairs.reshape(-1), total, plain, level)

    def _weights(self) -> None:
        share = np.cumsum(self.classes, axis=1)
        ends = share * ((1 << CLASS_BITS) - _KINDS) // share[:, -1:] + np.arange(1, _KINDS + 1)
        starts = np.concatenate([np.zeros((_CONTEXTS, 1), np.int64), ends[:, :-1]], axis=1)
        self.class_size = (ends - starts).reshape(-1).astype(np.uint64)
        self.class_start = starts.reshape(-1).astype(np.uint64)

    def predict(self) -> None:
        self.slot = (self.two * 2654435761 ^ self.last * 2246822519) >> 20 & (1 << TABLE2) - 1
        self.entry = self.table2.take(self.slot, mode="clip").astype(np.int64)
        self.guess = self.entry >> 3
        self.sure = self.entry & 7
        self.context = (self.sure << 3 | self.hits) * _KINDS
        self.start, self.base = self.start_of.take(self.last, mode="clip"), self.base_of.take(self.last, mode="clip")

    def update(self, now: np.ndarray, hit: np.ndarray, chosen: np.ndarray) -> None:
        """now: the ids; hit: where order 2 had them; chosen: context and class of each."""
        kept = np.where(self.sure > 1, self.entry ^ self.sure ^ self.sure >> 1, now << 3)
        self.table2[self.slot] = np.where(hit, self.entry + (self.sure < 7), kept)
        self.hits = (self.hits << 1 | hit) & 7
        self.two, self.last = self.last, now
        self.classes += np.bincount(chosen, minlength=_CONTEXTS * _KINDS).reshape(-1, _KINDS) * 4
        self.step += 1
        if self.step < 32 or self.step % 4 == 0:
            full = self.classes.sum(1) > 1 << 20
            if full.any():
                self.classes[full] = (self.classes[full] >> 1) + 1
            self._weights()
        if self.step >= self.due:
            self.due = max(self.step + 1, int(self.step * RENEW))
            self._rows()


def _carried(words: np.ndarray, at: np.ndarray, lanes: int) -> None:
    """Add one to the words at these places; a carry runs on through full words."""
    while len(at):
        words[at] += np.uint16(1)
        at = at[words[at] == 0] - lanes


def _encode_lanes(columns: np.ndarray, size: int) -> list[bytes]:
    """columns: a row of ids for each step. Returns the words of each lane."""
    steps, lanes = columns.shape
    model = _Model(columns, size)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    # the words stand in rows of one for each lane, the first of which takes no word; at is the next place of a lane
    words, at = np.zeros(lanes * (steps + 8), np.uint16), np.arange(lanes, 2 * lanes)
    for step in range(steps):
        now = columns[step]
        model.predict()
        hit = now == model.guess
        number = model.at_of.take(now, mode="clip")
        known = number >= 0
        cell = model.start + number
        begin = model.cum.take(cell, mode="clip")
        part = (model.cum.take(cell + 1, mode="clip") - begin).astype(np.uint64)
        begin = (begin - model.base).astype(np.uint64)
        if not known.all():
            odd = np.flatnonzero(~known)
            begin[odd], part[odd] = now[odd] << model.new_bits, 1 << model.new_bits
        begin *= ~hit
        part[hit] = 1 << ID_BITS
        chosen = model.context + ~hit + ~(hit | known)
        share = model.class_size.take(chosen, mode="clip")
        unit = span >> _PARTS
        add = ((model.class_start.take(chosen, mode="clip") << np.uint64(ID_BITS)) + share * begin) * unit
        low += add
        over = low < add
        if over.any():
            _carried(words, at[over] - lanes, lanes)
        span = share * part * unit
        # what is not due is overwritten
        words[at] = (low >> _TOP).astype(np.uint16)
        due = span < _LEAST
        at += due * lanes
        move = due.astype(np.uint64) << np.uint64(4)
        low <<= move
        span <<= move
        more = np.flatnonzero(span < _LEAST)
        while len(more):
            words[at[more]] = (low[more] >> _TOP).astype(np.uint16)
            at[more] += lanes
            low[more] <<= _WORD
            span[more] <<= _WORD
            more = more[span[more] < _LEAST]
        if int(at.max()) >= len(words) - 5 * lanes:
            words = np.concatenate([words, np.zeros(len(words), np.uint16)])
        model.update(now, hit, chosen)
    # one word is enough: the last interval holds a number that ends in zeros
    end = low + (_LEAST - np.uint64(1))
    over = end < low
    _carried(words, at[over] - lanes, lanes)
    words[at] = (end >> _TOP).astype(np.uint16)
    words = np.ascontiguousarray(words.reshape(-1, lanes).T)
    return [words[k, 1:n].astype("<u2").tobytes() for k, n in enumerate((at // lanes + 1).tolist())]


def _decode_lanes(coded: list[bytes], steps: int, size: int) -> np.ndarray:
    lanes = len(coded)
    words = np.zeros((lanes, max(len(c) // 2 for c in coded) + 4), np.uint64)
    for k, c in enumerate(coded):
        words[k, : len(c) // 2] = np.frombuffer(c, "<u2")
    code = words[:, 0] << _TOP | words[:, 1] << np.uint64(32) | words[:, 2] << _WORD | words[:, 3]
    words = np.ascontiguousarray(words.T).reshape(-1)
    at = np.arange(4 * lanes, 5 * lanes)
    columns = np.zeros((steps, lanes), np.int64)
    model = _Model(columns, size)
    span = np.full(lanes, ~np.uint64(0))
    most = np.uint64((1 << CLASS_BITS + ID_BITS) - 1)
    for step in range(steps):
        model.predict()
        unit = span >> _PARTS
        value = np.minimum(code // unit, most)
        place = value >> np.uint64(ID_BITS)
        hit = place < model.class_start.take(model.context + 1, mode="clip")
        new = place >= model.class_start.take(model.context + 2, mode="clip")
        chosen = model.context + ~hit + new
        first, share = model.class_start.take(chosen, mode="clip") << np.uint64(ID_BITS), model.class_size.take(chosen, mode="clip")
        target = np.minimum((value - first) // share, np.uint64((1 << ID_BITS) - 1))
        cell, jump, wanted = model.start, 1 << model.width.bit_length() - 1, target.astype(np.uint32) + model.base
        while jump:
            cell = cell + (model.cum.take(cell + jump, mode="clip") <= wanted) * jump
            jump >>= 1
        begin = model.cum.take(cell, mode="clip")
        part = (model.cum.take(cell + 1, mode="clip") - begin).astype(np.uint64)
        begin = (begin - model.base).astype(np.uint64)
        now = model.seen.take(cell - model.start, mode="clip") if len(model.seen) else np.zeros(lanes, np.int64)
        if new.any():
            odd = np.flatnonzero(new)
            now[odd] = np.minimum(target[odd].astype(np.int64) >> model.new_bits, size - 1)
            begin[odd], part[odd] = now[odd] << model.new_bits, 1 << model.new_bits
        now = np.where(hit, model.guess, now)
        begin *= ~hit
        part[hit] = 1 << ID_BITS
        code -= (first + share * begin) * unit
        span = share * part * unit
        due = span < _LEAST
        move = due.astype(np.uint64) << np.uint64(4)
        code = code << move | words.take(at, mode="clip") * due
        at += due * lanes
        span <<= move
        more = np.flatnonzero(span < _LEAST)
        while len(more):
            code[more] = code[more] << _WORD | words.take(at[more], mode="clip")
            at[more] += lanes
            span[more] <<= _WORD
            # a damaged lane may have no interval left
            span[more[span[more] == 0]] = _LEAST
            more = more[span[more] < _LEAST]
        columns[step] = now
        model.update(now, hit, chosen)
    return columns


def encode_block(ids: np.ndarray) -> bytes:
    """Numbers of ids, size of the vocabulary, lanes and CRC-32 of the ids, then each lane's number of words, compressed, and the lanes."""
    n, size = len(ids), int(ids.max(initial=0)) + 1
    if size - 1 > MAX_ID:
        raise ValueError("ids of more than 18 bits")
    if n > BLOCK:
        raise ValueError("too many ids for a block")
    lanes = max(1, min(LANES, n // LEAST_IDS))
    steps = -(-n // lanes)
    check = zlib.crc32(ids.astype("<u4").tobytes())
    columns = np.empty((steps, lanes), np.int64)
    if n:
        # the last lane ends with the last id, repeated
        columns.T[:] = np.pad(ids, (0, lanes * steps - n), mode="edge").reshape(lanes, steps)
    coded = _encode_lanes(columns, size) if n else []
    lengths = zlib.compress(np.array([len(c) // 2 for c in coded], "<u2").tobytes(), 9)
    return b"".join([struct.pack("<IIIII", n, size, len(coded), check, len(lengths)), lengths, *coded])


def decode_block(block: bytes) -> np.ndarray:
    """The ids of one block; ValueError if it is damaged."""
    damaged = ValueError("block is damaged")
    if len(block) < 20:
        raise damaged
    n, size, lanes, check, packed = struct.unpack_from("<IIIII", block)
    if n > BLOCK or not 0 < size <= MAX_ID + 1 or lanes > LANES or bool(n) != bool(lanes):
        raise damaged
    try:
        lengths = 2 * np.frombuffer(zlib.decompress(block[20 : 20 + packed]), "<u2").astype(np.int64)
    except zlib.error:
        raise damaged from None
    ends = 20 + packed + np.cumsum(lengths)
    if len(lengths) != lanes or lanes and int(ends[-1]) != len(block):
        raise damaged
    if not n:
        return np.empty(0, np.uint32)
    coded = [block[e - m : e] for e, m in zip(ends.tolist(), lengths.tolist(), strict=True)]
    ids = _decode_lanes(coded, -(-n // lanes), size).T.reshape(-1)[:n].astype(np.uint32)
    if zlib.crc32(ids.astype("<u4").tobytes()) != check:
        raise damaged
    return ids


def encode(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A frame: magic, number of blocks, CRC-32 of their sizes, the sizes, and the blocks."""
    blocks = [encode_block(ids[at : at + block]) for at in range(0, len(ids), block)]
    sizes = np.array([len(b) for b in blocks], "<u4").tobytes()
    return b"".join([MAGIC, struct.pack("<II", len(blocks), zlib.crc32(sizes)), sizes, *blocks])


def blocks_of(frame: bytes) -> list[bytes]:
    """The blocks of a frame, each of which decode_block() takes alone."""
    if frame[:4] != MAGIC or len(frame) < 12:
        raise ValueError("not a frame of this format")
    count, check = struct.unpack_from("<II", frame, 4)
    table = frame[12 : 12 + 4 * count]
    if len(table) != 4 * count or zlib.crc32(table) != check:
        raise ValueError("frame is damaged")
    sizes = np.frombuffer(table, "<u4").astype(np.int64)
    ends = 12 + len(table) + np.cumsum(sizes)
    if len(frame) != (int(ends[-1]) if count else 12):
        raise ValueError("frame is damaged")
    return [frame[e - n : e] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame; ValueError if it is damaged."""
    return np.concatenate([np.empty(0, np.uint32), *map(decode_block, blocks_of(frame))])
