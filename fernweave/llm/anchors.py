"""Anchors: one gram of each window of LENGTH bytes, chosen by its content alone.

Equal windows have equal anchors at equal places, so windows need to be compared only within the group of
their anchor. Consecutive windows mostly share an anchor; they form a fragment.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM + 1
#: bytes looked at together; a place fits in PLACE bits
PLACE = np.uint64(20)
BUFFER = (1 << 20) - 64
_PLACES = np.uint64((1 << 20) - 1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class Fragments(NamedTuple):
    """Runs of windows with one anchor: its hash (44 bits), the first window, number of windows, and owner (index of the text)."""

    anchor: np.ndarray
    first: np.ndarray
    count: np.ndarray
    owner: np.ndarray


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each place on."""
    n = len(data) - GRAM + 1
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.empty(n + 8, np.uint64)
    for k in range(8):
        part = padded[k : k + (n + 7 - k) // 8 * 8 + 8]
        found = part[: len(part) // 8 * 8].view(np.uint64)
        room = len(words[k::8])
        words[k::8] = found[:room] if len(found) >= room else np.concatenate([found, np.zeros(room - len(found), np.uint64)])
    mixed = words[:n] * _A ^ (words[8 : n + 8] * _B >> np.uint64(29)) ^ words[8 : n + 8] * _C
    mixed *= _B
    return mixed ^ mixed >> np.uint64(31)


def _least(keys: np.ndarray) -> np.ndarray:
    """Minimum of each SPAN consecutive keys."""
    now, width = keys, 1
    while width * 2 <= SPAN:
        now = np.minimum(now[:-width], now[width:])
        width *= 2
    rest = SPAN - width
    return np.minimum(now[: len(now) - rest], now[rest:]) if rest else now


def fragments(texts: list[bytes]) -> Fragments:
    """Fragments of each text, in order; first is a byte offset within the text."""
    found: list[Fragments] = []
    batch: list[tuple[int, int, bytes]] = []
    size = 0
    for owner, text in enumerate(texts):
        step = BUFFER - LENGTH
        for at in range(0, max(0, len(text) - LENGTH + 1), step):
            part = text[at : at + step + LENGTH - 1]
            if size + len(part) > BUFFER:
                found.append(_of_batch(batch))
                batch, size = [], 0
            batch.append((owner, at, part))
            size += len(part)
    if batch:
        found.append(_of_batch(batch))
    if not found:
        none = np.empty(0, np.int64)
        return Fragments(none.astype(np.uint64), none, none, none)
    return Fragments(*(np.concatenate(c) for c in zip(*found, strict=True)))


def _of_batch(batch: list[tuple[int, int, bytes]]) -> Fragments:
    data = np.frombuffer(b"".join(p for _, _, p in batch), np.uint8)
    sizes = np.array([len(p) for _, _, p in batch])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    hashes = _grams(data)
    keys = hashes & ~_PLACES | np.arange(len(hashes), dtype=np.uint64)
    least = _least(keys)
    good = np.zeros(len(data) + 1, np.int8)
    good[starts] += 1
    np.subtract.at(good, starts + sizes - LENGTH + 1, 1)
    valid = np.cumsum(good[: len(least)]) > 0
    new = np.empty(len(least), bool)
    new[0] = True
    new[1:] = least[1:] != least[:-1]
    new[starts[starts < len(least)]] = True
    begin = np.flatnonzero(new & valid)
    # a run ends at the next one or at its text's last window
    part = np.searchsorted(starts, begin, side="right") - 1
    last = starts[part] + sizes[part] - LENGTH
    following = np.concatenate([begin[1:], [len(data)]])
    count = np.minimum(following - 1, last) - begin + 1
    owner = np.array([o for o, _, _ in batch])[part]
    offset = np.array([a for _, a, _ in batch])[part]
    return Fragments(least[begin] >> PLACE, begin - starts[part] + offset, count, owner)
