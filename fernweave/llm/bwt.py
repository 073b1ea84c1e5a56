"""Burrows-Wheeler transforms of string collections over words of WORD bytes, and their merge.

A string is read in WORD phases; each phase is a string of words, closed by a terminator of its own. The
suffixes of a shard are sorted once, and the shard is kept as the word before each suffix, in that order. Shards are
merged by refining their interleave: start with the shards one after another, and in each
round sort it stably by the words that the transforms give in its order. After k rounds the interleave is right for k words.
Blocks of suffixes with equal first words split as the rounds go, which gives their common prefixes; no suffix is
sorted again.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

WORD = 10


class Shard(NamedTuple):
    """before: the word before each suffix in sorted order, -1 at a string's begin; place: where the suffix starts in the data."""

    before: np.ndarray
    place: np.ndarray
    terminators: int


def words(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Dense rank of the WORD bytes from each place, -1 where a string has fewer left."""
    if len(data) < WORD:
        return np.full(len(data), -1, np.int64)
    n = len(data) - WORD + 1
    half = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    for k in range(WORD):
        half[k >= WORD // 2] <<= np.uint64(8)
        half[k >= WORD // 2] |= data[k : k + n]
    room = np.zeros(len(data), np.int64)
    room[starts] = sizes
    left = np.repeat(starts + sizes, sizes) - np.arange(len(data))
    good = np.flatnonzero(left[:n] >= WORD)
    first = np.unique(half[0][good], return_inverse=True)[1].astype(np.uint64)
    ranks = np.full(len(data), -1, np.int64)
    ranks[good] = np.unique(first << np.uint64(40) | half[1][good], return_inverse=True)[1]
    return ranks


def shard(ranks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> Shard:
    """Sort the suffixes of the strings at starts; ranks is words() of the whole data."""
    # suffixes start at each place and at the end of each phase: WORD ends at most for a string, the last WORD places up to its end
    inner = np.concatenate([np.arange(a, a + n) for a, n in zip(starts, sizes, strict=True)]) if len(starts) else np.empty(0, np.int64)
    ends = starts + sizes
    place = np.concatenate([inner, ends])
    owner = np.concatenate([np.repeat(np.arange(len(starts)), sizes), np.arange(len(starts))])
    rest = ends[owner] - place
    is_end = rest < WORD
    rank = np.empty(len(place), np.int64)
    term = np.flatnonzero(is_end)
    # terminators come before all words, in order of their strings, then phases
    rank[term[np.lexsort((place[term], owner[term]))]] = np.arange(len(term))
    body = np.flatnonzero(~is_end)
    rank[body] = len(term) + ranks[place[body]]
    # within a string, the suffix one word on is WORD places on
    string_at = np.concatenate([[0], np.cumsum(sizes)])[:-1]
    step = WORD
    while True:
        following = place + step
        reach = following <= ends[owner]
        index = np.where(following == ends[owner], len(inner) + owner, string_at[owner] + following - starts[owner])
        after = np.where(reach & ~is_end, rank[np.where(reach, index, 0)] + 1, 0)
        key = rank * (int(after.max(initial=0)) + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        new = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        rank = np.empty(len(place), np.int64)
        rank[order] = new
        if new[-1] == len(place) - 1 or step > sizes.max(initial=0):
            break
        step *= 2
    back = place - starts[owner] >= WORD
    before = np.where(back, ranks[np.where(back, place - WORD, 0)], -1)
    return Shard(before[order], place[order], len(term))


def merged_blocks(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave the shards: places in merged order, and the block of each (equal first rounds words, for suffixes with so many)."""
    before = np.concatenate([s.before for s in shards])
    place = np.concatenate([s.place for s in shards])
    kind = np.uint16 if len(shards) < 1 << 16 else np.int64
    mix = np.repeat(np.arange(len(shards)), [len(s.before) for s in shards]).astype(kind)
    ends = np.repeat(np.arange(len(shards)), [s.terminators for s in shards]).astype(kind)
    entry = np.arange(len(before))  # the entry of the concatenated transforms that stands at each place of the interleave
    block = np.zeros(len(before), np.int64)
    for _ in range(rounds):
        word = before[entry]
        open_ = np.flatnonzero(word >= 0)
        low = (word[open_] & 0xFFFF).astype(np.uint16)
        turn = open_[np.argsort(low, kind="stable")]
        high = (word[turn] >> 16).astype(np.uint16)
        if high.any():
            turn = turn[np.argsort(high, kind="stable")]
        mix = np.concatenate([ends, mix[turn]])
        new = np.ones(len(turn), bool)
        new[1:] = (word[turn][1:] != word[turn][:-1]) | (block[turn][1:] != block[turn][:-1])
        block = np.concatenate([np.zeros(len(ends), np.int64), np.cumsum(new)])
        # each shard's entries come in its own order
        entry = np.empty(len(mix), np.int64)
        entry[np.argsort(mix, kind="stable")] = np.arange(len(mix))
    return place[entry], block
