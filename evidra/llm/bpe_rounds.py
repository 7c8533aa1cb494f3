"""Byte-pair merging of many words at once, in rounds over flat numpy arrays.

A word is a run of symbols; a merge table gives each mergeable pair of symbols a
rank and the symbol it becomes. The sequential rule is: take the pair of least
rank in the word, the leftmost among equals, merge it, and go on until no pair is
left. One round here does that in every unfinished word together: a segmented
minimum gives each word its least rank, and every occurrence of it merges, from
the left and without overlaps, as long as no merge makes a pair that would have
had to go first. After each round the arrays are compacted and finished words
leave them.
"""

from __future__ import annotations

import numpy as np

NEVER = np.int32(np.iinfo(np.int32).max)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class MergeTable:
    """Open-addressed hash table from a pair of symbols to (rank, merged symbol)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(max(len(left), 1) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.rank = np.full(1 << bits, NEVER, np.int32)
        self.merged = np.zeros(1 << bits, np.int32)
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(key)
        todo = np.arange(len(key))
        while len(todo):
            free = todo[self.keys[slot[todo]] == -1]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            at = slot[put]
            self.keys[at], self.rank[at], self.merged[at] = key[put], rank[put], merged[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * _MIX) >> self.shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER where the pair doesn't merge) and merged symbol of each pair."""
        key = (left.astype(np.int64) << 32) | right.astype(np.int64)
        slot = self._slot(key)
        held = self.keys[slot]
        off = np.flatnonzero((held != key) & (held != -1))
        while len(off):
            slot[off] = (slot[off] + 1) & self.mask
            held = self.keys[slot[off]]
            off = off[(held != key[off]) & (held != -1)]
        hit = self.keys[slot] == key
        return np.where(hit, self.rank[slot], NEVER), self.merged[slot]


def merge_words(symbols: np.ndarray, lengths: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Merge until no pair is left. Returns the symbols of all words in order, and each word's count.

    symbols: of all words, one word after the other; lengths: symbols of each word, none 0.
    """
    n_words = len(lengths)
    if n_words == 0:
        return symbols.astype(np.int32), lengths.astype(np.int64)
    word = np.repeat(np.arange(n_words, dtype=np.int64), lengths)
    sym = symbols.astype(np.int32)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    rank, made = _pairs(sym, word, table)
    while len(sym):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[starts, len(sym)])
        least = np.minimum.reduceat(rank, starts)
        over = least == NEVER
        if over.any():
            gone = np.repeat(over, size)
            done.append((word[gone], sym[gone]))
            stay = ~gone
            sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
            if not len(sym):
                break
            size, least = size[~over], least[~over]
        at = np.flatnonzero(rank == np.repeat(least, size))
        # Overlapping occurrences: every second one of a run, from its left end.
        fresh = np.r_[True, np.diff(at) != 1]
        run_start = np.maximum.accumulate(np.where(fresh, at, 0))
        at = at[(at - run_start) % 2 == 0]
        at = at[_before_a_better_pair(at, sym, word, rank, made, table)]
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        new_at = at - np.arange(len(at))
        sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
        touched = np.zeros(len(sym), bool)
        touched[new_at] = True
        touched[new_at[new_at > 0] - 1] = True
        redo = np.flatnonzero(touched)
        rank[redo], made[redo] = _pairs_at(redo, sym, word, table)
    words = np.concatenate([w for w, _ in done])
    out = np.concatenate([s for _, s in done])
    order = np.argsort(words, kind="stable")
    return out[order], np.bincount(words, minlength=n_words)


def _pairs(sym, word, table):
    rank, made = np.full(len(sym), NEVER, np.int32), np.zeros(len(sym), np.int32)
    if len(sym) > 1:
        r, m = table.find(sym[:-1], sym[1:])
        rank[:-1], made[:-1] = np.where(word[:-1] == word[1:], r, NEVER), m
    return rank, made


def _pairs_at(i, sym, word, table):
    """Rank and merged symbol of the pairs that begin at positions i."""
    j = np.minimum(i + 1, len(sym) - 1)
    r, m = table.find(sym[i], sym[j])
    return np.where((j > i) & (word[i] == word[j]), r, NEVER), m


def _before_a_better_pair(at, sym, word, rank, made, table):
    """Which of the merges at positions at may go in one round.

    In each word those up to and including the first one that makes a pair of the same or a lesser rank, with
    the symbol to its right or with what then stands to its left: the next merge must wait for that pair.
    """
    several = np.r_[False, word[at[1:]] == word[at[:-1]]]
    if not several.any():
        return np.ones(len(at), bool)
    mine, m = rank[at], made[at]
    right = np.minimum(at + 2, len(sym) - 1)
    r, _ = table.find(m, sym[right])
    bad = (at + 2 < len(sym)) & (word[right] == word[at]) & (r <= mine)
    left = np.maximum(at - 1, 0)
    before = sym[left].copy()
    touching = np.flatnonzero(np.r_[False, np.diff(at) == 2] & several)
    before[touching] = m[touching - 1]
    l, _ = table.find(before, m)
    bad |= (at > 0) & (word[left] == word[at]) & (l <= mine)
    seen = np.cumsum(bad) - bad
    first = np.maximum.accumulate(np.where(several, 0, np.arange(len(at))))
    return seen == seen[first]


def gather(table: np.ndarray, start: np.ndarray, size: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of ids one after the other, as bytes, and the size of each.

    table: all strings in one byte array; start, size: of each string in it.
    """
    n = size[ids]
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.uint8), n
    end = np.cumsum(n)
    at = np.arange(total, dtype=np.int64) + np.repeat(start[ids] - (end - n), n)
    return table[at], n


class WordCache:
    """Codes of words seen before, at most so many and none of very long words, in one or two generations.

    Once the younger one is full it becomes the older one, and the older one goes; words looked up again
    move to the younger one, so frequent words stay. With one generation the cache begins anew once it is full.
    """

    def __init__(self, code, limit: int, generations: int = 2, longest: int = 64):
        self.longest = longest
        self.code, self.most, self.keep = code, limit // generations, generations > 1
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, words: list[str]) -> list[bytes]:
        """The codes of words as little-endian int32 bytes; code(list of distinct words) gives those not seen."""
        young, old = self.young, self.old
        new = [w for w in set(words) if w not in young]
        if new and len(young) + len(new) > self.most:
            self.old, self.young = old, young = (young if self.keep else {}), {}
            new = list(set(words))
        again = [w for w in new if w in old]
        young.update(zip(again, map(old.__getitem__, again)))
        if len(again) < len(new):
            fresh = [w for w in new if w not in old]
            young.update(zip(fresh, self.code(fresh)))
        found = list(map(young.__getitem__, words))
        for w in new:
            if len(w) > self.longest:
                del young[w]
        return found


def split_bytes(flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """int32 codes of each word as bytes."""
    raw, ends = flat.astype("<i4").tobytes(), (np.cumsum(counts) * 4).tolist()
    return [raw[a:b] for a, b in zip([0, *ends[:-1]], ends)]
