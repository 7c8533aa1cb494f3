"""Simple-8b word-aligned coding of unsigned integers, with escapes and per-block offsets.

Each 64-bit word has a selector in its upper 4 bits, which tells how many values of how many bits its lower
60 bits hold, the first value lowest. Selector 15 is an escape: the next word holds one value of up to 64 bits. Values are
cut into blocks of equal counts; a block begins with a word of its own, and a table of word offsets lets every
block be found, so blocks are packed and unpacked side by side.

Layout, little-endian: magic "EVS8", block size (u32), count of values (u64), an offset (u32) in words for each block and one
for the end, zero bytes up to a multiple of 8, then the words.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC = b"EVS8"
BLOCK = 1024
#: Values that are packed at once: enough to share each step's cost, few enough to stay near the processor.
SLAB = 1 << 18
#: For each selector the values of a word and their bits; selector 0 is not used.
LAYOUT = [(0, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15


def _bits(values: np.ndarray) -> np.ndarray:
    """The least width of the layout, as bits, that holds each value; 61 where none does."""
    out, most = np.ones(len(values), np.int8), int(values.max())
    if most < 1 << 32:
        values = values.astype(np.uint32)
    for b in (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60):
        if most >= 1 << b:
            out[values >= values.dtype.type(1 << b)] = b + 1
    return out


def _selectors(values: np.ndarray, blocks: int, block: int) -> np.ndarray:
    """The selector of a word that began at each value: the one with most values, or with all that are left in the block."""
    n, longest = len(values), LAYOUT[1][0]
    bits = np.zeros((blocks, block), np.int8)
    bits.reshape(-1)[:n] = _bits(values)
    out, widest = np.zeros((blocks, block), np.int8), int(bits.max())
    # How many values before each place of a block are too wide; places behind the block are filled up with nothing.
    before = np.zeros((blocks, block + 1 + longest), np.int16 if block < 1 << 15 else np.int64)
    for s in range(len(LAYOUT) - 1, 0, -1):
        count, width = LAYOUT[s]
        if width >= widest:
            out[:] = s
            continue
        np.cumsum(bits > width, axis=1, dtype=before.dtype, out=before[:, 1 : block + 1])
        before[:, block + 1 :] = before[:, block : block + 1]
        np.copyto(out, np.int8(s), where=before[:, count : count + block] == before[:, :block])
    out[bits > 60] = ESCAPE
    return out.reshape(-1)[:n]


def pack(values: np.ndarray, block: int = BLOCK) -> bytes:
    values = np.ascontiguousarray(values).astype(np.uint64)
    n, slab = len(values), max(1, SLAB // block) * block
    if not n:
        return MAGIC + struct.pack("<IQI", block, 0, 0) + bytes(-20 % 8)
    offsets, parts, before = [], [], 0
    for a in range(0, n, slab):
        starts, words = _pack_blocks(values[a : a + slab], block)
        offsets.append(starts + before)
        parts.append(words)
        before += len(words)
    head = MAGIC + struct.pack("<IQ", block, n) + np.concatenate([*offsets, [before]]).astype("<u4").tobytes()
    return head + bytes(-len(head) % 8) + np.concatenate(parts).astype("<u8").tobytes()


def _pack_blocks(values: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of whole blocks (the last one may be shorter), and where each block begins in them."""
    n = len(values)
    blocks = -(-n // block)
    end = np.minimum((np.arange(n) // block + 1) * block, n)
    select = _selectors(values, blocks, block)
    count = np.array([c for c, _ in LAYOUT] + [1])
    nexts = np.minimum(np.arange(n) + count[select], end)
    # All blocks go on from word to word side by side.
    here = np.arange(blocks) * block
    stops = np.minimum(here + block, n)
    firsts = []
    while len(here):
        firsts.append(here)
        here = nexts[here]
        open_ = here < stops
        here, stops = here[open_], stops[open_]
    first = np.sort(np.concatenate(firsts))
    s, size = select[first], nexts[first] - first
    escaped = s == ESCAPE
    width = np.array([b for _, b in LAYOUT] + [0])[s]
    place = np.cumsum(1 + escaped) - (1 + escaped)
    words = np.zeros(len(s) + int(escaped.sum()), np.uint64)
    words[place] = s.astype(np.uint64) << np.uint64(60)
    k = np.arange(n) - np.repeat(first, size)
    shifted = np.where(np.repeat(escaped, size), np.uint64(0), values << (k * np.repeat(width, size)).astype(np.uint64))
    words[place] |= np.bitwise_or.reduceat(shifted, first)
    words[place[escaped] + 1] = values[first[escaped]]
    starts = place[np.searchsorted(first, np.arange(blocks) * block)]
    return starts, words


def header(data: bytes) -> tuple[int, np.ndarray, int]:
    """Count of values, word offsets of the blocks and the end, and the byte where the words begin."""
    if data[:4] != MAGIC:
        raise ValueError("not a Simple-8b file")
    block, n = struct.unpack_from("<IQ", data, 4)
    blocks = -(-n // block)
    at = 16 + 4 * (blocks + 1)
    return n, np.frombuffer(data, "<u4", blocks + 1, 16), at + -at % 8


def unpack(data: bytes, first: int = 0, last: int | None = None) -> np.ndarray:
    """The values of blocks first to last, exclusive; of all blocks if none are given."""
    n, offsets, at = header(data)
    if not n:
        return np.zeros(0, np.uint64)
    block = struct.unpack_from("<I", data, 4)[0]
    last = len(offsets) - 1 if last is None else last
    words = np.frombuffer(data, "<u8", int(offsets[last] - offsets[first]), at + 8 * int(offsets[first]))
    select = (words >> np.uint64(60)).astype(np.int64)
    # A word is the value of an escape if the one before is an escape that isn't a value itself.
    escape = select == ESCAPE
    value = np.zeros(len(words), bool)
    if escape.any():
        at_e = np.flatnonzero(escape)
        i = 0
        while i < len(at_e):
            if not value[at_e[i]]:
                value[at_e[i] + 1] = True
            i += 1
    lead = ~value
    start = np.flatnonzero(lead)
    s = select[start]
    size = np.array([c for c, _ in LAYOUT] + [1])[s]
    # The last word of a block holds no more than is left of it.
    in_block = np.searchsorted(offsets[first : last + 1] - offsets[first], start, side="right") - 1
    total = np.cumsum(size)
    head = np.r_[True, in_block[1:] != in_block[:-1]]
    begun = np.repeat((total - size)[head], np.diff(np.r_[np.flatnonzero(head), len(start)]))
    left = np.minimum(block, n - (first + in_block) * block) - (total - size - begun)
    size = np.minimum(size, left)
    end = np.cumsum(size)
    k = np.arange(int(end[-1])) - np.repeat(end - size, size)
    width = np.array([b for _, b in LAYOUT] + [0])[s]
    mask = np.array([(1 << b) - 1 for _, b in LAYOUT] + [0], np.uint64)[s]
    out = (np.repeat(words[start], size) >> (k * np.repeat(width, size)).astype(np.uint64)) & np.repeat(mask, size)
    esc = s == ESCAPE
    out[(end - size)[esc]] = words[start[esc] + 1]
    return out
