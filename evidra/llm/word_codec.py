"""Ids of a word BPE vocabulary (byte-level, with word ends, lower-cased), by the same merge rounds.

Gives the ids that the tokenizers library gives with add_special_tokens=False. White-space chunks are cut into
words and merged once each; a text with characters above the Latin blocks, rare control characters or the string of a
special token goes to the library itself.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata

import numpy as np

from evidra.llm.bpe_rounds import MergeTable, WordCache, merge_words, split_bytes

#: Texts of these characters only are handled here: below U+0250, without separators U+001C to U+001F and without
#: letters whose lower case is longer or above that.
TOP = 0x250
_ODD = [chr(c) for c in range(TOP) if 0x1C <= c <= 0x1F or len(chr(c).lower()) != 1 or ord(chr(c).lower()) >= TOP]
_ELSE = re.compile(f"[{re.escape(''.join(_ODD))}{chr(TOP)}-\U0010ffff]")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else one from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordCodec:
    def __init__(self, source: str):
        held = json.loads(source)
        model, split = held["model"], held["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in held["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or model["end_of_word_suffix"] != "</w>" or split["pattern"]["Regex"] != _PATTERN or kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("a lower-cased byte-level BPE vocabulary with word ends is needed")
        self.source, self._library = source, None
        self.special = [t["content"] for t in held["added_tokens"]]
        vocab, letters = model["vocab"], byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[letters[b] + "</w>"] for b in range(256)], np.int64)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        rows = [(vocab[a], vocab[b], r, vocab[a + b]) for r, (a, b) in enumerate(merges)]
        self.table = MergeTable(*(np.array(x, np.int64) for x in zip(*rows)))
        # Classes of characters: 0 white space, 1 letter, 2 number, 3 other.
        kind = [unicodedata.category(chr(c))[0] for c in range(TOP)]
        self.kind = np.array([0 if chr(c).isspace() else 1 if k == "L" else 2 if k == "N" else 3 for c, k in enumerate(kind)], np.int8)
        self.cache = WordCache(self._code, 1_000_000, 1)

    def _words(self, points: np.ndarray) -> np.ndarray:
        """For each character the mark of a word's first one; white space isn't in words."""
        kind = self.kind[points]
        n = len(points)
        before = np.r_[np.int8(0), kind[:-1]]
        first = (kind != before) | (kind == 2)
        # An apostrophe that begins a run of other characters takes s, t, m, d, re, ve or ll with it.
        at = np.flatnonzero((points == ord("'")) & (before != 3))
        if len(at):
            look = lambda k: np.where(at + k < n, points[np.minimum(at + k, n - 1)], 0)
            a, b = look(1), look(2)
            one = np.isin(a, [ord(c) for c in "stmd"])
            two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            first[at[one] + 1] = first[at[two] + 1] = False
            for end in (at[one] + 2, at[two] + 3):
                end = end[end < n]
                first[end] = kind[end] != 0
        return first & (kind != 0)

    def _code(self, chunks: list[str]) -> list[bytes]:
        points = np.frombuffer("\n".join(chunks).encode("utf-32-le"), np.uint32).astype(np.int64)
        first, inside = self._words(points), self.kind[points] != 0
        word = np.cumsum(first) - 1
        chunk = np.cumsum(points == 10)
        raw = np.frombuffer("".join(chunks).encode(), np.uint8)
        size = np.where(points < 0x80, 1, 2)[inside]
        of = np.repeat(word[inside], size)
        ends = np.r_[of[1:] != of[:-1], True]
        symbols = np.where(ends, self.last[raw], self.inner[raw])
        flat, counts = merge_words(symbols, np.bincount(of), self.table)
        own = np.bincount(chunk[np.flatnonzero(first)], weights=counts, minlength=len(chunks)).astype(np.int64)
        return split_bytes(flat, own)

    def _plain(self, text: str) -> np.ndarray:
        """By the library."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.source)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, np.int32)

    def encode(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """The ids of each text, with an id at the end if one is given."""
        chunks, sizes, out = [], [], []
        for text in texts:
            if _ELSE.search(text) or any(s in text for s in self.special):
                sizes.append(-1)
            else:
                found = text.lower().split()
                chunks += found
                sizes.append(len(found))
        codes, a = self.cache.look_up(chunks), 0
        tail = np.array([] if end is None else [end], "<i4")
        for text, n in zip(texts, sizes):
            if n < 0:
                out.append(np.r_[self._plain(text), tail].astype("<i4"))
            else:
                out.append(np.frombuffer(b"".join(codes[a : a + n]) + tail.tobytes(), "<i4"))
                a += n
        return out


_codecs: dict[bytes, WordCodec] = {}


def word_codec(source: str) -> WordCodec:
    """One codec for each vocabulary in each Python worker."""
    key = hashlib.sha256(source.encode()).digest()
    if key not in _codecs:
        _codecs[key] = WordCodec(source)
    return _codecs[key]
