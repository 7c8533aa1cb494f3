"""SentencePiece encoding and decoding by vectorised merge rounds.

The model file is only read for its pieces and scores. Encoding gives the ids that the sentencepiece
library gives for a BPE model with byte fallback, an identity normaliser, a dummy prefix and no removal of
extra white space; another kind of model is refused. No piece has a space mark after another character, so
the runs that begin with space marks merge independently, and each distinct run of a batch is merged once.

Defined cases: a null or empty text has no piece (the end id alone, if one is asked for) and decodes to the
empty text; the mark U+2581 in a text is a space, as in the library; repeated rows and ties need no rule, for
each row stands alone; an empty table gives an empty table; other columns are passed through untouched by
``encode`` and ``decode``, and a column that has the name of the new one is replaced.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidra.llm.bpe_rounds import MergeTable, WordCache, gather, merge_words, split_bytes
from evidra.llm.shared import map_batches, text_parts, vocabulary

MARK = "▁"
_RUN = re.compile(" +[^ ]*")
#: Characters of text that are worked on at once.
BATCH_CHARS = 4_000_000


#: Words whose codes a worker keeps; some 250 bytes each.
CACHED = 150_000


class Codec:
    """A BPE piece model as numpy tables."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        norm = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback:
            raise ValueError("a BPE model with byte fallback is needed")
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces:
            raise ValueError("an identity normaliser with a dummy prefix is needed")
        pieces = [p.piece for p in proto.pieces]
        self.n_pieces = len(pieces)
        kind = [p.type for p in proto.pieces]
        if any(k in (4, 5) for k in kind):
            raise ValueError("user-defined and unused pieces aren't supported")
        normal = {p: i for i, p in enumerate(pieces) if kind[i] == 1}
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("pieces must have space marks at their beginning only")
        self.end_id = next((i for i, p in enumerate(pieces) if p == "</s>"), None)
        # Symbols: the pieces, then characters that occur in pieces without being one.
        symbol = dict(normal)
        for p in normal:
            for c in p:
                symbol.setdefault(c, self.n_pieces + len(symbol))
        self.char = {c: i for c, i in symbol.items() if len(c) == 1}
        scores = sorted({proto.pieces[i].score for i in normal.values()}, reverse=True)
        rank_of = {s: k for k, s in enumerate(scores)}
        rows = [(symbol[p[:k]], symbol[p[k:]], rank_of[proto.pieces[i].score], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        self.table = MergeTable(*(np.array(x, np.int64) for x in zip(*rows)))
        self.byte_id = np.zeros(256, np.int32)
        text = []
        self.is_byte = np.zeros(self.n_pieces, bool)
        self.marked = np.array([k == 1 and p.startswith(MARK) for p, k in zip(pieces, kind)])
        for i, p in enumerate(pieces):
            if kind[i] == 6:
                b = int(p[3:5], 16)
                self.byte_id[b], self.is_byte[i] = i, True
                text.append(bytes([b]))
            elif kind[i] == 3:
                text.append(b"")
            elif kind[i] == 2:
                text.append(" ⁇ ".encode())
            else:
                text.append(p.replace(MARK, " ").encode())
        self.piece_size = np.array([len(x) for x in text], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)
        number = [b"%d " % i for i in range(self.n_pieces)]
        self.number_size = np.array([len(x) for x in number], np.int64)
        self.number_start = np.cumsum(self.number_size) - self.number_size
        self.number_bytes = np.frombuffer(b"".join(number), np.uint8)
        # Code points that are symbols, as a table for the usual ones and a dict for the rest.
        self.low = np.full(0x3000, -1, np.int32)
        for c, i in self.char.items():
            if ord(c) < 0x3000:
                self.low[ord(c)] = i
        self.cache = WordCache(self._code, CACHED)

    def _code(self, runs: list[str]) -> list[bytes]:
        """The ids of runs, each of which stands for itself with its spaces as marks."""
        text = "".join(runs).replace(" ", MARK)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        known = self.low[np.minimum(points, len(self.low) - 1)].astype(np.int64)
        for i in np.flatnonzero(points >= len(self.low)):
            known[i] = self.char.get(chr(points[i]), -1)
        # A character outside the vocabulary merges with nothing; it is kept as its negative code point.
        symbols = np.where(known < 0, -points - 1, known)
        flat, counts = merge_words(symbols, lengths, self.table)
        return split_bytes(*self._ids(flat, counts))

    def _ids(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols that aren't pieces become the ids of their UTF-8 bytes."""
        odd = np.flatnonzero((flat < 0) | (flat >= self.n_pieces))
        if not len(odd):
            return flat, counts
        letter = {i: c for c, i in self.char.items()}
        raw = [(chr(-int(s) - 1) if s < 0 else letter[int(s)]).encode() for s in flat[odd]]
        size = np.ones(len(flat), np.int64)
        size[odd] = [len(x) for x in raw]
        out = np.repeat(flat, size)
        where = np.zeros(len(flat), bool)
        where[odd] = True
        out[np.repeat(where, size)] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        word = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(word, weights=size, minlength=len(counts)).astype(np.int64)

    def encode(self, texts: list[str], end: bool = True) -> list[np.ndarray]:
        """The ids of each text."""
        runs, sizes = [], []
        for text in texts:
            if text:
                text = text.replace(MARK, " ")
                # Without two spaces in a row each word stands for itself with one space before it.
                found = [" " + w for w in text.split(" ")] if "  " not in text and text[0] != " " and text[-1] != " " else _RUN.findall(" " + text)
                runs += found
                sizes.append(len(found))
            else:
                sizes.append(0)
        codes = self.cache.look_up(runs)
        tail = np.array([self.end_id] if end else [], "<i4").tobytes()
        out, a = [], 0
        for n in sizes:
            out.append(np.frombuffer(b"".join(codes[a : a + n]) + tail, "<i4"))
            a += n
        return out

    def decode_bytes(self, ids: list[np.ndarray]) -> list[bytes]:
        """The UTF-8 text of each list of ids."""
        flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int64)
        if len(flat) and (flat.min() < 0 or flat.max() >= self.n_pieces):
            raise ValueError("an id outside the vocabulary")
        text, n = gather(self.piece_bytes, self.piece_start, self.piece_size, flat)
        ends = np.cumsum(np.r_[0, n])[np.cumsum([0, *map(len, ids)])].tolist()
        raw = text.tobytes()
        return [self._finish(raw[a:b], x) for a, b, x in zip(ends[:-1], ends[1:], ids)]

    def _finish(self, raw: bytes, ids: np.ndarray) -> bytes:
        """Without the dummy prefix; bytes that aren't UTF-8 become one U+FFFD each, run by run of byte pieces."""
        real = ids[self.piece_size[ids] > 0] if len(ids) else ids
        if len(real) and self.marked[real[0]]:
            raw = raw[1:]
        if not self.is_byte[ids].any() if len(ids) else True:
            return raw
        shown = np.flatnonzero(self.piece_size[ids] > 0)
        if shown[-1] - shown[0] + 1 == len(shown):  # else a control piece may stand between bytes
            try:
                raw.decode()
                return raw
            except UnicodeDecodeError:
                pass
        out, run, first = [], bytearray(), True
        for i in [*ids.tolist(), -1]:
            if i >= 0 and self.is_byte[i]:
                run += self.piece_bytes[self.piece_start[i] : self.piece_start[i] + 1].tobytes()
                continue
            out.append(_utf8(bytes(run)))
            first, run = first and not run, bytearray()
            if i >= 0:
                piece = self.piece_bytes[self.piece_start[i] : self.piece_start[i] + self.piece_size[i]].tobytes()
                if first and piece:
                    piece, first = piece[int(self.marked[i]) :], False
                out.append(piece)
        return b"".join(out)

    def numbers(self, ids: list[np.ndarray]) -> list[bytes]:
        """Decimal ids joined by one space, of each list."""
        flat = np.concatenate([*ids, np.zeros(0, np.int32)]).astype(np.int64)
        text, n = gather(self.number_bytes, self.number_start, self.number_size, flat)
        ends = np.cumsum(np.r_[0, n])[np.cumsum([0, *map(len, ids)])].tolist()
        raw = text.tobytes()
        return [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1], ends[1:])]


def _utf8(raw: bytes) -> bytes:
    """raw, with U+FFFD for each byte that isn't part of a whole UTF-8 character."""
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode().encode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�".encode())
            i += 1
    return b"".join(out)


_codecs: dict[bytes, Codec] = {}


def codec_of(model: bytes) -> Codec:
    """One codec for each model in each Python worker."""
    key = hashlib.sha256(model).digest()
    if key not in _codecs:
        _codecs[key] = Codec(model)
    return _codecs[key]


def read_model(path: str) -> bytes:
    """The model's bytes, read on the driver, so that executors need no file."""
    with open(vocabulary(path), "rb") as f:
        return f.read()


def slices(texts: list[str | None], limit: int = BATCH_CHARS) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that have at most so many characters together, or are one text."""
    start = held = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and held + n > limit:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(texts):
        yield start, len(texts)


def _with_column(df: DataFrame, name: str, kind: T.DataType, fill, column: str) -> DataFrame:
    """df with a column that fill makes of the values of another, batch by batch."""
    base = df.drop(name) if name != column else df
    schema = T.StructType([f for f in base.schema.fields if f.name != name] + [T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(batch.schema.names.index(column))
            rest = [i for i, n in enumerate(batch.schema.names) if n != name]
            arrays = [batch.column(i) for i in rest] + [fill(values)]
            yield pa.RecordBatch.from_arrays(arrays, names=[batch.schema.names[i] for i in rest] + [name])

    return map_batches(base, run, schema)


def encode(df: DataFrame, model: str, column: str = "text", out: str = "ids", end: bool = True) -> DataFrame:
    """df with the ids of the text column as an array of int; null texts count as empty."""
    held = df.sparkSession.sparkContext.broadcast(read_model(model))

    def fill(values: pa.Array) -> pa.Array:
        texts, codec, parts = values.to_pylist(), codec_of(held.value), []
        for a, b in slices(texts):
            parts += codec.encode([t or "" for t in texts[a:b]], end)
        ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
        flat = pa.array(np.concatenate([*parts, np.zeros(0, np.int32)]).astype(np.int32))
        return pa.ListArray.from_arrays(pa.array(ends), flat)

    return _with_column(df, out, T.ArrayType(T.IntegerType()), fill, column)


def decode(df: DataFrame, model: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the text that the ids of an array column stand for; a null array gives the empty text."""
    held = df.sparkSession.sparkContext.broadcast(read_model(model))

    def fill(values: pa.Array) -> pa.Array:
        codec = codec_of(held.value)
        lists = [np.array(x or [], np.int64) for x in values.to_pylist()]
        return pa.array([x.decode() for x in codec.decode_bytes(lists)], pa.string())

    return _with_column(df, out, T.StringType(), fill, column)


DIGEST = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def digests(docs: DataFrame, model: str) -> DataFrame:
    """Per document: count of ids, and SHA-256 of the ids and of the text that they decode to.

    Encoding and decoding meet within one pass, so neither ids nor decoded texts are ever shuffled or stored.
    """
    held = docs.sparkSession.sparkContext.broadcast(read_model(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(held.value)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part, texts in text_parts(batches):
            ids = codec.encode(texts)
            cols = list(zip(*((len(i), sha(n), sha(d)) for i, n, d in zip(ids, codec.numbers(ids), codec.decode_bytes(ids)))))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, DIGEST)
