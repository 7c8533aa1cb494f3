"""Token ids in binary files, coded with Simple-8b.

Documents are dealt out by ranges of doc_id, so that the files in order of their number hold them in ascending order;
each file is a partition's rows of a Parquet table in the shared folder (Spark's commit protocol takes care of lost
and repeated tasks), and each row holds some documents: their ids, how many token ids each has, how many the file holds
before the row, and the token ids of all of them in one Simple-8b string with per-block offsets.

Reading needs the count of token ids of each file only (a row a file) to tell where every document begins.

Defined cases: a null or empty text has the end id alone; documents without id come first; documents of equal id
come in the order of their texts; a very long text is one document of one row, never cut; an empty table gives
no file and an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidra.llm.shared import Scratch, map_batches, text_parts, vocabulary
from evidra.llm.simple8b import pack, unpack
from evidra.llm.word_codec import word_codec

#: Token ids of a row, about.
ROW_IDS = 1 << 20
END = 2
FILES = "file int, row int, before long, n_docs int, n_ids long, doc_ids binary, no_id binary, counts binary, ids binary"


def write(docs: DataFrame, vocabulary_file: str, path: str, end: int = END) -> None:
    """Write the ids of documents (doc_id, text) under path, in ascending order of doc_id."""
    with open(vocabulary(vocabulary_file)) as f:
        held = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, file = word_codec(held.value), TaskContext.get().partitionId()
        row = before = 0
        names: list[int | None] = []
        ids: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            nonlocal row, before
            flat = np.concatenate(ids).astype(np.uint64)
            out = {
                "file": [file], "row": [row], "before": [before], "n_docs": [len(ids)], "n_ids": [len(flat)],
                "doc_ids": [np.array([x or 0 for x in names], "<i8").tobytes()], "no_id": [np.packbits([x is None for x in names]).tobytes()],
                "counts": [pack(np.array([len(x) for x in ids], np.uint64))], "ids": [pack(flat)],
            }
            row, before = row + 1, before + len(flat)
            names.clear()
            ids.clear()
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

        held_ids = 0
        for part, texts in text_parts(batches, limit=1_500_000):
            for name, found in zip(part.column("doc_id").to_pylist(), codec.encode(texts, end)):
                names.append(name)
                ids.append(found)
                held_ids += len(found)
                if held_ids >= ROW_IDS:
                    yield flush()
                    held_ids = 0
        if ids:
            yield flush()

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = own.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    map_batches(dealt, run, FILES).write.parquet(path)


def read(spark, path: str) -> DataFrame:
    """The rows of the files with the position of each row's first token id over all files."""
    files = spark.read.schema(FILES).parquet(path)
    # A row a file: its token ids in all, summed up in order of the files.
    sums = files.groupBy("file").agg(F.sum("n_ids").alias("sum"))
    at = sums.select("file", F.coalesce(F.sum("sum").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"))
    return files.join(F.broadcast(at), "file").withColumn("start", F.col("at") + F.col("before")).drop("at")


def documents(rows: DataFrame) -> DataFrame:
    """Per document of the files read: doc_id, start, n_tokens and the CRC-32 of its ids as little-endian u32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, counts = unpack(r["ids"]).astype("<u4"), unpack(r["counts"]).astype(np.int64)
                raw, ends = ids.tobytes(), np.cumsum(counts)
                crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), counts.tolist())]
                none = np.unpackbits(np.frombuffer(r["no_id"], np.uint8), count=len(counts)).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["doc_ids"], "<i8"), mask=none), pa.array(r["start"] + ends - counts), pa.array(counts), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(rows.select("start", "doc_ids", "no_id", "counts", "ids"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def report(docs: DataFrame, vocabulary_file: str) -> DataFrame:
    """Write all documents, read the files back, and tell each document's place, count and checksum."""
    scratch = Scratch(docs.sparkSession, "tokens")
    path = f"{scratch.root}/files"
    write(docs, vocabulary_file, path)
    return documents(read(docs.sparkSession, path))
