"""What the operators of this subpackage share: scratch tables, vocabulary files, safe column names."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is ``spark.checkpoint.dir`` of the session. A folder of our own is set only where that is unset and all runs on
    one machine, as in tests; on a cluster executors couldn't read a machine's folder, so that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    set_before = spark.sparkContext.getCheckpointDir()
    if set_before is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evidra-"))
        set_before = spark.sparkContext.getCheckpointDir()
    return set_before.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder, which cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/evidra-{name}-{uuid.uuid4().hex}"
        self.n = 0

    def keep(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df once and return the written table."""
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        self.last = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, path: str | None = None) -> None:
        """Delete one table, or all."""
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path or self.root)
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def unused(name: str, columns: list[str]) -> str:
    """name, or else name with so many underscores that no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def vocabulary(name_or_path: str) -> str:
    """The place of a public vocabulary file: a path as it is, or else a name that public_tokenizers knows."""
    if "/" in name_or_path:
        return name_or_path
    import public_tokenizers

    return public_tokenizers.path(name_or_path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))


#: Bytes of text that a Python worker works on at once.
PART_BYTES = 500_000
#: Bytes of a batch of rows between Spark and Python, unless the session sets a limit; one row may be larger.
BATCH_BYTES = "4m"
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """``df.mapInArrow(run, schema)`` with batches bounded in bytes.

    By rows alone a batch of long texts has any size, and both the executor's memory outside its heap and the Python worker hold it.
    The limit is a setting of the session, as a plan reads it when it is run; one that the session has is left as it is.
    """
    if df.sparkSession.conf.get(_LIMIT, None) is None:
        df.sparkSession.conf.set(_LIMIT, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def text_parts(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = PART_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of batches with their texts, null ones as empty: so many bytes of text at once, or one text.

    A batch has thousands of rows, and its texts as Python strings would stay in the worker's memory, which outlives
    the task; what was used is given back to the system at the end.
    """
    for batch in batches:
        at = batch.schema.names.index(column)
        size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, a = np.cumsum(size), 0
        while a < len(size):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + limit, side="right")))
            part = batch.slice(a, b - a)
            yield part, [t or "" for t in part.column(at).to_pylist()]
            a = b
    give_back()


def give_back() -> None:
    """Return freed memory of this process to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library
