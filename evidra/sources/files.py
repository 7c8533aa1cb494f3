"""Source files, table snapshots and artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.operators.documents import from_files

#: Readers by suffix of a file's name. PDF and OCR need libraries that aren't here; a plug-in adds a reader: a
#: function from binary files (path, length, content) to path, sha256, size, pages.
READERS = {".txt": from_files, ".md": from_files}


def read_sources(spark: SparkSession, folder: str, registry: DataFrame) -> DataFrame:
    """Documents of the registry with their files' hash, size and pages; ``pages`` is null where the file is missing.

    A file whose suffix has no reader is an error.
    """
    suffixes = [r[0] for r in registry.select(F.lower(F.regexp_extract("local_file", "(\\.[^./]+)$", 1))).distinct().collect()]
    if unknown := sorted(set(suffixes) - set(READERS)):
        raise ValueError(f"no reader for {unknown}")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "content")
    read = None
    for s in suffixes:
        part = READERS[s](files.where(F.lower("path").endswith(s)))
        read = part if read is None else read.unionByName(part)
    base = F.regexp_replace("path", "^file:/+", "/")
    root = folder.rstrip("/").removeprefix("file://")
    named = read.withColumn("local_file", F.when(base.startswith(root + "/"), F.substring(base, F.lit(len(root) + 2), F.length(base))).otherwise(base))
    own = registry.select(F.col("id").alias("document_id"), F.col("title_original").alias("title"), F.col("original_language").alias("language"), "local_file")
    tables = F.array().cast("array<struct<page:int,rows:array<array<string>>>>")
    return own.join(named.drop("path"), "local_file", "left").withColumn("tables", tables)


def write_artifacts(chunks: DataFrame, documents: DataFrame, path: str) -> None:
    """pages, chunks and manifests as JSON, partitioned by document and the beginning of its hash.

    Only the versions that are given are written; those of other documents and of earlier versions stay.
    """
    short = F.substring("sha256", 1, 12).alias("sha12")
    write = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id", "sha12").json(f"{path}/{name}")
    write(documents.where("pages is not null").select("document_id", short, F.inline("pages")), "pages")
    write(chunks.select("document_id", short, *[c for c in chunks.columns if c not in ("document_id", "sha256", "warnings")]), "chunks")
    write(chunks.groupBy("document_id", "sha256").agg(F.count(F.lit(1)).alias("chunks"), F.first("warnings").alias("warnings")).select("document_id", short, "sha256", "chunks", "warnings"), "manifest")


class Store:
    """Snapshots of the tables in a folder. A new snapshot is written beside the old one, and then becomes the latest."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _snapshots(self, name: str) -> list[int]:
        where = self._path(f"{self.root}/{name}")
        if not self._fs.exists(where):
            return []
        # Only what Spark has committed counts.
        found = [s.getPath() for s in self._fs.listStatus(where)]
        return sorted(int(p.getName()) for p in found if p.getName().isdigit() and self._fs.exists(self._path(p, "_SUCCESS")))

    def read(self, name: str, schema: str | None = None) -> DataFrame:
        found = self._snapshots(name)
        if not found:
            if schema is None:
                raise FileNotFoundError(f"{self.root}/{name}")
            return self.spark.createDataFrame([], schema)
        return self.spark.read.parquet(f"{self.root}/{name}/{found[-1]}")

    def write(self, name: str, df: DataFrame, partition: list[str] | None = None) -> DataFrame:
        n = (self._snapshots(name) or [0])[-1] + 1
        df.write.mode("overwrite").partitionBy(*(partition or [])).parquet(f"{self.root}/{name}/{n}")
        return self.read(name)
