"""Files that arrive in a folder go through the same versioned tables, batch by batch.

An ingest is idempotent by content hash, so a batch that is delivered twice changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from evidra.operators.corpus import Corpus

BINARY = "path string, modificationTime timestamp, length long, content binary"


def watch(corpus: Corpus, registry: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Ingest whenever files arrive; with once, what is there now and no more."""
    files = corpus.spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", True).load(folder).select("path", "length")

    def arrived(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            corpus.ingest(registry, folder).write.format("noop").mode("overwrite").save()

    writer = files.writeStream.foreachBatch(arrived).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
