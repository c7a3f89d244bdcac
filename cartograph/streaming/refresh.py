"""Keeping an index fresh from a stream of changed files.

The reference operators have no stream; this runs the same incremental build on each
micro-batch of a file-source stream.  The batch is stateless: a batch that is run again
after a failure writes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.index import IndexStore, describe_folders, group_folders

FILES = "path string, folder string, file_name string, hash string, content string"


def refresh(store: IndexStore, batch: DataFrame, embedder) -> None:
    """Upsert the folders of ``batch``, which holds all files of the folders it names."""
    if batch.isEmpty():
        return
    files = batch.groupBy("folder", "path").agg(F.max(F.struct("hash", "file_name", "content")).alias("f")).select(
        "path", "folder", "f.file_name", "f.hash", "f.content"
    )
    store.upsert(describe_folders(group_folders(files), files, embedder))


def refresh_stream(spark: SparkSession, source: str, store: IndexStore, checkpoint: str, embedder) -> StreamingQuery:
    """Watch a folder of Parquet files of changed sources."""
    stream = spark.readStream.schema(FILES).parquet(source)
    write = stream.writeStream.foreachBatch(lambda batch, _: refresh(store, batch, embedder))
    return write.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
