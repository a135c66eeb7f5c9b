"""Incremental import as a stream: each micro-batch adds the contents that the catalog lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..sources.documents import import_sources


def import_stream(documents: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends distinct new sources (by content hash) of a document stream to the Parquet table at ``target``.

    A batch that is run again after a failure finds its own hashes and adds nothing.
    """

    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = import_sources(batch).select("source_id", "sha256", "doc_id", "title", "text")
        where = spark._jvm.org.apache.hadoop.fs.Path(target)
        if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            fresh = fresh.join(spark.read.parquet(target).select("sha256"), "sha256", "left_anti").select(fresh.columns)
        fresh.write.mode("append").parquet(target)

    return documents.filter(F.col("text").isNotNull()).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
