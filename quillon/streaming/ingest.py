"""Ingestion and statistics of streams: an extension, in which a batch operator sees each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillon.operators import chunking
from quillon.sources import store as S


def ingest_stream(documents: DataFrame, store: S.Store, checkpoint: str, most: int = 512, overlap: int = 50) -> StreamingQuery:
    """Chunk and upsert the documents (doc_id, content, source_path, doc_type) of a stream; unchanged ones are
    skipped, so a batch that runs again changes nothing. Ends when what is there has been read."""

    def batch(df: DataFrame, _: int) -> None:
        hashed = df.withColumn("content_hash", F.md5(F.col("content").cast("binary")))
        new = S.unchanged_removed(hashed, store.table("documents")).dropDuplicates(["doc_id"]).persist()
        store.upsert_chunks(chunking.chunk_documents(new, most, overlap))
        store.upsert_documents(new)
        new.unpersist()

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def log_windows(logs: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, queries, avg_total_time_ms) of each window of a stream of logs."""
    return logs.withWatermark("timestamp", late).groupBy(F.window("timestamp", size)).agg(F.count("*").alias("queries"), F.avg("total_time_ms").alias("avg_total_time_ms")).select(F.col("window.start").alias("start"), "queries", "avg_total_time_ms")


def text_stream(spark: SparkSession, path: str) -> DataFrame:
    """Documents of text files as they appear in a folder."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.txt").load(path)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return files.select(F.concat_ws("_", stem, F.substring(F.md5("content"), 1, 8)).alias("doc_id"), F.decode("content", "UTF-8").alias("content"), F.col("path").alias("source_path"), F.lit("txt").alias("doc_type"))
