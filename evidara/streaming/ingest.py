"""Idempotent ingestion, serial chain append and windowed counts as Structured Streaming jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from evidara.streaming.keyed import chained, use_rocksdb


def first_arrivals(stream: DataFrame, key: str, ts: str, lateness: str) -> DataFrame:
    """Each key once within the watermark: a copy that arrives again is dropped."""
    return stream.withWatermark(ts, lateness).dropDuplicatesWithinWatermark([key])


def ingest(stream: DataFrame, path: str, checkpoint: str, key: str = "sha256") -> StreamingQuery:
    """Appends rows whose key is not stored yet; a batch that runs again after a failure adds nothing twice."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates([key])
        try:
            known = spark.read.parquet(path).select(key)
        except Exception as error:  # the first batch has nothing to compare with
            if "PATH_NOT_FOUND" not in str(error):
                raise
            known = None
        if known is not None:
            fresh = fresh.join(known, key, "left_anti")
        fresh.withColumn("index_version", F.lit(number)).write.mode("append").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_chain(stream: DataFrame, path: str, checkpoint: str, seq: str = "seq", content: str = "content", chain: str | None = None) -> StreamingQuery:
    """Appends events to hash chains in a folder of Parquet files, each chain linked from the head that its state keeps.

    With ``chain``, a column that names each event's chain, that column is stored too.
    """
    use_rocksdb(stream.sparkSession)
    linked = chained(stream, seq, content, chain).filter("status = 'LINKED'")
    named = [F.col("chain").alias(chain)] if chain else []
    rows = linked.select(*named, F.col("seq").alias(seq), F.col("content").alias(content), "previous_hash", "row_hash")
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(stream: DataFrame, ts: str, kind: str, width: str, lateness: str) -> DataFrame:
    """Events by kind in tumbling windows of event time; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark(ts, lateness).groupBy(F.window(ts, width), kind).agg(F.count(F.lit(1)).alias("n"))
