"""Resumable ingest: new rows are added once, whatever is replayed.

A file stream feeds micro-batches; each batch drops what an earlier one of the same run brought
(watermarked state) and what the target table holds (anti join on the key), then appends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType


def stream_table(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest_once(rows: DataFrame, key: list[str], target: str, checkpoint: str, seen_at: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Starts an idempotent append of ``rows`` to the table at ``target``; rows later than ``late`` are not kept in state, yet still met by the anti join."""
    x = rows.withWatermark(seen_at, late).dropDuplicatesWithinWatermark(key) if seen_at else rows

    def add(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        # only a folder that is not there means a first batch; any error of reading stops the stream
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        have = spark.read.parquet(target).select(*key) if there else None
        fresh = batch.dropDuplicates(key)
        if have is not None:
            fresh = fresh.join(have, key, "left_anti")
        fresh.write.mode("append").parquet(target)

    return x.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events per type and window of time, for a stream or a table."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
