"""Structured Streaming forms: duplicates within a watermark, running counters, keyed upserts of micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.shared import shared_dir


def file_stream(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """New files of a folder or a glob pattern; a single file is a pattern that it alone matches."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def dedup_stream(rows: DataFrame, keys: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first row of each key; state older than the watermark is dropped."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def counter_stream(rows: DataFrame, key: str, **sums: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))


def windowed_counts(rows: DataFrame, key: str, ts: str = "ts", size: str = "1 day", late: str = "1 day") -> DataFrame:
    w = F.window(ts, size)
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def run_once(stream: DataFrame, mode: str = "append", root: str | None = None) -> DataFrame:
    """All that is there now through the stream and out as a table: checkpoint and result are in the shared folder.

    In complete mode each micro-batch's result takes the place of the one before.  root: the folder of an earlier run of
    the same stream, which this one goes on from."""
    spark = stream.sparkSession
    root = root or f"{shared_dir(spark)}/lodestar-stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{root}/rows").start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(f"{root}/rows")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/rows")
