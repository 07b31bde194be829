"""Incremental work: documents from a landing folder, windowed counts with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldquarry.operators.classify import document_type, with_envelope


def landing_documents(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """New text files of a folder as a stream of (path, text)."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", per_trigger).load(path)
    return raw.select("path", F.col("content").cast("string").alias("text"))


def classify_stream(docs: DataFrame, target: str, checkpoint: str):
    """Classify each micro-batch and append it as Parquet (a file name for each batch makes it repeatable)."""

    def write(batch: DataFrame, batch_id: int) -> None:
        with_envelope(batch.withColumn("document_type", document_type(F.col("text")))).drop("text").write.mode("overwrite").parquet(f"{target}/batch={batch_id}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events by type and tumbling window; rows later than the watermark are dropped in a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")
