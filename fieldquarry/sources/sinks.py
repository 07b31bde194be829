"""Sinks: records as JSON by category and type, crop plans, path rewrites, event-stream lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldquarry.functions import text as T


def to_json(record: Column) -> Column:
    """JSON with null fields kept."""
    return F.to_json(record, {"ignoreNullFields": "false"})


def write_records(records: DataFrame, path: str, at: Column | None = None) -> None:
    """One JSON line for each record, in folders by category and document type; with `at`, a time, below a folder by type and time."""
    by = ["category", "document_type"]
    if at is not None:
        records, by = records.withColumn("folder", T.folder_name(F.col("document_type"), at)), [*by, "folder"]
    records.write.mode("append").option("ignoreNullFields", "false").partitionBy(*by).json(path)


def output_folder(doc_type: Column, category: Column, at: Column) -> Column:
    return F.concat_ws("/", F.coalesce(category, F.lit("unknown")), doc_type, T.folder_name(doc_type, at))


def move_images(images: DataFrame, folder: Column, path_col: str = "patch_foto") -> DataFrame:
    return images.withColumn(path_col, F.concat(folder, F.lit("/"), T.file_name(F.col(path_col))))


def event_line(token: Column) -> Column:
    return F.concat(F.lit("data: "), F.to_json(F.struct(token.alias("token"))), F.lit("\n\n"))
