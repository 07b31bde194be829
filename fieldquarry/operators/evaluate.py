"""Extraction accuracy against ground truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CORRECT_FROM = 0.9


def compare_fields(truth: DataFrame, parsed: DataFrame, similarity, keys: tuple[str, ...] = ("doc_id", "field")) -> DataFrame:
    """Each ground-truth field with the parsed value, its similarity and whether that counts as correct.

    truth and parsed: keys and value. A missing parsed value is the empty string.
    """
    p = parsed.withColumnRenamed("value", "parsed")
    both = truth.withColumnRenamed("value", "ground_truth").join(p, list(keys), "left").withColumn("parsed", F.coalesce("parsed", F.lit("")))
    a, b = F.lower(F.trim(F.col("ground_truth"))), F.lower(F.trim(F.col("parsed")))
    return both.withColumn("similarity", similarity(a, b)).withColumn("correct", F.col("similarity") >= CORRECT_FROM)


def accuracy(compared: DataFrame, key: str = "doc_id") -> DataFrame:
    """Totals per document, the percentage to two places (0 without fields)."""
    g = compared.groupBy(key).agg(F.count("*").alias("total_fields"), F.sum(F.col("correct").cast("long")).alias("correct"))
    return g.withColumns({"incorrect": F.col("total_fields") - F.col("correct"), "accuracy": percent(F.col("correct"), F.col("total_fields"))})


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round((part * 100).cast("decimal(20,6)") / whole, 2).cast("double"))


def details(compared: DataFrame, key: str = "doc_id") -> DataFrame:
    """map field -> struct<ground_truth, parsed, correct, similarity> of each document."""
    return compared.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("field", F.struct("ground_truth", "parsed", "correct", "similarity")))).alias("details"))
