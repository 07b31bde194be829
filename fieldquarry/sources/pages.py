"""Document sources: page files, page text with a fallback, OCR results, ground truth."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MIN_TEXT = 20


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def pages(spark: SparkSession, path: str, decode: Callable[[bytes], list[str]], glob: str = "*") -> DataFrame:
    """(path, page, text) of binary files; decode turns a file into its pages' texts.

    decode is the only part outside the JVM. A file that it cannot read gives one row with the error.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += [(p, i + 1, t, None) for i, t in enumerate(decode(bytes(content)))]
                except Exception as error:
                    rows.append((p, 0, None, f"{type(error).__name__}: {error}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "page", "text", "error"])

    return files(spark, path, glob).select("path", "content").mapInPandas(run, "path string, page int, text string, error string")


def form_feed_pages(content: bytes) -> list[str]:
    return content.decode("utf-8").split("\f")


def has_text(text: Column) -> Column:
    """Whether a page's text layer is enough to go without OCR."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), "[\n \t]", "")) >= MIN_TEXT


def with_fallback(page_rows: DataFrame, ocr: DataFrame, force: bool = False) -> DataFrame:
    """Page text, or where there is too little of it the OCR text of (path, page)."""
    o = ocr.withColumnRenamed("text", "ocr_text")
    both = page_rows.join(o, ["path", "page"], "left")
    use = F.lit(force) | ~has_text(F.col("text"))
    return both.withColumn("from_ocr", use).withColumn("text", F.when(use, F.coalesce("ocr_text", F.lit(""))).otherwise(F.col("text"))).drop("ocr_text")


def whole_text(page_rows: DataFrame, key: str = "path") -> DataFrame:
    """Pages joined in order, each followed by a line break."""
    pages_ = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return page_rows.groupBy(key).agg(pages_.alias("p")).select(key, F.concat(F.array_join(F.transform("p", lambda x: x["text"]), "\n"), F.lit("\n")).alias("text"))


def first_pages(page_rows: DataFrame) -> DataFrame:
    """First pages with ten characters or more."""
    return page_rows.where((F.col("page") == 1) & (F.length(F.trim("text")) >= 10))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """(doc, field, value) of {"fields": {...}} files named <doc>_ground_truth.json; none gives no rows."""
    raw = spark.read.text(path, wholetext=True, pathGlobFilter="*_ground_truth.json").withColumn("doc", F.regexp_extract(F.input_file_name(), r"([^/]+)_ground_truth\.json", 1))
    fields = F.from_json("value", "struct<fields:map<string,string>>")["fields"]
    return raw.select("doc", F.explode(fields).alias("field", "value"))
