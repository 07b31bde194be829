"""Corpus pipeline: quality, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; between
stages rows are written as Parquet and read again. All but the last return the columns they got.
The tokenizer's path can be set by the environment variable FIELDQUARRY_TOKENIZER.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldquarry.llm import mixing, neardup, packing, quality, secrets
from fieldquarry.llm.common import store


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learned from the labels, rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~quality.held_out(F.col("doc_id")))
    return quality.keep_good(docs, quality.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return neardup.drop_near_duplicates(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that are not widely copied examples are masked; n_chars follows the text."""
    return secrets.mask_live_secrets(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents occur as often as the mix takes them; those that it does not take go."""
    mixed = mixing.mix(docs, F.array("source"), mixing.cycle_weights)
    return mixed.where("copies > 0 AND size > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids and places in sequences."""
    path = os.environ.get("FIELDQUARRY_TOKENIZER")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(docs, path, keep_ids=True)


STAGES = [
    ("quality", drop_low_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", mask_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The classifier, signatures and tokens have no SQL; tests compare the pipeline with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage's table goes once the next one is written, or a stage fails."""
    docs, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    try:
        for name, stage in STAGES[:-1]:
            before, kept = kept, store(stage(spark, docs, sf_dir), f"stage-{name}")
            docs = kept.df
            if before is not None:
                before.drop()
        return STAGES[-1][1](spark, docs, sf_dir)
    finally:
        if kept is not None:
            kept.drop()
