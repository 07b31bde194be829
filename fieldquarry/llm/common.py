"""Shared helpers: tables in the cluster's shared folder, connected components, copies."""

from __future__ import annotations

import ctypes
import re
import sys
import tempfile
import types
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that separate words everywhere in this package: 0x20 and 0x09-0x0D.
WORD_BREAK = r"[ \t-\r]+"
BREAK = re.compile(r"[ \t-\r]")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where none is configured and all is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="fieldquarry-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/fieldquarry"


#: Rows of a table of one or two long columns that may be broadcast (about 24 bytes each); larger ones are shuffled.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame) -> DataFrame:
    """df, a stored table of a few numbers a row, to be broadcast where its size allows it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


#: Rows and bytes of an Arrow batch: bounds what the JVM and a Python worker hold of whole texts.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after bounding the session's Arrow batches (the setting is read when a plan runs)."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


@dataclass
class Stored:
    """A table written to the shared folder; later reads survive the loss of executors."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        spark = self.df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def store(df: DataFrame, name: str, rows_a_file: int = 0) -> Stored:
    """df as a table; rows_a_file: rows of a file at most, as files of large values are read some thousand rows at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows_a_file).parquet(path)
    return Stored(spark.read.schema(df.schema).parquet(path), path)


class Scratch:
    """Tables of one run; those that no later read needs are dropped together, also where the run fails (`with`)."""

    def __init__(self) -> None:
        self.made: list[Stored] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure) -> None:
        self.clear()

    def put(self, df: DataFrame, name: str, rows_a_file: int = 0) -> DataFrame:
        self.made.append(store(df, name, rows_a_file))
        return self.made[-1].df

    def finish(self, df: DataFrame, name: str) -> DataFrame:
        """df as a table that stays, after which all others go."""
        out = store(df, name).df
        self.clear()
        return out

    def clear(self) -> None:
        for one in self.made:
            one.drop()
        self.made = []


def word_count(text: Column) -> Column:
    """Number of runs of non-break characters; null and empty texts have none."""
    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, 0).otherwise(F.size(F.split(inner, WORD_BREAK))).cast("long")


def arrow_words(texts: pa.Array, lower: bool) -> tuple[pa.Array, pa.Array]:
    """All words of a text column, flat, and for each the row that holds it."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    words, rows = pc.list_flatten(split), pc.list_parent_indices(split)
    keep = pc.not_equal(words, "")
    return words.filter(keep), rows.filter(keep)


def connected_components(edges: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(node, component) of an undirected graph given as long columns a, b; component: least node.

    Each round points every node at its least neighbour and contracts the graph, so edges shrink
    fast and nothing but an emptiness test reaches the driver. Every round's tables go to the
    shared folder; the result's is left to `scratch`. Nodes without edges are absent. Null ends and loops
    are ignored.
    """
    links = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    links = store(links, "links")
    labels: Stored | None = None
    while True:
        both = links.df.unionByName(links.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = store(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("parent")), "parents")
        if labels is None:
            after = store(least.df.select("node", F.col("parent").alias("component")), "labels")
        else:
            up = least.df.withColumnRenamed("node", "component")
            after = store(labels.df.join(up, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
            labels.drop()
        labels = after
        p = least.df.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        q = least.df.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        moved = links.df.join(p, "a").join(q, "b").where("pa <> pb")
        rest = store(moved.select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "links")
        links.drop()
        least.drop()
        links = rest
        if links.df.isEmpty():
            links.drop()
            if scratch is not None:
                scratch.made.append(labels)
            return labels.df


#: Text bytes that Arrow functions work on at once; a longer document is a slice of its own.
SLICE_BYTES = 8 << 20


def text_slices(batches, id_col: str = "doc_id", text_col: str = "text", limit: int = SLICE_BYTES, most: int = 1 << 62):
    """(ids, texts) of at most `most` consecutive rows with at most `limit` bytes, or one longer document."""
    for batch in batches:
        ids, texts = batch.column(id_col), pc.fill_null(batch.column(text_col), "").cast(pa.large_string())
        sizes = pc.binary_length(texts).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if i > start and (held + n > limit or i - start >= most):
                yield ids.slice(start, i - start), texts.slice(start, i - start)
                start, held = i, 0
            held += n
        if len(sizes) > start:
            yield ids.slice(start), texts.slice(start)


def joined(batches, limit: int):
    """Consecutive batches as one until they hold `limit` bytes, about."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= limit:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def runs_of(text: str, limit: int) -> list[str]:
    """A long text cut at white space into runs of about limit characters: its words are theirs in turn."""
    out, at = [], 0
    while len(text) - at > limit:
        cut = BREAK.search(text, at + limit)
        if cut is None:
            break
        out.append(text[at : cut.start()])
        at = cut.start()
    return [*out, text[at:]]


def give_back() -> None:
    """Return memory that this Python worker has freed but still holds to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidy(run):
    """run over a task's batches; afterwards the worker, which later tasks reuse, holds no freed memory."""

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def worker_kept(key, make):
    """A value that a Python worker keeps from task to task (functions arrive anew with each)."""
    held = sys.modules.setdefault("_fieldquarry_worker", types.ModuleType("_fieldquarry_worker")).__dict__
    if key not in held:
        held[key] = make()
    return held[key]


def forest_roots(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """Least position that links (x, y) connect each of n positions with."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, x, root[y])
        np.minimum.at(low, y, root[x])
        low = low[low]
        if (low == root).all():
            return root
        root = low
