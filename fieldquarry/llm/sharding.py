"""Extendible hashing: a directory of hash-prefix bits whose oversized buckets alone split.

Every row has a 60-bit hash of its id. Byte sums per hash cell form the leaves of a binary trie;
parents are sums of their two children, and a shard is a node within the limit whose parent is not.
Cells that are still too large at the trie's depth go another round on more bits. Rows whose whole
hash is equal (repeated ids) cannot be told apart by bits: they overflow into numbered pages of that
bucket, by running bytes per input partition. DataFrame operations only.

Defined cases: null text has 0 bytes; a null id hashes as the empty string; an empty table gives no
shards; one document above the limit gets a shard of its own, marked oversize.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldquarry.llm.common import Scratch, store

HASH_BITS = 60
#: Trie depth beyond what an even spread would need, and bits added by each further round.
SLACK_BITS, ROUND_BITS = 4, 8
#: Most bytes of a shard in the registered query.
LIMIT = 1 << 20


def id_hash(doc_id: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")


def _prefix(bits: Column | int) -> Column:
    return F.expr(f"shiftright(s_hash, {HASH_BITS - bits})") if isinstance(bits, int) else F.call_function("shiftright", F.col("s_hash"), bits)


def _leaves(cells: DataFrame, top: int, depth: int, limit: int, scratch: Scratch) -> DataFrame:
    """Shards of a trie over cells (cell, bytes, rows): prefix, depth, shard_bytes, and whether they fit.

    top: bits that all cells of one tree share at least (its roots are known to be oversized, but for
    the first round, where top is 0 and the root itself may fit).
    """
    levels = F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("depth")
    nodes = cells.select("cell", "bytes", "rows", levels)
    nodes = nodes.groupBy("depth", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("depth")).alias("prefix")).agg(F.sum("bytes").alias("shard_bytes"), F.sum("rows").alias("shard_rows"))
    nodes = scratch.put(nodes, "nodes")
    big = nodes.where(F.col("shard_bytes") > limit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("up"))
    small = nodes.where(F.col("shard_bytes") <= limit).withColumn("up", F.call_function("shiftright", F.col("prefix"), F.lit(1)))
    fits = small.join(big, ["depth", "up"], "left_semi").drop("up")
    if top == 0:
        fits = fits.unionByName(small.where("depth = 0").drop("up"))
    rest = nodes.where((F.col("depth") == depth) & (F.col("shard_bytes") > limit))
    return fits.withColumn("fits", F.lit(True)).unionByName(rest.withColumn("fits", F.lit(False)))


def extendible_shards(rows: DataFrame, id_col: str, bytes_col: str, limit: int) -> DataFrame:
    """rows with s_hash, depth, prefix, page, shard_id, shard_bytes, shard_rows, oversize.

    rows is read more than once, so pass a stored or cheap table. Shards hold at most `limit` bytes,
    but for single documents above it.
    """
    rows = rows.drop("s_hash", "depth", "prefix", "page", "shard_id", "shard_bytes", "shard_rows", "oversize").withColumn("s_hash", id_hash(F.col(id_col)))
    total = rows.agg(F.coalesce(F.sum(bytes_col), F.lit(0)).alias("b")).head().b
    depth = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SLACK_BITS)
    top, left, done = 0, rows, []
    while True:
        cells = left.groupBy(_prefix(depth).alias("cell")).agg(F.sum(bytes_col).alias("bytes"), F.count("*").alias("rows"))
        with Scratch() as scratch:
            leaves = scratch.finish(_leaves(cells, top, depth, limit, scratch), "leaves")
        spread = F.explode(F.sequence(F.call_function("shiftleft", F.col("prefix"), F.lit(depth) - F.col("depth")), F.call_function("shiftleft", F.col("prefix") + 1, F.lit(depth) - F.col("depth")) - 1))
        cover = leaves.select(spread.alias("cell"), "depth", "prefix", "shard_bytes", "shard_rows", "fits")
        dealt = left.withColumn("cell", _prefix(depth)).join(cover, "cell").drop("cell")
        done.append(dealt.where("fits").drop("fits").withColumn("page", F.lit(0).cast("long")))
        if leaves.where("NOT fits").isEmpty():
            break
        left = dealt.where("NOT fits").select(*rows.columns)
        if depth == HASH_BITS:
            with Scratch() as scratch:
                done.append(_pages(scratch.put(left, "overflow"), bytes_col, limit, scratch))
            break
        left, top, depth = store(left, "oversized").df, depth, min(HASH_BITS, depth + ROUND_BITS)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    bits = F.lpad(F.bin("prefix"), F.col("depth").cast("int"), "0")
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(bits)
    out = out.withColumn("shard_id", F.when(F.col("page") > 0, F.concat(name, F.lit("."), F.col("page"))).otherwise(name))
    return out.withColumn("oversize", F.col("shard_bytes") > limit)


def _pages(rows: DataFrame, bytes_col: str, limit: int, scratch: Scratch) -> DataFrame:
    """Pages of rows with equal hashes: running bytes within (hash, input partition), then offsets."""
    rows = rows.withColumn("o_part", F.spark_partition_id()).withColumn("o_row", F.monotonically_increasing_id())
    rows = scratch.put(rows, "numbered")
    order = ["o_row"]
    parts = rows.groupBy("s_hash", "o_part").agg(F.sum(bytes_col).alias("b"), F.count("*").alias("n"), F.max(bytes_col).alias("most"))
    over = Window.partitionBy("s_hash").orderBy("o_part")
    whole = Window.partitionBy("s_hash")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("s_hash", "o_part", F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.max("most").over(whole).alias("most"))
    run = Window.partitionBy("s_hash", "o_part").orderBy(*order)
    rows = rows.withColumns({"b1": F.coalesce(F.sum(bytes_col).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n1": F.row_number().over(run) - 1})
    rows = rows.join(parts, ["s_hash", "o_part"])
    # starts within one page differ by less than limit - most, so a page holds at most limit bytes
    page = F.when(F.col("most") >= limit, F.col("n0") + F.col("n1")).otherwise(F.floor((F.col("b0") + F.col("b1")) / (limit - F.col("most"))))
    paged = store(rows.withColumn("page", page.cast("long") + 1).withColumn("prefix", F.col("s_hash")).withColumn("depth", F.lit(HASH_BITS)), "paged").df
    sums = paged.groupBy("s_hash", "page").agg(F.sum(bytes_col).alias("shard_bytes"), F.count("*").alias("shard_rows"))
    return paged.join(sums, ["s_hash", "page"]).drop("o_part", "o_row", "b0", "b1", "n0", "n1", "most")


def op9_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = store(docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")), "shard-rows").df
    out = extendible_shards(slim, "doc_id", "n_bytes", LIMIT)
    return out.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), "shard_id", "shard_bytes", "shard_rows", "oversize")


def oracle() -> str:
    return f"""
WITH d AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                  ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h FROM documents),
n AS (SELECT r.bits, d.h >> ({HASH_BITS} - r.bits) AS prefix, sum(n_bytes)::BIGINT AS b, count(*) AS c
      FROM d, (SELECT unnest(range(0, {HASH_BITS} + 1)) AS bits) r GROUP BY ALL),
m AS (SELECT d.doc_id, d.n_bytes, min(n.bits) AS depth
      FROM d JOIN n ON n.prefix = d.h >> ({HASH_BITS} - n.bits) WHERE n.b <= {LIMIT} OR n.bits = {HASH_BITS} GROUP BY ALL)
SELECT m.doc_id, m.n_bytes, m.depth::INTEGER AS depth,
       CASE WHEN m.depth = 0 THEN '' ELSE lpad(bin(n.prefix), m.depth::INTEGER, '0') END AS shard_id,
       n.b AS shard_bytes, n.c AS shard_rows, n.b > {LIMIT} AS oversize
FROM m JOIN d USING (doc_id) JOIN n ON n.bits = m.depth AND n.prefix = d.h >> ({HASH_BITS} - m.depth)
"""
