"""Queries that run as streams over the base tables, in several micro-batches, and give what a table query gives."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldquarry.plans import catalog
from fieldquarry.registry import query
from fieldquarry.sources import shared, sinks
from fieldquarry.streaming import lines, turns

_SAID = """WITH s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS turn, role,
  text || CASE WHEN turn % 3 = 0 THEN ' 00000000' || lpad((conv_id % 7 + turn // 6)::VARCHAR, 2, '0') ELSE '' END || CASE WHEN turn % 4 = 1 THEN ' 00012' || turn % 10 || '/WO-LA/1999' ELSE '' END AS text FROM conversations),
e AS (SELECT *, nullif(regexp_extract(text, '\\b(\\d{10})\\b', 1), '') AS net, nullif(regexp_extract(text, '([0-9]{6}/[A-Za-z-]+/\\d{4})', 1), '') AS ord FROM s),
n AS (SELECT *, last_value(net IGNORE NULLS) OVER w AS ctx FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)),
c AS (SELECT *, (ctx IS DISTINCT FROM lag(ctx) OVER (PARTITION BY conv_id ORDER BY turn))::INT AS fresh FROM n),
p AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn) AS epoch FROM c)"""


def said(spark, d):
    """conversations with turns counted from 0, some of which name a network or an order."""
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    t = catalog.table(spark, d, "conversations").withColumn("n", F.row_number().over(w) - 1)
    network = F.when(F.pmod("turn", F.lit(3)) == 0, F.concat(F.lit(" 00000000"), F.lpad((F.pmod("conv_id", F.lit(7)) + F.floor(F.col("turn") / 6)).cast("string"), 2, "0"))).otherwise("")
    order = F.when(F.pmod("turn", F.lit(4)) == 1, F.concat(F.lit(" 00012"), F.pmod("turn", F.lit(10)), F.lit("/WO-LA/1999"))).otherwise("")
    return t.select("conv_id", F.col("n").cast("long").alias("turn"), "role", F.concat("text", network, order).alias("text"))


def in_batches(spark, rows, folder, n=3):
    """rows as a stream of about n micro-batches, with a file for each core in each; which file holds a row has nothing to do with its order."""
    cores = spark.sparkContext.defaultParallelism
    rows.repartition(n * cores, F.xxhash64("conv_id", "turn")).write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", cores).parquet(f"{folder}/in")


@query("stream_context", f"{_SAID} SELECT conv_id, turn, md5(string_agg(role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS 4 PRECEDING)) AS history, ctx AS ctx_network, last_value(ord IGNORE NULLS) OVER (PARTITION BY conv_id, epoch ORDER BY turn ROWS UNBOUNDED PRECEDING) AS ctx_order FROM p")
def _stream_context(spark, d):
    folder = shared.work_folder(spark, "turns")
    made = turns.conversation_context(in_batches(spark, said(spark, d), folder), k=5, patience_ms=3_600_000)
    turns.write_available(made, f"{folder}/out", f"{folder}/state", partitions=max(4, 2 * spark.sparkContext.defaultParallelism))
    return spark.read.schema(turns.ROWS).parquet(f"{folder}/out").withColumn("history", F.md5("history"))


@query("stream_lines", "SELECT conv_id::VARCHAR || '/' || turn AS token, count(*) AS n FROM conversations GROUP BY ALL")
def _stream_lines(spark, d):
    folder = shared.work_folder(spark, "lines")
    rows = catalog.table(spark, d, "conversations").select("conv_id", "turn")
    tokens = in_batches(spark, rows, folder).select(sinks.event_line(F.concat_ws("/", "conv_id", "turn")).alias("line"))
    lines.write_lines(tokens, f"{folder}/out", f"{folder}/state").awaitTermination()
    out = lines.read_lines(spark, f"{folder}/out")
    return out.select(F.get_json_object(F.regexp_replace("value", r"\Adata: ", ""), "$.token").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
