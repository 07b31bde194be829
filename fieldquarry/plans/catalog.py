"""The relational domain over the base tables: networks, work orders, execution, timing, photos.

Views hide nothing: soft deletion stays a column, and the SQL gate checks that statements use it.
`ORACLE` restates the same views as common table expressions for another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("jaringan", "spk", "spk_execution_info", "spk_pelaksanaan", "dokumentasi_foto")

# Kinds of work orders by priority, photo categories by return flag, document types.
KINDS = {"1-URGENT": "aktivasi", "2-HIGH": "dismantle", "3-MEDIUM": "instalasi", "4-NOT SPECIFIED": "survey", "5-LOW": "maintenance"}
PHOTOS = {"A": "foto_lokasi", "N": "foto_perangkat", "R": "foto_berita_acara"}
DOCUMENT_TYPES = ("spk", "form_checklist_wireline", "form_checklist_wireless")

#: Declared columns, keys and relationships: the text that a language model is shown.
SCHEMA = {
    "jaringan": ("no_jaringan", ["no_jaringan VARCHAR(100)", "nama_pelanggan VARCHAR(255)", "lokasi_pelanggan TEXT", "jasa VARCHAR(100)", "media_akses VARCHAR(100)", "kecepatan VARCHAR(255)", "pop TEXT", "tgl_rfs_la DATE", "tgl_rfs_plg DATE", "is_deleted BOOLEAN"]),
    "spk": ("id_spk", ["id_spk BIGINT", "no_spk VARCHAR(100)", "no_jaringan VARCHAR(100)", "document_type ENUM", "jenis_spk ENUM", "tanggal_spk DATE", "no_mr VARCHAR(100)", "no_fps VARCHAR(100)", "is_deleted BOOLEAN"]),
    "spk_execution_info": ("id_execution", ["id_execution BIGINT", "id_spk BIGINT", "latitude DECIMAL(9,6)", "longitude DECIMAL(10,6)", "pic_pelanggan VARCHAR(255)", "kontak_pic_pelanggan VARCHAR(20)", "teknisi VARCHAR(255)", "nama_vendor VARCHAR(255)"]),
    "spk_pelaksanaan": ("id_pelaksanaan", ["id_pelaksanaan BIGINT", "id_spk BIGINT", "permintaan_pelanggan TIMESTAMP", "datang TIMESTAMP", "selesai TIMESTAMP"]),
    "dokumentasi_foto": ("id_dokumentasi", ["id_dokumentasi BIGINT", "id_spk BIGINT", "kategori_foto ENUM", "path_foto VARCHAR(1000)", "keterangan TEXT", "urutan INT"]),
}
RELATIONSHIPS = (
    ("spk", "jaringan", "no_jaringan", "INNER JOIN"),
    ("spk_execution_info", "spk", "id_spk", "LEFT JOIN"),
    ("spk_pelaksanaan", "spk", "id_spk", "LEFT JOIN"),
    ("dokumentasi_foto", "spk", "id_spk", "LEFT JOIN"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tasks for each core that documents are spread over.
WAVES = 8


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt to all cores by their keys. A small file, or one of few row groups, is read by one task or few, and
    what is made of its rows (texts, records, tokens) costs far more than moving them."""
    return rows.repartition(WAVES * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def _lookup(c, values: dict[str, str]):
    out = F
    for k, v in values.items():
        out = out.when(c == k, v)
    return out


def pad(c, width: int):
    return F.lpad(c.cast("string"), width, "0")


def jaringan(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    speed = F.concat((F.pmod("c_custkey", F.lit(10)) + 1).cast("string"), F.lit("0 Mbps"))
    return c.join(n, c.c_nationkey == n.n_nationkey).select(
        pad(F.col("c_custkey"), 10).alias("no_jaringan"), F.upper("c_name").alias("nama_pelanggan"), F.col("n_name").alias("lokasi_pelanggan"),
        F.col("c_mktsegment").alias("jasa"), F.when(F.pmod("c_custkey", F.lit(2)) == 0, "FO").otherwise("WIRELESS").alias("media_akses"),
        speed.alias("kecepatan"), F.concat(F.lit("POP "), F.col("c_nationkey")).alias("pop"), (F.pmod("c_custkey", F.lit(10)) == 0).alias("is_deleted"),
    )


def spk(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    kind = F.element_at(F.array(*map(F.lit, DOCUMENT_TYPES)), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    return o.select(
        F.col("o_orderkey").alias("id_spk"), F.concat(pad(F.col("o_orderkey"), 6), F.lit("/WO-LA/"), F.year("o_orderdate")).alias("no_spk"),
        pad(F.col("o_custkey"), 10).alias("no_jaringan"), kind.alias("document_type"), _lookup(F.col("o_orderpriority"), KINDS).alias("jenis_spk"),
        F.to_date("o_orderdate").alias("tanggal_spk"), F.concat(F.lit("MR-"), F.col("o_orderkey")).alias("no_mr"), (F.pmod("o_orderkey", F.lit(13)) == 0).alias("is_deleted"),
    )


def spk_execution_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").groupBy("l_orderkey").agg(F.min("l_suppkey").alias("s_suppkey"))
    s = table(spark, sf_dir, "supplier")
    return first.join(s, "s_suppkey").select(
        F.col("l_orderkey").alias("id_execution"), F.col("l_orderkey").alias("id_spk"),
        (F.lit(-6) - F.col("s_suppkey") / 1000).cast("decimal(9,6)").alias("latitude"), (F.lit(106) + F.col("s_suppkey") / 1000).cast("decimal(10,6)").alias("longitude"),
        F.upper("s_name").alias("teknisi"), F.concat(F.lit("VENDOR "), F.col("s_nationkey")).alias("nama_vendor"),
    )


def spk_pelaksanaan(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy(F.col("l_orderkey").alias("id_spk")).agg(F.min("l_shipdate").alias("datang"), F.max("l_shipdate").alias("selesai")).withColumn("id_pelaksanaan", F.col("id_spk"))


def dokumentasi_foto(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("id_spk"), _lookup(F.col("l_returnflag"), PHOTOS).alias("kategori_foto"), F.concat(F.lit("foto/"), F.col("l_orderkey"), F.lit("/"), F.col("l_linenumber"), F.lit(".jpg")).alias("path_foto"), F.col("l_linenumber").alias("urutan"))


VIEWS = {"jaringan": jaringan, "spk": spk, "spk_execution_info": spk_execution_info, "spk_pelaksanaan": spk_pelaksanaan, "dokumentasi_foto": dokumentasi_foto}


def register(spark: SparkSession, sf_dir: str) -> None:
    """Temporary views of the domain tables."""
    for name, make in VIEWS.items():
        make(spark, sf_dir).createOrReplaceTempView(name)


def schema_text(tables: tuple[str, ...] = TABLES) -> str:
    return "\n\n".join(f"TABLE {t} (PK {SCHEMA[t][0]})\n" + "\n".join(f"  - {c}" for c in SCHEMA[t][1]) for t in tables)


def relationships_text() -> str:
    return "\n".join(f"{a} -> {b} ON {a}.{k} = {b}.{k} ({j})" for a, b, k, j in RELATIONSHIPS)


def is_allowed(name: str) -> bool:
    return name.lower() in TABLES


def _case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


ORACLE = f"""
WITH jaringan AS (SELECT lpad(c_custkey::VARCHAR, 10, '0') AS no_jaringan, upper(c_name) AS nama_pelanggan, n_name AS lokasi_pelanggan, c_mktsegment AS jasa,
       CASE WHEN c_custkey % 2 = 0 THEN 'FO' ELSE 'WIRELESS' END AS media_akses, (c_custkey % 10 + 1) || '0 Mbps' AS kecepatan, 'POP ' || c_nationkey AS pop,
       c_custkey % 10 = 0 AS is_deleted FROM customer JOIN nation ON c_nationkey = n_nationkey),
spk AS (SELECT o_orderkey AS id_spk, lpad(o_orderkey::VARCHAR, 6, '0') || '/WO-LA/' || year(o_orderdate) AS no_spk, lpad(o_custkey::VARCHAR, 10, '0') AS no_jaringan,
       ['spk', 'form_checklist_wireline', 'form_checklist_wireless'][(o_orderkey % 3 + 1)::INT] AS document_type, {_case("o_orderpriority", KINDS)} AS jenis_spk,
       o_orderdate::DATE AS tanggal_spk, 'MR-' || o_orderkey AS no_mr, o_orderkey % 13 = 0 AS is_deleted FROM orders),
spk_execution_info AS (SELECT l_orderkey AS id_execution, l_orderkey AS id_spk, upper(s_name) AS teknisi, 'VENDOR ' || s_nationkey AS nama_vendor, s_suppkey
       FROM (SELECT l_orderkey, min(l_suppkey) AS k FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey) JOIN supplier ON s_suppkey = k),
spk_pelaksanaan AS (SELECT l_orderkey AS id_spk, l_orderkey AS id_pelaksanaan, min(l_shipdate) AS datang, max(l_shipdate) AS selesai FROM lineitem GROUP BY l_orderkey),
dokumentasi_foto AS (SELECT l_orderkey AS id_spk, {_case("l_returnflag", PHOTOS)} AS kategori_foto, 'foto/' || l_orderkey || '/' || l_linenumber || '.jpg' AS path_foto, l_linenumber AS urutan FROM lineitem)
"""
