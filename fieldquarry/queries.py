"""Named queries over the base tables, each with the DuckDB statement that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldquarry.functions import similarity as S
from fieldquarry.functions import text as T
from fieldquarry.operators import checklists, classify, conversation, evaluate, fields, forms, headings, layout, nlq, rules, sqlgate
from fieldquarry.plans import catalog
from fieldquarry.registry import ORACLES, QUERIES, query
from fieldquarry.sources import pages, sinks
from fieldquarry.streaming import ingest

# ---- SQL over the domain tables: one text, through the gate, on views ------------------------------
SQL = {
    "count_spk": "SELECT s.no_jaringan, COUNT(*) AS jumlah_spk FROM spk s WHERE s.is_deleted = false GROUP BY s.no_jaringan",
    "count_distinct_spk": "SELECT COUNT(DISTINCT s.id_spk) AS jumlah_spk, COUNT(DISTINCT s.no_jaringan) AS jumlah_jaringan FROM spk s WHERE s.is_deleted = false",
    "list_spk": "SELECT s.id_spk, s.no_spk, s.jenis_spk, s.tanggal_spk FROM spk s WHERE s.is_deleted = false AND s.no_jaringan IN ('0000000085', '0000000001', '0000000004')",
    "list_spk_by_jenis": "SELECT s.id_spk, s.no_spk, s.no_jaringan FROM spk s WHERE s.is_deleted = false AND s.jenis_spk = 'survey'",
    "customer_info": "SELECT j.no_jaringan, j.nama_pelanggan, j.lokasi_pelanggan, j.jasa, j.kecepatan FROM jaringan j WHERE j.is_deleted = false",
    "spk_with_teknisi": "SELECT s.no_spk, s.jenis_spk, sei.teknisi, sei.nama_vendor FROM spk s LEFT JOIN spk_execution_info sei ON s.id_spk = sei.id_spk WHERE s.is_deleted = false",
    "spk_with_pelaksanaan": "SELECT s.no_spk, sp.datang, sp.selesai FROM spk s LEFT JOIN spk_pelaksanaan sp ON s.id_spk = sp.id_spk WHERE s.is_deleted = false",
    "foto_fanout": "SELECT s.no_spk, df.kategori_foto, COUNT(*) AS jumlah FROM spk s LEFT JOIN dokumentasi_foto df ON s.id_spk = df.id_spk WHERE s.is_deleted = false GROUP BY s.no_spk, df.kategori_foto",
    "foto_count_scalar_subquery": "SELECT COUNT(*) AS jumlah_foto FROM dokumentasi_foto df WHERE df.id_spk = (SELECT MAX(s.id_spk) FROM spk s WHERE s.is_deleted = false)",
    "latest_spk_by_jenis": "SELECT jenis_spk, no_spk, tanggal_spk, nama_pelanggan, teknisi, nama_vendor FROM (SELECT s.jenis_spk, s.no_spk, s.tanggal_spk, j.nama_pelanggan, sei.teknisi, sei.nama_vendor, ROW_NUMBER() OVER (PARTITION BY s.no_jaringan, s.jenis_spk ORDER BY s.tanggal_spk DESC, s.id_spk) AS rn FROM spk s JOIN jaringan j ON s.no_jaringan = j.no_jaringan LEFT JOIN spk_execution_info sei ON s.id_spk = sei.id_spk WHERE s.is_deleted = false AND j.is_deleted = false) t WHERE rn = 1",
    "search_customer_ilike": "SELECT j.no_jaringan, j.nama_pelanggan FROM jaringan j WHERE j.nama_pelanggan ILIKE '%customer%9' AND j.is_deleted = false",
    "spk_group_by_jenis": "SELECT s.jenis_spk, COUNT(*) AS n, MIN(s.tanggal_spk) AS first_date, MAX(s.tanggal_spk) AS last_date FROM spk s WHERE s.is_deleted = false GROUP BY s.jenis_spk HAVING COUNT(*) > 10",
    "spk_rollup_year_jenis": "SELECT YEAR(s.tanggal_spk) AS tahun, s.jenis_spk, COUNT(*) AS n FROM spk s WHERE s.is_deleted = false GROUP BY ROLLUP (YEAR(s.tanggal_spk), s.jenis_spk)",
    "spk_cube": "SELECT s.document_type, s.jenis_spk, COUNT(*) AS n FROM spk s WHERE s.is_deleted = false GROUP BY CUBE (s.document_type, s.jenis_spk)",
    "spk_grouping_sets": "SELECT s.document_type, s.jenis_spk, COUNT(*) AS n FROM spk s WHERE s.is_deleted = false GROUP BY GROUPING SETS ((s.document_type), (s.jenis_spk), ())",
    "spk_without_execution": "SELECT s.id_spk, s.no_spk FROM spk s WHERE s.is_deleted = false AND NOT EXISTS (SELECT 1 FROM spk_execution_info e WHERE e.id_spk = s.id_spk)",
    "network_with_spk": "SELECT j.no_jaringan, j.jasa FROM jaringan j WHERE j.is_deleted = false AND EXISTS (SELECT 1 FROM spk s WHERE s.no_jaringan = j.no_jaringan AND s.jenis_spk = 'dismantle')",
    "spk_union_checklist": "SELECT s.no_spk, 'spk' AS asal FROM spk s WHERE s.is_deleted = false AND s.document_type = 'spk' UNION ALL SELECT c.no_spk, 'checklist' AS asal FROM spk c WHERE c.is_deleted = false AND c.document_type <> 'spk'",
    "spk_intersect_networks": "SELECT no_jaringan FROM spk WHERE jenis_spk = 'survey' AND is_deleted = false INTERSECT SELECT no_jaringan FROM spk WHERE jenis_spk = 'aktivasi' AND is_deleted = false",
    "spk_except_networks": "SELECT no_jaringan FROM jaringan WHERE is_deleted = false EXCEPT SELECT no_jaringan FROM spk WHERE is_deleted = false",
    "rank_spk_per_network": "SELECT s.no_spk, RANK() OVER (PARTITION BY s.no_jaringan ORDER BY s.tanggal_spk) AS r, DENSE_RANK() OVER (PARTITION BY s.no_jaringan ORDER BY s.jenis_spk) AS d FROM spk s WHERE s.is_deleted = false",
    "running_count_spk": "SELECT s.id_spk, COUNT(*) OVER (PARTITION BY s.no_jaringan ORDER BY s.tanggal_spk, s.id_spk ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM spk s WHERE s.is_deleted = false",
    "spk_full_outer": "SELECT COALESCE(s.id_spk, e.id_spk) AS id_spk, s.no_spk, e.teknisi FROM spk s FULL OUTER JOIN spk_execution_info e ON s.id_spk = e.id_spk AND s.is_deleted = false",
    "spk_top_networks": "SELECT s.no_jaringan, COUNT(*) AS n FROM spk s WHERE s.is_deleted = false GROUP BY s.no_jaringan ORDER BY n DESC, s.no_jaringan LIMIT 10",
    "spk_cte_monthly": "WITH bulan AS (SELECT YEAR(tanggal_spk) AS y, MONTH(tanggal_spk) AS m, COUNT(*) AS n FROM spk WHERE is_deleted = false GROUP BY YEAR(tanggal_spk), MONTH(tanggal_spk)) SELECT y, m, n, SUM(n) OVER (ORDER BY y, m) AS kumulatif FROM bulan",
}


def _sql(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        catalog.register(spark, sf_dir)
        return sqlgate.run_checked(spark, text)

    return run


def _oracle(text: str) -> str:
    return f"{catalog.ORACLE.rstrip()},\n{text[5:]}" if text.startswith("WITH ") else f"{catalog.ORACLE}{text}"


#: Where a statement leaves the flag out of a block, the policy puts it in; DuckDB has to be told.
LIVE = {
    "network_with_spk": ("s.jenis_spk = 'dismantle'", "s.jenis_spk = 'dismantle' AND s.is_deleted = false"),
    "spk_full_outer": ("FROM spk s", "FROM (SELECT * FROM spk WHERE is_deleted = false) s"),
}
for _name, _text in SQL.items():
    QUERIES[_name], ORACLES[_name] = _sql(_text), _oracle(_text.replace(*LIVE.get(_name, ("", ""))))


def _lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("no_jaringan").orderBy("tanggal_spk", "id_spk")
    s = catalog.spk(spark, sf_dir).where("NOT is_deleted")
    return s.select("id_spk", F.datediff("tanggal_spk", F.lag("tanggal_spk").over(w)).cast("long").alias("hari"))


QUERIES["lag_days_between_spk"] = _lag
ORACLES["lag_days_between_spk"] = f"{catalog.ORACLE} SELECT id_spk, date_diff('day', lag(tanggal_spk) OVER (PARTITION BY no_jaringan ORDER BY tanggal_spk, id_spk), tanggal_spk) AS hari FROM spk WHERE NOT is_deleted"


@query("duration_datang_selesai", f"{catalog.ORACLE} SELECT id_spk, date_diff('second', datang, selesai) AS detik FROM spk_pelaksanaan")
def _duration(spark, d):
    return catalog.spk_pelaksanaan(spark, d).select("id_spk", F.expr("timestampdiff(SECOND, datang, selesai)").alias("detik"))


@query("template_answers", f"{catalog.ORACLE} SELECT no_jaringan, (SELECT count(DISTINCT id_spk) FROM spk s WHERE s.no_jaringan = j.no_jaringan AND NOT s.is_deleted) AS jumlah_spk FROM jaringan j WHERE no_jaringan IN ('0000000001', '0000000085')")
def _templates(spark, d):
    catalog.register(spark, d)
    one = [nlq.run_template(spark, "count_spk", n).withColumn("no_jaringan", F.lit(n)) for n in ("0000000001", "0000000085")]
    return one[0].unionByName(one[1])


@query("fallback_network_row", f"{catalog.ORACLE} SELECT no_jaringan, nama_pelanggan, lokasi_pelanggan, jasa, media_akses, kecepatan, pop FROM jaringan WHERE no_jaringan = '0000000085' AND NOT is_deleted")
def _fallback(spark, d):
    catalog.register(spark, d)
    return nlq.run_template(spark, "fallback", "0000000085")


# ---- rendered documents ------------------------------------------------------------------------
def work_orders(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): a work order for each order, as printed."""
    s, j = catalog.spk(spark, d), catalog.jaringan(spark, d).drop("is_deleted")
    e, p = catalog.spk_execution_info(spark, d).drop("id_execution"), catalog.spk_pelaksanaan(spark, d).drop("id_pelaksanaan")
    r = catalog.spread(s.join(j, "no_jaringan").join(p, "id_spk", "left").join(e, "id_spk", "left"), "id_spk")
    stamp = lambda c: F.coalesce(F.date_format(c, "dd/MMM/yyyy HH:mm"), F.lit("-"))
    text = F.concat_ws(
        "\n", F.lit("SURAT PERINTAH KERJA"), F.concat(F.lit("SPK "), F.upper("jenis_spk")), F.concat(F.lit("Nomor : "), "no_spk"),
        F.concat(F.lit("Tanggal : "), F.date_format("tanggal_spk", "dd/MMM/yyyy")), F.concat(F.lit("Nama Pelanggan : "), "nama_pelanggan"),
        F.concat(F.lit("Lokasi Pelanggan : "), "lokasi_pelanggan"), F.concat(F.lit("No. Jaringan : "), "no_jaringan"), F.concat(F.lit("Jasa : "), "jasa"),
        F.concat(F.lit("Media Akses : "), "media_akses"), F.concat(F.lit("POP : "), "pop", F.lit("\nLantai 2\nKecepatan : "), "kecepatan"),
        F.concat(F.lit("Telepon : 021"), F.substring("no_jaringan", 4, 7)), stamp("datang"), stamp("selesai"),
        F.concat(F.lit("Pelaksana : "), F.coalesce("teknisi", F.lit("-"))), F.concat(F.lit("Vendor : "), F.coalesce("nama_vendor", F.lit("-"))),
        F.concat(F.lit("Koordinat\n"), F.coalesce(F.col("latitude").cast("string"), F.lit("-")), F.lit(" , "), F.coalesce(F.col("longitude").cast("string"), F.lit("-"))),
        F.lit("BERITA ACARA"), F.concat(F.lit("Nomor SPK : "), "no_spk"), F.concat(F.lit("Kontak Person : PIC\n"), "id_spk"), F.concat(F.lit("Telepon : 021"), F.lpad(F.col("id_spk").cast("string"), 7, "9")),
    )
    return r.select(F.col("id_spk").alias("doc_id"), text.alias("text"))


_WO = f"{catalog.ORACLE}, wo AS (SELECT s.*, j.nama_pelanggan, j.lokasi_pelanggan, j.jasa, j.media_akses, j.kecepatan, j.pop, p.datang, p.selesai, e.teknisi, e.nama_vendor, e.s_suppkey FROM spk s JOIN jaringan j USING (no_jaringan) LEFT JOIN spk_pelaksanaan p USING (id_spk) LEFT JOIN spk_execution_info e USING (id_spk))"


@query("roundtrip_spk_header", f"{_WO} SELECT id_spk AS doc_id, 'SURAT PERINTAH KERJA' AS judul_spk, no_spk, strftime(tanggal_spk, '%d/%b/%Y') AS tanggal_spk, NULL::VARCHAR AS no_fps FROM wo")
def _rt_header(spark, d):
    return work_orders(spark, d).select("doc_id", fields.work_order(F.col("text"), ("spk",)).alias("w")).select("doc_id", "w.spk.*")


@query("roundtrip_pelanggan", f"{_WO} SELECT id_spk AS doc_id, nama_pelanggan, lokasi_pelanggan, '021' || substr(no_jaringan, 4, 7) AS telepon FROM wo")
def _rt_customer(spark, d):
    made = F.struct(*[T.search_field(F.col("text"), p, m).alias(n) for n, p, _, m in rules.CUSTOMER])
    return work_orders(spark, d).select("doc_id", made.alias("c")).select("doc_id", "c.nama_pelanggan", "c.lokasi_pelanggan", "c.telepon")


@query("roundtrip_jaringan", f"{_WO} SELECT id_spk AS doc_id, no_jaringan, jasa, media_akses, pop || ' Lantai 2' AS pop, kecepatan FROM wo")
def _rt_network(spark, d):
    made = F.struct(*[T.search_field(F.col("text"), p, m).alias(n) for n, p, _, m in rules.NETWORK])
    return work_orders(spark, d).select("doc_id", made.alias("c")).select("doc_id", "c.no_jaringan", "c.jasa", "c.media_akses", "c.pop", "c.kecepatan")


@query("roundtrip_berita_acara", f"{_WO} SELECT id_spk AS doc_id, no_spk AS nomor_spk, 'PIC ' || id_spk AS kontak_person, '021' || lpad(id_spk::VARCHAR, 7, '9') AS telepon FROM wo")
def _rt_report(spark, d):
    _, report = T.split_report(F.col("text"))
    made = F.struct(*[T.search_field(F.col("text") if part == "all" else report, p, m).alias(n) for n, p, part, m in rules.REPORT if n in ("nomor_spk", "kontak_person", "telepon")])
    return work_orders(spark, d).select("doc_id", made.alias("c")).select("doc_id", "c.*")


@query("roundtrip_vendor", f"{_WO} SELECT id_spk AS doc_id, coalesce(teknisi, '') AS teknisi, coalesce(nama_vendor, '-') AS nama_vendor, (-6 - s_suppkey / 1000)::DECIMAL(9,6)::VARCHAR AS latitude, (106 + s_suppkey / 1000)::DECIMAL(10,6)::VARCHAR AS longitude FROM wo")
def _rt_vendor(spark, d):
    return work_orders(spark, d).select("doc_id", fields.vendor(F.col("text")).alias("v")).select("doc_id", "v.teknisi", "v.nama_vendor", "v.latitude", "v.longitude")


@query("vendor_forms", f"{_WO}, w AS (SELECT *, id_spk % 3 AS form FROM wo WHERE teknisi IS NOT NULL) SELECT id_spk AS doc_id, teknisi, nama_vendor, '-' || s_suppkey % 90 AS latitude, CASE form WHEN 2 THEN '106.' ELSE '106.25' END AS longitude, 'Ibu ' || id_spk || CASE form WHEN 0 THEN chr(10) || 'Lantai 2' ELSE '' END AS pic_pelanggan, '+62 (21) ' || id_spk AS kontak_pic_pelanggan FROM w")
def _vendor_forms(spark, d):
    """Execution blocks in three printed forms: labels on lines of their own, labels with colons, names in a line with its label."""
    e = catalog.spk_execution_info(spark, d).where("teknisi IS NOT NULL").select(F.col("id_spk").alias("doc_id"), "teknisi", "nama_vendor", "latitude")
    own = catalog.spk(spark, d).select(F.col("id_spk").alias("doc_id"), F.initcap("jenis_spk").alias("kind"))
    # the supplier's key by the printed latitude: -6 - key / 1000
    south = F.concat(F.lit("-"), (F.round((-F.col("latitude") - 6) * 1000).cast("long") % 90).cast("string"))
    pic, phone = F.concat(F.lit("Ibu "), "doc_id"), F.concat(F.lit("+62 (21) "), "doc_id")
    lines = lambda *x: F.concat_ws("\n", *[F.lit(y) if isinstance(y, str) else y for y in x])
    first = lines(F.concat(F.lit("Pelaksana Survey dari Tim Vendor\n"), "teknisi"), "Vendor", F.regexp_replace("nama_vendor", " ", "\n"), "", "INFORMASI", "Koordinat", F.concat(south, F.lit(", 106.25")), "PIC Pelanggan (nama)", pic, "Lantai 2", "Kontak PIC Pelanggan", phone)
    second = lines(F.concat(F.lit("Koordinat "), south, F.lit(" , 106.25")), F.concat(F.lit("Pelaksana : "), "teknisi"), F.concat(F.lit("Vendor : "), "nama_vendor"), F.concat(F.lit("PIC Pelanggan : "), pic), F.concat(F.lit("Kontak PIC Pelanggan : "), phone, F.lit(" Bpk")))
    third = lines(F.concat(F.lit("Pelaksana INSTALASI "), "teknisi", F.lit(" "), "nama_vendor"), F.concat(F.lit("Vendor "), "nama_vendor"), "Kontak Person", "PIC Pelanggan", pic, F.concat(F.lit("Kontak PIC Pelanggan - "), phone), F.concat(F.lit("Koordinat\n\n"), south, F.lit(",106.")))
    form = F.pmod("doc_id", F.lit(3))
    made = catalog.spread(e.join(own, "doc_id"), "doc_id").select("doc_id", F.when(form == 0, first).when(form == 1, second).otherwise(third).alias("text"))
    return made.select("doc_id", fields.vendor(F.col("text")).alias("v")).select("doc_id", "v.teknisi", "v.nama_vendor", "v.latitude", "v.longitude", "v.pic_pelanggan", "v.kontak_pic_pelanggan")


@query("ordinal_timestamps", f"{_WO} SELECT id_spk AS doc_id, coalesce(strftime(datang, '%d/%b/%Y %H:%M'), '') AS first_stamp, coalesce(strftime(selesai, '%d/%b/%Y %H:%M'), '') AS second_stamp, '' AS third_stamp FROM wo")
def _stamps(spark, d):
    s = fields.stamps(F.col("text"))
    return work_orders(spark, d).select("doc_id", s["permintaan_pelanggan"].alias("first_stamp"), s["datang"].alias("second_stamp"), s["selesai"].alias("third_stamp"))


@query("doctype_full_chain", f"{_WO} SELECT CASE WHEN jenis_spk = 'maintenance' THEN 'unknown' ELSE 'spk_' || jenis_spk END AS document_type, count(*) AS n FROM wo GROUP BY 1")
def _doctype(spark, d):
    docs = work_orders(spark, d)
    return docs.groupBy(classify.document_type(F.col("text")).alias("document_type")).agg(F.count("*").alias("n"))


@query("confidence_score", f"{_WO} SELECT CASE WHEN jenis_spk = 'survey' THEN 'medium' ELSE 'low' END AS level, count(*) AS n FROM wo GROUP BY 1")
def _confidence(spark, d):
    docs = work_orders(spark, d).withColumn("t", classify.document_type(F.col("text")))
    return docs.groupBy(classify.confidence(F.col("text"), F.col("t")).alias("level")).agg(F.count("*").alias("n"))


@query("category_membership", f"{_WO} SELECT id_spk AS doc_id, jenis_spk <> 'maintenance' AS is_valid, CASE WHEN jenis_spk <> 'maintenance' THEN 'spk' END AS category, CASE WHEN jenis_spk = 'maintenance' THEN 'unknown_document_type' ELSE 'success' END AS parsing_status FROM wo")
def _category(spark, d):
    docs = work_orders(spark, d).withColumn("document_type", classify.document_type(F.col("text"))).withColumn("expected", F.lit("spk"))
    return classify.validate(docs, "expected").select("doc_id", "is_valid", "category", "parsing_status")


_SURVEY_ROWS = (
    ("informasi_gedung", "status_gedung", "c_mktsegment"), ("informasi_gedung", "kondisi_gedung", "'Baik'"), ("informasi_gedung", "pelanggan_fo", "NULL"), ("informasi_gedung", "email", "'c' || c_custkey || '@mail.test'"),
    ("sarpen_ruang_server", "ups", "'Ada ' || c_custkey"), ("sarpen_ruang_server", "info_kelistrikan_pln_p_n", "'220 VAC'"), ("sarpen_ruang_server", "perangkat_pelanggan", "'Router'"),
    ("lokasi_antena", "lokasi_antena", "c_name"), ("lokasi_antena", "tindak_lanjut", "'baru'"),
    ("perizinan_biaya_gedung", "pic_bm", "c_name"), ("perizinan_biaya_gedung", "supervisi", "'lama'"),
    ("perizinan_biaya_kawasan", "nama_kawasan", "'Kawasan ' || c_nationkey"), ("perizinan_biaya_kawasan", "biaya_sewa", "'0'"),
    ("data_splitter", "id_splitter", "'SP-' || c_custkey"),
)


def surveys(spark, d) -> DataFrame:
    """(doc_id, text): a survey report for each customer, with repeated labels, a label without a value and a missing section."""
    c = catalog.spread(catalog.table(spark, d, "customer"), "c_custkey")
    text = F.concat(
        F.lit("SURAT PERINTAH KERJA\nSPK SURVEY\nNomor : 1\nStatus Gedung\n"), "c_mktsegment", F.lit("\nKondisi Gedung\nBaik\nPelanggan bersedia dipasang perangkat\nEmail\nto c"), "c_custkey", F.lit("@mail.test now\nINFORMASI LOKASI ANTENA\nLokasi Antena\n"), "c_name",
        F.lit("\nTindak Lanjut\nlama\nTindak Lanjut\nbaru\nSURVEY REPORT\nDATA PERIZINAN DAN BIAYA  YANG TIMBUL DALAM GEDUNG\nPIC BM\n"), "c_name",
        F.lit("\nSupervisi\nlama\nSupervisi\nbaru\nINFORMASI SARPEN DAN RUANG SERVER PELANGGAN\nUPS : Ada "), "c_custkey", F.lit("\nInfo Kelistrikan (PLN P-\nN)\n220 VAC\nPerangkat Pelanggan\nRouter\nDATA PERIZINAN DAN BIAYA YANG TIMBUL DALAM KAWASAN\nNama Kawasan : Kawasan "), "c_nationkey",
        F.lit("\nbiaya sewa\n0\nDATA KAWASAN UMUM\nDATA JALUR KABEL\nDATA SPLITTER\nID Splitter SP-"), "c_custkey", F.lit("\nDATA HH BARU\nData HH 2\nKondisi HH-2\nBaik\nFOTO LOKASI HH BARU\nData HH 9"),
    )
    return c.select(F.col("c_custkey").alias("doc_id"), text.alias("text"))


@query("record_spk_survey", "SELECT c_custkey AS doc_id, " + ", ".join(f"unnest([{', '.join(v)}]) AS {n}" for n, v in zip(("section", "key", "value"), ([f"'{a}'" for a, _, _ in _SURVEY_ROWS] + ["'hh_baru'"], [f"'{b}'" for _, b, _ in _SURVEY_ROWS] + ["'hh_2.kondisi_hh_2'"], [x for *_, x in _SURVEY_ROWS] + ["'Baik'"]), strict=True)) + " FROM customer")
def _survey(spark, d):
    s = surveys(spark, d).select("doc_id", fields.survey(F.col("text")).alias("s"))
    wanted = {(a, b) for a, b, _ in _SURVEY_ROWS}
    def entries_of(name: str):
        return F.transform(F.map_entries(F.col(f"s.{name}")), lambda e: F.struct(F.lit(name).alias("section"), e["key"].alias("key"), e["value"].alias("value")))

    entries = [entries_of(n) for n, *_ in rules.SURVEY]
    groups = F.transform("s.hh_baru", lambda h: F.struct(F.lit("hh_baru").alias("section"), F.concat_ws(".", h["hh"], h["key"]).alias("key"), h["value"].alias("value")))
    out = s.select("doc_id", F.explode(F.concat(*[F.coalesce(e, F.array().cast("array<struct<section: string, key: string, value: string>>")) for e in [*entries, groups]])).alias("e")).select("doc_id", "e.*")
    # inline sections list all their labels; the others only what they hold
    out = out.where((F.col("section") != "sarpen_ruang_server") | F.col("key").isin(*[b for a, b in wanted if a == "sarpen_ruang_server"]) | F.col("value").isNotNull())
    return out


_QUALITY_ROWS = (("Menggunakan UPS", "'Ya'", "CASE WHEN k % 2 = 0 THEN 'Ya' ELSE 'Tidak' END"), ("Ruangan Bebas Debu", "''", "''"), ("Suhu Ruangan", "'< 25 C'", "(k % 40) || ' C'"), ("Terpasang ground bar dan terhubung ke MDP pertanahan", "'Tidak'", "''"))


@query("quality_parameters_indoor", "SELECT k AS doc_id, " + ", ".join(f"unnest([{', '.join(v)}]) AS {n}" for n, v in zip(("parameter", "standard", "existing"), ([f"'{a}'" for a, _, _ in _QUALITY_ROWS], [b for _, b, _ in _QUALITY_ROWS], [c for *_, c in _QUALITY_ROWS]), strict=True)) + " FROM (SELECT s_suppkey AS k FROM supplier)")
def _quality_indoor(spark, d):
    k = F.col("doc_id")
    text = F.concat(F.lit("Menggunakan  UPS Ya "), F.when(F.pmod(k, F.lit(2)) == 0, "Ya").otherwise("Tidak"), F.lit("\nSuhu Ruangan < 25 C "), F.pmod(k, F.lit(40)), F.lit(" C\nTerpasang ground bar dan terhubung ke MDP pertanahan Tidak\n"))
    return _numbers(spark, d).select("doc_id", F.explode(fields.quality_table(text, rules.QUALITY["sarana_penunjang"])).alias("q")).select("doc_id", "q.*")


@query("roundtrip_inverter", "SELECT s_suppkey AS doc_id, unnest(['1.a', '2.a', '2.e', '2.b']) AS no, unnest(['Clean', (48 + s_suppkey % 8) || ',5', '30', (s_suppkey % 40) || ',0']) AS result, unnest(['Clean, No dust', '48 - 56 VDC ', '0-35 c', CASE WHEN s_suppkey % 40 <= 12 THEN '9 A' WHEN s_suppkey % 40 <= 24 THEN '16 A' ELSE '33 A' END]) AS standard, unnest(['OK', 'NOK', 'OK', 'OK']) AS status FROM supplier")
def _inverter(spark, d):
    k = F.col("doc_id")
    text = F.concat(
        F.lit("1. Physical Check\na. Environment Condition Clean Normal Clean, No dust OK\n2. Performance and Capacity Check\na. DC Input Voltage "), 48 + F.pmod(k, F.lit(8)), F.lit(",5 VDC\n48-56 VDC NOK\nb. DC Current Input *) "),
        F.pmod(k, F.lit(40)), F.lit(",0 A 500VA 9 A OK\ne. Equipment Temperature 30 C 0 - 35 C OK\nNotes : none"),
    )
    made = _numbers(spark, d).select("doc_id", forms.inverter(text).alias("r"))
    items = made.select("doc_id", F.explode(F.concat("r.physical_check", "r.performance_check")).alias("i")).select("doc_id", "i.no", "i.result", "i.standard", "i.status")
    options = made.select("doc_id", F.col("r.dc_current_input.no").alias("no"), F.explode("r.dc_current_input.checklist").alias("o")).where("o.result <> ''")
    return items.unionByName(options.select("doc_id", "no", "o.result", "o.standard", "o.status"))


_FORM = "WITH f AS (SELECT s_suppkey AS k, s_suppkey % 3 = 0 AS third, (s_suppkey % 80) || ',5' AS amps, s_suppkey % 80 + 0.5 AS a FROM supplier)"


@query("roundtrip_rectifier", f"{_FORM} SELECT k AS doc_id, unnest(['1.a', '1.d', '2.a', '3']) AS no, unnest(['Clean', NULL, (200 + k % 40)::VARCHAR, '-']) AS result, unnest(['Clean, No dust', NULL, '180-240 VAC', 'Rectifier Normal Operations']) AS standard, unnest(['OK', NULL, CASE WHEN third THEN 'NOK' ELSE 'OK' END, '']) AS status FROM f UNION ALL SELECT k, '2.b', '-', NULL, '' FROM f UNION ALL SELECT k, '2.c', amps, CASE WHEN a <= 37.5 THEN '25 A ( Single Power Module )' WHEN a <= 62.5 THEN '50 A ( Dual Power Module )' ELSE '75 A ( Three Power Module )' END, 'OK' FROM f")
def _rectifier(spark, d):
    k = F.col("doc_id")
    text = F.concat(
        F.lit("Kap.Power Module : Dual\n1. Physical Check\na. Environment Condition Clean Clean, No\ndust OK\nb. LED / display\nd. Rectifier Module Installed\n2. Performance and Capacity Check\na. AC Input Voltage "), 200 + F.pmod(k, F.lit(40)),
        F.lit(" 180-240 VAC "), F.when(F.pmod(k, F.lit(3)) == 0, "NOK").otherwise("OK"), F.lit("\nb. AC Current Input -\nc. DC Current Output "), F.pmod(k, F.lit(80)), F.lit(",5 25 A\n50 A\nOK\nBackup Tests\n3. Rectifier Switching test\nNotes : none"),
    )
    made = _numbers(spark, d).select("doc_id", forms.rectifier(text).alias("r"))
    names = ("no", "result", "standard", "status")
    items = made.select("doc_id", F.explode(F.concat("r.physical_check", "r.performance_capacity_check", "r.backup_tests")).alias("i")).select("doc_id", *[f"i.{n}" for n in names])
    loads = made.select("doc_id", F.explode(F.array("r.ac_current_input", "r.dc_current_output")).alias("i")).select("doc_id", "i.no", "i.result", F.col("i.standard_selected").alias("standard"), "i.status")
    return items.unionByName(loads)


@query("roundtrip_shelter", f"{_FORM} SELECT k AS doc_id, unnest(['1.a', '2.c', '<25C Shelter Room', '<35C Outdoor Cabinet (ODC)', '<40C Pole Outdoor Cabinet (ODC)']) AS no, unnest(['Clean', 'Easy', '', '', '']) AS result, unnest([CASE WHEN third THEN 'NOK' ELSE 'OK' END, 'OK', 'OK', CASE WHEN third THEN 'NOK' ELSE 'OK' END, '']) AS status FROM f")
def _shelter(spark, d):
    bad = F.when(F.pmod("doc_id", F.lit(3)) == 0, "NOK").otherwise("OK")
    text = F.concat(
        F.lit("1. Physical Check\na. Room Condition Clean Clean, free from\nleaks "), bad, F.lit("\n2. Room Infrastructure\nb. Security Management Control\nc. Ease Of Access Easy Safe and efficient OK\n3. Room Temprature\n<25°C Shelter Room OK\n<35C Outdoor\nCabinet (ODC) x\n"),
        bad, F.lit("\n<40C Pole\n\n\nNotes : OK"),
    )
    made = _numbers(spark, d).select("doc_id", forms.shelter(text).alias("r"))
    items = made.select("doc_id", F.explode(F.concat("r.physical_check", "r.room_infrastructure")).alias("i")).select("doc_id", "i.no", "i.result", "i.status")
    return items.unionByName(made.select("doc_id", F.explode("r.room_temperature").alias("i")).select("doc_id", F.col("i.standard").alias("no"), "i.result", "i.status"))


@query("roundtrip_air_conditioner", f"{_FORM} SELECT k AS doc_id, unnest(['1.a', '1.b', '1.c', '2', '3', '4']) AS no, unnest(['Unit', 'Filter', 'Pipe', 'PSI Pressure', 'Input Current AC (AC = 1 PK)', 'Output Temperature AC']) AS description, unnest(['Clean', 'No Dust', NULL, (100 + k % 50) || ' psi', amps || ' Amp', CASE WHEN third THEN NULL ELSE (k % 20)::VARCHAR END]) AS result, unnest(['Clean, dry', 'None', NULL, '60 - 80 psi', '¾ -1 PK ≤ 4 A' || chr(10) || '2 PK ≤ 10 A', '16 - 20°C']) AS standard, unnest(['OK', 'NOK', NULL, 'OK', 'OK', 'NOK']) AS status FROM f")
def _air_conditioner(spark, d):
    k = F.col("doc_id")
    text = F.concat(
        F.lit("S/N : AC 1 : X1\nCapacity : 1 PK AC 2 : X2\n1. Physical Check\na. Unit Clean Clean, dry OK\nb. Filter No Dust\nNone NOK\nc. Pipe\n2. PSI Pressure "), 100 + F.pmod(k, F.lit(50)), F.lit(" psi 60 - 80 psi OK\n3. Input Current AC\nAC = 1 PK "),
        F.pmod(k, F.lit(80)), F.lit(",5 Amp ¾ -1  PK ≤ 4 A\n   2 PK ≤ 10 A\nOK\n4. Output Temperature AC ....... "), F.when(F.pmod(k, F.lit(3)) == 0, "").otherwise(F.pmod(k, F.lit(20)).cast("string")), F.lit(" 16 - 20 °C NOK\nNotes : none"),
    )
    made = _numbers(spark, d).select("doc_id", forms.air_conditioner(text).alias("r"))
    return made.select("doc_id", F.explode(F.concat("r.physical_check", F.array("r.psi_pressure", "r.input_current", "r.output_temperature"))).alias("i")).select("doc_id", "i.*")


#: What the forms print, written out apart from the rules under test.
_PRINTED = {
    "spk_survey": ["Dokumentasi foto", "Foto penempatan perangkat di lokasi pelanggan", "Foto jalur kabel dalam gedung", "Plan jalur dalam gedung", "Data jalur kabel", "Foto splitter", "Foto hh eksisting yang dipakai", "Foto lokasi hh baru"],
    "spk_instalasi": ["HASIL INSTALASI", "PHOTO INSTALASI ETHERNET", "FOTO LAIN-LAIN", "LIST ITEM"],
    "spk_dismantle": ["HASIL PEKERJAAN CABUT", "DISMANTLE ITEMS"],
    "spk_aktivasi": ["HASIL AKTIVASI", "DOKUMENTASI FOTO", "LIST ITEM"],
}


@query("image_labels", f"{_WO} SELECT id_spk AS doc_id, unnest(CASE jenis_spk " + " ".join(f"WHEN '{t[4:]}' THEN [{', '.join(repr(x) for x in v)}]" for t, v in _PRINTED.items()) + " END) AS label, CASE jenis_spk WHEN 'survey' THEN 21 WHEN 'instalasi' THEN 18 WHEN 'dismantle' THEN 16 ELSE 17 END AS n_words FROM wo WHERE jenis_spk <> 'maintenance'")
def _image_labels(spark, d):
    """The labels that each work order's images are looked up by."""
    docs = work_orders(spark, d).select("doc_id", classify.document_type(F.col("text")).alias("t"))
    known = {t: rules.image_labels(t.replace("_", " ").upper()) for t in rules.IMAGE_LABELS}
    labels = F.create_map(*[F.lit(x) for t, v in known.items() for x in (t, F.array(*map(F.lit, v)))])
    words = F.create_map(*[F.lit(x) for t, v in known.items() for x in (t, len(rules.section_words(v)))])
    return docs.select("doc_id", F.explode(F.try_element_at(labels, "t")).alias("label"), F.try_element_at(words, "t").alias("n_words"))


def pm_forms(spark, d) -> DataFrame:
    """(doc_id, text): a maintenance form for each part."""
    p = catalog.spread(catalog.table(spark, d, "part"), "p_partkey")
    code = F.lpad((F.pmod("p_partkey", F.lit(16)) + 1).cast("string"), 3, "0")
    volts = F.concat((F.col("p_size") + 20).cast("string"), F.lit(","), F.pmod("p_partkey", F.lit(10)).cast("string"))
    status = F.when(F.pmod("p_partkey", F.lit(3)) == 0, "NOK").otherwise("OK")
    text = F.concat(
        F.lit("No. Dok. : FM-LAP- D2-SOP-003-"), code, F.lit(" Formulir\nPreventive Maintenance "), F.col("p_brand"), F.lit("\nVersi : 1.0\nHal : 1 dari 1\nLabel : Internal\nLocation : Site "),
        F.col("p_partkey"), F.lit("\nBrand / Type : "), F.col("p_brand"), F.lit("\nS/N : "), F.col("p_partkey") + 1000, F.lit("\n1. Physical Check\na. Environment Condition Normal : Clean "), status,
        F.lit("\nb. LED display Normal Normal Condition OK\na. Temperature "), volts, F.lit(" 20 - 25 C "), status, F.lit("\n2. Performance\nDC Input Voltage "), volts, F.lit(" VDC "), status, F.lit("\nNotes : part "), F.col("p_name"), F.lit("\nExecutor\n"),
    )
    return p.select(F.col("p_partkey").alias("doc_id"), text.alias("text"))


_PM = "WITH f AS (SELECT p_partkey AS doc_id, p_brand, p_name, lpad((p_partkey % 16 + 1)::VARCHAR, 3, '0') AS code, (p_size + 20) || ',' || (p_partkey % 10) AS volts, CASE WHEN p_partkey % 3 = 0 THEN 'NOK' ELSE 'OK' END AS status FROM part)"


@query("doctype_code_map", f"{_PM} SELECT doc_id, CASE code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in rules.PM_CODES.items())} END AS form_type FROM f")
def _codes(spark, d):
    return pm_forms(spark, d).select("doc_id", classify.pm_by_code(F.col("text")).alias("form_type"))


@query("roundtrip_pm_header", f"{_PM} SELECT doc_id, 'FM-LAP- D2-SOP-003-' || code AS no_dok, 'Preventive Maintenance ' || p_brand AS judul, '1.0' AS versi, '1 dari 1' AS halaman, 'Internal' AS label, 'Site ' || doc_id AS location, p_brand AS brand_type, (doc_id + 1000)::VARCHAR AS serial_number FROM f")
def _pm_header(spark, d):
    t = F.col("text")
    return pm_forms(spark, d).select("doc_id", forms.header(t).alias("h"), forms.general(t).alias("g")).select("doc_id", "h.*", "g.location", "g.brand_type", "g.serial_number")


CHECKS = (("2.a", "DC Input Voltage", rf"DC Input Voltage\s+({forms.NUMBER}) VDC\s+(OK|NOK)", "48 - 56 VDC"), ("2.b", "Frequency", r"Frequency\s+(\S+)\s+(OK|NOK)", "50 Hz"))


@query("roundtrip_check_items", f"{_PM} SELECT doc_id, '2.a' AS no, volts AS result, '48 - 56 VDC' AS standard, status, replace(volts, ',', '.')::DOUBLE AS number FROM f")
def _checks(spark, d):
    rows = pm_forms(spark, d).select("doc_id", F.explode(forms.check_items(F.col("text"), CHECKS)).alias("c"))
    return rows.select("doc_id", "c.no", "c.result", "c.standard", "c.status", T.decimal(F.col("c.result")).alias("number"))


@query("roundtrip_marker_items", f"{_PM} SELECT doc_id, '1.a' AS no, 'Temperature' AS description, volts AS result, '20 - 25 C' AS standard, status FROM f UNION ALL SELECT doc_id, '1.b', 'LED display', 'Normal', 'Normal Condition', 'OK' FROM f")
def _markers(spark, d):
    block = T.found(F.col("text"), r"(?ims)1\.\s*Physical\s+Check(.*?)(?=^\s*2\.\s*Performance|\z)")
    return pm_forms(spark, d).select("doc_id", F.explode(forms.marker_items(block)).alias("c")).select("doc_id", "c.*")


@query("roundtrip_notes", f"{_PM} SELECT doc_id, 'part ' || p_name AS notes FROM f")
def _notes(spark, d):
    return pm_forms(spark, d).select("doc_id", forms.notes(F.col("text")).alias("notes"))


OPTIONS = (("500VA", "9 A"), ("1000VA", "16 A"), ("2000VA", "33 A"))


@query("roundtrip_capacity_options", "WITH v AS (SELECT p_partkey AS doc_id, p_size % 40 AS s FROM part), n AS (SELECT doc_id, s, CASE WHEN abs(s - 9) <= abs(s - 16) AND abs(s - 9) <= abs(s - 33) THEN '500VA' WHEN abs(s - 16) <= abs(s - 33) THEN '1000VA' ELSE '2000VA' END AS near, CASE WHEN s < 12 THEN '500VA' WHEN s < 25 THEN '1000VA' ELSE '2000VA' END AS bucket FROM v), o AS (SELECT unnest(['500VA', '1000VA', '2000VA']) AS capacity) SELECT doc_id, capacity, CASE WHEN capacity = near THEN s || ',0' ELSE '' END AS result, bucket FROM n, o")
def _capacity(spark, d):
    v = F.concat(F.pmod("p_size", F.lit(40)).cast("string"), F.lit(",0"))
    p = catalog.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), v.alias("v"))
    near = forms.nearest_capacity(F.col("v"), OPTIONS)
    rows = p.select("doc_id", "v", F.explode(forms.capacity_options(F.col("v"), near, F.lit("OK"), OPTIONS)).alias("o"))
    return rows.select("doc_id", "o.capacity", "o.result", forms.magnitude_capacity(F.col("v"), ("500VA", "1000VA", "2000VA")).alias("bucket"))


def _numbers(spark, d, key="supplier", col="s_suppkey"):
    return catalog.spread(catalog.table(spark, d, key).select(F.col(col).alias("doc_id")), "doc_id")


def _lines(n, make):
    """Lines for i = 1..n, joined."""
    return F.array_join(F.transform(F.sequence(F.lit(1), n.cast("int")), make), "\n")


def batteries(spark, d):
    k = F.col("doc_id")
    n = F.pmod(k, F.lit(9)) + 1
    volts = lambda i, side: F.concat(F.lit("1"), F.pmod(k + i + side, F.lit(5)).cast("string"), F.lit(","), F.pmod(k, F.lit(10)).cast("string"))
    rows = lambda side: _lines(n, lambda i: F.concat_ws("\n", F.concat_ws(" ", i.cast("string"), volts(i, side)), F.pmod(k * i + side, F.lit(101)).cast("string")))
    head = lambda kind, b: F.concat(F.lit("Bank : 1 "), F.lit(kind), F.lit("\nBattery Type : VRLA\nBattery Brand : "), F.lit(b), F.lit("\nEnd Device Batt : D"), k.cast("string"), F.lit("\n"))
    text = F.concat(head("UPS", "B1"), head("Recti", "B2"), F.lit("No Voltage SOH\n"), rows(0), F.lit("\n"), rows(1), F.lit("\n* Measurement 1 12,5 80"))
    return _numbers(spark, d).select("doc_id", text.alias("text"))


_BAT = "WITH b AS (SELECT s_suppkey AS doc_id, side, i, '1' || ((s_suppkey + i + side) % 5) || ',' || (s_suppkey % 10) AS voltage, ((s_suppkey * i + side) % 101)::VARCHAR AS soh FROM supplier, (SELECT unnest([0, 1]) AS side), LATERAL (SELECT unnest(range(1, s_suppkey % 9 + 2)) AS i))"


@query("roundtrip_battery_sides", f"{_BAT} SELECT doc_id, CASE side WHEN 0 THEN 'UPS' ELSE 'Recti' END AS side, i::VARCHAR AS no, voltage, soh, 'B1' AS ups_brand, 'D' || doc_id AS recti_device FROM b")
def _battery(spark, d):
    rows = batteries(spark, d).select("doc_id", F.explode(forms.battery_banks(F.col("text"))).alias("b")).select("doc_id", "b", F.explode("b.rows").alias("r"))
    return rows.select("doc_id", "r.side", "r.no", "r.voltage", "r.soh", F.col("b.ups.battery_brand").alias("ups_brand"), F.col("b.recti.end_device_batt").alias("recti_device"))


@query("roundtrip_battery_triplets", f"{_BAT} SELECT doc_id, count(*) AS n, sum(i)::BIGINT AS sum_no, sum(soh::BIGINT)::BIGINT AS sum_soh FROM b GROUP BY doc_id")
def _triplets(spark, d):
    table = F.regexp_replace(F.col("text"), r"(?s)\A.*SOH\n|\n\* Measurement.*\z", "")
    rows = batteries(spark, d).select("doc_id", F.explode(forms.battery_rows(table)).alias("r"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.col("r.no").cast("long")).alias("sum_no"), F.sum(F.col("r.soh").cast("long")).alias("sum_soh"))


@query("battery_measurements", "SELECT s_suppkey AS doc_id, unnest(['1', 'a', 'b', '2']) AS no, unnest(['Voltage of bank', 'Internal resistance', '', 'Load test after load']) AS description, unnest([(10 + s_suppkey % 4) || ',' || s_suppkey % 10, s_suppkey::VARCHAR, 'none', '9']) AS result, unnest(['Min 11,5 V', '≥ 80 mOhm', NULL, '20 - 25 C']) AS operational_standard, unnest(['OK', CASE WHEN s_suppkey % 2 = 0 THEN 'NOK' END, NULL, 'ok']) AS status, (20 + s_suppkey % 9) || ' C' AS temperature, 'B' || s_suppkey AS bank FROM supplier")
def _measurements(spark, d):
    k = F.col("doc_id")
    text = F.concat(
        F.lit("Location : Site\nBattery Temperature : "), 20 + F.pmod(k, F.lit(9)), F.lit(" C Battery Bank : B"), k, F.lit("\n1. outside\nNo. Descriptions Result Operational Standard Status\n1. Voltage of\nbank "), 10 + F.pmod(k, F.lit(4)), F.lit(","), F.pmod(k, F.lit(10)),
        F.lit(" Min 11,5 V OK\na. Internal resistance "), k, F.lit(" ≥ 80 mOhm"), F.when(F.pmod(k, F.lit(2)) == 0, " NOK").otherwise(""), F.lit("\nb. none\n2. Load test\nafter load 9 20 - 25 C\nok\nNotes : x\n3. no item"),
    )
    made = _numbers(spark, d).select("doc_id", F.explode(forms.measurements(text)).alias("m"), forms.battery_information(text).alias("i"))
    return made.select("doc_id", "m.*", F.col("i.battery_temperature").alias("temperature"), F.col("i.battery_bank").alias("bank"))


@query("capacity_choice", "SELECT s_suppkey AS doc_id, CASE s_suppkey % 3 WHEN 0 THEN '2000VA' WHEN 1 THEN '1000VA' ELSE CASE WHEN s_suppkey % 40 <= 12 THEN '500VA' WHEN s_suppkey % 40 <= 24 THEN '1000VA' ELSE '2000VA' END END AS chosen FROM supplier")
def _choice(spark, d):
    """By a mark, by what the item prints, by the number alone."""
    k = F.col("doc_id")
    value = F.concat(F.pmod(k, F.lit(40)), F.lit(",0"))
    options = F.when(F.pmod(k, F.lit(3)) == 0, "9 A (500VA)\n16 A (1000VA)\n✓ 33 A ( 2000VA )").when(F.pmod(k, F.lit(3)) == 1, "16 A\n( 1000VA )").otherwise("16 A")
    text = F.concat(F.lit("a. DC Input 9 A (500VA)\nb. DC Current Input *) "), value, F.lit(" A "), options, F.lit("\nc. Next 33 A (2000VA)\nNotes : none"))
    return _numbers(spark, d).select("doc_id", forms.chosen_capacity(text, "DC Current Input", value, OPTIONS).alias("chosen"))


@query("ups_fields", "SELECT s_suppkey AS doc_id, CASE s_suppkey % 4 WHEN 0 THEN 'APC Smart ' || s_suppkey WHEN 1 THEN '' WHEN 2 THEN '' ELSE 'ICA-' || s_suppkey END AS merk, CASE s_suppkey % 3 WHEN 0 THEN s_suppkey || ' KVA' WHEN 1 THEN s_suppkey || '.5VA' ELSE '' END AS kapasitas FROM supplier")
def _ups(spark, d):
    k = F.col("doc_id")
    brand = F.when(F.pmod(k, F.lit(4)) == 0, F.concat(F.lit("APC Smart "), k, F.lit(" Menggunakan UPS Ya"))).when(F.pmod(k, F.lit(4)) == 1, "Menggunakan UPS Ya").when(F.pmod(k, F.lit(4)) == 2, "Ruangan AC").otherwise(F.concat(F.lit("ICA-"), k))
    size = F.when(F.pmod(k, F.lit(3)) == 0, F.concat(k, F.lit(" KVA"))).when(F.pmod(k, F.lit(3)) == 1, F.concat(k, F.lit(".5VA x"))).otherwise("QUALITY 5")
    text = F.concat(F.lit("Merk UPS : "), brand, F.lit("\nKapasitas UPS : "), size, F.lit("\nQUALITY PARAMETER"))
    return _numbers(spark, d).select("doc_id", checklists.ups(text).alias("u")).select("doc_id", "u.*")


@query("roundtrip_inventory_fsm", "WITH i AS (SELECT s_suppkey AS doc_id, unnest(range(1, s_suppkey % 4 + 2)) AS i FROM supplier) SELECT doc_id, 'Switch ' || chr((64 + i)::INT) || ' (RACK)' AS equipment, i::VARCHAR AS qty, CASE WHEN (doc_id + i) % 2 = 0 THEN 'Active' ELSE 'Shutdown' END AS status, CASE WHEN i % 2 = 0 THEN 'Connect' ELSE 'Not Connect' END AS bonding_ground FROM i")
def _inventory(spark, d):
    k = F.col("doc_id")
    text = _lines(F.pmod(k, F.lit(4)) + 1, lambda i: F.concat_ws("\n", F.concat(F.lit("Switch "), F.chr(64 + i), F.lit("\n(RACK)")), i.cast("string"), F.when(F.pmod(k + i, F.lit(2)) == 0, "Active").otherwise("Shutdown"), F.when(F.pmod(i, F.lit(2)) == 0, "Connect").otherwise("Not Connect")))
    return _numbers(spark, d).select("doc_id", F.explode(forms.inventory(text)).alias("r")).select("doc_id", "r.*")


@query("roundtrip_executors", "WITH i AS (SELECT s_suppkey AS doc_id, unnest(range(1, s_suppkey % 3 + 2)) AS i FROM supplier) SELECT doc_id, i::VARCHAR AS no, 'Worker ' || i AS nama, 'ORG' || doc_id AS mitra FROM i UNION ALL SELECT s_suppkey, '9', 'WorkerB', 'ORG2' FROM supplier")
def _executors(spark, d):
    k = F.col("doc_id")
    people = _lines(F.pmod(k, F.lit(3)) + 1, lambda i: F.concat_ws("\n", i.cast("string"), F.concat(F.lit("Worker "), i.cast("string")), F.concat(F.lit("ORG"), k.cast("string"))))
    text = F.concat(F.lit("No Nama Mitra / Internal Signature\n9 WorkerB ORG2\n"), people, F.lit("\n( ______ )"))
    return _numbers(spark, d).select("doc_id", F.explode(forms.executors(text)).alias("r")).select("doc_id", "r.*")


@query("roundtrip_hh_groups", "WITH i AS (SELECT s_suppkey AS doc_id, unnest(range(1, s_suppkey % 3 + 2)) AS i FROM supplier) SELECT doc_id, 'hh_' || i AS hh, 'kondisi_hh_' || i AS key, 'Baik ' || doc_id AS value FROM i UNION ALL SELECT doc_id, 'hh_' || i, 'lokasi_hh_' || i, NULL FROM i")
def _hh(spark, d):
    k = F.col("doc_id")
    text = _lines(F.pmod(k, F.lit(3)) + 1, lambda i: F.concat(F.lit("Data HH "), i, F.lit("\nKondisi HH-"), i, F.lit("\nBaik "), k, F.lit("\nLokasi HH-"), i))
    return _numbers(spark, d).select("doc_id", F.explode(fields.hh_groups(text)).alias("r")).select("doc_id", "r.*")


LABELS = ("Status Gedung", "PIC BM", "Email PIC", "Alamat")


@query("roundtrip_label_next_line", "SELECT c_custkey AS doc_id, unnest(['status_gedung', 'pic_bm', 'email_pic', 'alamat']) AS key, unnest([c_mktsegment, NULL, 'c' || c_custkey || '@mail.test', c_name]) AS value FROM customer")
def _next_line(spark, d):
    text = F.concat(F.lit("Status Gedung\n"), "c_mktsegment", F.lit("\nPIC BM\nEmail PIC\nmail c"), "c_custkey", F.lit("@mail.test\nAlamat\nold\nAlamat\n"), "c_name")
    rows = catalog.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), fields.label_next_line(text, LABELS).alias("m"))
    return rows.select("doc_id", F.explode("m").alias("key", "value"))


@query("roundtrip_label_inline", "SELECT c_custkey AS doc_id, unnest(['status_gedung', 'pic_bm', 'email_pic', 'alamat']) AS key, unnest([c_mktsegment, c_name, NULL, NULL]) AS value FROM customer")
def _inline(spark, d):
    text = F.concat(F.lit("Status Gedung : "), "c_mktsegment", F.lit("\nPIC BM\n"), "c_name", F.lit("\nEmail PIC\nAlamat"))
    rows = catalog.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), fields.label_inline(text, LABELS).alias("m"))
    return rows.select("doc_id", F.explode("m").alias("key", "value"))


@query("roundtrip_label_prefix", "SELECT c_custkey AS doc_id, unnest(['status_gedung', 'pic_bm']) AS key, unnest([c_mktsegment, c_name]) AS value FROM customer")
def _prefix(spark, d):
    text = F.concat(F.lit("status gedung "), "c_mktsegment", F.lit("\nPIC BM\n"), "c_name", F.lit("\nAlamat"))
    rows = catalog.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), fields.label_prefix(text, LABELS).alias("m"))
    return rows.select("doc_id", F.explode("m").alias("key", "value"))


@query("roundtrip_list_item", "SELECT c_custkey AS doc_id, 'AB-' || c_custkey AS kode, c_mktsegment AS deskripsi FROM customer UNION ALL SELECT c_custkey, 'MODEM', c_name || ', spare' FROM customer")
def _list_item(spark, d):
    text = F.concat(F.lit("List Item :\n- AB-"), "c_custkey", F.lit(" , "), "c_mktsegment", F.lit("\n- MODEM, "), "c_name", F.lit(", spare\n\n- NO , outside"))
    return catalog.table(spark, d, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(fields.list_items(text)).alias("i")).select("doc_id", "i.*")


@query("roundtrip_voltage_table", "SELECT s_suppkey AS doc_id, 220 + s_suppkey % 10 || ' VAC' AS pln_p_n, '1 VAC' AS pln_n_g, 230 + s_suppkey % 7 || ' VAC' AS ups_p_n, 'VAC' AS it_p_n FROM supplier")
def _voltage(spark, d):
    k = F.col("doc_id")
    text = F.concat(F.lit("PLN "), 220 + F.pmod(k, F.lit(10)), F.lit(" VAC 219 VAC 1 VAC UPS "), 230 + F.pmod(k, F.lit(7)), F.lit(" VAC 218 VAC 2 VAC"))
    v = fields.voltage_table(text)
    return _numbers(spark, d).select("doc_id", v["pln"]["p_n"].alias("pln_p_n"), v["pln"]["n_g"].alias("pln_n_g"), v["ups"]["p_n"].alias("ups_p_n"), v["it"]["p_n"].alias("it_p_n"))


@query("roundtrip_devices_noreg", "SELECT s_suppkey AS doc_id, 'Router ' || s_suppkey AS nama_barang, 'B2WN' || lpad(s_suppkey::VARCHAR, 12, '0') AS no_reg FROM supplier UNION ALL SELECT s_suppkey, 'Adapter 12V', 'B2WN' || lpad((s_suppkey + 1)::VARCHAR, 12, '0') FROM supplier")
def _devices(spark, d):
    k = F.col("doc_id")
    text = F.concat(F.lit("Nama Barang Router router "), k, F.lit(" B2WN"), F.lpad(k.cast("string"), 12, "0"), F.lit(" Adapter 12V B2WN"), F.lpad((k + 1).cast("string"), 12, "0"))
    return _numbers(spark, d).select("doc_id", F.explode(fields.devices(text)).alias("r")).select("doc_id", "r.*")


@query("quality_parameters", "SELECT s_suppkey AS doc_id, '-65 dBm' AS standard, '-' || (50 + s_suppkey % 20) || ' dBm' AS existing FROM supplier")
def _quality(spark, d):
    text = F.concat(F.lit("RSL : -65 dBm -"), 50 + F.pmod("doc_id", F.lit(20)), F.lit(" dBm\n"))
    return _numbers(spark, d).select("doc_id", fields.quality_pair(text, "RSL").alias("q")).select("doc_id", "q.*")


# ---- text functions ----------------------------------------------------------------------------
@query("key_normalise", "SELECT p_partkey, replace(replace(replace(replace(replace(replace(lower(p_type || ' (A/B-' || p_size || '.)'), ' ', '_'), '/', '_'), '.', ''), '(', ''), ')', ''), '-', '_') AS key FROM part")
def _key(spark, d):
    return catalog.table(spark, d, "part").select("p_partkey", T.key_of(F.concat("p_type", F.lit(" (A/B-"), "p_size", F.lit(".)"))).alias("key"))


@query("whitespace_clean", r"SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[\r\t]+', ' ', 'g'), ' {2,}', ' ', 'g'), '\n+', chr(10), 'g')) AS h FROM documents")
def _clean(spark, d):
    return catalog.table(spark, d, "documents").select("doc_id", F.md5(T.clean_space(F.col("text"))).alias("h"))


@query("dash_normalise", "SELECT conv_id, turn, md5(translate(text || '−–—―', '−–—―', '----')) AS h FROM conversations")
def _dash(spark, d):
    return catalog.table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.plain_dashes(F.concat("text", F.lit("−–—―")))).alias("h"))


@query("kv_join_normalise", "SELECT c_custkey, 'Nama: ' || c_name || chr(10) || 'Kota: ' || c_mktsegment AS t FROM customer")
def _kv(spark, d):
    raw = F.concat(F.lit("Nama\n:\n"), "c_name", F.lit("\nKota\n: "), "c_mktsegment")
    return catalog.table(spark, d, "customer").select("c_custkey", T.join_key_values(raw).alias("t"))


@query("datetime_parse_tiers", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d-%b-%Y') || ' 18:00' WHEN 1 THEN strftime(o_orderdate, '%d-%b-%Y') ELSE '18:00' END AS t, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 18:00' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') || ' 00:00' END AS typed FROM orders")
def _tiers(spark, d):
    day = F.date_format("o_orderdate", "dd-MMM-yyyy")
    o = catalog.table(spark, d, "orders")
    raw = F.when(F.pmod("o_orderkey", F.lit(3)) == 0, F.concat(F.lit("x "), day, F.lit("18:00"))).when(F.pmod("o_orderkey", F.lit(3)) == 1, F.concat(day, F.lit(" x"))).otherwise("x 18:00")
    t = T.date_time_text(raw)
    return o.select("o_orderkey", t.alias("t"), F.date_format(T.stamp(t), "yyyy-MM-dd HH:mm").alias("typed"))


@query("date_time_zip", "SELECT o_orderkey, strftime(o_orderdate, '%d-%b-%Y') || ' 08:00' AS a, strftime(o_orderdate, '%d-%b-%Y') || ' 09:30' AS b, '01-Jan-2000' AS c FROM orders")
def _zip(spark, d):
    day = F.date_format("o_orderdate", "dd-MMM-yyyy")
    z = T.zip_dates(F.concat(day, F.lit(" "), day, F.lit(" 01-Jan-2000 jam 08:00 jam 09:30")))
    return catalog.table(spark, d, "orders").select("o_orderkey", F.get(z, F.lit(0)).alias("a"), F.get(z, F.lit(1)).alias("b"), F.get(z, F.lit(2)).alias("c"))


@query("comma_decimal_cast", "SELECT l_orderkey, l_linenumber, sum(l_quantity + l_linenumber / 10.0) AS v FROM lineitem GROUP BY ALL")
def _comma(spark, d):
    raw = F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(","), F.col("l_linenumber").cast("string"))
    return catalog.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.sum(T.decimal(raw)).alias("v"))


@query("path_relativise", "SELECT p_partkey, 'foto/' || p_brand || '/' || p_partkey || '.jpg' AS rel, p_partkey || '.jpg' AS name FROM part")
def _path(spark, d):
    p = F.concat(F.lit("/data/out/foto\\"), "p_brand", F.lit("/"), "p_partkey", F.lit(".jpg"))
    return catalog.table(spark, d, "part").select("p_partkey", T.relative_path(p, "/data/out").alias("rel"), T.file_name(p).alias("name"))


@query("folder_name", "SELECT o_orderkey, 'pmpop/form_pm_ac/pm_ac_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') AS folder FROM orders")
def _folder(spark, d):
    return catalog.table(spark, d, "orders").select("o_orderkey", sinks.output_folder(F.lit("form_pm_ac"), F.lit("pmpop"), F.col("o_orderdate")).alias("folder"))


# ---- layout ------------------------------------------------------------------------------------
def tokens(spark, d) -> DataFrame:
    """(doc_id, idx, text, x, y): a printed table for each order; a token for each line number."""
    o = catalog.spread(catalog.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.col("o_custkey").alias("c")), "doc_id")
    k = F.col("doc_id")
    rows = [("Nama Pelanggan", F.lit(40.0), F.lit(100.0)), (":", F.lit(180.0), F.lit(100.0)), (F.concat(F.lit("CUSTOMER "), "c"), F.lit(200.0), F.lit(102.0)), ("Kota", F.lit(40.0), F.lit(130.0)), ("POWER", F.lit(60.0), F.lit(400.0)),
            ("OK", F.lit(480.0), F.lit(405.0)), (F.concat(F.lit("ON"), F.pmod(k, F.lit(7))), F.lit(300.0), F.lit(402.0)), ("GREEN", F.lit(700.0), F.lit(430.0)), (F.concat(F.lit("B2WN"), F.lpad(k.cast("string"), 10, "0")), F.lit(100.0), F.lit(600.0)), (F.concat(F.lit("B2WN"), F.lpad((k + 1).cast("string"), 10, "0")), 500.0 + F.pmod(k, F.lit(3)), F.lit(600.0)), ("Kota", F.lit(45.0), F.lit(700.0))]
    made = F.array(*[F.struct((F.lit(t) if isinstance(t, str) else t).alias("text"), x.cast("double").alias("x"), y.alias("y")) for t, x, y in rows])
    return o.select("doc_id", F.posexplode(made).alias("idx", "t")).select("doc_id", "idx", "t.*")


@query("reading_order", "SELECT o_orderkey AS doc_id, 'Nama Pelanggan > : > CUSTOMER ' || o_custkey || ' > Kota > POWER > ON' || (o_orderkey % 7) || ' > OK > GREEN' AS t FROM orders")
def _order(spark, d):
    r = layout.reading_order(tokens(spark, d)).where("rank <= 8")
    return r.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " > ").alias("t"))


@query("spatial_map_lastwins", "SELECT o_orderkey AS doc_id, 45.0::DOUBLE AS x, 700.0::DOUBLE AS y, 10 AS idx, 3 AS first_idx FROM orders")
def _spatial(spark, d):
    return layout.spatial_map(tokens(spark, d)).where("key = 'kota'").select("doc_id", "x", "y", "idx", "first_idx")


@query("value_after_label_band", "SELECT o_orderkey AS doc_id, 'CUSTOMER ' || o_custkey AS value FROM orders")
def _after(spark, d):
    return layout.value_after_label(tokens(spark, d), ("Nama Pelanggan", "Kota")).where("label = 'nama pelanggan'").select("doc_id", "value")


@query("row_band_fields", "SELECT o_orderkey AS doc_id, 'ON' || (o_orderkey % 7) AS standard, 'OK' AS nms_engineer, NULL::VARCHAR AS hasil_akhir FROM orders")
def _row_band(spark, d):
    return layout.row_band(tokens(spark, d), ("POWER",)).select("doc_id", "standard", "nms_engineer", "hasil_akhir")


@query("column_band", "SELECT o_orderkey AS doc_id, 'ON' || (o_orderkey % 7) || ' OK' AS standard, '' AS existing FROM orders")
def _column_band(spark, d):
    return layout.column_band(tokens(spark, d), ("POWER",)).select("doc_id", "standard", "existing")


@query("column_band_split", "SELECT o_orderkey AS doc_id, 'left' AS side, 'B2WN' || lpad(o_orderkey::VARCHAR, 10, '0') AS text FROM orders UNION ALL SELECT o_orderkey, 'right', 'B2WN' || lpad((o_orderkey + 1)::VARCHAR, 10, '0') FROM orders")
def _split(spark, d):
    return layout.column_split(tokens(spark, d), fields.WIRELESS_REG).select("doc_id", "side", "text")


@query("exclusion_context_anti", "SELECT o_orderkey AS doc_id, 45.0::DOUBLE AS x FROM orders")
def _exclusion(spark, d):
    return layout.labels_without_context(tokens(spark, d), "kota", "pelanggan").select("doc_id", "x")


@query("bbox_to_rect", "SELECT s_suppkey, s_suppkey::DOUBLE AS x0, 2.0::DOUBLE AS y0, s_suppkey + 9.0::DOUBLE AS x1, 8.0::DOUBLE AS y1 FROM supplier")
def _rect(spark, d):
    k = F.col("s_suppkey").cast("double")
    box = F.array(F.array(k + 9, F.lit(2.0)), F.array(k, F.lit(3.0)), F.array(k + 1, F.lit(8.0)))
    return catalog.table(spark, d, "supplier").select("s_suppkey", layout.rectangle(box).alias("r")).select("s_suppkey", "r.*")


@query("crop_plan", "WITH h AS (SELECT s_suppkey AS doc_id FROM supplier) SELECT doc_id, 'A' AS label, 1 AS page, 85.0::DOUBLE AS y0, 470.0::DOUBLE AS y1 FROM h UNION ALL SELECT doc_id, 'B', 1, 485.0, 1000.0 FROM h UNION ALL SELECT doc_id, 'B', 2, 0.0, 1000.0 FROM h UNION ALL SELECT doc_id, 'B', 3, 0.0, 370.0 FROM h UNION ALL SELECT doc_id, 'C', 3, 385.0, 1000.0 FROM h")
def _crops(spark, d):
    h = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(p).alias("page"), F.lit(y).alias("y")) for n, p, y in (("A", 1, 100.0), ("B", 1, 500.0), ("C", 3, 400.0))]))
    return layout.crop_plan(_numbers(spark, d).select("doc_id", h.alias("h")).select("doc_id", "h.*"))


@query("ocr_decode", "SELECT s_suppkey AS doc_id, 0 AS idx, 'T' || s_suppkey AS text, 15.0::DOUBLE AS y, s_suppkey::DOUBLE AS x FROM supplier")
def _ocr(spark, d):
    k = F.col("doc_id")
    box = F.array(F.array(k, F.lit(10)), F.array(k + 5, F.lit(10)), F.array(k + 5, F.lit(20)), F.array(k, F.lit(20)))
    js = F.to_json(F.struct(F.array(F.concat(F.lit("T"), k), F.lit("")).alias("rec_texts"), F.array(F.lit(0.9), F.lit(0.8)).alias("rec_scores"), F.array(box, box).alias("rec_polys")))
    return layout.decode_tokens(_numbers(spark, d).select("doc_id", js.alias("result"))).select("doc_id", "idx", "text", "y", "x")


@query("ocr_shapes", "SELECT s_suppkey AS doc_id, shape, 'T' || s_suppkey AS text, CASE WHEN shape = 3 THEN 1.0 ELSE 0.5 END::DOUBLE AS score, 15.0::DOUBLE AS y, s_suppkey::DOUBLE AS x FROM supplier, (SELECT unnest([0, 1, 2, 3]) AS shape)")
def _ocr_shapes(spark, d):
    box = F.format_string("[[%1$d,10],[%1$d,10],[%1$d,20],[%1$d,20]]", F.col("doc_id"))
    said = F.concat(F.lit('"T'), "doc_id", F.lit('"'))
    lists = lambda t, s, b: F.concat(F.lit(f'{{"{t}":['), said, F.lit(f',""],"{s}":[0.5],"{b}":['), box, F.lit(","), box, F.lit("]}"))
    shapes = F.array(lists("rec_texts", "rec_scores", "dt_polys"), F.concat(F.lit("["), lists("rec_text", "rec_score", "rec_polys"), F.lit("]")), F.concat(F.lit("[[["), box, F.lit(",["), said, F.lit(",0.5]]]]")), F.concat(F.lit("[[["), box, F.lit(","), said, F.lit("],[[[1,2]],\"short\"]]]")))
    rows = _numbers(spark, d).select("doc_id", F.posexplode(shapes).alias("shape", "result"))
    return layout.decode_tokens(rows).select("doc_id", "shape", "text", "score", "y", "x")


@query("device_name_boxes", "SELECT o_orderkey AS doc_id, 'B2WN' || lpad(o_orderkey::VARCHAR, 10, '0') AS no_reg, 'left' AS side, 'Router C' || o_custkey AS name FROM orders UNION ALL SELECT o_orderkey, 'B2WN' || lpad((o_orderkey + 1)::VARCHAR, 10, '0'), 'right', 'Modem FO' FROM orders")
def _device_boxes(spark, d):
    o = catalog.spread(catalog.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey"), "doc_id")
    reg = lambda n: F.concat(F.lit("B2WN"), F.lpad((F.col("doc_id") + n).cast("string"), 10, "0"))
    token = lambda t, x, y: F.struct(t.alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y"))
    made = F.array(
        token(F.lit("Router"), 100.0, 570.0), token(F.concat(F.lit("C"), "o_custkey"), 180.0, 570.0), token(F.lit("Lantai 2"), 190.0, 572.0), token(F.lit("02-Jan-2024"), 200.0, 574.0), token(reg(0), 110.0, 600.0), token(F.lit("between"), 450.0, 580.0),
        token(F.lit("x"), 640.0, 565.0), token(F.lit("Modem"), 620.0, 560.0), token(F.lit("FO"), 600.0, 580.0), token(F.concat(F.lit("No.Reg:"), reg(1), F.lit("/2")), 630.0, 600.0), token(F.lit("far"), 100.0, 300.0), token(F.lit("border"), 100.0, 540.0),
    )
    return layout.device_names(o.select("doc_id", F.posexplode(made).alias("idx", "t")).select("doc_id", "idx", "t.*"), fields.WIRELESS_REG)


# ---- questions ---------------------------------------------------------------------------------
FORMS = (
    "berapa spk untuk {n}", "sebutkan", "detail spk {o}", "pop nya apa?", "jelaskan prosedur pemasangan", "halo", "sebutkan spk survey", "kapan aktivasi untuk nomor {n}",
    "siapa teknisi pada {o}", "apa nama pelanggan {n}", "tanggal tersebut kapan selesai ya", "list pekerjaan instalasi {n}", "berapa", "lihat semua lokasi dan alamat",
)


def questions(spark, d) -> DataFrame:
    """(id, q, ctx_network, ctx_order, counted): a question for each order, some with context."""
    s = catalog.spk(spark, d)
    q = F
    for i, f in enumerate(FORMS):
        q = q.when(F.pmod("id_spk", F.lit(len(FORMS))) == i, F.replace(F.replace(F.lit(f), F.lit("{n}"), F.col("no_jaringan")), F.lit("{o}"), F.col("no_spk")))
    return s.select(F.col("id_spk").alias("id"), q.alias("q"), F.when(F.pmod("id_spk", F.lit(3)) != 0, F.col("no_jaringan")).alias("ctx_network"), F.when(F.pmod("id_spk", F.lit(5)) == 0, F.col("no_spk")).alias("ctx_order"), (F.pmod("id_spk", F.lit(4)) == 0).alias("counted"))


_QS = f"""{catalog.ORACLE}, q0 AS (SELECT id_spk AS id, replace(replace([{", ".join(f"'{f}'" for f in FORMS)}][(id_spk % {len(FORMS)} + 1)::INT], '{{n}}', no_jaringan), '{{o}}', no_spk) AS q,
  CASE WHEN id_spk % 3 <> 0 THEN no_jaringan END AS ctx_network, CASE WHEN id_spk % 5 = 0 THEN no_spk END AS ctx_order, id_spk % 4 = 0 AS counted FROM spk),
qs AS (SELECT *, lower(trim(q)) AS l, nullif(regexp_extract(q, '\\b(\\d{{10}})\\b', 1), '') AS net, nullif(regexp_extract(q, '([0-9]{{6}}/[A-Za-z-]+/\\d{{4}})', 1), '') AS ord FROM q0)"""


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(l, '{w}')" for w in words) + ")"


def _in(words) -> str:
    return "l IN (" + ", ".join(f"'{w}'" for w in words) + ")"


_N, _S = "coalesce(net, ctx_network) IS NOT NULL", "coalesce(ord, ctx_order) IS NOT NULL"
_RULES = [
    ("R0", f"len(string_split(l, ' ')) <= 2 AND ({' OR '.join(f"starts_with(l, '{w}')" for w in rules.SHORT_STARTS)}) AND ({_N} OR {_S})", f"CASE WHEN {_in(rules.SHORT_LIST)} THEN 'LIST_SPK' WHEN {_in(rules.SHORT_COUNT)} THEN 'COUNT_SPK' ELSE 'SPECIFIC_QUERY' END", 0.98),
    ("R0.5", "ord IS NOT NULL", f"CASE WHEN {_any(rules.VENDOR_WORDS)} THEN 'GET_VENDOR_TEKNISI' WHEN {_any(rules.DETAIL_WORDS)} THEN 'GET_SPK_DETAIL' ELSE 'SPECIFIC_QUERY' END", 0.98),
    ("R1", f"counted AND ({_N} OR {_S}) AND {_any(rules.AFTER_COUNT)}", "'LIST_SPK'", 0.95),
    ("R2", f"{_any(rules.ORDER_WORDS)} AND {_N}", f"CASE WHEN {_any(rules.COUNT_WORDS)} THEN 'COUNT_SPK' WHEN {_any(rules.LIST_WORDS)} THEN 'LIST_SPK' ELSE 'SPECIFIC_QUERY' END", 0.95),
    ("R3", f"{_any(rules.REFERENCES)} AND ({_N} OR {_S})", "'SPECIFIC_QUERY'", 0.90),
    ("R4", f"{_any(rules.FACT_WORDS)} AND ({_N} OR {_S} OR net IS NOT NULL OR ord IS NOT NULL)", "'SPECIFIC_QUERY'", 0.85),
    ("R5", _any(rules.HOW_WORDS), "'GENERAL_INFO'", 0.90),
    ("default", "true", "'GENERAL_INFO'", 0.70),
]


@query("intent_cascade", f"{_QS}, r AS (SELECT id, q, CASE {' '.join(f"WHEN {c} THEN {t}" for _, c, t, _ in _RULES)} END AS type, CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c, _, _ in _RULES)} END AS rule, CASE {' '.join(f"WHEN {c} THEN {p}::DOUBLE" for _, c, _, p in _RULES)} END AS confidence FROM qs) SELECT id, type, rule, confidence, CASE WHEN rule IN ('R5', 'default') THEN 'RAG' ELSE 'SQL' END AS strategy FROM r")
def _intent(spark, d):
    return questions(spark, d).select("id", nlq.intent(F.col("q"), F.col("ctx_network"), F.col("ctx_order"), F.col("counted")).alias("i")).select("id", "i.*")


@query("entity_extract", f"{_QS} SELECT id, net AS network, ord AS \"order\" FROM qs")
def _entities(spark, d):
    return questions(spark, d).select("id", nlq.network_of(F.col("q")).alias("network"), nlq.order_of(F.col("q")).alias("order"))


_NET, _ORD = "coalesce(net, ctx_network)", "coalesce(ord, ctx_order)"
_LLM = f"""(({_any(rules.LLM_REFERENCES)} AND NOT (contains(l, 'berapa') AND contains(l, 'spk') AND ({_N} OR {_S}))) OR {_any(rules.LLM_HOW)}
  OR regexp_full_match(l, '(pop|teknisi|vendor|lokasi|alamat)\\s+(nya|apa)\\??|(siapa|kapan|dimana)\\s+\\w+\\??')
  OR ({_any(rules.VENDOR_WORDS)} AND NOT contains(l, 'spk') AND {_S}) OR (NOT ({_N} OR {_S}) AND NOT {_any(rules.GREETINGS)}))"""
_KIND = "CASE " + " ".join(f"WHEN contains(l, '{k}') THEN '{k}'" for k in rules.LIST_KINDS) + " END"
_WHEN = "CASE " + " ".join(f"WHEN contains(l, '{k}') THEN '{k}'" for k in ("survey", "instalasi", "aktivasi")) + " END"


@query("pattern_or_llm", f"{_QS} SELECT id, CASE WHEN {_LLM} THEN 'llm' WHEN contains(l, 'berapa') AND contains(l, 'spk') AND {_N} THEN 'count_spk' WHEN ({_any(('spk', 'sebutkan', 'list'))}) AND {_N} THEN coalesce('list_spk_' || {_KIND}, 'list_spk') WHEN contains(l, 'pelanggan') AND {_N} AND contains(l, 'apa') THEN 'customer_info' WHEN contains(l, 'kapan') AND {_WHEN} IS NOT NULL AND {_N} THEN 'latest_' || {_WHEN} ELSE 'fallback' END AS template FROM qs")
def _pattern(spark, d):
    n, s = F.coalesce(nlq.network_of(F.col("q")), F.col("ctx_network")), F.coalesce(nlq.order_of(F.col("q")), F.col("ctx_order"))
    return questions(spark, d).select("id", nlq.template_of(F.col("q"), n, s).alias("template"))


@query("sql_extract_from_llm", f"{catalog.ORACLE} SELECT id_spk, 'SELECT no_spk FROM spk WHERE id_spk = ' || id_spk || ' AND is_deleted = 0' AS sql FROM spk")
def _extract(spark, d):
    reply = F.concat(F.lit("Here is the SQL:\n```sql\nSELECT no_spk FROM spk WHERE id_spk = "), "id_spk", F.lit(" AND is_deleted = 0;\n```\nDone."))
    return catalog.spk(spark, d).select("id_spk", nlq.sql_of_reply(reply).alias("sql"))


STATEMENTS = (
    ("SELECT * FROM spk WHERE no_jaringan = '0000000085' AND is_deleted = 0", "forbidden: DELETE", 0, 3),
    ("SELECT * FROM spk WHERE no_jaringan = '123'; DROP TABLE spk; --", "forbidden: DROP", 2, 4),
    ("UPDATE spk SET is_deleted = 1 WHERE id_spk = 1", "not a SELECT", 3, 1),
    ("SELECT * FROM spk UNION SELECT * FROM users", "no is_deleted", 2, 4),
    ("SELECT COUNT(*) as total FROM spk WHERE is_deleted = 0", "forbidden: DELETE", 0, 1),
    ("SELECT * FROM unknown_table WHERE id = 1", "no allowed table", 1, 2),
)


def _statements(spark, d):
    """A statement of one of the forms for each order, with its own numbers in it."""
    o = catalog.spk(spark, d)
    forms_ = F.array(*[F.lit(s) for s, *_ in STATEMENTS])
    own = F.get(forms_, F.pmod("id_spk", F.lit(len(STATEMENTS))).cast("int"))
    for old, new in (("'0000000085'", F.concat(F.lit("'"), "no_jaringan", F.lit("'"))), ("'123'", F.concat(F.lit("'"), "no_jaringan", F.lit("'"))), ("id_spk = 1", F.concat(F.lit("id_spk = "), "id_spk"))):
        own = F.replace(own, F.lit(old), new)
    return o.select(F.col("id_spk").alias("id"), own.alias("sql"))


def _by_form(values: list[str]) -> str:
    return f"CASE o_orderkey % {len(STATEMENTS)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


@query("sql_gate_string", f"SELECT o_orderkey AS id, {_by_form([f"'{r}'" if r else 'NULL::VARCHAR' for _, r, _, _ in STATEMENTS])} AS reason, {_by_form([e for _, _, e, _ in STATEMENTS])} AS n_errors FROM orders")
def _gate(spark, d):
    return _statements(spark, d).select("id", sqlgate.gate(F.col("sql")).alias("reason"), F.size(sqlgate.strict_errors(F.col("sql"))).alias("n_errors"))


@query("sql_lint_warnings", f"SELECT o_orderkey AS id, {_by_form([w for *_, w in STATEMENTS])} AS n_warnings FROM orders")
def _lint(spark, d):
    return _statements(spark, d).select("id", F.size(sqlgate.lint(F.col("sql"))).alias("n_warnings"))


@query("sql_sanitised", f"{catalog.ORACLE} SELECT id_spk, 'SELECT no_spk FROM spk WHERE id_spk = ' || id_spk AS sql, md5({"'Write one SELECT statement for this schema.' || chr(10) || 'spk(id_spk)' || chr(10) || 'Question: spk ' || no_spk || chr(10) || 'SQL:'"}) AS prompt FROM spk")
def _sanitised(spark, d):
    sql = F.concat(F.lit("  SELECT no_spk\n  FROM spk\tWHERE id_spk = "), "id_spk", F.lit(";; "))
    return catalog.spk(spark, d).select("id_spk", sqlgate.sanitise(sql).alias("sql"), F.md5(nlq.sql_prompt(F.concat(F.lit("spk "), "no_spk"), "spk(id_spk)")).alias("prompt"))


@query("asked_order", f"{catalog.ORACLE} SELECT id_spk, CASE WHEN id_spk % 2 = 0 THEN no_spk ELSE '000001/WO-LA/1999' END AS no_spk FROM spk")
def _asked_order(spark, d):
    return catalog.spk(spark, d).select("id_spk", nlq.asked_order_of(F.concat(F.lit("bandingkan 000001/WO-LA/1999 dengan "), F.when(F.pmod("id_spk", F.lit(2)) == 0, "nomor SPK ").otherwise(""), "no_spk")).alias("no_spk"))


# ---- conversations -----------------------------------------------------------------------------
def talk(spark, d) -> DataFrame:
    """conversations with a network or an order mentioned in some turns."""
    c = catalog.table(spark, d, "conversations")
    net = F.lpad((F.col("conv_id") * 10 + F.col("turn")).cast("string"), 10, "0")
    order = F.concat(F.lpad(F.col("turn").cast("string"), 6, "0"), F.lit("/WO-LA/1997"))
    said = F.when(F.pmod("turn", F.lit(3)) == 0, F.concat("text", F.lit(" jaringan "), net)).when(F.pmod("turn", F.lit(3)) == 1, F.concat("text", F.lit(" ditemukan "), order)).otherwise(F.col("text"))
    return c.withColumn("text", said)


_TALK = "WITH t AS (SELECT conv_id, turn, role, CASE turn % 3 WHEN 0 THEN text || ' jaringan ' || lpad((conv_id * 10 + turn)::VARCHAR, 10, '0') WHEN 1 THEN text || ' ditemukan ' || lpad(turn::VARCHAR, 6, '0') || '/WO-LA/1997' ELSE text END AS text FROM conversations), e AS (SELECT *, nullif(regexp_extract(text, '\\b(\\d{10})\\b', 1), '') AS net, nullif(regexp_extract(text, '([0-9]{6}/[A-Za-z-]+/\\d{4})', 1), '') AS ord FROM t)"


@query("history_last_k", f"{_TALK} SELECT conv_id, turn, string_agg(role || ': ' || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS history FROM t")
def _history(spark, d):
    return conversation.last_turns(talk(spark, d), 5).select("conv_id", "turn", "history")


@query("carry_forward_entity", f"{_TALK} SELECT conv_id, turn, last_value(CASE WHEN role = 'assistant' THEN ord END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS last_order FROM e")
def _carry(spark, d):
    return conversation.carry_forward(talk(spark, d), nlq.order_of(F.col("text")), "last_order").select("conv_id", "turn", "last_order")


@query("context_override_epochs", f"{_TALK}, n AS (SELECT *, last_value(net IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctx_network FROM e), c AS (SELECT *, CASE WHEN ctx_network IS DISTINCT FROM lag(ctx_network) OVER (PARTITION BY conv_id ORDER BY turn) THEN 1 ELSE 0 END AS new FROM n), p AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS epoch FROM c) SELECT conv_id, turn, ctx_network, last_value(ord IGNORE NULLS) OVER (PARTITION BY conv_id, epoch ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ctx_order FROM p")
def _epochs(spark, d):
    return conversation.context_epochs(talk(spark, d), nlq.network_of(F.col("text")), nlq.order_of(F.col("text"))).select("conv_id", "turn", "ctx_network", "ctx_order")


@query("history_count_flag", f"{_TALK} SELECT conv_id, turn, coalesce(bool_or(contains(lower(text), 'ditemukan') OR contains(lower(text), 'ada ') OR contains(lower(text), ' spk')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), false) AS last_was_count FROM t")
def _count_flag(spark, d):
    return conversation.after_count(talk(spark, d)).select("conv_id", "turn", "last_was_count")


@query("cache_fifo_dedup", "SELECT md5(lower(trim(event_type || (user_id % 400)))) AS cache_key, min(event_id) AS seq FROM events GROUP BY 1 ORDER BY seq DESC LIMIT 1000")
def _cache(spark, d):
    e = catalog.table(spark, d, "events")
    return conversation.newest_keys(e, "event_id", conversation.question_key(F.concat("event_type", F.col("user_id") % 400)))


#: Customers come back after their keys were pushed out: 60 keys of more than a hundred.
_FIFO = """WITH l AS (SELECT list(md5(o_custkey::VARCHAR) || ':' || o_orderkey ORDER BY o_orderkey) AS l FROM orders),
f AS (SELECT list_reduce(list_transform(l, lambda x: [x]), lambda held, x: CASE WHEN list_contains(list_transform(held, lambda y: split_part(y, ':', 1)), split_part(x[1], ':', 1)) THEN held ELSE list_append(held, x[1])[-60:] END, []::VARCHAR[]) AS f FROM l)
SELECT split_part(x, ':', 1) AS cache_key, split_part(x, ':', 2)::BIGINT AS seq FROM (SELECT unnest(f) AS x FROM f)"""


@query("cache_fifo_exact", _FIFO)
def _cache_exact(spark, d):
    o = catalog.table(spark, d, "orders")
    return conversation.fifo_cache(o, "o_orderkey", F.md5(F.col("o_custkey").cast("string")), most=60, rows=4000)


@query("history_fifo_cap", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def _cap(spark, d):
    return conversation.keep_last(catalog.table(spark, d, "events").select("event_id", "event_type"), "event_id", 500)


@query("prompt_last_k_text", f"{_TALK}, h AS (SELECT conv_id, turn, text, string_agg(role || ': ' || coalesce(text, ''), chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS history FROM t) SELECT conv_id, turn, md5('Answer from the data only.' || chr(10) || CASE WHEN length(trim(text, ' ')) > 100 AND text <> 'Tidak ada data' THEN 'Data:' || chr(10) || text ELSE 'Data: Tidak ada data' END || chr(10) || 'History:' || chr(10) || history || chr(10) || 'Question: q') AS h FROM h")
def _prompt(spark, d):
    t = conversation.last_turns(talk(spark, d), 3)
    return t.select("conv_id", "turn", F.md5(conversation.prompt(F.lit("q"), F.col("text"), F.col("history"), strict=True)).alias("h"))


@query("nearest_history_cosine", "WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings), h AS (SELECT * FROM v ORDER BY vec_id DESC LIMIT 500), p AS (SELECT v.vec_id, h.vec_id AS m, h.label, list_cosine_similarity(v.e, h.e) AS s, row_number() OVER (PARTITION BY v.vec_id ORDER BY list_cosine_similarity(v.e, h.e) DESC, h.vec_id) AS r FROM v JOIN h ON v.vec_id <> h.vec_id) SELECT vec_id, CASE WHEN s >= 0.4 THEN m END AS match_id, CASE WHEN s >= 0.4 THEN round(s, 6) END AS similarity FROM p WHERE r = 1")
def _nearest(spark, d):
    v = catalog.table(spark, d, "embeddings")
    out = conversation.nearest_before(v, conversation.keep_last(v, "vec_id", 500), "vec_id", "embedding", "label", 0.4)
    return out.select("vec_id", "match_id", F.round("similarity", 6).alias("similarity"))


@query("show_first_10_and_more", f"{catalog.ORACLE}, r AS (SELECT no_jaringan, no_spk, row_number() OVER (PARTITION BY no_jaringan ORDER BY tanggal_spk, id_spk) AS rn, count(*) OVER (PARTITION BY no_jaringan) AS n FROM spk) SELECT no_jaringan, any_value(n) AS n_rows, string_agg(no_spk, chr(10) ORDER BY rn) || CASE WHEN any_value(n) > 10 THEN chr(10) || '... and ' || (any_value(n) - 10) || ' more' ELSE '' END AS shown FROM r WHERE rn <= 10 GROUP BY no_jaringan")
def _first10(spark, d):
    return conversation.first_rows_and_more(catalog.spk(spark, d), "no_jaringan", ["tanggal_spk", "id_spk"], F.col("no_spk"))


@query("count_verification", f"{catalog.ORACLE} SELECT no_jaringan, count(*) AS n, abs(count(*) - 10) <= 2 AS ok FROM spk GROUP BY no_jaringan")
def _count_check(spark, d):
    return catalog.spk(spark, d).groupBy("no_jaringan").agg(F.count("*").alias("n")).withColumn("ok", conversation.count_is_valid(F.col("n"), F.lit(10)))


_TABLE_TEXTS = (
    "TABLE jaringan (PK no_jaringan)\n  - no_jaringan VARCHAR(100)\n  - nama_pelanggan VARCHAR(255)\n  - lokasi_pelanggan TEXT\n  - jasa VARCHAR(100)\n  - media_akses VARCHAR(100)\n  - kecepatan VARCHAR(255)\n  - pop TEXT\n  - tgl_rfs_la DATE\n  - tgl_rfs_plg DATE\n  - is_deleted BOOLEAN",
    "TABLE spk (PK id_spk)\n  - id_spk BIGINT\n  - no_spk VARCHAR(100)\n  - no_jaringan VARCHAR(100)\n  - document_type ENUM\n  - jenis_spk ENUM\n  - tanggal_spk DATE\n  - no_mr VARCHAR(100)\n  - no_fps VARCHAR(100)\n  - is_deleted BOOLEAN",
    "TABLE spk_execution_info (PK id_execution)\n  - id_execution BIGINT\n  - id_spk BIGINT\n  - latitude DECIMAL(9,6)\n  - longitude DECIMAL(10,6)\n  - pic_pelanggan VARCHAR(255)\n  - kontak_pic_pelanggan VARCHAR(20)\n  - teknisi VARCHAR(255)\n  - nama_vendor VARCHAR(255)",
)


@query("schema_prompt", "SELECT o_orderkey AS id, md5('Write one SELECT statement for this schema.' || chr(10) || CASE o_orderkey % 3 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(_TABLE_TEXTS)) + " END || chr(10) || 'Question: spk ' || o_orderkey || chr(10) || 'SQL:') AS prompt FROM orders")
def _schema(spark, d):
    """A prompt for each order's question over the one table that it asks about."""
    asked = F.array(*[F.lit(catalog.schema_text((t,))) for t in ("jaringan", "spk", "spk_execution_info")])
    schema = F.get(asked, F.pmod("id_spk", F.lit(3)).cast("int"))
    return catalog.spk(spark, d).select(F.col("id_spk").alias("id"), F.md5(nlq.sql_prompt(F.concat(F.lit("spk "), "id_spk"), schema)).alias("prompt"))


# ---- evaluation and sources --------------------------------------------------------------------
def _truth_parsed(spark, d):
    p = catalog.table(spark, d, "part").select(F.col("p_partkey").alias("doc_id"), "p_name", "p_brand", "p_type")
    one = lambda changed: F.explode(F.map_from_arrays(F.array(F.lit("name"), F.lit("brand"), F.lit("type")), F.array(F.when(F.pmod("doc_id", F.lit(4)) == 0, F.concat(F.lit("xx"), "p_name")).otherwise(F.col("p_name")) if changed else F.col("p_name"), F.col("p_brand"), F.upper("p_type") if changed else F.col("p_type")))).alias("field", "value")
    return p.select("doc_id", one(False)), p.select("doc_id", one(True)).where("NOT (field = 'brand' AND doc_id % 7 = 0)")


_EVAL = "WITH f AS (SELECT p_partkey AS doc_id, lower(trim(p_name)) AS name, lower(trim(p_brand)) AS brand FROM part), s AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 1 - levenshtein(name, 'xx' || name) / greatest(length(name), length(name) + 2)::DOUBLE ELSE 1 END AS a, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE 1 END AS b FROM f), c AS (SELECT doc_id, (a >= 0.9)::INT + (b >= 0.9)::INT + 1 AS correct FROM s)"


@query("field_accuracy_levenshtein", f"{_EVAL} SELECT doc_id, 3::BIGINT AS total_fields, correct::BIGINT AS correct, (3 - correct)::BIGINT AS incorrect, round(100.0 * correct / 3, 2)::DOUBLE AS accuracy FROM c")
def _accuracy(spark, d):
    t, p = _truth_parsed(spark, d)
    return evaluate.accuracy(evaluate.compare_fields(t, p, S.edit_ratio))


@query("field_accuracy_ratcliff")
def _ratcliff(spark, d):
    t, p = _truth_parsed(spark, d)
    return evaluate.accuracy(evaluate.compare_fields(t, p, S.block_ratio))


@query("field_details", "SELECT p_partkey AS doc_id, 'brand' AS field, p_brand AS ground_truth, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_brand END AS parsed, p_partkey % 7 <> 0 AS correct FROM part")
def _details(spark, d):
    t, p = _truth_parsed(spark, d)
    one = F.element_at("details", F.lit("brand"))
    return evaluate.details(evaluate.compare_fields(t, p, S.edit_ratio)).select("doc_id", F.lit("brand").alias("field"), one["ground_truth"].alias("ground_truth"), one["parsed"].alias("parsed"), one["correct"].alias("correct"))


@query("page_text_predicate", r"SELECT page_id, length(regexp_replace(html, '[\n \t]', '', 'g')) >= 20 AS has_text FROM pages")
def _has_text(spark, d):
    return catalog.table(spark, d, "pages").select("page_id", pages.has_text(F.col("html")).alias("has_text"))


@query("page_assembly", "SELECT conv_id AS doc, md5(string_agg(coalesce(text, '') || chr(10), '' ORDER BY turn)) AS h FROM conversations GROUP BY conv_id")
def _assembly(spark, d):
    rows = catalog.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), "text")
    return pages.whole_text(rows, "doc").select("doc", F.md5("text").alias("h"))


@query("event_line_sink", "SELECT event_id, 'data: {\"token\":\"' || event_type || '\"}' || chr(10) || chr(10) AS line FROM events")
def _events_line(spark, d):
    return catalog.table(spark, d, "events").select("event_id", sinks.event_line(F.col("event_type")).alias("line"))


@query("event_window_counts", "SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _windows(spark, d):
    e = catalog.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.event_counts(e).select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("keyword_counts", "SELECT doc_id, (contains(lower(text), 'the') AND true)::INT + contains(lower(text), 'license')::INT + contains(lower(text), 'und')::INT AS hits FROM documents")
def _keywords(spark, d):
    return catalog.table(spark, d, "documents").select("doc_id", classify.count_in(F.lower("text"), ("the", "license", "und")).alias("hits"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest work order of each kind for each network, with customer, technician and vendor."""
    return QUERIES["latest_spk_by_jenis"](spark, sf_dir)


# ---- checklists and records --------------------------------------------------------------------
from fieldquarry.operators import checklists, records  # noqa: E402
from fieldquarry.sources import endpoints  # noqa: E402


def site_checklists(spark, d) -> DataFrame:
    """(doc_id, text): a wireline checklist for each order."""
    s, j = catalog.spk(spark, d), catalog.jaringan(spark, d).drop("is_deleted")
    k, day = F.col("id_spk"), F.date_format("tanggal_spk", "dd-MMM-yyyy")
    text = F.concat(
        F.lit("FORM CHECKLIST WIRELINE\nNama Pelanggan : "), "nama_pelanggan", F.lit(" Contact Person : PIC\nNomor Jaringan : "), "no_jaringan", F.lit("\nAlamat : Jl. "), k, F.lit(" Kota : "), "lokasi_pelanggan",
        F.lit("\nPropinsi : No SPK\nTanggal ： "), day, F.lit("\nJam Perintah "), day, F.lit(" 08:00 "), day, F.lit(" 08:10 "), day, F.lit(" 08:20 "), day, F.lit("\nLatitude : -6.2 Longitude : .\nPosisi Modem di Lt. : 2 Ruang : Server\n"),
        F.lit("1. Output Tegangan\nP-N "), 220 + F.pmod(k, F.lit(9)), F.lit(" VAC . VAC 221 VAC\nP-G 219 VAC\nGrounding Bar terkoneksi ke : Gedung\nENVIRONMENT\nAC Pendingin Ruangan : Ada\nSuhu Ruangan Perangkat : "), 20 + F.pmod(k, F.lit(5)),
        F.lit("\nMERK UPS : APC\nKapasitas : 10 KVA\nLINE CHECKLIST\nSite Area\nKabel RJ-11 Baik\nPhone Box : "), "jenis_spk", F.lit("\nHRB\nKabel Data OK\nTes Konektivitas\nTest Ping "), k, F.lit(" ms\nRSL\n--\nStandard\n-65 dBm\nNama Barang Router A B2WX"), F.lpad(k.cast("string"), 10, "0"), F.lit("\nNama Barang Modem B"),
    )
    return catalog.spread(s.join(j, "no_jaringan"), "id_spk").select(k.alias("doc_id"), text.alias("text"))


_CL = f"{catalog.ORACLE}, cl AS (SELECT s.id_spk AS doc_id, s.*, j.nama_pelanggan, j.lokasi_pelanggan, strftime(tanggal_spk, '%d-%b-%Y') AS day FROM spk s JOIN jaringan j USING (no_jaringan))"


@query("checklist_remote_data", f"{_CL} SELECT doc_id, nama_pelanggan, 'PIC' AS contact_person, no_jaringan AS nomor_jaringan, 'Jl. ' || doc_id AS alamat, lokasi_pelanggan AS kota, '' AS propinsi, day AS tanggal FROM cl")
def _remote(spark, d):
    return site_checklists(spark, d).select("doc_id", checklists.remote_data(F.col("text")).alias("r")).select("doc_id", "r.nama_pelanggan", "r.contact_person", "r.nomor_jaringan", "r.alamat", "r.kota", "r.propinsi", "r.tanggal")


@query("checklist_clocks", f"{_CL} SELECT doc_id, day || ' 08:00' AS jam_perintah, day || ' 08:20' AS jam_berangkat, day AS jam_tiba_di_lokasi, '' AS jam_mulai_kerja, '' AS jam_pulang FROM cl")
def _clocks(spark, d):
    return site_checklists(spark, d).select("doc_id", checklists.clocks(F.col("text")).alias("r")).select("doc_id", "r.jam_perintah", "r.jam_berangkat", "r.jam_tiba_di_lokasi", "r.jam_mulai_kerja", "r.jam_pulang")


@query("checklist_electrical", f"{_CL} SELECT doc_id, (220 + doc_id % 9) || ' VAC' AS pn_pln, '' AS pn_ups, '221 VAC' AS pn_it, '219 VAC' AS pg_pln, 'Gedung' AS grounding_bar, 'Ada' AS ac, (20 + doc_id % 5) || '°' AS suhu, '-6.2' AS latitude, '' AS longitude, 'Server' AS ruang FROM cl")
def _electrical(spark, d):
    t = F.col("text")
    rows = site_checklists(spark, d).select("doc_id", checklists.electrical(t).alias("e"), checklists.environment(t).alias("v"), checklists.location(t).alias("l"))
    return rows.select("doc_id", F.col("e.p_n.pln").alias("pn_pln"), F.col("e.p_n.ups").alias("pn_ups"), F.col("e.p_n.it").alias("pn_it"), F.col("e.p_g.pln").alias("pg_pln"), "e.grounding_bar", "v.ac", "v.suhu", "l.latitude", "l.longitude", "l.ruang")


@query("checklist_line_items", f"{_CL}, i AS (SELECT doc_id, unnest(['Kabel RJ-11', 'Phone Box', 'Kabel Data', 'Test Ping']) AS item, unnest(['Baik', jenis_spk, 'OK', doc_id || ' ms']) AS value FROM cl) SELECT * FROM i")
def _line_items(spark, d):
    return site_checklists(spark, d).select("doc_id", F.explode(checklists.line_items(F.col("text"))).alias("i")).where("i.value <> ''").select("doc_id", "i.item", "i.value")


@query("checklist_scalars", f"{_CL} SELECT doc_id, 'APC' AS merk, '10 KVA' AS kapasitas, '-65 dBm' AS rsl, true AS wireline, 'Modem B' AS second_column FROM cl")
def _scalars(spark, d):
    t = F.col("text")
    return site_checklists(spark, d).select("doc_id", checklists.scalar_field(t, r"MERK\s+UPS", ("kapasitas",)).alias("merk"), checklists.scalar_field(t, "Kapasitas", unit="KVA|VA|W").alias("kapasitas"), checklists.quality_row(t, "RSL").alias("rsl"), checklists.is_wireline(t).alias("wireline"), checklists.device_columns(t)["second"].alias("second_column"))


@query("device_continuations", "SELECT s_suppkey AS doc_id, 'Firewall HW AND WARRANTY KIT' || chr(10) || 'Router ' || s_suppkey AS names FROM supplier")
def _continuations(spark, d):
    names = F.concat(F.lit("Firewall HW AND\nWARRANTY KIT Router "), "doc_id")
    return _numbers(spark, d).select("doc_id", checklists.join_continuations(names).alias("names"))


#: Device tables: what is printed before, between and behind the numbers, and the names that are read, by order.
DEVICES = (
    (("C.DATA PERANGKAT EXISTING Nama Barang No.Reg S/N ROUTER {c} ", " + Antena\nModem {s} ", " S/N 0815"), ("ROUTER {c} Antena Modem", "+ Antena Modem {s}")),
    (("CABUT Nama Barang Firewall HW AND ", " WARRANTY ADAPTOR {c} ", " ADAPTOR 12V"), ("Firewall HW AND WARRANTY", "ADAPTOR {c}")),
    (("Nama Barang PSU ", "\nFG-50E BOX {s} ", " CABUT"), ("PSU", "FG-50E BOX {s}")),
    (("", " ADAPTOR POWER 12 ", " Kit"), ("ADAPTOR POWER 12 Kit",)),
    (("PENGGANTI PASANG BARU |Switch {c} ", " BLACK , Kabel {s} ", ""), ("Switch {c} BLACK Kabel BLACK", ", Kabel {s}")),
)


def _device_rows() -> str:
    """The names as rows (kind, part, name) of DuckDB."""
    return ", ".join(f"({k}, {len(parts) - 1 - len(names) + i}, '{n}')" for k, (parts, names) in enumerate(DEVICES) for i, n in enumerate(names))


@query("device_items", f"WITH k(kind, part, name) AS (VALUES {_device_rows()}) SELECT o_orderkey AS doc_id, part + 1 AS item, 'B2WN' || lpad((o_orderkey + part)::VARCHAR, 10, '0') AS no_reg, replace(replace(name, '{{c}}', 'C' || o_custkey), '{{s}}', 'T' || o_orderkey % 100) AS nama_barang FROM orders JOIN k ON kind = o_orderkey % {len(DEVICES)}")
def _device_items(spark, d):
    o = catalog.spread(catalog.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_custkey"), "doc_id")
    reg = lambda n: F.concat(F.lit("B2WN"), F.lpad((F.col("doc_id") + n).cast("string"), 10, "0"))
    text = F
    for k, (parts, _) in enumerate(DEVICES):
        made = F.concat(F.lit(parts[0]), reg(0), F.lit(parts[1]), reg(1), F.lit(parts[2]))
        text = text.when(F.pmod("doc_id", F.lit(len(DEVICES))) == k, made)
    text = F.replace(F.replace(text, F.lit("{c}"), F.concat(F.lit("C"), "o_custkey")), F.lit("{s}"), F.concat(F.lit("T"), F.col("doc_id") % 100))
    items = o.select("doc_id", F.explode(checklists.device_items(text)).alias("i"))
    at = (F.substring("i.no_reg", 5, 10).cast("long") - F.col("doc_id") + 1).cast("int")
    return items.select("doc_id", at.alias("item"), "i.no_reg", "i.nama_barang")


@query("parser_status_lookup", f"{_PM} SELECT doc_id, CASE WHEN code IN ('002', '003', '013', '014', '015') THEN 'planned' WHEN code <> '016' THEN 'active' END AS status, CASE WHEN code <> '016' THEN 'pmpop' END AS category FROM f")
def _status(spark, d):
    """What the registry says of each form's type."""
    forms_ = pm_forms(spark, d).select("doc_id", classify.pm_by_code(F.col("text")).alias("document_type"))
    return forms_.join(F.broadcast(records.parser_status(spark)), "document_type", "left").select("doc_id", "status", "category")


@query("parse_records", f"{_WO} SELECT id_spk AS doc_id, CASE WHEN jenis_spk = 'maintenance' THEN 'unknown' ELSE 'spk_' || jenis_spk END AS document_type, CASE WHEN jenis_spk = 'maintenance' THEN 'unknown_document_type' ELSE 'success' END AS parsing_status, CASE WHEN jenis_spk <> 'maintenance' THEN no_spk END AS no_spk FROM wo")
def _records(spark, d):
    out = records.parse(work_orders(spark, d))
    return out.select("doc_id", "document_type", "parsing_status", F.get_json_object("parsed", "$.spk.no_spk").alias("no_spk"))


@query("parse_forms", f"{_PM} SELECT doc_id, CASE WHEN code IN ('002', '003', '013', '014', '015') THEN 'not_implemented' WHEN code = '016' THEN 'unknown_document_type' ELSE 'success' END AS parsing_status, CASE WHEN code NOT IN ('002', '003', '013', '014', '015', '016') THEN '1.0' END AS versi FROM f")
def _parse_forms(spark, d):
    return records.parse(pm_forms(spark, d)).select("doc_id", "parsing_status", F.get_json_object("parsed", "$.header.versi").alias("versi"))


def letter_counts(texts: list[str | None]) -> list[list[float]]:
    """An embedding without a model: how often each of a to z is in a text, as floats."""
    return [[float((t or "").count(chr(97 + i))) for i in range(26)] for t in texts]


@query("endpoint_answers", "SELECT conv_id, turn, length(text) - length(replace(text, 'a', '')) AS a, length(text) - length(replace(text, 'z', '')) AS z, length(regexp_replace(text, '[^a-z]', '', 'g')) AS letters FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)")
def _answers(spark, d):
    rows = catalog.table(spark, d, "conversations").select("conv_id", "turn", "text")
    made = endpoints.embed(rows, "text", letter_counts)
    count = lambda c: c.cast("long")
    return made.select("conv_id", "turn", count(F.col("embedding")[0]).alias("a"), count(F.col("embedding")[25]).alias("z"), count(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)).alias("letters"))


@query("cache_usage", "SELECT event_type, count(*) AS entries, round(count(*) * 100.0 / 1000, 2)::DOUBLE AS percent FROM events GROUP BY event_type")
def _usage(spark, d):
    return conversation.usage(catalog.table(spark, d, "events"), "event_type", 1000).withColumn("percent", F.col("percent").cast("double"))


@query("label_hits", "SELECT o_orderkey AS doc_id, 'nama-pelanggan' AS label, 'Nama Pelanggan' AS text FROM orders")
def _label_hits(spark, d):
    labels = spark.createDataFrame([("nama-pelanggan",), ("FOTO LOKASI",)], "label string")
    return headings.find_labels(tokens(spark, d), labels).select("doc_id", "label", "text")


@query("json_paths", "SELECT s_suppkey AS doc_id, '{\"a\":[{\"patch_foto\":\"spk/foto ' || s_suppkey || '.jpg\",\"no\":1}],\"OutPath\":\"/other/' || s_suppkey || '\",\"text\":\"/data/public/x\"}' AS record FROM supplier")
def _json_paths(spark, d):
    record = F.concat(F.lit('{"a":[{"patch_foto":"/data/public/spk\\\\foto '), "doc_id", F.lit('.jpg","no":1}],"OutPath":"/other/'), "doc_id", F.lit('","text":"/data/public/x"}'))
    return _numbers(spark, d).select("doc_id", T.relative_paths(record, "/data/public/").alias("record"))


def indoor_checklists(spark, d) -> DataFrame:
    """(doc_id, text): an indoor checklist for each supplier; every third without its meter part."""
    k = F.col("doc_id")
    text = F.concat(
        F.lit("NDOORAREA CHECKLIST\nQuality Parameter Standard\nPOWER\nMerek : x\nGreen "), F.pmod(k, F.lit(5)), F.lit("\nModem OFF 109/DCD/LINK-WAN\nTD/TXD/103 Blinking\nRTS105\nCTS/106\nAlarm LED Off\nAll STU Modem Quality A No Counter CRC Error\nTainet Scorpio Connected xxx KBps Connected\nKBps\nOptical LED Alarm "),
        k, F.lit("\nSTU 160\n> 20 dB\n"), F.when(F.pmod(k, F.lit(3)) != 0, "(Checked by AVO Meter)\nSTU 1088/2304\n400-700 Ω (Tlkm Area)\nTainet\n50–200 Ω (HRB Area)\nAdtran Express 48-50 VDc (QUAD\nCES SHDSL)\n").otherwise(""), F.lit("OUTDOOR AREA"),
    )
    return _numbers(spark, d).select("doc_id", text.alias("text"))


_INDOOR = (
    ("indikator_modem", "POWER", "'Green ' || k % 5", ""), ("indikator_modem", "109/DCD/LINK-WAN", "'OFF'", ""), ("merek", "TD/TXD/103", "'Blinking'", ""), ("merek", "Alarm LED", "'Off'", ""), ("merek", "All STU Modem", "'Quality A No Counter CRC Error'", ""),
    ("merek", "Tainet Scorpio", "'Connected xxx KBps'", ""), ("modem_fo", "Optical LED Alarm", "k::VARCHAR", ""), ("lc_signal_kop", "STU 160", "'> 20 dB'", ""), ("lc_signal_avo", "STU 1088/2304", "'400-700 Ω (Tlkm Area)'", "Ω"),
    ("lc_signal_avo", "Tainet", "'50–200 Ω (HRB Area)'", "Ω"), ("lc_signal_avo", "Adtran Express", "'48-50 VDc (QUAD CES SHDSL)'", ""),
)


def _indoor_sql() -> str:
    """All rows, those without a value too."""
    held = {(p, n): (v, e) for p, n, v, e in _INDOOR}
    rows = []
    for p, n in rules.INDOOR:
        v, e = held.get((p, n), ("''", ""))
        there = "k % 3 <> 0" if p == "lc_signal_avo" else "true"
        rows.append(f"SELECT k AS doc_id, '{p}' AS bagian, '{n}' AS parameter, CASE WHEN {there} THEN {v} ELSE '' END AS standard, CASE WHEN {there} THEN '{e}' ELSE '' END AS nms_engineer, '{'Connected KBps' if n == 'Tainet Scorpio' else ''}' AS on_site_teknisi FROM (SELECT s_suppkey AS k FROM supplier)")
    return " UNION ALL ".join(rows)


@query("checklist_indoor", _indoor_sql())
def _indoor(spark, d):
    rows = indoor_checklists(spark, d).select("doc_id", F.explode(checklists.indoor(F.col("text"))).alias("r"))
    return rows.select("doc_id", "r.bagian", "r.parameter", "r.standard", "r.nms_engineer", "r.on_site_teknisi")


@query("indoor_by_bands", "SELECT o_orderkey AS doc_id, 'POWER' AS parameter, 'ON' || (o_orderkey % 7) AS standard, 'OK' AS nms_engineer FROM orders UNION ALL SELECT o_orderkey, 'Alarm LED', 'Off', '' FROM orders")
def _indoor_bands(spark, d):
    text = F.lit("INDOOR AREA CHECKLIST Quality Parameter\nPOWER Green\nAlarm LED Off\n")
    rows = catalog.table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(checklists.indoor(text)).alias("r")).select("doc_id", "r.*")
    bands = layout.row_band(tokens(spark, d), ("POWER",))
    return checklists.prefer_bands(rows, bands, "parameter", {n: n for n in checklists.ROW}).where("standard <> ''").select("doc_id", "parameter", "standard", "nms_engineer")


@query("voltage_rows", "SELECT s_suppkey AS doc_id, (220 + s_suppkey % 9) || ' VAC' AS pln, '' AS ups, CASE WHEN s_suppkey % 2 = 0 THEN '221 VAC' ELSE '' END AS it FROM supplier")
def _voltage_rows(spark, d):
    one = F.concat(F.lit("Output Tegangan\nP-N "), 220 + F.pmod("doc_id", F.lit(9)), F.lit(" VAC"))
    text = F.when(F.pmod("doc_id", F.lit(2)) == 0, F.concat(one, F.lit("\n. VAC\n221 VAC\nP-G 1 VAC"))).otherwise(F.concat(one, F.lit("\nP-G 1 VAC")))
    return _numbers(spark, d).select("doc_id", checklists.electrical(text)["p_n"].alias("v")).select("doc_id", "v.*")


from fieldquarry import queries_documents, queries_streams  # noqa: E402, F401  (they register their queries)
