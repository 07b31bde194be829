"""Queries over document files and page layouts that Spark makes of the base tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldquarry.operators import headings, layout, rules
from fieldquarry.plans import catalog
from fieldquarry.registry import query
from fieldquarry.sources import blobs, paged, pages, shared
from fieldquarry.sources.pdf import write as pdf_of

# ---- page files --------------------------------------------------------------------------------
_PAGES = """WITH c AS (SELECT c_custkey AS k, 'SPK SURVEY' || chr(10) || 'Nama Pelanggan : ' || c_name || ' (' || c_mktsegment || ')' AS first_page, c_comment FROM (SELECT *, 'é→ ' || c_nationkey AS c_comment FROM customer)),
p AS (SELECT k, unnest(range(1, k % 4 + 2)) AS page, k % 4 + 1 AS n_pages, first_page, c_comment FROM c WHERE k % 50 <> 7),
t AS (SELECT k, page, n_pages, CASE WHEN page = 1 THEN first_page WHEN page = 2 THEN c_comment ELSE 'Lampiran ' || page || ' untuk pelanggan ' || k END AS text FROM p)"""


def page_files(spark, d):
    """A folder of PDF files, one for each customer; every fiftieth is cut short."""
    c = catalog.spread(catalog.table(spark, d, "customer"), "c_custkey")
    k = F.col("c_custkey")
    first = F.concat(F.lit("SPK SURVEY\nNama Pelanggan : "), "c_name", F.lit(" ("), "c_mktsegment", F.lit(")"))
    more = F.transform(F.sequence(F.lit(2), F.pmod(k, F.lit(4)).cast("int") + 1, F.lit(1)), lambda i: F.when(i == 2, F.concat(F.lit("é→ "), "c_nationkey")).otherwise(F.concat(F.lit("Lampiran "), i, F.lit(" untuk pelanggan "), k)))
    texts = F.when(F.pmod(k, F.lit(4)) == 0, F.array(first)).otherwise(F.concat(F.array(first), more))
    made = c.select(F.concat(F.lit("c"), k, F.lit(".pdf")).alias("name"), texts.alias("pages"), (F.pmod(k, F.lit(50)) == 7).alias("cut"))

    def files(batches):
        for b in batches:
            out = [pdf_of(t) for t in b["pages"]]
            b["content"] = [x[: len(x) // 2] if cut else x for x, cut in zip(out, b["cut"], strict=True)]
            yield b[["name", "content"]]

    folder = shared.work_folder(spark, "pdf")
    blobs.write_files(made.mapInPandas(files, "name string, content binary"), folder, "overwrite")
    return folder


def _key():
    return F.regexp_extract("path", r"/c(\d+)\.pdf$", 1).cast("long").alias("k")


@query("pdf_pages", f"{_PAGES} SELECT k, page::INTEGER AS page, n_pages::INTEGER AS n_pages, text, len(regexp_replace(text, '[\n\t ]', '', 'g')) >= 20 AS has_text, false AS failed FROM t UNION ALL SELECT c_custkey, 0, NULL, NULL, false, true FROM customer WHERE c_custkey % 50 = 7")
def _pdf_pages(spark, d):
    rows = paged.read_pages(spark, page_files(spark, d), "*.pdf")
    return rows.select(_key(), "page", "n_pages", "text", pages.has_text(F.col("text")).alias("has_text"), F.col("error").isNotNull().alias("failed"))


@query("pdf_first_pages", f"{_PAGES} SELECT k, n_pages::INTEGER AS n_pages, text FROM t WHERE page = 1")
def _pdf_first(spark, d):
    return pages.first_pages(paged.read_pages(spark, page_files(spark, d), "*.pdf")).select(_key(), "n_pages", "text")


# ---- crops -------------------------------------------------------------------------------------
#: Shape of a page: a heading at a tenth of its height each (label, page, y); 60 words unless few.
_CASES = {
    0: ((("FOTO LOKASI", 1, 300.0), ("Hasil Aktivasi", 3, 500.0)), ()),
    1: ((("FOTO LOKASI", 1, 300.0), ("BOQ FO", 3, 100.0)), ()),
    2: ((("FOTO LOKASI", 1, 300.0), ("DATA SPLITTER", 2, 600.0)), ()),
    3: ((("FOTO LOKASI", 2, 10.0), ("FOTO LOKASI", 3, 400.0), ("DATA SPLITTER", 4, 200.0)), ()),
    4: ((("FOTO LOKASI", 1, 300.0), ("DATA SPLITTER", 2, 600.0), ("DATA HH BARU", 4, 100.0)), (2,)),
    5: ((("FOTO LOKASI", 1, 300.0), ("Hasil Aktivasi", 1, 700.0), ("DATA HH BARU", 2, 220.0), ("DATA HH BARU", 2, 420.0)), ()),
}
_CROPS = {
    0: (("FOTO LOKASI", 1, 285, 1000), ("FOTO LOKASI", 2, 0, 1000), ("Hasil Aktivasi", 3, 485, 1000), ("Hasil Aktivasi", 4, 0, 1000)),
    1: (("FOTO LOKASI", 1, 285, 1000), ("FOTO LOKASI", 2, 0, 1000)),
    2: (("FOTO LOKASI", 1, 285, 1000), ("FOTO LOKASI", 2, 0, 570)),
    3: (("FOTO LOKASI", 2, 0, 1000), ("FOTO LOKASI", 3, 0, 1000)),
    4: (("FOTO LOKASI", 1, 285, 1000), ("FOTO LOKASI", 2, 0, 1000), ("FOTO LOKASI", 3, 0, 1000)),
    5: (("FOTO LOKASI", 1, 285, 1000),),
}
_IMAGE_LABELS = ("FOTO LOKASI", "Hasil Aktivasi")


def _headed(spark, d):
    """(found, pages) of four pages for each supplier; what stands on them follows six cases in turn."""
    s = catalog.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    case = F.pmod("doc_id", F.lit(len(_CASES)))
    rows = F.lit(None)
    few = F.lit(False)
    for k, (heads, short) in _CASES.items():
        made = F.array(*[F.struct(F.lit(n).alias("text"), F.lit(p).alias("page"), F.lit(y).alias("y")) for n, p, y in heads])
        rows = F.when(case == k, made).otherwise(rows)
        few = few | ((case == k) & F.col("page").isin(*short)) if short else few
    tokens = s.select("doc_id", F.explode(rows).alias("t")).select("doc_id", "t.*")
    words = rules.section_words(_IMAGE_LABELS) + rules.IMAGE_TOP_STOPS
    labels = spark.createDataFrame([(w,) for w in dict.fromkeys(words)], "label string")
    found = headings.find_labels(tokens, labels).select("doc_id", "page", "label", "y")
    pages_ = s.select("doc_id", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page"))
    return found, pages_.withColumn("n_words", F.when(few, 5).otherwise(60))


def _crop_rows(y=lambda v: f"{v}.0::DOUBLE"):
    return " UNION ALL ".join(f"SELECT s_suppkey AS doc_id, '{n}' AS label, {p} AS page, {y(a)} AS y0, {y(b)} AS y1 FROM supplier WHERE s_suppkey % {len(_CASES)} = {k}" for k, rows in _CROPS.items() for n, p, a, b in rows)


@query("continued_crops", _crop_rows())
def _continued(spark, d):
    return headings.continued_crops(*_headed(spark, d), _IMAGE_LABELS)


WIDTH, HEIGHT = 16, 100
_RASTER = "list_aggregate(list_transform(range(y0, y1), lambda y: rpad(doc_id || ':' || page || ':' || y, 16, '.')), 'string_agg', '')"


def rasters(spark, d):
    """(doc_id, page, image): a grey raster (PGM) of each page."""
    s = catalog.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"), F.explode(F.sequence(F.lit(1), F.lit(4))).alias("page"))
    lines = F.transform(F.sequence(F.lit(0), F.lit(HEIGHT - 1)), lambda y: F.rpad(F.concat_ws(":", "doc_id", "page", y.cast("string")), F.lit(WIDTH), F.lit(".")))
    return s.select("doc_id", "page", F.concat(F.lit(f"P5\n{WIDTH} {HEIGHT}\n255\n"), F.array_join(lines, "")).cast("binary").alias("image"))


@query(
    "crop_files",
    f"WITH c AS (SELECT doc_id, label, page, (y0 / 10)::INT AS y0, (y1 / 10)::INT AS y1 FROM ({_crop_rows(str)})) SELECT doc_id, replace(lower(label), ' ', '_') || '_hal' || page || '.pgm' AS name, strlen('P5' || chr(10) || '16 ' || (y1 - y0) || chr(10) || '255' || chr(10)) + 16 * (y1 - y0) AS n_bytes, sha256('P5' || chr(10) || '16 ' || (y1 - y0) || chr(10) || '255' || chr(10) || {_RASTER}) AS digest FROM c".replace("(y0 / 10)", "floor(y0 / 10.0)").replace("(y1 / 10)", "ceil(y1 / 10.0)"),
)
def _crop_files(spark, d):
    plan = headings.continued_crops(*_headed(spark, d), _IMAGE_LABELS)
    crops = layout.crop_images(plan, rasters(spark, d))
    name = F.concat_ws("/", F.concat(F.lit("d"), "doc_id"), layout.crop_name(F.col("label"), F.col("page"), "pgm"))
    folder = shared.work_folder(spark, "crops")
    blobs.write_files(blobs.distinct_names(crops.select(name.alias("name"), "doc_id", "page", "image"), "doc_id", "page").withColumnRenamed("image", "content"), folder)
    files = blobs.read_files(spark, folder)
    part = F.regexp_extract("name", r"^d(\d+)/([^/]+)$", 1).cast("long")
    return files.select(part.alias("doc_id"), F.regexp_extract("name", r"^d(\d+)/([^/]+)$", 2).alias("name"), F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


# ---- sections with wrong letters ---------------------------------------------------------------
_SECTIONS = """WITH s AS (SELECT s_suppkey AS doc_id, s_suppkey % 3 AS r FROM supplier)
SELECT doc_id, unnest(['indoor', 'line', 'devices']) AS section, unnest([1, 5, 8]) AS first_line, unnest([4, 7, 9]) AS last_line, unnest([4, 3, 2]) AS hits FROM s WHERE r < 2
UNION ALL SELECT doc_id, 'devices', 8, 9, 2 FROM s WHERE r = 2"""


@query("sections_with_errors", _SECTIONS)
def _sections(spark, d):
    """Of three documents one has sound headings, one has two wrong letters in each, one has too many in two of them."""
    r = F.pmod("doc_id", F.lit(3))
    pick = lambda *t: F.when(r == 0, t[0]).when(r == 1, t[1]).otherwise(t[2])
    lines = F.array(
        F.lit("CHECKLIST umum"), pick("A. INDOOR AREA CHECKLIST", "A. NDO0RAREA CHECKLIST", "A. 1NDQQR ARFA CHECKLIST"), F.lit("POWER on STANDARD"), F.lit("line by line"), F.lit("Modem QUALITY"),
        pick("B. LINE CHECKLIST", "B LINE CHECKL1SI", "B. L1NF CHFCKL1ST"), F.lit("Tes Konektivitas"), F.lit("HRB"), pick("C. DATA PERANGKAT", "C.DATAPERANGKAI", "C. DATA PERANGKAT"), F.lit("Existing lalu Cabut"), F.lit("D. VERIFIKASI"), F.lit("EXISTING CABUT"),
    )
    s = catalog.table(spark, d, "supplier").select(F.col("s_suppkey").alias("doc_id"))
    return headings.sections(s.select("doc_id", F.posexplode(lines).alias("line_no", "text")), rules.WIRELINE_SECTIONS)
