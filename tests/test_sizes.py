"""What large tables need: plans that gather nothing on the driver or in one task, and queries that differ once caches are full."""

import re

import pytest
from pyspark.sql import functions as F

from fieldquarry import queries, queries_documents, queries_streams
from fieldquarry.functions import text as T
from fieldquarry.operators import checklists, classify, conversation, fields, forms, headings, layout, records, rules
from fieldquarry.sources import blobs

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def stored_tokens(spark, tmp_path):
    """Tokens that `explode` makes of a small file, so that their size is guessed too small."""
    spark.range(50).write.parquet(str(tmp_path / "docs"))
    words = F.array(*[F.struct(F.lit(t).alias("text"), F.lit(x).alias("x"), F.lit(y).alias("y")) for t, x, y in (("POWER", 60.0, 400.0), ("ON", 300.0, 402.0), ("Nama Pelanggan", 40.0, 600.0))])
    docs = spark.read.parquet(str(tmp_path / "docs")).select(F.col("id").alias("doc_id"))
    return docs.select("doc_id", F.posexplode(words).alias("idx", "t")).select("doc_id", "idx", "t.*")


def test_bands_are_not_broadcast(spark, tmp_path):
    df = layout.column_band(stored_tokens(spark, tmp_path), ("POWER",))
    assert "Broadcast" not in plan_of(df)
    assert {(r.standard, r.existing) for r in df.collect()} == {("ON", "")} and df.count() == 50


def test_label_hits_broadcast_only_labels(spark, tmp_path):
    labels = spark.createDataFrame([("nama-pelanggan",), ("FOTO LOKASI",)], "label string")
    df = headings.find_labels(stored_tokens(spark, tmp_path), labels)
    plan = plan_of(df)
    assert "BroadcastHashJoin [__text" not in plan and not re.search(r"BroadcastHashJoin \[size[^\n]*BuildLeft", plan)
    assert df.count() == 50


def test_more_labels_than_are_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(headings, "MANY_LABELS", 1)
    labels = spark.createDataFrame([("nama-pelanggan",), ("pow",), ("o",), ("FOTO LOKASI",)], "label string")
    df = headings.find_labels(stored_tokens(spark, tmp_path), labels)
    assert not re.search(r"BroadcastHashJoin \[size\S*, gram", plan_of(df))
    assert {(r.text, r.label) for r in df.collect()} == {("Nama Pelanggan", "nama-pelanggan"), ("POWER", "pow"), ("POWER", "o"), ("ON", "o")}


def test_newest_keys_keep_their_first_request(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a"), (5, None), (6, None)], "seq long, k string")
    assert [(r.cache_key, r.seq) for r in conversation.newest_keys(df, "seq", F.col("k"), most=3).collect()] == [(None, 5), ("c", 3), ("b", 2)]


@pytest.mark.parametrize("made", [queries.work_orders, queries.surveys, queries.pm_forms, queries.tokens, queries.site_checklists, queries.batteries])
def test_documents_of_a_small_file_are_spread(spark, made):
    """One file of one row group is read by one task; what is made of its rows must not be."""
    assert made(spark, SF).rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize(
    "made,pattern,most",
    [
        (checklists.clocks, r"\bJum\b", 1), (checklists.location, r"\bJum\b", 1), (checklists.electrical, "Output", 2), (classify.document_type, "SOP-003", 1), (fields.vendor, r"\R", 1),
        (lambda t: forms.header(t)["versi"], "(?i)Versi", 2), (forms.marker_items, r"\s(OK|NOK)\s*\z", 3),
    ],
)
def test_a_value_is_computed_once(spark, made, pattern, most):
    """Expressions that name a value several times bind it: a pattern runs over a text once, or twice where it is tested first."""
    plan = spark.range(1).select(F.concat(F.col("id").cast("string"), F.lit("x")).alias("t")).select(made(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(pattern) <= most


def test_label_lines_by_their_first_letters(spark):
    text = "STATUS gedung : Baik\nStatus Gedung\nalamat\nPIC BM - Budi\nAlamat = Jl. X\nstatus gedungan : y"
    row = spark.createDataFrame([(text,)], "t string").select(fields.label_inline(F.col("t"), ("Status Gedung", "PIC BM", "Alamat", "Email PIC")).alias("x")).head().x
    assert row == {"status_gedung": "Baik", "pic_bm": "Budi", "alamat": "PIC BM - Budi", "email_pic": None}


def test_strip_takes_what_the_pattern_takes(spark):
    """Around a letter and alone, each character of the first plane; and no pattern in the plan."""
    c = F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')")
    rows = spark.range(0xD800).unionByName(spark.range(0xE000, 0xFFFE)).select(F.explode(F.array(c, F.concat(c, F.lit("a"), c, c, F.lit("b"), c, F.lit(" ")), F.concat(F.lit("\n"), c, F.lit("\t")))).alias("t"))
    df = rows.select(T.strip(F.col("t")).alias("a"), F.regexp_replace("t", r"(?U)\A\s+|\s+\z", "").alias("b"))
    assert df.where("a <> b").count() == 0 and df.where("a <> ''").count() > 60_000
    assert "RLIKE" not in plan_of(rows.select(T.strip(F.col("t")))) and "regexp" not in plan_of(rows.select(T.strip(F.col("t"))))


@pytest.mark.parametrize("pattern,most", [(r"Formulir\s*(.*?)\s*Versi", 1), (r"No\.?\s*FPS\s*:", 6), (r"(?i)\bPelaksana\b", 1), (r"No\s+Nama\s+Mitra", 2)])
def test_types_share_the_parts_of_their_records(spark, pattern, most):
    """A part that several types have is in the plan once; labels are named by extraction, test and the line below, in text and report."""
    docs = spark.range(1).select(F.concat(F.col("id").cast("string"), F.lit("x")).alias("text"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = records.parse(docs)._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert 1 <= plan.count(pattern) <= most


@pytest.mark.parametrize("made,pattern,most", [(forms.rectifier, r"1\.\s*Physical\s+Check", 2), (forms.inverter, r"2\.\s*Performance", 4), (forms.shelter, r"3\.\s*Room", 3), (fields.vendor, r"(?i)\bPelaksana\b", 1), (fields.stamps, r"\d{2}/[A-Za-z]", 1)])
def test_sections_are_cut_once(spark, made, pattern, most):
    plan = spark.range(1).select(F.concat(F.col("id").cast("string"), F.lit("x")).alias("t")).select(made(F.col("t")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert 1 <= plan.count(pattern) <= most


def test_parsers_of_ones_own(spark):
    """Whole functions and parts may stand side by side; a part is shared by function."""
    own = {"spk_survey": lambda t: F.struct(F.length(t).alias("n")), "spk_aktivasi": (("low", F.lower), ("first", (F.lower, lambda v: F.substring(v, 1, 3))))}
    docs = spark.createDataFrame([(1, "SPK survey"), (2, "SPK AKTIVASI"), (3, "SPK dismantle"), (4, None)], "doc_id int, text string")
    out = records.parse(docs, parsers=own)
    assert out.columns == ["doc_id", "text", "document_type", "category", "folder", "parsing_status", "parsed"]
    assert {r.doc_id: r.parsed for r in out.collect()} == {1: '{"n":10}', 2: '{"low":"spk aktivasi","first":"spk"}', 3: None, 4: None}


def test_a_fold_loses_no_match(spark):
    """Each character of the first plane that a pattern of letters takes, ignoring case, has that letter as its lower case or is odd."""
    c = F.expr("decode(unhex(lpad(hex(id), 4, '0')), 'UTF-16BE')")
    rows = spark.range(0xD800).unionByName(spark.range(0xE000, 0xFFFE)).select(c.alias("t"))
    taken = rows.where(F.rlike("t", F.lit("(?iU)[a-z]"))).select("t", T.folded(F.col("t")).alias("f"))
    assert taken.where(~F.rlike("f.low", F.lit("[a-z]")) & ~F.col("f.odd")).count() == 0 and taken.where("f.odd").count() == 4
    text = F.lit("No Fp\u017f : 7\nJa\u017fa\nVPN")
    row = spark.range(1).select(*[T.search_field(text, p, m, T.folded(text)).alias(n) for n, p, _, m in (rules.labelled("no_fps", "No. FPS"), rules.labelled("pop", "POP"))]).head()
    assert (row.no_fps, row.pop) == ("7", None)
    assert T.label_words(rules.labelled("x", "Tgl.RFS PLG")[1]) == ("Tgl", "RFS", "PLG") and T.label_words("(A|B)") == T.label_words("A?b: (x)") == ()


def test_survey_without_labels(spark):
    """Texts that hold no label's words give what empty ones do; a label's line is found wherever its section is missing."""
    texts = ["", "SPK survey\nAlmat\nx", "SPK survey\nALAMAT\nJl. X\nUPS : 3 kVA\nlokasi  antena\natap"]
    rows = [r.s for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(fields.survey(F.col("t")).alias("s")).collect()]
    assert rows[0] == rows[1] and rows[2].informasi_gedung == {"alamat": "Jl. X"}
    assert rows[2].sarpen_ruang_server["ups"] == "3 kVA" and rows[2].lokasi_antena == {"lokasi_antena": "atap"}


def test_files_are_listed_by_tasks(spark, tmp_path):
    rows = spark.range(40).repartition(4).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/f"), "id").alias("name"), F.col("id").cast("string").cast("binary").alias("content"))
    folder = str(tmp_path / "out")
    assert blobs.read_files(spark, folder).count() == 0
    blobs.write_files(rows, folder)
    assert {(r.name, bytes(r.content)) for r in blobs.read_files(spark, folder).collect()} == {(f"d{i % 3}/f{i}", str(i).encode()) for i in range(40)}
    assert len(blobs.BlobReader(folder).partitions()) == 4  # folders of tasks, however many files they hold


def test_crops_are_not_listed_by_the_driver(spark):
    assert "binaryFile" not in queries_documents._crop_files(spark, SF)._jdf.queryExecution().analyzed().toString()


def test_stream_files_for_all_cores(spark, tmp_path):
    rows = spark.range(2000).select((F.col("id") % 50).alias("conv_id"), "id", F.col("id").alias("turn"))
    queries_streams.in_batches(spark, rows, str(tmp_path))
    assert len(list((tmp_path / "in").glob("*.parquet"))) >= 2 * spark.sparkContext.defaultParallelism
    assert spark.read.parquet(str(tmp_path / "in")).count() == 2000


def test_fields_of_several_sections_are_computed_once(spark):
    """A field that sections share, coordinates and the fold of a survey are in the plan once (a field: extraction, test, line below)."""
    docs = spark.range(1).select(F.concat(F.col("id").cast("string"), F.lit("x")).alias("text"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = records.parse(docs)._jdf.queryExecution().analyzed().toString()
        survey = docs.select(fields.survey(F.col("text")).alias("s"))._jdf.queryExecution().analyzed().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert 1 <= plan.count(r"Manage\s*Router\s*:") <= 3 and 1 <= plan.count(r"Jasa\s*:") <= 3
    assert survey.count("\u212a") == 1


def test_marked_fields_are_those_of_their_patterns(spark):
    """Fields read behind marks are what their own patterns find, where labels are broken, cut, repeated, empty or not plain."""
    head = "SPK SURVEY\nNomor : 1/WO\nNama Pelanggan : PT X\n"
    texts = [
        "", head, head + "Jasa : x Media Akses : FO\nKecepatan : 10 Mbps", head + "Jasa : xNama\nPelanggan\n:\n Budi\nKecepatan : 3 Telepon\n: 5", "JASA:VPN\njasa : b\nTelepon : abc\nTELEPON  :  021 x\nNo Jaringan:7",
        head + "Tanggal :\n\nAlamat\nNo. FPS :\n9\nTgl. RFS PLG : 1:2\nOpsi Router 1/3 : a\nPOP : a\nb\nIP LAN : 10.0.0.1\nBERITA ACARA\nNomor SPK : 3\nKontak Person : a\nb\nTelepon : 5",
        "Ja\u017fa : 1\nMedia\u00a0Akses : FO", "Jasa\t:\tVPN \r\nPOP : x", "Jasa : a\x01b\nPOP : \x02c\nKecepatan : 1", "Telepon : Telepon : 5\nNomorNomor : 4\nNo No. FPS : 3 :", None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    report = T.split_report(F.col("t"))[1]
    own = F.struct(*[F.struct(*[T.search_field(F.col("t") if part == "all" else report, p, m).alias(n) for n, p, part, m in table]).alias(s) for s, table in rules.SECTIONS.items()])
    for r in df.select("i", fields.work_order(F.col("t"), tuple(rules.SECTIONS)).alias("a"), own.alias("b"), fields.order_values(F.col("t")).alias("v")).collect():
        assert r.a == r.b, texts[r.i]
    keys = [fields._label_key(p) for p in {p.split(fields._BEHIND)[0] for table in rules.SECTIONS.values() for _, p, part, _ in table if part == "all" and fields._BEHIND in p}]
    assert not [(a, b) for a in keys for b in keys if a != b and a.endswith(b)]
    patterns = {}
    for name, p in ((fields._value_name(p, part), p) for table in rules.SECTIONS.values() for _, p, part, _ in table):
        assert patterns.setdefault(name, p) == p


def test_plain_lines_are_those_of_the_pattern(spark):
    texts = ["", "a", " a \n\n b", "a\r\nb\x0bc\x85d\u2028e", "\ta\u00a0\n\u2003b ", "a\x1cb\n \n", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    out = df.select(T.lines_of(F.col("t"), keep_blank=True).alias("a"), F.transform(F.split("t", r"\R", -1), T.strip).alias("b")).collect()
    assert [r.a for r in out] == [r.b for r in out]
