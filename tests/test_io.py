import json

from pyspark.sql import functions as F

from fieldquarry.operators import classify
from fieldquarry.sources import pages, sinks
from fieldquarry.streaming import ingest


def test_pages_and_fallback(spark, tmp_path):
    (tmp_path / "a.txt").write_text("SPK SURVEY nomor satu dua tiga empat\fx")
    (tmp_path / "b.txt").write_bytes(b"\xff\xfe")
    rows = pages.pages(spark, str(tmp_path), pages.form_feed_pages, "*.txt")
    assert rows.where("error IS NOT NULL").count() == 1
    ocr = rows.where("page = 2").select("path", "page", F.lit("from ocr").alias("text"))
    full = pages.with_fallback(rows.where("error IS NULL").drop("error"), ocr)
    assert pages.whole_text(full).head().text == "SPK SURVEY nomor satu dua tiga empat\nfrom ocr\n"
    assert pages.first_pages(rows).count() == 1


def test_ground_truth(spark, tmp_path):
    (tmp_path / "d1_ground_truth.json").write_text(json.dumps({"fields": {"no_spk": "1", "jasa": "x"}}))
    got = pages.ground_truth(spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [("d1", "jasa", "x"), ("d1", "no_spk", "1")]


def test_json_keeps_nulls(spark, tmp_path):
    df = spark.sql("SELECT 'spk' category, 'spk_survey' document_type, CAST(NULL AS string) a, 1 b")
    assert df.select(sinks.to_json(F.struct("a", "b")).alias("j")).head().j == '{"a":null,"b":1}'
    sinks.write_records(df, str(tmp_path / "out"))
    assert (tmp_path / "out/category=spk/document_type=spk_survey").exists()


def test_stream_classifies_new_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("SPK SURVEY")
    (tmp_path / "in/b.txt").write_text("FORM CHECKLIST wireless")
    q = ingest.classify_stream(ingest.landing_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    got = {r.document_type: r.category for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"spk_survey": "spk", "checklist_wireless": "checklist"}


def test_types(spark):
    cases = {"FM-LAP- D2-SOP-003-010": "form_pm_battery", "Preventive Maintenance Acme": "unknown", "Preventive Maintenance AC": "form_pm_ac", "checklist wireline spk survey": "checklist_wireline", "dismantle dan spk": "spk_dismantle", "FM-LAP-D2-SOP-003-099 Preventive Maintenance Pole": "form_pm_pole_tower", "": "unknown"}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.d for r in df.select("t", classify.document_type(F.col("t")).alias("d")).collect()} == cases
