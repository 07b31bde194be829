import difflib

import pytest
from pyspark.sql import functions as F

from fieldquarry.functions import similarity as S
from fieldquarry.functions import text as T
from fieldquarry.operators import checklists, fields, forms, layout


def one(spark, text, make):
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).head().x


@pytest.mark.parametrize(
    "label,key",
    [("Info Kelistrikan (PLN P-N)", "info_kelistrikan_pln_p_n"), ("Bagian / Jabatan", "bagian___jabatan"), ("Pelanggan bersedia dipasang perangkat", "pelanggan_fo"), ("Penanggungjawab pengurusan dan pembayaran sewa", "penanggungjawab_sewa")],
)
def test_key(spark, label, key):
    assert one(spark, label, T.key_of) == key


def test_key_value_lines(spark):
    assert one(spark, "Nama\n:\nBudi\nKota\n: X", T.join_key_values) == "Nama: Budi\nKota: X"


def test_search_field(spark):
    nomor = lambda t: one(spark, t, lambda c: T.search_field(c, r"Nomor\s*:\s*([^\n]*)"))
    assert nomor("Nomor : 12") == "12"
    assert nomor("nothing") is None
    assert nomor("Nomor :\nTanggal : 1") is None  # the capture reaches the next line, which holds a colon
    assert nomor(None) is None
    own = lambda t: one(spark, t, lambda c: T.search_field(c, r"Kode *: *([^\n]*)"))
    assert own("Kode :\n A-17\n") == "A-17"
    assert own("Kode :\nAlamat\n") is None


def test_dates(spark):
    assert one(spark, "21-Jun-202118:00", T.date_time_text) == "21-Jun-2021 18:00"
    assert one(spark, "x 18:00", T.date_time_text) == "18:00"
    assert one(spark, "none", T.date_time_text) is None
    assert one(spark, "21-Jum-2021  x：", T.clean_checklist) == "21-Jun-2021 x:"


def test_ratios(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", "abd"), (None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select(S.block_ratio("a", "b").alias("r"), S.edit_ratio(F.col("a"), F.col("b")).alias("e")).collect()
    assert [r.r for r in got] == [difflib.SequenceMatcher(None, a, b).ratio() if a is not None else None for a, b in pairs]
    assert [r.e for r in got[:4]] == pytest.approx([0.0, 0.0, 1.0, 2 / 3], abs=1e-9) or got[2].e == 1.0


def test_cosine(spark):
    rows = spark.sql("SELECT array(1.0D, 0.0D) a, array(1.0D, 1.0D) b, array(0.0D, 0.0D) z")
    r = rows.select(S.cosine(F.col("a"), F.col("b")).alias("x"), S.cosine(F.col("a"), F.col("z")).alias("y")).head()
    assert r.x == pytest.approx(0.70710678) and r.y == 0.0


def plain_battery(text):
    import re

    n = re.findall(r"\d+(?:[,.]\d+)?", text)
    out, i = [], 0
    while i + 2 < len(n):
        no, v, soh = n[i : i + 3]
        volts = float(v.replace(",", "."))
        whole = "," not in v and "." not in v
        if no.isdigit() and soh.isdigit() and not (whole and 1 <= volts <= 20) and 10 <= volts <= 15 and int(soh) <= 100 and 1 <= int(no) <= 20:
            out.append((no, v, soh))
            i += 3
        else:
            i += 1
    return out


def test_battery_against_plain(spark):
    import random

    random.seed(5)
    texts = [" ".join(random.choice(["1", "7", "20", "21", "12,5", "13,0", "13", "9,9", "16,0", "80", "100", "101", "0"]) for _ in range(random.randint(0, 30))) for _ in range(150)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", forms.battery_rows(F.col("t")).alias("r")).collect()
    assert {g.i: [tuple(x) for x in g.r] for g in got} == {i: plain_battery(t) for i, t in enumerate(texts)}


def test_battery_sides(spark):
    text = "No Voltage SOH\n1 12,5\n80\n11 12,5\n80\n1 13,0\n100\n1 13,1 90"
    rows = one(spark, text, lambda c: forms.battery_sides(forms.battery_rows(c)))
    assert [(r.side, r.no, r.voltage, r.soh) for r in rows] == [("Recti", "1", "13,0", "100"), ("UPS", "1", "12,5", "80"), ("UPS", "11", "12,5", "80")]


def test_inventory(spark):
    rows = one(spark, "Switch A\n2\nActive\nConnect\nRouter B\n1\nShutdown\nNot Connect", forms.inventory)
    assert [tuple(r) for r in rows] == [("Switch A", "2", "Active", "Connect"), ("Router B", "1", "Shutdown", "Not Connect")]
    rows = one(spark, "Cooler\n(SARPEN)\n2\nActive\nFan\nPump\n3", lambda c: forms.inventory(c, bonding=False))
    assert [tuple(r) for r in rows] == [("Cooler (SARPEN)", "2", "Active", None), ("Pump", "3", None, None)]
    assert one(spark, "", forms.inventory) == []


def test_executors(spark):
    text = "No Nama Mitra / Internal Signature\n1\nWorker A\nORG1\n2 WorkerB ORG2\n( ______ )\n3 Late Org"
    assert [tuple(r) for r in one(spark, text, forms.executors)] == [("1", "Worker A", "ORG1"), ("3", "Late", "Org")]
    assert one(spark, "none", forms.executors) == []


def test_markers_keep_last(spark):
    text = "a. Old Normal x OK\nb. Angle 90 deg NOK\na. Paint Normal : clean\n OK"
    rows = one(spark, text, forms.marker_items)
    assert [tuple(r) for r in rows] == [("1.a", "Paint", "Normal", "clean", "OK"), ("1.b", "Angle", "90", "deg", "NOK")]


def test_devices(spark):
    text = "Nama Barang Router X B2WN0262020HA1346 Adapter 12V B2WN0262020HA1347"
    assert [tuple(r) for r in one(spark, text, fields.devices)] == [("Router X", "B2WN0262020HA1346"), ("Adapter 12V", "B2WN0262020HA1347")]


def test_reading_order_rounds_half_to_even(spark):
    t = spark.createDataFrame([("d", 0, "b", 5.0, 10.0), ("d", 1, "a", 1.0, 9.0), ("d", 2, "c", 0.0, 30.0)], "doc_id string, idx int, text string, x double, y double")
    assert [r.text for r in layout.reading_order(t).orderBy("rank").collect()] == ["a", "b", "c"]


def test_section_by_keywords(spark):
    text = "INDOOR AREA none\nNDOOR AREA modem ups kabel\nOUTDOOR"
    pick = lambda c: fields.section_by_keywords(c, (r"INDOOR AREA(.*?)\n", r"\nNDOOR AREA(.*?)OUTDOOR"), ("modem", "ups", "antena"))
    assert one(spark, text, pick).strip() == "modem ups kabel"
    assert one(spark, "nothing", pick) is None


def test_temperature_options(spark):
    got = one(spark, "18 - 25 C\nfine OK\n26 - 30 C\nx\ny\nz NOK", lambda c: forms.temperature_options(c, ("18 - 25 C", "26 - 30 C")))
    assert [(r.option, r.status) for r in got] == [("18 - 25 C", "OK"), ("26 - 30 C", "")]


def test_page_image():
    import numpy as np

    from fieldquarry.sources.endpoints import enhance

    page = np.full((40, 40), 200.0)
    page[18:22, 18:22] = 20
    out = enhance(page)
    assert out[20, 20] == 0 and out[0, 0] == 255 and out.shape == page.shape


def test_headers_and_boxes(spark):
    spans = spark.createDataFrame([("d", 1, "FOTO", 50.0, 100.0, 12.0), ("d", 1, "no. ", 300.0, 500.0, 12.0), ("d", 1, "FOTO 2", 380.0, 500.0, 12.0), ("d", 1, "foot", 10.0, 950.0, 14.0)], "doc_id string, page int, text string, x double, y double, size double")
    assert {r.text for r in layout.valid_header(spans).collect()} == {"FOTO", "no. "}
    assert layout.near_box(spans, 55, 95, 10).count() == 1


@pytest.mark.parametrize(
    "behind,tail",
    [
        ("Kit", "Kit"), ("+ Antena Modem X", "Antena Modem"), ("WARRANTY ADAPTOR", ""), ("ADAPTOR 12V", ""), ("FG-50E Kit", ""), ("B311As", ""), ("Antenna CABUT x", "Antenna"), ("CABUT Kit", ""),
        ("a Kit - Box Set", "Kit Box"), ("Antenna Cabinet", "Antenna"), ("Antenna + Cabinet", "Antenna Cabinet"), ("Antennas + Cabinets", "Antennas"), ("ROUTER + ANTENA", ""), ("Kit B2WN0123456789 Box", "Kit"), ("", ""), ("EXISTINGS", ""), ("Verylongdescriptor", ""),
    ],
)
def test_tail_behind_a_number(spark, behind, tail):
    assert one(spark, behind, checklists.tail_behind) == tail


@pytest.mark.parametrize(
    "word,before,want",
    [
        ("Router", "Firewall HW AND", True), ("KIT", "one two three four", True), ("KIT", "one two three four five", False), ("HW", "PSU", True), ("HW", "PSU 12V", False), ("HW", "PSU + Box", False),
        ("HW", "a b c", False), ("1A", "PSU", True), ("A1", "PSU", False), ("aB", "PSU", False), ("FORTIGATE", "PSU", False), ("KIT", "", False),
    ],
)
def test_words_that_go_on(spark, word, before, want):
    assert one(spark, before, lambda c: checklists.goes_on(F.lit(word), F.filter(F.split(c, " "), lambda w: w != ""))) is want


def test_continuations_by_line(spark):
    assert one(spark, "PSU\nHW AND\n\nKIT", checklists.join_continuations) == "PSU HW\nAND\n\nKIT"
    assert one(spark, None, checklists.join_continuations) is None and one(spark, "", checklists.join_continuations) == ""


def test_device_items(spark):
    a, b = "B2WN0000000001", "B2WN0000000002"
    text = f"CABUT Nama Barang No.Reg {' '.join('w%d' % i for i in range(12))} {a} KIT, Modem {b} {'Box' + ' ' * 60}Set"
    got = [tuple(r) for r in one(spark, text, checklists.device_items)]
    assert got == [(" ".join("w%d" % i for i in range(2, 12)) + " KIT, Modem", a), ("KIT, Modem Box", b)]
    assert one(spark, "no number", checklists.device_items) == [] and one(spark, None, checklists.device_items) is None
    assert one(spark, f"x {a}", checklists.device_items) == []


def test_vendor_without_end_or_name(spark):
    v = lambda t: one(spark, t, fields.vendor)
    assert v("Vendor\n\nPT ABC\nJAYA").nama_vendor == "PT ABC JAYA"
    assert v("Tim Vendor\nbudi").nama_vendor is None and v("Vendor\nbudi\n\nVendor ABC\nKontak").nama_vendor == "ABC"
    assert v("Pelaksana BUDI").teknisi is None and v("Kontak PIC Pelanggan\nsiang").kontak_pic_pelanggan is None
    assert v("PIC Pelanggan\nKontak PIC Pelanggan : 08-1").pic_pelanggan is None
    assert v("") == v("x") and all(x is None for x in v(""))
    assert v(None).nama_vendor is None
