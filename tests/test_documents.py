"""Page files, binary sinks, labels and headings, position joins, exact caches: against plain versions."""

import glob
import os
import random
import zlib
from collections import OrderedDict

import pytest
from pyspark.sql import functions as F

from fieldquarry.operators import bands, conversation, headings, layout, rules
from fieldquarry.sources import blobs, paged
from fieldquarry.sources.pdf import Pdf, write


# ---- pages -------------------------------------------------------------------------------------
def opened(data):
    return Pdf(len(data), lambda at, n: data[at : at + n])


@pytest.mark.parametrize("pages", [["a"], ["Hello\nWorld (x)", "Étion → 😀\n\nlast"], [""], [f"p {i}" for i in range(400)], ["long " * 30_000]])
@pytest.mark.parametrize("packed", [True, False])
def test_pdf_text_comes_back(pages, packed):
    pdf = opened(write(pages, packed))
    assert pdf.n_pages == len(pages) and [pdf.text(i) for i in range(len(pages))] == pages


def test_pdf_operators():
    """Kerning, escapes, simple fonts, moves on one line, text matrices and forms."""
    form = b"BT (in a form) Tj ET"
    content = b"BT /F1 9 Tf 10 700 Td [(Na) -250 (ma) 20 (!)] TJ 40 0 Td (\\(same\\051 line\\n\\101) Tj 1 0 0 1 10 650 Tm (next) Tj T* <616263> Tj (q) ' ET % note\n/X1 Do"
    bodies = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count 1/Kids[3 0 R]/Resources<</XObject<</X1 5 0 R>>>>>>", b"<</Type/Page/Contents[4 0 R 4 0 R]>>", b"<</Length 6 0 R>>stream\r\n" + content + b"\nendstream", b"<</Subtype/Form/Length %d>>stream\n%s\nendstream" % (len(form), form), b"%d" % len(content)]
    out, at = b"%PDF-1.4\n", []
    for i, b in enumerate(bodies, 1):
        at.append(len(out))
        out += b"%d 0 obj %s endobj\n" % (i, b)
    out += b"xref\n0 1\n0000000000 65535 f \n1 6\n" + b"".join(b"%010d 00000 n \n" % a for a in at) + b"trailer<</Size 7/Root 1 0 R>>\nstartxref\n%d\n%%%%EOF" % len(out)
    once = "Na ma!(same) line\nA\nnext\nabc\nq\nin a form"
    got = opened(out).text(0)
    assert got.startswith(once.rsplit("\n", 1)[0]) and got.count("in a form") == 2


def test_pdf_cross_reference_streams():
    """Objects in an object stream, found by a cross-reference stream with a row predictor."""
    inner = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/Count 1/Kids[3 0 R]>>", b"<</Type/Page/Contents 5 0 R>>"]
    heads, body = b"", b""
    for i, b in enumerate(inner, 1):
        heads += b"%d %d " % (i, len(body))
        body += b + b" "
    packed = zlib.compress(heads + body)
    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += b"4 0 obj<</Type/ObjStm/N 3/First %d/Length %d/Filter/FlateDecode>>stream\n%s\nendstream endobj\n" % (len(heads), len(packed), packed)
    at5 = len(out)
    out += b"5 0 obj<</Length 15>>stream\nBT (deep) Tj ET\nendstream endobj\n"
    at6 = len(out)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0), (1, at6, 0)]
    plain = [bytes([a]) + b.to_bytes(2, "big") + bytes([c]) for a, b, c in rows]
    up = [b"\x02" + bytes((x - y) % 256 for x, y in zip(r, p, strict=True)) for r, p in zip(plain, [bytes(4), *plain], strict=False)]
    table = zlib.compress(b"".join(up))
    out += b"6 0 obj<</Type/XRef/Size 7/W[1 2 1]/Root 1 0 R/Filter/FlateDecode/DecodeParms<</Predictor 12/Columns 4>>/Length %d>>stream\n%s\nendstream endobj\nstartxref\n%d\n%%%%EOF" % (len(table), table, at6)
    assert opened(out).text(0) == "deep"


def test_pages_are_split_and_pruned(spark, tmp_path):
    long = [f"page {i} of a long file" for i in range(1, 201)]
    (tmp_path / "long.pdf").write_bytes(write(long))
    broken = bytearray(write(["fine first page", "second page", "third"], packed=False))
    at = broken.index("second".encode("utf-16-be").hex().encode())
    broken[at - 1 : at + 1] = b"(("
    (tmp_path / "broken.pdf").write_bytes(bytes(broken))
    (tmp_path / "cut.pdf").write_bytes(write(["x"] * 9)[:300])
    (tmp_path / "notes.txt").write_text("one\ftwo\fthree")
    (tmp_path / "_hidden.txt").write_text("no")
    (tmp_path / "empty.pdf").write_bytes(b"")
    rows = paged.read_pages(spark, str(tmp_path), split=4096)
    found = rows.where("path LIKE '%long.pdf'").collect()
    assert sorted((r.page, r.text) for r in found) == list(enumerate(long, 1)) and {r.n_pages for r in found} == {200}
    assert rows.where(F.endswith("path", F.lit("long.pdf"))).rdd.getNumPartitions() > 5
    assert {(os.path.basename(r.path), r.page) for r in rows.where("error IS NOT NULL").collect()} == {("cut.pdf", 0), ("empty.pdf", 0), ("broken.pdf", 2)}
    first = rows.where("page = 1")
    assert {os.path.basename(r.path): r.text for r in first.collect()} == {"long.pdf": long[0], "broken.pdf": "fine first page", "notes.txt": "one"}
    assert "page" not in first._jdf.queryExecution().executedPlan().toString().split("Filter")[-1] or "Filter" not in first._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.page for r in rows.where("page > 197 AND page <= 199").collect()) == [198, 199]
    assert sorted(r.text for r in rows.where("page IN (2, 3) AND path LIKE '%.txt'").collect()) == ["three", "two"]
    assert paged.read_pages(spark, str(tmp_path), "*.doc").count() == 0


# ---- binary files ------------------------------------------------------------------------------
def files_of(folder):
    return {os.path.relpath(p, folder).split("/", 1)[1]: open(p, "rb").read() for p in glob.glob(f"{folder}/**", recursive=True) if os.path.isfile(p)}


def test_files_are_committed_once(spark, tmp_path):
    rows = spark.range(20).select(F.concat(F.lit("d"), F.col("id") % 3, F.lit("/f.jpg")).alias("name"), "id", F.col("id").cast("string").cast("binary").alias("content"))
    named = blobs.distinct_names(rows, "id").repartition(4)
    blobs.write_files(named, str(tmp_path / "out"))
    got = files_of(tmp_path / "out")
    assert len(got) == 20 and got["d0/f.jpg"] == b"0" and got["d1/f_2.jpg"] == b"4" and not [f for f in os.listdir(tmp_path / "out") if f.startswith("_")]
    blobs.write_files(named.where("id < 2"), str(tmp_path / "out"), "overwrite")
    assert set(files_of(tmp_path / "out")) == {"d0/f.jpg", "d1/f.jpg"}


def test_a_failed_job_leaves_no_files(spark, tmp_path):
    rows = spark.range(20).repartition(4).select(F.concat(F.lit("f"), "id").alias("name"), F.when(F.col("id") == 13, F.raise_error(F.lit("lost"))).otherwise(F.lit(b"x")).alias("content"))
    with pytest.raises(Exception, match="lost"):
        blobs.write_files(rows, str(tmp_path / "out"))
    assert not glob.glob(f"{tmp_path}/out/**/f*", recursive=True)


def test_a_repeated_task_leaves_one_copy(tmp_path):
    """Two attempts of a task write; the job commits the one that it heard of."""
    import pyarrow as pa

    writer = blobs.BlobWriter(str(tmp_path), False)
    batch = pa.RecordBatch.from_pydict({"name": ["a/b.bin"], "content": [b"1"]})
    writer.write(iter([batch]))
    writer.commit([writer.write(iter([batch])), None])
    assert files_of(tmp_path) == {"a/b.bin": b"1"}
    with pytest.raises(ValueError):
        writer.write(iter([pa.RecordBatch.from_pydict({"name": ["../x"], "content": [b"1"]})]))


def test_crops(spark):
    image = b"P5\n4 10\n255\n" + b"".join(bytes([65 + y]) * 4 for y in range(10))
    plan = spark.createDataFrame([(1, "A", 1, 250.0, 600.0), (1, "B", 1, 0.0, 1000.0), (2, "C", 1, 0.0, 500.0), (3, "D", 1, 0.0, 500.0)], "doc_id long, label string, page int, y0 double, y1 double")
    pages = spark.createDataFrame([(1, 1, image), (3, 1, b"PNG")], "doc_id long, page int, image binary")
    got = {r.label: r.image for r in layout.crop_images(plan, pages).collect()}
    assert got == {"A": b"P5\n4 4\n255\nCCCCDDDDEEEEFFFF", "B": image, "C": None, "D": None}


# ---- labels and headings -----------------------------------------------------------------------
def test_labels_by_grams(spark):
    rng = random.Random(2)
    words = ["foto", "lokasi", "Hasil", "aktivasi", "A", "b2", "no.", "x-y", "PIC", "(1)", "data hh"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 5)))) for i in range(300)] + [(900, None), (901, "--"), (902, "Foto  LOKASI:")]
    names = [(w, 7) for w in [*words, "foto lokasi", "lokasi hasil", "absent label", "", "-", "b", "ab", None, "Hasil-Aktivasi"]]
    tokens = spark.createDataFrame(texts, "idx int, text string")
    labels = spark.createDataFrame(names, "label string, x int")
    plain = lambda s: "".join(c for c in s.lower() if c.isascii() and c.isalnum())
    want = sorted((i, n) for i, t in texts for n, _ in names if t is not None and n is not None and plain(n) and plain(n) in plain(t))
    df = headings.find_labels(tokens, labels)
    assert sorted((r.idx, r.label) for r in df.collect()) == want and set(df.columns) == {"idx", "text", "label", "x"}


def test_many_labels_without_nested_loops(spark):
    tokens = spark.range(2000).select(F.concat(F.lit("kode "), F.col("id")).alias("text"))
    labels = spark.range(10_000).select(F.concat(F.lit("kode "), F.col("id") * 7).alias("label"))
    df = headings.find_labels(tokens, labels)
    assert "NestedLoop" not in df._jdf.queryExecution().executedPlan().toString() and "Cartesian" not in df._jdf.queryExecution().executedPlan().toString()
    want = sum(str(i).startswith(str(7 * j)) for i in range(2000) for j in range(286))  # labels above 1,999 are in no token
    assert df.count() == want


def distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row)


def test_bit_vectors_against_a_table():
    rng = random.Random(3)
    for _ in range(400):
        p, t = "".join(rng.choices("abc", k=rng.randint(1, 12))), "".join(rng.choices("abcd", k=rng.randint(0, 25)))
        assert headings.least_errors(p, t) == distance(p, t)
    long = "ab" * 60
    assert headings.least_errors(long, "zz" + long[:50] + "q" + long[51:]) == 1


def test_headings_with_errors(spark):
    lines = [(0, "INDOOR AREA CHECKLIST"), (1, "NDOORAREACHECKLIST"), (2, "1NDO0R AREA CHECKLIST x"), (3, "INDOOR"), (4, None), (5, "LINE CHECKLIST"), (6, "an ordinary line about areas and checks"), (7, "L1NE CHECKUST"), (8, "OUTDOOR AREA CHECKLIST")]
    df = spark.createDataFrame([(1, n, t) for n, t in lines], "doc_id long, line_no int, text string")
    got = {(r.line_no, r.section, r.errors) for r in headings.near_headings(df, {"indoor": "INDOOR AREA CHECKLIST", "line": "LINE CHECKLIST"}).collect()}
    plain = lambda s: "".join(c for c in (s or "").lower() if c.isascii() and c.isalnum())
    table = {"indoor": "indoorareachecklist", "line": "linechecklist"}
    assert got == {(n, s, distance(p, plain(t))) for n, t in lines for s, p in table.items() if t and distance(p, plain(t)) <= headings.allowed(p)}
    assert {(0, "indoor", 0), (1, "indoor", 1), (2, "indoor", 2), (5, "line", 0)} <= got and not {n for n, *_ in got} & {3, 4, 6}


def test_no_headings_in_prose(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    assert headings.sections(lines, rules.WIRELINE_SECTIONS).count() == 0
    assert headings.sections(lines.limit(0), rules.WIRELESS_SECTIONS).count() == 0


def plain_crops(found, pages, labels):
    """Page by page, as the rule reads."""
    heads = {}
    for p, word, y in found:
        heads.setdefault(p, {}).setdefault(word, []).append(y)
    upper = [n.upper() for n in labels]
    out, busy = [], {}
    for p in sorted(pages):
        here = heads.get(p, {})
        label = next((n for n in upper if n in here), None)
        if label is None or busy.get(p) == label:
            continue
        out.append((label, p, max(0, min(here[label]) - 15), 1000))
        q = p + 1
        while q in pages:
            other = {w: ys for w, ys in heads.get(q, {}).items() if w != label}
            mean = lambda ys: sum(ys) / len(ys)
            if any(w in upper for w in other) or any(w in rules.IMAGE_TOP_STOPS and mean(ys) < 300 for w, ys in other.items()):
                break
            if pages[q] >= 20 and other:
                end = min(min(ys) for ys in other.values()) - 30
                if not any(mean(ys) < 300 for ys in other.values()) and end >= 200:
                    out.append((label, q, 0, end))
                break
            out.append((label, q, 0, 1000))
            busy[q] = label
            q += 1
    return out


def test_sections_go_on_over_pages(spark):
    rng = random.Random(9)
    labels, stops = ("Foto A", "Foto B", "Foto C"), ("DATA SPLITTER", "BOQ", "DATA HH BARU")
    found, pages, want = [], [], []
    for doc in range(150):
        n = rng.randint(1, 9)
        counts = {p: rng.choice([3, 50]) for p in range(1, n + 1)}
        marks = [(p, rng.choice([x.upper() for x in labels] + list(stops)), float(rng.choice([50, 150, 250, 350, 600]))) for p in counts for _ in range(rng.choice([0, 0, 0, 1, 1, 2]))]
        pages += [(doc, p, c) for p, c in counts.items()]
        found += [(doc, p, w, y) for p, w, y in marks]
        # few-word pages: stop headings count only at the top and of the strong kind
        want += [(doc, *c) for c in plain_crops(marks, counts, labels)]
    f = spark.createDataFrame(found, "doc_id int, page int, label string, y double")
    p = spark.createDataFrame(pages, "doc_id int, page int, n_words int")
    got = sorted((r.doc_id, r.label.upper(), r.page, r.y0, r.y1) for r in headings.continued_crops(f, p, labels).collect())
    assert got == sorted(want)
    assert headings.continued_crops(f.limit(0), p, labels).count() == 0


# ---- positions ---------------------------------------------------------------------------------
def test_interval_join_against_all_pairs(spark):
    rng = random.Random(4)
    points = [(rng.choice([1, 2, None]), rng.choice([-50.0, 0.0, rng.uniform(-200, 900)]), i) for i in range(200)] + [(1, None, 999)]
    spans = [(rng.choice([1, 2, 3]), a := rng.uniform(-200, 900), a + rng.choice([0.0, 5.0, 400.0, -1.0]), i) for i in range(60)] + [(1, None, 5.0, 77)]
    p, s = spark.createDataFrame(points, "k int, y double, i int"), spark.createDataFrame(spans, "k int, low double, high double, j int")
    want = sorted((a[2], b[3]) for a in points for b in spans if a[0] == b[0] and a[1] is not None and b[1] is not None and b[1] <= a[1] <= b[2])
    assert sorted((r.i, r.j) for r in bands.interval_join(p, s, ("k",), "y", "low", "high", width=37.0).collect()) == want
    hit = {i for i, _ in want}
    assert {r.i for r in bands.interval_join(p, s, ("k",), "y", "low", "high", how="left_anti").collect()} == {a[2] for a in points} - hit


def test_a_document_of_many_tokens_does_not_meet_itself(spark):
    n = 200_000
    tokens = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("idx"), F.when(F.col("id") % 2 == 0, "foto").otherwise("kota").alias("text"), F.lit(1.0).alias("x"), (F.col("id") * 10.0).alias("y"))
    assert layout.labels_without_context(tokens, "foto", "kota", reach=5.0).count() == n / 2
    assert layout.labels_without_context(tokens, "foto", "kota", reach=15.0).count() == 0


# ---- caches ------------------------------------------------------------------------------------
@pytest.mark.parametrize("most,rows", [(2, 1), (2, 3), (5, 40), (30, 64), (1000, 1000)])
def test_cache_against_a_loop(spark, most, rows):
    rng = random.Random(most)
    log = [(i // 2, rng.choice("abcdefghij") + str(int(rng.expovariate(0.2)))) for i in range(400)]
    held = OrderedDict()
    for seq, key in sorted(log):
        held.setdefault(key, seq)
        if len(held) > most:
            held.popitem(last=False)
    df = spark.createDataFrame(log, "seq long, k string").repartition(3)
    got = conversation.fifo_cache(df, "seq", F.col("k"), most=most, rows=max(rows, 20)).collect()
    assert {r.cache_key: r.seq for r in got} == dict(held)


def test_a_key_that_comes_back_is_new(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "a")], "seq long, k string")
    assert {r.cache_key: r.seq for r in conversation.fifo_cache(df, "seq", F.col("k"), most=2, rows=1).collect()} == {"c": 3, "a": 4}
    assert conversation.fifo_cache(df.limit(0), "seq", F.col("k")).count() == 0
