"""WARC archives, conversation repair and ranked search against brute force, and on awkward rows."""

import collections
import hashlib
import io
import itertools
import math
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldquarry.llm import ranking, turns, warc
from fieldquarry.llm.common import Scratch

SF = "/root/testdata/sf0.001"


def saved(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.mark.parametrize("module,query", [(warc, "op11_warc_history"), (turns, "op12_conversation_repair"), (ranking, "op13_ranked_search")])
def test_duckdb_twins(spark, module, query):
    duck = duckdb.connect()
    for f in os.listdir(SF):
        duck.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = duck.execute(module.oracle())
    columns = sorted(d[0] for d in want.description)
    df = getattr(module, query)(spark, SF)
    assert sorted(df.columns) == columns
    key = lambda r: tuple((v is None, v) for v in r)
    named = [d[0] for d in want.description]
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[named.index(c)] for c in columns) for r in want.fetchall()), key=key)


# ---- archives -----------------------------------------------------------------------------------
def entry(i, key="k"):
    return {"url_key": key, "captured": "", "page_id": i, "archive": "a", "position": 0}


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    sources = [sorted(rng.sample(range(10_000), rng.choice([0, 1, 7, 300]))) for _ in range(k)]
    ids = [i * 100 + n for n, s in enumerate(sources) for i in s]
    cut = lambda n, s: [[entry(i * 100 + n) for i in s[at : at + 11]] for at in range(0, len(s), 11)]
    got = [e["page_id"] for e in warc.merged([iter(cut(n, s)) for n, s in enumerate(sources)])]
    assert got == sorted(ids)


def test_loser_tree_plays_only_the_way_up():
    tree = warc.LoserTree([(0, 3), (0, 1), (0, 2), (0, 5), (0, 4)])
    seen = []
    while len(seen) < 5:
        seen.append(tree.keys[tree.winner])
        assert tree.rival() == min([k for i, k in enumerate(tree.keys) if i != tree.winner] + [warc.ENDED])
        tree.replace(warc.ENDED)
    assert seen == [(0, n) for n in range(1, 6)]


PAYLOADS = [None, b"", b"x", b"\r\n\r\n", b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", bytes(range(256)) * 40, os.urandom(3000)]


def row_of(i, payload, kind="response"):
    return {"record_type": kind, "record_id": f"<urn:page:{i}>", "refers_to": None, "uri": "http://a.b/c d\r\nX: y", "captured": "2024-01-01T00:00:00Z", "payload_digest": hashlib.sha256(payload or b"").hexdigest(), "payload": payload}


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("step", [1, 7, 1 << 20])
def test_records_come_back(packed, step):
    records = [warc.record(row_of(i, p)) for i, p in enumerate(PAYLOADS)] + [warc.record(row_of(9, b"y" * 500, "revisit"))]
    stored = []
    for r in records:
        z = zlib.compressobj(3, zlib.DEFLATED, 31)
        stored.append(z.compress(r) + z.flush() if packed else r)
    found = list(warc.members(io.BytesIO(b"".join(stored)), step))
    assert [d for _, _, d in found] == records
    assert [(at, n) for at, n, _ in found] == list(zip(itertools.accumulate([0] + [len(x) for x in stored[:-1]]), map(len, stored), strict=True))
    back = [warc.parsed(d) for _, _, d in found]
    assert [r["payload"] for r in back] == [p or b"" for p in PAYLOADS] + [None]
    assert back[-1]["payload_bytes"] == 500 and all(r["error"] is None and r["uri"] == "http://a.b/c%20d%0D%0AX:%20y" for r in back)


def test_damage_is_told(spark, tmp_path):
    rows = [row_of(i, b"p" * 200) for i in range(4)]
    warc.write_archives(spark.createDataFrame(rows, warc.WRITTEN).coalesce(1), str(tmp_path))
    (name,) = [f for f in os.listdir(tmp_path) if f.endswith(".gz")]
    data = (tmp_path / name).read_bytes()
    (tmp_path / name).write_bytes(data[:-20])
    got = warc.read_archives(spark, str(tmp_path)).collect()
    assert [r.error is None for r in got] == [True, True, True, False]
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    wrong = warc.record(row_of(0, b"p" * 200)).replace(b"p" * 200, b"p" * 199 + b"q")
    (tmp_path / name).write_bytes(z.compress(wrong) + z.flush())
    (bad,) = warc.read_archives(spark, str(tmp_path)).collect()
    assert bad.error == "payload differs from its digest"


def test_only_committed_archives_count(spark, tmp_path):
    rows = spark.createDataFrame([row_of(i, b"p" * 200) for i in range(20)], warc.WRITTEN).repartition(3)
    warc.write_archives(rows, str(tmp_path), limit=300)
    names = [f for f in os.listdir(tmp_path) if f.endswith(".gz")]
    assert len(names) > 3  # archives are closed at their limit
    (tmp_path / "of-a-lost-task.warc.gz").write_bytes((tmp_path / names[0]).read_bytes())
    assert warc.read_archives(spark, str(tmp_path), payload=False).count() == 20
    warc.write_archives(rows, str(tmp_path))
    assert warc.read_archives(spark, str(tmp_path)).count() == 40


def test_failed_write_leaves_nothing(spark, tmp_path):
    bad = F.when(F.col("id") == 7, F.raise_error(F.lit("lost"))).otherwise(F.lit("response"))
    rows = spark.range(10).coalesce(1).select(bad.alias("record_type"), *(F.lit("x").alias(c) for c in ("record_id", "refers_to", "uri", "captured", "payload_digest")), F.lit(b"z").alias("payload"))
    with pytest.raises(Exception, match="lost"):
        warc.write_archives(rows, str(tmp_path / "w"), limit=10)
    assert not os.path.isdir(tmp_path / "w") or not [f for f in os.listdir(tmp_path / "w") if not f.startswith(".")]


def plain_pages(rows):
    size = lambda h: len((h or "").encode())
    groups = collections.defaultdict(list)
    for i, _, h in rows:
        if size(h) >= 100:
            groups[h].append(i)
    out = []
    for i, _, h in rows:
        ids = [x for x in groups.get(h, []) if x is not None]
        first = min(ids, default=None)
        revisit = bool(ids) and i != first
        out.append((i, size(h), hashlib.sha256((h or "").encode()).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast,bucket", [(10_000, 65_536), (0, 3)])
def test_pages_against_plain(spark, broadcast, bucket, monkeypatch):
    rng = random.Random(1)
    bodies = ["é" * 50, "b" * 99, "c" * 100, "", None, "long " * 30_000, *("".join(rng.choices("ab <>", k=120)) for _ in range(5))]
    rows = [(i, rng.choice(["http://A.example/x", "https://b.a.example/?q=1#f", "not a url", "", None, "http://a.example"]), rng.choice(bodies)) for i in range(60)]
    rows += [(3, "http://a.example", "c" * 100), (None, None, "c" * 100), (None, "http://z", "q" * 100), *[(100 + i, "http://hot.example/", "h" * 300) for i in range(40)]]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, captured string, first int").repartition(4)
    monkeypatch.setattr(warc, "RUN", 8)
    monkeypatch.setattr(warc, "BLOCK", 3)
    monkeypatch.setattr(warc, "HOT", 4)
    scratch, folder = Scratch(), f"{warc.shared_dir(spark)}/test-{random.random()}"
    warc.write_archives(warc.records_of(pages, scratch, F.timestamp_seconds(F.pmod(F.col("page_id"), F.lit(7))), broadcast=broadcast), folder, limit=2000)
    got = warc.capture_history(warc.read_archives(spark, folder, payload=False), scratch, bucket).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == plain_pages(rows)
    order = [(r.url_key, r.captured, r.page_id is None, r.page_id) for r in sorted(got, key=lambda r: r.capture_no)]
    assert order == sorted(order, key=lambda k: (*k[:3], k[3] or 0)) and [r.capture_no for r in sorted(got, key=lambda r: r.capture_no)] == list(range(1, len(rows) + 1))
    hot = {r.payload_digest: r for r in got if r.page_id == 100}
    assert [r.record_type for r in hot.values()] == ["response"]
    scratch.clear()
    warc.drop_folder(spark, folder)


def test_no_pages(spark, tmp_path):
    folder = saved(spark, tmp_path, "pages", [], "page_id long, url string, html string")
    assert warc.op11_warc_history(spark, folder).count() == 0


def test_url_keys():
    keys = {"http://B.a.example:80/x?y=1#z": "example:80,a,b)/x?y=1", "https://a.example": "example,a)/", "https://a.example?q": "example,a)?q", "text": "text", "": "", None: ""}
    assert {u: warc.url_key(u) for u in keys} == keys


# ---- conversations ------------------------------------------------------------------------------
def plain_edits(rows):
    """Least (cost, edits, repaired rows) over all edit strings. rows: (role, text, fault)."""
    best = None
    gaps = ["", "I", "II"]
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for edits in itertools.product("KRD", repeat=len(rows)):
            cost, out, audit = 0, [], ""
            for (role, text, fault), ins, e in zip(rows, inserts, edits, strict=False):
                audit += ins + e
                out += [("user" if not out or out[-1][0][:1] != "u" else "assistant", "")] if ins else []
                out += [("assistant" if out[-1][0] == "user" else "user", "")] if len(ins) == 2 else []
                cost += 5 * len(ins)
                if e == "D":
                    cost += 2
                    continue
                if fault in ("blank", "duplicate"):
                    break
                cost += 5 * (fault == "truncated") + (e == "R")
                out.append((role if e == "K" else "user" if not out or out[-1][0][:1] != "u" else "assistant", text))
            else:
                ins = inserts[-1]
                audit += ins
                for _ in ins:
                    out.append(("user" if not out or out[-1][0][:1] != "u" else "assistant", ""))
                cost += 5 * len(ins)
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, out)
    return best


def symbol(role, fault):
    s = "d" if fault in ("blank", "duplicate") else role[:1] if role[:1] in ("s", "u", "a") else "o"
    return s.upper() if fault == "truncated" else s


def test_solutions_against_all_edits():
    roles, faults = ["system", "user", "assistant", "tool"], ["", "", "truncated", "blank"]
    rng = random.Random(5)
    cases = [[(r, "t", f) for r, f in zip(rs, fs, strict=True)] for n in (1, 2) for rs in itertools.product(roles, repeat=n) for fs in itertools.product(faults[1:], repeat=n)]
    cases += [[(rng.choice(roles), "t", rng.choice(faults)) for _ in range(4)] for _ in range(25)]
    for rows in cases:
        found = turns.solve("".join(symbol(r, f) for r, _, f in rows))
        cost, edits = min((c + 5 * len(turns.TAIL[z]), e + turns.TAIL[z]) for (a, z), (c, e) in found.items() if a == turns.START)
        assert (cost, edits) == plain_edits(rows)[:2]


def test_segments_are_put_together():
    rng = random.Random(6)
    for n in [1, 5, 40, 200, 513]:
        for _ in range(8):
            sig = "".join(rng.choices("suaoSUAOd", k=n))
            cost, edits = min((c + 5 * len(turns.TAIL[z]), e + turns.TAIL[z]) for (a, z), (c, e) in turns.solve(sig).items() if a == turns.START)
            size = rng.choice([1, 2, 3, 17])
            ways, texts = [], []
            for i in range(0, n, size):
                found = turns.solve(sig[i : i + size])
                ranks = {e: k for k, e in enumerate(sorted({e for _, e in found.values()}))}
                ways.append([{"enter": a, "leave": z, "cost": c, "rank": ranks[e]} for (a, z), (c, e) in found.items()])
                texts.append(found)
            total, path = turns.chosen(ways)
            assert (total, "".join(t[p][1] for t, p in zip(texts, path, strict=True)) + turns.TAIL[path[-1][1]]) == (cost, edits)


def plain_repair(rows):
    """rows after damage: (turn, role, text), in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        visible = re.sub(r"[ \t-\r]", "", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    cost, audit, out = plain_edits([(r, x, f) for (_, r, x), f in zip(rows, faults, strict=True)]) or (0, "", [])
    count = collections.Counter(faults)
    return (gaps, count["blank"], count["duplicate"], count["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1)
    return out


@pytest.mark.parametrize("segment", [1, 2, 512])
def test_conversations_against_plain(spark, tmp_path, segment, monkeypatch):
    monkeypatch.setattr(turns, "SEGMENT", segment)
    rng = random.Random(8)
    rows = []
    for conv in [*range(40), None]:
        for i in range(rng.choice([0, 1, 2, 3, 4])):
            turn = rng.choice([i, i, i, 3 * i, None])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "No!", "cut", "cut ", " \n", "", None, "a.\nb. ", "Yes."])))
    rows.append((77, 2, "user", "Long " * 50_000 + "end."))
    folder = saved(spark, tmp_path, "conversations", [(*r, 5, "x") for r in rows], "conv_id long, turn long, role string, text string, pos int, sig string")
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in turns.op12_conversation_repair(spark, folder).collect()}
    after = collections.defaultdict(list)
    for conv, turn, role, text in plain_damage(rows):
        after[conv].append((turn, role, text))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    small = {c for c in {r[0] for r in rows} if len(after[c]) <= 5}
    assert set(got) == {r[0] for r in rows} and len(small) > 30
    for conv in small:
        assert got[conv] == plain_repair(sorted(after[conv], key=order)), conv


def test_a_long_conversation(spark):
    """One conversation of many rows is the same in segments as whole."""
    rows = [(1, i, ["user", "assistant"][i % 2], f"t{i % 50 if i % 7 else 3}.") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    scratch = Scratch()
    (got,) = turns.repair(df, scratch).collect()
    syms = [r.sym for r in turns.faulty(df).orderBy("pos").collect()]
    held = {0: (0, "")}  # a forward pass over rows, state by state
    for s in syms:
        nxt = {}
        for (a, z), (c, e) in turns.solve(s).items():
            if a in held:
                way = (held[a][0] + c, held[a][1] + e)
                nxt[z] = min(nxt.get(z, way), way)
        held = nxt
    assert (got.cost, got.audit) == min((c + 5 * len(turns.TAIL[z]), e + turns.TAIL[z]) for z, (c, e) in held.items())
    scratch.clear()


def test_no_conversations(spark, tmp_path):
    folder = saved(spark, tmp_path, "conversations", [], "conv_id long, turn long, role string, text string")
    assert turns.op12_conversation_repair(spark, folder).count() == 0


# ---- ranked search ------------------------------------------------------------------------------
def plain_ranks(docs, items, k=10):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    split = lambda t: re.findall(ranking.TERM, (t or "").translate(lower))
    held = [(i, collections.Counter(split(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(x for _, _, x in held)
    df = collections.Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 100 - 75 + ((75 * size * n) // total)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in split(text) if t in c)
            scores.append((-s, i is None, i, s))
        out += [(item, r, i, s) for r, (_, _, i, s) in enumerate(sorted(x for x in scores if x[3] > 0)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block,size", [(20_000, 8 << 20), (3, 64)])
def test_ranks_against_plain(spark, block, size, monkeypatch):
    monkeypatch.setattr(ranking, "SHARD_BYTES", size)
    rng = random.Random(4)
    words = ["Alpha", "alpha", "É1", "é1", "x-y", "b c", "die", "der", "z9", "中文", "rare"]
    docs = [(i, " ".join(rng.choices(words[:-1], k=rng.randint(0, 12)))) for i in range(150)]
    docs += [(i, "alpha die") for i in range(200, 240)] + [(5, "alpha die"), (None, "alpha die"), (None, None), (300, None), (301, ""), (302, "-- !"), (303, "rare " * 20_000)]
    items = [(1, "alpha die die"), (2, None), (3, "unknown"), (4, "RARE z9"), (4, "RARE z9"), (None, "x y"), (5, "--"), (6, "der É1 中文"), (7, "b c"), (1, "x")]
    d = spark.createDataFrame([(*r, 3, 0.5) for r in docs], "doc_id long, text string, rank int, score double").repartition(5)
    q = spark.createDataFrame([(*r, "c") for r in items], "item_id long, text string, q string")
    scratch = Scratch()
    got = ranking.ranked(d, q, scratch, block=block)
    assert dict(got.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_ranks(docs, items)
    scratch.clear()


def test_best_of_keeps_ties_by_id():
    rng = np.random.default_rng(0)
    for _ in range(200):
        scores, ids = rng.integers(0, 4, 50), rng.permutation(50)
        want = sorted((i for i in range(50) if scores[i] > 0), key=lambda i: (-scores[i], ids[i]))[:10]
        assert ranking.best_of(scores, ids, 10).tolist() == want


def test_folded_terms():
    texts = pa.array(["skip", "A-B_cÉ d\x7fe\x00F", None, "", "9z"])[1:]
    words, rows = ranking.terms_of(texts)
    assert list(zip(rows.tolist(), words.to_pylist(), strict=True)) == [(0, w) for w in ("a", "b", "cÉ", "d", "e", "f")] + [(3, "9z")]


def test_nothing_to_rank(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    scratch = Scratch()
    assert ranking.ranked(none, items, scratch).count() == 0
    assert ranking.ranked(spark.createDataFrame([(1, "a")], "doc_id long, text string"), items.limit(0), scratch).count() == 0
    scratch.clear()
