"""Each operator against brute force on small fixtures, and on awkward rows."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldquarry.llm import common, hnsw, licenses, lm, media, mixing, neardup, packing, quality, secrets, sharding

P = pytest.importorskip("public_tokenizers")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, score double, taken string"


def docs_of(spark, rows):
    """rows: (doc_id, text[, source]); the other columns clash with what operators add."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, 7, True, 0.5, "x") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="module")
def texts():
    random.seed(3)
    words = ["alpha", "Beta", "gamma", "delta", "eps.", "zeta", "ÉTA", "theta", "iota", "kappa", "la|mbda", "mu"]
    base = [" ".join(random.choices(words, k=random.randint(30, 90))) for _ in range(12)]
    rows = [(i, t, random.choice("abc")) for i, t in enumerate(base)]
    for i in range(12, 40):  # near copies: a few words changed
        w = random.choice(base).split()
        for _ in range(random.choice([0, 1, 1, 2, 3])):
            w[random.randrange(len(w))] = random.choice(words)
        rows.append((i, " ".join(w), random.choice("abc")))
    rows += [(40, None, "a"), (41, "", None), (42, " \n\t", "b"), (43, "one", "c"), (44, "one", "c"), (45, "x " * 30_000, "a"), (46, "two words", "b")]
    rows += [(47, base[0], None), (47, base[0], None), (None, base[1], "a"), (None, None, None)]
    return rows


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else collections.Counter()


def test_connected_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (5, 5), (20, 1), (3, 1), (None, 4)] + [(100 + i, 101 + i) for i in range(60)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == components({x for e in real for x in e}, real)
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- 1 -----------------------------------------------------------------------------------------
def test_licenses(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [(0, f"intro\n{mit}", "a/LICENSE"), (1, "no words of it", "a/b/c.txt"), (2, f"{gpl}\n{mit}", "a/b/d.txt"), (3, None, "a/e.txt"), (4, "", "z/f.txt"), (5, mit, "g/COPYING.md"), (6, "x", "g/h/i/j.txt"), (7, gpl, "g/h/LICENSE"), (8, "plain", "g/h/i/k.txt"), (9, "plain", None), (9, "plain", None), (10, "see the license", "top.txt")]
    df = spark.createDataFrame(rows, "doc_id long, text string, path string").withColumn("cosine", F.lit("clash"))
    got = {(r.doc_id, r.path): (r.own_license, r.license, r.inherited_from) for r in licenses.license_scan(df, F.col("path")).collect()}
    assert got[(0, "a/LICENSE")] == ("MIT", "MIT", None)
    assert got[(1, "a/b/c.txt")] == (None, "MIT", "a")
    assert got[(2, "a/b/d.txt")] == ("GPL-3.0", "GPL-3.0", None)
    assert got[(3, "a/e.txt")] == (None, "MIT", "a")
    assert got[(4, "z/f.txt")] == (None, None, None)
    assert got[(6, "g/h/i/j.txt")] == (None, "GPL-3.0", "g/h") == got[(8, "g/h/i/k.txt")]
    assert got[(9, None)] == (None, None, None)
    assert licenses.license_scan(df.limit(0), F.col("path")).count() == 0


def test_license_spans_against_all_spans(spark):
    """Every line, run of a template's size and whole text against every template, with every term's own idf."""
    random.seed(1)
    templates = licenses.TEMPLATES + licenses.HEADERS
    pool = [t for _, x in templates for t in x.split()] + ["foo", "bar", "2.0.1", "MIT."]
    one = lambda: " ".join(random.choices(pool, k=random.randint(0, 9))) if random.random() < 0.6 else " ".join(random.choice(["", "foo"]) if random.random() < 0.06 else w for w in random.choice(templates)[1].split())
    texts = ["\n".join(one() for _ in range(random.randint(1, 4))) for _ in range(60)]
    df = collections.Counter(t for x in texts for t in set(licenses.terms(x)))
    idf = lambda t: math.log((1 + len(texts)) / (1 + df[t])) + 1
    weigh = lambda ts: {t: c * idf(t) for t, c in collections.Counter(ts).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    ways = [(n, weigh(licenses.terms(x)), len(licenses.terms(x)), *licenses.naming_terms(n, x)) for n, x in templates]
    want = {}
    for i, text in enumerate(texts):
        found = [(t, n) for n, line in enumerate(text.split("\n")) for t in licenses.terms(line)]
        spans = [[x for x in found if x[1] == n] for n in {n for _, n in found}] + [found]
        best = None
        for name, v, size, must, never in ways:
            for span in spans + [found[a : a + size] for a in range(len(found) - size + 1)]:
                u = weigh([t for t, _ in span])
                if u and must <= u.keys() and not never & u.keys():
                    cos = sum(x * v.get(t, 0.0) for t, x in u.items()) / norm(u) / norm(v)
                    if cos >= licenses.THRESHOLD - 1e-12 and (best is None or (-round(cos, 12), span[0][1], name) < best):
                        best = (-round(cos, 12), span[0][1], name)
        want[i] = best and (best[2], best[1], pytest.approx(-best[0], abs=1e-9))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.own_license and (r.own_license, r.line, r.cosine) for r in licenses.license_scan(rows, F.lit(None).cast("string"), templates=templates).collect()}
    assert got == want and sum(x is not None for x in want.values()) > 20


def test_license_headers_files_and_tags(spark):
    full = dict(licenses.all_templates()[::-1])
    texts = {f.stem: f.read_text() for f in (licenses.Path(licenses.__file__).parent / "license_texts").glob("*.txt")}
    wrapped = "// This program is free software: you can redistribute it and/or modify\n// it under the terms of the GNU General Public License as published by\n// the Free Software Foundation, either version 3 of the License, or\n// (at your option) any later version.\n\nint main;"
    rows = [(0, wrapped, "GPL-3.0", 0), (1, "ona tir wesh ona kel " * 20 + "Released under the MIT License. " + "mor sel tin ko " * 20, "MIT", 0), (2, "x = 1\n/* SPDX-License-Identifier: (LGPL-2.1-or-later OR MIT) */", "LGPL-2.1", 1), (3, "SPDX-License-Identifier: Unheard-1.0", None, -1), (4, "the software is for you and the license is not", None, -1), (5, "#!/bin/sh\n# under the terms of the GNU General Public\n# License version 2.", "GPL-2.0", 1)]
    rows += [(10 + i, "\n".join(["Copyright 2020 Somebody Else", *x.split("\n")[1:]]), n, None) for i, (n, x) in enumerate(sorted(texts.items()))]
    assert len(texts) >= 10 and set(texts) <= set(full)
    df = spark.createDataFrame([(i, t) for i, t, _, _ in rows] + [(100 + i, "ona tir wesh the of and") for i in range(30)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.license_scan(df, F.lit(None).cast("string")).collect()}
    for i, _, name, line in rows:
        assert got[i].own_license == name and (line is None or got[i].line == line), (i, name, got[i])


def test_license_neighbours_and_bodies(spark):
    """Words that name a licence decide; licence texts are found inside longer ones, their borders cut."""
    random.seed(11)
    words = ["ona", "tir", "wesh", "kel", "mor", "sel", "tin", "ko", "under", "the", "mit", "version"]
    filler = lambda n: "\n".join(" ".join(random.choices(words, k=9)) for _ in range(n))
    texts = {f.stem: f.read_text() for f in sorted((licenses.Path(licenses.__file__).parent / "license_texts").glob("*.txt"))}
    bodies = {n: t[len(t) // 10 : len(t) - len(t) // 10] for n, t in texts.items()}
    rows = [(0, "The tool was released under the license of its vendor", None), (1, "under the terms of the GNU General Public License version 1", None), (2, "Licensed under CC BY-SA 4.0", None)]
    rows += [(3, "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License", None), (4, "under the terms of the GNU Lesser General Public License version 3", None), (5, "Licensed under CC BY 4.0", "CC-BY-4.0"), (6, "Released under the MIT License", "MIT")]
    rows += [(100 + i, f"{filler(400)}\n{b}\n{filler(400)}", n) for i, (n, b) in enumerate(bodies.items())]
    rows += [(1000 + i, filler(3), None) for i in range(120)]
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.own_license for r in licenses.license_scan(df, F.lit(None).cast("string")).collect()}
    assert {i: got[i] for i, _, _ in rows} == {i: n for i, _, n in rows}


def test_license_idf_of_every_term(spark):
    notice = (("MIT", "Released under the MIT License"),)
    rows = [(0, "released under the mit license zeta eta")] + [(i, "zeta eta") for i in range(1, 60)]
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(None).cast("string"), templates=(("MIT", "released under the mit license zeta iota"),)).collect()}
    idf = lambda d: math.log(61 / (1 + d)) + 1
    both = 5 * idf(1) ** 2 + idf(60) ** 2  # zeta is in all documents, eta only beside it, iota nowhere
    assert got[0].cosine == pytest.approx(both / math.sqrt((both + idf(60) ** 2) * (both + idf(0) ** 2))) and got[0].own_license == "MIT"
    long = [(0, "alpha under the mit license")] + [(i, "alpha") for i in range(1, 60)]  # five terms, one of them not the template's
    got = {r.doc_id: r for r in licenses.license_scan(spark.createDataFrame(long, "doc_id long, text string"), F.lit(None).cast("string"), templates=notice).collect()}
    four = 4 * idf(1) ** 2
    assert got[0].cosine == pytest.approx(four / math.sqrt((four + idf(60) ** 2) * (four + idf(0) ** 2)))


# ---- 2 -----------------------------------------------------------------------------------------
def test_embedding_links(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vecs = [(i, (centres[i % 12] + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.2])).tolist()) for i in range(300)]
    vecs += [(300 + i, vecs[i][1]) for i in range(5)]
    odd = [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] + [1.0] * 15), (404, [None] + [1.0] * 15), (405, [float("inf")] + [1.0] * 15), (406, vecs[0][1][:8]), (None, vecs[0][1])]
    df = spark.createDataFrame(vecs + odd, "vec_id long, embedding array<double>").withColumn("n_links", F.lit("clash"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in hnsw.embedding_links(df).collect() if r.vec_id is not None}
    x = np.array([v for _, v in vecs])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    ids = [i for i, _ in vecs]
    want = components(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(near)) if a < b])
    same0 = [i for i, v in vecs if v == vecs[0][1]]
    for k, i in enumerate(ids):
        extra = 1 if near[k][0] else 0  # the row without an id is a copy of vector 0
        assert got[i] == (near[k].sum() - 1 + extra, want[i]), (i, same0)
    for i in range(400, 407):
        assert got[i] == (0, i)
    assert hnsw.embedding_links(df.limit(0)).count() == 0


def test_beams_widen_for_large_groups():
    rng = np.random.default_rng(0)
    v = hnsw.unit(np.concatenate([rng.normal(size=(400, 24)), rng.normal(size=24) + rng.normal(size=(300, 24)) * 0.03]))
    g = hnsw.Graph.load(hnsw.build(v, np.arange(700)).dump())
    at, to, _ = hnsw.links_of(g, v, 0.95)
    truth = set(zip(*(a.tolist() for a in np.nonzero(v @ v.T >= 0.95))))
    assert len(set(zip(at.tolist(), to.tolist())) & truth) >= 0.99 * len(truth) and set(zip(at.tolist(), to.tolist())) <= truth


def test_large_group_does_not_hide_missed_links(monkeypatch):
    rng = np.random.default_rng(5)
    pairs = np.repeat(rng.normal(size=(200, 24)), 2, axis=0) + rng.normal(size=(400, 24)) * 0.01
    v = hnsw.unit(np.concatenate([pairs, rng.normal(size=24) + rng.normal(size=(800, 24)) * 0.03])[rng.permutation(1200)])
    truth = (v @ v.T >= 0.95).sum(1)
    real = hnsw._search_all

    def lossy(graph, queries, beam, threshold):  # the first beam finds no link of ordinary vectors
        ids, sims = real(graph, queries, beam, threshold)
        few = (queries @ v.T >= threshold).sum(1) <= 2
        return ids, [np.full_like(s, -1.0) if beam == hnsw.SEARCH_BEAM and f else s for s, f in zip(sims, few)]

    monkeypatch.setattr(hnsw, "_search_all", lossy)
    at, to, beam = hnsw.links_of(hnsw.build(v, np.arange(1200)), v, 0.95)
    few = truth <= 2
    assert beam > hnsw.SEARCH_BEAM and few.sum() == 400
    assert np.array_equal(np.bincount(at, minlength=1200)[few], truth[few])
    assert hnsw.audit_passes(np.array([5000, 1, 0]), np.array([4990, 1, 0]))
    assert not hnsw.audit_passes(np.array([5000, 3, 1]), np.array([5000, 2, 1])) and not hnsw.audit_passes(np.array([5000, 3, 1]), np.array([5000, 3, 0]))


# ---- 3 -----------------------------------------------------------------------------------------
def plain_lattice(lattice, word):
    s = lm.MARK + word
    total = [1.0] + [0.0] * len(s)
    for j in range(1, len(s) + 1):
        for i in range(j):
            p = lattice.table.get(s[i:j])
            if p is None and j - i == 1:
                p = sum(lattice.byte_logp[b] for b in s[i:j].encode())
            if p is not None:
                total[j] += total[i] * 10**p
    return math.log10(total[-1])


def test_lm(spark, texts):
    path = P.path("piece_bpe_32k.model")
    df = docs_of(spark, texts)
    got = lm.score_documents(df, path, F.crc32(F.col("doc_id").cast("string")) % 7 != 2).collect()
    train = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    tokens = [(i, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t, *_ in texts]
    c = collections.Counter(w for i, ws in tokens if train(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), len(ws), sum(c[w] > 0 for w in ws), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 4)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
    assert all(r.train_tokens == n and r.score < 0 and r.train == train(r.doc_id) for r in got)
    assert lm.score_documents(df.limit(0), path, F.lit(True)).count() == 0


def test_lattice_against_plain_sums():
    vocabulary = lm.Vocabulary.load(P.path("piece_bpe_32k.model"))
    prior = vocabulary.prior()
    with np.errstate(divide="ignore"):
        logp = np.log10(prior / (prior.sum() + 1))
    lattice = lm.Lattice(vocabulary.pieces, logp, logp[vocabulary.bytes_], -1.0)
    words = ["hello", "Größe", "日本語", "a", "zzzzz", "\U0001f600x", "the%%%", "internationalisation", "x" * 60] * 40
    got = lattice.words(pa.array(words, pa.large_string()))
    assert got == pytest.approx([plain_lattice(lattice, w) for w in words], abs=1e-9)
    assert got == pytest.approx([lattice.word(w) for w in words], abs=1e-9)


# ---- 4 -----------------------------------------------------------------------------------------
def test_mixing(spark, texts):
    out = mixing.mix(docs_of(spark, texts), F.array("source"), mixing.cycle_weights).collect()
    assert len(out) == len(texts)
    by = collections.defaultdict(list)
    for r in out:
        assert r.size == len(WORD.findall(r.text or "")) and r.taken == r.size * r.copies and r.copies <= 3
        by[r.source].append(r)
    sizes = {s: sum(r.size for r in rs) for s, rs in by.items()}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.water_fill([sizes[s] for s in order], mixing.cycle_weights(order), sum(sizes.values()), 3)
    for s, t in zip(order, want, strict=True):
        assert all(r.source_size == sizes[s] and r.target == pytest.approx(t) for r in by[s])
        assert abs(sum(r.taken for r in by[s]) - t) <= max(r.size for r in by[s]) / 2 + 1
    again = mixing.mix(docs_of(spark, list(reversed(texts))), F.array("source"), mixing.cycle_weights).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.taken)
    assert sorted(map(key, again)) == sorted(map(key, out))
    assert mixing.mix(docs_of(spark, texts).limit(0), F.array("source"), mixing.cycle_weights).count() == 0


def test_mixing_overlapping_sources(spark):
    rows = [(i, "w " * (5 + i % 4), m) for i, m in enumerate([["a"], ["a", "b"], ["b"], ["b", "a", "a"], None, []] * 20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    out = mixing.mix(df, F.col("m"), lambda sources: [1.0, 3.0]).collect()
    assert len(out) == len(rows) and all(r.taken == 0 for r in out if not r.m)
    total = sum(r.size for r in out)
    taken = sum(r.taken for r in out)
    assert 0 < taken <= 3 * sum(r.size for r in out if r.m) and abs(taken - total) <= 3 * 8
    by = collections.Counter()
    for r in out:
        by[str(sorted(set(r.m or [])))] += r.taken
    only_a = sum(r.size for r in out if r.m == ["a"])
    assert by["['b']"] > by["['a']"] or by["['a']"] <= only_a  # the heavier source draws more copies


def test_water_fill():
    assert mixing.water_fill([10, 100, 100], [1, 1, 1], 210, 3) == pytest.approx([30, 90, 90])
    assert mixing.water_fill([0, 0], [1, 2], 0, 3) == [0, 0]
    assert sum(mixing.water_fill([5, 7, 900], [3, 2, 1], 912, 3)) == pytest.approx(912)


def test_flow_against_enumeration():
    random.seed(2)
    for _ in range(40):
        patterns = [(tuple(sorted(random.sample(range(3), random.randint(1, 3)))), random.randint(1, 3)) for _ in range(3)]
        quotas = [random.randint(0, 5) for _ in range(3)]
        sent = mixing.min_cost_flow(patterns, quotas, 2)
        used = [sum(f.values()) for f in sent]
        assert all(set(f) <= set(m) for f, (m, _) in zip(sent, patterns)) and all(sum(f.get(s, 0) for f in sent) <= q for s, q in enumerate(quotas))
        cost = sum(max(0, u - w) for u, (_, w) in zip(used, patterns))
        best = None
        spots = [(p, s) for p, (m, _) in enumerate(patterns) for s in m]
        caps = [2 * patterns[p][1] for p, _ in spots]
        for amounts in itertools.product(*[range(min(c, quotas[s]) + 1) for c, (_, s) in zip(caps, spots)]):
            by_p, by_s = collections.Counter(), collections.Counter()
            for (p, s), a in zip(spots, amounts):
                by_p[p] += a
                by_s[s] += a
            if all(by_p[p] <= 2 * w for p, (_, w) in enumerate(patterns)) and all(by_s[s] <= q for s, q in enumerate(quotas)):
                key = (-sum(amounts), sum(max(0, by_p[p] - w) for p, (_, w) in enumerate(patterns)))
                best = key if best is None or key < best else best
        assert (-sum(used), cost) == best


# ---- 5 -----------------------------------------------------------------------------------------
def plain_spans(text):
    out = []
    kinds = (("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6), ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20), ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24))
    for o, (k, p, good) in enumerate(kinds):
        for m in re.finditer(p, text, re.ASCII | (re.IGNORECASE if k == "assign" else 0)):
            if good(m):
                out.append((m.start(), o, f"{k}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def test_secrets(spark):
    hexes = ["deadbeef" * 4, "0123456789abcdef" * 2]
    cases = [None, "", "token=token:abcdefgh", "TOKEN = 'abcdef' secret:x password=\"" + hexes[0], "é😀 api_key=AAAAAA AKIA" + "Z" * 16 + " AKIA" + "Y" * 15, "ſecret=abcdefg passwd :  a.b_c=-", hexes[1] + "g" + hexes[0][:23], "token=" * 20, "x" * 50_000 + " secret=zzzzzzz"]
    cases += [f"Abcdefgh1234567890Xyz{i}" for i in range(2)] + ["copied Qwertyuiop1234567890Zz"] * 3
    rows = [(i, t, f"o{i}") for i, t in enumerate(cases)] + [(99, cases[3], None), (99, cases[3], None), (None, cases[3], "n")]
    got = secrets.scan_secrets(docs_of(spark, rows)).select("id", secrets.spans_text(F.filter("spans", lambda s: s["kind"] != "generic")).alias("base"), secrets.spans_text(F.col("spans")).alias("all")).collect()
    assert collections.Counter((r.id, r.base) for r in got) == collections.Counter((i, plain_spans(t or "")) for i, t, _ in rows)
    by = {r.id: r.all for r in got}
    assert by[9] == "generic:0:22" and by[11] == ""  # one owner's token; one that three owners share
    assert secrets.scan_secrets(docs_of(spark, rows).limit(0)).count() == 0


def test_secrets_of_two_owners_and_of_many_documents(spark):
    token, pasted, hexes = "Abcdefgh1234567890Xyz", "Qwertyuiop1234567890Zz", "0123456789abcdef" * 2
    rows = [(0, f"a {token}", "x"), (1, f"{token} b", "y")]
    rows += [(10 + i, f"{pasted} {hexes}", "hot") for i in range(secrets.COPIED_REPOS)] + [(1000 + i, "key " + hexes[::-1], "hot") for i in range(secrets.COPIED_REPOS - 1)]
    got = {r.id: r.spans for r in secrets.scan_secrets(docs_of(spark, rows)).collect()}
    assert [(s.kind, s.start, s.stop, s.label) for i in (0, 1) for s in got[i]] == [("generic", 2, 23, "shared"), ("generic", 0, 21, "shared")]
    assert [(s.kind, s.label, s.n_owners, s.n_repos) for s in got[10]] == [("hex", "copied", 1, secrets.COPIED_REPOS)]
    assert [(s.kind, s.label) for s in got[1000]] == [("hex", "owned")]
    masked = {r.doc_id: r.text for r in secrets.mask_live_secrets(docs_of(spark, rows)).collect()}
    assert (masked[0], masked[1], masked[10], masked[1000]) == ("a [SECRET]", "[SECRET] b", rows[2][1], "key [SECRET]")


def test_mask(spark):
    rows = [(1, "a token=abcdefgh b", "x"), (2, None, "x"), (3, "plain", "y"), (4, "token=sharedvalue", "x"), (5, "token=sharedvalue", "y"), (6, "token=sharedvalue", "z"), (1, "a token=abcdefgh b", "x")]
    got = secrets.mask_live_secrets(docs_of(spark, rows))
    assert got.columns == docs_of(spark, rows).columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == [(1, "a [SECRET] b"), (1, "a [SECRET] b"), (2, ""), (3, "plain"), (4, "token=sharedvalue"), (5, "token=sharedvalue"), (6, "token=sharedvalue")]


# ---- 6 -----------------------------------------------------------------------------------------
def test_near_duplicates(spark, texts):
    got = collections.defaultdict(set)
    for r in neardup.near_duplicates(docs_of(spark, texts)).collect():
        got[r.doc_id].add(r.component_id)
    named = {i: shingles(t) for i, t, *_ in texts if i is not None}
    links = []
    for a, b in itertools.combinations(named, 2):
        both, either = sum((named[a] & named[b]).values()), sum((named[a] | named[b]).values())
        if either and 5 * both >= 4 * either:
            links.append((a, b))
    assert links and {i: got[i] for i in named} == {i: {c} for i, c in components(named, links).items()}
    assert got[None] == {None}
    kept = neardup.drop_near_duplicates(docs_of(spark, texts))
    assert kept.where("doc_id IS NOT NULL").count() == len(set(components(named, links).values())) and kept.where("doc_id IS NULL").count() == 2
    assert neardup.near_duplicates(docs_of(spark, texts).limit(0)).count() == 0


def test_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    for _ in range(3):
        items = np.arange(40, dtype=np.uint64) * np.uint64(7919)
        a, b = rng.integers(0, 9, 40), rng.integers(0, 9, 40)
        doc = np.concatenate([np.zeros((a > 0).sum(), np.int64), np.ones((b > 0).sum(), np.int64)])
        sig = neardup.bag_minhash(doc, np.concatenate([items[a > 0], items[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 4096)
        assert (sig[0] == sig[1]).mean() == pytest.approx(np.minimum(a, b).sum() / np.maximum(a, b).sum(), abs=0.04)


def test_large_group_of_near_copies(spark):
    random.seed(8)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(300):
        w = list(base)
        for _ in range(2):
            w[random.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * sum((sets[a] & sets[b]).values()) >= 4 * sum((sets[a] | sets[b]).values())]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == components(sets, links)


# ---- 7 -----------------------------------------------------------------------------------------
@pytest.mark.parametrize("mode", [media.XIPH, media.FIXED, media.EBML_LACING])
def test_lacing(mode):
    frames = [bytes([i]) * (300 if mode == media.FIXED else n) for i, n in enumerate((5, 700, 255, 0, 254, 511))]
    body = media.block(3, -2, frames, mode)
    group = media.element(media.SEGMENT, media.element(media.CLUSTER, media.uint(media.TIMESTAMP, 10) + media.element(media.BLOCK_GROUP, media.element(media.BLOCK, body)) + media.element(0xEC, b"void")))
    packets = media.read_media(group).packets
    assert [group[p.start : p.start + p.size] for p in packets] == frames and {(p.track, p.timestamp, p.block) for p in packets} == {(3, 8, 0)}


def test_streamed_clusters_and_laced_times():
    open_ = lambda eid, body: eid.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + body  # noqa: E731  size unknown
    frames = [b"ab", b"cd", b"ef"]
    cluster = lambda t: open_(media.CLUSTER, media.uint(media.TIMESTAMP, t) + media.element(media.SIMPLE_BLOCK, media.block(1, 0, frames, media.FIXED)))
    track = media.element(media.TRACKS, media.element(media.TRACK_ENTRY, media.uint(media.TRACK_NUMBER, 1) + media.uint(media.DEFAULT_DURATION, 20_000_000)))
    point = media.element(media.CUES, media.element(media.CUE_POINT, media.uint(media.CUE_TIME, 7)))
    data = open_(media.SEGMENT, track + cluster(100) + cluster(200) + cluster(300) + point)
    m = media.read_media(data)
    assert [(p.timestamp, data[p.start : p.start + p.size]) for p in m.packets] == [(t + 20 * i, f) for t in (100, 200, 300) for i, f in enumerate(frames)]
    assert len(m.clusters) == 3 and m.cues == [(7, 0, 0)]
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, media.block(1, 0, frames, media.FIXED)) + media.uint(media.BLOCK_DURATION, 30))
    assert [p.timestamp for p in media.read_media(media.element(media.SEGMENT, open_(media.CLUSTER, media.uint(media.TIMESTAMP, 5) + group))).packets] == [5, 15, 25]
    pcm = media.read_media(media.write_pcm(bytes(media.PACKET * media.LACES * 2)))
    assert [p.timestamp for p in pcm.packets] == [i * media.PACKET * 1000 // media.RATE for i in range(media.LACES * 2)]


def test_vint_round_trip():
    for v in [0, 1, 126, 127, 128, 16382, 16383, 16384, 2**28, 2**49]:
        assert media.read_vint(media.vint(v), 0) == (v, len(media.vint(v)))
    with pytest.raises(ValueError):
        media.read_media(media.element(media.SEGMENT, b"ab")[:-1])


def test_media(spark, texts):
    df = docs_of(spark, texts)
    stored = media.media_column(df)
    want = collections.Counter()
    for i, t, *_ in texts:
        raw = (t or "").encode()
        want[(i, len(raw), hashlib.sha256(raw + bytes(-len(raw) % 64 or (0 if raw else 64))).hexdigest())] += 1
    got = collections.Counter()
    for r in stored.collect():
        m = media.read_media(bytes(r.media))
        got[(r.doc_id, r.n_bytes, hashlib.sha256(b"".join(bytes(r.media)[p.start : p.start + p.size] for p in m.packets)).hexdigest())] += 1
        assert len(m.cues) == len(m.clusters) and m.tracks == [{"number": 1, "type": 2, "codec": "A_PCM/INT/LIT"}]
    assert got == want
    assert media.packet_table(stored).count() > len(texts) and media.media_column(df.limit(0)).count() == 0


# ---- 8 -----------------------------------------------------------------------------------------
def least_bins_plain(sizes, capacity):
    sizes = sorted(sizes, reverse=True)
    best = [len(sizes)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                bins[j] += sizes[i]
                go(i + 1, bins)
                bins[j] -= sizes[i]
        go(i + 1, [*bins, sizes[i]])

    go(0, [])
    return best[0]


def test_bins_against_plain_search():
    random.seed(6)
    for _ in range(60):
        sizes = [random.randint(1, 20) for _ in range(random.randint(0, 9))]
        plan, bins, bound = packing.complete_bins(dict(collections.Counter(sizes)), 20)
        used = collections.Counter()
        for pattern, times in plan:
            assert sum(a * n for a, n in pattern) <= 20
            for a, n in pattern:
                used[a] += n * times
        assert used == collections.Counter(sizes) and bins == sum(t for _, t in plan) >= bound
        assert bins == least_bins_plain(sizes, 20)


def best_fit_plain(sizes, capacity):
    room = []
    for size in sorted(sizes, reverse=True):
        at = min((r, i) for i, r in enumerate([*room, capacity]) if r >= size)[1]
        if at == len(room):
            room.append(capacity)
        room[at] -= size
    return len(room)


def test_bins_never_exceed_best_fit():
    assert packing.fillings([3, 4], {3: 5, 4: 5}, 10, 2000, 4)[0] == (0, ((4, 1), (3, 2)))  # not the greatest multiple of 4
    assert all(w < 3 for w, _ in packing.fillings([3, 4, 5], {3: 9, 4: 9, 5: 9}, 11, 2000, 9))
    for seed, low, high, n in [(0, 800, 2000, 1500), (1, 1000, 1800, 900), (2, 1100, 2100, 900), (3, 1, 4096, 900)]:
        random.seed(seed)
        sizes = [random.randint(low, high) for _ in range(n)]
        counts = collections.Counter(sizes)
        plain = best_fit_plain(sizes, 4096)
        assert sum(times for _, times in packing.best_fit(dict(counts), 4096)) == plain
        plan, bins, _ = packing.complete_bins(dict(counts), 4096)
        used = collections.Counter()
        for pattern, times in plan:
            assert sum(a * k for a, k in pattern) <= 4096 and len({a for a, _ in pattern}) == len(pattern)
            for a, k in pattern:
                used[a] += k * times
        assert used == counts and bins == sum(t for _, t in plan) <= plain


def test_packing(spark, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    model = Tokenizer.from_file(path)
    more = [(200 + i, t) for i, t in enumerate(["don't I'll", "<|endoftext|> x", "<|ENDOFTEXT|>", "ABC123Größe!!a", "é É İ. ß", "a\x00b \x7f\x01", "tab\tnl\nx\x0by", "日本語テキスト"])]
    rows = [*texts, *more]
    df = docs_of(spark, rows)
    got = packing.pack(df, path, capacity=512, keep_ids=True).collect()
    want = collections.Counter()
    for i, t, *_ in rows:
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), 512)):
            want[(i, k, s, tuple(ids[s : s + 512]))] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in got) == want
    by = collections.defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 512
    assert len(by) == packing.complete_bins(dict(collections.Counter(r.length for r in got)), 512)[1]
    assert packing.pack(df.limit(0), path).count() == 0


def test_packing_with_another_tokenizer(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    assert not packing.WordIds.fits(model) and packing.WordIds.fits(Tokenizer.from_file(P.path("word_bpe_49k.json")))
    texts = ["two  spaces here", "", None, "tab\tand\nline " * 9]
    got = packing.pack(docs_of(spark, list(enumerate(texts))), path, capacity=16, keep_ids=True).collect()
    joined = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        joined[r.doc_id] += r.ids
    assert dict(joined) == {i: [*model.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


# ---- 9 -----------------------------------------------------------------------------------------
def test_sharding(spark):
    rows = [(i, 10 + i % 7) for i in range(500)] + [(7, 10)] * 400 + [(None, 5)] * 60 + [(1000, 5000), (1001, 0)]
    df = spark.createDataFrame(rows, "doc_id long, n_bytes long").repartition(3).withColumn("prefix", F.lit("clash"))
    stored = common.store(df, "t").df
    out = sharding.extendible_shards(stored, "doc_id", "n_bytes", 300).collect()
    assert collections.Counter((r.doc_id, r.n_bytes) for r in out) == collections.Counter(rows)
    by = collections.defaultdict(list)
    for r in out:
        by[r.shard_id].append(r)
    for s, rs in by.items():
        total = sum(r.n_bytes for r in rs)
        assert all(r.shard_bytes == total and r.shard_rows == len(rs) for r in rs)
        assert total <= 300 or (len(rs) == 1 and rs[0].oversize)
    # a shard split only because its parent was too large
    sums = collections.Counter()
    for r in out:
        for d in range(61):
            sums[(d, r.s_hash >> (60 - d))] += r.n_bytes
    assert all(r.depth == 0 or sums[(r.depth - 1, r.s_hash >> (61 - r.depth))] > 300 for r in out)
    assert sharding.extendible_shards(stored.limit(0), "doc_id", "n_bytes", 300).count() == 0


def test_secrets_against_their_sql(spark, tmp_path):
    import duckdb

    two, many, base, once = "Ab3" * 8, "Zx9" * 8, "0123456789abcdef" * 2, "Qw7" * 9
    rows = [(1, f"see {two} and password = {two}", "a"), (2, f"{two}", "b"), (3, once, None), (4, once, ""), (5, None, "a"), (6, "", "b"), (6, f"token: {once[:12]}", "b")]
    rows += [(100 + i, f"{many} {base} é {i}", "hot") for i in range(secrets.COPIED_REPOS)]
    rows += [(300 + i, "Kk8" * 9, owner) for i, owner in enumerate(["a", "b", "c"])] + [(400, f"passwd='{'Rr5' * 9}' {'Rr5' * 9}", "a")] * 2
    docs_of(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = secrets.op5_secret_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    plain = con.execute(secrets.oracle())
    names = [d[0] for d in plain.description]
    plain = sorted(plain.fetchall(), key=str)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=str) == plain
    by = {r[names.index("doc_id")]: r for r in plain}
    at = names.index
    assert "generic" in by[2][at("spans")] and by[2][at("n_owned")] == 0  # two owners share it: not copied
    assert "generic" not in by[100][at("spans")] and by[100][at("n_hex")] == by[100][at("n_copied")] == 1  # base spans stay
    assert by[300][at("spans")] == "" and by[400][at("n_assign")] == 1


# ---- 10 ----------------------------------------------------------------------------------------
def test_quality(spark):
    random.seed(9)
    good = lambda: ". ".join(" ".join("".join(random.choices("aeiounrst", k=random.randint(2, 9))) for _ in range(12)).capitalize() for _ in range(6))
    bad = lambda: " ".join(w + random.choice(["%%%", "$$$", "###"]) for w in good().split())
    rows = [(i, good() if i % 3 else bad()) for i in range(240)] + [(500, None), (501, ""), (502, "x" * 40_000), (None, "abc"), (3, "again"), (3, "again")]
    df = docs_of(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), "z") for i in range(240)] + [(500, None, "z"), (None, 1, "z"), (9999, 0, "z"), (1, 1, "z")], "doc_id long, quality int, text string")
    model = quality.fit(df, labels.where(~quality.held_out(F.col("doc_id"))))
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    held = [i for i in range(240) if i != 3 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert held and np.mean([(got[i] >= 0.3) == (i % 3 > 0) for i in held]) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and got[500] == got[501]
    kept = quality.keep_good(df, model)
    assert kept.schema == df.schema and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in quality.score(df, model).where("score >= 0.3").collect())
    none = quality.fit(df, labels.limit(0))
    assert {r.score for r in quality.score(df, none).collect()} == {0.5} and quality.score(df.limit(0), model).count() == 0


def test_classifier_learns_from_all_passages_of_chosen_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "train", lambda x, n, y: seen.append((x.copy(), n.copy(), y.copy())))
    long = " ".join(f"word{i}" for i in range(14_000))
    rows = [(1, long), (2, "short text"), (3, None), (2, "short text"), (4, "other " * 90)]
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (4, 0), (4, 0)], "doc_id long, quality int")
    quality.fit(docs_of(spark, rows), labels)
    by_hash = sorted([(1, long, 1), (2, "short text", 0), (3, "", 1), (4, "other " * 90, 0)], key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest())
    parts = [quality.passage_features(pa.array([t], pa.large_string())) for _, t, _ in by_hash]
    x, n, y = seen.pop()
    assert n.tolist() == [int(p[1][0]) for p in parts] and max(n) > 200 and y.tolist() == [r[2] for r in by_hash]
    assert np.allclose(x, np.concatenate([p[0] for p in parts]), atol=2e-3)
    quality.fit(docs_of(spark, rows), labels, max_passages=int(n[:2].sum()))
    assert seen.pop()[1].tolist() == n[:2].tolist()


def test_attention_gradient():
    rng = np.random.default_rng(0)
    x, n = rng.normal(size=(9, 5)).astype(np.float32), np.array([4, 2, 3])
    w = {"mean": np.zeros(5), "scale": np.ones(5), "W": rng.normal(size=(5, 4)), "b": np.zeros(4), "V": rng.normal(size=(4, 3)), "U": rng.normal(size=(4, 3)), "w": rng.normal(size=3), "c": rng.normal(size=4), "d": np.zeros(1)}
    p, _, _, _, _, a, z = quality._forward(w, x, n)
    assert np.add.reduceat(a, [0, 4, 6]) == pytest.approx([1, 1, 1]) and z.shape == (3, 4) and ((0 < p) & (p < 1)).all()


def test_expected_uses_against_enumeration():
    vocabulary = lm.Vocabulary.load(P.path("piece_bpe_32k.model"))
    lattice = lm._estimate(vocabulary, {}, 5)
    words, weights = ["ab", "the", "ünd", "the"], np.array([3, 1, 2, 4])
    want = collections.Counter()
    for w, c in zip(words, weights):
        s, ways = lm.MARK + w, []
        for cuts in itertools.product([0, 1], repeat=len(s) - 1):
            at = [0, *[i + 1 for i, x in enumerate(cuts) if x], len(s)]
            parts = [s[a:z] for a, z in itertools.pairwise(at)]
            lp = [lattice.table.get(x) if x in lattice.table else (lattice.char(x) if len(x) == 1 else None) for x in parts]
            if None not in lp:
                ways.append((10 ** sum(lp), parts))
        total = sum(p for p, _ in ways)
        for p, parts in ways:
            for x in parts:
                if x in lattice.table:
                    want[x] += c * p / total
    got, apart = lattice.expected(pa.array(words, pa.large_string()), weights)
    assert len(apart) == 0
    assert {n: round(float(g), 9) for n, g in zip(lattice.names, got) if g > 1e-12} == {n: round(v, 9) for n, v in want.items() if v > 1e-12}


# ---- cases found later ---------------------------------------------------------------------------
def test_mix_takes_rows_without_id_at_the_cut(spark):
    rows = [(None, "w " * 5, "a"), (9063, "w " * 5, "a"), (2_000_000, "w " * 5, "b")]
    for copies in (1, 2, 3):
        out = mixing.mix(docs_of(spark, rows), F.array("source"), mixing.cycle_weights, copies=copies).collect()
        assert len(out) == 3 and all(r.taken is not None and 0 <= r.taken <= copies * r.size for r in out)


def test_mix_routes_meet_quotas(spark):
    rows = [(i, "w " * 10, m) for i, m in enumerate([["a"], ["a", "b"], ["b", "c"], ["c"]] * 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, m array<string>")
    slim = df.select(F.col("m").alias("m_members"), mixing.pattern_of(F.col("m")).alias("m_pattern"), mixing.seeded_key(F.col("doc_id"), "mix").alias("m_key"), "doc_id", F.lit(10).cast("long").alias("size"))
    plan = mixing.plan_mix(slim, lambda sources: [1.0, 2.0, 1.0], 3, 1.0)
    sent = collections.Counter()
    for _, source, words in plan.routes():
        sent[source] += words
    assert plan.sources == ["a", "b", "c"] and [sent[s] for s in plan.sources] == [round(t) for t in plan.targets]
    assert {p: sum(w for q, _, w in plan.routes() if q == p) for p, *_ in plan.routes()} == {r[0]: sum(f.values()) for r, f in zip(plan.rows, plan.flows) if f}


def test_flow_with_many_patterns():
    random.seed(4)
    patterns = [(p, random.randint(1, 10**6)) for p in sorted({tuple(sorted(random.sample(range(40), random.randint(1, 4)))) for _ in range(3000)})]
    total = sum(w for _, w in patterns)
    quotas = [total * (1 + i % 3) // 80 for i in range(40)]
    sent = mixing.min_cost_flow(patterns, quotas, 3)
    assert [sum(f.get(s, 0) for f in sent) for s in range(40)] == quotas
    assert all(sum(f.values()) <= 3 * w for f, (_, w) in zip(sent, patterns))


def test_vectors_that_share_an_id_are_nodes_of_their_own(spark):
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (5, [0.0, 1.0]), (None, [0.01, 1.0]), (7, [-1.0, 0.0])]
    got = sorted((r.vec_id or 0, r.n_links, r.component_id or 0) for r in hnsw.embedding_links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == [(0, 1, 0), (1, 1, 1), (1, 1, 1), (5, 1, 5), (7, 0, 7)]


def test_links_of_a_large_group_in_bounded_steps():
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(size=16) + rng.normal(size=(900, 16)) * 0.01, rng.normal(size=(300, 16))])
    graph = hnsw.build(hnsw.unit(v), np.arange(1200))
    shard = pa.table({"nodes": pa.array([np.arange(1200).tobytes()], pa.binary()), "copies": pa.array([np.ones(1200, np.int64).tobytes()], pa.binary()), "graph": pa.array([graph.dump()], pa.binary())})
    out = hnsw._link(0.95)(shard, pa.table({"node": np.arange(1200), "embedding": list(v)})).to_pylist()
    x = hnsw.unit(v)
    want = (x @ x.T >= 0.95).sum(1) - 1
    audit = [r for r in out if r["node"] is None]
    assert {r["node"]: r["n"] for r in out if r["node"] is not None} == {i: n for i, n in enumerate(want.tolist()) if n}
    assert len(audit) == 1 and audit[0]["found"] >= 0.995 * audit[0]["sampled"] > 0


def test_document_scores_are_plain_sums(spark, texts):
    path = P.path("piece_bpe_32k.model")
    rows = [(r[0], r[1]) for r in texts if r[0] not in (45,)] + [(900, "ab" * 40 + " tail"), (900, "ab" * 40 + " tail")]
    df = docs_of(spark, rows)
    out = lm.score_documents(df, path, F.lit(True)).collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(i for i, _ in rows)
    # the model again, from the plain counts: first segmentation, then expectations word by word
    import sentencepiece

    counts = collections.Counter(w for _, t in rows for w in WORD.findall((t or "").translate(LOWER)))
    vocabulary = lm.Vocabulary.load(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    uses = collections.Counter()
    for w, c in counts.items():
        for piece in sp.encode(w):
            uses[piece] += c
    lattice = lm._estimate(vocabulary, uses, len(rows))
    for _ in range(lm.EM_ROUNDS):
        place = {n: i for i, n in enumerate(vocabulary.pieces)}
        total = np.zeros(len(lattice.values))
        for w, c in counts.items():
            lattice._expected_one(lm.MARK + w, float(c), total)
        lattice = lm._estimate(vocabulary, {place[n]: u for n, u in zip(lattice.names, total[:-1]) if u}, len(rows))
    want = {(i, t): lattice.end + sum(plain_lattice(lattice, w) for w in WORD.findall((t or "").translate(LOWER))) for i, t in rows}
    got = collections.defaultdict(list)
    for r in out:
        got[r.doc_id].append(r.score)
    for (i, _), score in want.items():
        assert any(abs(s - score) < 1e-6 for s in got[i])


def test_long_words_count_in_expectation():
    lattice = lm._estimate(lm.Vocabulary.load(P.path("piece_bpe_32k.model")), {}, 5)
    word = "thequickbrownfox" * 3
    one = np.zeros(len(lattice.values))
    lattice._expected_one(lm.MARK + word, 2.0, one)
    uses, none = lattice.expected(pa.array([word, "the"], pa.large_string()), np.array([2, 1]))
    short, _ = lattice.expected(pa.array(["the"], pa.large_string()), np.array([1]))
    assert len(none) == 0 and np.allclose(uses, one[:-1] + short)
    assert sum(len(n) * u for n, u in zip(lattice.names, one)) == pytest.approx(2.0 * (len(word) + 1))


def test_masks_in_chunks(spark):
    random.seed(9)
    texts = ["", "plain", "token=abcdefgh", "token=deadbeef" * 3 + "0123456789abcdef" * 2]
    for gap in (4080, 4095, 4096, 4097, 8192, 20_000):
        texts.append("é" * gap + " secret=q" + str(gap) + "zzzzz " + "x " * gap + "AKIA" + "Z" * 12 + str(10_000 + gap) + " 😀" * random.randint(0, 9))
    rows = [(i, t, f"o{i}") for i, t in enumerate(texts)]
    got = {r.doc_id: r.text for r in secrets.mask_live_secrets(docs_of(spark, rows)).collect()}
    for i, text in enumerate(texts):
        out, at = "", 0
        for _, a, z in (x.split(":") for x in plain_spans(text).split(",") if x):
            if int(a) >= at:
                out += text[at : int(a)] + "[SECRET]"
            at = max(at, int(z))
        assert got[i] == out + text[at:]


def test_many_secrets_in_one_text(spark):
    values = [f"{i:024x}" for i in range(20_000)]
    text = " ".join(values)
    got = secrets.scan_secrets(docs_of(spark, [(1, text, "a")])).collect()[0].spans
    assert len(got) == len(values) and [(s.start, s.stop) for s in got[:2]] == [(0, 24), (25, 49)]
    masked = secrets.mask_live_secrets(docs_of(spark, [(1, text, "a")])).collect()[0].text
    assert masked == " ".join(["[SECRET]"] * len(values))


def test_rows_that_share_an_id_keep_their_own_texts(spark):
    long = [" ".join(f"{c}{i}" for i in range(40)) for c in "pqr"]
    rows = [(1, long[0]), (1, long[1]), (2, long[0]), (3, long[1]), (3, long[1]), (4, long[2]), (5, ""), (5, ""), (6, None)]
    got = collections.Counter((r.doc_id, r.component_id) for r in neardup.near_duplicates(docs_of(spark, rows)).collect())
    assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 2, (4, 4): 1, (5, 5): 2, (6, 6): 1}
    kept = sorted((r.doc_id, r.text or "") for r in neardup.drop_near_duplicates(docs_of(spark, rows)).collect())
    assert kept == sorted([(1, long[0]), (1, long[1]), (4, long[2]), (5, ""), (6, "")])


def test_hot_bucket_with_few_strangers(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 16)
    random.seed(11)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(150):  # a chain of drifting copies around one text
        w = list(base)
        for _ in range(i % 6):
            w[random.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 5 * sum((sets[a] & sets[b]).values()) >= 4 * sum((sets[a] | sets[b]).values())]
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert got == components(sets, links)


def left_by(spark, run):
    """Kinds of tables that a run leaves in the shared folder."""
    from pathlib import Path

    folder = Path(common.shared_dir(spark))
    before = {p.name for p in folder.iterdir()} if folder.exists() else set()
    run()
    return {p.name.rsplit("-", 1)[0] for p in folder.iterdir() if p.name not in before}


def test_no_tables_are_left_but_results(spark, texts):
    docs = docs_of(spark, texts[:20]).withColumn("path", F.lit("a/b.txt"))
    assert left_by(spark, lambda: neardup.near_duplicates(docs).count()) == {"classes"}
    assert left_by(spark, lambda: neardup.drop_near_duplicates(docs).count()) <= {"duplicates", "repeated"}
    assert left_by(spark, lambda: licenses.license_scan(docs, F.col("path")).count()) == {"license-scan"}
    rows = spark.createDataFrame([(i % 7, 100) for i in range(50)], "doc_id long, n_bytes long")
    assert left_by(spark, lambda: sharding.extendible_shards(rows, "doc_id", "n_bytes", 300).count()) <= {"leaves", "oversized", "paged"}


def test_no_tables_are_left_by_a_run_that_fails(spark, texts, monkeypatch):
    def broken(*args):
        raise RuntimeError("broken")

    monkeypatch.setattr(neardup, "_verified", broken)
    monkeypatch.setattr(licenses, "_best_spans", broken)
    docs = docs_of(spark, texts[:20]).withColumn("path", F.lit("a/b.txt"))
    for run in (lambda: neardup.near_duplicates(docs), lambda: neardup.drop_near_duplicates(docs), lambda: licenses.license_scan(docs, F.col("path"))):

        def fails(run=run):
            with pytest.raises(RuntimeError):
                run()

        assert left_by(spark, fails) == set()


def test_pairs_without_the_signature_filter(spark, texts):
    """With agree=0 every pair that shares a band is compared exactly: the same classes."""
    both = [sorted(tuple(r) for r in neardup.near_duplicates(docs_of(spark, texts).where("doc_id IS NOT NULL"), agree=n).collect()) for n in (neardup.AGREE, 0)]
    assert both[0] == both[1] and any(i != c for i, _, c in both[0])


@pytest.mark.parametrize("seed", range(4))
def test_bins_are_optimal_on_small_cases(seed):
    random.seed(seed)
    for _ in range(150):
        capacity = random.randint(8, 40)
        sizes = [random.randint(1, capacity) for _ in range(random.randint(1, 9))]
        assert packing.complete_bins(dict(collections.Counter(sizes)), capacity)[1] == least_bins_plain(sizes, capacity)
    sizes = [736, 907, 1167, 1331, 1366, 1425, 1499, 1627, 1644, 1652, 1687, 1719, 1764, 1817, 1832, 2001, 2114]
    assert packing.complete_bins(dict(collections.Counter(sizes)), 4096)[1] == 7


@pytest.mark.parametrize(("low", "high", "n", "slack"), [(800, 2000, 600, 2), (900, 2300, 400, 1), (1100, 1700, 600, 3), (700, 2300, 300, 1), (1000, 1800, 600, 3)])
def test_bins_come_near_the_bound_where_best_fit_does_not(low, high, n, slack):
    random.seed(1)
    counts = collections.Counter(random.randint(low, high) for _ in range(n))
    plan, bins, bound = packing.complete_bins(dict(counts), 4096)
    used = collections.Counter()
    for pattern, times in plan:
        assert sum(a * k for a, k in pattern) <= 4096
        for a, k in pattern:
            used[a] += k * times
    assert used == counts and bins == sum(t for _, t in plan)
    assert bound <= bins <= bound + slack and bins < best_fit_plain(list(counts.elements()), 4096)


def test_prices_against_plain_search():
    random.seed(8)
    for _ in range(40):
        sizes = [random.randint(3, 20) for _ in range(random.randint(1, 9))]
        counts = collections.Counter(sizes)
        at = np.array(sorted(counts))
        need = np.array([counts[int(k)] for k in at], float)
        prices, columns, times = packing.relax(at, need, 20)
        assert np.allclose(prices @ need, times.sum()) and (columns @ times >= need - 1e-6).all() and (at @ columns <= 20).all()
        assert packing.priced_bound(counts, 20, at, prices) <= least_bins_plain(sizes, 20)
        worth, held = packing.dearest(at, prices, need, 20)
        assert np.isclose(held @ prices, worth) and held @ at <= 20 and (held <= need).all() and worth <= 1 + 1e-6


def test_units_encode_like_whole_texts():
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    own = packing.WordIds(Tokenizer.from_file(P.path("word_bpe_49k.json")))
    random.seed(5)
    alphabet = [*"abAB09'.,<|>-_ \t\n\x00\x1c\x7f", *"éÉßİıǅﬁ中文ΩςΣ½²😀가", "\u0301", "\xa0", "\u2003", "\x85", "\u200b", "'s", "'LL", "<|endoftext|>", "\ufeff"]
    for _ in range(400):
        texts = ["".join(random.choices(alphabet, k=random.randint(0, 14))) for _ in range(random.randint(1, 4))]
        ids, n = own.ids(pa.array(texts, pa.large_string()))
        assert [list(x) for x in np.split(ids, np.cumsum(n)[:-1])] == [model.encode(t, add_special_tokens=False).ids for t in texts]


def test_long_text_in_runs(spark, monkeypatch):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "SLICE_TEXT", 200)
    text = "Some words, 12 of them; don't stop Größe. " * 60
    run = packing._pieces_of(path, 64, 1, True)
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([text, "x"])], ["doc_id", "text"])
    got = pa.Table.from_batches(list(run(iter([batch])))).to_pylist()
    ids = [x for r in got if r["doc_id"] == 1 for x in r["ids"]]
    assert ids == [*Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids, 1]
    assert collections.Counter(r["length"] for r in got) == collections.Counter(len(r["ids"]) for r in got)
    by = collections.defaultdict(list)
    for r in got:
        by[r["length"]].append(r["own"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_gradient_by_finite_differences():
    rng = np.random.default_rng(2)
    n = np.array([3, 1, 4, 2])
    x, y = rng.normal(size=(10, 6)), np.array([1.0, 0.0, 0.0, 1.0])
    w = {"mean": np.zeros(6), "scale": np.ones(6), "W": rng.normal(size=(6, 5)), "b": rng.normal(size=5), "V": rng.normal(size=(5, 3)), "U": rng.normal(size=(5, 3)), "w": rng.normal(size=3), "c": rng.normal(size=5), "d": np.zeros(1)}

    def plain(w):  # an independent forward pass, bag by bag
        out, at = [], 0
        for k in n:
            h = np.tanh((x[at : at + k] - w["mean"]) * w["scale"] @ w["W"] + w["b"])
            e = (np.tanh(h @ w["V"]) / (1 + np.exp(-(h @ w["U"])))) @ w["w"]
            a = np.exp(e) / np.exp(e).sum()
            out.append(float(1 / (1 + np.exp(-((a[:, None] * h).sum(0) @ w["c"] + w["d"][0])))))
            at += k
        return np.array(out)

    assert np.allclose(quality._forward(w, x, n)[0], plain(w))
    loss = lambda w: -np.mean(y * np.log(plain(w)) + (1 - y) * np.log(1 - plain(w)))
    grad = quality.gradient(w, x, n, y)
    for k, g in grad.items():
        for at in itertools.islice(np.ndindex(w[k].shape), 6):
            up, down = {**w, k: w[k].copy()}, {**w, k: w[k].copy()}
            up[k][at] += 1e-6
            down[k][at] -= 1e-6
            assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-6, abs=1e-6)


@pytest.mark.parametrize("cut", [1, 5, 30, 41, 60, 90])
def test_damaged_media(cut):
    whole = media.write_pcm(bytes(range(64)) * 4)
    with pytest.raises(ValueError):
        media.read_media(whole[: len(whole) - cut])


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_graphs_travel_in_pieces(spark, monkeypatch):
    """Rows with a shard's graph stay small however large the shard; what is linked is the same."""
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(40, 16)), 3, axis=0) + rng.normal(size=(120, 16)) * 0.02
    table = pa.table({"dim": [16] * 120, "shard": [0] * 120, "node": np.arange(120), "key": np.arange(120), "copies": np.ones(120, np.int64), "embedding": list(v)})
    whole = hnsw._shard(hnsw._build(table))
    monkeypatch.setattr(hnsw, "PIECE", 1000)
    made = hnsw._build(table)
    assert made.num_rows > 10 and max(len(x) for x in made.column("graph").to_pylist()) <= 1000
    nodes, copies, graph = hnsw._shard(made.take(pa.array(rng.permutation(made.num_rows))))
    assert (nodes == whole[0]).all() and (copies == 1).all() and (graph.vectors == whole[2].vectors).all()
    block = pa.table({"node": np.arange(120), "embedding": list(v)})
    assert hnsw._link(0.95)(made, block).to_pylist() == hnsw._link(0.95)(hnsw._build(table), block).to_pylist()
