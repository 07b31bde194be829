"""License scans: TF-IDF cosine of texts to licence templates, then inheritance from the nearest directory.

Templates are one-line notices, common headers, SPDX tags and full licence texts. Of every whole text
four kinds of spans are compared with them: each line, the whole text, for templates of up to
WINDOW terms every run of as many terms as the template has, wherever lines break, and for longer
ones the best fitting run of their size and of four fifths of it. So a header wrapped over several
lines, a notice inside a longer line, a licence file and a licence text inside another count alike.
Spans of notices and headers must hold the words and the version that name their licence, and no
word that names a neighbour.

Terms are lower-case runs of letters, digits and dots; an SPDX tag with its id (of an expression, the
first) is one term. They are weighted by idf over all documents: every term's document frequency is
counted. Those of template terms (a bounded table) come to the driver; spans are first scored with
bounds for all other terms, and what could reach THRESHOLD and be its text's best meets the counts of
its other terms in a salted join. The best span counts from THRESHOLD on. Files named as licence
files govern their directory: a file without a licence of its own inherits from the nearest ancestor
directory that has a licence file, found by joining paths of distinct directories.

Defined cases: null and empty texts have no spans; of equally good spans the one that starts on the
first line counts, then the template first by name; several licence files of a directory count by
best cosine, then name; null paths neither inherit nor govern; repeated rows give repeated results;
an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldquarry.llm.common import Scratch, small_batches, text_slices

THRESHOLD = 0.8
TERM = re.compile(r"[a-z0-9.]*[a-z0-9]")
TAG = "spdx-license-identifier:"
TAG_OR_TERM = re.compile(TAG + r"[ \t]*\(?[a-z0-9.+-]*[a-z0-9+]|" + TERM.pattern)
#: Terms of a template up to which runs within a text are compared with it; salts over which a term's rows are spread; terms
#: that a task counts before it passes them on.
WINDOW, SALTS, HELD_TERMS = 400, 64, 300_000

# One-line notices by which public licences are commonly declared.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("LGPL-2.1", "This library is free software under the GNU Lesser General Public License, version 2.1"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
)

# Titles and headers of licence texts, as files carry them, without comment signs.
_GNU = "This {what} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation{end}"
_LATER = "either version {v} of the License, or (at your option) any later version."
HEADERS = (
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("AGPL-3.0", _GNU.format(what="program", sep=":", name="Affero General Public License", end=", ") + _LATER.format(v=3)),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License version 3"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC0-1.0", "Creative Commons CC0 1.0 Universal"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-2.0", _GNU.format(what="program", sep=";", name="General Public License", end="; ") + _LATER.format(v=2)),
    ("GPL-2.0", "under the terms of the GNU General Public License version 2"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", _GNU.format(what="program", sep=":", name="General Public License", end=", ") + _LATER.format(v=3)),
    ("GPL-3.0", "under the terms of the GNU General Public License version 3"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-2.1", _GNU.format(what="library", sep=";", name="Lesser General Public License", end="; ") + _LATER.format(v="2.1")),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("LGPL-3.0", _GNU.format(what="library", sep=":", name="Lesser General Public License", end=", ") + _LATER.format(v=3)),
    ("MIT", "Licensed under the MIT License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
# Identifiers of SPDX tags; GNU licences also with a suffix.
SPDX = ("AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC-BY-4.0", "CC-BY-NC-4.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense")


#: Words that tell one licence from its neighbours. A span must hold those of its template, and no others of them.
NAMING = frozenset({
    "affero", "agpl", "apache", "attribution", "bsd", "cc", "cc0", "commons", "creative", "derivatives", "gnu", "gpl", "isc", "lesser", "lgpl", "library", "mit",
    "mozilla", "mpl", "nc", "nd", "noderivatives", "noderivs", "noncommercial", "sa", "sharealike", "unencumbered", "unlicense",
})
#: Of them, words that also stand in notices without naming anything.
PLAIN = frozenset({"library"})
#: Terms of a notice or header at most; longer templates are licence texts. Parts of their size that runs of a longer text have.
NOTICE, PARTS = 100, (1.0, 0.8)


def naming_terms(name: str, text: str) -> tuple[frozenset, frozenset]:
    """(terms that a span must hold, naming terms that it must not hold) of a template: its naming words and its version."""
    own = set(terms(text))
    version = re.search(r"\d+(\.\d+)?", name)
    forms = {version[0], version[0].removesuffix(".0")} if version else set()
    return frozenset((own & (NAMING - PLAIN)) | (own & forms)), NAMING - PLAIN - own


@cache
def all_templates() -> tuple[tuple[str, str], ...]:
    """Notices, headers, SPDX tags and the full texts in license_texts, by name (read on the driver)."""
    tags = [(n, f"{TAG} {n}{end}") for n in SPDX for end in (("", "+", "-only", "-or-later") if "GPL" in n else ("",))]
    full = [(f.name.removesuffix(".txt"), f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))]
    return tuple(sorted([*TEMPLATES, *HEADERS, *tags, *full], key=lambda t: t[0]))


def term_spans(text: str) -> list[tuple[str, int]]:
    """Terms of a lower-case text and where they start."""
    if TAG not in text:
        return [(m[0], m.start()) for m in TERM.finditer(text)]
    return [(re.sub(r"[ \t(]", "", m[0]), m.start()) for m in TAG_OR_TERM.finditer(text)]


def terms(text: str) -> list[str]:
    text = text.lower()
    return TERM.findall(text) if TAG not in text else [t for t, _ in term_spans(text)]


class Scanner:
    """Templates as a term matrix under given document frequencies."""

    def __init__(self, n_docs: int, df: dict[str, int], templates=TEMPLATES, threshold: float = THRESHOLD):
        self.names, self.threshold = [n for n, _ in templates], threshold
        short = lambda x: len(terms(x)) <= NOTICE and TAG not in x.lower()
        self.naming = [naming_terms(n, x) if short(x) else (frozenset(), frozenset()) for n, x in templates]
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for _, x in templates for t in terms(x)}))}
        idf = lambda d: np.log((1 + n_docs) / (1 + d)) + 1
        self.idf = np.array([idf(df.get(t, 0)) for t in self.vocabulary])
        self.unseen = float(idf(0))
        self.matrix = np.zeros((len(templates), len(self.vocabulary)))
        for i, (_, x) in enumerate(templates):
            for t in terms(x):
                self.matrix[i, self.vocabulary[t]] += 1
        self.matrix *= self.idf
        self.matrix /= np.linalg.norm(self.matrix, axis=1, keepdims=True)
        self.sizes = [len(terms(x)) for _, x in templates]
        self.share = np.ascontiguousarray((self.matrix**2).T)

    def candidates(self, text: str) -> list[dict]:
        """Spans that could reach the threshold and be the best, whatever the idf of other terms.

        A term's idf lies between 1 and that of an unseen one; both ends bound a span's cosine, and
        a span whose upper bound is below another's lower bound is not the best. Each comes with the
        scalar product, the squared norm of template terms, and its other terms with their counts.
        """
        text, floor = text.lower(), self.threshold - 1e-9
        present = [self.vocabulary[t] for t in self.vocabulary.keys() & set(terms(text))]
        if not present:
            return []
        # the terms a text shares with a template bound the cosine of all its spans
        hits = np.flatnonzero(self.share[present].sum(axis=0) >= floor**2)
        if not len(hits):
            return []
        found = term_spans(text)
        n, v = len(found), len(self.vocabulary)
        own: dict[str, int] = {}
        codes = np.array([i if (i := self.vocabulary.get(t)) is not None else v + own.setdefault(t, len(own)) for t, _ in found])
        others = list(own)
        code_of = lambda x: self.vocabulary.get(x, v + own[x] if x in own else None)
        line = np.searchsorted(np.array([m.start() for m in re.finditer("\n", text)], np.int64), np.array([a for _, a in found]))
        cuts = np.flatnonzero(np.diff(line)) + 1
        starts, stops = np.concatenate([[0], cuts, [0]]), np.concatenate([cuts, [n], [n]])
        weight = np.concatenate([self.idf, np.zeros(len(others))])
        norm = np.concatenate([[0.0], np.cumsum(np.where(codes < v, weight[codes] ** 2, 1.0))])  # at most a span's squared norm
        out: dict[tuple, dict] = {}
        for t in hits.tolist():
            a, z = starts, stops
            if self.sizes[t] <= WINDOW and self.sizes[t] < n:
                run = np.arange(n - self.sizes[t] + 1)
                a, z = np.concatenate([a, run]), np.concatenate([z, run + self.sizes[t]])
            row = np.concatenate([self.matrix[t] * self.idf, np.zeros(len(others))])
            dot = np.concatenate([[0.0], np.cumsum(row[codes])])
            for part in PARTS if self.sizes[t] > NOTICE else ():  # a licence text within a longer one: where it fits best
                if 0 < (size := int(part * self.sizes[t])) < n:
                    fit = (dot[size:] - dot[:-size]) / np.sqrt(np.maximum(norm[size:] - norm[:-size], 1e-12))
                    a, z = np.append(a, fit.argmax()), np.append(z, fit.argmax() + size)
            must, never = self.naming[t]
            must, never = {code_of(x) for x in must}, {code_of(x) for x in never} - {None}
            for i in np.flatnonzero(dot[z] - dot[a] >= floor * np.sqrt(norm[z] - norm[a])).tolist():
                u, c = np.unique(codes[a[i] : z[i]], return_counts=True)
                if must or never:
                    held = set(u.tolist())
                    if not must <= held or never & held:
                        continue
                known = u < v
                product, square, rest = float(row[u] @ c), float(((weight[u] * c)[known] ** 2).sum()), float((c[~known] ** 2).sum())
                if product >= floor * np.sqrt(square + rest):
                    key = (t, u.tobytes(), c.tobytes())
                    least, most = product / np.sqrt(square + rest * self.unseen**2), product / np.sqrt(square + rest)
                    one = {"line": int(line[a[i]]), "name": self.names[t], "product": product, "square": square, "least": least, "most": most, "terms": [others[x - v] for x in u[~known]], "times": c[~known].tolist()}
                    if key not in out or one["line"] < out[key]["line"]:
                        out[key] = one
        best = max((x["least"] for x in out.values() if x["least"] >= self.threshold), default=0.0)
        return [x for x in out.values() if x["most"] >= best - 1e-9]


def _frequencies(batches):
    """In how many documents each term is; a null term counts the documents."""
    held: Counter = Counter()
    docs = 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["term", "n"])

    for _, texts in text_slices(batches):
        for text in texts:
            docs += 1
            held.update(set(terms(text.as_py())))
            if len(held) > HELD_TERMS:
                yield rows()
                held.clear()
    yield rows()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([docs], pa.int64())], ["term", "n"])


SPANS = "array<struct<line:int,name:string,product:double,square:double,terms:array<string>,times:array<bigint>>>"


def _scan(n_docs: int, df: dict[str, int], templates, threshold: float):
    kind = pa.list_(pa.struct([("line", pa.int32()), ("name", pa.string()), ("product", pa.float64()), ("square", pa.float64()), ("terms", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))]))

    def run(batches):
        scanner = Scanner(n_docs, df, templates, threshold)
        for rows, texts in text_slices(batches, "row"):
            found = [scanner.candidates(t.as_py()) for t in texts]
            yield pa.RecordBatch.from_arrays([*rows.flatten(), pa.array(found, kind)], ["doc_id", "path", "spans"])

    return run


def _best_spans(found: DataFrame, counts: DataFrame, n_docs: int, threshold: float) -> DataFrame:
    """(rid, best: own_license, cosine, line): the cosines of all candidate spans with every term's own idf."""
    spans = found.where(F.size("spans") > 0).select("rid", F.posexplode("spans").alias("at", "s"))
    other = spans.select("rid", "at", F.explode(F.arrays_zip(F.col("s.terms").alias("term"), F.col("s.times").alias("times"))).alias("x"))
    other = other.select("rid", "at", "x.term", "x.times", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).alias("salt"))
    idf = F.log((1 + F.lit(float(n_docs))) / (1 + F.col("n"))) + 1
    asked = other.select("term", "salt").distinct().join(counts, "term").select("term", "salt", idf.alias("idf"))
    rest = other.join(asked, ["term", "salt"]).groupBy("rid", "at").agg(F.sum(F.pow(F.col("times") * F.col("idf"), 2)).alias("rest"))
    cosine = F.least(F.lit(1.0), F.col("s.product") / F.sqrt(F.col("s.square") + F.coalesce("rest", F.lit(0.0))))
    scored = spans.join(rest, ["rid", "at"], "left").select("rid", F.struct(F.col("s.name").alias("own_license"), cosine.alias("cosine"), F.col("s.line").alias("line")).alias("best"))
    scored = scored.where(F.col("best.cosine") >= threshold - 1e-12)
    return scored.groupBy("rid").agg(F.min_by("best", F.struct(-F.round("best.cosine", 12), F.col("best.line"), F.col("best.own_license"))).alias("best"))


def license_scan(docs: DataFrame, path: Column, id_col: str = "doc_id", text_col: str = "text", is_license_file: Column | None = None, templates=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, path, own_license, cosine, line, license, inherited_from (directory, '' for the root), as a stored table."""
    with Scratch() as scratch:
        return scratch.finish(_licensed(docs, path, id_col, text_col, is_license_file, templates, threshold, scratch), "license-scan")


def _licensed(docs: DataFrame, path: Column, id_col: str, text_col: str, is_license_file: Column | None, templates, threshold: float, scratch: Scratch) -> DataFrame:
    templates = all_templates() if templates is None else templates
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), path.alias("path"), F.col(text_col).alias("text"))
    vocabulary = sorted({t for _, x in templates for t in terms(x)})
    keyed = rows.select(F.struct("doc_id", "path").alias("row"), "text")
    counted = keyed.select(F.col("row").alias("doc_id"), "text").mapInArrow(_frequencies, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = scratch.put(counted, "license-terms")
    df = {r.term: r.n for r in counts.where(F.col("term").isNull() | F.col("term").isin(vocabulary)).collect()}  # one row for each template term
    n_docs = df.pop(None, 0) or 0
    scan = keyed.mapInArrow(_scan(n_docs, df, templates, threshold), f"doc_id long, path string, spans {SPANS}")
    scan = scratch.put(scan.withColumn("rid", F.monotonically_increasing_id()), "license-spans")
    scan = scan.select("rid", "doc_id", "path").join(_best_spans(scan, counts, n_docs, threshold), "rid", "left")
    scan = scan.select("doc_id", "path", F.col("best.own_license").alias("license"), F.coalesce("best.cosine", F.lit(0.0)).alias("cosine"), F.coalesce("best.line", F.lit(-1)).alias("line"))
    named = F.rlike("path", F.lit(r"(^|/)(LICEN[CS]E|COPYING)[^/]*$")) if is_license_file is None else is_license_file
    found = scratch.put(scan.withColumn("governs", F.coalesce(named, F.lit(False))).withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")), "licenses")
    files = found.where("governs AND license IS NOT NULL").groupBy("dir").agg(F.max_by("license", F.struct("cosine", "license")).alias("from_license"))
    files = scratch.put(files.withColumnRenamed("dir", "ancestor"), "license-files")
    # nearest ancestor: every distinct directory with its prefixes, the longest that is governed
    dirs = found.where("dir IS NOT NULL").select("dir").distinct()
    parts = F.split("dir", "/")
    ups = dirs.select("dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))).alias("ancestor")).distinct()
    near = ups.join(files, "ancestor").groupBy("dir").agg(F.max_by(F.struct("from_license", "ancestor"), F.length("ancestor")).alias("near"))
    near = scratch.put(near.select("dir", "near.from_license", "near.ancestor"), "license-dirs")
    out = found.join(near, "dir", "left")
    inherits = F.col("license").isNull()
    return out.select(
        "doc_id", "path", F.col("license").alias("own_license"), "cosine", "line",
        F.coalesce("license", "from_license").alias("license"), F.when(inherits, F.col("ancestor")).alias("inherited_from"),
    )


def corpus_path(doc_id: Column, source: Column, lang: Column) -> Column:
    """A path for a document table: source/lang/thousands/hundreds/id.

    By hash of the id, one file in 16 is a licence file, and one in 64 that of its source and language.
    """
    n = F.coalesce(doc_id, F.lit(0)).cast("long")
    h = F.crc32(n.cast("string"))
    top = F.concat_ws("/", F.coalesce(source, F.lit("-")), F.coalesce(lang, F.lit("-")))
    inner = F.concat_ws("/", F.floor(n / 1000).cast("string"), F.floor(n % 1000 / 100).cast("string"))
    name = F.concat(F.when(h % 16 == 0, F.lit("LICENSE-")).otherwise(F.lit("")), n.cast("string"), F.lit(".txt"))
    return F.when(h % 64 == 0, F.concat_ws("/", top, name)).otherwise(F.concat_ws("/", top, inner, name))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    return license_scan(docs, corpus_path(F.col("doc_id"), F.col("source"), F.col("lang")))
