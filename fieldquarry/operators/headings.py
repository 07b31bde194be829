"""Labels in texts: containment by a gram index, headings with wrong letters, image sections over pages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldquarry.operators import rules

GRAM = 3
#: Labels that are broadcast at most, with their grams; more are shuffled.
MANY_LABELS = 20_000


def plain(text: Column) -> Column:
    """text without case, blanks and punctuation."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "")


def _grams(text: Column, size: int) -> Column:
    at = F.sequence(F.lit(1), F.length(text) - (size - 1))
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(at, lambda i: F.substr(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label_key) for each label_key that a text holds; both are distinct, normalised strings.

    An inverted index on grams: of each label's grams the one that fewest texts hold is looked up,
    and only texts that hold it are searched. Labels shorter than a gram are grams themselves; empty
    ones are held by nothing. What is broadcast is said here, as Spark guesses texts from `explode` too small.
    """
    few = labels.limit(MANY_LABELS + 1).count() <= MANY_LABELS
    known = F.broadcast if few else lambda df: df.hint("merge")
    sizes = F.explode(F.array(*[F.lit(i) for i in range(1, GRAM + 1)]))
    size = F.least(F.lit(GRAM), F.length("label_key"))
    whole = labels.where("label_key <> ''").withColumn("size", size)
    grams = whole.withColumn("gram", F.explode(F.when(F.col("size") == 1, _grams(F.col("label_key"), 1)).when(F.col("size") == 2, _grams(F.col("label_key"), 2)).otherwise(_grams(F.col("label_key"), GRAM))))
    wanted = grams.select("size", "gram").distinct()
    held = texts.withColumn("size", sizes)
    made = F.when(F.col("size") == 1, _grams(F.col("text"), 1)).when(F.col("size") == 2, _grams(F.col("text"), 2)).otherwise(_grams(F.col("text"), GRAM))
    posted = held.join(F.broadcast(wanted.select("size").distinct()), "size").select("text", "size", F.explode(made).alias("gram")).join(known(wanted), ["size", "gram"])
    counts = posted.groupBy("size", "gram").agg(F.count("*").alias("n"))
    rarest = grams.join(counts.hint("merge"), ["size", "gram"], "left").groupBy("label_key").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "size", "gram")).alias("g"))
    chosen = rarest.where("g.n > 0").select("label_key", F.col("g.size").alias("size"), F.col("g.gram").alias("gram"))
    return posted.join(known(chosen), ["size", "gram"]).where(F.contains("text", F.col("label_key"))).select("text", "label_key")


def find_labels(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """Each token (with its columns) for each label (with its columns) that it holds, compared as `plain` does.

    Any number of labels; tokens' distinct texts are searched once. A null text holds nothing.
    """
    t = tokens.withColumn("__text", plain(F.col("text")))
    wanted = labels.withColumn("__label", plain(F.col("label")))
    pairs = contained(t.select(F.col("__text").alias("text")).where("text IS NOT NULL").distinct(), wanted.select(F.col("__label").alias("label_key")).where("label_key IS NOT NULL").distinct())
    pairs = pairs.select(F.col("text").alias("__text"), F.col("label_key").alias("__label"))
    return t.join(pairs.join(wanted.hint("merge"), "__label").hint("merge"), "__text").drop("__text", "__label")


# ---- headings with wrong letters ----------------------------------------------------------------
def least_errors(pattern: str, text: str) -> int:
    """Fewest letters changed, lost or added between the pattern and any part of the text, by bit vectors over the pattern."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    ones, top = (1 << len(pattern)) - 1, 1 << len(pattern) >> 1
    up, down, score = ones, 0, len(pattern)
    best = score
    for c in text:
        same = masks.get(c, 0)
        v = same | down
        h = (((same & up) + up) ^ up) | same
        more, less = down | ~(h | up) & ones, up & h
        score += bool(more & top) - bool(less & top)
        best = min(best, score)
        more, less = more << 1 & ones, less << 1 & ones
        up, down = less | ~(v | more) & ones, more & v
    return best


def allowed(pattern: str) -> int:
    """Wrong letters that a heading may have: one for each six, two at most."""
    return min(2, len(pattern) // 6)


def near_headings(lines: DataFrame, headings: dict[str, str], keep: tuple[str, ...] = ("doc_id", "line_no")) -> DataFrame:
    """(keep, section, errors) of lines (text) that hold a heading with at most its allowed errors.

    headings: section -> words, compared without case, blanks and punctuation. With k errors one of
    k + 1 parts of the heading is whole: only lines that hold such a part leave the JVM.
    """
    wanted = {s: "".join(c for c in h.lower() if c.isascii() and c.isalnum()) for s, h in headings.items()}
    parts = {p[i * len(p) // (allowed(p) + 1) : (i + 1) * len(p) // (allowed(p) + 1)] for p in wanted.values() for i in range(allowed(p) + 1)}
    likely = F.lit(False)
    for part in sorted(parts):
        likely |= F.contains("__plain", F.lit(part))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("__plain").to_pylist()
            found = [(i, s, e) for i, t in enumerate(texts) for s, p in wanted.items() if (e := least_errors(p, t)) <= allowed(p)]
            rows = pa.array([i for i, *_ in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(k).take(rows) for k in keep), pa.array([s for _, s, _ in found], pa.string()), pa.array([e for *_, e in found], pa.int32())], [*keep, "section", "errors"])

    rows = lines.select(*keep, plain(F.col("text")).alias("__plain")).where(likely)
    kinds = ", ".join(f"`{n}` {k}" for n, k in rows.dtypes if n != "__plain")
    return rows.mapInArrow(run, f"{kinds}, section string, errors int")


def sections(lines: DataFrame, table: dict[str, tuple[str, tuple[str, ...], int]] = rules.CHECKLIST_SECTIONS, ends: tuple[str, ...] = rules.CHECKLIST_ENDS) -> DataFrame:
    """(doc_id, section, first_line, last_line, hits): each document's sections by approximate headings.

    lines: doc_id, line_no, text. table: section -> (heading, keywords, least). A section runs from its
    heading to the line before the next heading of another section or before an end word; of several
    stretches the first with at least `least` of its keywords counts.
    """
    marks = near_headings(lines, {s: h for s, (h, _, _) in table.items()} | {f"end {e}": e for e in ends})
    w = Window.partitionBy("doc_id", "line_no").orderBy("errors", "section")
    marks = marks.withColumn("n", F.row_number().over(w)).where("n = 1").select("doc_id", "line_no", F.col("section").alias("mark"))
    named = lines.join(marks, ["doc_id", "line_no"], "left")
    before = Window.partitionBy("doc_id").orderBy("line_no")
    named = named.withColumn("section", F.last("mark", ignorenulls=True).over(before)).where("section IS NOT NULL")
    named = named.withColumn("__new", (~F.col("section").eqNullSafe(F.lag("section").over(before))).cast("int"))
    named = named.withColumn("run", F.sum("__new").over(before)).where(~F.startswith("section", F.lit("end ")))
    upper = F.upper("text")
    words = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(k).alias("k")) for s, (_, keys, _) in table.items() for k in keys])
    hits = F.transform(F.filter(words, lambda x: (x["s"] == F.col("section")) & F.contains(upper, x["k"])), lambda x: x["k"])
    runs = named.groupBy("doc_id", "section", "run").agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"), F.size(F.array_distinct(F.flatten(F.collect_set(hits)))).alias("hits"))
    least = F.create_map(*[F.lit(x) for s, (_, _, n) in table.items() for x in (s, n)])
    runs = runs.where(F.col("hits") >= F.try_element_at(least, "section"))
    first = Window.partitionBy("doc_id", "section").orderBy("run")
    return runs.withColumn("n", F.row_number().over(first)).where("n = 1").select("doc_id", "section", "first_line", "last_line", "hits")


# ---- image sections over pages ------------------------------------------------------------------
#: Parts of a page's height: above TOP a heading ends a section before the page; a crop is LEAST high.
TOP, LEAST = 0.3, 0.2
#: A page with fewer words belongs to the section that goes on, unless another label is on it.
FEW_WORDS = 20


def continued_crops(found: DataFrame, pages: DataFrame, labels: tuple[str, ...], height: float = 1000.0) -> DataFrame:
    """(doc_id, label, page, y0, y1): image sections from their label on, over the pages that go on.

    found: doc_id, page, label, y of labels and stop headings on pages. pages: doc_id, page, n_words. Of
    a page's labels the first in `labels` begins a section, 15 above it and to the page's end; later
    pages belong to it whole up to the first page with another label, or with a stop heading: in the
    upper three tenths (by its mean y) the page is left out, else it is taken down to 30 above the
    heading, if that is a fifth of the page or more. A section's own word does not end it. Stop headings
    of pages with fewer than FEW_WORDS words count only at the top, and only the strongest of them.

    Pages with headings are islands of one and the same word: a section ends at the next such page
    of another word, which is that page or the first of the island after it.
    """
    order = F.create_map(*[F.lit(x) for i, n in enumerate(labels) for x in (n.upper(), i)])
    names = F.create_map(*[F.lit(x) for n in labels for x in (n.upper(), n)])
    marks = found.withColumn("word", F.upper("label")).groupBy("doc_id", "page", "word").agg(F.avg("y").alias("mean_y"), F.min("y").alias("least_y"))
    marks = marks.withColumn("place", F.try_element_at(order, "word")).join(pages.select("doc_id", "page", "n_words"), ["doc_id", "page"])
    early = F.upper(F.col("word")).isin(*rules.IMAGE_TOP_STOPS) & (F.col("mean_y") < TOP * height)
    counts = F.col("place").isNotNull() | early | (F.col("n_words") >= FEW_WORDS)
    heads = F.struct("word", "place", "mean_y", "least_y")
    by_page = marks.where(counts).groupBy("doc_id", "page").agg(F.collect_list(heads).alias("heads"))  # as many as there are known words
    by_page = by_page.withColumn("sign", F.when(F.size("heads") == 1, F.col("heads")[0]["word"]))  # null: several words
    start = F.array_min(F.transform(F.filter("heads", lambda h: h["place"].isNotNull()), lambda h: F.struct(h["place"], h["word"], h["least_y"])))
    by_page = by_page.withColumns({"started": start["word"], "start_y": start["least_y"]})
    w = Window.partitionBy("doc_id").orderBy("page")
    by_page = by_page.withColumn("__new", F.coalesce((F.col("sign") != F.lag("sign").over(w)), F.lit(True)).cast("int"))
    by_page = by_page.withColumn("island", F.sum("__new").over(w))
    begins = Window.partitionBy("doc_id").orderBy("island")
    islands = by_page.groupBy("doc_id", "island").agg(F.min("page").alias("island_page")).withColumn("after_page", F.lead("island_page").over(begins))
    by_page = by_page.join(islands, ["doc_id", "island"]).withColumns({"next_page": F.lead("page").over(w), "next_sign": F.lead("sign").over(w), "next_after": F.lead("after_page").over(w), "before": F.lag("started").over(w)})
    sections_ = by_page.where(F.col("started").isNotNull() & ~(F.col("sign").eqNullSafe(F.col("started")) & F.col("before").eqNullSafe(F.col("started"))))
    same = F.coalesce(F.col("next_sign") == F.col("started"), F.lit(False))
    sections_ = sections_.select("doc_id", F.col("started").alias("word"), "page", "start_y", F.when(same, F.col("next_after")).otherwise(F.col("next_page")).alias("stop"))
    last = pages.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    sections_ = sections_.join(last, "doc_id").withColumn("label", F.try_element_at(names, "word"))
    first = sections_.select("doc_id", "label", "page", F.greatest(F.col("start_y") - 15, F.lit(0.0)).alias("y0"), F.lit(height).alias("y1"))
    until = F.coalesce(F.col("stop") - 1, F.col("last_page"))
    whole = sections_.where(until > F.col("page")).select("doc_id", "label", F.explode(F.sequence(F.col("page") + 1, until)).alias("page"), F.lit(0.0).alias("y0"), F.lit(height).alias("y1"))
    stops = by_page.select("doc_id", F.col("page").alias("stop"), "heads")
    ended = sections_.where("stop IS NOT NULL").join(stops, ["doc_id", "stop"])
    others = F.filter("heads", lambda h: h["word"] != F.col("word"))
    cut = F.exists(others, lambda h: h["place"].isNotNull() | (h["mean_y"] < TOP * height))
    end = F.array_min(F.transform(others, lambda h: h["least_y"])) - 30
    partly = ended.where(~cut & (end >= LEAST * height)).select("doc_id", "label", F.col("stop").alias("page"), F.lit(0.0).alias("y0"), end.alias("y1"))
    return first.unionByName(whole).unionByName(partly)
