"""Layout operators over OCR tokens (doc_id, page, idx, text, x, y): bands, order, boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldquarry.functions import text as T
from fieldquarry.operators import bands, rules

DOC = ("doc_id",)


def rectangle(bbox: Column) -> Column:
    """struct<x0, y0, x1, y1> of a polygon array<array<double>>."""
    xs, ys = F.transform(bbox, lambda p: p[0]), F.transform(bbox, lambda p: p[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


#: Shapes of OCR results: parallel lists under these names (each with its older one), alone or first in a list.
LISTS = "struct<rec_texts:array<string>,rec_text:array<string>,rec_scores:array<double>,rec_score:array<double>,dt_polys:array<array<array<double>>>,rec_polys:array<array<array<double>>>>"
LINES = "array<array<array<string>>>"


def decode_tokens(results: DataFrame, json_col: str = "result") -> DataFrame:
    """OCR result JSON as token rows: idx, text, score, bbox, y, x.

    Takes an object of parallel lists, a list that begins with one, or the old form, a list of lines
    [box, [text, score]] or [box, text] in a list. Tokens without text or a box of four corners go; a missing
    score is 1; null, empty and broken results have no tokens.
    """
    own, token = F.col(json_col), "array<struct<text:string,score:double,bbox:array<array<double>>>>"
    one = F.coalesce(F.get(F.from_json(F.when(F.rlike(own, F.lit(r"\A\s*\[\s*\{")), own), f"array<{LISTS}>"), F.lit(0)), F.from_json(F.when(F.rlike(own, F.lit(r"\A\s*\{")), own), LISTS))

    def lists(r: Column) -> Column:
        texts, scores, boxes = F.coalesce(r["rec_texts"], r["rec_text"]), F.coalesce(r["rec_scores"], r["rec_score"]), F.coalesce(r["dt_polys"], r["rec_polys"])
        return F.transform(texts, lambda t, i: F.struct(t.alias("text"), F.coalesce(F.get(scores, i), F.lit(1.0)).alias("score"), F.get(boxes, i).alias("bbox")))

    def line(x: Column) -> Column:
        said = F.get(x, F.lit(1))
        pair = F.from_json(F.when(F.startswith(said, F.lit("[")), said), "array<string>")
        return F.struct(F.coalesce(F.get(pair, F.lit(0)), said).alias("text"), F.coalesce(F.get(pair, F.lit(1)).try_cast("double"), F.lit(1.0)).alias("score"), F.from_json(F.get(x, F.lit(0)), "array<array<double>>").alias("bbox"))

    old = F.get(F.from_json(F.when(F.rlike(own, F.lit(r"\A\s*\[\s*\[")), own), LINES), F.lit(0))
    made = F.coalesce(T.let(one, lists), F.transform(old, line)).cast(token)
    rows = results.withColumn("__tokens", made).select(*[c for c in results.columns if c != json_col], F.posexplode("__tokens").alias("idx", "__t")).select("*", "__t.*").drop("__t")
    rows = rows.where("text <> '' AND bbox IS NOT NULL AND size(bbox) >= 4")
    return rows.withColumns({"y": (F.col("bbox")[0][1] + F.col("bbox")[2][1]) / 2, "x": F.col("bbox")[0][0]})


def reading_order(tokens: DataFrame, band: float = 20.0, keys: tuple[str, ...] = DOC) -> DataFrame:
    """rank of each token by its band (rounded half to even) and x, ties in input order."""
    w = Window.partitionBy(*keys).orderBy(F.bround(F.col("y") / band) * band, "x", "idx")
    return tokens.withColumn("rank", F.row_number().over(w))


def spatial_map(tokens: DataFrame, keys: tuple[str, ...] = DOC) -> DataFrame:
    """One row per normalised text: the last token with it, and where it first stood."""
    key = F.lower(F.trim(F.col("text")))
    return tokens.groupBy(*keys, key.alias("key")).agg(F.max_by("x", "idx").alias("x"), F.max_by("y", "idx").alias("y"), F.max("idx").alias("idx"), F.min("idx").alias("first_idx"))


def value_after_label(tokens: DataFrame, labels: tuple[str, ...], ahead: int = 3, band: float = 40.0, keys: tuple[str, ...] = DOC) -> DataFrame:
    """(keys, label, value): the first of the next tokens in the band, past punctuation, before a label."""
    w = Window.partitionBy(*keys).orderBy("idx")
    following = F.collect_list(F.struct("text", "y")).over(w.rowsBetween(1, ahead))
    low = F.lower(F.trim(F.col("text")))
    rows = tokens.withColumn("next", following).where(low.isin(*[x.lower() for x in labels]))
    near = F.filter("next", lambda t: F.abs(t["y"] - F.col("y")) < band)
    near = F.filter(near, lambda t: ~F.rlike(t["text"], F.lit(r"\A[\p{Punct}\s]*\z")))
    first = F.get(near, F.lit(0))["text"]
    return rows.select(*keys, low.alias("label"), F.when(~F.lower(F.trim(first)).isin(*[x.lower() for x in labels]), first).alias("value"))


def row_band(tokens: DataFrame, labels: tuple[str, ...], ahead: int = 19, band: float = 20.0, left: float = 250.0, keys: tuple[str, ...] = DOC) -> DataFrame:
    """(keys, label, standard, nms_engineer, on_site_teknisi, perbaikan, hasil_akhir) of table rows.

    The next tokens up to the first outside the band; those right of the label column, without
    repeats, by x; null columns unless the standard is there.
    """
    w = Window.partitionBy(*keys).orderBy("idx").rowsBetween(1, ahead)
    low = F.lower(F.trim(F.col("text")))
    rows = tokens.withColumn("next", F.collect_list(F.struct("x", "y", "text")).over(w)).where(low.isin(*[x.lower() for x in labels]))
    stop = F.array_position(F.transform("next", lambda t: F.abs(t["y"] - F.col("y")) > band), True)
    run = F.slice("next", 1, F.when(stop > 0, stop.cast("int") - 1).otherwise(F.size("next")))
    kept = F.array_sort(F.array_distinct(F.transform(F.filter(run, lambda t: t["x"] >= left), lambda t: F.struct(F.round(t["x"]).alias("x"), t["text"].alias("text")))))
    names = ("standard", "nms_engineer", "on_site_teknisi", "perbaikan", "hasil_akhir")
    return rows.withColumn("kept", kept).select(*keys, low.alias("label"), *[F.get("kept", F.lit(i))["text"].alias(n) for i, n in enumerate(names)])


def column_band(tokens: DataFrame, labels: tuple[str, ...], keys: tuple[str, ...] = DOC) -> DataFrame:
    """(keys, label, standard, existing): box join of labels with the tokens of two columns.

    Rows end five pixels above the next longer token of the left column, else 80 below the label.
    """
    low = F.lower(F.trim(F.col("text")))
    lab = tokens.where(low.isin(*[x.lower() for x in labels])).select(*keys, low.alias("label"), F.col("y").alias("ly"), F.col("idx").alias("li"))
    # the next left token below a label: both in one order, labels where their reach begins
    marks = lab.select(*keys, (F.col("ly") + 20).alias("at"), "label", "li", "ly", F.lit(None).cast("double").alias("ny"))
    left = tokens.where("x < 200 AND length(text) > 3").select(*keys, F.col("y").alias("at"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("int").alias("li"), F.lit(None).cast("double").alias("ly"), F.col("y").alias("ny"))
    below = Window.partitionBy(*keys).orderBy("at", F.col("label").isNotNull()).rowsBetween(1, Window.unboundedFollowing)
    ends = marks.unionByName(left).withColumn("ny", F.min("ny").over(below)).where("label IS NOT NULL")
    ends = ends.select(*keys, "label", "li", "ly", (F.col("ly") - 15).alias("low"), F.coalesce(F.col("ny") - 5, F.col("ly") + 80).alias("end"))
    box = bands.interval_join(tokens, ends, keys, "y", "low", "end", more=F.col("y") < F.col("end"))
    join = lambda cond: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(cond, F.struct("y", "x", "text")))), lambda t: t["text"]), " ")
    std = F.expr("x >= 300 AND x <= 650")
    ext = F.expr("x > 650 AND x <= 900 AND abs(y - ly) <= 15")
    return box.groupBy(*keys, "label", "li").agg(join(std).alias("standard"), join(ext).alias("existing")).drop("li")


def column_split(tokens: DataFrame, pattern: str, keys: tuple[str, ...] = DOC) -> DataFrame:
    """Tokens that match, with the side they are on: of a document's x range of 100 or more, its half."""
    hits = tokens.where(F.rlike("text", F.lit(pattern)))
    w = Window.partitionBy(*keys)
    hits = hits.withColumns({"x_min": F.min("x").over(w), "x_max": F.max("x").over(w)})
    wide = F.col("x_max") - F.col("x_min") >= 100
    return hits.withColumn("side", F.when(wide, F.when(F.col("x") < (F.col("x_min") + F.col("x_max")) / 2, "left").otherwise("right")).otherwise("single")).drop("x_min", "x_max")


def labels_without_context(tokens: DataFrame, label: str, context: str, reach: float = 200.0, keys: tuple[str, ...] = DOC) -> DataFrame:
    """Tokens that hold the label and have no token with the context within reach (anti join)."""
    hits = tokens.where(F.contains(F.lower("text"), F.lit(label.lower())))
    near = tokens.where(F.contains(F.lower("text"), F.lit(context.lower()))).select(*keys, (F.col("y") - reach).alias("__low"), (F.col("y") + reach).alias("__high"))
    inside = (F.col("y") > F.col("__low")) & (F.col("y") < F.col("__high"))
    return bands.interval_join(hits, near, keys, "y", "__low", "__high", width=reach, more=inside, how="left_anti")


def crop_plan(headers: DataFrame, page_height: float = 1000.0) -> DataFrame:
    """Crop rectangles (doc_id, label, page, y0, y1) from each label to the next, over pages between.

    headers: doc_id, label, page, y. Crops start 15 above the label and end 30 above the next one on
    the same page; otherwise they run to the page's end and on over whole pages up to the next label.
    Crops lower than a fifth of the page grow to that height.
    """
    w = Window.partitionBy("doc_id").orderBy("page", "y")
    h = headers.withColumns({"next_page": F.lead("page").over(w), "next_y": F.lead("y").over(w)})
    same = F.col("next_page") == F.col("page")
    y0 = F.greatest(F.col("y") - 15, F.lit(0.0))
    y1 = F.when(same, F.col("next_y") - 30).otherwise(F.lit(page_height))
    first = h.select("doc_id", "label", "page", y0.alias("y0"), F.least(F.greatest(y1, y0 + page_height / 5), F.lit(page_height)).alias("y1"))
    between = h.where("next_page > page").select("doc_id", "label", F.explode(F.sequence(F.col("page") + 1, F.col("next_page"))).alias("page"), "next_page", "next_y")
    end = F.when(F.col("page") == F.col("next_page"), F.col("next_y") - 30).otherwise(F.lit(page_height))
    more = between.select("doc_id", "label", "page", F.lit(0.0).alias("y0"), end.alias("y1")).where(F.col("y1") >= page_height / 5)
    return first.unionByName(more)


def crop_name(label: Column, page: Column, ending: str = "jpg") -> Column:
    """<label>_hal<page>.<ending>, blanks and slashes of the label as underlines."""
    return F.concat(F.translate(F.lower(label), " /", "__"), F.lit("_hal"), page.cast("string"), F.lit(f".{ending}"))


def crop_images(plan: DataFrame, rasters: DataFrame, page_height: float = 1000.0) -> DataFrame:
    """plan (doc_id, label, page, y0, y1) with `image`, its rows of the page's raster (binary PGM, 8 bits).

    Rasters: doc_id, page, image. A crop begins at the row that holds y0 and ends with the one that
    y1 cuts. Pages without a raster, or with one of another form, give null.
    """
    head = F.regexp_extract(F.substring("image", 1, 64).cast("string"), r"(?s)\AP5\s(\d+)\s(\d+)\s255\s", 0)
    number = lambda i: F.regexp_extract(head, r"(?s)\AP5\s(\d+)\s(\d+)", i).try_cast("int")
    p = plan.join(rasters.select("doc_id", "page", "image"), ["doc_id", "page"], "left")
    p = p.withColumns({"__w": number(1), "__h": number(2), "__at": F.octet_length(head)})
    first, last = F.floor(F.col("y0") / page_height * F.col("__h")).cast("int"), F.ceil(F.col("y1") / page_height * F.col("__h")).cast("int")
    cut = F.substr("image", F.col("__at") + 1 + first * F.col("__w"), (last - first) * F.col("__w"))
    made = F.concat(F.format_string("P5\n%d %d\n255\n", F.col("__w"), last - first).cast("binary"), cut)
    return p.withColumn("image", F.when(F.col("__w").isNotNull(), made)).drop("__w", "__h", "__at")


def valid_header(spans: DataFrame, page_height: float = 1000.0) -> DataFrame:
    """Headings: type of 10 points or more, in the upper 85 %, nothing within 100 to the left on the line."""
    other = spans.select("doc_id", "page", F.col("x").alias("ox"), F.col("y").alias("oy"), (F.col("y") - 10).alias("__low"), (F.col("y") + 10).alias("__high"))
    s = spans.where((F.col("size") >= 10) & (F.col("y") / page_height <= 0.85))
    beside = (F.abs(F.col("y") - F.col("oy")) < 10) & (F.col("ox") < F.col("x")) & (F.col("ox") >= F.col("x") - 100)
    return bands.interval_join(s, other, ("doc_id", "page"), "y", "__low", "__high", width=20.0, more=beside, how="left_anti")


def near_box(tokens: DataFrame, x: float, y: float, margin: float) -> DataFrame:
    """Tokens within a margin of a point."""
    return tokens.where((F.abs(F.col("x") - x) <= margin) & (F.abs(F.col("y") - y) <= margin))


def device_names(tokens: DataFrame, pattern: str, left: float = 400.0, right: float = 600.0, above: float = 60.0, keys: tuple[str, ...] = DOC) -> DataFrame:
    """(keys, no_reg, side, name): the tokens of a device's name column just above or beside its number.

    Numbers are found inside tokens. Names stand up to `left` in the left column, from `right` on in
    the right one; single characters, dates, times and words that forms print are no part of them.
    """
    hits = column_split(tokens, pattern, keys).select(*keys, F.regexp_extract("text", pattern, 0).alias("no_reg"), "side", F.col("idx").alias("ri"), (F.col("y") - above).alias("__low"), F.col("y").alias("__high"))
    low = F.lower(F.trim("text"))
    printed = F.rlike(low, F.lit("(?<![a-z])(?:" + "|".join(w.replace(".", r"\.") for w in rules.DEVICE_SKIPPED) + ")(?![a-z])"))
    words = tokens.where(~F.rlike("text", F.lit(pattern)) & (F.length(F.trim("text")) >= 2) & ~printed & ~F.rlike("text", F.lit(r"\A\s*(\d{2}-[A-Za-z]{3}-\d{4}|\d{2}:\d{2})")))
    column = F.when(F.col("side") == "right", F.col("x") >= right).otherwise(F.col("x") <= left)
    joined = bands.interval_join(words, hits, keys, "y", "__low", "__high", width=above, more=(F.col("y") > F.col("__low")) & column)
    joined = joined.groupBy(*keys, "ri", "no_reg", "side").agg(F.array_sort(F.collect_list(F.struct("y", "x", "text"))).alias("t"))
    return joined.select(*keys, "no_reg", "side", F.array_join(F.transform("t", lambda w: w["text"]), " ").alias("name"))
