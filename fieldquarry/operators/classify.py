"""Document classification: codes, titles, chains, confidence, categories, parser status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldquarry.functions import text as T
from fieldquarry.operators import rules

CODE = r"FM-LAP-?\s*D2-SOP-003-(\d{3})"


def first_of(pairs: list[tuple[Column, Column | str]], default: Column | str | None = None) -> Column:
    out = F
    for cond, value in pairs:
        out = out.when(cond, value)
    return out.otherwise(default) if default is not None else out


def any_in(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def count_in(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def pm_by_code(text: Column) -> Column:
    """Form type by its document code (case-sensitive); null for an unknown code."""
    known = F.create_map(*[F.lit(x) for pair in rules.PM_CODES.items() for x in pair])
    return F.when(F.contains(text, F.lit("FM-LAP")), F.try_element_at(known, F.regexp_extract(text, CODE, 1)))


def pm_by_title(text: Column) -> Column:
    """Form type by the first title that the text holds, whole words only."""
    return T.let(F.lower(text), _by_title)


#: What each title holds one of.
_IN_TITLES = tuple(dict.fromkeys("preventive" if "preventive" in t else t for t, _ in rules.PM_TITLES))


def _by_title(low: Column) -> Column:
    # most texts go by one word, most titles by their letters, before any pattern
    return F.when(any_in(low, _IN_TITLES), first_of([(F.contains(low, F.lit(t)) & F.rlike(low, F.lit(t.replace("-", r"\-") + r"(?![a-z0-9])")), v) for t, v in rules.PM_TITLES]))


def document_type(text: Column) -> Column:
    return F.coalesce(pm_by_code(text), T.let(F.lower(text), lambda low: F.coalesce(_by_title(low), _by_words(low))))


def _by_words(low: Column) -> Column:
    has = lambda *w: reduce(lambda a, b: a & b, [F.contains(low, F.lit(x)) for x in w])
    listed = F.when(has("checklist"), first_of([(has("wireline"), "checklist_wireline"), (has("wireless"), "checklist_wireless")]))
    ordered = F.when(has("spk"), first_of([(has(k), f"spk_{k}") for k in rules.ORDER_KINDS]))
    return F.coalesce(listed, ordered, F.lit("unknown"))


def confidence(text: Column, doc_type: Column) -> Column:
    """high, medium or low; a document code makes a form's confidence high."""
    return T.let(F.lower(text), lambda low: F.when(F.startswith(doc_type, F.lit("form_pm_")), T.let(F.regexp_replace(F.trim(low), r"\s+", " "), _form_level)).otherwise(_word_level(low, doc_type)))


def _form_level(plain: Column) -> Column:
    score = reduce(lambda a, b: a + b, [2 * F.rlike(plain, F.lit(p)).cast("int") for p in rules.PM_STRONG]) + count_in(plain, rules.PM_SUPPORT)
    coded = F.rlike(plain, F.lit(CODE.lower().replace(r"\\d", r"\d")))
    return T.let(score, lambda s: F.when(coded | (s >= 6), "high").when(s >= 3, "medium").otherwise("low"))


def _word_level(low: Column, doc_type: Column) -> Column:
    hits = first_of([(doc_type == t, count_in(low, words)) for t, words in rules.TYPE_KEYWORDS.items()], F.lit(0))
    return T.let(hits, lambda h: F.when(h >= 3, "high").when(h >= 2, "medium").otherwise("low"))


def category_table(spark: SparkSession) -> DataFrame:
    """(category, document_type, folder, parsing_status): a small lookup."""
    rows = [(c, t, f"{c}/{t}", "not_implemented" if t in rules.NOT_IMPLEMENTED else "success") for c, ts in rules.CATEGORIES.items() for t in ts]
    return spark.createDataFrame(rows, "category string, document_type string, folder string, parsing_status string")


def with_envelope(docs: DataFrame, type_col: str = "document_type") -> DataFrame:
    """Category, folder and parsing status of each document; unknown types have a status of their own."""
    known = category_table(docs.sparkSession).withColumnRenamed("document_type", "t_type")
    out = docs.join(F.broadcast(known), F.col(type_col) == F.col("t_type"), "left").drop("t_type")
    return out.withColumn("parsing_status", F.coalesce("parsing_status", F.lit("unknown_document_type")))


def validate(docs: DataFrame, expected_col: str) -> DataFrame:
    """Whether the found type belongs to the expected category."""
    return with_envelope(docs).withColumn("is_valid", F.coalesce(F.col("category") == F.col(expected_col), F.lit(False)))
