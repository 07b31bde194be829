"""Text functions on columns: normalisers, field search, dates and paths. All inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Flags under which Java's regular expressions read like the usual ones of Python (ignore case,
#: multi-line, dot-all; Unix lines and Unicode classes).
SEARCH_FLAGS = "(?imsdU)"
LABEL_LINE = r"^[A-Za-z ]+:?\z"


def lit(x) -> Column:
    return F.lit(x)


def let(value: Column, use) -> Column:
    """use(value) with value computed once: inside lambdas Catalyst would compute it for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: White space as Unicode has it: what `(?U)\s` takes.
BLANKS = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def strip(c: Column) -> Column:
    """Without white space at both ends; no pattern, as lines are stripped more often than all else is done."""
    return F.btrim(c, lit(BLANKS))


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def is_plain(c: Column, also: str = "") -> Column:
    """Whether a text is ASCII and has no blanks but line feeds and spaces, nor one of the other characters."""
    return is_ascii(c) & ~F.rlike(c, lit(r"[\t\x0b-\x0d" + also + "]"))


def lines_of(c: Column, keep_blank: bool = False) -> Column:
    """Stripped lines. Plain texts, which are most, are split and stripped without a pattern."""
    out = let(c, lambda t: F.when(is_plain(t), F.transform(F.split(t, "\n", -1), lambda x: F.trim(x))).otherwise(F.transform(F.split(t, r"\R", -1), strip)))
    return out if keep_blank else F.filter(out, lambda x: x != "")


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without a match (an empty group stays empty)."""
    return F.when(F.rlike(text, lit(pattern)), F.regexp_extract(text, pattern, group))


def held(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, '' without a match or a text: for values whose absence and emptiness are one."""
    return F.coalesce(F.regexp_extract(text, pattern, group), lit(""))


#: Characters other than letters A to Z that a pattern of such letters takes when it ignores case by Unicode.
FOLDED = "\u017f\u0131\u0130\u212a"


def folded(text: Column) -> Column:
    """struct<low, odd>: the text in lower case, and whether characters are in it whose lower case does not tell what patterns take."""
    return F.struct(F.lower(text).alias("low"), is_odd(text).alias("odd"))


def is_odd(text: Column) -> Column:
    return ~is_ascii(text) & reduce(lambda a, b: a | b, [F.contains(text, lit(c)) for c in FOLDED])


def may_hold(fold: Column, words: tuple[str, ...]) -> Column:
    """Whether a pattern of these words, ignoring case, can match the text of a fold: cheap, before a pattern runs over it."""
    return reduce(lambda a, b: a & b, [F.contains(fold["low"], lit(w.lower())) for w in words], lit(True)) | fold["odd"]


def label_words(pattern: str) -> tuple[str, ...]:
    """The words that a field's pattern has before its first group; none unless they stand there plainly."""
    plain = re.sub(r"\\s[*+]|\\\.\??| [*+]|:|\[1-3\]", " ", pattern.split("(")[0])
    return tuple(plain.split()) if re.fullmatch(r"[A-Za-z ]*", plain) else ()


def join_key_values(text: Column) -> Column:
    """'Key', ':', 'Value' on lines of their own become 'Key: Value'; lines are stripped."""
    text = F.regexp_replace(text, r"(?U)([A-Za-z0-9.\s]+)\n\s*:\s*\n\s*", "$1: ")
    text = F.regexp_replace(text, r"(?U)([A-Za-z0-9.\s]+)\n\s*:\s*", "$1: ")
    return F.array_join(lines_of(text, keep_blank=True), "\n")


def clean_space(text: Column) -> Column:
    text = F.regexp_replace(text, r"[\r\t]+", " ")
    text = F.regexp_replace(text, r" {2,}", " ")
    return F.regexp_replace(text, r"\n+", "\n")


def plain_dashes(text: Column) -> Column:
    return F.translate(text, "−–—―", "----")


def clean_checklist(text: Column) -> Column:
    """Misread months, runs of spaces and full-width colons."""
    text = F.regexp_replace(text, r"(?i)\bJum\b", "Jun")
    return F.replace(F.regexp_replace(text, r" +", " "), lit("："), lit(":"))


def key_of(label: Column) -> Column:
    """A label as a snake-case key, with the two agreed short names."""
    key = F.translate(F.lower(label), " /-.()", "___")
    key = F.replace(key, lit("bersedia_dipasang_perangkat"), lit("fo"))
    return F.replace(key, lit("penanggungjawab_pengurusan_dan_pembayaran_sewa"), lit("penanggungjawab_sewa"))


def search_field(text: Column, pattern: str, multiline: bool = False, fold: Column | None = None) -> Column:
    """The first group of pattern, by the field rules.

    Empty captures take the line after the first label line, unless it looks like a label itself;
    single-line values that hold a line break or a colon count as missing; multi-line values are
    joined by spaces. With the text's fold, texts without the label's words are passed over.
    """
    p, words = SEARCH_FLAGS + pattern, label_words(pattern)
    value = strip(F.regexp_extract(text, p, 1))

    def after(lines: Column) -> Column:
        pairs = F.transform(lines, lambda x, i: F.struct(x.alias("own"), strip(F.coalesce(F.get(lines, i + 1), lit(""))).alias("next")))
        good = F.filter(pairs, lambda x: F.rlike(x["own"], lit("(?iU)" + pattern)) & (x["next"] != "") & ~F.rlike(x["next"], lit(LABEL_LINE)))
        return F.get(good, lit(0))["next"]

    def good(v: Column) -> Column:
        if multiline:
            return strip(F.regexp_replace(v, r"(?U)\s*\n\s*", " "))
        return F.when(~F.contains(v, lit("\n")) & ~F.contains(v, lit(":")), v)

    # what is empty may be no match
    found_ = let(value, lambda v: F.when(v == "", F.when(F.rlike(text, lit(p)), let(F.split(text, r"\R", -1), after))).otherwise(good(v)))
    return found_ if fold is None else F.when(may_hold(fold, words), found_)


def section(text: Column, start: str, end: str) -> Column:
    """Text between two patterns, or to the end of the text."""
    return found(text, rf"(?iU){start}([\s\S]*?)(?={end}|\z)")


def split_report(text: Column, mark: str = "BERITA ACARA") -> tuple[Column, Column]:
    """(before, after) the first mark; without it the whole text and an empty report."""
    at = F.instr(text, mark)
    return (
        strip(F.when(at > 0, F.substring(text, lit(1), at - 1)).otherwise(text)),
        F.when(at > 0, strip(F.substring(text, at + len(mark), F.length(text)))).otherwise(lit("")),
    )


STAMP = r"\d{2}/[A-Za-z]{3}/\d{4}\s+\d{2}:\d{2}"
DATE, CLOCK = r"\d{1,2}[-/][A-Za-z]{3}[-/]\d{4}", r"\d{1,2}[:.]\d{2}"


def nth_match(text: Column, pattern: str, n: int, group: int = 0) -> Column:
    """The n-th match (from 0), or the empty string."""
    return F.coalesce(F.get(F.regexp_extract_all(text, lit(pattern), lit(group)), lit(n)), lit(""))


def date_time_text(text: Column) -> Column:
    """Date and clock, also where they touch; else the date, else the clock, else null."""
    both = found(text, rf"({DATE})\s*({CLOCK})", 1), found(text, rf"({DATE})\s*({CLOCK})", 2)
    return F.coalesce(F.when(both[0].isNotNull(), F.concat(both[0], lit(" "), both[1])), found(text, f"({DATE})"), found(text, f"({CLOCK})"))


def stamp(text: Column) -> Column:
    """The typed companion of date_time_text."""
    return F.coalesce(F.try_to_timestamp(text, lit("d-MMM-yyyy HH:mm")), F.try_to_timestamp(text, lit("d/MMM/yyyy HH:mm")), F.try_to_timestamp(text, lit("d-MMM-yyyy")))


def zip_dates(text: Column) -> Column:
    """array<string>: i-th date with i-th clock; dates without a clock stay alone."""
    dates = F.regexp_extract_all(text, lit(f"({DATE})"), lit(1))
    clocks = F.regexp_extract_all(text, lit(rf"(?<![\d:])(\d{{2}}:\d{{2}})(?![\d:])"), lit(1))
    return F.transform(dates, lambda d, i: F.when(F.get(clocks, i).isNotNull(), F.concat(d, lit(" "), F.get(clocks, i))).otherwise(d))


def decimal(c: Column) -> Column:
    """Numbers with a decimal comma or point; null if neither."""
    return F.replace(c, lit(","), lit(".")).try_cast("double")


def relative_path(path: Column, base: str) -> Column:
    """Below base, with forward slashes."""
    return F.regexp_replace(F.translate(path, "\\", "/"), "^" + base.rstrip("/").replace(".", r"\.") + "/", "")


#: A JSON member whose key tells of a path, with its text value.
PATH_MEMBER = r'(?<!\\)"(?:[^"\\]*(?:patch_foto|(?i:path))[^"\\]*)"\s*:\s*"(?:[^"\\]++|\\.)*+"'


def relative_paths(json: Column, base: str) -> Column:
    """JSON with every path below base made relative, at any depth: text values of keys with 'path' or 'patch_foto'.

    Such values get forward slashes; those elsewhere keep their place. Other members stay as they are.
    """
    plain = base.replace("\\", "/").rstrip("/")

    def one(member: Column) -> Column:
        value = F.regexp_replace(F.regexp_extract(member, r'(?s)\A"[^"]*"\s*:\s*"(.*)"\z', 1), r"\\\\|\\/", "/")
        inside = F.startswith(value, lit(plain + "/"))
        return F.concat(F.regexp_extract(member, r'(?s)\A("[^"]*"\s*:\s*")', 1), F.when(inside, F.substring(value, lit(len(plain) + 2), F.length(value))).otherwise(value), lit('"'))

    members = F.concat(F.transform(F.regexp_extract_all(json, lit(PATH_MEMBER), lit(0)), one), F.array(lit("")))
    return F.array_join(F.zip_with(F.split(json, PATH_MEMBER, -1), members, lambda a, b: F.concat(a, F.coalesce(b, lit("")))), "")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)


def folder_name(doc_type: Column, at: Column) -> Column:
    """The type without its first word, and the time."""
    return F.concat(F.regexp_replace(doc_type, r"\A[^_]*_", ""), lit("_"), F.date_format(at, "yyyyMMdd_HHmmss"))


def drop_repeated_words(text: Column, most: int = 10) -> Column:
    """Consecutive equal words (any case) count once; the last `most` words stay."""
    words = F.filter(F.split(F.regexp_replace(text, r"(?iU)\b(?:nama\s+barang|no\.?\s*reg(?:istrasi)?|serial\s+number)\b", " "), r"\s+"), lambda x: x != "")
    kept = let(words, lambda ws: F.filter(ws, lambda x, i: (i == 0) | (F.lower(x) != F.lower(F.coalesce(F.get(ws, i - 1), lit(""))))))
    return let(kept, lambda k: F.array_join(F.slice(k, F.greatest(lit(1), F.size(k) - most + 1), most), " "))
