"""Field extraction from document text: work-order sections, label folds, groups, devices, voltages."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldquarry.functions import text as T
from fieldquarry.operators import rules

EMAIL = r"[\w.-]+@[\w.-]+\.\w+"


def order_parts(text: Column, sections: tuple[str, ...] = (*rules.SECTIONS, "pelaksanaan")) -> dict[str, Column]:
    """Sections by the field tables, and the three positional stamps; a column for each, so that a record holds none twice."""
    one = lambda name: T.let(order_values(text, (name,)), lambda v: order_section(v, name))
    return {name: stamps(text) if name == "pelaksanaan" else one(name) for name in sections}


_BEHIND = r"\s*:\s*"


def _value_name(pattern: str, part: str) -> str:
    """A field's name among the values: the letters of its label or title, and its part of the text."""
    return f"{part}_{_label_key(pattern)}"


def _label_key(pattern: str) -> str:
    return re.sub(r"\\s|\[.*?\]|[^A-Za-z]", "", pattern.split(_BEHIND)[0]).lower()


def order_values(text: Column, sections: tuple[str, ...] = tuple(rules.SECTIONS)) -> Column:
    """struct of each distinct field of the sections, once however many sections have it (order_section takes them from it).

    The labels in the text are found in one pass, which marks them; fields of one line are read from what stands behind
    their first mark. No label ends where another does, so the pass finds each. What is empty or cut there, and texts that are
    not plain (ASCII, no blanks but line feeds and spaces), go by the field's own pattern.
    """
    return T.let(text, lambda t: _order_values(t, sections))


def _marks(labels: tuple[str, ...]) -> str:
    """A pattern that takes each label with its colon in a plain text, whatever the case; labels by their first letters, as most characters begin none."""
    by_first: dict[str, list[str]] = {}
    for x in labels:
        by_first.setdefault(x[0], []).append(x[1:])
    return rf"(?i)(?=[{''.join(by_first)}])({'|'.join(f'{c}(?:{chr(124).join(ends)})' for c, ends in by_first.items())}){_BEHIND}"


def _order_values(text: Column, sections: tuple[str, ...]) -> Column:
    table = {_value_name(p, part): (p, part, multi) for s in sections for _, p, part, multi in rules.SECTIONS[s]}
    labels = {n: p.split(_BEHIND)[0] for n, (p, part, _) in table.items() if part == "all" and _BEHIND in p}
    plain = T.is_plain(text, "\x01\x02")
    pieces = F.split(F.regexp_replace(text, _marks(tuple(labels.values())), "\x01$1\x02"), "\x01", -1)
    known = {"plain": plain, "pieces": F.when(plain, pieces)}
    if any(part == "report" for _, part, _ in table.values()):
        known["report"] = T.split_report(text)[1]

    def read(k: Column) -> Column:
        last = F.size(k["pieces"]) - 1
        # a line that the next label cuts is left to the pattern: that label may end on another line
        line = lambda x, i: T.let(F.substring_index(x, "\x02", -1), lambda b: F.when((i == last) | F.contains(b, F.lit("\n")), F.trim(F.substring_index(b, "\n", 1))).otherwise(F.lit("")))
        keys = F.array_join(F.transform(k["pieces"], lambda x, i: F.when(i > 0, F.substring_index(x, "\x02", 1)).otherwise(F.lit(""))), ",")
        own = {"plain": k["plain"], "keys": F.regexp_replace(F.lower(keys), "[^a-z,]+", ""), "lines": F.transform(k["pieces"], line)}
        return F.struct(*[c.alias(n) for n, c in own.items()], *([k["report"].alias("report")] if "report" in known else []))

    def value(k: Column, name: str) -> Column:
        pattern, part, multi = table[name]
        if part != "all" or name not in labels:
            return T.search_field(text if part == "all" else k[part], pattern, multi)
        whole, at = T.search_field(text, pattern, multi), F.find_in_set(F.lit(_label_key(pattern)), k["keys"])
        if multi:
            return F.when(~k["plain"] | (at > 0), whole)
        digits = pattern.endswith(rules.CAPTURES["digits"])
        line = F.get(k["lines"], at - 1)
        # a first label without digits need not be the one that the pattern takes
        return T.let(F.regexp_extract(line, r"\A[0-9]+", 0) if digits else line, lambda v: F.when(~k["plain"] | (v == ""), whole).when(~F.contains(v, F.lit(":")), v))

    made = lambda k: F.struct(*[value(k, n).alias(n) for n in table])
    return T.let(F.struct(*[c.alias(n) for n, c in known.items()]), lambda k: T.let(read(k), made))


def order_section(values: Column, name: str) -> Column:
    """A section's struct from order_values."""
    return F.struct(*[values[_value_name(p, part)].alias(n) for n, p, part, _ in rules.SECTIONS[name]])


def work_order(text: Column, sections: tuple[str, ...] = (*rules.SECTIONS, "pelaksanaan")) -> Column:
    """order_parts as one struct. Only those named are computed."""
    return F.struct(*[c.alias(n) for n, c in order_parts(text, sections).items()])


def _words(heading: str) -> str:
    return r"\s*".join(map(re.escape, heading.split()))


#: The survey's sections by name: heading, headings that end it, fold, labels (None: hand holes).
SURVEY_PARTS = {n: own for n, *own in rules.SURVEY} | {n: (start, ends, "groups", None) for n, start, ends in rules.HH_SECTIONS}


def survey(text: Column) -> Column:
    """survey_parts as one struct."""
    return T.let(T.folded(text), lambda k: F.struct(*[survey_part(text, n, k).alias(n) for n in SURVEY_PARTS]))


def survey_parts(text: Column) -> dict[str, Column]:
    """The survey's sections: a map of labels and values for each, arrays for hand holes."""
    return {n: T.let(T.folded(text), lambda k, n=n: survey_part(text, n, k)) for n in SURVEY_PARTS}


def survey_part(text: Column, name: str, known: Column) -> Column:
    """A section of the survey, from the text and its fold.

    A section that has a heading but is missing is read from the whole text where the fold needs no
    section, else it is empty.
    """
    start, ends, fold, labels = SURVEY_PARTS[name]
    folds = {
        "next": lambda t: label_next_line(t, labels), "last": lambda t: label_next_line(T.clean_space(t), labels), "first": lambda t: label_next_line(T.clean_space(t), labels, keep="first"),
        "inline": lambda t: label_inline(F.regexp_replace(t, r"(?i)\(PLN ([PN])-\s*\n\s*([NG])\)", r"(PLN $1-$2)"), labels), "prefix": lambda t: label_prefix(t, labels), "groups": hh_groups,
    }

    def section(known: Column) -> Column:
        if not start:
            return text
        if fold == "groups":
            own = T.section(text, _words(start), "|".join(map(_words, ends)))
        else:
            own = T.found(text, rf"(?iU){_words(start)}([\s\S]*?)(?={'|'.join([*map(_words, ends), chr(92) + 'z'])})")
        return F.coalesce(F.when(T.may_hold(known, tuple(start.split())), own), text if fold in ("inline", "last") else F.lit(""))

    # read from the whole text, one without any label's words gives what an empty one does
    whole = not start or fold in ("inline", "last")
    return folds[fold](F.when(~_any_label(known, labels), F.lit("")).otherwise(section(known)) if whole else section(known))


def _any_label(fold: Column, labels: tuple[str, ...]) -> Column:
    """Whether all words of one of the labels are in a text, wherever they stand."""
    return reduce(lambda a, b: a | b, [T.may_hold(fold, tuple(re.findall("[A-Za-z]{2,}", label))) for label in labels])


def stamps(text: Column) -> Column:
    all_ = F.regexp_extract_all(text, F.lit(T.STAMP), F.lit(0))
    return T.let(all_, lambda m: F.struct(*[F.coalesce(F.get(m, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(("permintaan_pelanggan", "datang", "selesai"))]))


def list_items(text: Column) -> Column:
    """array<struct<kode, deskripsi>> of '- CODE , text' lines of the list block; null without any."""
    block = T.section(text, r"List\s+Item\s*:", r"\n\s*\n")
    lines = F.regexp_extract_all(block, F.lit(r"-\s*([A-Z0-9-]+\s*,\s*[^\n]+)"), F.lit(1))
    items = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ",", 1)).alias("kode"), F.trim(F.regexp_replace(x, r"\A[^,]*,", "")).alias("deskripsi")))
    return F.when(F.size(items) > 0, items)


def vendor(text: Column) -> Column:
    """vendor_parts as one struct."""
    def known(lines: Column) -> Column:
        own = {"name": _vendor_name(lines), "held": F.filter(lines, lambda x: x != ""), "spot": _spot(text), "names_pic": _names_pic(text)}
        return F.struct(*[c.alias(n) for n, c in own.items()])

    parts = lambda k: F.struct(*[c.alias(n) for n, c in _vendor_parts(text, k["held"], k["name"], k["spot"], k["names_pic"]).items()])
    return T.let(T.lines_of(text, keep_blank=True), lambda lines: T.let(known(lines), parts))


# Kinds of work that a line of executors may name, headings that end a vendor's name.
WORK_KINDS = ("survey", "instalasi", "aktivasi", "dismantle")
AFTER_VENDOR = ("INFORMASI", "HASIL", "PEKERJAAN", "Kontak")
_CONTACT, _PIC = "kontak pic pelanggan", "pic pelanggan"


def _rest(line: Column, words: int) -> Column:
    """A line behind its first words and what separates them from a value."""
    return T.strip(F.regexp_replace(line, rf"(?U)\A(?:\S+\s+){{{words - 1}}}[^\s:]+\s*[:\-–]?", ""))


def _first_at(lines: Column, test) -> Column:
    """The position (from 1) of the first line that passes, 0 without one."""
    return F.coalesce(F.array_position(F.transform(lines, lambda x: F.coalesce(test(x), F.lit(False))), True), F.lit(0)).cast("int")


def _begins(start: str):
    # most lines go by their first word, before any pattern
    return lambda x: F.startswith(F.lower(x), F.lit(start.split()[0])) & F.startswith(F.regexp_replace(F.lower(x), r"(?U)\s+", " "), F.lit(start))


def _names_pic(text: Column) -> Column:
    """Whether the labels of the customer's person and contact can be in a text: one pattern, before its lines are looked at."""
    return F.rlike(text, F.lit(r"(?iU)pic\s+pelanggan"))


def _customer_pic(lines: Column) -> Column:
    """What stands between the lines of the person's and the contact's label, else what follows the label in its line."""
    def between(at: Column, until: Column) -> Column:
        below = F.when((at > 0) & (until > at + 1), F.array_join(F.slice(lines, at + 1, F.greatest(until - at - 1, F.lit(0))), "\n"))
        own = F.when(at > 0, _rest(F.get(lines, at - 1), 2))
        return F.coalesce(below, T.let(own, lambda o: F.when(o != "", o)))

    places = F.struct(_first_at(lines, _begins(_PIC)).alias("at"), _first_at(lines, _begins(_CONTACT)).alias("until"))
    return T.let(places, lambda p: between(p["at"], p["until"]))


def _customer_contact(lines: Column) -> Column:
    """The number behind the contact's label, else at the start of the next line."""
    def behind(at: Column) -> Column:
        own = F.when(at > 0, _rest(F.get(lines, at - 1), 3))
        number = T.strip(F.regexp_extract(T.let(own, lambda o: F.when(o == "", F.get(lines, at)).otherwise(o)), r"\A[-0-9+() ]+", 0))
        return T.let(number, lambda n: F.when(n != "", n))

    return T.let(_first_at(lines, _begins(_CONTACT)), behind)


def _vendor_name(lines: Column) -> Column:
    """'Vendor : NAME' in a line; else, without a colon, capitals and digits behind 'Vendor' and in the lines
    below it, up to a blank line, a heading or the end. lines: with blank ones."""
    # most lines go by their first letters, before any pattern
    begins = lambda x: F.startswith(x, F.lit("V")) | F.startswith(x, F.lit("v"))
    colon = F.get(F.filter(lines, lambda x: begins(x) & F.rlike(x, F.lit(r"(?i)\AVendor\s*:\s*\S"))), F.lit(0))

    def named(at: Column) -> Column:
        rest = F.slice(lines, at, F.size(lines))
        ends = F.array_position(F.transform(rest, lambda x, i: (i > 0) & ((x == "") | F.rlike(x, F.lit(r"\A(?:" + "|".join(AFTER_VENDOR) + ")")))), True).cast("int")
        first = F.when(F.rlike(F.get(rest, F.lit(0)), F.lit(r"\AVendor\z")) & (F.get(rest, F.lit(1)) == ""), F.array_position(F.transform(rest, lambda x, i: (i > 0) & (x != "")), True).cast("int")).otherwise(F.lit(1))
        # a blank line right below the label is passed over: the name is the next run of lines
        tail = F.slice(rest, first + 1, F.size(rest))
        stop = F.array_position(F.transform(tail, lambda x: (x == "") | F.rlike(x, F.lit(r"\A(?:" + "|".join(AFTER_VENDOR) + ")"))), True).cast("int")
        block = F.when(first > 1, F.concat(F.slice(rest, first, F.lit(1)), F.slice(tail, F.lit(1), F.when(stop > 0, stop - 1).otherwise(F.size(tail))))).otherwise(F.slice(rest, F.lit(1), F.when(ends > 0, ends - 1).otherwise(F.size(rest))))
        name = T.strip(F.regexp_replace(F.regexp_replace(F.array_join(block, " "), r"\AVendor\b", ""), r"(?U)\s+", " "))
        return F.when(F.rlike(name, F.lit(r"\A[A-Z][A-Z0-9 ]*\z")), name)

    starts = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda i: F.startswith(F.get(lines, i - 1), F.lit("Vendor")) & F.rlike(F.get(lines, i - 1), F.lit(r"\AVendor(?:\s+[A-Z]|\z)")))
    below = F.get(F.filter(F.transform(starts, named), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(T.let(colon, lambda c: F.when(c.isNotNull(), _rest(c, 1))), below)


def _technician(text: Column, name: Column) -> Column:
    """What stands between 'Pelaksana', with the kind of work and 'dari Tim Vendor', and the next 'Vendor', without the vendor's name."""
    behind = F.get(F.split(text, r"(?i)\bPelaksana\b", 2), F.lit(1))
    behind = F.regexp_replace(behind, r"(?iU)\A\s*(?:" + "|".join(WORK_KINDS) + r")?\s*(?:dari\s+Tim\s+Vendor)?\s*:?\s*", "")
    parts = F.split(behind, r"(?iU)\s+Vendor\b|\AVendor\b", 2)
    own = T.let(parts, lambda ps: F.when(F.size(ps) == 2, F.regexp_replace(F.get(ps, F.lit(0)), r"(?U)\s+", " ")))
    bare = lambda o: F.regexp_replace(o, F.concat(F.lit("(?iU)(?<!\\w)\\Q"), F.coalesce(name, F.lit("\0")), F.lit("\\E(?!\\w)")), F.lit(""))
    # a pattern of the name is made for each text, so only where the name can be
    held = lambda o: ~T.is_ascii(o) | ~T.is_ascii(name) | F.contains(name, F.lit("\\E")) | F.contains(F.lower(o), F.lower(name))
    return T.strip(T.let(own, lambda o: F.when(name.isNull() | held(o), bare(o)).otherwise(o)))


def vendor_parts(text: Column) -> dict[str, Column]:
    """Coordinates (whole numbers too), the customer's person and contact, vendor name and technician (minus the vendor's name).

    Labels and values may share a line or stand on lines of their own.
    """
    return _vendor_parts(text, T.lines_of(text), T.let(T.lines_of(text, keep_blank=True), _vendor_name), _spot(text), _names_pic(text))


_NUMBER = r"(-?\d+(?:\.\d*)?)"
SPOT = rf"(?iU)Koordinat\s*{_NUMBER}\s*,\s*{_NUMBER}"


def _spot(text: Column) -> Column:
    """The label and the numbers of the first coordinates, '' without any: a text is searched once for both."""
    return F.regexp_extract(text, SPOT, 0)


def _vendor_parts(text: Column, lines: Column, name: Column, spot: Column, names_pic: Column) -> dict[str, Column]:
    """vendor_parts from a text, its lines that are not blank, its vendor's name, its coordinates and whether it may name the person."""
    number = lambda i: F.when(spot != "", F.regexp_extract(spot, SPOT, i))
    return {
        "latitude": number(1),
        "longitude": number(2),
        "pic_pelanggan": F.when(names_pic, T.let(lines, _customer_pic)),
        "kontak_pic_pelanggan": F.when(names_pic, T.let(lines, _customer_contact)),
        "teknisi": T.let(name, lambda n: _technician(text, n)),
        "nama_vendor": name,
    }


def _is_label(line: Column, labels: tuple[str, ...]) -> Column:
    return _is_low_label(F.lower(line), labels)


def _is_low_label(low: Column, labels: tuple[str, ...]) -> Column:
    return low.isin(*[x.lower() for x in labels])


def _pairs(text: Column, clean: bool = False) -> Column:
    """array<struct<own, low, next>> of a text's lines; low: in lower case."""
    lines = T.lines_of(T.clean_space(text) if clean else text)
    return T.let(lines, lambda ls: F.transform(ls, lambda x, i: F.struct(x.alias("own"), F.lower(x).alias("low"), F.get(ls, i + 1).alias("next"))))


def _label_lines(text: Column, labels: tuple[str, ...]) -> Column:
    """_pairs of the lines that begin with a label, so that each label is looked for in few lines."""
    begins = r"\A(?:" + "|".join(rf"\Q{label.lower()}\E" for label in labels) + ")"
    return F.filter(_pairs(text), lambda x: F.rlike(x["low"], F.lit(begins)))


def label_next_line(text: Column, labels: tuple[str, ...], keep: str = "last") -> Column:
    """map key -> next line, for labels that fill a line; e-mail fields must hold an address.

    A label before another label has a null value; of repeated labels the last (or first) counts.
    """
    def entry(x: Column) -> Column:
        key = T.key_of(x["own"])
        value = F.when(~_is_label(x["next"], labels), x["next"])
        mail = F.when(F.rlike(value, F.lit(EMAIL)), F.regexp_extract(value, EMAIL, 0))
        return F.struct(key.alias("key"), F.when(F.contains(key, F.lit("email")), mail).otherwise(value).alias("value"))

    def pick(rank: Column) -> Column:
        later = (lambda o, r: o["i"] > r["i"]) if keep == "last" else (lambda o, r: o["i"] < r["i"])
        good = F.filter(rank, lambda r: ~F.exists(rank, lambda o: (o["e"]["key"] == r["e"]["key"]) & later(o, r)))
        return F.map_from_entries(F.transform(good, lambda r: r["e"]))

    hits = F.filter(_pairs(text), lambda x: _is_low_label(x["low"], labels))
    return T.let(F.transform(hits, lambda x, i: F.struct(entry(x).alias("e"), i.alias("i"))), pick)


def label_inline(text: Column, labels: tuple[str, ...]) -> Column:
    """map of all labels -> 'label : value' of the first such line, else the line after the label."""
    def one(own: Column, label: str) -> Column:
        pattern = rf"(?i)\A\Q{label}\E\s*[:\-–=]\s*(.+)\z"

        def entry(hit: Column) -> Column:
            value = F.when(F.rlike(hit["own"], F.lit(pattern)), F.trim(F.regexp_extract(hit["own"], pattern, 1))).when(~_is_label(hit["next"], labels), hit["next"])
            return F.struct(F.lit(_key(label)).alias("key"), value.alias("value"))

        return T.let(F.get(F.filter(own, _line_test(label, pattern)), F.lit(0)), entry)

    none = F.map_from_entries(F.array(*[F.struct(F.lit(_key(label)).alias("key"), F.lit(None).cast("string").alias("value")) for label in labels]))
    return T.let(_label_lines(text, labels), lambda own: F.when(F.size(own) > 0, F.map_from_entries(F.array(*[one(own, label) for label in labels]))).otherwise(none))


def _line_test(label: str, pattern: str):
    # most lines go by their first letters, before any pattern
    return lambda x: F.startswith(x["low"], F.lit(label.lower())) & (F.rlike(x["own"], F.lit(pattern)) | (x["low"] == label.lower()))


def _key(label: str) -> str:
    key = label.lower().translate({ord(c): "_" for c in " /-"} | {ord(c): None for c in ".()"})
    return key.replace("bersedia_dipasang_perangkat", "fo").replace("penanggungjawab_pengurusan_dan_pembayaran_sewa", "penanggungjawab_sewa")


def label_prefix(text: Column, labels: tuple[str, ...]) -> Column:
    """map: lines that begin with a label (first in list order); the rest of the line, else the next line."""
    def one(own: Column, label: str) -> Column:
        def entry(hit: Column) -> Column:
            rest = T.strip(F.regexp_replace(F.substring(hit["own"], F.lit(len(label) + 1), F.length(hit["own"])), r"\A\s*[:\-–=]", ""))
            value = F.when(rest != "", rest).when(~_is_label(hit["next"], labels), hit["next"])
            return F.struct(F.lit(_key(label)).alias("key"), value.alias("value"))

        return T.let(F.get(F.filter(own, _prefix_test(label)), F.lit(0)), entry)

    return T.let(_label_lines(text, labels), lambda own: F.map_from_entries(F.when(F.size(own) > 0, F.filter(F.array(*[one(own, label) for label in labels]), lambda e: e["value"].isNotNull())).otherwise(F.array().cast("array<struct<key:string,value:string>>"))))


def _prefix_test(label: str):
    return lambda x: F.startswith(x["low"], F.lit(label.lower()))


HH_LABEL = r"(?i)\A(?:" + "|".join(rules.HH_LABELS) + r")-\d+\z"
HH_HEAD = r"(?i)\AData\s*HH\s*(\d+)"


def hh_groups(text: Column) -> Column:
    """array<struct<hh, key, value>>: 'Data HH n' opens a group, labels inside take the next line."""
    zero = F.struct(F.lit(None).cast("string").alias("hh"), F.array().cast("array<struct<hh:string,key:string,value:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        head = F.rlike(x["own"], F.lit(HH_HEAD))
        label = F.rlike(x["own"], F.lit(HH_LABEL)) & acc["hh"].isNotNull()
        value = F.when(~F.rlike(x["next"], F.lit(HH_LABEL)) & ~F.rlike(x["next"], F.lit(HH_HEAD)), x["next"])
        row = F.struct(acc["hh"].alias("hh"), T.key_of(x["own"]).alias("key"), value.alias("value"))
        return F.struct(F.when(head, F.concat(F.lit("hh_"), F.regexp_extract(x["own"], HH_HEAD, 1))).otherwise(acc["hh"]).alias("hh"), F.when(label, F.concat(acc["out"], F.array(row))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(_pairs(text, clean=True), zero, step, lambda a: a["out"])


def voltage_table(text: Column) -> Column:
    """struct of pln, ups and it: their three 'n VAC' readings in order; all empty below three."""
    all_ = F.regexp_extract_all(text, F.lit(r"(?i)(\d+(?:[.,]\d+)?\s*VAC)"), F.lit(1))

    def reading(i: int) -> Column:
        return F.when(F.size(all_) < 3, F.lit("")).otherwise(F.coalesce(F.get(all_, F.lit(i)), F.lit("VAC")))

    return F.struct(*[F.struct(*[reading(3 * r + c).alias(n) for c, n in enumerate(("p_n", "p_g", "n_g"))]).alias(s) for r, s in enumerate(("pln", "ups", "it"))])


WIRELESS_REG, WIRELINE_REG = r"B2WN[A-Z0-9]{10,}", r"B2W[A-Z][A-Z0-9]{10,}"


def devices(text: Column, pattern: str = WIRELESS_REG) -> Column:
    """array<struct<nama_barang, no_reg>>: the name is the text between this and the previous number."""
    regs = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    names = F.slice(F.split(text, pattern, -1), 1, F.size(regs))
    return F.zip_with(names, regs, lambda n, r: F.struct(T.drop_repeated_words(n).alias("nama_barang"), r.alias("no_reg")))


def quality_pair(text: Column, label: str, tail: int = 20) -> Column:
    """struct<standard, existing> after a parameter's label; else what the next characters hold."""
    pattern = rf"(?iU){label}\s*[:\-]?\s*(\S+(?:\s?(?:dBm|dB|Ohm|MHz|ms))?)\s+(\S+(?:\s?(?:dBm|dB|Ohm|MHz|ms))?)"
    near = T.found(text, rf"(?isU){label}(.{{0,{tail}}})")
    return F.struct(F.coalesce(T.found(text, pattern, 1), F.when(T.strip(near) != "", T.strip(near))).alias("standard"), T.found(text, pattern, 2).alias("existing"))


def _values(options: tuple[str, ...]) -> str:
    """A group of the values that a parameter may have; '#' is a number, blanks and commas may vary."""
    return "(" + "|".join(re.escape(o).replace(r"\#", r"\d+(?:[.,]\d+)?").replace(",", ",?").replace(r"\ ", r"\s*") for o in options) + ")"


def quality_table(text: Column, table: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...]) -> Column:
    """array<struct<parameter, standard, existing>>, an entry for every parameter, '' where a value is missing.

    The standard is the first of its values within 60 characters of the label, the existing value the
    first of its own right behind it.
    """
    made = []
    for label, standards, existing in table:
        words = r"\s+".join(re.escape(w) for w in label.split())
        first = rf"(?isU){words}[^\n]{{0,60}}?(?<!\w){_values(standards)}"
        both = rf"{first}\s+{_values(existing)}"
        made.append(F.struct(F.lit(label).alias("parameter"), F.coalesce(T.found(text, both, 1), T.found(text, first, 1), F.lit("")).alias("standard"), F.coalesce(T.found(text, both, 2), F.lit("")).alias("existing")))
    return F.array(*made)


def section_by_keywords(text: Column, patterns: tuple[str, ...], keywords: tuple[str, ...], least: int = 2) -> Column:
    """The first pattern whose section holds enough of the keywords."""
    from fieldquarry.operators.classify import count_in

    made = [T.found(text, f"(?isU){p}") for p in patterns]
    return F.coalesce(*[F.when(count_in(F.lower(m), keywords) >= least, m) for m in made])


def cut_at_labels(text: Column, label: str, labels: tuple[str, ...]) -> Column:
    """The value after 'label :' up to the first known label or the line's end."""
    stop = "|".join(x.replace(".", r"\.") for x in labels)
    return T.strip(T.found(text, rf"(?i){label}\s*:\s*(.*?)(?=\s*(?:{stop})\s*:|\n|\z)"))
