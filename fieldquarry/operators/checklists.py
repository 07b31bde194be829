"""Site checklists: remote data, clocks, location, electricity, quality rows, line items, device columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldquarry.functions import text as T
from fieldquarry.operators import rules
from fieldquarry.operators.fields import WIRELESS_REG, cut_at_labels, section_by_keywords

# Labels of the remote-data block, clock fields in order, line items, quality parameters.
REMOTE = (
    ("nama_pelanggan", r"Nama\s*Pelanggan"), ("contact_person", r"Contact\s*Person"), ("nomor_jaringan", r"Nomor\s*Jaringan"), ("nomor_telepon", r"Nomor\s*Telepon"),
    ("alamat", "Alamat"), ("kota", "Kota"), ("propinsi", "Prop(?:i|o)nsi"), ("no_spk", r"No\.?\s*SPK"),
)
STOPS = (*(p for _, p in REMOTE), "Tanggal", r"Jam\s*Perintah")
CLOCKS = ("jam_perintah", "jam_persiapan", "jam_berangkat", "jam_tiba_di_lokasi", "jam_mulai_kerja", "jam_selesai_kerja")
LATE_CLOCKS = (("jam_pulang", r"Jam\s*Pulang"), ("jam_tiba_di_kantor", r"Jam\s*Tiba\s*(?:Di\s*)?Kantor"))
LINE_GROUPS = {
    "site_area": (r"Site\s+Area", "HRB|Tes\\s+Konektivitas", ("Kabel RJ-11", "Phone Box", "KTB/DP Wall", "DP Telkom", "Sub Gedung", "MDF Gedung", "T-Line Gedung")),
    "hrb_r_lintas": ("HRB", "Line\\s+FO|Tes\\s+Konektivitas", ("T-Line (TX,LC)", "Kabel Data", "Port Sentral")),
    "line_fo": (r"Line\s+FO", "Tes\\s+Konektivitas", ("Cek Signal FO", "Koneksi OTB")),
    "tes_konektivitas": (r"Tes\s+Konektivitas", r"\z", ("Test Ping", "Traffic")),
}
STAMP = r"\d{2}-[A-Za-z]{3}-\d{4}"


def is_wireless(text: Column) -> Column:
    return F.contains(F.upper(text), F.lit("WIRELESS"))


def is_wireline(text: Column) -> Column:
    return F.contains(F.upper(text), F.lit("WIRELINE"))


def remote_data(text: Column) -> Column:
    """struct of the remote-data fields; a province that names a work order is none."""
    return T.let(T.clean_checklist(text), _remote)


def _remote(text: Column) -> Column:
    made = [(n, F.coalesce(cut_at_labels(text, p, STOPS), F.lit(""))) for n, p in REMOTE]
    made = [(n, T.let(v, lambda x: F.when(F.contains(F.lower(x), F.lit("spk")), "").otherwise(x)) if n == "propinsi" else v) for n, v in made]
    date = F.coalesce(T.found(text, rf"(?i)Tanggal\s*:?\s*({STAMP}(?:\s+\d{{2}}:\d{{2}})?)"), F.lit(""))
    return F.struct(*[v.alias(n) for n, v in made], date.alias("tanggal"))


def clocks(text: Column) -> Column:
    """struct of eight clock fields: six by position in the block, two by their labels."""
    def of(t: Column) -> Column:
        block = F.coalesce(T.found(t["text"], r"(?is)(Jam\s*Perintah.*?)(?=GLOBAL|Latitude|DATA\s*LOKASI|\z)"), F.lit(""))
        return T.let(block, lambda b: T.let(F.struct(F.regexp_extract_all(b, F.lit(f"({STAMP})"), F.lit(1)).alias("dates"), F.regexp_extract_all(b, F.lit(r"(\d{2}:\d{2})"), F.lit(1)).alias("times")), lambda m: _clocks(t["text"], b, m["dates"], m["times"])))

    return T.let(F.struct(T.clean_checklist(text).alias("text")), of)


def _clocks(text: Column, block: Column, dates: Column, times: Column) -> Column:
    nth = lambda i: F.coalesce(F.when(F.get(times, F.lit(i)).isNotNull(), F.concat(F.get(dates, F.lit(i)), F.lit(" "), F.get(times, F.lit(i)))), F.get(dates, F.lit(i)), F.lit(""))
    late = [F.when(F.length(block) > 0, F.coalesce(T.found(text, rf"(?i){p}\s*:?\s*({STAMP}(?:\s+\d{{2}}:\d{{2}})?)"), F.lit(""))).otherwise("").alias(n) for n, p in LATE_CLOCKS]
    return F.struct(*[nth(i).alias(n) for i, n in enumerate(CLOCKS)], *late)


def location(text: Column) -> Column:
    return T.let(T.clean_checklist(text), _location)


def _location(text: Column) -> Column:
    lat, lon = T.found(text, r"(?i)Latitude\s*:?\s*([\d°'\".-]+)"), T.found(text, r"(?i)Longitude\s*:?\s*([\d°'\".-]+)")
    keep = lambda v: T.let(v, lambda x: F.coalesce(F.when(x != ".", x), F.lit("")))
    floor = T.strip(T.found(text, r"(?i)Posisi\s*Modem\s*di\s*Lt\.\s*:?\s*([A-Za-z0-9 ]+?)(?=\s+Ruang|\n|\z)"))
    room = T.strip(T.found(text, r"(?i)\bRuang\s*:?\s*([A-Za-z ]+?)(?=\s+P-G|\s+\d|\n|\z)"))
    return F.struct(keep(lat).alias("latitude"), keep(lon).alias("longitude"), F.coalesce(floor, F.lit("")).alias("posisi_modem_di_lt"), F.coalesce(room, F.lit("")).alias("ruang"))


def voltage_row(text: Column, label: str) -> Column:
    """struct<pln, ups, it> of a labelled row: three readings, over lines too, else as many as the line holds; '.' is none."""
    three = T.found(text, rf"(?i)({label}(?:\s+[\d.]+\s*VAC){{3}})")
    line = F.coalesce(three, T.found(text, rf"(?i){label}\s+(.+?)(?=\n|P-[NG]|N-G|Grounding|\z)"))
    numbers = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit(r"(?i)([\d.]+)\s*VAC"), F.lit(1))
    one = lambda got, i: F.coalesce(F.when(F.get(got, F.lit(i)) != ".", F.concat(F.get(got, F.lit(i)), F.lit(" VAC"))), F.lit(""))
    return T.let(numbers, lambda got: F.struct(*[one(got, i).alias(n) for i, n in enumerate(("pln", "ups", "it"))]))


def electrical(text: Column) -> Column:
    table = F.coalesce(T.found(text, r"(?is)(Output\s*Tegangan.*?)(?=Grounding\s*Bar|ENVIRONMENT|INDOOR|OUTDOOR|\z)"), F.lit(""))
    bar = T.strip(T.found(text, r"(?i)Grounding\s*Bar\s*terkoneksi\s*ke\s*:?\s*([A-Za-z ]+?)(?=\s*N?DOOR|\n|\z)"))
    bar = T.let(bar, lambda b: F.when(~F.rlike(b, F.lit("(?i)INDOOR|OUTDOOR|AREA")), b))
    return T.let(table, lambda t: F.struct(*[voltage_row(t, r).alias(n) for n, r in (("p_n", "P-N"), ("p_g", "P-G"), ("n_g", "N-G"))], F.coalesce(bar, F.lit("")).alias("grounding_bar")))


def environment(text: Column) -> Column:
    heat = T.found(text, r"(?i)Suhu\s*Ruangan\s*Perangkat\s*:?\s*([\d.]+)")
    return F.struct(F.coalesce(T.found(text, r"(?i)AC\s*Pendingin\s*Ruangan\s*:?\s*([A-Za-z]+)"), F.lit("")).alias("ac"), F.coalesce(F.concat(heat, F.lit("°")), F.lit("")).alias("suhu"))


def scalar_field(text: Column, label: str, stop_words: tuple[str, ...] = (), unit: str = "") -> Column:
    """The word after a label, unless it is a stop word; with a unit, else the first 'n unit'."""
    value = T.found(text, rf"(?i){label}\s*[:\-]?\s*(\S+)")
    value = F.when(~F.lower(value).isin(*[w.lower() for w in stop_words], ""), value)
    if unit:
        exact = T.found(text, rf"(?i){label}\s*[:\-]?\s*(\d+(?:[.,]\d+)?\s*(?:{unit}))\b")
        return F.coalesce(exact, T.found(text, rf"(?i)\b(\d+(?:[.,]\d+)?\s*(?:{unit}))\b"))
    return value


#: Labels beside the UPS brand, and words that are never a brand.
UPS_LABELS = ("Menggunakan UPS", "Kapasitas UPS", "Jenis UPS", "QUALITY")
NO_BRAND = ("menggunakan", "kapasitas", "quality", "parameter", "standard", "existing", "jenis", "ruangan")


def ups(text: Column) -> Column:
    """struct<merk, kapasitas> of the UPS: a brand of 3 to 30 characters before the next label, a number with its unit; '' where missing."""
    line = T.found(text, r"(?i)Merk\s+UPS\s*:\s*([^\n]*)")
    brand = line
    for n in UPS_LABELS:
        brand = F.get(F.split(brand, rf"(?i){n.split()[0]}", 2), F.lit(0))
    brand = T.strip(brand)
    fits = F.length(brand).between(3, 30) & F.rlike(brand, F.lit(r"\A[A-Za-z0-9 ,.-]*\w[A-Za-z0-9 ,.-]*\z")) & ~F.exists(F.array(*map(F.lit, NO_BRAND)), lambda w: F.contains(F.lower(brand), w))
    size = T.found(text, r"(?i)Kapasitas\s+UPS\s*:?\s*(\d+(?:\.\d+)?\s*K?(?:VA|W))(?!\w)")
    return F.struct(F.when(fits, brand).otherwise("").alias("merk"), F.coalesce(size, F.lit("")).alias("kapasitas"))


NOISE = r"(?i)\A(?:[\W_]*|standard|existing|no\.?|page \d+)\z"


def quality_row(text: Column, label: str, labels: tuple[str, ...] = (), ahead: int = 5, reach: int = 400) -> Column:
    """The first meaningful of the next lines after a label, within reach; none beyond another label."""
    tail = T.found(text, rf"(?is)\Q{label}\E(.{{0,{reach}}})")
    lines = F.slice(T.lines_of(F.coalesce(tail, F.lit(""))), 1, ahead)
    good = F.get(F.filter(lines, lambda x: ~F.rlike(x, F.lit(NOISE))), F.lit(0))
    return F.when(~F.lower(good).isin(*[x.lower() for x in labels]), good) if labels else good


#: The indoor checklist's heading as it is read (a letter lost, blanks lost), the strict one first.
INDOOR_STARTS = (r"I?ND[O0]{2}R\s*AREA\s*CHECKLIST", r"I?ND[O0]{2}R.*?CHECKLIST")
ROW = ("standard", "nms_engineer", "on_site_teknisi", "perbaikan", "hasil_akhir")


def _label(label: str) -> str:
    """A pattern for a printed label: blanks vary, slashes and hyphens may be lost."""
    return r"\s+".join(re.sub("[/-]", "[/-]?", w) for w in label.split())


def indoor(text: Column) -> Column:
    """array<struct<bagian, parameter, standard, nms_engineer, on_site_teknisi, perbaikan, hasil_akhir>> of the text layer.

    An entry for every row, '' for what is not found; an empty array without the section. The section
    is cut at the rows' labels, so a row holds what stands up to the next label and nothing else.
    """
    section = section_by_keywords(T.clean_checklist(text), tuple(rf"({p}.*?)(?=OUTDOOR|LINE\s*CHECKLIST|KESIMPULAN|\z)" for p in INDOOR_STARTS), rules.INDOOR_KEYWORDS)
    return F.coalesce(T.let(section, lambda s: F.when(s.isNotNull(), _indoor_rows(s))), F.array().cast("array<struct<" + ",".join(f"{n}:string" for n in ("bagian", "parameter", *ROW)) + ">>"))


#: Marks before and behind the number of a label that has been found.
OPEN, SHUT = "\x01", "\x02"


def _cells(text: Column, labels: list[str]) -> Column:
    """array<struct<label, cells, before>>: a text cut at labels (the longest first); lines that print headings are left out.

    cells: what follows the label; before: what precedes it, up to the label before.
    """
    marked = text
    for n in sorted(labels, key=len, reverse=True):
        marked = F.regexp_replace(marked, rf"(?i)(?<![\w/]){_label(n)}(?![\w/])", f"{OPEN}{labels.index(n)}{SHUT}")
    printed = [h.replace(" ", "") for h in rules.INDOOR_HEADINGS]
    heading = lambda x: F.exists(F.array(*map(F.lit, printed)), lambda h: F.startswith(F.regexp_replace(F.upper(x), r"[\s(]+", ""), h))

    def piece(x: Column) -> Column:
        cells = F.array_join(F.filter(T.lines_of(F.substring_index(x, SHUT, -1)), lambda y: ~heading(y)), "\n")
        return F.struct(F.when(F.contains(x, F.lit(SHUT)), F.get(F.array(*map(F.lit, labels)), F.substring_index(x, SHUT, 1).try_cast("int"))).alias("label"), cells.alias("cells"))

    pieces = T.let(F.split(marked, OPEN), lambda parts: F.transform(parts, piece))
    return T.let(pieces, lambda all_: F.transform(all_, lambda x, i: F.struct(x["label"].alias("label"), x["cells"].alias("cells"), F.when(i > 0, F.get(all_, i - 1)["cells"]).alias("before"))))


def _indoor_rows(section: Column) -> Column:
    """Rows of the section: those that are checked by AVO meter behind that heading, all others before it."""
    avo = rf"(?i){_label(rules.AVO_HEADING)}"
    parts = F.split(section, avo, 2)
    near, behind = _cells(F.get(parts, F.lit(0)), [n for p, n in rules.INDOOR if p != "lc_signal_avo"]), _cells(F.coalesce(F.get(parts, F.lit(1)), section), [n for p, n in rules.INDOOR if p == "lc_signal_avo"] + ["Tainet Scorpio"])

    def row(part: str, label: str, cells: Column) -> Column:
        """By position: a printed value as it stands in the form, else the first line; what follows a printed value is the next column's."""
        at = F.get(F.filter(cells, lambda x: x["label"] == label), F.lit(0))
        whole = F.coalesce(F.regexp_replace(at["cells"], r"\s+", " "), F.lit(""))
        plain = F.lower(T.plain_dashes(whole))
        value, rest = F.substring_index(F.coalesce(at["cells"], F.lit("")), "\n", 1), F.lit("")
        fixed = rules.INDOOR_VALUES.get((part, label), ())
        for printed, *_ in reversed(fixed):
            fits = F.startswith(plain, F.lit(printed.lower()))
            value, rest = F.when(fits, F.substr(whole, F.lit(1), F.lit(len(printed)))).otherwise(value), F.when(fits, F.trim(F.substr(whole, F.lit(len(printed) + 1)))).otherwise(rest)
        if (part, label) in rules.INDOOR_STATES:  # the form prints the state before or behind the label
            last = F.upper(F.regexp_extract(at["before"], r"(?i)\b(on|off)\s*\z", 1))
            value = F.when(value != "", value).otherwise(F.coalesce(last, F.lit("")))
        unit, on_site = next(((u, o) for _, u, o in fixed if u or o), ("", ""))
        if fixed and not unit:
            value = T.strip(F.translate(value, "Ω", ""))
        engineer = F.when(F.lit(unit != "") & (value != ""), F.lit(unit)).otherwise("")
        site = F.when(F.lit(on_site != "") & F.startswith(F.lower(rest), F.lit(on_site.lower())), F.lit(on_site)).otherwise("")
        return F.struct(F.lit(part).alias("bagian"), F.lit(label).alias("parameter"), F.regexp_replace(value, r"\s+", " ").alias("standard"), engineer.alias("nms_engineer"), site.alias("on_site_teknisi"), F.lit("").alias("perbaikan"), F.lit("").alias("hasil_akhir"))

    return T.let(F.struct(near.alias("near"), behind.alias("behind")), lambda c: F.array(*[row(p, n, c["behind"] if p == "lc_signal_avo" else c["near"]) for p, n in rules.INDOOR]))


def prefer_bands(rows: DataFrame, bands: DataFrame, label: str, columns: dict[str, str], keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows whose values come from OCR bands (layout.row_band) where these hold a standard, else from the text.

    columns: a row's column to the band's column it takes. Labels meet without case; of several bands
    of one label the least (by its values) counts. Null labels and keys meet none.
    """
    names = [n for n in bands.columns if n not in (*keys, "label")]
    found = bands.where("standard IS NOT NULL").groupBy(*keys, F.lower("label").alias("__label")).agg(F.min(F.struct(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in names])).alias("__band"))
    both = rows.withColumn("__label", F.lower(F.col(label))).join(found, [*keys, "__label"], "left")
    return both.withColumns({c: F.when(F.col("__band").isNotNull(), F.col(f"__band.{b}")).otherwise(F.col(c)) for c, b in columns.items()}).select(*rows.columns)


def line_items(text: Column) -> Column:
    """array<struct<bagian, item, value>> of the line checklist, group by group."""
    made = [T.let(F.coalesce(T.found(text, rf"(?is){start}(.*?)(?={end}|\z)"), F.lit("")), _group_items(group, items)) for group, (start, end, items) in LINE_GROUPS.items()]
    return F.flatten(F.array(*made))


def _group_items(group: str, items: tuple[str, ...]):
    """The items of one group's block; a value that names another item is none."""

    def one(item: str):
        others = "|".join(rf"\Q{x}\E" for x in items if x != item)
        return lambda v: F.struct(F.lit(group).alias("bagian"), F.lit(item).alias("item"), F.when(~F.rlike(v, F.lit(f"(?i){others}")), v).otherwise("").alias("value"))

    def all_of(block: Column) -> Column:
        values = [T.strip(F.regexp_extract(block, rf"(?i)\Q{i}\E\s*:?\s*([^\n]*)", 1)) for i in items]
        return F.array(*[T.let(v, one(i)) for i, v in zip(items, values, strict=True)])

    return all_of


def device_columns(text: Column) -> Column:
    """struct<first, second>: two columns by their 'Nama Barang' headings, else around the word CABUT."""
    parts = F.split(text, r"(?i)Nama\s+Barang", 3)
    around = F.split(text, "(?i)CABUT", 2)
    two = F.size(parts) == 3
    return F.struct(
        T.strip(F.when(two, F.get(parts, F.lit(1))).otherwise(F.get(around, F.lit(0)))).alias("first"),
        T.strip(F.coalesce(F.when(two, F.get(parts, F.lit(2))).otherwise(F.get(around, F.lit(1))), F.lit(""))).alias("second"),
    )


# Words after which a device name goes on, words that usually belong to the name before them,
# headings of device tables (several words of one heading may stand apart).
CONNECTORS = ("AND", "HW", "WITH", "FOR", "OF", "TO", "IN", "ON", "BY", "&", "+", "OR")
TAILS = ("WARRANTY", "HARDWARE", "SOFTWARE", "ADAPTER", "CABLE", "POWER", "SUPPLY", "MODULE", "UNIT", "KIT", "SET", "BLACK", "WHITE", "MINI", "STANDARD", "ORIGINAL")
TABLE_HEADINGS = ("CABUT", "PENGGANTI", "PASANG BARU", "TIDAK TERPAKAI", "EXISTING", "Nama Barang", "No Reg", "No. Reg", "S/N")
#: A product code: letters and a digit, with or without a dash between them.
CODE = r"(?i)[A-Z]-?\d"
#: Signs of a name that is whole: a unit, a code, something added.
WHOLE = r"\d[A-Z]|[A-Z]-\d|\+\s*[A-Z]"
#: Most characters behind the last number that may belong to its name; most words and letters of such a tail.
BEHIND, TAIL_WORDS, TAIL_LETTERS = 50, 2, 15

_WORDS = "array<string>"
_HEADING = "(?i)" + "|".join(r"\s*".join(rf"\Q{w}\E" for w in h.split()) for h in TABLE_HEADINGS)
_HEAD_WORD = "(?i)\\A(?:" + "|".join(rf"\Q{h}\E" for h in TABLE_HEADINGS if " " not in h) + r"|No\.?Reg)"
_NUMBER_WORD = r"(?i)\AB2WN[A-Z0-9]"


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def _is_upper(word: Column) -> Column:
    return (F.upper(word) == word) & (F.lower(word) != word)


def goes_on(word: Column, before: Column) -> Column:
    """Whether a word continues the device name before it (an array of words) rather than starting the next.

    So it does behind a connector; a usual tail does behind at most four words; a word of at most three
    letters behind at most two, unless the name is whole or the word is a code or of mixed case.
    """
    n, name = F.size(before), F.array_join(before, " ")
    short = (F.length(word) <= 3) & (n <= 2) & ~F.rlike(word, F.lit(CODE)) & ~F.rlike(word, F.lit("[a-z][A-Z]|[A-Z][a-z]+[A-Z]")) & ~F.rlike(name, F.lit(WHOLE))
    return (n > 0) & (F.upper(F.element_at(before, -1)).isin(*CONNECTORS) | (F.upper(word).isin(*TAILS) & (n <= 4)) | short)


def join_continuations(names: Column) -> Column:
    """Device names of a text (one a line): leading words that continue the name before move to it.

    A line keeps its last word. Each step changes the name that the next one is judged by: a fold over
    the lines, and over the words of each. Null stays null.
    """

    def split_line(before: Column, words: Column) -> Column:
        """struct<before, own>: the words of a line that move, behind those before it, and those that stay."""
        zero = F.struct(before.alias("before"), F.array().cast(_WORDS).alias("own"))
        numbered = F.transform(words, lambda w, i: F.struct(w.alias("w"), (i < F.size(words) - 1).alias("free")))

        def step(acc: Column, x: Column) -> Column:
            moves = x["free"] & (F.size(acc["own"]) == 0) & goes_on(x["w"], acc["before"])
            one = F.array(x["w"])
            return F.when(moves, F.struct(F.concat(acc["before"], one).alias("before"), acc["own"].alias("own"))).otherwise(F.struct(acc["before"].alias("before"), F.concat(acc["own"], one).alias("own")))

        return F.aggregate(numbered, zero, step)

    def line(acc: Column, words: Column) -> Column:
        moved = lambda m: F.struct(F.concat(acc["done"], F.array(m["before"])).alias("done"), m["own"].alias("last"), F.lit(True).alias("any"))
        first = F.struct(acc["done"].alias("done"), words.alias("last"), F.lit(True).alias("any"))
        return F.when(acc["any"], T.let(split_line(acc["last"], words), moved)).otherwise(first)

    zero = F.struct(F.array().cast(f"array<{_WORDS}>").alias("done"), F.array().cast(_WORDS).alias("last"), F.lit(False).alias("any"))
    made = F.aggregate(F.transform(F.split(names, "\n", -1), _words), zero, line, lambda a: F.concat(a["done"], F.array(a["last"])))
    return F.array_join(F.transform(made, lambda ws: F.array_join(ws, " ")), "\n")


def tail_behind(text: Column) -> Column:
    """Of the text behind a registration number the words that belong to the name before the number, '' if none.

    One-letter words are passed over. The tail ends at a heading or another number; at a first word that is
    a code, or of six and more capitals before a word of five and more, a digit or a heading (a new name); at
    a later word of more than five letters not behind '+' or '&'; and at two words or fifteen letters. Two
    words of six and more capitals are a name of their own, hence none.
    """

    def taken(words: Column) -> Column:
        known = F.transform(words, lambda w, i: F.struct(w.alias("w"), F.coalesce(F.get(words, i + 1), F.lit("")).alias("next"), F.when(i > 0, F.get(words, i - 1)).alias("prev")))

        def step(acc: Column, x: Column) -> Column:
            w, nxt, n = x["w"], x["next"], F.size(acc["own"])
            phrase = (F.length(w) >= 6) & _is_upper(w) & (((F.length(nxt) >= 5) & _is_upper(nxt)) | F.rlike(nxt, F.lit(r"\d")) | F.rlike(nxt, F.lit(_HEAD_WORD)))
            starts = (n == 0) & (phrase | F.rlike(w, F.lit(CODE)))
            fits = (n < TAIL_WORDS) & (F.length(F.array_join(acc["own"], "")) + F.length(w) <= TAIL_LETTERS)
            likely = (F.length(w) <= 5) | F.coalesce(x["prev"].isin("+", "&"), F.lit(False)) | (n == 0)
            ends = F.rlike(w, F.lit(_HEAD_WORD)) | F.rlike(w, F.lit(_NUMBER_WORD)) | ((F.length(w) > 1) & (starts | ~fits | ~likely))
            own = F.when(F.length(w) > 1, F.concat(acc["own"], F.array(w))).otherwise(acc["own"])
            return F.when(acc["open"] & ~ends, F.struct(F.lit(True).alias("open"), own.alias("own"))).otherwise(F.struct(F.lit(False).alias("open"), acc["own"].alias("own")))

        return F.aggregate(known, F.struct(F.lit(True).alias("open"), F.array().cast(_WORDS).alias("own")), step, lambda a: a["own"])

    own_name = lambda ws: (F.size(ws) == TAIL_WORDS) & F.forall(ws, lambda w: (F.length(w) >= 6) & _is_upper(w))
    return T.let(T.let(_words(text), taken), lambda ws: F.when(own_name(ws), "").otherwise(F.array_join(ws, " ")))


def device_items(text: Column, pattern: str = WIRELESS_REG) -> Column:
    """array<struct<nama_barang, no_reg>> of a device table's text: names before their numbers, with what belongs to them behind.

    A name is what stands before its number, without headings, of at most ten words; a tail behind the
    number is added to it (and stays part of the next name, which is judged on its own). Where the first
    of several words continues the name before, it moves there. Names of fewer than three letters are no
    items. Null text: null; no number: no items.
    """
    regs = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))

    def rows(parts: Column) -> Column:
        def one(reg: Column, i: Column) -> Column:
            own = F.get(parts, i)
            # only the text before the first number has a heading of its own: what follows its last one counts
            own = F.when(i == 0, F.element_at(F.split(own, _HEADING, -1), -1)).otherwise(F.regexp_replace(F.regexp_replace(own, r"(?i)PENGGANTI.*?PASANG\s+BARU", ""), _HEADING, ""))
            own = F.regexp_replace(F.array_join(_words(F.regexp_replace(own, r"(?i)C\.?DATA\s*PERANGKAT", "")), " "), r"\A[|,.\-_:;]+|[|,.\-_:;]+\z", "")
            own = T.let(_words(own), lambda ws: F.slice(ws, F.greatest(F.lit(1), F.size(ws) - 9), 10))
            behind = F.get(parts, i + 1)
            behind = F.when(i == F.size(parts) - 2, F.substring(behind, 1, BEHIND)).otherwise(behind)
            return F.struct(F.concat(own, _words(tail_behind(behind))).alias("words"), reg.alias("no_reg"))

        return F.zip_with(F.sequence(F.lit(0), F.size(parts) - 2), F.slice(regs, 1, F.size(parts) - 1), lambda i, reg: one(reg, i))

    kind = "array<struct<words:array<string>,no_reg:string>>"

    def step(acc: Column, x: Column) -> Column:
        def placed(last: Column) -> Column:
            moves = (F.size(acc) > 0) & (F.size(x["words"]) >= 2) & F.coalesce(goes_on(F.get(x["words"], F.lit(0)), last["words"]), F.lit(False))
            before = F.when(moves, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.concat(last["words"], F.slice(x["words"], 1, 1)).alias("words"), last["no_reg"].alias("no_reg"))))).otherwise(acc)
            own = F.when(moves, F.slice(x["words"], 2, F.size(x["words"]))).otherwise(x["words"])
            return F.when(F.length(F.array_join(own, " ")) >= 3, F.concat(before, F.array(F.struct(own.alias("words"), x["no_reg"].alias("no_reg"))))).otherwise(before)

        return T.let(F.get(acc, F.size(acc) - 1), placed)

    none = F.array().cast(kind)
    parts = F.split(text, pattern, -1)
    made = F.aggregate(F.when(F.size(regs) > 0, T.let(parts, rows)).otherwise(none), none, step)
    return F.when(text.isNotNull(), F.transform(made, lambda r: F.struct(F.array_join(r["words"], " ").alias("nama_barang"), r["no_reg"].alias("no_reg"))))
