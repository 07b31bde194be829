"""Documents to records: each type's fields as JSON in an envelope with its status."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldquarry.operators import checklists, classify, fields, forms, rules
from fieldquarry.sources.sinks import to_json

REMOVED = ("pic_pelanggan", "kontak_pic_pelanggan", "teknisi", "nama_vendor")


ORDER_SECTIONS = ("spk", "pelanggan", "jaringan", "berita_acara", "pelaksanaan")


def _struct(parts: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(n) for n, c in parts.items()])


#: A part of a record: its value from the text, or such a function and what is taken of its value. Functions that
#: several types have are one object, so that parse() makes and computes them once for all of them.
Part = Callable[[Column], Column] | tuple[Callable[[Column], Column], Callable[[Column], Column]]
#: A type's record: its parts by name, or a function from the text to the whole struct.
Record = tuple[tuple[str, Part], ...] | Callable[[Column], Column]


def _sections() -> dict[str, Part]:
    return {n: fields.stamps if n == "pelaksanaan" else (fields.order_values, lambda v, n=n: fields.order_section(v, n)) for n in ORDER_SECTIONS}


_OWN = _sections()
_ORDER = (*_OWN.items(), ("vendor", fields.vendor))
_SURVEY = (*_ORDER, *((n, (fields.survey, lambda v, n=n: v[n])) for n in fields.SURVEY_PARTS))
_DISMANTLE = (
    *((n, _OWN[n]) for n in ("spk", "pelanggan", "jaringan", "pelaksanaan")), ("pekerja_cabut", (fields.vendor, lambda v: _struct({n: v[n] for n in REMOVED}))), ("list_item", fields.list_items),
)


def _checklist(kind: str) -> Record:
    common = (("data_remote", checklists.remote_data), ("pelaksanaan", checklists.clocks))
    if kind == "wireless":
        quality = lambda text: F.struct(*[fields.quality_table(text, t).alias(n) for n, t in rules.QUALITY.items()])
        return (*common, ("data_perangkat", checklists.device_items), ("tegangan", fields.voltage_table), ("rsl", lambda text: fields.quality_pair(text, "RSL")), ("ups", checklists.ups), ("quality_parameter", quality))
    devices = lambda text: fields.devices(text, fields.WIRELINE_REG)
    return (
        *common, ("data_perangkat", devices), ("data_lokasi", checklists.location), ("electrical", checklists.electrical), ("environment", checklists.environment), ("indoor_area", checklists.indoor),
        ("line_checklist", checklists.line_items),
    )


def _form(*more: tuple[str, Callable[[Column], Column]]) -> Record:
    return (("header", forms.header), ("informasi_umum", forms.general), *more, ("notes", forms.notes), ("pelaksana", forms.executors))


def _items(start: str, end: str, letters: str, prefix: str) -> Callable[[Column], Column]:
    from fieldquarry.functions import text as T

    return lambda t: forms.marker_items(T.found(t, rf"(?ims){start}(.*?)(?=^\s*{end}|\z)"), letters, prefix)


_PHYSICAL = ("physical_check", _items(r"1\.\s*Physical\s+Check", r"2\.", "abcdefgh", "1"))
_PERFORMANCE = ("performance_measurement", _items(r"2\.\s*Performance", r"(?:3\.|Notes)", "a-z", "2"))

_MARKED = _form(_PHYSICAL, _PERFORMANCE)

#: Registry: a document type's record. New types are added here (or to a copy that parse() is given).
PARSERS: dict[str, Record] = {
    "spk_survey": _SURVEY, "spk_instalasi": _ORDER, "spk_aktivasi": _ORDER, "spk_dismantle": _DISMANTLE,
    "checklist_wireless": _checklist("wireless"), "checklist_wireline": _checklist("wireline"),
    **{f"form_pm_{n}": _MARKED for n in ("petir_grounding", "instalasi_kabel", "pole_tower")},
    "form_pm_rectifier": _form(("rectifier", forms.rectifier)),
    "form_pm_ruang_shelter": _form(("shelter", forms.shelter)),
    "form_pm_inverter": _form(("inverter", forms.inverter)),
    "form_pm_ac": _form(("air_conditioner", forms.air_conditioner)),
    "form_pm_battery": _form(("battery", forms.battery_information), ("battery_banks", forms.battery_banks), ("measurement_test", forms.measurements)),
    "form_pm_dokumentasi_perangkat": _form(("inventory", forms.inventory)),
    "form_pm_1phase_ups": _form(("checklist_items", lambda t: forms.ups_template())),
}


#: Record expressions by application, column and registry: making them takes thousands of calls into the JVM.
_MADE: dict[tuple, tuple[list[Column], Column]] = {}


def record_columns(spark, text_col: str = "text", parsers: dict[str, Record] | None = None) -> tuple[list[Column], Column]:
    """The parts of all records, each for the types that have it, and over these the record of a row as JSON by its
    document_type, null without parser. Made once a session and registry."""
    parsers = PARSERS if parsers is None else parsers
    key = (spark.sparkContext.applicationId, text_col, tuple(parsers.items()))
    if key not in _MADE:
        types: dict[Record, list[str]] = {}
        for t, record in parsers.items():
            types.setdefault(record, []).append(t)
        owners: dict[Callable[[Column], Column], list[str]] = {}
        for record, ts in types.items():
            for f in dict.fromkeys([record] if callable(record) else [_function(part) for _, part in record]):
                owners.setdefault(f, []).extend(ts)
        names = {f: f"__part_{i}" for i, f in enumerate(owners)}
        is_a = lambda ts: F.col("document_type").isin(*ts)
        parts = [F.when(is_a(ts), f(F.col(text_col))).alias(names[f]) for f, ts in owners.items()]
        value = lambda part: F.col(names[part]) if callable(part) else part[1](F.col(names[part[0]]))
        whole = lambda record: value(record) if callable(record) else _struct({n: value(part) for n, part in record})
        _MADE[key] = parts, classify.first_of([(is_a(ts), to_json(whole(record))) for record, ts in types.items()])
    return _MADE[key]


def _function(part: Part) -> Callable[[Column], Column]:
    return part if callable(part) else part[0]


def parse(docs: DataFrame, text_col: str = "text", parsers: dict[str, Record] | None = None) -> DataFrame:
    """docs with document_type, category, parsing_status and parsed (the record as JSON, null without parser)."""
    typed = classify.with_envelope(docs.withColumn("document_type", classify.document_type(F.col(text_col))))
    parts, record = record_columns(docs.sparkSession, text_col, parsers)
    return typed.select("*", *parts).select(*typed.columns, record.alias("parsed"))


def parser_status(spark) -> DataFrame:
    """(document_type, status) of all supported types, from the registry."""
    known = classify.category_table(spark).select("document_type", "category")
    return known.withColumn("status", F.when(F.col("document_type").isin(*PARSERS), "active").otherwise("planned"))
