"""Questions to intents, and to SQL with parameters; SQL text out of a language model's reply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldquarry.functions import text as T
from fieldquarry.operators import rules
from fieldquarry.operators.classify import any_in, first_of

NETWORK = r"\b(\d{10})\b"
ORDER = r"([0-9]{6}/[A-Za-z-]+/\d{4})"
CUSTOMER = r"(?-i)[Pp]elanggan\s+([A-Z][A-Z &.]{5,})"


def network_of(text: Column) -> Column:
    return T.found(text, NETWORK)


def order_of(text: Column) -> Column:
    return T.found(text, ORDER)


def asked_order_of(text: Column) -> Column:
    """The order behind the word 'spk' ('no spk', 'nomor spk'), else the first one."""
    return F.coalesce(T.found(text, r"(?i)spk\s+" + ORDER), order_of(text))


def customer_of(text: Column) -> Column:
    return T.strip(T.found(text, CUSTOMER))


def intent(question: Column, ctx_network: Column, ctx_order: Column, last_was_count: Column) -> Column:
    """struct<type, strategy, confidence, rule>: the first rule that holds."""
    q = F.lower(F.trim(question))
    own_network, own_order = network_of(q), asked_order_of(question)
    n, s = F.coalesce(own_network, ctx_network).isNotNull(), F.coalesce(own_order, ctx_order).isNotNull()
    x = own_network.isNotNull() | own_order.isNotNull()
    words = F.size(F.filter(F.split(q, r"\s+"), lambda w: w != ""))
    starts = F.lit(False)
    for w in rules.SHORT_STARTS:
        starts |= F.startswith(q, F.lit(w))

    def made(kind: Column | str, confidence: float, rule: str, strategy: str = "SQL") -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("type"), F.lit(strategy).alias("strategy"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule"))

    short = first_of([(q.isin(*rules.SHORT_LIST), "LIST_SPK"), (q.isin(*rules.SHORT_COUNT), "COUNT_SPK")], "SPECIFIC_QUERY")
    by_order = first_of([(any_in(q, rules.VENDOR_WORDS), "GET_VENDOR_TEKNISI"), (any_in(q, rules.DETAIL_WORDS), "GET_SPK_DETAIL")], "SPECIFIC_QUERY")
    about = first_of([(any_in(q, rules.COUNT_WORDS), "COUNT_SPK"), (any_in(q, rules.LIST_WORDS), "LIST_SPK")], "SPECIFIC_QUERY")
    return first_of(
        [
            ((words <= 2) & starts & (n | s), made(short, 0.98, "R0")),
            (own_order.isNotNull(), made(by_order, 0.98, "R0.5")),
            (last_was_count & (n | s) & any_in(q, rules.AFTER_COUNT), made("LIST_SPK", 0.95, "R1")),
            (any_in(q, rules.ORDER_WORDS) & n, made(about, 0.95, "R2")),
            (any_in(q, rules.REFERENCES) & (n | s), made("SPECIFIC_QUERY", 0.90, "R3")),
            (any_in(q, rules.FACT_WORDS) & (n | s | x), made("SPECIFIC_QUERY", 0.85, "R4")),
            (any_in(q, rules.HOW_WORDS), made("GENERAL_INFO", 0.90, "R5", "RAG")),
        ],
        made("GENERAL_INFO", 0.70, "default", "RAG"),
    )


def needs_llm(question: Column, network: Column, order: Column) -> Column:
    """Whether a question goes to the language model rather than a template."""
    q = F.lower(F.trim(question))
    has = lambda w: F.contains(q, F.lit(w))
    ref = any_in(q, rules.LLM_REFERENCES)
    ids = network.isNotNull() | order.isNotNull()
    return (
        (ref & ~(has("berapa") & has("spk") & ids))
        | any_in(q, rules.LLM_HOW)
        | F.rlike(q, F.lit(r"\A(pop|teknisi|vendor|lokasi|alamat)\s+(nya|apa)\??\z|\A(siapa|kapan|dimana)\s+\w+\??\z"))
        | ((has("teknisi") | has("vendor")) & ~has("spk") & order.isNotNull())
        | (~ids & ~any_in(q, rules.GREETINGS))
    )


def template_of(question: Column, network: Column, order: Column) -> Column:
    """Name of the template that answers, 'llm', or 'fallback' where no template matches."""
    q = F.lower(F.trim(question))
    has = lambda w: F.contains(q, F.lit(w))
    n = network.isNotNull()
    kind = first_of([(has(k), k) for k in rules.LIST_KINDS])
    when = first_of([(has(k), k) for k in ("survey", "instalasi", "aktivasi")])
    return first_of(
        [
            (needs_llm(question, network, order), F.lit("llm")),
            (has("berapa") & has("spk") & n, F.lit("count_spk")),
            ((has("spk") | has("sebutkan") | has("list")) & n, F.when(kind.isNotNull(), F.concat(F.lit("list_spk_"), kind)).otherwise("list_spk")),
            (has("pelanggan") & n & has("apa"), F.lit("customer_info")),
            (has("kapan") & when.isNotNull() & n, F.concat(F.lit("latest_"), when)),
        ],
        F.lit("fallback"),
    )


# Templates take parameters by marker and are checked by the gate like any other statement.
SELECT_ORDER = "SELECT s.id_spk, s.no_spk, s.jenis_spk, s.tanggal_spk FROM spk s WHERE s.no_jaringan = :network AND s.is_deleted = false"
TEMPLATES = {
    "count_spk": "SELECT COUNT(DISTINCT s.id_spk) AS jumlah_spk FROM spk s WHERE s.no_jaringan = :network AND s.is_deleted = false",
    "list_spk": f"{SELECT_ORDER} ORDER BY s.tanggal_spk DESC, s.id_spk",
    **{f"list_spk_{k}": f"{SELECT_ORDER} AND s.jenis_spk = '{k}' ORDER BY s.tanggal_spk DESC, s.id_spk" for k in rules.LIST_KINDS},
    "customer_info": "SELECT j.no_jaringan, j.nama_pelanggan, j.lokasi_pelanggan, j.jasa, j.kecepatan FROM jaringan j WHERE j.no_jaringan = :network AND j.is_deleted = false",
    **{
        f"latest_{k}": "SELECT s.no_spk, s.tanggal_spk, j.nama_pelanggan, j.lokasi_pelanggan, sei.teknisi, sei.nama_vendor FROM spk s JOIN jaringan j ON s.no_jaringan = j.no_jaringan"
        f" LEFT JOIN spk_execution_info sei ON s.id_spk = sei.id_spk WHERE s.no_jaringan = :network AND s.jenis_spk = '{k}' AND s.is_deleted = false AND j.is_deleted = false"
        " ORDER BY s.tanggal_spk DESC, s.id_spk LIMIT 1"
        for k in ("survey", "instalasi", "aktivasi")
    },
    "fallback": "SELECT j.no_jaringan, j.nama_pelanggan, j.lokasi_pelanggan, j.jasa, j.media_akses, j.kecepatan, j.pop FROM jaringan j WHERE j.no_jaringan = :network AND j.is_deleted = false LIMIT 1",
}


def run_template(spark: SparkSession, name: str, network: str) -> DataFrame:
    """A template's answer for a network id (ten digits, passed as a parameter)."""
    from fieldquarry.operators.sqlgate import run_checked

    if not (len(network) == 10 and network.isdigit()):
        raise ValueError("a network id has ten digits")
    return run_checked(spark, TEMPLATES[name], {"network": network})


def sql_of_reply(reply: Column) -> Column:
    """The first SELECT statement of a model's reply, without fences, prefixes or the final semicolon."""
    plain = F.regexp_replace(reply, r"(?i)```(?:sql)?", "")
    found = T.found(plain, r"(?is)(SELECT\b.*?(?:;|\z))")
    return T.strip(F.regexp_replace(T.strip(found), r";\z", ""))


def sql_prompt(question: Column, schema: str | Column) -> Column:
    shown = F.lit(schema) if isinstance(schema, str) else schema
    return F.concat(F.lit("Write one SELECT statement for this schema.\n"), shown, F.lit("\nQuestion: "), question, F.lit("\nSQL:"))
