r"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Candidates are found in whole texts by four patterns. The hash of each candidate's value is then
aggregated by distinct repositories and owners over the whole corpus: a value that several owners
share, or that very many repositories hold, is a copied example; any other may be live. Pattern kinds
(assign, access, hex) are always reported; generic tokens (20+ characters with a digit and letters of
both cases) unless they are copied. Each candidate is labelled copied, owned (one owner) or shared.

Defined cases: null text is empty and has no spans; repeated rows are scanned one by one and count
as one repository; a null owner or repository is one of its own; an empty table gives no rows.
A hot value's rows are spread over salts before they meet its counts. Offsets are code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldquarry.llm.common import BROADCAST_ROWS, Scratch

#: Kinds in report order; the group holds the value. Letters are spelt in both cases where either counts.
ASSIGN = (
    r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
#: Greedy runs with their least length: the same spans as matching all runs and dropping short ones.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
GENERIC = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "generic")
MIN_VALUE = 6
#: Owners and repositories from which a value counts as a copied example; salts over which a value's rows are spread.
COPIED_OWNERS, COPIED_REPOS, SALTS = 3, 100, 64


#: Code points of a chunk of text, so that masking many spans of a long text reads it once.
CHUNK = 4096


def _hits(text: Column, kind: str, pattern: str, group: int, good) -> Column:
    """array<struct<ord, pos, gap, size, ok, vh>>: matches in turn, each with the length of the piece before it."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    zipped = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)).alias("piece"), found.alias("found"), values.alias("value"))

    def one(x: Column, i: Column) -> Column:
        sizes = F.length(x["piece"]).alias("gap"), F.length(x["found"]).alias("size")
        return F.struct(F.lit(KINDS.index(kind)).alias("ord"), i.alias("pos"), *sizes, good(x["value"]).alias("ok"), F.md5(x["value"]).alias("vh"))

    none = F.array().cast("array<struct<ord:int,pos:int,gap:int,size:int,ok:boolean,vh:string>>")
    return F.when(F.rlike(text, F.lit(pattern)), F.transform(zipped, one)).otherwise(none)


def _candidates(text: Column) -> Column:
    text = F.coalesce(text, F.lit(""))
    has = lambda v, p: F.rlike(v, F.lit(p))
    return F.concat(
        _hits(text, "assign", ASSIGN, 2, lambda v: F.length(v) >= MIN_VALUE),
        _hits(text, "access", ACCESS, 0, lambda v: F.lit(True)),
        _hits(text, "hex", HEX, 0, lambda v: F.lit(True)),
        _hits(text, "generic", GENERIC, 0, lambda v: has(v, "[0-9]") & has(v, "[a-z]") & has(v, "[A-Z]")),
    )


def _scan(docs: DataFrame, id_col: str, text_col: str, owner_col: str, repo_col: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rid, id) of all rows, and a row for each span that stays: rid, id, start, ord, kind, stop, n_owners, n_repos, label.

    Spans are rows of their own: where they start is a running sum over their row's matches, so the
    work grows with the matches, however many a text has.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(owner_col).cast("string").alias("owner"), F.col(repo_col).cast("string").alias("repo"), _candidates(F.col(text_col)).alias("found"))
    rows = scratch.put(rows.withColumn("rid", F.monotonically_increasing_id()), "secrets")
    hits = rows.where(F.size("found") > 0).select("rid", "id", "owner", "repo", F.explode("found").alias("s")).select("rid", "id", "owner", "repo", "s.*")
    through = F.sum(F.col("gap") + F.col("size")).over(Window.partitionBy("rid", "ord").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    kinds = F.array(*map(F.lit, KINDS))
    cand = hits.withColumn("stop", through.cast("int")).where("ok").withColumn("start", F.col("stop") - F.col("size")).withColumn("kind", F.get(kinds, F.col("ord")))
    cand = scratch.put(cand.drop("ok", "pos", "gap", "size").withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS))), "secret-spans")
    per_owner = cand.select("vh", "owner", "repo").distinct().groupBy("vh", "owner").agg(F.count("*").alias("n"))
    stats = per_owner.groupBy("vh").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos"))
    salted = cand.select("vh", "salt").distinct().join(stats, "vh")
    label = F.when((F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS), "copied").when(F.col("n_owners") == 1, "owned").otherwise("shared")
    by_start = Window.partitionBy("rid").orderBy("start")
    base = F.col("kind") != "generic"
    before = F.max(F.when(base, F.col("stop"))).over(by_start.rangeBetween(Window.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(by_start.rangeBetween(0, Window.unboundedFollowing))
    marked = cand.join(salted, ["vh", "salt"]).withColumns({"label": label, "clash": F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("stop"), F.lit(False))})
    marked = marked.where(base | ((F.col("label") != "copied") & ~F.col("clash")))
    return rows.select("rid", "id"), marked.select("rid", "id", "start", "ord", "kind", "stop", "n_owners", "n_repos", "label")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """(id, spans) per row of docs; spans: array<struct<start, ord, kind, stop, n_owners, n_repos, label>>.

    label: 'copied' where COPIED_OWNERS or more owners or COPIED_REPOS or more repositories hold the
    value, else 'owned' where one owner does, else 'shared'. Generic candidates stay only if not copied
    and clear of pattern spans.
    """
    scratch = Scratch()
    rows, spans = _scan(docs, id_col, text_col, owner_col, repo_col, scratch)
    one = F.struct("start", "ord", "kind", "stop", "n_owners", "n_repos", "label")
    marked = spans.groupBy("rid").agg(F.array_sort(F.collect_list(one)).alias("spans"))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,stop:int,n_owners:bigint,n_repos:bigint,label:string>>")
    return scratch.finish(rows.join(marked, "rid", "left").select("id", F.coalesce("spans", none).alias("spans")), "secret-scan")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def _between(chunks: Column, a: Column, b: Column) -> Column:
    """Code points a to b (exclusive) of a text that is given in chunks."""
    i, j = F.floor(a / CHUNK).cast("int"), F.floor(b / CHUNK).cast("int")
    at = lambda k: F.coalesce(F.get(chunks, k), F.lit(""))
    ends = F.concat(F.substring(at(i), a - i * CHUNK + 1, F.lit(CHUNK)), F.array_join(F.slice(chunks, i + 2, F.greatest(j - i - 1, F.lit(0))), ""), F.substring(at(j), F.lit(1), b - j * CHUNK))
    return F.when(i == j, F.substring(at(i), a - i * CHUNK + 1, b - a)).otherwise(ends)


def mask_islands(text: Column, islands: Column, tail: Column, mark: str) -> Column:
    """text with a mark for each island (struct<start, stop>: of the kept text before it), then the text from tail on."""
    text = F.coalesce(text, F.lit(""))

    def whole(chunks: Column) -> Column:
        kept = F.transform(islands, lambda s: F.concat(_between(chunks, s["start"], s["stop"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), _between(chunks, tail, F.greatest(tail, F.length(text))))

    return F.get(F.transform(F.array(F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % CHUNK), F.lit(0))), whole), F.lit(0))


def mask_live_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mark: str = "[SECRET]") -> DataFrame:
    """docs, all columns as they are, with every span masked whose value is not a widely copied example.

    Texts stay where they are while the rows with such spans are few enough to be broadcast.
    """
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    scratch = Scratch()
    keyed = docs.select(key.alias("s_id"), F.col(text_col).alias("s_text"), F.col(owner_col).alias("s_owner"), F.col(id_col).alias("s_repo"))
    _, spans = _scan(keyed, "s_id", "s_text", "s_owner", "s_repo", scratch)
    live = spans.where("label <> 'copied'").select(F.col("id").alias("s_id"), "start", "stop").distinct()
    # overlapping spans are one: kept text runs from where all earlier ones end
    before = F.max("stop").over(Window.partitionBy("s_id").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    live = live.withColumn("kept", F.coalesce(before, F.lit(0)))
    island = F.when(F.col("start") >= F.col("kept"), F.struct(F.col("kept").alias("start"), F.col("start").alias("stop")))
    live = live.groupBy("s_id").agg(F.array_sort(F.collect_list(island)).alias("s_islands"), F.max("stop").alias("s_tail"))
    live = scratch.finish(live, "live-secrets")
    found = live.agg(F.coalesce(F.sum(F.size("s_islands") + 4), F.lit(0)).alias("n")).head().n
    out = docs.withColumn("s_id", key).join(F.broadcast(live) if found <= BROADCAST_ROWS else live, "s_id", "left")
    masked = F.when(F.col("s_islands").isNotNull(), mask_islands(F.col(text_col), F.col("s_islands"), F.col("s_tail"), mark)).otherwise(F.col(text_col))
    return out.withColumn(text_col, masked).select(*docs.columns)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"] != "generic")

    def count(name: str, value: str) -> Column:
        return F.size(F.filter("spans", lambda s: s[name] == value)).cast("long").alias(f"n_{value}")

    return out.select(F.col("id").alias("doc_id"), *(count("kind", k) for k in KINDS[:3]), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"), count("label", "owned"), count("label", "copied"))


def oracle() -> str:
    def found(kind: str, pattern: str, group: int) -> str:
        p = pattern.replace("'", "''")
        at = "(coalesce(list_sum(list_transform(s[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))"
        return f"""SELECT rid, doc_id, source, {KINDS.index(kind)} AS ord, '{kind}' AS kind, {at}::BIGINT AS a, ({at} + length(m[i]))::BIGINT AS z, g[i] AS v
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, doc_id, source, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {group}) AS g, string_split_regex(t, '{p}') AS s FROM d))"""

    union = "\nUNION ALL ".join([found("assign", ASSIGN, 2), found("access", ACCESS, 0), found("hex", HEX, 0), found("generic", GENERIC, 0)])
    join = "coalesce(string_agg(kind || ':' || a || ':' || z, ',' ORDER BY a, ord){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
c AS ({union}),
k AS (SELECT * FROM c WHERE CASE kind WHEN 'assign' THEN length(v) >= {MIN_VALUE}
      WHEN 'generic' THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') ELSE true END),
o AS (SELECT v, count(*) AS owners, sum(n) AS repos
      FROM (SELECT v, source, count(*) AS n FROM (SELECT DISTINCT v, source, doc_id FROM k) GROUP BY v, source) GROUP BY v),
x AS (SELECT k.*, CASE WHEN owners >= {COPIED_OWNERS} OR repos >= {COPIED_REPOS} THEN 'copied' WHEN owners = 1 THEN 'owned' ELSE 'shared' END AS label FROM k JOIN o USING (v)),
y AS (SELECT * FROM x WHERE kind <> 'generic' OR (label <> 'copied' AND NOT EXISTS (
      SELECT 1 FROM x b WHERE b.rid = x.rid AND b.kind <> 'generic' AND b.a < x.z AND x.a < b.z)))
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
       count(*) FILTER (WHERE kind = 'hex') AS n_hex, sha256({join.format(" FILTER (WHERE kind <> 'generic')")}) AS base_sha256, {join.format('')} AS spans,
       count(*) FILTER (WHERE label = 'owned') AS n_owned, count(*) FILTER (WHERE label = 'copied') AS n_copied
FROM d LEFT JOIN y USING (rid) GROUP BY d.rid, d.doc_id
"""
