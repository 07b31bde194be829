"""Mixing sources to target weights by min-cost flow over membership patterns.

Documents may belong to several sources. They are aggregated by membership pattern; a min-cost flow
on the driver routes each pattern's words (first copy free, each further copy dearer: convex costs)
to source quotas; then whole documents are selected in a seeded order, as a per-pattern cut-off that
every row is compared with. Rows never move: only word sums per (pattern, hash bucket) are shuffled.

Defined cases: null or blank text has size 0 and takes nothing; a null source is a source of its
own, sorted last; a document of no source (null or empty membership) takes nothing; an empty table gives an empty result; rows that share a doc_id are taken or left
together. Columns of the input are kept, except that a clash with an output column is an error that
`mix` avoids by replacing the column.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldquarry.llm.common import store, word_count

#: Hash buckets (hex digits of the seeded key) by which the cut-off is found.
BUCKET_DIGITS = 3
#: Membership patterns and sources the driver's flow problem may have; more is an error, never a cut.
MAX_PATTERNS = 100_000
#: Files of the table of bucket sums, at most: it has a row for each pattern and bucket, however many documents there are.
CELL_FILES = 32


def water_fill(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of total by weight, each at most cap x its size; the excess is reshared by weight."""
    target, open_ = [0.0] * len(sizes), [i for i in range(len(sizes)) if weights[i] > 0]
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = float(cap * sizes[i])
        left -= sum(target[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return target


def min_cost_flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], copies: int) -> list[dict[int, int]]:
    """Words that each pattern sends to each of its sources: most words first, then least repetition.

    patterns: (sources, words); quotas: words wanted by source; copies: times a word may be used.
    The k-th copy of a word costs k - 1, so the cost is convex. Shortest paths with potentials over
    pattern nodes, source nodes and a sink; all paths of one cost are saturated by blocking flows, so
    there are few rounds however many patterns; ties go to the lower index.
    """
    n_p, n_s = len(patterns), len(quotas)
    start, sink = n_p + n_s, n_p + n_s + 1
    head: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def arc(u: int, v: int, cap: int, c: int) -> None:
        for a, b, r, k in ((u, v, cap, c), (v, u, 0, -c)):
            head[a].append(len(to))
            to.append(b)
            room.append(r)
            cost.append(k)

    for p, (members, words) in enumerate(patterns):
        for k in range(copies):
            arc(start, p, words, k)
        for s in members:
            arc(p, n_p + s, words * copies, 0)
    for s, q in enumerate(quotas):
        arc(n_p + s, sink, q, 0)
    price = [0] * len(head)
    while True:
        far = [float("inf")] * len(head)
        far[start] = 0
        heap = [(0, start)]
        while heap:
            d, u = heapq.heappop(heap)
            if d > far[u]:
                continue
            for e in head[u]:
                v, x = to[e], d + cost[e] + price[u] - price[to[e]]
                if room[e] > 0 and x < far[v]:
                    far[v] = x
                    heapq.heappush(heap, (x, v))
        if far[sink] == float("inf"):
            break
        price = [p + (int(f) if f < far[sink] else int(far[sink])) for p, f in zip(price, far, strict=True)]
        _saturate(head, to, room, cost, price, start, sink)
    sent: list[dict[int, int]] = [{} for _ in range(n_p)]
    for p in range(n_p):
        for e in head[p]:
            if n_p <= to[e] < n_p + n_s and room[e ^ 1]:
                sent[p][to[e] - n_p] = room[e ^ 1]
    return sent


def _saturate(head: list[list[int]], to: list[int], room: list[int], cost: list[int], price: list[int], start: int, sink: int) -> None:
    """All flow that arcs of reduced cost 0 can still carry: blocking flows by levels, lower arcs first."""
    while True:
        level = [-1] * len(head)
        level[start] = 0
        queue = [start]
        for u in queue:
            for e in head[u]:
                v = to[e]
                if level[v] < 0 and room[e] > 0 and cost[e] + price[u] == price[v]:
                    level[v] = level[u] + 1
                    queue.append(v)
        if level[sink] < 0:
            return
        turn, path, u = [0] * len(head), [], start
        while True:
            if u == sink:
                push = min(room[e] for e in path)
                for e in path:
                    room[e] -= push
                    room[e ^ 1] += push
                cut = next(k for k, e in enumerate(path) if not room[e])
                u = to[path[cut] ^ 1]
                del path[cut:]
            while turn[u] < len(head[u]):
                e = head[u][turn[u]]
                if room[e] > 0 and level[to[e]] == level[u] + 1 and cost[e] + price[u] == price[to[e]]:
                    break
                turn[u] += 1
            else:
                if not path:
                    break
                u = to[path.pop() ^ 1]
                turn[u] += 1
                continue
            path.append(e)
            u = to[e]


@dataclass
class MixPlan:
    """Per-pattern decisions (a small table) and the flow behind them."""

    rows: list[tuple]
    sources: list[str | None]
    targets: list[float]
    flows: list[dict[int, int]] = field(default_factory=list)

    SCHEMA = T.StructType([
        T.StructField("m_pattern", T.StringType()), T.StructField("source_size", T.LongType()), T.StructField("target", T.DoubleType()),
        T.StructField("m_copies", T.LongType()), T.StructField("m_cut_key", T.StringType()), T.StructField("m_cut_id", T.LongType()),
        T.StructField("m_fill_key", T.StringType()), T.StructField("m_fill_id", T.LongType()),
    ])

    def routes(self) -> list[tuple[str, str | None, int]]:
        """(pattern, source, words): what each pattern sends to each of its sources, by the flow."""
        return [(r[0], self.sources[s], n) for r, sent in zip(self.rows, self.flows, strict=True) for s, n in sorted(sent.items())]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.SCHEMA)


def seeded_key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def pattern_of(members: Column) -> Column:
    """A sorted, duplicate-free JSON list of sources: the key of a membership pattern."""
    return F.to_json(F.array_sort(F.array_distinct(members)), {"ignoreNullFields": "false"})


def plan_mix(slim: DataFrame, weights, copies: int, share: float) -> MixPlan:
    """slim: m_members array<string>, m_pattern, m_key, doc_id, size; weights: sources -> list of weights."""
    spark = slim.sparkSession
    cells = slim.groupBy("m_pattern", F.substring("m_key", 1, BUCKET_DIGITS).alias("bucket")).agg(F.sum("size").alias("words"), F.first("m_members").alias("members"))
    cells = store(cells.coalesce(CELL_FILES), "mix-cells")
    found = cells.df.groupBy("m_pattern").agg(F.sum("words").alias("words"), F.first("members").alias("members")).limit(MAX_PATTERNS + 1).collect()
    if len(found) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; group sources before mixing")
    found = sorted(found, key=lambda r: r.m_pattern)
    sources = sorted({s for r in found for s in r.members}, key=lambda s: (s is None, s or ""))
    at = {s: i for i, s in enumerate(sources)}
    patterns = [(tuple(sorted({at[s] for s in r.members})), r.words) for r in found]
    sizes = [sum(w for m, w in patterns if i in m) for i in range(len(sources))]
    targets = water_fill(sizes, weights(sources), share * sum(w for _, w in patterns), copies)
    flows = min_cost_flow(patterns, [round(t) for t in targets], copies)
    want = [sum(f.values()) for f in flows]
    whole = [f // w if w else 0 for f, (_, w) in zip(want, patterns, strict=True)]
    part = [f - q * w for f, q, (_, w) in zip(want, whole, patterns, strict=True)]
    rest = spark.createDataFrame([(r.m_pattern, p) for r, p in zip(found, part, strict=True)], "m_pattern string, part long")

    run = Window.partitionBy("m_pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = cells.df.select("m_pattern", "bucket", "words", F.sum("words").over(run).alias("through")).join(F.broadcast(rest), "m_pattern")
    cut = cum.where("through > part").groupBy("m_pattern").agg(F.min(F.struct("bucket", "through", "words", "part")).alias("c"))
    cut = cut.select("m_pattern", F.col("c.bucket").alias("bucket"), (F.col("c.through") - F.col("c.words")).alias("before"), F.col("c.part").alias("part"))
    edge = store(cut.coalesce(1), "mix-cut")
    near = slim.withColumn("bucket", F.substring("m_key", 1, BUCKET_DIGITS)).join(F.broadcast(edge.df), ["m_pattern", "bucket"])
    near = near.groupBy("m_pattern", "m_key", "doc_id", "before", "part").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("m_pattern").orderBy("m_key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("through", F.col("before") + F.sum("words").over(order)).where("through <= part")
    last = near.groupBy("m_pattern").agg(F.max(F.struct("m_key", "doc_id", "through")).alias("l"))
    stops = {r.m_pattern: r for r in edge.df.join(last, "m_pattern", "left").select("m_pattern", "bucket", "before", "l").collect()}

    cuts = {}
    for r, p in zip(found, part, strict=True):
        s = stops.get(r.m_pattern)
        if p == 0 or s is None:
            cuts[r.m_pattern] = ("", -1, 0, p)
        elif s.l is not None:
            cuts[r.m_pattern] = (s.l.m_key, -1 if s.l.doc_id is None else s.l.doc_id, s.l.through, p)  # -1: see _before
        else:  # no document of the cut bucket fits: all buckets before it are in
            cuts[r.m_pattern] = (s.bucket, -1, s.before, p)
    gaps = spark.createDataFrame([(k, *v) for k, v in cuts.items()], "m_pattern string, ck string, ci long, got long, part long")
    left = slim.join(F.broadcast(gaps), "m_pattern").where(~_before("m_key", "doc_id", "ck", "ci"))
    left = left.withColumn("gap", F.col("part") - F.col("got")).where("size > 0 AND size < 2 * gap")
    fill = left.groupBy("m_pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "m_key", "doc_id")).alias("f"))
    fills = {r.m_pattern: (r.f.m_key, r.f.doc_id) for r in fill.collect()}
    cells.drop()
    edge.drop()
    rows = []
    for r, q, (members, words) in zip(found, whole, patterns, strict=True):
        ck, ci, _, _ = cuts[r.m_pattern]
        size = sizes[members[0]] if len(members) == 1 else words
        rows.append((r.m_pattern, size, float(sum(targets[s] for s in members)), q, ck, ci, *fills.get(r.m_pattern, (None, None))))
    return MixPlan(rows, sources, targets, flows)


def _before(key: str, doc_id: str, cut_key: str, cut_id: str) -> Column:
    """Whether a row comes no later than the cut; a null id counts as -1 (only equal ids share a key)."""
    a, b = F.col(key), F.col(cut_key)
    return (a < b) | ((a == b) & (F.coalesce(F.col(doc_id), F.lit(-1)) <= F.col(cut_id)))


def mix(docs: DataFrame, members: Column, weights, copies: int = 3, share: float = 1.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size, source_size, target, copies and taken (words used, repeats counted: size x copies)."""
    made = docs.drop("size", "source_size", "target", "copies", "taken")
    made = made.withColumns({"m_members": F.coalesce(members.cast("array<string>"), F.array().cast("array<string>")), "size": word_count(F.col(text_col)), "m_key": seeded_key(F.col(id_col), seed)})
    made = made.withColumn("m_pattern", pattern_of(F.col("m_members")))
    slim = store(made.select("m_members", "m_pattern", "m_key", F.col(id_col).cast("long").alias("doc_id"), "size"), "mix-slim")
    plan = plan_mix(slim.df, weights, copies, share)
    slim.drop()
    out = made.join(F.broadcast(plan.table(docs.sparkSession)), "m_pattern")
    extra = _before("m_key", id_col, "m_cut_key", "m_cut_id") | F.coalesce((F.col("m_key") == F.col("m_fill_key")) & F.col(id_col).cast("long").eqNullSafe(F.col("m_fill_id")), F.lit(False))
    out = out.withColumn("copies", F.col("m_copies") + extra.cast("long")).withColumn("taken", F.col("size") * F.col("copies"))
    return out.drop("m_members", "m_pattern", "m_key", "m_copies", "m_cut_key", "m_cut_id", "m_fill_key", "m_fill_id")


def cycle_weights(sources: list[str | None]) -> list[float]:
    """1, 2, 3, 1, ... by the sources' order (code point, null last)."""
    return [1.0 + i % 3 for i in range(len(sources))]


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = mix(docs, F.array("source"), cycle_weights)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    return r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || doc_id::VARCHAR) AS k FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS sz, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT source, sz, 1.0 + ((r - 1) % 3) AS w, sum(sz) OVER () AS total, 3 * sz / (1.0 + ((r - 1) % 3)) AS level FROM s),
-- water level: sources in order of the level at which they fill; the first level that all later ones can hold
o AS (SELECT *, coalesce(sum(3 * sz) OVER (ORDER BY level, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
             sum(w) OVER (ORDER BY level, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
lv AS (SELECT arg_min((total - full_before) / w_left, level) FILTER (WHERE (total - full_before) / w_left <= level) AS water FROM o),
t AS (SELECT source, sz::BIGINT AS source_size, CASE WHEN w * water > 3 * sz THEN 3 * sz ELSE w * water END AS target FROM o, lv),
q AS (SELECT *, round_even(target, 0)::BIGINT AS quota FROM t),
p AS (SELECT *, CASE WHEN source_size > 0 THEN quota // source_size ELSE 0 END AS copies,
             CASE WHEN source_size > 0 THEN quota % source_size ELSE 0 END AS part FROM q),
c AS (SELECT d.doc_id, d.size, d.k, p.source_size, p.target, p.copies, p.part, p.source,
             sum(d.size) OVER (PARTITION BY p.source ORDER BY d.k, d.doc_id) AS through
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
-- the cut-off ends at the last prefix that fits
g AS (SELECT *, through <= part AND part > 0 AS chosen,
             part - max(CASE WHEN through <= part THEN through ELSE 0 END) OVER (PARTITION BY source) AS gap FROM c),
f AS (SELECT *, row_number() OVER (PARTITION BY source, (NOT chosen AND size > 0 AND size < 2 * gap) ORDER BY abs(size - gap), k, doc_id) = 1
             AND NOT chosen AND size > 0 AND size < 2 * gap AS filled FROM g)
SELECT doc_id, size, source_size, target, size * (copies + (chosen OR filled)::BIGINT) AS taken FROM f
"""
