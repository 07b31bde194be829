"""Conversation structure repair: one solution for each distinct signature.

A conversation's rows become a string of symbols, one a row: its role's initial where the row may
stay (small: sound, capital: truncated), `d` where it must go (blank, or role and text seen before).
Strings are cut into segments of `SEGMENT` rows. Each distinct segment is solved once, by a memoised
recursion over rows and grammar states: for each state before it and after it the cheapest edits.
Solutions join back by segment; a conversation of several segments is put together from them by
costs and ranks alone. Then the edits are replayed over the rows in order.

Edits: K keeps a row, R gives it the role that comes next (user or assistant), D deletes it, I
inserts an empty row of the role that comes next. Roles must read `(s?(ua)+)?`. Two edit strings for
the same rows and of equal cost are never proper prefixes of each other (the longer would have more
inserts), so the ASCII-least of the parts is the ASCII-least of the whole.

A conversation is read in order by one task, as a stream: the hash of what it becomes is sequential.
Only segments, counts and states are held, whatever its length.

Defined results: a null role or text is one blank; a null id or turn is one blank in the key of the
damage, comes first, and null ids are one conversation; rows of one turn are ordered by role, then
text. A role's initial is its first character; roles of another initial than s, u, a cannot stay.
Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldquarry.llm.common import Scratch, small_batches

#: Rows of a segment at most.
SEGMENT = 512
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Grammar states: at the start, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state the state that user or assistant, whichever comes next, leads to.
NEXT = (USER, USER, ASSISTANT, USER)
#: Inserts that end a conversation well from each state.
TAIL = ("", "II", "I", "")
VISIBLE = r"[^ \t-\r]"


# ---- damage and faults --------------------------------------------------------------------------
def damaged(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of `conv_id:turn` chooses."""
    blank = F.lit(" ")
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("damage", F.crc32(key.cast("binary")) % 20).where("damage <> 0")
    text = F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("damage") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def faulty(rows: DataFrame) -> DataFrame:
    """rows with `pos` in their conversation (from 0), `fault`, `sym`, and the flags that are counted. One shuffle, by conv_id."""
    rows = rows.repartition("conv_id").withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    rows = rows.withColumn("seen", seen)
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text", "seen")
    visible = F.regexp_like("text", F.lit(VISIBLE))
    ended = F.regexp_like("text", F.lit(r"[.!?][ \t-\r]*\z"))
    fault = F.when(~visible, "blank").when(F.col("seen"), "duplicate").when(~ended, "truncated")
    initial = F.substring("role", 1, 1)
    sym = F.when(F.col("fault").isin("blank", "duplicate"), "d").when(~initial.isin("s", "u", "a"), "o").otherwise(initial)
    turn, before = F.col("turn"), F.lag("turn").over(order)
    pair = F.concat(F.lag(initial).over(order), initial)
    rows = rows.withColumns({"pos": F.row_number().over(order) - 1, "fault": fault, "fresh": turn.isNotNull() & (before.isNull() | (before != turn)), "illegal": F.coalesce(~pair.isin("su", "ua", "au"), F.lit(False))})
    return rows.withColumn("sym", F.when(F.col("fault") == "truncated", F.upper(sym)).otherwise(sym)).drop("seen", "digest")


def counted() -> list[Column]:
    count = lambda c: F.count_if(c).cast("long")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("fresh"), F.lit(0)).cast("long")
    return [gaps.alias("gaps"), *(count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")), count(F.col("illegal")).alias("illegal")]


# ---- solving ------------------------------------------------------------------------------------
def solve(segment: str) -> dict[tuple[int, int], tuple[int, str]]:
    """(state before, state after) -> (cost, edits), cheapest and then ASCII-least, of a segment's rows."""

    @cache
    def best(at: int, state: int) -> dict[int, tuple[int, str]]:
        """Of the rows from `at` on, for each state after them."""
        if at == len(segment):
            return {state: (0, "")}
        found: dict[int, tuple[int, str]] = {}

        def add(cost: int, edits: str, after: dict) -> None:
            for end, (c, e) in after.items():
                if end not in found or (cost + c, edits + e) < found[end]:
                    found[end] = (cost + c, edits + e)

        sym = segment[at]
        inserts, s = "", state
        while len(inserts) < 3:  # two inserts come back to where one began; three states can be met
            spent = INSERT * len(inserts)
            add(spent + DELETE, inserts + "D", best(at + 1, s))
            if sym != "d":
                late = TRUNCATED if sym.isupper() else 0
                add(spent + REROLE + late, inserts + "R", best(at + 1, NEXT[s]))
                kept = {"s": SYSTEM if s == START else None, "u": USER if s != USER else None, "a": ASSISTANT if s == USER else None}.get(sym.lower())
                if kept is not None:
                    add(spent + KEEP + late, inserts + "K", best(at + 1, kept))
            inserts, s = inserts + "I", NEXT[s]
        return found

    out = {}
    for at in range(len(segment), -1, -64):  # from the end on, so that no call goes deep
        for state in range(4):
            best(at, state)
    for state in range(4):
        out |= {(state, end): found for end, found in best(0, state).items()}
    return out


def _solved(batches):
    for b in batches:
        out = []
        for sig in b.column("sig").to_pylist():
            found = solve(sig)
            ranks = {e: i for i, e in enumerate(sorted({e for _, e in found.values()}))}
            out.append([{"enter": a, "leave": z, "cost": c, "rank": ranks[e], "edits": e} for (a, z), (c, e) in sorted(found.items())])
        yield pa.RecordBatch.from_arrays([b.column("sig"), pa.array(out, WAYS)], ["sig", "ways"])


WAYS = pa.list_(pa.struct([("enter", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("rank", pa.int32()), ("edits", pa.string())]))
WAYS_SQL = "ways array<struct<enter: int, leave: int, cost: long, rank: int, edits: string>>"


class Path:
    """Cheapest, then ASCII-least edits over a conversation's segments, from their costs and ranks alone.

    Forward, each state keeps its least cost and how its edits so far rank among the other states';
    of a segment four bytes remain: for each state after it the state before it.
    """

    def __init__(self) -> None:
        self.held, self.back = {START: (0, 0)}, bytearray()

    def step(self, ways: list[dict]) -> None:
        found: dict[int, tuple] = {}
        for w in ways:
            if w["enter"] in self.held:
                cost, order = self.held[w["enter"]]
                way = (cost + w["cost"], order, w["rank"], w["enter"])
                if w["leave"] not in found or way < found[w["leave"]]:
                    found[w["leave"]] = way
        ranks = {k: i for i, k in enumerate(sorted({f[1:3] for f in found.values()}))}
        self.held = {s: (f[0], ranks[f[1:3]]) for s, f in found.items()}
        self.back += bytes(found[s][3] if s in found else 0 for s in range(4))

    def end(self) -> tuple[int, list[tuple[int, int]]]:
        """Total cost, and for each segment in turn the states before and after it."""
        cost, _, state = min((c + INSERT * len(TAIL[s]), order, s) for s, (c, order) in self.held.items())
        path = []
        for at in range(len(self.back) - 4, -1, -4):
            path.append((self.back[at + state], state))
            state = self.back[at + state]
        return cost, path[::-1]


def chosen(ways: list[list[dict]]) -> tuple[int, list[tuple[int, int]]]:
    path = Path()
    for w in ways:
        path.step(w)
    return path.end()


def _choose(batches):
    """(conv_id, seg, enter, leave, cost) of segments that come in order."""
    conv, path, done = None, None, []

    def ended():
        cost, states = path.end()
        done.extend((conv, i, a, z, cost) for i, (a, z) in enumerate(states))

    def taken():
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        cols = list(zip(*done, strict=True)) if done else [[]] * 5
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "seg", "enter", "leave", "cost"])

    for b in batches:
        for r in b.to_pylist():
            if path is None or r["conv_id"] != conv:
                if path is not None:
                    ended()
                conv, path = r["conv_id"], Path()
            path.step(r["ways"])
        yield taken()
    if path is not None:
        ended()
        yield taken()


# ---- replay -------------------------------------------------------------------------------------
class Replay:
    """Rows of one conversation as they become by their edits: their hash, without holding them."""

    def __init__(self) -> None:
        self.hash, self.state, self.rows, self.edits = hashlib.sha256(), START, 0, []

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.rows else ''}{role}:{text}".encode())
        self.rows += 1

    def insert(self) -> None:
        self.state = NEXT[self.state]
        self.put("user" if self.state == USER else "assistant", "")

    def row(self, role: str, text: str) -> None:
        """The next row: inserts before it, then its own edit."""
        while (edit := self.edits.pop()) == "I":
            self.insert()
        if edit == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[0]]
            self.put(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self.put("user" if self.state == USER else "assistant", text)

    def end(self) -> str:
        for _ in TAIL[self.state]:
            self.insert()
        return self.hash.hexdigest()


def _replayed(batches):
    """Rows in order, each segment's edits before its rows: (conv_id, repaired_sha256)."""
    conv, replay = None, None
    for b in batches:
        out = []
        for r in b.to_pylist():
            if replay is None or r["conv_id"] != conv:
                if replay is not None:
                    out.append((conv, replay.end()))
                conv, replay = r["conv_id"], Replay()
            if r["edits"] is not None:
                replay.edits = list(reversed(r["edits"]))
            else:
                replay.row(r["role"], r["text"])
        yield _hashes(out)
    if replay is not None:
        yield _hashes([(conv, replay.end())])


def _hashes(rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["conv_id", "repaired_sha256"])


def repair(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(conv_id, counts, cost, audit, repaired_sha256) of conversations given as (conv_id, turn, role, text)."""
    rows = faulty(rows).withColumn("seg", F.floor(F.col("pos") / SEGMENT))
    rows = scratch.put(rows, "turn-rows")
    symbols = F.transform(F.sort_array(F.collect_list(F.struct("pos", "sym"))), lambda s: s["sym"])  # SEGMENT rows at most
    segments = scratch.put(rows.groupBy("conv_id", "seg").agg(F.array_join(symbols, "").alias("sig")), "turn-segments")
    solved = scratch.put(segments.select("sig").distinct().mapInArrow(_solved, f"sig string, {WAYS_SQL}"), "turn-solved")
    # numbers of the ways, without edits, are all that putting segments together needs
    slim = solved.select("sig", F.transform("ways", lambda w: F.struct(w["enter"].alias("enter"), w["leave"].alias("leave"), w["cost"].alias("cost"), w["rank"].alias("rank"))).alias("ways"))
    steps = segments.join(slim, "sig").select("conv_id", "seg", "ways").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    path = scratch.put(steps.mapInArrow(_choose, "conv_id long, seg long, enter int, leave int, cost long"), "turn-path").alias("p")
    keyed = segments.alias("s").join(path, F.col("s.conv_id").eqNullSafe(F.col("p.conv_id")) & (F.col("s.seg") == F.col("p.seg")))
    way = F.filter("ways", lambda w: (w["enter"] == F.col("enter")) & (w["leave"] == F.col("leave")))[0]
    edits = keyed.select("s.conv_id", "s.seg", "s.sig", "enter", "leave", "cost").join(solved, "sig").select("conv_id", "seg", "leave", "cost", way["edits"].alias("edits"))
    edits = scratch.put(edits, "turn-edits")
    stream = rows.select("conv_id", "seg", "pos", "role", "text", F.lit(None).cast("string").alias("edits"))
    stream = stream.unionByName(edits.select("conv_id", "seg", F.lit(-1).alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"), "edits"))
    stream = small_batches(stream.repartition("conv_id").sortWithinPartitions("conv_id", "seg", "pos"))
    hashes = stream.mapInArrow(_replayed, "conv_id long, repaired_sha256 string")
    parts = F.sort_array(F.collect_list(F.struct("seg", "edits", "leave")))
    last = F.element_at(parts, -1)["leave"]
    tail = F.element_at(F.array(*(F.lit(t) for t in TAIL)), last + 1)
    audits = edits.groupBy("conv_id").agg(F.max("cost").alias("cost"), F.concat(F.array_join(F.transform(parts, lambda x: x["edits"]), ""), tail).alias("audit"))
    counts = rows.groupBy("conv_id").agg(*counted())
    same = lambda a, b: F.col(f"{a}.conv_id").eqNullSafe(F.col(f"{b}.conv_id"))
    out = counts.alias("c").join(audits.alias("a"), same("c", "a")).join(hashes.alias("h"), same("c", "h"))
    return out.select("c.*", "a.cost", "a.audit", "h.repaired_sha256")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    scratch = Scratch()
    try:
        done = repair(damaged(turns), scratch).alias("r")
        every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("t")
        out = every.join(done, F.col("t.conv_id").eqNullSafe(F.col("r.conv_id")), "left")
        zeros = [F.coalesce(f"r.{c}", F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
        texts = [F.coalesce("r.audit", F.lit("")).alias("audit"), F.coalesce("r.repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256")]
        return scratch.finish(out.select("t.conv_id", *zeros, *texts), "turns-repaired")
    finally:
        scratch.clear()


def oracle() -> str:
    """Crc32 bit by bit; the cheapest edits by a recursion over rows that keeps the best string of each state."""
    return r"""
WITH RECURSIVE k AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
c AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
        lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) % 20 AS damage FROM k),
r AS (SELECT conv_id, turn, CASE WHEN damage = 4 THEN 'user' ELSE role END AS role,
             CASE damage WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE WHEN damage = 3 THEN [0, 1] ELSE [0] END) AS copy FROM c WHERE damage <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS seen FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS pos FROM n),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
             substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM o),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
dp(conv_id, pos, st, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'body': ''} FROM f
  UNION ALL
  SELECT conv_id, pos, st, min(best) FROM (
    SELECT s.conv_id, f.pos, e.st, {'cost': s.best.cost + i.n * 5 + e.cost + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END,
           'audit': s.best.audit || i.audit || e.edit,
           'body': s.best.body || i.body || CASE e.edit WHEN 'D' THEN '' WHEN 'K' THEN f.role || ':' || f.text || chr(10)
                    ELSE CASE e.st WHEN 2 THEN 'user:' ELSE 'assistant:' END || f.text || chr(10) END} AS best
    FROM dp s JOIN f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.pos = s.pos + 1,
    LATERAL (VALUES (0, s.st, '', ''), (1, CASE s.st WHEN 2 THEN 3 ELSE 2 END, 'I', CASE s.st WHEN 2 THEN 'assistant:' ELSE 'user:' END || chr(10)),
                    (2, CASE s.st WHEN 2 THEN 2 ELSE 3 END, 'II', CASE s.st WHEN 2 THEN 'assistant:' || chr(10) || 'user:' ELSE 'user:' || chr(10) || 'assistant:' END || chr(10))) i(n, st, audit, body),
    LATERAL (VALUES ('D', i.st, 2), ('R', CASE i.st WHEN 2 THEN 3 ELSE 2 END, 1),
                    ('K', CASE WHEN f.initial = 's' AND i.st = 0 THEN 1 WHEN f.initial = 'u' AND i.st <> 2 THEN 2 WHEN f.initial = 'a' AND i.st = 2 THEN 3 END, 0)) e(edit, st, cost)
    WHERE e.st IS NOT NULL AND (e.edit = 'D' OR f.fault NOT IN ('blank', 'duplicate'))) GROUP BY conv_id, pos, st),
ends AS (SELECT dp.conv_id, min({'cost': best.cost + t.n * 5, 'audit': best.audit || t.audit, 'body': best.body || t.body}) AS best
         FROM dp JOIN (SELECT conv_id, max(pos) AS pos FROM f GROUP BY conv_id) m ON m.conv_id IS NOT DISTINCT FROM dp.conv_id AND m.pos = dp.pos
         JOIN (VALUES (0, 0, '', ''), (1, 2, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 1, 'I', 'assistant:' || chr(10)), (3, 0, '', '')) t(st, n, audit, body) ON t.st = dp.st
         GROUP BY dp.conv_id)
SELECT t.conv_id, coalesce(c.gaps, 0)::BIGINT AS gaps, coalesce(c.blank, 0)::BIGINT AS blank, coalesce(c.duplicate, 0)::BIGINT AS duplicate, coalesce(c.truncated, 0)::BIGINT AS truncated,
       coalesce(c.illegal, 0)::BIGINT AS illegal, coalesce(e.best.cost, 0)::BIGINT AS cost, coalesce(e.best.audit, '') AS audit,
       sha256(coalesce(left(e.best.body, greatest(length(e.best.body) - 1, 0)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) t
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM t.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM t.conv_id
"""
