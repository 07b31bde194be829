"""SQL gates: string checks for rows of statements, and a check of the parsed plan before running.

The string gates are columns (they judge tables of statements); the plan gate walks Catalyst's parse
of one statement, so names in strings, comments or sub-queries cannot mislead it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldquarry.operators import rules
from fieldquarry.plans.catalog import TABLES

DENIED = {"reflect", "java_method", "try_reflect", "read_files", "input_file_name"}


def gate(sql: Column) -> Column:
    """The reason why the simple gate refuses a statement, null if it passes.

    It looks for words anywhere, so is_deleted counts as DELETE: kept for comparison with older
    verdicts only. Statements are run behind check_plan.
    """
    up = F.upper(F.trim(sql))
    out = F.when(~F.startswith(up, F.lit("SELECT")), F.lit("not a SELECT"))
    for w in rules.FORBIDDEN:
        out = out.when(F.contains(up, F.lit(w)), F.lit(f"forbidden: {w}"))
    out = out.when(~F.contains(up, F.lit("FROM")), F.lit("no FROM"))
    known = F.lit(False)
    for t in TABLES:
        known |= F.contains(up, F.lit(t.upper()))
    out = out.when(~known, F.lit("no allowed table"))
    needs = (F.contains(up, F.lit("SPK")) | F.contains(up, F.lit("JARINGAN"))) & ~F.contains(up, F.lit("IS_DELETED"))
    return out.when(needs, F.lit("no is_deleted"))


def strict_errors(sql: Column) -> Column:
    """All errors of the strict gate, as an array."""
    up = F.upper(F.trim(sql))
    errors = [F.when(~F.rlike(up, F.lit(r"\A\s*SELECT\b")), F.lit("not a SELECT"))]
    errors += [F.when(F.rlike(up, F.lit(rf"\b{w}\b")), F.lit(f"forbidden: {w}")) for w in (*rules.FORBIDDEN, *rules.FORBIDDEN_MORE)]
    errors += [F.when(F.rlike(up, F.lit(f"(?is){p}")), F.lit(f"injection: {i}")) for i, p in enumerate(rules.INJECTIONS)]
    errors.append(F.when(~F.rlike(up, F.lit(r"\bFROM\b")), F.lit("no FROM")))
    names = F.regexp_extract_all(up, F.lit(r"\b(?:FROM|JOIN)\s+([A-Z_][A-Z0-9_]*)"), F.lit(1))
    errors.append(F.when(F.exists(names, lambda t: ~t.isin(*[x.upper() for x in TABLES])), F.lit("table not allowed")))
    return F.array_compact(F.array(*errors))


def lint(sql: Column) -> Column:
    """Warnings that do not refuse a statement."""
    up = F.upper(F.trim(sql))
    has = lambda p: F.rlike(up, F.lit(p))
    flagged = ~has("IS_DELETED")
    made = [
        F.when(has(r"SELECT\s+\*"), F.lit("SELECT *")),
        F.when(has(r"\bSPK\b") & flagged, F.lit("spk without is_deleted")),
        F.when(has(r"\bJARINGAN\b") & flagged, F.lit("jaringan without is_deleted")),
        F.when(~has(r"\bLIMIT\b") & ~has(r"\bCOUNT\b"), F.lit("no LIMIT")),
        F.when(has(r"\bFROM\s+SPK\b") & ~has(r"ORDER\s+BY"), F.lit("no ORDER BY")),
    ]
    return F.array_compact(F.array(*made))


def sanitise(sql: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(sql), r";+\s*\z", ""), r"\s+", " "))


class Refused(ValueError):
    """A statement that the plan gate does not let through."""


#: Relations with a soft-delete flag, and the flag.
FLAGGED, FLAG = ("spk", "jaringan"), "is_deleted"
#: Nodes that a row passes with all its columns: a filter above them is a filter of the relation below.
SAME_ROWS = ("Filter", "Join", "SubqueryAlias", "UnresolvedRelation", "UnresolvedSubqueryColumnAliases", "Sample")


def _scala(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _kind(node) -> str:
    return node.getClass().getSimpleName()


def _span(node) -> tuple[int, int]:
    """Where a node stands in its statement: first character, and the one after the last."""
    origin = node.origin()
    return origin.startIndex().get(), origin.stopIndex().get() + 1


def _name(attribute) -> list[str]:
    return [x.lower() for x in _scala(attribute.nameParts())]


def _conjuncts(expr) -> list:
    return [c for x in _scala(expr.children()) for c in _conjuncts(x)] if _kind(expr) == "And" else [expr]


def _kept_live(expr) -> str | None:
    """The qualifier ('' without one) whose deleted rows a condition drops: is_deleted = false (or 0), NOT is_deleted."""
    parts = _scala(expr.children())
    if _kind(expr) == "Not" and _kind(parts[0]) == "UnresolvedAttribute":
        flag = parts[0]
    elif _kind(expr) == "EqualTo" and any(_kind(x) == "Literal" and x.toString().lower() in ("false", "0") for x in parts):
        flag = next((x for x in parts if _kind(x) == "UnresolvedAttribute"), None)
    else:
        return None
    name = _name(flag) if flag is not None else []
    return None if not name or name[-1] != FLAG else name[-2] if len(name) > 1 else ""


class Statement:
    """What Catalyst's parse of a statement holds, and the edits that the policy asks for."""

    def __init__(self, spark: SparkSession, sql: str) -> None:
        try:
            plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception as error:
            raise Refused(f"does not parse: {str(error).splitlines()[0][:120]}") from None
        self.sql, self.ctes, self.relations, self.functions, self.flag_named = sql, set(), [], set(), False
        self.edits: list[tuple[int, int, str]] = []
        self._ctes(plan)
        self._plan(plan, [], None)

    def _ctes(self, node) -> None:
        if _kind(node) == "UnresolvedWith":
            self.ctes |= {item._1().lower() for item in _scala(node.cteRelations())}

    def _plan(self, node, kept: list[str], alias: str | None) -> None:
        """kept: qualifiers whose deleted rows a filter of this query block drops. alias: what the node is called."""
        kind = _kind(node)
        if "Command" in kind or "Insert" in kind or kind.startswith(("Create", "Drop", "Alter", "Truncate", "Delete", "Update", "Merge", "Replace", "Set", "Describe", "Show")):
            raise Refused(f"not a query: {kind}")
        if kind == "UnresolvedWith":
            self._ctes(node)
            for item in _scala(node.cteRelations()):
                self._plan(item._2(), [], None)
        if kind == "UnresolvedRelation":
            name = ".".join(_scala(node.multipartIdentifier())).lower()
            self.relations.append(name)
            if name in FLAGGED and name not in self.ctes and (alias or name) not in kept and "" not in kept:
                self.edits.append((*_span(node), f"(SELECT * FROM {name} WHERE {FLAG} = false)" + ("" if alias else f" AS {name}")))
        if kind in ("UnresolvedTableValuedFunction", "UnresolvedTVFAliases"):
            self.functions.update(x.lower() for x in re.findall(r"\w+", node.toString()))
        if kind not in SAME_ROWS:
            kept = []
        if kind == "Filter":
            kept = kept + [q for c in _conjuncts(node.condition()) if (q := _kept_live(c)) is not None]
        for expr in _scala(node.expressions()):
            self._expr(expr)
        children = _scala(node.children())
        for i, child in enumerate(children):
            # a condition of an outer join filters the side that may be missing
            sides = {"Inner": (0, 1), "Cross": (0, 1), "LeftOuter": (1,), "RightOuter": (0,)}
            own = [q for c in _conjuncts(node.condition().get()) if (q := _kept_live(c)) is not None] if kind == "Join" and node.condition().isDefined() and i in sides.get(node.joinType().toString(), ()) else []
            self._plan(child, kept + own, node.alias().lower() if kind == "SubqueryAlias" else None)

    def _expr(self, expr) -> None:
        kind = _kind(expr)
        if kind == "UnresolvedFunction":
            self.functions.add(expr.nameParts().last().lower())
        if kind == "UnresolvedAttribute":
            self.flag_named |= _name(expr)[-1] == FLAG
        if kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression", "InSubquery"):
            if kind != "InSubquery":
                self._plan(expr.plan(), [], None)
        parts = _scala(expr.children())
        names = [_name(x)[-1] if _kind(x) == "UnresolvedAttribute" else None for x in parts]
        if FLAG in names and kind in ("EqualTo", "EqualNullSafe", "In"):
            for x in parts:
                if _kind(x) == "Literal" and x.toString() in ("0", "1"):
                    self.edits.append((*_span(x), "false" if x.toString() == "0" else "true"))
        if kind == "Like" and names[0] == "nama_pelanggan":
            at = re.compile(r"(?i)LIKE").search(self.sql, _span(expr)[0])
            self.edits.append((at.start(), at.end(), "ILIKE"))
        for child in parts:
            self._expr(child)

    def check(self, tables: tuple[str, ...] = TABLES) -> None:
        if not self.relations:
            raise Refused("reads no table")
        for r in self.relations:
            if r not in self.ctes and r not in tables:
                raise Refused(f"table not allowed: {r}")
        for f in self.functions & DENIED:
            raise Refused(f"function not allowed: {f}")
        if set(FLAGGED) & set(self.relations) and not self.flag_named:
            raise Refused("spk and jaringan need is_deleted")

    def rewritten(self) -> str:
        """The statement with its edits, at the places that the parser gave them; nothing else is touched."""
        out = self.sql
        for start, end, text in sorted(set(self.edits), reverse=True):
            out = out[:start] + text + out[end:]
        return out


def check_plan(spark: SparkSession, sql: str, tables: tuple[str, ...] = TABLES) -> None:
    """Raise Refused unless sql is one query over allowed tables, without denied functions, that names is_deleted."""
    Statement(spark, sql).check(tables)


def rewrite(spark: SparkSession, sql: str) -> str:
    """sql with the policy in it: only live rows of flagged relations, boolean flags, names compared without case.

    Relations (under aliases, in sub-queries and CTEs) get a filter where their query block does not
    filter them already, by a condition that all its rows must meet. Literals and comments stay.
    """
    return Statement(spark, sql.strip().rstrip(";")).rewritten()


def run_checked(spark: SparkSession, sql: str, args: dict[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Check, rewrite and run a statement; values come as parameters, never as text."""
    statement = Statement(spark, sql.strip().rstrip(";"))
    statement.check()
    out = spark.sql(statement.rewritten(), args=args or {})
    return out.limit(limit) if limit is not None else out
