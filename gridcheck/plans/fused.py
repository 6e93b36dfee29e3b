"""All rules of a table's columns and slots as one array of findings per row.

The contract names rules by kind; each kind is a function from a cell to findings.
A table is scanned once for all of them.  What needs another table carries a key
to its edge (see ``operators.findings``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcheck.functions.scalar import is_blank, let, strip_outer_quotes, wrap_uint
from gridcheck.operators import columns as C
from gridcheck.operators import refs as R
from gridcheck.operators import slot_rules as S
from gridcheck.operators.findings import FINDING, finding, gathered, short, when, whole
from gridcheck.operators.formulas import Lookup, formula_findings, used_part, walk
from gridcheck.plans.contract import ColumnContract, ColumnRule, Contract, SlotContract, TableContract, physical_columns

TYPES = ("int", "float", "boolean", "stored_boolean")


@dataclass
class Edges:
    """The targets that findings refer to, numbered: (table, column, resolver) -> edge; those that are not there have none.

    ``single`` (as short rows) and ``many`` are the findings with keys of the
    table in hand, all that a look at its references has to read.  ``fixed`` is
    what short rows leave out, for all tables.
    """

    has_target: Callable[[str, str], bool]
    numbers: dict[tuple[str, str, str], int] = field(default_factory=dict)
    table: str = ""
    fixed: list[dict[str, str | None]] = field(default_factory=list)
    single: list[Column] = field(default_factory=list)
    many: list[Column] = field(default_factory=list)

    def of(self, table: str, column: str, resolver: str) -> int | None:
        if not self.has_target(table, column):
            return None
        return self.numbers.setdefault((table.lower(), column.lower(), resolver), len(self.numbers))

    def fix(self, **said: str | None) -> int:
        """The number of what all findings of a rule say."""
        self.fixed.append({"table": self.table, **said})
        return len(self.fixed) - 1


@dataclass(frozen=True)
class Cell:
    """A column of the row in hand: its name, its value as text, the table's columns and the edges."""

    col: str
    v: Column
    columns: list[str]
    edges: Edges

    def other(self, name: str) -> Column | None:
        have = {c.lower(): c for c in self.columns}
        return F.col(have[name.lower()]).cast("string") if name.lower() in have else None

    def reference(self, rule: str, value: Column, target: Mapping, code: str = "unresolved", severity: str | None = None, condition: Column | None = None, col: str | None = None) -> None:
        """Notes a finding that stands if the value has no key in the target; none for blanks, missing targets or 'ignore'."""
        resolver, policy = target.get("resolver", "ascii-ci"), target.get("unknown", "error")
        edge = self.edges.of(target["table"], target["column"], resolver)
        if edge is None or policy not in R.POLICIES:
            return
        there = ~is_blank(value) if condition is None else ~is_blank(value) & condition
        n = self.edges.fix(col=col or self.col, rule=rule, code=code, severity=severity or R.POLICIES[policy], message_key=f"{rule}.{code}", target=f"{target['table']}.{target['column']}")
        self.edges.single.append(F.when(there, short(n, edge, R.RESOLVERS[resolver](value), value)))


Made = tuple[list[Column], list[Column]]


def _uint(cell: Cell, rule: ColumnRule) -> Made:
    bits = int(rule.params.get("bits", 8))
    return [when(C.not_uint(cell.v, bits), finding("uint", f"uint{bits}-range", "warning", cell.col, cell.v, {"stored": wrap_uint(cell.v, bits)}))], []


def _code_range(cell: Cell, rule: ColumnRule) -> Made:
    p, condition = rule.params, None
    if "when" in p:
        other = cell.other(p["when"]["column"])
        if other is None:
            return [], []
        condition = other == str(p["when"]["value"])
    fine, code, args = C.code_range(cell.v, p.get("low", 0), p.get("high", 15), p.get("fallback", 1), p.get("labels", ()))
    bad = (cell.v != "") & ~fine
    return [when(bad if condition is None else bad & condition, finding("code-range", code, "warning", cell.col, cell.v, args))], []


def _list(cell: Cell, rule: ColumnRule) -> Made:
    """A mini-list: its base must be in a target, if one is named; then the first unknown modifier."""
    from gridcheck.operators.tokens import base_of, first_unknown

    p = rule.params
    tokens = F.split(strip_outer_quotes(cell.v), ",", -1)
    filled, base, single = ~is_blank(cell.v), base_of(tokens), []
    if "base" in p:
        single.append(when(filled & (base == ""), finding("base", "empty-base", "error", cell.col, cell.v, {"base": base})))
        cell.reference("base", F.when(filled, base), p["base"], "unresolved-base")
    if any(k in p for k in ("flags", "assignments", "pairs")):
        stop = first_unknown(tokens, p.get("flags", ()), p.get("assignments", ()), p.get("pairs", ()))
        single.append(F.when(filled, let(stop, lambda at: when(at.isNotNull(), finding("modifiers", "ignored-suffix", "warning", cell.col, cell.v, {"stopped_at": F.get(tokens, at), "position": at})))))
    return single, []


def _formula(cell: Cell, rule: ColumnRule) -> Made:
    """A formula; ``lists`` names a target for each list of names that is to be checked."""
    lookups = {}
    for name, target in rule.params.get("lists", {}).items():
        resolver = target.get("resolver", "exact")
        edge = cell.edges.of(target["table"], target["column"], resolver)
        if edge is not None:
            lookups[name] = Lookup(edge, resolver)
    body, used = used_part(cell.v)
    decimals = not rule.params.get("decimals", False)
    made = let(F.struct(body.alias("body"), used.alias("used")), lambda b: let(walk(b["used"]), lambda w: formula_findings(F.lit(cell.col), b["body"], b["used"], w, lookups, decimals=decimals)))
    found = F.when(~is_blank(cell.v), made)
    if lookups:
        cell.edges.many.append(found)
    return [], [found]


#: kind -> findings of one cell, single ones and arrays.
COLUMN_RULES: dict[str, Callable[[Cell, ColumnRule], Made]] = {"uint": _uint, "code_range": _code_range, "list": _list, "formula": _formula}


def _slot_cells(s: Column, made: Callable[[Column], Column]) -> Column:
    return F.flatten(F.transform(s, lambda x: F.array_compact(made(x)))).cast(f"array<{FINDING}>")


def _first_gap(s: Column, slots: SlotContract, cell: Cell, rule: ColumnRule) -> list[Column]:
    numbered = lambda pattern, x: F.replace(F.lit(pattern), F.lit("#"), x["slot"].cast("string"))

    def of(x: Column, gap: Column) -> Column:
        after, own = x["slot"] > gap, (x["slot"] == gap) & x["item"].isNotNull()
        args = {"gap": gap}
        item = when(after & S.filled(x["item"]), finding("first-gap", "after-first-gap", "warning", numbered(slots.items, x), x["item"], args))
        weight = when((after | own) & S.filled(x["weight"]), finding("first-gap", F.when(after, "after-first-gap").otherwise("orphaned"), "warning", numbered(slots.weights or "", x), x["weight"], args))
        return F.array(item, weight)

    return [let(S.first_gap(s), lambda gap: F.when(gap.isNotNull(), _slot_cells(s, lambda x: of(x, gap))))]


def _weight(s: Column, slots: SlotContract, cell: Cell, rule: ColumnRule) -> list[Column]:
    numbered = lambda x: F.replace(F.lit(slots.weights or ""), F.lit("#"), x["slot"].cast("string"))
    of = lambda x, gap: F.array(F.when((x["slot"] < gap) & x["weight"].isNotNull(), let(S.weight_code(x["weight"]), lambda code: when(code.isNotNull(), finding("weight", code, "warning", numbered(x), x["weight"])))))
    return [let(F.coalesce(S.first_gap(s), F.lit(1 << 30)), lambda gap: _slot_cells(s, lambda x: of(x, gap)))]


def _declared_count(s: Column, slots: SlotContract, cell: Cell, rule: ColumnRule) -> list[Column]:
    declared = cell.other(rule.params["column"])
    if declared is None:
        return []
    code, n, actual = S.declared_count(s, declared)
    one = let(F.struct(code.alias("code"), n.alias("n"), actual.alias("actual")), lambda x: when(x["code"].isNotNull(), finding("declared-count", x["code"], "warning", rule.params["column"], x["n"], {"expected": F.coalesce(x["n"], F.lit("")), "actual": x["actual"]})))
    return [F.array_compact(F.array(one)).cast(f"array<{FINDING}>")]


def _slot_reference(s: Column, slots: SlotContract, cell: Cell, rule: ColumnRule) -> list[Column]:
    """Items before the first gap must be in the target."""
    target = rule.params["target"]
    resolver = target.get("resolver", "ascii-ci")
    edge = cell.edges.of(target["table"], target["column"], resolver)
    if edge is None:
        return []

    def of(x: Column, gap: Column) -> Column:
        item = strip_outer_quotes(x["item"])
        return F.array(when((x["slot"] < gap) & ~is_blank(item), finding("slot-reference", "unresolved", R.POLICIES.get(target.get("unknown", "error"), "error"), F.replace(F.lit(slots.items), F.lit("#"), x["slot"].cast("string")), item, {"target": F.lit(f"{target['table']}.{target['column']}")}, edge=edge, key=R.RESOLVERS[resolver](item))))

    found = let(F.coalesce(S.first_gap(s), F.lit(1 << 30)), lambda gap: _slot_cells(s, lambda x: of(x, gap)))
    cell.edges.many.append(found)
    return [found]


#: kind -> arrays of findings of a row's slots.
SLOT_RULES = {"first_gap": _first_gap, "weight": _weight, "declared_count": _declared_count, "reference": _slot_reference}


def column_findings(contract: ColumnContract, cell: Cell, version: str | None) -> Made:
    """All that a column's contract says about one cell, but uniqueness."""
    v, single, many = cell.v, [], []
    if not contract.exempt:
        if contract.type in TYPES:
            condition, code = C.CHECKS[contract.type]
            single.append(when(condition(v), finding("type", code, "warning", cell.col, v, message_key=code)))
        if contract.table and contract.column:
            cell.reference("reference", v, {"table": contract.table, "column": contract.column, "resolver": contract.resolver, "unknown": contract.unknown})
        elif contract.values and contract.unknown in R.POLICIES:
            key = R.RESOLVERS[contract.resolver]
            known = [key(F.lit(x)) for x in contract.values if x.strip()]
            single.append(when(~is_blank(v) & ~F.coalesce(key(v).isin(*known), F.lit(False)) if known else ~is_blank(v), finding("enum", "unresolved", R.POLICIES[contract.unknown], cell.col, v, {"target": F.lit("enum")})))
    if contract.max_chars:
        single.append(when(C.too_many_chars(v, contract.max_chars), finding("max-chars", "too-long", "warning", cell.col, v, {"over": F.length(v) - contract.max_chars, "limit": F.lit(contract.max_chars)})))
    if contract.max_bytes:
        single.append(when(C.too_many_bytes(v, contract.max_bytes), finding("max-bytes", "too-long", "warning", cell.col, v, {"bytes": F.octet_length(v), "limit": F.lit(contract.max_bytes)})))
    for rule in contract.rules:
        if rule.applies(version):
            a, b = COLUMN_RULES[rule.kind](cell, rule)
            single, many = single + a, many + b
    return single, many


def table_findings(contract: Contract, table: TableContract, df: DataFrame, edges: Edges) -> tuple[Column | None, Column | None]:
    """The array of a row's findings, of which those without keys count, and that of those with keys; None for none."""
    single, many = [], []
    edges.table, edges.single, edges.many = table.name, [], []
    for column in contract.columns_of(table.name):
        for name in physical_columns(column, df.columns):
            a, b = column_findings(column, Cell(name, F.col(name).cast("string"), df.columns, edges), contract.version)
            single, many = single + a, many + b
    for slots in table.slots:
        items = C.expand_numbered(df.columns, slots.items)
        n = max([len(items), *(len(C.expand_numbered(df.columns, slots.weights)) for _ in [0] if slots.weights)])
        have = {c.lower(): c for c in df.columns}
        cell = lambda pattern, k: F.col(have[name]).cast("string") if pattern and (name := pattern.replace("#", str(k)).lower()) in have else F.lit(None).cast("string")
        if not n:
            continue
        s = F.array(*(F.struct(F.lit(k).alias("slot"), cell(slots.items, k).alias("item"), cell(slots.weights, k).alias("weight")) for k in range(1, n + 1)))
        for rule in slots.rules:
            if rule.applies(contract.version):
                many += SLOT_RULES[rule.kind](s, slots, Cell(slots.items, F.lit(None), df.columns, edges), rule)
    arrays = ([F.array(*edges.single)] if edges.single else []) + [whole(edges.fix(), m) for m in edges.many]
    return gathered(single, many) if single or many else None, F.concat(*arrays) if arrays else None
