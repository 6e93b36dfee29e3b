"""Findings of many rules in one pass: an array per row, exploded once, and references resolved by one anti join.

A finding is what one rule says about one cell.  One that only stands if a key is
missing in a target carries the number of its target (``edge``) and the key.
All of these, tagged by edge, meet all targets' keys in one anti join, as short
rows: what is the same for all findings of a rule is put back behind the join.
Findings without a key never leave their task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcheck.violations import SCHEMA

FINDING = "struct<col:string,col_start:int,col_end:int,rule:string,code:string,severity:string,value:string,message_key:string,args:map<string,string>,edge:int,key:string>"
#: A finding with a key on its way to the targets: what its rule says stands in a list, at ``n``; ``value`` is null if it is the key; ``f`` is the finding itself where no list can say it.
KEYED = f"struct<n:int,edge:int,key:string,value:string,f:{FINDING}>"
#: Findings without a key are spread over so many values while others are joined.
SPREAD = 4096


def _lit(x: Column | str | int | None) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def finding(rule: str | Column, code: str | Column, severity: str | Column, col: str | Column, value: Column, args: Mapping[str, Column] | None = None, start: Column | None = None, end: Column | None = None, message_key: Column | str | None = None, edge: int | Column | None = None, key: Column | None = None, arguments: Column | None = None) -> Column:
    pairs = [x for k, v in (args or {}).items() for x in (F.lit(k), v.cast("string"))]
    named = message_key if message_key is not None else F.concat(_lit(rule), F.lit("."), _lit(code))
    fields = {"col": _lit(col), "col_start": _lit(start), "col_end": _lit(end if end is not None else start), "rule": _lit(rule), "code": _lit(code), "severity": _lit(severity), "value": value, "message_key": _lit(named), "args": arguments if arguments is not None else F.create_map(*pairs) if pairs else F.create_map(), "edge": _lit(edge), "key": _lit(key)}
    return F.struct(*(v.alias(k) for k, v in fields.items())).cast(FINDING)


def when(condition: Column, found: Column) -> Column:
    """The finding where the condition holds (null counts as no), else null."""
    return F.when(condition, found)


def gathered(single: Sequence[Column], many: Sequence[Column] = ()) -> Column:
    """One array of the findings, of single ones and of arrays; those that are not there are null.

    Nulls go after the array is exploded: to take them out of it would leave
    generated code.
    """
    parts = ([F.array(*single)] if single else []) + [F.coalesce(m, F.array().cast(f"array<{FINDING}>")) for m in many]
    return F.concat(*parts) if len(parts) > 1 else parts[0] if parts else F.array().cast(f"array<{FINDING}>")


def exploded(df: DataFrame, table: str, row_key: Column, found: Column, line: Column | None = None, scope: Column | None = None) -> DataFrame:
    """A row per finding, with its table, row and scope (empty without scopes)."""
    line = line if line is not None else F.lit(None)
    return df.select(F.lit(table).alias("table"), row_key.cast("string").alias("row_key"), line.cast("int").alias("line"), _scope(scope), F.explode(found).alias("f")).filter("f IS NOT NULL").select("table", "row_key", "line", "scope", "f.*")


def _scope(scope: Column | None) -> Column:
    return F.coalesce(scope.cast("string") if scope is not None else F.lit(None), F.lit("")).alias("scope")


def short(n: int, edge: int, key: Column, value: Column) -> Column:
    """A finding with a key as what differs from row to row."""
    return F.struct(F.lit(n).alias("n"), F.lit(edge).alias("edge"), key.alias("key"), F.when(~value.eqNullSafe(key), value).alias("value"), F.lit(None).cast(FINDING).alias("f")).cast(KEYED)


def whole(n: int, found: Column) -> Column:
    """Those of an array of findings that have a key, whole; ``n`` is where their table stands."""
    made = lambda f: F.struct(F.lit(n).alias("n"), f["edge"].alias("edge"), f["key"].alias("key"), F.lit(None).cast("string").alias("value"), f.alias("f"))
    return F.transform(F.filter(F.coalesce(found, F.array().cast(f"array<{FINDING}>")), lambda f: f["edge"].isNotNull()), made).cast(f"array<{KEYED}>")


def keyed(df: DataFrame, row_key: Column, found: Column, line: Column | None = None, scope: Column | None = None) -> DataFrame:
    """Rows with the array of their findings with keys; exploded in ``unresolved``."""
    line = line if line is not None else F.lit(None)
    return df.select(row_key.cast("string").alias("row_key"), line.cast("int").alias("line"), _scope(scope), found.alias("found"))


def as_violations(found: DataFrame) -> DataFrame:
    end = F.greatest(F.coalesce("col_end", "col_start"), F.col("col_start"))
    columns = {f.name: F.col(f.name) for f in SCHEMA} | {"col_end": end, "severity": F.coalesce("severity", F.lit("warning"))}
    return found.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in SCHEMA))


@dataclass(frozen=True)
class Target:
    """The normalised keys of one edge: ``key``, and ``scope`` if its rows belong to scopes; ``shared`` is for scopes without rows of their own.

    ``scopes`` lists the scopes that have the target (column ``scope``).
    """

    keys: DataFrame
    scopes: DataFrame | None = None
    shared: DataFrame | None = None

    def rows(self, edge: int) -> list[DataFrame]:
        tiers = [(self.keys, F.col("scope") if self.scopes is not None else F.lit(""))] + ([(self.shared, F.lit(""))] if self.shared is not None else [])
        return [df.select(F.lit(edge).alias("at"), scope.alias("tier"), F.col("key").alias("__key")) for df, scope in tiers]


def unresolved(found: Sequence[DataFrame], fixed: Sequence[Mapping[str, str | None]], targets: Mapping[int, DataFrame | Target]) -> DataFrame:
    """The violations: findings (of ``keyed``) whose key no target of their edge has.

    ``targets``: for each edge a table with the column ``key``, already
    normalised (repeats in it do no harm), or a ``Target`` with scopes.  Within a
    scope its own rows of the target count if it has any; else the shared ones; if
    there are none either, nothing can be proved invalid.  ``fixed`` is what the
    findings' ``n`` stands for: table, col, rule, code, severity and target.

    The targets' keys are hashed in each part and the findings stream past them,
    so no finding is sorted and no memory grows with the findings; a key that a
    third of all rows have makes a long task, not a large one.  That table holds
    a repeated key once, so targets are sent as they are: made distinct first,
    all keys that a task reads would be in its memory.  The list of scopes is
    broadcast: they are folders, not rows.
    """
    of = {e: t if isinstance(t, Target) else Target(t) for e, t in targets.items()}
    there = reduce(DataFrame.unionByName, [df for e, t in of.items() for df in t.rows(e)])
    # exploded behind the union: an anti join would be moved in front of it, with the targets once for each table
    placed = reduce(DataFrame.unionByName, found).select("row_key", "line", "scope", F.explode("found").alias("k")).filter("k.key IS NOT NULL")
    placed = placed.select("row_key", "line", "scope", F.col("k.edge").alias("at"), F.col("k.key").alias("__key"), "k.n", "k.value", "k.f")
    by = ["at", "__key"]
    scoped = {e: t for e, t in of.items() if t.scopes is not None}
    if scoped:
        own = reduce(DataFrame.unionByName, [t.scopes.select(F.lit(e).alias("at"), "scope") for e, t in scoped.items()]).distinct().withColumn("__own", F.lit(True))
        closed = [e for e, t in scoped.items() if t.shared is None]
        placed = placed.join(F.broadcast(own), ["at", "scope"], "left").withColumn("tier", F.when(F.col("__own"), F.col("scope")).otherwise(F.lit("")))
        placed = placed.filter(F.col("__own") | ~F.col("at").isin(*closed)) if closed else placed
        by = ["at", "tier", "__key"]
    missing = placed.join(there.select(*by).hint("shuffle_hash"), by, "left_anti")
    said = F.get(F.array(*(_said(x) for x in fixed)), F.col("n"))
    own_words = {"col_start": F.lit(None), "col_end": F.lit(None), "value": F.coalesce("value", "__key")}
    names = [f.name for f in SCHEMA if f.name not in ("table", "row_key", "line")]
    return as_violations(missing.select(said["table"].alias("table"), "row_key", "line", *(F.when(F.col("f").isNotNull(), F.col(f"f.{c}")).otherwise(own_words[c] if c in own_words else said[c]).alias(c) for c in names)))


def _said(x: Mapping[str, str | None]) -> Column:
    """What all findings of a rule on a column say."""
    fields = {c: F.lit(x.get(c)).cast("string") for c in ("table", "col", "rule", "code", "severity", "message_key")}
    args = F.create_map(F.lit("target"), F.lit(x["target"])) if x.get("target") else F.create_map()
    return F.struct(*(v.alias(c) for c, v in fields.items()), args.cast("map<string,string>").alias("args"))


def resolved(found: DataFrame, targets: Mapping[int, DataFrame]) -> DataFrame:
    """The violations: findings (of ``exploded``) without a key, and those whose key no target of their edge has.

    The findings meet the targets whole, in one pass: for those that cost more to
    make twice than to send.
    """
    if not targets:
        return as_violations(found.filter("edge IS NULL"))
    there = reduce(DataFrame.unionByName, [df for e, t in targets.items() for df in Target(t).rows(e)])
    # findings without a key must not meet in one place when the join is by hash
    at = F.coalesce("edge", -1 - F.pmod(F.xxhash64("row_key", "col", "rule"), F.lit(SPREAD)).cast("int"))
    placed = found.withColumns({"at": at, "__key": F.coalesce("key", F.lit(""))})
    return as_violations(placed.join(there.select("at", "__key").distinct(), ["at", "__key"], "left_anti"))
