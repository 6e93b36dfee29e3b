"""From a contract and tables to one plan of violations.

All rules of a table are one expression over its rows; references of all tables
share one anti join.  A reference whose target table or column is missing is left
out: nothing can be proved invalid then.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcheck.functions.scalar import is_blank
from gridcheck.operators import columns as C
from gridcheck.operators import refs as R
from gridcheck.operators.findings import Target, as_violations, exploded, keyed, unresolved
from gridcheck.operators.unique import check_unique
from gridcheck.plans.contract import Contract, physical_columns
from gridcheck.plans.fused import Edges, table_findings
from gridcheck.violations import SCHEMA, merge_violations, row_key, violations

class TableSet:
    """Tables by stem, with the look-ups that custom rules use.

    With ``scope``, rows of a table that has that column belong to independent
    sets of tables (a folder each); ``shared`` are the tables of lower tiers, for
    scopes without rows of a table of their own.
    """

    def __init__(self, tables: Mapping[str, DataFrame], contract: Contract | None = None, sources: Mapping[str, str] | None = None, scope: str | None = None, shared: Mapping[str, DataFrame] | None = None) -> None:
        self.tables = {k.lower(): v for k, v in tables.items()}
        self.scope, self.shared = scope, {k.lower(): v for k, v in (shared or {}).items()}
        self.contract, self.sources = contract, {k.lower(): v for k, v in (sources or {}).items()}
        self._keys: dict[tuple[str, str, str], DataFrame] = {}

    def has_table(self, name: str) -> bool:
        return name.lower() in self.tables

    def has_target(self, name: str, col: str) -> bool:
        return any(name.lower() in tier and col.lower() in (c.lower() for c in tier[name.lower()].columns) for tier in (self.tables, self.shared))

    def scope_of(self, name: str) -> Column | None:
        """The scope of the table's rows; None if they have none."""
        df = self.tables.get(name.lower())
        return F.col(self.scope) if df is not None and self.scope and self.scope in df.columns else None

    def table(self, name: str) -> DataFrame:
        return self.tables[name.lower()]

    def keys(self, name: str, col: str, resolver: str = "ascii-ci") -> DataFrame | None:
        """Distinct keys of a target, the same plan for all rules that ask; None without it."""
        if not self.has_target(name, col):
            return None
        at = (name.lower(), col.lower(), resolver)
        if at not in self._keys:
            self._keys[at] = R.keys_of(self.tables.get(name.lower(), self.shared.get(name.lower())), col, resolver)
        return self._keys[at]

    def target(self, name: str, col: str, resolver: str) -> DataFrame | Target:
        """The keys of a target for every scope."""
        name = name.lower()
        own, shared, scope = self.tables.get(name), self.shared.get(name), self.scope_of(name)
        has = lambda df: df is not None and col.lower() in (c.lower() for c in df.columns)
        if scope is None or not has(own):
            return R.keys_of(own if own is not None else shared, col, resolver, distinct=False)
        value, where = F.col(col).cast("string"), F.coalesce(scope.cast("string"), F.lit("")).alias("scope")
        keys = own.filter(~is_blank(value)).select(where, R.RESOLVERS[resolver](value).alias("key"))
        return Target(keys, own.select(where).distinct(), R.keys_of(shared, col, resolver, distinct=False) if has(shared) else None)

    def values(self, name: str, col: str) -> DataFrame | None:
        return C.column_values(self.table(name), col) if self.has_target(name, col) else None

    def filtered_values(self, name: str, a: str, b: str, v: str) -> DataFrame | None:
        return C.filtered_column_values(self.table(name), a, b, v) if self.has_target(name, a) and self.has_target(name, b) else None

    def first_lines(self, name: str, col: str, line: str) -> DataFrame | None:
        return R.first_occurrence(self.table(name), col, line) if self.has_target(name, col) else None

    def enum(self, table: str, col: str) -> list[str]:
        if self.contract is None or table not in self.contract.tables:
            return []
        return next((list(c.values) for c in self.contract.columns_of(table) if c.name.lower() == col.lower()), [])

    def source_of(self, name: str) -> str | None:
        return self.sources.get(name.lower())


def compile_contract(contract: Contract, tables: TableSet) -> list[DataFrame]:
    """The violations plans: one of all columns, slots and references of all tables, one of unique columns per table.

    Nothing is run.  Each table is scanned once for its findings without keys, and
    once more, for its reference columns alone, if it has references; see ``plans.fused``.
    """
    edges = Edges(tables.has_target)
    found, asked, unique = [], [], []
    for name, table in contract.tables.items():
        if not tables.has_table(name):
            continue
        df = tables.table(name)
        scope = tables.scope_of(name)
        key = row_key(*([tables.scope] if scope is not None else []), *table.key) if table.key else F.lit(None).cast("string")
        rows = C.drop_comment_rows(df, table.comments) if table.comments else df
        findings, with_keys = table_findings(contract, table, rows, edges)
        line = F.col(table.line) if table.line else None
        if findings is not None:
            found.append(as_violations(exploded(rows, name, key, findings, line, scope).filter("edge IS NULL")))
        if with_keys is not None:
            asked.append(keyed(rows, key, with_keys, line, scope))
        columns = [p for c in contract.columns_of(name) if c.unique for p in physical_columns(c, df.columns)]
        if columns and table.order:
            unique.append(check_unique(rows, name, columns, table.order, key, scope=scope))
    if asked:
        found.append(unresolved(asked, edges.fixed, {n: tables.target(*at) for at, n in edges.numbers.items()}))
    return ([merge_violations(found)] if found else []) + unique


@dataclass(frozen=True)
class Rule:
    name: str
    run: Callable[[TableSet, Contract | None], DataFrame]
    tables: tuple[str, ...] = ()
    versions: tuple[str, ...] = ()
    not_versions: tuple[str, ...] = ()

    def applies(self, tables: TableSet, version: str | None) -> bool:
        if self.versions and version not in self.versions or version in self.not_versions:
            return False
        return not self.tables or any(tables.has_table(t) for t in self.tables)

    def checked(self, tables: TableSet, contract: Contract | None) -> DataFrame:
        """The rule's violations; another schema is an error."""
        found = self.run(tables, contract)
        if {f.name: f.dataType for f in found.schema} != {f.name: f.dataType for f in SCHEMA}:
            raise TypeError(f"not a violations table: {found.schema.simpleString()}")
        return found.select(*SCHEMA.names)


class RuleSet:
    """Custom rules and enrichers in the order they were added."""

    def __init__(self) -> None:
        self.rules: list[Rule] = []
        self.enrichers: list[Callable[[TableSet], DataFrame]] = []

    def rule(self, name: str | None = None, tables: Sequence[str] = (), versions: Sequence[str] = (), not_versions: Sequence[str] = ()):
        """Registers ``fn(tables, contract) -> violations``, for some tables or for all."""

        def add(fn):
            self.rules.append(Rule(name or fn.__name__, fn, tuple(tables), tuple(versions), tuple(not_versions)))
            return fn

        return add

    def enricher(self, fn):
        """Registers ``fn(tables) -> key and columns``; of several, the first non-null wins."""
        self.enrichers.append(fn)
        return fn

    def run(self, tables: TableSet, contract: Contract | None = None) -> list[DataFrame]:
        """The rules' plans; one that fails or returns another schema becomes one ``rule-error`` row."""
        out = []
        for rule in self.rules:
            if not rule.applies(tables, contract.version if contract else None):
                continue
            try:
                out.append(rule.checked(tables, contract))
            except Exception as e:  # a rule is foreign code: whatever it raises is reported once
                spark = next(iter(tables.tables.values())).sparkSession
                out.append(violations(spark.createDataFrame([(rule.name, str(e)[:500])], "row_key string, value string"), "rules", rule.name, "rule-error", "error"))
        return out

    def enrich(self, df: DataFrame, key: str, column: str, tables: TableSet, order_col: str | None = None) -> DataFrame:
        """``df`` with ``column``: the first enricher's value for the key that is not null.

        Of several rows of an enricher with the same key, the first that is not
        null counts, by ``order_col`` if it has that column.
        """
        names = []
        for i, fn in enumerate(self.enrichers):
            found = fn(tables)
            if column not in found.columns:
                continue
            names.append(f"__{column}_{i}")
            order = F.col(order_col) if order_col and order_col in found.columns else F.monotonically_increasing_id()
            first = found.filter(F.col(column).isNotNull()).select(F.col(key).alias("__k"), F.col(column).alias(names[-1]), order.alias("__o")).groupBy("__k").agg(F.min_by(names[-1], "__o").alias(names[-1]))
            df = df.join(first, F.col(key) == F.col("__k"), "left").drop("__k")
        return df.withColumn(column, F.coalesce(*names) if names else F.lit(None).cast("string")).drop(*names)


def validate(contract: Contract, tables: Mapping[str, DataFrame], rules: RuleSet | None = None, scope: str | None = None, shared: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """All violations of a set of tables: of the contract and of custom rules.

    With ``scope`` (a column) the rows of each scope are a set of tables of their
    own; their row keys begin with it.  ``shared`` tables serve scopes that lack one.
    """
    group = TableSet(tables, contract, scope=scope, shared=shared)
    parts = compile_contract(contract, group) + (rules.run(group, contract) if rules else [])
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], SCHEMA)
    return merge_violations(parts)
