"""Contracts: what the columns of a set of tables must hold; plain data, read from JSON."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class ColumnRule:
    """One more rule of a column: its kind, parameters, and the versions in which it applies (none named: all)."""

    kind: str
    params: Mapping[str, Any] = field(default_factory=dict)
    versions: tuple[str, ...] = ()
    not_versions: tuple[str, ...] = ()

    @staticmethod
    def of(raw: Mapping[str, Any]) -> ColumnRule:
        known = ("kind", "versions", "not_versions")
        return ColumnRule(raw["kind"], {k: v for k, v in raw.items() if k not in known}, tuple(raw.get("versions", ())), tuple(raw.get("not_versions", ())))

    def applies(self, version: str | None) -> bool:
        return version not in self.not_versions and (not self.versions or version in self.versions)


@dataclass(frozen=True)
class ColumnContract:
    """What a column must hold; a name with '#' stands for all columns of a numbered family."""

    name: str
    alt_names: tuple[str, ...] = ()
    type: str = "string"
    unique: bool = False
    table: str | None = None
    column: str | None = None
    resolver: str = "ascii-ci"
    unknown: str = "error"
    values: tuple[str, ...] = ()
    max_chars: int | None = None
    max_bytes: int | None = None
    exempt: bool = False
    rules: tuple[ColumnRule, ...] = ()

    @staticmethod
    def of(raw: Mapping[str, Any]) -> ColumnContract:
        kind = raw.get("type") or {}
        kind = {"type": kind} if isinstance(kind, str) else kind
        values = tuple(str(v[0] if isinstance(v, list) else v) for v in raw.get("values", ()))
        return ColumnContract(raw["name"], tuple(raw.get("alt_names", ())), kind.get("type", "string"), bool(raw.get("unique", False)), kind.get("table"), kind.get("column"), kind.get("resolver", "ascii-ci"), kind.get("unknown", "error"), values, kind.get("max_chars"), kind.get("max_bytes"), bool(raw.get("exempt", False)), tuple(map(ColumnRule.of, raw.get("rules", ()))))


@dataclass(frozen=True)
class SlotContract:
    """Numbered families of a row, item and weight, and the rules on them (kinds in ``plans.fused.SLOT_RULES``)."""

    items: str
    weights: str | None = None
    rules: tuple[ColumnRule, ...] = ()


@dataclass(frozen=True)
class TableContract:
    name: str
    key: tuple[str, ...] = ()
    order: str | None = None
    append: tuple[str, ...] = ()
    columns: tuple[ColumnContract, ...] = ()
    slots: tuple[SlotContract, ...] = ()
    comments: str | None = None
    line: str | None = None


@dataclass(frozen=True)
class Contract:
    tables: Mapping[str, TableContract]
    version: str | None = None

    @staticmethod
    def of(raw: Mapping[str, Any]) -> Contract:
        tables = {n: TableContract(n, tuple(t.get("key", ())), t.get("order"), tuple(t.get("append", ())), tuple(ColumnContract.of(c) for c in t.get("columns", ())), tuple(SlotContract(x["items"], x.get("weights"), tuple(map(ColumnRule.of, x.get("rules", ())))) for x in t.get("slots", ())), t.get("comments"), t.get("line")) for n, t in raw["tables"].items()}
        return Contract(tables, raw.get("version"))

    @staticmethod
    def load(path: str) -> Contract:
        with open(path, encoding="utf-8") as f:
            return Contract.of(json.load(f))

    def columns_of(self, table: str) -> list[ColumnContract]:
        """A table's columns and, depth first, those of the tables it appends; of a name the first counts."""
        out: dict[str, ColumnContract] = {}
        seen: set[str] = set()

        def visit(name: str) -> None:
            if name in seen or name not in self.tables:
                return
            seen.add(name)
            for c in self.tables[name].columns:
                out.setdefault(c.name.lower(), c)
            for more in self.tables[name].append:
                visit(more)

        visit(table)
        return list(out.values())

    def references(self) -> list[tuple[str, str, str, str]]:
        """(source table, column, target table, column) of every reference."""
        return [(t, c.name, c.table, c.column) for t in self.tables for c in self.columns_of(t) if c.table and c.column]

    def metadata(self, spark: SparkSession) -> DataFrame:
        """The columns' limits as rows: table, col, type, max_chars, max_bytes."""
        rows = [(t, c.name, c.type, c.max_chars, c.max_bytes) for t in self.tables for c in self.columns_of(t)]
        return spark.createDataFrame(rows, "table string, col string, type string, max_chars int, max_bytes int")


def physical_columns(contract: ColumnContract, columns: list[str]) -> list[str]:
    """The table's columns for a contract: the one, or all of a numbered family."""
    if "#" in contract.name:
        from gridcheck.operators.columns import expand_numbered

        return expand_numbered(columns, contract.name)
    found = physical_column(contract, columns)
    return [found] if found else []


def physical_column(contract: ColumnContract, columns: list[str]) -> str | None:
    """The table's column for a contract: by name, else an alternative name, in any case."""
    have = {}
    for c in columns:
        have.setdefault(c.lower(), c)
    return next((have[n.lower()] for n in (contract.name, *contract.alt_names) if n.lower() in have), None)
