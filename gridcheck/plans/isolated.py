"""Validation in parts: each rule runs by itself into its own folder, and one that fails leaves the others alone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from gridcheck.plans.compile import RuleSet, TableSet, compile_contract
from gridcheck.plans.contract import Contract
from gridcheck.violations import SCHEMA, violations


def validate_to(path: str, contract: Contract | None, tables: Mapping[str, DataFrame], rules: RuleSet | None = None) -> tuple[DataFrame, DataFrame]:
    """All violations as stored below ``path``, and a summary: ``rule``, ``rows``, ``error`` (null if it ran).

    A part is the contract's own plans, or one custom rule.  A rule that fails,
    while planned or in its tasks, gives one ``rule-error`` row instead of its
    findings: what it had written is overwritten.  Rows are counted while they are
    written.
    """
    group = TableSet(tables, contract)
    spark = next(iter(tables.values())).sparkSession
    makers = []
    if contract is not None:
        makers.append(("contract", lambda: compile_contract(contract, group)))
    for rule in rules.rules if rules else []:
        if rule.applies(group, contract.version if contract else None):
            makers.append((rule.name, lambda rule=rule: [rule.checked(group, contract)]))
    summary, paths = [], []
    for number, (name, make) in enumerate(makers):
        at = f"{path}/part={number:05d}"
        count, error = 0, None
        try:
            for i, found in enumerate(make()):
                seen = Observation()
                found.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{at}/{i:05d}")
                paths.append(f"{at}/{i:05d}")
                count += seen.get["rows"]
        except Exception as e:  # a rule is foreign code: whatever it raises is reported once
            error, count = f"{type(e).__name__}: {e}"[:500], 1
            paths = [p for p in paths if not p.startswith(at)]
            row = spark.createDataFrame([(name, error)], "row_key string, value string")
            violations(row, "rules", name, "rule-error", "error").write.mode("overwrite").parquet(f"{at}/error")
            paths.append(f"{at}/error")
        summary.append((name, count, error))
    found = spark.read.schema(SCHEMA).parquet(*paths) if paths else spark.createDataFrame([], SCHEMA)
    return found, spark.createDataFrame(summary, "rule string, rows long, error string")
