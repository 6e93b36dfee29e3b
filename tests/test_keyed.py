"""Findings with keys on their way to the targets: short rows, never sorted, whole again behind the join."""

import pytest

from gridcheck.plans.compile import validate
from gridcheck.plans.contract import Contract
from gridcheck.queries.slots_tokens import summary, validated

DATA = "/root/testdata/sf0.001"


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_findings_are_not_sorted_and_meet_targets_once(spark, no_broadcast):
    plan = physical(validated(spark, DATA).filter("rule <> 'unique'"))
    joins = [x for x in plan.splitlines() if "LeftAnti" in x or "LeftOuter" in x]
    assert len(joins) == 1 and "ShuffledHashJoin" in joins[0]


def test_findings_are_whole_behind_the_join(spark, no_broadcast):
    contract = Contract.of({
        "tables": {
            "t": {"key": ["id"], "line": "at", "columns": [
                {"name": "r", "type": {"type": "reference", "table": "u", "column": "k", "unknown": "warning"}}, {"name": "s", "type": {"type": "int", "table": "u", "column": "k", "resolver": "exact"}},
                {"name": "list", "rules": [{"kind": "list", "base": {"table": "u", "column": "k"}}]}, {"name": "calc", "rules": [{"kind": "formula", "lists": {"scope": {"table": "u", "column": "k"}}}]},
            ]},
            "u": {"key": ["k"], "columns": [{"name": "parent", "type": {"type": "reference", "table": "u", "column": "k"}}]},
        }
    })
    t = spark.createDataFrame([(1, 7, "Nope", "1", "Gone,eth", "lost+1"), (2, 8, "ONE", "ONE", "one", "one"), (3, 9, None, " ", "", None)], "id long, at int, r string, s string, list string, calc string")
    u = spark.createDataFrame([("one", "Two"), ("one", ""), ("1", "ONE")], "k string, parent string")
    found = validate(contract, {"t": t, "u": u})
    got = sorted((r.table, r.row_key, r.line, r.col, r.rule, r.code, r.severity, r.value, r.message_key, r.args.get("target")) for r in found.collect())
    assert got == sorted([
        ("t", "1", 7, "r", "reference", "unresolved", "warning", "Nope", "reference.unresolved", "u.k"), ("t", "2", 8, "s", "reference", "unresolved", "error", "ONE", "reference.unresolved", "u.k"),
        ("t", "2", 8, "s", "type", "diag.integer.invalid", "warning", "ONE", "diag.integer.invalid", None), ("t", "3", 9, "s", "type", "diag.integer.invalid", "warning", " ", "diag.integer.invalid", None), ("t", "1", 7, "list", "base", "unresolved-base", "error", "Gone", "base.unresolved-base", "u.k"),
        ("t", "1", 7, "calc", "formula-identifier", "unknown-identifier", "error", "lost", "formula-identifier.unknown-identifier", None), ("u", "one", None, "parent", "reference", "unresolved", "error", "Two", "reference.unresolved", "u.k"),
    ])
    assert [(r.col_start, r.col_end) for r in found.filter("col = 'calc'").collect()] == [(0, 4)]
    assert [r.args for r in found.filter("col = 'r'").collect()] == [{"target": "u.k"}]


def test_a_task_of_the_summary_sorts_no_findings(spark, no_broadcast):
    plan = physical(summary(spark, DATA))
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan
    # only what is counted is sent: the key, and the number of what its rule says
    assert all("concat_ws" not in x for x in plan.splitlines() if "Project" in x)


def test_a_task_that_reads_a_target_does_not_hold_its_keys(spark, no_broadcast):
    for found in (summary(spark, DATA), validated(spark, DATA).filter("rule <> 'unique'")):
        assert not [x for x in physical(found).splitlines() if "Aggregate" in x and "__key" in x]
