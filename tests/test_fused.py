"""Contracts compiled to one pass: cases by hand against the single checks, and the shape of the plan."""

import re

from pyspark.sql import functions as F

from gridcheck.operators import columns as C
from gridcheck.operators import slot_rules as L
from gridcheck.plans.compile import TableSet, compile_contract, validate
from gridcheck.plans.contract import Contract
from gridcheck.violations import row_key

DATA = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def nodes(df, pattern):
    return len(re.findall(pattern, plan_of(df)))


CONTRACT = {
    "version": "3.3",
    "tables": {
        "items": {
            "key": ["id"], "order": "id", "comments": "name",
            "columns": [
                {"name": "n", "type": "int", "rules": [{"kind": "uint", "bits": 8, "not_versions": ["1.0"]}]},
                {"name": "flag", "type": "stored_boolean"}, {"name": "odd", "type": {"type": "int", "table": "kinds", "column": "k"}, "exempt": True, "unique": True},
                {"name": "code", "rules": [{"kind": "code_range", "labels": ["none"], "when": {"column": "flag", "value": "6"}, "versions": ["3.2", "3.3"]}, {"kind": "code_range", "versions": ["1.0"]}]},
                {"name": "kind", "type": {"type": "reference", "table": "kinds", "column": "k"}}, {"name": "short", "type": {"type": "reference", "table": "kinds", "column": "k", "resolver": "fixed4", "unknown": "warning"}},
                {"name": "calc#", "rules": [{"kind": "formula", "lists": {"scope": {"table": "words", "column": "w"}, "skills": {"table": "gone", "column": "x"}}}]},
                {"name": "list", "rules": [{"kind": "list", "flags": ["eth"], "base": {"table": "kinds", "column": "k"}}]}, {"name": "name", "type": {"type": "string", "max_chars": 3}, "values": ["A", "b"]},
            ],
            "slots": [{"items": "Item#", "weights": "Prob#", "rules": [{"kind": "first_gap"}, {"kind": "weight"}, {"kind": "declared_count", "column": "n"}, {"kind": "reference", "target": {"table": "kinds", "column": "k"}}]}],
        },
        "kinds": {"key": ["k"], "columns": [{"name": "parent", "type": {"type": "reference", "table": "kinds", "column": "k"}}]},
    },
}
COLUMNS = "id long, name string, n string, flag string, odd string, code string, kind string, short string, calc1 string, calc2 string, list string, Item1 string, Prob1 string, Item2 string, Prob2 string, Item3 string, Prob3 string"


def tables(spark):
    rows = [
        (1, "A", "300", "7", "x", "99", "ARMOR", "armour", "lvl+1", "min(1", "armor,eth", "armor", "1", "", "5", "swrd", "1"),
        (2, "long", "2", "6", "x", "16", "nope", "swrd", "foo", "1.5", "none,eth,bad", "armor", "0", "zzz", "x", "", None),
        (3, "* note", "bad", "bad", "bad", "bad", "bad", "bad", "bad(", "", "", "bad", "", "", "", "", ""),
        (4, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None, None),
        (5, "b", " ", "", "", "-1", " ", "", " ", "", " ", '""', "", "", "", "", ""),
    ]
    items = spark.createDataFrame(rows, COLUMNS)
    return {"Items": items, "kinds": spark.createDataFrame([("armor", ""), ("swrd", "Armor"), ("armo", "none")], "k string, parent string"), "words": spark.createDataFrame([("lvl",)], "w string")}


def test_findings_of_a_contract(spark):
    found = validate(Contract.of(CONTRACT), tables(spark))
    got = sorted((r.table, r.row_key, r.col, r.rule, r.code) for r in found.collect())
    assert got == sorted([
        ("items", "1", "n", "uint", "uint8-range"), ("items", "1", "calc2", "formula-balance", "missing-close"), ("items", "1", "calc2", "formula-arity", "arity"), ("items", "1", "Prob2", "first-gap", "orphaned"), ("items", "1", "Item3", "first-gap", "after-first-gap"), ("items", "1", "Prob3", "first-gap", "after-first-gap"),
        ("items", "1", "n", "declared-count", "count-mismatch"), ("items", "2", "name", "enum", "unresolved"), ("items", "2", "name", "max-chars", "too-long"), ("items", "2", "code", "code-range", "falls-back"), ("items", "2", "kind", "reference", "unresolved"), ("items", "2", "calc1", "formula-identifier", "unknown-identifier"),
        ("items", "2", "calc2", "formula-policy", "decimal"), ("items", "2", "list", "base", "unresolved-base"), ("items", "2", "list", "modifiers", "ignored-suffix"), ("items", "2", "Prob1", "weight", "nonpositive-omission"), ("items", "2", "Prob2", "weight", "noncanonical"), ("items", "2", "Item2", "slot-reference", "unresolved"),
        ("items", "2", "odd", "unique", "duplicate"), ("items", "5", "n", "type", "diag.integer.invalid"), ("items", "4", "n", "declared-count", "no-inputs"), ("items", "5", "n", "declared-count", "no-inputs"), ("kinds", "armo", "parent", "reference", "unresolved"),
        ("items", "5", "Item1", "", ""),
    ][:-1])
    assert [(r.args["effective"], r.args["label"]) for r in found.filter("rule = 'code-range'").collect()] == [("1", None)]


def test_no_target_no_findings(spark):
    some = {k: v for k, v in tables(spark).items() if k != "kinds"}
    assert not validate(Contract.of(CONTRACT), some).filter("rule IN ('reference', 'slot-reference') OR code = 'unresolved-base'").count()


def test_same_as_the_single_checks(spark):
    items = C.drop_comment_rows(tables(spark)["Items"], "name")
    arrays = L.slot_array(items, row_key("id"), ["Item1", "Item2", "Item3"], ["Prob1", "Prob2", "Prob3"], keep=["n"])
    found = validate(Contract.of(CONTRACT), tables(spark))
    for rule, single in (("first-gap", L.check_first_gap(arrays, "items")), ("weight", L.check_weight(arrays, "items")), ("declared-count", L.check_declared_count(arrays, "items", "n")), ("uint", C.check_uint(C.melt(items, row_key("id"), ["n"]), "items", ["n"], 8))):
        rows = lambda df: sorted((r.row_key, r.code, r.value, tuple(sorted(r.args.items()))) for r in df.collect())
        assert rows(found.filter(F.col("rule") == rule)) == rows(single), rule


def test_one_anti_join_and_one_scan(spark):
    """Four references of two tables: one anti join; each table's rows once for findings, its references' columns once more."""
    raw = {
        "tables": {
            "lineitem": {"key": ["l_orderkey", "l_linenumber"], "columns": [{"name": "l_quantity", "type": "float"}, {"name": "l_comment", "max_chars": 40}, {"name": "l_partkey", "type": {"type": "int", "table": "part", "column": "p_partkey"}}, {"name": "l_suppkey", "type": {"type": "int", "table": "supplier", "column": "s_suppkey"}}, {"name": "l_orderkey", "type": {"type": "int", "table": "orders", "column": "o_orderkey"}}]},
            "orders": {"key": ["o_orderkey"], "columns": [{"name": "o_custkey", "type": {"type": "int", "table": "customer", "column": "c_custkey"}}, {"name": "o_clerk", "max_chars": 5}]},
        }
    }
    have = {n: spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("lineitem", "orders", "part", "supplier", "customer")}
    # small targets are broadcast, and Spark moves the anti join in front of each table's keys; large ones are one join
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        (found,) = compile_contract(Contract.of(raw), TableSet(have))
        plan = plan_of(found)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"Join LeftAnti", plan)) == 1
    scans = re.findall(r"Relation \[([^\]]*)\]", plan)
    assert sum("l_partkey" in x for x in scans) == 2 and sum("o_custkey" in x for x in scans) == 3  # as target, for findings, for keys
    physical = found._jdf.queryExecution().executedPlan().toString()
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", physical) or re.findall(r"FileScan parquet \[([^\]]*)\]", physical)
    assert any("l_partkey" in x and "l_comment" not in x and "l_quantity" not in x for x in reads), reads
