"""Differences of two runs of violations: one aggregation; what is worked out is stored once."""

import os

from pyspark.sql import functions as F

from gridcheck.plans.contract import Contract
from gridcheck.streaming.revalidate import Revalidation
from gridcheck.violations import diff_violations, row_key, violations


def test_repeats_and_nulls_are_counted_without_a_join(spark):
    of = lambda *ids: violations(spark.createDataFrame([(i,) for i in ids], "id long"), "t", "r", "c", row_key=F.when(F.col("id") > 0, row_key("id")))
    found = diff_violations(of(1, 1, 1, 2, 0), of(1, 1, 3, 3, 0, 0))
    got = sorted((r.row_key or "", r.status, r.n) for r in found.collect())
    assert got == [("", "new", 1), ("", "unchanged", 1), ("1", "resolved", 1), ("1", "unchanged", 2), ("2", "resolved", 1), ("3", "new", 2)]
    assert [f.dataType.simpleString() for f in found.schema if f.name == "n"] == ["bigint"]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_violations_are_stored_once(spark, tmp_path):
    t = spark.createDataFrame([(1, "x"), (2, "2")], "id long, n string")
    t.write.parquet(str(tmp_path / "t"))
    contract = Contract.of({"tables": {"t": {"key": ["id"], "columns": [{"name": "n", "type": "int"}]}}})
    live = Revalidation(spark, {"t": str(tmp_path / "t")}, {"t": t.schema}, contract, str(tmp_path / "store"))
    assert live.revalidate(["t"], 0) is True
    assert [(r.row_key, r.status) for r in live.differences().collect()] == [("1", "new")] and not os.path.exists(tmp_path / "store/aside")


def test_blanks_are_the_same_with_and_without_a_look_at_the_first_character(spark):
    from gridcheck.functions.scalar import SPACE, is_blank

    texts = [None, "", *(a + b for a in [chr(i) for i in range(256)] + [" ", " ", "​", "　", "\U0001f600"] for b in ("", " ", "x", "　"))]
    rows = spark.createDataFrame([(x,) for x in texts], "v string")
    old = F.col("v").isNull() | ~F.col("v").rlike(f"[^{SPACE}]")
    assert rows.filter(~is_blank(F.col("v")).eqNullSafe(old)).count() == 0
    assert spark.range(2).filter(is_blank(F.col("id"))).count() == 0
