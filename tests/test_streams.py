"""State on streams, live revalidation over several runs, and rules that fail while they run."""

import os

import pytest
from pyspark.sql import functions as F

from gridcheck.plans.compile import RuleSet, TableSet
from gridcheck.plans.contract import Contract
from gridcheck.plans.isolated import validate_to
from gridcheck.streaming.revalidate import Revalidation
from gridcheck.streaming.unique import STATE_STORE, stream_check_unique
from gridcheck.violations import row_key, violations


@pytest.fixture()
def state_store(spark):
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_unique_keeps_state_between_batches_and_forgets_by_watermark(spark, tmp_path, state_store):
    schema = "id long, v string, ts timestamp"
    source = str(tmp_path / "in")
    os.mkdir(source)

    def run():
        found = stream_check_unique(spark.readStream.schema(schema).parquet(source), "t", "v", row_key("id"), "ts", "1 hour")
        found.select("row_key", "args.first").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        return sorted(map(tuple, spark.read.schema("row_key string, first string").parquet(str(tmp_path / "out")).collect()))

    def arrive(*rows):
        spark.createDataFrame([(i, v, f"2024-01-01 {t}") for i, v, t in rows], "id long, v string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(source)

    # a value with most of the rows; the earliest of a batch is the first, then the smallest key
    arrive(*[(100 + i, "Hot", "10:30:00") for i in range(3000)], (5, "hot", "10:00:00"), (4, "hot", "10:00:00"), (1, "a", "10:00:00"), (2, " ", "10:00:00"), (3, None, "10:00:00"))
    got = run()
    assert len(got) == 3001 and {f for _, f in got} == {"4"} and ("4", "4") not in got
    arrive((6, "A", "10:20:00"), (7, "b", "10:20:00"))
    got = run()
    assert ("6", "1") in got and len(got) == 3002
    arrive((8, "c", "20:00:00"))  # the watermark passes all that came before
    run()
    arrive((9, "a", "20:10:00"), (10, "c", "20:20:00"))
    got = run()
    assert ("10", "8") in got and not any(k == "9" for k, _ in got) and len(got) == 3003


CONTRACT = {
    "tables": {
        "child": {"key": ["id"], "order": "line", "columns": [{"name": "ref", "type": {"type": "reference", "table": "parent", "column": "k"}}, {"name": "n", "type": "int"}, {"name": "id", "unique": True}]},
        "other": {"key": ["id"], "columns": [{"name": "n", "type": "int"}]},
        "parent": {"key": ["k"], "columns": [{"name": "k", "type": "string"}]},
    }
}


def test_live_revalidation_publishes_exactly_what_changed(spark, tmp_path):
    frames = {
        "child": spark.createDataFrame([(1, 1, "a", "1"), (2, 2, "b", "x"), (3, 3, "c", "3"), (4, 3, "a", "4")], "line long, id long, ref string, n string"),
        "other": spark.createDataFrame([(1, "bad")], "id long, n string"),
        "parent": spark.createDataFrame([("a",)], "k string"),
    }
    paths = {n: str(tmp_path / n) for n in frames}
    for n, df in frames.items():
        df.write.parquet(paths[n])
    live = lambda: Revalidation(spark, paths, {n: df.schema for n, df in frames.items()}, Contract.of(CONTRACT), str(tmp_path / "store"))
    said = lambda found, *cols: sorted(tuple(r[c] for c in cols) for r in found.collect())

    live().start().awaitTermination()
    assert said(live().differences(), "batch", "table", "row_key", "rule", "status") == [(0, "child", "2", "reference", "new"), (0, "child", "2", "type", "new"), (0, "child", "3", "reference", "new"), (0, "child", "3", "unique", "new"), (0, "other", "1", "type", "new")]

    # a target grows: only the tables that refer to it are worked out, and exactly one violation goes
    spark.createDataFrame([("B",)], "k string").write.mode("append").parquet(paths["parent"])
    live().start().awaitTermination()  # a restart, from the checkpoint
    assert said(live().differences().filter("batch = 1"), "table", "row_key", "rule", "status") == [("child", "2", "reference", "resolved")]
    assert live().versions() == {"child": 1, "other": 0, "parent": 1}
    assert said(live().stored(), "table", "row_key", "rule") == [("child", "2", "type"), ("child", "3", "reference"), ("child", "3", "unique"), ("other", "1", "type")]

    # a batch that is run again: nothing is written twice; one that had not finished is done anew
    before = said(live().differences(), "batch", "row_key", "status")
    assert live().revalidate(["parent"], 1) is False and said(live().differences(), "batch", "row_key", "status") == before
    os.remove(tmp_path / "store/manifests/000000000001/_SUCCESS")
    assert live().versions() == {"child": 0, "other": 0, "parent": 0}
    assert live().revalidate(["parent"], 1) is True and said(live().differences(), "batch", "row_key", "status") == before

    # nothing new: no batch
    live().start().awaitTermination()
    assert said(live().differences(), "batch", "row_key", "status") == before

    # a file that can't be read: what was known stays, one syntax finding comes
    (tmp_path / "child/broken.parquet").write_bytes(b"not parquet")
    assert live().revalidate(["child"], 2) is True
    assert said(live().differences().filter("batch = 2"), "table", "rule", "status") == [("child", "syntax", "new")]
    assert said(live().stored(["child"]), "row_key", "rule") == [("2", "type"), ("3", "reference"), ("3", "unique"), ("child", "syntax")]
    os.remove(tmp_path / "child/broken.parquet")
    assert live().revalidate(["child"], 3) is True
    assert said(live().differences().filter("batch = 3"), "table", "rule", "status") == [("child", "syntax", "resolved")]


def test_a_rule_that_fails_in_its_tasks_leaves_the_rest(spark, tmp_path):
    rules = RuleSet()
    made = lambda df, name: violations(df, "t", name, "c", row_key=row_key("id"))

    @rules.rule("first")
    def first(t, c):
        return made(t.table("t"), "first")

    @rules.rule("broken")
    def broken(t, c):
        return made(t.table("t").filter(F.when(F.col("id") == 3, F.raise_error(F.lit("boom")).cast("boolean")).otherwise(True)), "broken")

    @rules.rule("python")
    def python(t, c):
        return made(t.table("t").filter(F.udf(lambda x: 1 // (x - 2) > 5, "boolean")("id")), "python")

    @rules.rule("wrong")
    def wrong(t, c):
        return t.table("t")

    @rules.rule("last")
    def last(t, c):
        return made(t.table("t").filter("id > 2"), "last")

    df = spark.createDataFrame([(i,) for i in range(1, 5)], "id long").repartition(2)
    found, summary = validate_to(str(tmp_path / "out"), None, {"t": df}, rules)
    counts = {r.rule: r["count"] for r in found.groupBy("rule").count().collect()}
    assert counts == {"first": 4, "broken": 1, "python": 1, "wrong": 1, "last": 2}
    assert sorted(found.filter("code = 'rule-error'").select("row_key").toPandas().row_key) == ["broken", "python", "wrong"]
    told = {r.rule: (r.rows, r.error) for r in summary.collect()}
    assert told["first"] == (4, None) and told["last"] == (2, None) and "boom" in told["broken"][1] and told["wrong"][1].startswith("TypeError")
    # the plan alone can't see what fails in tasks
    assert len(rules.run(TableSet({"t": df}))) == 5
