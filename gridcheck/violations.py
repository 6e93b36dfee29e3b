"""The violations table: its schema, and what is done with whole runs of it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("table", T.StringType()), T.StructField("row_key", T.StringType()), T.StructField("line", T.IntegerType()), T.StructField("col", T.StringType()),
        T.StructField("col_start", T.IntegerType()), T.StructField("col_end", T.IntegerType()), T.StructField("rule", T.StringType()), T.StructField("code", T.StringType()),
        T.StructField("severity", T.StringType()), T.StructField("value", T.StringType()), T.StructField("message_key", T.StringType()), T.StructField("args", T.MapType(T.StringType(), T.StringType())),
    ]
)
SEVERITIES = ("error", "warning", "information", "hint")


def violations(df: DataFrame, table: str, rule: str, code: str | Column, severity: str | Column = "warning", row_key: Column | None = None, col: str | Column | None = None, value: Column | None = None, message_key: str | Column | None = None, args: dict[str, Column] | None = None) -> DataFrame:
    """Rows of ``df`` as violations; a missing end of the range is its start."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    have = set(df.columns)
    start = F.col("col_start") if "col_start" in have else F.lit(None)
    end = F.col("col_end") if "col_end" in have else F.lit(None)
    pairs = [x for k, v in (args or {}).items() for x in (F.lit(k), v.cast("string"))]
    key = message_key if message_key is not None else F.concat(F.lit(f"{rule}."), lit(code))
    columns = {
        "table": F.lit(table), "row_key": row_key if row_key is not None else F.col("row_key") if "row_key" in have else F.lit(None),
        "line": F.col("line") if "line" in have else F.lit(None), "col": lit(col) if col is not None else F.col("col") if "col" in have else F.lit(None),
        "col_start": start, "col_end": F.greatest(F.coalesce(end, start), start), "rule": F.lit(rule), "code": lit(code), "severity": F.coalesce(lit(severity), F.lit("warning")),
        "value": value if value is not None else F.col("value") if "value" in have else F.lit(None), "message_key": lit(key),
        "args": F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>"),
    }
    return df.select(*(columns[f.name].cast(f.dataType).alias(f.name) for f in SCHEMA))


def row_key(*cols: str) -> Column:
    """The key columns as text, joined by '|'."""
    return F.concat_ws("|", *(F.col(c).cast("string") for c in cols))


def merge_violations(parts: Sequence[DataFrame]) -> DataFrame:
    """All rules' violations; repeats stay."""
    return reduce(DataFrame.unionByName, parts)


def severity_summary(found: DataFrame, totals: bool = False) -> DataFrame:
    """Counts of each severity per table; with ``totals`` also over all (table null)."""
    counts = [F.count_if(F.col("severity") == s).alias(f"n_{s}") for s in SEVERITIES]
    return (found.rollup("table") if totals else found.groupBy("table")).agg(*counts)


def gate(found: DataFrame) -> DataFrame:
    """One row: how many errors, and the exit code (1 if there are any)."""
    return found.agg(F.count_if(F.col("severity") == "error").alias("errors")).select("errors", F.when(F.col("errors") > 0, 1).otherwise(0).alias("exit_code"))


def report_lines(found: DataFrame, message: Column | None = None) -> DataFrame:
    """``table:line:column: severity: message`` (1-based), ordered by place."""
    line, col = F.coalesce(F.col("line") + 1, F.lit(1)), F.coalesce(F.col("col_start") + 1, F.lit(1))
    text = F.concat(F.col("table"), F.lit(":"), line.cast("string"), F.lit(":"), col.cast("string"), F.lit(": "), F.col("severity"), F.lit(": "), message if message is not None else F.coalesce("message_key", "code"))
    return found.orderBy("table", "line", "col_start", "row_key", "col", "rule").select(text.alias("value"))


def write_report(found: DataFrame, path: str, message: Column | None = None) -> None:
    report_lines(found, message).write.mode("overwrite").text(path)


IDENTITY = [f.name for f in SCHEMA if f.name != "args"]


def diff_violations(before: DataFrame, after: DataFrame) -> DataFrame:
    """Each violation with its ``status`` (new, resolved, unchanged) and how many rows have it.

    Repeats count: of three before and two after, two are unchanged, one is resolved.
    Both sides are counted by one aggregation, without a join.
    """
    sides = before.select(*IDENTITY, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(after.select(*IDENTITY, F.lit(0).alias("b"), F.lit(1).alias("a")))
    both = sides.groupBy(*IDENTITY).agg(F.sum("b").alias("n_before"), F.sum("a").alias("n_after"))
    nb, na = F.col("n_before"), F.col("n_after")
    parts = F.array(F.struct(F.lit("unchanged").alias("status"), F.least(nb, na).alias("n")), F.struct(F.lit("resolved").alias("status"), (nb - na).alias("n")), F.struct(F.lit("new").alias("status"), (na - nb).alias("n")))
    return both.select(*IDENTITY, F.explode(parts).alias("p")).filter("p.n > 0").select(*IDENTITY, "p.status", "p.n")


def carry_forward(before: DataFrame, now: DataFrame, failed: DataFrame, syntax_rule: str, duplicate_rule: str, rules_run: Sequence[str] | None = None, scope: str | None = None) -> DataFrame:
    """Violations after a run in which some inputs failed to parse.

    ``failed`` has a ``table`` (and the ``scope`` column, if named) for each
    failed input.  A failed table keeps its violations from before and gets
    only its new syntax violations.  Tables of the same scope keep their
    duplicate findings.  A partial run replaces only the rules in ``rules_run``.
    """
    gone = failed.select(F.col("table").alias("__t")).distinct()
    old_failed = before.join(gone, F.col("table") == F.col("__t"), "left_semi").filter(F.col("rule") != syntax_rule)
    new_failed = now.join(gone, F.col("table") == F.col("__t"), "left_semi").filter(F.col("rule") == syntax_rule)
    peers_now = now.join(gone, F.col("table") == F.col("__t"), "left_anti")
    peers_before = before.join(gone, F.col("table") == F.col("__t"), "left_anti")
    if scope is None:
        has_failed = F.broadcast(gone.agg((F.count("*") > 0).alias("__any")))
        kept = peers_before.filter(F.col("rule") == duplicate_rule).join(has_failed, F.col("__any")).drop("__any")
        fresh = peers_now.join(has_failed, (F.col("rule") != duplicate_rule) | ~F.col("__any")).drop("__any")
    else:
        scopes = failed.select(F.col(scope).alias("__s")).distinct()
        kept = peers_before.filter(F.col("rule") == duplicate_rule).join(scopes, F.col(scope) == F.col("__s"), "left_semi")
        dup = peers_now.filter(F.col("rule") == duplicate_rule).join(scopes, F.col(scope) == F.col("__s"), "left_anti")
        fresh = peers_now.filter(F.col("rule") != duplicate_rule).unionByName(dup)
    out = merge_violations([old_failed, new_failed, kept, fresh])
    if rules_run is not None:
        out = out.filter(F.col("rule").isin(*rules_run)).unionByName(before.filter(~F.col("rule").isin(*rules_run)))
    return out
