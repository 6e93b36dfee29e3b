"""Queries of slots, lists, formulas, messages, runs of violations, and contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcheck import violations as V
from gridcheck.functions import messages as M
from gridcheck.functions.scalar import ascii_lower, format_percent
from gridcheck.operators import columns as C
from gridcheck.operators import formulas as X
from gridcheck.operators import slot_rules as L
from gridcheck.operators import tokens as T
from gridcheck.plans.compile import RuleSet, TableSet, validate
from gridcheck.plans.contract import Contract
from gridcheck.queries.base import Registry, table
from gridcheck.violations import row_key

R = Registry()
N = 7
ITEMS, WEIGHTS = [f"Item{k}" for k in range(1, N + 1)], [f"Prob{k}" for k in range(1, N + 1)]

#: Orders with their lines as numbered slots; lines that are missing leave gaps.
WIDE_SQL = "SELECT l_orderkey, " + ", ".join(f"CAST(coalesce(min(CASE WHEN l_linenumber = {k} THEN l_partkey END)::VARCHAR, '') AS VARCHAR) AS Item{k}, coalesce(CAST(CAST(min(CASE WHEN l_linenumber = {k} THEN l_quantity END) AS BIGINT) - 10 AS VARCHAR), CASE WHEN l_orderkey % 5 = 0 THEN '3' ELSE '' END) AS Prob{k}" for k in range(1, N + 1)) + " FROM lineitem GROUP BY l_orderkey"
CELLS_SQL = "SELECT l_orderkey, slot, item, weight FROM (" + " UNION ALL ".join(f"SELECT l_orderkey, {k} AS slot, Item{k} AS item, Prob{k} AS weight FROM w" for k in range(1, N + 1)) + ")"
GAP_SQL = f"WITH w AS ({WIDE_SQL}), c AS ({CELLS_SQL}), g AS (SELECT *, coalesce(min(CASE WHEN item = '' THEN slot END) OVER (PARTITION BY l_orderkey), 99) AS gap FROM c)"


def wide(spark: SparkSession, d: str) -> DataFrame:
    line, k5 = table(spark, d, "lineitem"), F.col("l_orderkey") % 5 == 0
    of = lambda k, c: F.min(F.when(F.col("l_linenumber") == k, F.col(c)))
    found = line.groupBy("l_orderkey").agg(*(of(k, "l_partkey").alias(f"i{k}") for k in range(1, N + 1)), *(of(k, "l_quantity").alias(f"q{k}") for k in range(1, N + 1)))
    item = lambda k: F.coalesce(F.col(f"i{k}").cast("string"), F.lit("")).alias(f"Item{k}")
    weight = lambda k: F.coalesce((F.col(f"q{k}").cast("long") - 10).cast("string"), F.when(k5, "3").otherwise("")).alias(f"Prob{k}")
    return found.select("l_orderkey", *(item(k) for k in range(1, N + 1)), *(weight(k) for k in range(1, N + 1)))


def arrays(spark: SparkSession, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return L.slot_array(wide(spark, d), row_key("l_orderkey"), ITEMS, WEIGHTS, keep)


@R.add("prj4_slots", f"WITH w AS ({WIDE_SQL}) SELECT CAST(l_orderkey AS VARCHAR) AS row_key, slot, item, weight FROM ({CELLS_SQL})")
def slot_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.slots(wide(spark, d), row_key("l_orderkey"), {"item": "item#", "weight": "prob#"})


@R.add(
    "win1_check_first_gap",
    f"""{GAP_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS row_key, 'item' || slot AS col, item AS value, 'after-first-gap' AS code FROM g WHERE slot > gap AND item <> ''
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'weight' || slot, weight, CASE WHEN slot > gap THEN 'after-first-gap' ELSE 'orphaned' END FROM g WHERE slot >= gap AND weight <> ''""",
)
def first_gap(spark: SparkSession, d: str) -> DataFrame:
    return L.check_first_gap(arrays(spark, d), "orders").select("row_key", "col", "value", "code")


@R.add(
    "chk11_check_weight",
    f"""{GAP_SQL} SELECT CAST(l_orderkey AS VARCHAR) AS row_key, 'weight' || slot AS col, weight AS value, CASE WHEN trim(weight) = '' THEN 'blank-omission' ELSE 'nonpositive-omission' END AS code
    FROM g WHERE slot < gap AND (trim(weight) = '' OR CAST(weight AS BIGINT) <= 0)""",
)
def weight(spark: SparkSession, d: str) -> DataFrame:
    return L.check_weight(arrays(spark, d), "orders").select("row_key", "col", "value", "code")


@R.add(
    "agg4_check_declared_count",
    f"""{GAP_SQL}, n AS (SELECT l_orderkey, CAST(sum(CASE WHEN item <> '' THEN CASE WHEN coalesce(try_cast(weight AS BIGINT), 0) % 256 = 0 THEN 1 WHEN CAST(weight AS BIGINT) < 0 THEN 256 + CAST(weight AS BIGINT) ELSE CAST(weight AS BIGINT) END ELSE 0 END) AS BIGINT) AS actual FROM g GROUP BY 1)
    SELECT CAST(l_orderkey AS VARCHAR) AS row_key, CASE l_orderkey % 4 WHEN 0 THEN 'no-inputs' WHEN 1 THEN 'invalid-numinputs' ELSE 'count-mismatch' END AS code, CAST(actual AS VARCHAR) AS actual FROM n WHERE l_orderkey % 4 < 2 OR actual <> l_orderkey % 40""",
)
def declared(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    n = F.when(k % 4 == 0, "0").when(k % 4 == 1, "x").otherwise((k % 40).cast("string"))
    rows = L.slot_array(wide(spark, d).withColumn("numinputs", n), row_key("l_orderkey"), ITEMS, WEIGHTS, ["numinputs"])
    return L.check_declared_count(rows, "orders", "numinputs").select("row_key", "code", F.col("args")["actual"].alias("actual"))


@R.add(
    "agg5_6_slot_probability",
    f"""{GAP_SQL}, p AS (SELECT l_orderkey, slot, CAST(weight AS BIGINT) AS weight, greatest(l_orderkey % 30 - 5, 0) AS no_drop FROM g WHERE slot < gap AND coalesce(try_cast(weight AS BIGINT), 0) > 0),
    t AS (SELECT l_orderkey, CAST(max(no_drop) + sum(weight) AS BIGINT) AS total FROM p GROUP BY 1)
    SELECT CAST(l_orderkey AS VARCHAR) AS row_key, slot, total, round(weight / total, 9) AS per_roll, round(1 - pow(1 - weight / total, 1 + l_orderkey % 3), 9) AS at_least_once FROM p JOIN t USING (l_orderkey)""",
)
def probability(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    rows = L.slot_array(wide(spark, d).withColumn("nodrop", k % 30 - 5).withColumn("picks", 1 + k % 3), row_key("l_orderkey"), ITEMS, WEIGHTS, ["nodrop", "picks"])
    return L.slot_probability(rows, F.col("nodrop"), F.col("picks")).select("row_key", "slot", "total", F.round("per_roll", 9).alias("per_roll"), F.round("at_least_once", 9).alias("at_least_once"))


@R.add("agg6_format_percent", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, regexp_replace(regexp_replace(printf('%.4f', l_discount * 100), '0+$', ''), '[.]$', '') || '%' AS share FROM lineitem")
def percent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", format_percent(F.col("l_discount")).alias("share"))


@R.add(
    "flt4_prefix_gate",
    f"""WITH w AS ({WIDE_SQL}), c AS ({CELLS_SQL}), m AS (SELECT *, coalesce(try_cast(item AS BIGINT) % 40 BETWEEN 1 AND 25 OR try_cast(item AS BIGINT) % 40 = 36, false) AS ok FROM c)
    SELECT CAST(l_orderkey AS VARCHAR) AS row_key, slot, item FROM m a WHERE (SELECT bool_and(ok) FROM m b WHERE b.l_orderkey = a.l_orderkey AND b.slot <= a.slot)""",
)
def gate(spark: SparkSession, d: str) -> DataFrame:
    rows = C.slots(wide(spark, d), row_key("l_orderkey"), {"item": "item#", "weight": "prob#"}).withColumn("func", F.expr("try_cast(item AS bigint) % 40"))
    return C.prefix_gate(rows, "func", C.selector_allowed("func")).select("row_key", "slot", "item")


@R.add(
    "win3_ordinal_dependency",
    f"""WITH w AS ({WIDE_SQL}), c AS ({CELLS_SQL}) SELECT CAST(l_orderkey AS VARCHAR) AS row_key, 'slot' || slot AS col FROM c WHERE item <> '' AND CAST(item AS BIGINT) % 2 = 0 AND trim(weight) = ''
    UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'slot' || slot FROM c WHERE item = '' AND trim(weight) = ''""",
)
def ordinal(spark: SparkSession, d: str) -> DataFrame:
    rows = wide(spark, d)
    outputs = [F.when((F.col(c) == "") | (F.col(c).try_cast("long") % 2 == 0), "UseItem").otherwise(F.col(c)).alias(f"out{i}") for i, c in enumerate(ITEMS, 1)]
    rows = rows.select("l_orderkey", *WEIGHTS, *outputs)
    found = L.slot_array(rows, row_key("l_orderkey"), [f"out{i}" for i in range(1, N + 1)], (), WEIGHTS)
    return L.check_ordinal_dependency(found, "orders", WEIGHTS, ["useitem", "usetype"]).select("row_key", "col")


LIST_SQL = "SELECT p_partkey, p_name, p_type || ',qty=' || p_size || ',' || CASE p_size % 3 WHEN 0 THEN 'mag' WHEN 1 THEN 'sock=2' ELSE 'bogus' END || ',' || CASE p_partkey % 4 WHEN 0 THEN 'pre,x' WHEN 1 THEN 'eth' WHEN 2 THEN lower(p_brand) ELSE 'noe' END AS v FROM part"


def lists(spark: SparkSession, d: str) -> DataFrame:
    size, k = F.col("p_size"), F.col("p_partkey")
    v = F.concat("p_type", F.lit(",qty="), size.cast("string"), F.lit(","), F.when(size % 3 == 0, "mag").when(size % 3 == 1, "sock=2").otherwise("bogus"), F.lit(","), F.when(k % 4 == 0, "pre,x").when(k % 4 == 1, "eth").when(k % 4 == 2, F.lower("p_brand")).otherwise("noe"))
    return table(spark, d, "part").withColumn("v", v)


@R.add("tok1_split_modifiers", f"WITH l AS ({LIST_SQL}), s AS (SELECT p_partkey, unnest(string_split(v, ',')) AS token, generate_subscripts(string_split(v, ','), 1) - 1 AS pos FROM l) SELECT CAST(p_partkey AS VARCHAR) AS row_key, CAST(pos AS INTEGER) AS pos, token FROM s")
def split(spark: SparkSession, d: str) -> DataFrame:
    rows = lists(spark, d).withColumn("v", F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit('"'), "v", F.lit('"'))).otherwise(F.col("v")))
    return T.split_modifiers(rows, row_key("p_partkey"), "v").select("row_key", "pos", "token")


@R.add("tok2_check_modifiers", f"WITH l AS ({LIST_SQL}) SELECT CAST(p_partkey AS VARCHAR) AS row_key, CASE WHEN p_size_bogus THEN 'bogus' ELSE brand END AS stopped_at, CASE WHEN p_size_bogus THEN '2' ELSE '3' END AS position FROM (SELECT l.p_partkey, lower(p_brand) AS brand, p_size % 3 = 2 AS p_size_bogus FROM l JOIN part USING (p_partkey)) WHERE p_size_bogus OR p_partkey % 4 = 2")
def modifiers(spark: SparkSession, d: str) -> DataFrame:
    found = T.check_modifiers(T.token_arrays(lists(spark, d), row_key("p_partkey"), "v"), "part", ["mag", "eth", "noe"], ["qty", "sock"], ["pre"])
    return found.select("row_key", F.col("args")["stopped_at"].alias("stopped_at"), F.col("args")["position"].alias("position"))


@R.add("tok3_check_base", f"WITH l AS ({LIST_SQL}), t AS (SELECT lower(p_type) AS t FROM part WHERE p_type < 'P') SELECT CAST(p_partkey AS VARCHAR) AS row_key, split_part(v, ',', 1) AS base FROM l WHERE lower(split_part(v, ',', 1)) NOT IN (SELECT t FROM t)")
def base(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "part").filter("p_type < 'P'").select(ascii_lower(F.col("p_type")).alias("key")).distinct()
    found, _ = T.check_base(T.token_arrays(lists(spark, d), row_key("p_partkey"), "v"), "part", keys)
    return found.select("row_key", F.col("args")["base"].alias("base"))


def formulas(spark: SparkSession, d: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    v = (
        F.when(k % 6 == 0, F.concat(F.lit("min("), size, F.lit(",par1)+skill('"), "p_name", F.lit("'.lvl)")))
        .when(k % 6 == 1, F.concat(F.lit("max("), size, F.lit(")")))
        .when(k % 6 == 2, F.concat(F.lit("(par1+"), size))
        .when(k % 6 == 3, F.concat(size, F.lit(".5*unknown")))
        .when(k % 6 == 4, F.concat(F.lit("lvl+*"), size, F.lit("#")))
        .otherwise(F.concat(F.lit("lvl % "), size))
    )
    return X.formulas(table(spark, d, "part").withColumn("calc", v), row_key("p_partkey"), ["calc"])


@R.add(
    "frm_check_formulas",
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS row_key, p_partkey % 6 AS k, lower(p_name) IN (SELECT lower(p_name) FROM part WHERE p_size <= 25) AS known FROM part)
    SELECT row_key, 'formula-arity' AS rule, 'arity' AS code FROM p WHERE k = 1
    UNION ALL SELECT row_key, 'formula-balance', 'missing-close' FROM p WHERE k = 2
    UNION ALL SELECT row_key, 'formula-lexical', 'unknown-character' FROM p WHERE k = 4 UNION ALL SELECT row_key, 'formula-policy', 'decimal' FROM p WHERE k = 3
    UNION ALL SELECT row_key, 'formula-policy', 'percent-ends-formula' FROM p WHERE k = 5 UNION ALL SELECT row_key, 'formula-identifier', 'unknown-identifier' FROM p WHERE k = 3
    UNION ALL SELECT row_key, 'formula-reference', 'unresolved-name' FROM p WHERE k = 0 AND NOT known""",
)
def check_formulas(spark: SparkSession, d: str) -> DataFrame:
    f = formulas(spark, d)
    names = table(spark, d, "part").filter("p_size <= 25").select(F.col("p_name").alias("key"))
    words = spark.createDataFrame([("lvl",), ("par1",)], "key string")
    return X.check_formulas(f, "part", {"skills": (names, "ascii-ci"), "scope": (words, "exact")}).select("row_key", "rule", "code")


@R.add(
    "frm4_nested_calls",
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS row_key, p_size % 4 + 1 AS inside, CASE WHEN p_partkey % 3 > 0 THEN 2 ELSE 1 END AS outside FROM part)
    SELECT row_key, 'min' AS fn, CAST(inside AS BIGINT) AS found FROM p WHERE inside <> 2 UNION ALL SELECT row_key, 'max', CAST(outside AS BIGINT) FROM p WHERE outside <> 2""",
)
def nested_calls(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("calc", F.concat(F.lit("1+max(min("), F.expr("repeat('1,', p_size % 4)"), F.lit("(p_size))"), F.when(F.col("p_partkey") % 3 > 0, ", 2-par1").otherwise(""), F.lit(")")))
    found = X.check_formulas(X.formulas(part, row_key("p_partkey"), ["calc"]), "part").filter("rule = 'formula-arity'")
    return found.select("row_key", F.col("args.fn").alias("fn"), F.col("args.found").cast("long").alias("found"))


@R.add(
    "frm5_parentheses",
    """WITH p AS (SELECT CAST(p_partkey AS VARCHAR) AS row_key, p_size % 4 AS opened, p_partkey % 4 AS closed, p_size % 3 AS powers FROM part)
    SELECT row_key, CASE WHEN powers = 2 THEN 'structure' WHEN closed > opened THEN 'unexpected-close' ELSE 'missing-close' END AS code FROM p WHERE powers = 2 OR opened <> closed""",
)
def parentheses(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("calc", F.expr("concat(repeat('(', p_size % 4), '7', repeat('^2', p_size % 3), repeat(')', p_partkey % 4))"))
    return X.check_formulas(X.formulas(part, row_key("p_partkey"), ["calc"]), "part").select("row_key", "code")


@R.add(
    "frm2_bare_names",
    "SELECT CAST(p_partkey AS VARCHAR) AS row_key, 'w' || p_size AS value FROM part WHERE p_size > 25 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'x' || p_size % 7 FROM part WHERE p_size % 7 <> 3",
)
def bare_names(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").withColumn("calc", F.expr("concat('min(1,y', p_size, ')+(w', p_size, ')*rand(1,(z))-x', p_size % 7)"))
    words = spark.createDataFrame([(f"w{k}",) for k in range(26)] + [("x3",)], "key string")
    return X.check_formulas(X.formulas(part, row_key("p_partkey"), ["calc"]), "part", {"scope": (words, "exact")}).select("row_key", "value")


@R.add("frm1_formula_tokens", "SELECT CAST(p_partkey AS VARCHAR) AS row_key, CAST(CASE p_partkey % 6 WHEN 0 THEN 13 WHEN 1 THEN 4 WHEN 2 THEN 4 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 1 END AS BIGINT) AS n FROM part")
def formula_tokens(spark: SparkSession, d: str) -> DataFrame:
    return X.formula_tokens(formulas(spark, d)).select("row_key", F.size("tokens").cast("long").alias("n"))


CHECKS = {
    "tables": {
        "lineitem": {"key": ["l_orderkey", "l_linenumber"], "columns": [{"name": "l_partkey", "type": {"type": "reference", "table": "part", "column": "p_partkey"}}, {"name": "l_returnflag", "type": {"unknown": "warning"}, "values": ["A", "R"]}]},
        "orders": {"key": ["o_orderkey"], "columns": [{"name": "o_orderpriority", "type": {"unknown": "warning"}, "values": ["1-URGENT", "2-HIGH"]}]},
    }
}


def checks(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").filter("p_size <= 25")
    return validate(Contract.of(CHECKS), {"lineitem": table(spark, d, "lineitem"), "orders": table(spark, d, "orders"), "part": part})


CHECKS_SQL = """WITH v AS (SELECT 'lineitem' AS "table", 'error' AS severity, l_orderkey || '|' || l_linenumber AS row_key, 'reference' AS rule FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)
  UNION ALL SELECT 'lineitem', 'warning', l_orderkey || '|' || l_linenumber, 'enum' FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')
  UNION ALL SELECT 'orders', 'warning', CAST(o_orderkey AS VARCHAR), 'enum' FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH'))"""


@R.add("agg2_severity_summary", f"""{CHECKS_SQL} SELECT "table", CAST(count(CASE WHEN severity = 'error' THEN 1 END) AS BIGINT) AS n_error, CAST(count(CASE WHEN severity = 'warning' THEN 1 END) AS BIGINT) AS n_warning, CAST(0 AS BIGINT) AS n_information, CAST(0 AS BIGINT) AS n_hint FROM v GROUP BY ROLLUP ("table")""")
def summary(spark: SparkSession, d: str) -> DataFrame:
    return V.severity_summary(checks(spark, d), totals=True)


@R.add("snk2_gate", f"{CHECKS_SQL} SELECT CAST(count(CASE WHEN severity = 'error' THEN 1 END) AS BIGINT) AS errors, CASE WHEN count(CASE WHEN severity = 'error' THEN 1 END) > 0 THEN 1 ELSE 0 END AS exit_code FROM v")
def passed(spark: SparkSession, d: str) -> DataFrame:
    return V.gate(checks(spark, d))


@R.add("snk1_report_lines", f"""{CHECKS_SQL} SELECT "table" || ':1:1: ' || severity || ': ' || row_key AS value FROM v""")
def report(spark: SparkSession, d: str) -> DataFrame:
    return V.report_lines(checks(spark, d), F.col("row_key"))


@R.add(
    "set1_2_diff_violations",
    """WITH b AS (SELECT event_id FROM events WHERE event_id % 3 = 0), a AS (SELECT event_id FROM events WHERE event_id % 2 = 0)
    SELECT CAST(coalesce(b.event_id, a.event_id) AS VARCHAR) AS row_key, CASE WHEN a.event_id IS NULL THEN 'resolved' WHEN b.event_id IS NULL THEN 'new' ELSE 'unchanged' END AS status, CAST(1 AS BIGINT) AS n FROM b FULL OUTER JOIN a ON a.event_id = b.event_id""",
)
def diff(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    of = lambda n: V.violations(events.filter(F.col("event_id") % n == 0), "events", "r", "c", row_key=row_key("event_id"))
    return V.diff_violations(of(3), of(2)).select("row_key", "status", F.col("n").cast("long").alias("n"))


@R.add(
    "set3_carry_forward",
    """SELECT CAST(event_id AS VARCHAR) AS row_key, 'orders' AS "table", 'old' AS "from" FROM events WHERE event_id % 3 = 0
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'orders', 'syntax' FROM events WHERE event_id % 97 = 0 UNION ALL SELECT CAST(event_id AS VARCHAR), 'events', 'new' FROM events WHERE event_id % 2 = 0""",
)
def carried(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    make = lambda n, t, rule, code: V.violations(events.filter(F.col("event_id") % n == 0), t, rule, code, row_key=row_key("event_id"))
    before = make(3, "orders", "type", "old").unionByName(make(5, "events", "type", "old"))
    now = make(97, "orders", "syntax", "syntax").unionByName(make(2, "events", "type", "new"))
    failed = spark.createDataFrame([("orders",)], "table string")
    return V.carry_forward(before, now, failed, "syntax", "duplicate").select("row_key", "table", F.col("code").alias("from"))


CATALOG = [("en", "reference.unresolved", "{value} is not in {target}"), ("de", "reference.unresolved", "{value} fehlt in {target}"), ("en", "enum.unresolved", "{value} is not allowed"), ("de", "enum.unresolved", "{wert} ist nicht erlaubt"), ("en", "gone", "gone"), ("fr", "reference.unresolved", "{value} absent de {target}"), ("fr", "enum.unresolved", "{value} interdit"), ("fr", "gone", "parti"), ("fr", "extra", "plus")]


@R.add("scl11_render_messages", "SELECT l_orderkey || '|' || l_linenumber AS row_key, l_partkey || ' fehlt in part.p_partkey' AS message FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)")
def messages(spark: SparkSession, d: str) -> DataFrame:
    catalog = spark.createDataFrame(CATALOG, "locale string, key string, template string")
    found = checks(spark, d).filter("rule = 'reference'").withColumn("args", F.map_concat("args", F.create_map(F.lit("value"), F.col("value"))))
    return M.render_messages(found, catalog, "DE").select("row_key", "message")


CONTRACT = {
    "version": "3.3",
    "tables": {
        "lineitem": {
            "key": ["l_orderkey", "l_linenumber"],
            "columns": [
                {"name": "L_PARTKEY", "type": {"type": "int", "table": "part", "column": "p_partkey"}}, {"name": "l_suppkey", "type": {"type": "reference", "table": "supplier", "column": "s_suppkey", "unknown": "warning"}}, {"name": "l_orderkey", "type": {"type": "reference", "table": "orders", "column": "o_orderkey"}},
                {"name": "l_linenumber", "type": {"type": "reference", "table": "nation", "column": "n_nationkey", "resolver": "exact"}}, {"name": "l_tax", "type": {"type": "reference", "table": "absent", "column": "x"}}, {"name": "flag", "alt_names": ["l_returnflag"], "values": ["A", "R"]},
            ],
        },
        "part": {"key": ["p_partkey"], "order": "p_partkey", "append": ["more"], "columns": [{"name": "p_name", "unique": True}]},
        "more": {"columns": [{"name": "p_brand", "type": {"type": "string", "max_chars": 7}, "rules": [{"kind": "formula", "versions": ["1.0"]}]}, {"name": "p_size", "rules": [{"kind": "code_range", "low": 0, "high": 15, "when": {"column": "p_brand", "value": "Brand#13"}, "versions": ["3.3"]}]}]},
    },
}


@R.add(
    "e1_validate_contract",
    """SELECT l_orderkey || '|' || l_linenumber AS row_key, 'reference' AS rule, 'l_partkey' AS col FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 25)
    UNION ALL SELECT l_orderkey || '|' || l_linenumber, 'reference', 'l_suppkey' FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)
    UNION ALL SELECT l_orderkey || '|' || l_linenumber, 'reference', 'l_orderkey' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_totalprice > 50000)
    UNION ALL SELECT l_orderkey || '|' || l_linenumber, 'reference', 'l_linenumber' FROM lineitem WHERE l_linenumber NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 3)
    UNION ALL SELECT l_orderkey || '|' || l_linenumber, 'enum', 'l_returnflag' FROM lineitem WHERE l_returnflag NOT IN ('A', 'R')
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'code-range', 'p_size' FROM part WHERE p_size <= 25 AND p_brand = 'Brand#13' AND p_size > 15
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'unique', 'p_name' FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY lower(p_name)) AS first FROM part WHERE p_size <= 25) WHERE p_partkey <> first
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'max-chars', 'p_brand' FROM part WHERE p_size <= 25 AND length(p_brand) > 7
    UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'price', 'p_retailprice' FROM part WHERE p_size <= 25 AND p_retailprice > 1500
    UNION ALL SELECT 'broken', 'broken', NULL""",
)
def validated(spark: SparkSession, d: str) -> DataFrame:
    rules = RuleSet()

    @rules.rule("price", tables=["part"])
    def price(tables: TableSet, _):
        return V.violations(tables.table("part").filter("p_retailprice > 1500"), "part", "price", "high", row_key=row_key("p_partkey"), col="p_retailprice")

    @rules.rule("broken")
    def broken(tables: TableSet, _):
        return tables.table("part")

    @rules.rule("old", not_versions=["3.3"])
    def old(tables: TableSet, _):
        raise RuntimeError("does not apply")

    have = {"part": "p_size <= 25", "supplier": "s_acctbal > 0", "orders": "o_totalprice > 50000", "nation": "n_nationkey <> 3"}
    tables = {"lineitem": table(spark, d, "lineitem")} | {n: table(spark, d, n).filter(condition) for n, condition in have.items()}
    found = validate(Contract.of(CONTRACT), tables, rules)
    return found.select("row_key", "rule", "col")


SCOPED = {
    "tables": {
        "lines": {"key": ["l_orderkey", "l_linenumber"], "order": "n", "columns": [{"name": "l_partkey", "type": {"type": "int", "table": "parts", "column": "p_partkey"}}, {"name": "pair", "unique": True}]},
        "parts": {"key": ["p_partkey"], "columns": [{"name": "p_size", "type": {"type": "reference", "table": "sizes", "column": "size"}}]},
    }
}


@R.add(
    "src7_scoped_contract",
    """WITH l AS (SELECT *, 'f' || l_suppkey % 4 AS scope, l_partkey || '/' || l_returnflag AS pair, l_orderkey * 10 + l_linenumber AS n FROM lineitem),
    p AS (SELECT *, 'f' || p_partkey % 3 AS scope FROM part WHERE p_size <= 40),
    bad AS (SELECT scope, l_orderkey, l_linenumber FROM l WHERE scope IN ('f0', 'f1', 'f2') AND NOT EXISTS (SELECT 1 FROM p WHERE p.scope = l.scope AND p_partkey = l_partkey)
      UNION ALL SELECT scope, l_orderkey, l_linenumber FROM l WHERE scope = 'f3' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 10)),
    f AS (SELECT *, min(n) OVER (PARTITION BY scope, pair) AS first FROM l)
    SELECT scope || '|' || l_orderkey || '|' || l_linenumber AS row_key, 'reference' AS rule FROM bad UNION ALL SELECT scope || '|' || l_orderkey || '|' || l_linenumber, 'unique' FROM f WHERE n <> first
    UNION ALL SELECT scope || '|' || p_partkey, 'reference' FROM p WHERE scope IN ('f0', 'f2') AND p_size > CASE scope WHEN 'f0' THEN 20 ELSE 30 END""",
)
def scoped(spark: SparkSession, d: str) -> DataFrame:
    """Folders f0 to f3 with lines; f0 to f2 have parts of their own, f3 takes the shared ones; sizes are known to f0 and f2 alone."""
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    lines = line.withColumns({"scope": F.concat(F.lit("f"), (F.col("l_suppkey") % 4).cast("string")), "pair": F.concat_ws("/", F.col("l_partkey").cast("string"), "l_returnflag"), "n": F.col("l_orderkey") * 10 + F.col("l_linenumber")})
    parts = part.filter("p_size <= 40").withColumn("scope", F.concat(F.lit("f"), (F.col("p_partkey") % 3).cast("string")))
    of = lambda scope, most: part.select(F.lit(scope).alias("scope"), F.col("p_size").alias("size")).filter(F.col("size") <= most)
    have = {"lines": lines, "parts": parts, "sizes": of("f0", 20).unionByName(of("f2", 30))}
    found = validate(Contract.of(SCOPED), have, scope="scope", shared={"parts": part.filter("p_size <= 10")})
    return found.select("row_key", "rule")


@R.add("udf4_violation_defaults", "SELECT CAST(event_id AS VARCHAR) AS row_key, CASE event_id % 3 WHEN 0 THEN 'warning' WHEN 1 THEN 'error' ELSE 'hint' END AS severity, CAST(user_id % 50 AS INTEGER) AS col_start, CAST(CASE event_id % 2 WHEN 0 THEN user_id % 50 + 5 ELSE user_id % 50 END AS INTEGER) AS col_end, 'r.c' AS message_key FROM events")
def violation_defaults(spark: SparkSession, d: str) -> DataFrame:
    """A rule's rows without some fields: no severity is a warning, a missing or earlier end of the range is its start."""
    k, start = F.col("event_id"), (F.col("user_id") % 50).cast("int")
    rows = table(spark, d, "events").select(k.cast("string").alias("row_key"), start.alias("col_start"), F.when(k % 2 == 0, start + 5).when(k % 4 == 1, start - 3).alias("col_end"), F.when(k % 3 == 1, "error").when(k % 3 == 2, "hint").alias("said"))
    return V.violations(rows, "events", "r", "c", F.col("said")).select("row_key", "severity", "col_start", "col_end", "message_key")


@R.add("win4_first_enrichment", "SELECT p_partkey, CASE WHEN p_size > 40 THEN p_brand ELSE p_type END AS title FROM part")
def enrichment(spark: SparkSession, d: str) -> DataFrame:
    part, rules = table(spark, d, "part"), RuleSet()
    rules.enricher(lambda t: t.table("part").filter("p_size > 40").select("p_partkey", F.col("p_brand").alias("title")))
    rules.enricher(lambda t: t.table("part").select("p_partkey", F.col("p_type").alias("title")))
    return rules.enrich(part.select("p_partkey"), "p_partkey", "title", TableSet({"part": part}))


@R.add(
    "prj6_field_metadata",
    """SELECT 'lineitem' AS "table", col, CAST(NULL AS INTEGER) AS max_chars, (SELECT count(*) FROM lineitem) AS n FROM (VALUES ('L_PARTKEY'), ('l_suppkey'), ('l_orderkey'), ('l_linenumber'), ('l_tax'), ('flag')) v(col)
    UNION ALL SELECT 'part', col, max_chars, (SELECT count(*) FROM part) FROM (VALUES ('p_name', CAST(NULL AS INTEGER)), ('p_brand', 7), ('p_size', NULL)) v(col, max_chars)""",
)
def metadata(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "lineitem").agg(F.count("*").alias("n")).withColumn("t", F.lit("lineitem")).unionByName(table(spark, d, "part").agg(F.count("*").alias("n")).withColumn("t", F.lit("part")))
    return Contract.of(CONTRACT).metadata(spark).join(counts, F.col("table") == F.col("t")).select("table", "col", "max_chars", "n")


@R.add(
    "tok4_secondary_families",
    f"""WITH w AS ({WIDE_SQL}), c AS ({CELLS_SQL}) SELECT CAST(l_orderkey AS VARCHAR) AS row_key, 'b mod ' || slot AS col, item AS value FROM c WHERE slot <= 5 AND item <> '' AND item <> '7'
      AND NOT EXISTS (SELECT 1 FROM part WHERE p_size <= 25 AND CAST(p_partkey AS VARCHAR) = item) AND NOT EXISTS (SELECT 1 FROM supplier WHERE CAST(s_suppkey AS VARCHAR) = item)""",
)
def families(spark: SparkSession, d: str) -> DataFrame:
    from gridcheck.operators import refs as X

    rows = wide(spark, d).select("l_orderkey", *(F.col(f"Item{k}").alias(f"b mod {k}") for k in range(1, 6)))
    keys = X.union_keys([(table(spark, d, "part").filter("p_size <= 25"), "p_partkey"), (table(spark, d, "supplier"), "s_suppkey")])
    long = C.melt(rows, row_key("l_orderkey"), C.expand_numbered(rows.columns, "B mod #"))
    return X.check_reference(long, "orders", keys, "part|supplier", skip=["7"]).select("row_key", "col", "value")


@R.add("frm7_alias_hint", "SELECT CAST(p_partkey AS VARCHAR) AS row_key, 'par' || (10 + p_size % 11) AS identifier, 'par' || CASE WHEN p_size % 11 = 10 THEN '2' ELSE '1' END AS read_as, CASE WHEN p_size % 11 BETWEEN 2 AND 5 THEN 'pa' || (10 + p_size % 11) END AS hint FROM part")
def alias_hint(spark: SparkSession, d: str) -> DataFrame:
    number = (10 + F.col("p_size") % 11).cast("string")
    rows = table(spark, d, "part").withColumn("calc", F.concat(F.lit("par"), number, F.lit("+par9*2")))
    words = spark.createDataFrame([(w,) for w in ("par1", "par2", "pa12", "pa13", "pa14", "pa15")], "key string")
    return X.with_alias_hint(X.formulas(rows, row_key("p_partkey"), ["calc"]), words).select("row_key", "identifier", "read_as", "hint")


@R.add("udf3_table_lookups", "SELECT 'value' AS kind, p_brand AS value, CAST(NULL AS BIGINT) AS first_line FROM part UNION ALL SELECT 'filtered', p_name, NULL FROM part WHERE p_size = 7 UNION ALL SELECT 'first', lower(p_type), min(p_partkey) FROM part GROUP BY lower(p_type)")
def lookups(spark: SparkSession, d: str) -> DataFrame:
    tables = TableSet({"Part": table(spark, d, "part")}, Contract.of(CONTRACT))
    none = F.lit(None).cast("long").alias("first_line")
    first = tables.first_lines("part", "P_TYPE", "p_partkey").select(F.lit("first").alias("kind"), F.col("key").alias("value"), "first_line")
    return tables.values("PART", "p_brand").select(F.lit("value").alias("kind"), "value", none).unionByName(tables.filtered_values("part", "p_name", "p_size", "7").select(F.lit("filtered").alias("kind"), "value", none)).unionByName(first)


@R.add(
    "agg8_catalog_parity",
    """SELECT 'de' AS locale, 'k' || p_partkey AS key, 'missing-key' AS code FROM part WHERE p_size <= 10 UNION ALL SELECT 'de', 'k' || p_partkey, 'placeholders' FROM part WHERE p_size > 10 AND p_size % 5 = 0
    UNION ALL SELECT 'de', 'x' || p_partkey, 'extra-key' FROM part WHERE p_size = 7""",
)
def catalog_parity(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    entry = lambda rows, locale, key, template: rows.select(F.lit(locale).alias("locale"), F.expr(f"concat('{key}', p_partkey)").alias("key"), template.alias("template"))
    base = entry(part, "en", "k", F.concat(F.lit("{value} is not a "), "p_name"))
    own = entry(part.filter("p_size > 10"), "DE", "k", F.when(F.col("p_size") % 5 == 0, "{wert} fehlt").otherwise("es fehlt {value}"))
    return M.check_catalog_parity(base.unionByName(own).unionByName(entry(part.filter("p_size = 7"), "de", "x", F.lit("mehr"))))
