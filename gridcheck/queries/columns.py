"""Queries of column checks, projections and filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcheck.functions import scalar as S
from gridcheck.operators import columns as C
from gridcheck.queries.base import Registry, table
from gridcheck.violations import row_key

R = Registry()

#: Numeric columns as text, with edits by the key.
DIRTY_SQL = """
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
    CASE l_orderkey % 9 WHEN 0 THEN ' ' || l_partkey || ' ' WHEN 1 THEN l_partkey || '.5' WHEN 2 THEN '' WHEN 3 THEN '*' || l_partkey WHEN 4 THEN '+' || l_partkey WHEN 5 THEN '-' || l_partkey ELSE CAST(l_partkey AS VARCHAR) END AS a,
    CASE l_suppkey % 7 WHEN 0 THEN l_suppkey || 'd' WHEN 1 THEN '.' || l_suppkey WHEN 2 THEN l_suppkey || '.' WHEN 3 THEN l_suppkey || 'e' || l_linenumber WHEN 4 THEN ' ' ELSE CAST(l_suppkey AS VARCHAR) END AS b,
    CASE l_linenumber % 5 WHEN 0 THEN '0' WHEN 1 THEN '1' WHEN 2 THEN '2' WHEN 3 THEN '' ELSE ' 1' END AS c
  FROM lineitem"""


def dirty(spark: SparkSession, d: str) -> DataFrame:
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    k, m, n = F.col("l_orderkey") % 9, F.col("l_suppkey") % 7, F.col("l_linenumber") % 5
    a = F.when(k == 0, F.concat(F.lit(" "), p, F.lit(" "))).when(k == 1, F.concat(p, F.lit(".5"))).when(k == 2, "").when(k == 3, F.concat(F.lit("*"), p)).when(k == 4, F.concat(F.lit("+"), p)).when(k == 5, F.concat(F.lit("-"), p)).otherwise(p)
    b = F.when(m == 0, F.concat(s, F.lit("d"))).when(m == 1, F.concat(F.lit("."), s)).when(m == 2, F.concat(s, F.lit("."))).when(m == 3, F.concat(s, F.lit("e"), F.col("l_linenumber").cast("string"))).when(m == 4, " ").otherwise(s)
    c = F.when(n == 0, "0").when(n == 1, "1").when(n == 2, "2").when(n == 3, "").otherwise(" 1")
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", a.alias("a"), b.alias("b"), c.alias("c"))


def line_key():
    return row_key("l_orderkey", "l_linenumber")


KEY_SQL = "l_orderkey || '|' || l_linenumber"


@R.add(
    "chk1_3_check_columns",
    f"""WITH d AS ({DIRTY_SQL})
    SELECT {KEY_SQL} AS row_key, 'a' AS col, 'diag.integer.invalid' AS code, a AS value FROM d WHERE a <> '' AND NOT regexp_full_match(a, '[+-]?[0-9]+')
    UNION ALL SELECT {KEY_SQL}, 'b', 'diag.float.invalid', b FROM d WHERE b <> '' AND NOT regexp_full_match(b, '[+-]?([0-9]+[.]?[0-9]*([eE][+-]?[0-9]+)?|[.][0-9]+([eE][+-]?[0-9]+)?)')
    UNION ALL SELECT {KEY_SQL}, 'c', 'diag.boolean.invalid', c FROM d WHERE trim(c) <> '' AND c NOT IN ('0', '1')""",
)
def check_columns(spark: SparkSession, d: str) -> DataFrame:
    long = C.melt(dirty(spark, d), line_key(), ["a", "b", "c"])
    return C.check_columns(long, "lineitem", {"a": "int", "b": "float", "c": "boolean"}).select("row_key", "col", "code", "value")


@R.add(
    "chk4_stored_boolean",
    f"""WITH d AS ({DIRTY_SQL})
    SELECT {KEY_SQL} AS row_key, a AS value, regexp_full_match(a, '-?[0-9]+') AS valid,
      CASE WHEN regexp_full_match(a, '-?[0-9]+') THEN l_partkey % 256 <> 0 END AS enabled
    FROM d WHERE trim(a) <> ''""",
)
def stored_boolean(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("a")
    return dirty(spark, d).filter(F.trim(v) != "").select(line_key().alias("row_key"), v.alias("value"), (~C.not_stored_boolean(v)).alias("valid"), C.stored_boolean(v, "stored").alias("enabled"))


@R.add(
    "chk5_check_code_range",
    """WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey % 20 AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN '-' || o_custkey ELSE '0' || (o_custkey % 16) || CASE WHEN o_custkey % 3 = 0 THEN 'x' ELSE '' END END AS v
      FROM orders WHERE o_orderstatus = 'F'),
    e AS (SELECT *, CASE WHEN regexp_full_match(v, '-[0-9]+') THEN (256 - CAST(substr(v, 2) AS BIGINT) % 256) % 256 WHEN regexp_full_match(v, '[0-9]+') THEN CAST(v AS BIGINT) % 256 END AS f,
      regexp_full_match(v, '[+-]?[0-9]+') AS num FROM d)
    SELECT CAST(o_orderkey AS VARCHAR) AS row_key, v AS value,
      CASE WHEN NOT num THEN 'not-integer' WHEN v LIKE '-%' AND f BETWEEN 0 AND 15 THEN 'wraps-negative' WHEN v LIKE '-%' THEN 'negative' WHEN f BETWEEN 0 AND 15 THEN 'wraps-into-range' ELSE 'falls-back' END AS code,
      CAST(CASE WHEN num AND f BETWEEN 0 AND 15 THEN f ELSE 1 END AS VARCHAR) AS effective
    FROM e WHERE NOT coalesce(num AND v NOT LIKE '-%' AND TRY_CAST(v AS BIGINT) BETWEEN 0 AND 15, false)""",
)
def check_code_range(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey")
    text = c.cast("string")
    v = F.when(k == 0, (c % 20).cast("string")).when(k == 1, text).when(k == 2, F.concat(F.lit("-"), text)).otherwise(F.concat(F.lit("0"), (c % 16).cast("string"), F.when(c % 3 == 0, "x").otherwise("")))
    rows = table(spark, d, "orders").withColumn("v", v)
    return C.check_code_range(rows, "orders", row_key("o_orderkey"), "v", when=F.col("o_orderstatus") == "F").select("row_key", "value", "code", F.col("args")["effective"].alias("effective"))


@R.add(
    "chk6_check_uint",
    f"""WITH d AS ({DIRTY_SQL})
    SELECT {KEY_SQL} AS row_key, a AS value, CAST(CASE WHEN a LIKE '-%' THEN (256 - l_partkey % 256) % 256 ELSE l_partkey % 256 END AS VARCHAR) AS stored
    FROM d WHERE regexp_full_match(a, '[+-]?[0-9]+') AND (l_partkey > 255 OR (a LIKE '-%' AND l_partkey <> 0))""",
)
def check_uint(spark: SparkSession, d: str) -> DataFrame:
    long = C.melt(dirty(spark, d), line_key(), ["a"])
    return C.check_uint(long, "lineitem", ["a"], 8).select("row_key", "value", F.col("args")["stored"].alias("stored"))


@R.add(
    "chk7_8_check_lengths",
    """SELECT CAST(doc_id AS VARCHAR) AS row_key, 'max-bytes' AS rule, CAST(octet_length(encode(text)) AS VARCHAR) AS amount FROM documents WHERE octet_length(encode(text)) >= 4096
    UNION ALL SELECT CAST(doc_id AS VARCHAR), 'max-chars', CAST(length(text) - 2000 AS VARCHAR) FROM documents WHERE length(text) > 2000""",
)
def check_lengths(spark: SparkSession, d: str) -> DataFrame:
    long = C.melt(table(spark, d, "documents"), row_key("doc_id"), ["text"])
    found = C.check_max_bytes(long, "documents", ["text"], 4096).unionByName(C.check_max_chars(long, "documents", ["text"], 2000))
    return found.select("row_key", "rule", F.coalesce(F.col("args")["over"], F.col("args")["bytes"]).alias("amount"))


@R.add(
    "chk12_whitespace_hint",
    f"""WITH d AS ({DIRTY_SQL})
    SELECT {KEY_SQL} AS row_key, CAST(length(a) - length(ltrim(a, ' ')) AS BIGINT) AS leading, CAST(length(a) - length(rtrim(a, ' ')) AS BIGINT) AS trailing, replace(a, ' ', '␠') AS visible FROM d WHERE a LIKE ' %'""",
)
def whitespace_hint(spark: SparkSession, d: str) -> DataFrame:
    rows = dirty(spark, d).filter(F.col("a").startswith(" ")).select(line_key().alias("row_key"), F.col("a").alias("value"))
    return C.with_whitespace_hint(rows).select("row_key", F.col("leading").cast("long"), F.col("trailing").cast("long"), "visible")


@R.add("flt1_2_drop_comment_rows", f"WITH d AS ({DIRTY_SQL}) SELECT l_orderkey % 100 AS part, CAST(count(*) AS BIGINT) AS n, CAST(count(CASE WHEN trim(b) = '' THEN 1 END) AS BIGINT) AS n_blank FROM d WHERE NOT (ltrim(a) LIKE '*%') GROUP BY 1")
def comment_rows(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_comment_rows(dirty(spark, d), "a").groupBy((F.col("l_orderkey") % 100).alias("part")).agg(F.count("*").alias("n"), F.count_if(S.is_blank(F.col("b"))).alias("n_blank"))


@R.add("flt3_active_rows", "SELECT o_orderkey, o_orderstatus FROM orders WHERE CASE o_orderstatus WHEN 'F' THEN ' 0' WHEN 'O' THEN '1' ELSE ' ' END = '1'")
def active(spark: SparkSession, d: str) -> DataFrame:
    flag = F.when(F.col("o_orderstatus") == "F", " 0").when(F.col("o_orderstatus") == "O", "1").otherwise(" ")
    return C.active_rows(table(spark, d, "orders").withColumn("enabled", flag), "enabled").select("o_orderkey", "o_orderstatus")


@R.add("prj1_2_column_values", "SELECT p_name AS value, 'filtered' AS kind FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) UNION ALL SELECT p_type, 'all' FROM part WHERE trim(p_type) <> ''")
def values(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    least = part.agg(F.min("p_brand")).first()[0] or ""
    return C.filtered_column_values(part, "p_name", "p_brand", least).withColumn("kind", F.lit("filtered")).unionByName(C.column_values(part, "p_type").withColumn("kind", F.lit("all")))


@R.add("prj3_melt", "SELECT CAST(c_custkey AS VARCHAR) AS row_key, 'c_name' AS col, c_name AS value FROM customer UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'c_mktsegment', c_mktsegment FROM customer")
def melted(spark: SparkSession, d: str) -> DataFrame:
    return C.melt(table(spark, d, "customer"), row_key("c_custkey"), ["c_name", "c_mktsegment"])


@R.add("prj5_display_context", f"WITH d AS ({DIRTY_SQL}) SELECT {KEY_SQL} AS row_key, CASE WHEN trim(c) <> '' THEN trim(c) WHEN trim(b) <> '' THEN trim(b) WHEN trim(a) <> '' THEN trim(a) END AS display FROM d")
def display(spark: SparkSession, d: str) -> DataFrame:
    return C.display_context(dirty(spark, d), line_key(), ["c", "b", "a"])


@R.add(
    "scl_text_functions",
    """SELECT p_partkey, translate(upper(p_name), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low, lower(hex(encode(rpad(substr(p_name, 1, 4), 4, ' ')))) AS key4, rpad(substr(p_name, 1, 4), 4, ' ') AS shown,
      CAST(length(p_name) AS BIGINT) AS units, (p_partkey * 977) % 256 AS wrapped, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '"' || p_name END AS bare,
      CAST(CASE p_size % 4 WHEN 0 THEN p_size WHEN 1 THEN 0 WHEN 2 THEN 31 ELSE NULL END AS DOUBLE) AS number FROM part""",
)
def text_functions(spark: SparkSession, d: str) -> DataFrame:
    name, size = F.col("p_name"), F.col("p_size")
    quoted = F.when(size % 2 == 0, F.concat(F.lit('"'), name, F.lit('"'))).otherwise(F.concat(F.lit('"'), name))
    loose = F.when(size % 4 == 0, F.concat(F.lit(" "), size.cast("string"))).when(size % 4 == 1, " ").when(size % 4 == 2, "0x1f").otherwise("x")
    number = S.text_number(loose)
    return table(spark, d, "part").select(
        "p_partkey", S.ascii_lower(F.upper(name)).alias("low"), S.fixed4_key(name).alias("key4"), S.fixed4_display(name).alias("shown"), S.utf16_len(name).cast("long").alias("units"),
        S.wrap_uint((F.col("p_partkey") * 977).cast("string"), 8).alias("wrapped"), S.strip_outer_quotes(quoted).alias("bare"), F.when(~F.isnan(number), number).alias("number"),
    )


@R.add(
    "scl_html_to_text",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '(?i)<li[^>]*>', chr(10) || '- ', 'g'), '<[^>]*>', '', 'g'), ' ') AS text,
      regexp_extract(url, '([^/]*)$', 1) AS tail FROM pages""",
)
def html(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", S.html_to_text(F.col("html")).alias("text"), F.regexp_extract("url", r"([^/]*)$", 1).alias("tail"))


@R.add(
    "scl_format_description",
    r"""SELECT doc_id, regexp_replace(regexp_replace(replace(text, chr(10), '<br>') || '$!parts#' || source || '!$', '(?i)<br\s*/?>', chr(10) || chr(10), 'g'), '\$!([^#!]+)#([^!]+)!\$', '**\2** (\1)', 'g') AS text FROM documents""",
)
def description(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.replace("text", F.lit("\n"), F.lit("<br>")), F.lit("$!parts#"), F.col("source"), F.lit("!$"))
    return table(spark, d, "documents").select("doc_id", S.format_description(text).alias("text"))
