"""Queries of sources, overlays and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcheck.plans.compile import RuleSet
from gridcheck.plans.contract import Contract
from gridcheck.plans.isolated import validate_to
from gridcheck.queries.base import Registry, table
from gridcheck.sources import text_tables as S
from gridcheck.sources.text_source import read_text_tables
from gridcheck.storage import shared_dir
from gridcheck.streaming import streams as X
from gridcheck.streaming.revalidate import Revalidation
from gridcheck.streaming.unique import STATE_STORE, stream_check_unique
from gridcheck.violations import row_key, violations

R = Registry()


@R.add("src3_nation_round_trip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Nations as tab-separated lines, parsed back."""
    rows = table(spark, d, "nation").select(F.array_join(F.array(F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string")), "\t").alias("line"))
    text = rows.agg(F.array_join(F.sort_array(F.collect_list("line")), "\r\n").alias("body")).select(F.lit("nation.txt").alias("path"), F.concat(F.lit("N_NATIONKEY\tn_name\tn_regionkey\r\n"), "body").alias("text"))
    wide = S.wide_rows(S.cells_of(S.text_lines(text)), ["n_nationkey", "n_name", "n_regionkey"])
    return wide.select(F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int"))


@R.add("src3_order_files", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def order_files(spark: SparkSession, d: str) -> DataFrame:
    """Orders as tab-separated files of a range of a thousand keys each, parsed back."""
    rows = table(spark, d, "orders").select(F.expr("o_orderkey div 1000").alias("path"), F.struct("o_orderkey", F.array_join(F.array(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"), "o_orderpriority"), "\t").alias("line")).alias("row"))
    body = F.array_join(F.transform(F.sort_array(F.collect_list("row")), lambda r: r["line"]), "\r\n")
    text = rows.groupBy("path").agg(F.concat(F.lit("O_ORDERKEY\to_custkey\to_orderpriority\r\n"), body).alias("text"))
    wide = S.wide_rows(S.cells_of(S.text_lines(text)), ["o_orderkey", "o_custkey", "o_orderpriority"])
    return wide.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), "o_orderpriority")


@R.add("src3_text_source", "SELECT CAST(length(line) AS INTEGER) AS length, count(*) AS n FROM (SELECT unnest(string_split(replace(text, chr(13), ' '), chr(10))) AS line FROM documents WHERE text IS NOT NULL) GROUP BY 1")
def text_source(spark: SparkSession, d: str) -> DataFrame:
    """All lines of all documents written as text files, and read through the data source in parts of 64 KB; a file that can't be read is an error."""
    at = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    table(spark, d, "documents").filter("text IS NOT NULL").select(F.explode(F.split(F.translate("text", "\r", " "), "\n", -1)).alias("value")).write.text(at)
    found = read_text_tables(spark, at, partBytes=1 << 16, encoding="utf-8")
    unread = F.raise_error(F.concat("path", F.lit(": "), "error")).cast("int")
    return found.groupBy(F.when(F.col("error").isNull(), F.length("content")).otherwise(unread).alias("length")).agg(F.count("*").alias("n"))


@R.add("src3_document_lines", "SELECT doc_id, CAST(count(*) AS BIGINT) AS n_cells, CAST(max(length(cell)) AS BIGINT) AS longest FROM (SELECT doc_id, unnest(string_split(line, ' ')) AS cell FROM (SELECT doc_id, unnest(string_split(text, chr(10))[2:]) AS line FROM documents)) GROUP BY doc_id")
def document_lines(spark: SparkSession, d: str) -> DataFrame:
    cells = S.cells_of(S.text_lines(table(spark, d, "documents").select("doc_id", "text")), " ", ["doc_id"])
    return cells.groupBy("doc_id").agg(F.count("*").alias("n_cells"), F.max(F.length("value")).cast("long").alias("longest"))


@R.add("src6_overlay_rows", "SELECT p_partkey, 'patch' AS tier, p_size FROM part WHERE p_partkey % 5 = 0 UNION ALL SELECT p_partkey, 'base', p_size FROM part WHERE p_partkey % 5 <> 0 AND p_size <= 30")
def overlay(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    base, patch = part.filter("p_size <= 30").select("p_partkey", F.lit("base").alias("tier"), "p_size"), part.filter("p_partkey % 5 = 0").select("p_partkey", F.lit("patch").alias("tier"), "p_size")
    return S.overlay_rows(base, patch, "p_partkey")


@R.add(
    "src6_overlay_sources",
    """WITH c AS (SELECT CAST(o_custkey % 10 AS VARCHAR) AS scope, CAST(o_custkey AS VARCHAR) AS stem, CAST(o_orderkey AS VARCHAR) AS path, CAST(o_orderkey % 4 AS INTEGER) AS tier, o_orderstatus <> 'F' AS readable FROM orders),
    b AS (SELECT *, min(tier) OVER (PARTITION BY scope, stem) AS best FROM c) SELECT scope, stem, tier, min(path) AS path FROM b WHERE tier = best AND readable GROUP BY 1, 2, 3""",
)
def sources(spark: SparkSession, d: str) -> DataFrame:
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    return S.overlay_sources(table(spark, d, "orders").select((c % 10).cast("string").alias("scope"), c.cast("string").alias("stem"), o.cast("string").alias("path"), (o % 4).cast("int").alias("tier"), (F.col("o_orderstatus") != "F").alias("readable")))


@R.add("src9_load_rank", "SELECT doc_id, CAST(CASE source WHEN 'src3' THEN 1 WHEN 'src1' THEN 2 ELSE 3 END AS INTEGER) AS load_rank FROM documents")
def rank(spark: SparkSession, d: str) -> DataFrame:
    return S.load_rank(table(spark, d, "documents"), ["src3", "src1"], "source").select("doc_id", "load_rank")


@R.add("src8_read_json_entries", "SELECT event_id, CAST(0 AS INTEGER) AS entry, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 5 <> 0")
def json_entries(spark: SparkSession, d: str) -> DataFrame:
    text = F.when(F.col("event_id") % 5 == 0, F.col("props")).otherwise(F.concat(F.lit("["), "props", F.lit("]")))
    files = table(spark, d, "events").select(F.col("event_id").alias("path"), text.alias("text"))
    return S.read_json_entries(files).select(F.col("file").alias("event_id"), "entry", F.try_variant_get("v", "$.k", "bigint").alias("k"))


def _streamed(spark: SparkSession, d: str, change, mode: str = "append", settings: dict[str, str] | None = None) -> DataFrame:
    """What a stream over ``events`` leaves in a table when all files are read; ``settings`` hold while it runs."""
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    events = spark.read.parquet(f"{d}/events.parquet")
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    out = change(source)
    try:
        for k, v in (settings or {}).items():
            spark.conf.set(k, v)
        out.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(out.schema).parquet(f"{at}/out")


@R.add("str1_stream_check_columns", "SELECT CAST(event_id AS VARCHAR) AS row_key, CAST(user_id AS VARCHAR) AS value FROM events WHERE user_id NOT IN (0, 1)")
def stream_columns(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, lambda s: X.stream_check_columns(s, "events", row_key("event_id"), {"user_id": "boolean"})).select("row_key", "value")


@R.add("str2_stream_check_reference", "SELECT CAST(event_id AS VARCHAR) AS row_key, CAST(user_id AS VARCHAR) AS value FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0)")
def stream_reference(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer").filter("c_custkey % 3 = 0")
    return _streamed(spark, d, lambda s: X.stream_check_reference(s, "events", row_key("event_id"), "user_id", customers, "c_custkey")).select("row_key", "value")


@R.add("str3_stream_without_repeats", "SELECT CAST(count(DISTINCT user_id) AS BIGINT) AS n_users FROM events")
def stream_repeats(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, lambda s: X.without_repeats(s, ["user_id"], "ts", "3650 days").select("user_id")).agg(F.count("*").alias("n_users"))


@R.add("str3_stream_check_unique", "SELECT CAST(event_id AS VARCHAR) AS row_key, first FROM (SELECT event_id, first_value(CAST(event_id AS VARCHAR)) OVER (PARTITION BY user_id ORDER BY ts, CAST(event_id AS VARCHAR)) AS first FROM events) WHERE CAST(event_id AS VARCHAR) <> first")
def stream_unique(spark: SparkSession, d: str) -> DataFrame:
    return _streamed(spark, d, lambda s: stream_check_unique(s, "events", "user_id", row_key("event_id"), "ts", "3650 days"), settings=STATE_STORE).select("row_key", F.col("args")["first"].alias("first"))


@R.add(
    "str4_live_revalidation",
    """WITH l AS (SELECT l_orderkey || '|' || l_linenumber AS row_key, p_size, l_partkey FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT 0 AS batch, row_key, 'new' AS status, count(*) AS n FROM l WHERE p_size > 25 GROUP BY row_key, l_partkey UNION ALL SELECT 1, row_key, 'resolved', count(*) FROM l WHERE p_size BETWEEN 26 AND 40 GROUP BY row_key, l_partkey""",
)
def live_revalidation(spark: SparkSession, d: str) -> DataFrame:
    at = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    part, line = table(spark, d, "part"), table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    line.write.parquet(f"{at}/lineitem")
    part.filter("p_size <= 25").write.parquet(f"{at}/part")
    contract = Contract.of({"tables": {"lineitem": {"key": ["l_orderkey", "l_linenumber"], "columns": [{"name": "l_partkey", "type": {"type": "int", "table": "part", "column": "p_partkey"}}]}}})
    live = Revalidation(spark, {"lineitem": f"{at}/lineitem", "part": f"{at}/part"}, {"lineitem": line.schema, "part": part.schema}, contract, f"{at}/store")
    live.start().awaitTermination()
    part.filter("p_size BETWEEN 26 AND 40").write.mode("append").parquet(f"{at}/part")
    live.start().awaitTermination()
    return live.differences().select("batch", "row_key", "status", "n")


@R.add(
    "udf5_isolated_rules",
    """SELECT CAST(p_partkey AS VARCHAR) AS row_key, 'price' AS rule, 'high' AS code FROM part WHERE p_retailprice > 1500 UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'type', 'diag.integer.invalid' FROM part
    UNION ALL SELECT 'fails-in-tasks', 'fails-in-tasks', 'rule-error' UNION ALL SELECT 'fails-in-plan', 'fails-in-plan', 'rule-error'""",
)
def isolated_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = RuleSet()
    of = lambda df, name, code: violations(df, "part", name, code, row_key=row_key("p_partkey"))
    rules.rule("fails-in-tasks")(lambda t, c: of(t.table("part").filter(F.when(F.col("p_partkey") % 7 == 3, F.raise_error(F.lit("a fault in a task")).cast("boolean")).otherwise(True)), "fails-in-tasks", "x"))
    rules.rule("fails-in-plan")(lambda t, c: of(t.table("part").filter("no_such_column > 1"), "fails-in-plan", "x"))
    rules.rule("price")(lambda t, c: of(t.table("part").filter("p_retailprice > 1500"), "price", "high"))
    contract = Contract.of({"tables": {"part": {"key": ["p_partkey"], "columns": [{"name": "p_name", "type": "int"}]}}})
    found, _ = validate_to(f"{shared_dir(spark)}/isolated-{uuid.uuid4().hex}", contract, {"part": table(spark, d, "part")}, rules)
    return found.select("row_key", "rule", "code")


@R.add("str5_severity_counts", "SELECT date_trunc('day', ts) AS day, CASE WHEN value > 50 THEN 'error' ELSE 'warning' END AS severity, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark: SparkSession, d: str) -> DataFrame:
    severity = F.when(F.col("value") > 50, "error").otherwise("warning")
    name = f"counts_{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{d}/events.parquet")
    source = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    out = X.stream_severity_counts(source.withColumn("severity", severity), "ts", "1 day", "1 hour")
    out.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("day"), "severity", "n")


@R.add(
    "src5_verify_manifest",
    """WITH f AS (SELECT source || '/' || doc_id || '.txt' AS path, doc_id, text, octet_length(encode(text)) AS n FROM documents)
    SELECT path, CASE doc_id % 11 WHEN 0 THEN 'not-listed' WHEN 1 THEN 'size' WHEN 2 THEN 'sha256' ELSE 'missing' END AS code FROM f WHERE doc_id % 11 < 3 OR doc_id % 11 = 3""",
)
def manifest(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 11
    docs = table(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    size, sha = F.octet_length("content").cast("long"), F.sha2("content", 256)
    listed = docs.filter(k != 0).select(F.lit("docs").alias("dataset"), "path", (size + F.when(k == 1, 1).otherwise(0)).alias("bytes"), F.lit("utf-8").alias("encoding"), F.when(k == 2, F.reverse(sha)).otherwise(F.upper(sha)).alias("sha256"))
    return S.verify_manifest(docs.filter(k != 3).select("path", "content"), listed)


@R.add("src5_dataset_digests", "SELECT source AS dataset, CAST(count(*) AS BIGINT) AS files, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, sha256(string_agg(sha256(text) || '  ' || lower('D/' || doc_id) || chr(10), '' ORDER BY lower('D/' || doc_id))) AS digest FROM documents GROUP BY source")
def digests(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    listed = docs.select(F.col("source").alias("dataset"), F.concat(F.lit("D/"), F.col("doc_id").cast("string")).alias("path"), F.octet_length("text").cast("long").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    return S.dataset_digests(listed)


@R.add("src7_10_with_scope", "SELECT page_id, regexp_extract(url, '^(.*)[/][^/]*$', 1) AS scope, lower(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)[.][^.]*$', '\\1')) AS stem FROM pages")
def scope(spark: SparkSession, d: str) -> DataFrame:
    from gridcheck.functions.scalar import path_stem

    return S.with_scope(table(spark, d, "pages").withColumnRenamed("url", "path")).select("page_id", "scope", path_stem(F.col("path")).alias("stem"))


@R.add("src10_data_roots", "SELECT page_id, CASE page_id % 3 WHEN 2 THEN '' ELSE 'root' || page_id % 5 || '/data' END AS scope FROM pages")
def data_roots(spark: SparkSession, d: str) -> DataFrame:
    """Tables by the folder above ``global/excel``, in any case; what lies elsewhere has none."""
    k = F.col("page_id")
    below = F.when(k % 3 == 0, "/global/excel/base/").when(k % 3 == 1, "/Global/EXCEL/").otherwise("/other/")
    return S.with_scope(table(spark, d, "pages").select("page_id", F.concat(F.lit("root"), (k % 5).cast("string"), F.lit("/data"), below, F.lit("a.txt")).alias("path")), "global/excel").select("page_id", "scope")


@R.add("scl8_variant_text", "SELECT event_id, CASE event_id % 6 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN 't' || event_id WHEN 2 THEN 'true' WHEN 3 THEN 'null' WHEN 4 THEN event_id || ',,x' ELSE '[object Object]' END AS said FROM events")
def variant_texts(spark: SparkSession, d: str) -> DataFrame:
    from gridcheck.functions.scalar import variant_text

    k = F.col("event_id").cast("string")
    js = F.when(F.col("event_id") % 6 == 0, k).when(F.col("event_id") % 6 == 1, F.concat(F.lit('"t'), k, F.lit('"'))).when(F.col("event_id") % 6 == 2, "true").when(F.col("event_id") % 6 == 3, "null").when(F.col("event_id") % 6 == 4, F.concat(F.lit("["), k, F.lit(', null, "x"]'))).otherwise('{"a": 1}')
    return table(spark, d, "events").select("event_id", variant_text(F.parse_json(js)).alias("said"))


@R.add("src2_decode_text", "SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'utf-16-le' WHEN 1 THEN 'utf-8-bom' ELSE 'utf-8' END AS detected_encoding FROM documents WHERE doc_id % 4 <> 3 UNION ALL SELECT doc_id, text, CASE doc_id % 3 WHEN 0 THEN 'utf-16-le' WHEN 1 THEN 'utf-8-bom' ELSE 'utf-8' END FROM documents WHERE doc_id % 4 = 3")
def decoded(spark: SparkSession, d: str) -> DataFrame:
    k, t = F.col("doc_id") % 3, F.col("text")
    content = F.when(k == 0, F.concat(F.unhex(F.lit("FFFE")), F.encode(t, "UTF-16LE"))).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(t, "UTF-8"))).otherwise(F.encode(t, "UTF-8"))
    return S.decode_text(table(spark, d, "documents").select("doc_id", content.alias("content"))).select("doc_id", "text", "detected_encoding")


@R.add("agg7_load_stats", "SELECT CAST(count(*) AS BIGINT) AS discovered, CAST(count(CASE WHEN doc_id % 5 <> 0 THEN 1 END) AS BIGINT) AS parsed, CAST(count(CASE WHEN doc_id % 5 = 0 THEN 1 END) AS BIGINT) AS failed FROM documents")
def stats(spark: SparkSession, d: str) -> DataFrame:
    mark = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE"), F.when(F.col("doc_id") % 5 == 0, F.unhex(F.lit("41"))).otherwise(F.unhex(F.lit(""))))
    return S.load_stats(S.decode_text(table(spark, d, "documents").select(mark.alias("content"))))


@R.add(
    "src4_header_map",
    "SELECT CAST(l_orderkey AS VARCHAR) AS path, lower(l_linestatus || l_returnflag) AS name, CAST(min(l_linenumber) AS INTEGER) AS first_idx, CAST(max(l_linenumber) AS INTEGER) AS last_idx FROM lineitem GROUP BY ALL",
)
def header_map(spark: SparkSession, d: str) -> DataFrame:
    # the headers of a file repeat, in upper or lower case; some are empty
    line = table(spark, d, "lineitem")
    name = F.concat("l_linestatus", "l_returnflag")
    cells = line.select(F.col("l_orderkey").cast("string").alias("path"), F.when(F.col("l_linenumber") % 2 == 0, name).otherwise(F.lower(name)).alias("col_name"), F.col("l_linenumber").alias("col_idx"))
    hidden = line.select(F.col("l_orderkey").cast("string").alias("path"), F.lit("").alias("col_name"), (F.col("l_linenumber") + 10).alias("col_idx"))
    return S.header_map(cells.unionByName(hidden))
