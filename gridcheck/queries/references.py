"""Queries of reference checks and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcheck.operators import columns as C
from gridcheck.operators import entries as E
from gridcheck.operators import refs as X
from gridcheck.operators import unique as U
from gridcheck.queries.base import Registry, table
from gridcheck.violations import row_key

R = Registry()


@R.add("ref1_check_reference", "SELECT l_orderkey || '|' || l_linenumber AS row_key, CAST(l_partkey AS VARCHAR) AS value, 'unresolved' AS code, 'error' AS severity FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p_size <= 25 AND p_partkey = l_partkey)")
def check_reference(spark: SparkSession, d: str) -> DataFrame:
    target = X.keys_of(table(spark, d, "part").filter("p_size <= 25"), "p_partkey")
    long = C.melt(table(spark, d, "lineitem"), row_key("l_orderkey", "l_linenumber"), ["l_partkey"])
    return X.check_reference(long, "lineitem", target, "part.p_partkey").select("row_key", "value", "code", "severity")


@R.add(
    "ref1_11_case_and_trim",
    """WITH s AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN upper(n_name) WHEN 1 THEN lower(n_name) WHEN 2 THEN ' ' || n_name ELSE n_name || '?' END AS v FROM customer JOIN nation ON n_nationkey = c_nationkey)
    SELECT CAST(c_custkey AS VARCHAR) AS row_key, v AS value, trim(lower(v)) IN (SELECT lower(n_name) FROM nation) AS trimmed_match FROM s WHERE lower(v) NOT IN (SELECT lower(n_name) FROM nation)""",
)
def case_and_trim(spark: SparkSession, d: str) -> DataFrame:
    nation, k, n = table(spark, d, "nation"), F.col("c_custkey") % 4, F.col("n_name")
    v = F.when(k == 0, F.upper(n)).when(k == 1, F.lower(n)).when(k == 2, F.concat(F.lit(" "), n)).otherwise(F.concat(n, F.lit("?")))
    rows = table(spark, d, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", v.alias("nation"))
    keys = X.keys_of(nation, "n_name")
    found = X.check_reference(C.melt(rows, row_key("c_custkey"), ["nation"]), "customer", keys, "nation.n_name")
    return X.with_trim_hint(found, keys).select("row_key", "value", "trimmed_match")


@R.add(
    "ref2_fixed4",
    """WITH w AS (SELECT doc_id, split_part(text, ' ', 1) AS word FROM documents), k AS (SELECT doc_id, word, substr(hex(encode(word)) || '20202020', 1, 8) AS key FROM w WHERE trim(translate(word, chr(9) || chr(10) || chr(13), '   ')) <> '')
    SELECT CAST(doc_id AS VARCHAR) AS row_key, word AS value FROM k WHERE key NOT IN (SELECT key FROM k WHERE doc_id % 10 = 0)""",
)
def fixed4(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "documents").select("doc_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("word"))
    keys = X.keys_of(words.filter("doc_id % 10 = 0"), "word", "fixed4")
    return X.check_reference(C.melt(words, row_key("doc_id"), ["word"]), "documents", keys, "documents.word", "fixed4").select("row_key", "value")


@R.add("ref3_check_reference_any", "SELECT CAST(event_id AS VARCHAR) AS row_key, CAST(user_id AS VARCHAR) AS value FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0 UNION SELECT s_suppkey FROM supplier WHERE s_suppkey % 2 = 0)")
def reference_any(spark: SparkSession, d: str) -> DataFrame:
    keys = X.union_keys([(table(spark, d, "customer").filter("c_custkey % 3 = 0"), "c_custkey"), (table(spark, d, "supplier").filter("s_suppkey % 2 = 0"), "s_suppkey")])
    return X.check_reference(C.melt(table(spark, d, "events"), row_key("event_id"), ["user_id"]), "events", keys, "customer|supplier").select("row_key", "value")


@R.add(
    "ref4_resolve_tiered",
    """WITH s AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN substr(p_brand, 1, 4) ELSE upper(p_name) END AS v FROM part),
    t AS (SELECT p_partkey, v, (SELECT min(p_type) FROM part b WHERE b.p_size <= 20 AND b.p_type = v) AS a, CASE WHEN length(v) <= 4 THEN (SELECT min(p_brand) FROM part b WHERE b.p_size > 20 AND substr(b.p_brand, 1, 4) = v) END AS b,
      (SELECT min(p_name) FROM part b WHERE b.p_size <= 40 AND lower(b.p_name) = lower(v)) AS c FROM s)
    SELECT p_partkey, v, CASE WHEN a IS NOT NULL THEN 'keyword' WHEN b IS NOT NULL THEN 'code' WHEN c IS NOT NULL THEN 'name' END AS kind, coalesce(a, b, c) AS target_value FROM t""",
)
def tiered(spark: SparkSession, d: str) -> DataFrame:
    part, k = table(spark, d, "part"), F.col("p_partkey") % 3
    rows = part.select("p_partkey", F.when(k == 0, F.col("p_type")).when(k == 1, F.substring("p_brand", 1, 4)).otherwise(F.upper("p_name")).alias("v"))
    tiers = [("keyword", part.filter("p_size <= 20"), "p_type", "exact"), ("code", part.filter("p_size > 20"), "p_brand", "fixed4"), ("name", part.filter("p_size <= 40"), "p_name", "ascii-ci")]
    return X.resolve_tiered(rows, "v", tiers).select("p_partkey", "v", "kind", "target_value")


@R.add("ref6_check_enum", "SELECT CAST(o_orderkey AS VARCHAR) AS row_key, o_orderpriority AS value FROM orders WHERE lower(o_orderpriority) NOT IN ('1-urgent', '2-high', '5-low')")
def enum(spark: SparkSession, d: str) -> DataFrame:
    long = C.melt(table(spark, d, "orders"), row_key("o_orderkey"), ["o_orderpriority"])
    return X.check_enum(long, "orders", ["1-URGENT", "2-HIGH", "5-low"]).select("row_key", "value")


@R.add(
    "ref7_8_locations",
    """WITH k AS (SELECT lower(p_name) AS name, max(p_partkey) AS last, min(p_partkey) AS first FROM part GROUP BY 1)
    SELECT p_partkey, last AS target_line, first AS first_line FROM part JOIN k ON lower(p_name) = name""",
)
def locations(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    first = X.first_occurrence(part, "p_name", "p_partkey")
    return X.resolve_location(part, "p_name", part, "p_name", "p_partkey").join(first, F.lower("p_name") == F.col("key")).select("p_partkey", "target_line", "first_line")


@R.add(
    "ref9_forward_reference",
    """WITH r AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey + 5 WHEN o_orderkey % 3 = 1 THEN o_orderkey ELSE o_orderkey - 7 END AS ref FROM orders)
    SELECT CAST(o_orderkey AS VARCHAR) AS row_key, CAST(ref AS VARCHAR) AS value, CASE WHEN NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = ref) THEN 'unresolved-base' ELSE 'forward-reference' END AS code
    FROM r WHERE ref > o_orderkey OR NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_orderkey = ref)""",
)
def forward(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, d, "orders").select("o_orderkey", k.alias("line"), F.when(k % 3 == 0, k + 5).when(k % 3 == 1, k).otherwise(k - 7).alias("ref"))
    return X.check_forward_reference(rows, "orders", "o_orderkey", "ref", "line").select("row_key", "value", "code")


@R.add(
    "ref10_expand_keys",
    """SELECT l_orderkey || '|' || l_linenumber AS row_key, p_brand || (l_linenumber * 3) || CASE WHEN l_linenumber > 5 THEN 'x' ELSE '' END AS value FROM lineitem JOIN part ON p_partkey = l_partkey
    WHERE p_brand NOT IN (SELECT p_brand FROM part WHERE p_size - 25 <> 0 AND p_partkey % 7 = 1) OR l_linenumber > 5""",
)
def expanded(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    keys = X.expand_keys(part.filter("p_partkey % 7 = 1").withColumn("flag", F.col("p_size") - 25), "p_brand", "flag")
    value = F.concat("p_brand", (F.col("l_linenumber") * 3).cast("string"), F.when(F.col("l_linenumber") > 5, "x").otherwise(""))
    rows = table(spark, d, "lineitem").join(part, F.col("p_partkey") == F.col("l_partkey")).withColumn("code", value)
    return X.check_reference(C.melt(rows, row_key("l_orderkey", "l_linenumber"), ["code"]), "lineitem", keys, "part.levels", "exact").select("row_key", "value")


@R.add("ref12_enrich", "SELECT l_orderkey, l_linenumber, l_partkey, p_name AS part_name, n_name AS nation FROM lineitem LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN nation ON n_nationkey = s_nationkey")
def enriched(spark: SparkSession, d: str) -> DataFrame:
    rows = X.enrich(table(spark, d, "lineitem"), "l_partkey", table(spark, d, "part"), "p_partkey", {"part_name": "p_name"}, "p_partkey", "exact")
    rows = X.enrich(rows, "l_suppkey", table(spark, d, "supplier"), "s_suppkey", {"nationkey": "s_nationkey"}, "s_suppkey", "exact")
    return X.enrich(rows, "nationkey", table(spark, d, "nation"), "n_nationkey", {"nation": "n_name"}, "n_nationkey", "exact").select("l_orderkey", "l_linenumber", "l_partkey", "part_name", "nation")


@R.add("ref13_check_unused", "SELECT CAST(doc_id AS VARCHAR) AS row_key FROM documents WHERE doc_id > 100 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def unused(spark: SparkSession, d: str) -> DataFrame:
    docs, used = table(spark, d, "documents"), table(spark, d, "labels").select(F.col("doc_id").cast("string").alias("key"))
    return E.check_unused(docs.select("doc_id"), used, "documents", F.col("doc_id").cast("double"), F.col("doc_id"), row_key("doc_id"), 100).select("row_key")


@R.add("ref14_collect_used", "SELECT DISTINCT key FROM (SELECT CAST(r_regionkey AS VARCHAR) AS key FROM region UNION ALL SELECT r_name FROM region UNION ALL SELECT n_name FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT CAST(n_regionkey AS VARCHAR) FROM nation UNION ALL SELECT unnest(regexp_extract_all(replace(text, ' ', ' @'), '@([A-Za-z0-9_]+)', 1)) FROM conversations) WHERE key <> ''")
def used(spark: SparkSession, d: str) -> DataFrame:
    texts = table(spark, d, "conversations").select(F.replace("text", F.lit(" "), F.lit(" @")).alias("text"))
    return E.collect_used({"region": table(spark, d, "region"), "nation": table(spark, d, "nation")}, texts)


@R.add(
    "ref14_ragged_evidence",
    """WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL AND source <> 'web'),
    h AS (SELECT doc_id, unnest(list_concat(['*note', '@SkipDocs'], string_split(lines[1], ' '))) AS name, unnest(range(1, len(string_split(lines[1], ' ')) + 3)) AS i FROM l),
    c AS (SELECT doc_id, count(*) AS n FROM h WHERE name NOT LIKE '*%' GROUP BY doc_id), u AS (SELECT doc_id, max(i) AS i FROM h WHERE name NOT LIKE '*%' GROUP BY doc_id, lower(name)),
    x AS (SELECT doc_id, unnest(lines[2:]) AS line FROM l), r AS (SELECT doc_id, list_concat(['n', CASE WHEN length(line) % 2 = 0 THEN '' ELSE 'y' END], string_split(line, ' ')) AS cells FROM x),
    ok AS (SELECT r.doc_id, cells FROM r JOIN c ON r.doc_id = c.doc_id AND len(cells) >= n)
    SELECT DISTINCT cells[i] AS key FROM ok JOIN u ON ok.doc_id = u.doc_id WHERE cells[i] <> '' UNION SELECT 'true' FROM ok WHERE cells[2] <> ''""",
)
def ragged_evidence(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "documents").filter("text IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", F.posexplode(F.split("text", "\n", -1)).alias("line", "content"))
    words = F.split("content", " ", -1)
    headers = lines.filter("line = 0").select("doc_id", "source", F.concat(F.array(F.lit("*note"), F.lit("@SkipDocs")), words).alias("header"))
    rows = lines.filter("line > 0").select("doc_id", F.concat(F.array(F.lit("n"), F.when(F.length("content") % 2 == 0, "").otherwise("y")), words).alias("cells"))
    return E.collect_used_rows(rows, headers, file_cols=["doc_id"], stem=F.col("source"), excluded=["web"])


@R.add(
    "ref15_referential_summary",
    """SELECT 'lineitem' AS source_table, 'l_partkey' AS source_col, 'part' AS target_table, 'p_partkey' AS target_col, CAST(count(CASE WHEN p_partkey IS NOT NULL THEN 1 END) AS BIGINT) AS n_match, CAST(count(CASE WHEN p_partkey IS NULL THEN 1 END) AS BIGINT) AS n_miss FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey
    UNION ALL SELECT 'lineitem', 'l_orderkey', 'orders', 'o_orderkey', count(CASE WHEN o_orderkey IS NOT NULL THEN 1 END), count(CASE WHEN o_orderkey IS NULL THEN 1 END) FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey
    UNION ALL SELECT 'orders', 'o_custkey', 'customer', 'c_custkey', count(CASE WHEN c_custkey IS NOT NULL THEN 1 END), count(CASE WHEN c_custkey IS NULL THEN 1 END) FROM orders LEFT JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT 'nation', 'n_regionkey', 'region', 'r_regionkey', count(CASE WHEN r_regionkey IS NOT NULL THEN 1 END), count(CASE WHEN r_regionkey IS NULL THEN 1 END) FROM nation LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def summary(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return X.referential_summary([("lineitem", t("lineitem"), "l_partkey", "part", t("part").filter("p_size <= 25"), "p_partkey"), ("lineitem", t("lineitem"), "l_orderkey", "orders", t("orders"), "o_orderkey"), ("orders", t("orders"), "o_custkey", "customer", t("customer"), "c_custkey"), ("nation", t("nation"), "n_regionkey", "region", t("region"), "r_regionkey")])


@R.add(
    "agg1_check_unique",
    """WITH r AS (SELECT p_partkey, p_name, first_value(p_partkey) OVER (PARTITION BY lower(p_name) ORDER BY p_partkey) AS first FROM part WHERE trim(p_name) <> '')
    SELECT CAST(p_partkey AS VARCHAR) AS row_key, p_name AS value, CAST(first AS VARCHAR) AS first FROM r WHERE p_partkey <> first""",
)
def unique(spark: SparkSession, d: str) -> DataFrame:
    return U.check_unique(table(spark, d, "part"), "part", ["p_name"], "p_partkey", row_key("p_partkey")).select("row_key", "value", F.col("args")["first"].alias("first"))


@R.add(
    "agg1_unique_documents",
    """WITH r AS (SELECT doc_id, first_value(doc_id) OVER (PARTITION BY lower(text) ORDER BY doc_id) AS first FROM documents WHERE trim(text) <> '')
    SELECT CAST(doc_id AS VARCHAR) AS row_key, CAST(first AS VARCHAR) AS first FROM r WHERE doc_id <> first""",
)
def unique_documents(spark: SparkSession, d: str) -> DataFrame:
    return U.check_unique(table(spark, d, "documents"), "documents", ["text"], "doc_id", row_key("doc_id")).select("row_key", F.col("args")["first"].alias("first"))


@R.add("agg1_unique_key", "SELECT l_orderkey || '|' || l_linenumber AS row_key, CAST(count(*) AS VARCHAR) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def unique_key(spark: SparkSession, d: str) -> DataFrame:
    return U.check_unique_key(table(spark, d, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]).select("row_key", F.col("args")["count"].alias("n"))


@R.add("agg3_distinct_values", "SELECT DISTINCT 'part' AS \"table\", 'p_brand' AS col, translate(p_brand, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS value FROM part UNION SELECT DISTINCT 'part', 'p_type', translate(p_type, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM part UNION SELECT DISTINCT 'orders', 'o_orderpriority', translate(o_orderpriority, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM orders")
def distinct(spark: SparkSession, d: str) -> DataFrame:
    return U.distinct_values({"part": table(spark, d, "part").select("p_brand", "p_type"), "orders": table(spark, d, "orders").select("o_orderpriority")})


LOADED_SQL = """run AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS ids, CAST([] AS VARCHAR[]) AS id_files, CAST([] AS VARCHAR[]) AS keys, CAST([] AS VARCHAR[]) AS key_files, CAST(NULL AS BIGINT) AS doc_id, CAST(NULL AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS outcome
      UNION ALL SELECT n, CASE WHEN outcome = 'loaded' THEN list_append(ids, id) ELSE ids END, CASE WHEN outcome = 'loaded' THEN list_append(id_files, file) ELSE id_files END,
        CASE WHEN outcome = 'loaded' THEN list_append(keys, key) ELSE keys END, CASE WHEN outcome = 'loaded' THEN list_append(key_files, file) ELSE key_files END, doc_id, id, outcome
      FROM (SELECT o.n, run.ids, run.id_files, run.keys, run.key_files, o.doc_id, o.id, o.key, o.file,
          CASE WHEN coalesce(list_contains(run.ids, o.id), false) THEN 'duplicate-id' || CASE WHEN run.id_files[list_position(run.ids, o.id)] = o.file THEN '' ELSE '-cross-file' END
               WHEN coalesce(list_contains(run.keys, o.key), false) THEN 'duplicate-key' || CASE WHEN run.key_files[list_position(run.keys, o.key)] = o.file THEN '' ELSE '-cross-file' END
               ELSE 'loaded' END AS outcome
        FROM run JOIN o ON o.n = run.n + 1))"""


@R.add(
    "win2_load_duplicates",
    f"""WITH RECURSIVE o AS (SELECT doc_id, CAST(doc_id // 2 AS VARCHAR) AS id, sha256(text) AS key, coalesce(source, '') AS file, row_number() OVER (ORDER BY source NULLS LAST, doc_id) AS n FROM documents),
    {LOADED_SQL}
    SELECT doc_id, id, outcome FROM run WHERE n > 0""",
)
def loaded(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.expr("CAST(doc_id div 2 AS STRING)").alias("id"), F.sha2("text", 256).alias("key"), "source")
    return U.load_duplicates(docs, "id", "key", ["source", "doc_id"], "source").select("doc_id", "id", "outcome")


#: Ids of every JSON type, among them numbers that are equal in other forms, and keys that are texts, empty or numbers.
TYPED = [("0", "{m}"), ("1", '"{m}"'), ("2", "{m}.0"), ("3", "null"), ("4", "[{m}]"), ("5", "true"), ("6", "-0"), ("7", "0.0"), ("8", '{{"a": {m}}}'), ("9", "{m}e0")]
_SAME = "CASE doc_id % 10 WHEN 0 THEN 'n:' || (doc_id // 40) WHEN 2 THEN 'n:' || (doc_id // 40) WHEN 9 THEN 'n:' || (doc_id // 40) WHEN 1 THEN 's:' || (doc_id // 40) WHEN 3 THEN 'null' WHEN 5 THEN 'b:true' WHEN 6 THEN 'n:0' WHEN 7 THEN 'n:0' END"


@R.add(
    "win2_typed_identity",
    f"""WITH RECURSIVE o AS (SELECT doc_id, {_SAME} AS id, CASE doc_id % 3 WHEN 0 THEN 's:' || (doc_id // 7) WHEN 1 THEN NULL ELSE 'n:' || (doc_id // 7) END AS key, coalesce(source, '') AS file, row_number() OVER (ORDER BY source NULLS LAST, doc_id) AS n FROM documents),
    {LOADED_SQL}
    SELECT doc_id, outcome FROM run WHERE n > 0""",
)
def typed_identity(spark: SparkSession, d: str) -> DataFrame:
    m, k = F.expr("CAST(doc_id div 40 AS STRING)"), F.col("doc_id") % 10
    text = F.lit(None).cast("string")
    for at, form in TYPED:
        before, _, after = form.format(m="#").partition("#")
        text = F.when(k == int(at), F.concat(F.lit(before), m, F.lit(after)) if "{m}" in form else F.lit(form)).otherwise(text)
    key = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"'), F.expr("doc_id div 7"), F.lit('"'))).when(F.col("doc_id") % 3 == 1, '""').otherwise(F.expr("CAST(doc_id div 7 AS STRING)"))
    docs = table(spark, d, "documents").select("doc_id", "source", F.parse_json(text).alias("id"), F.parse_json(key).alias("key"))
    return U.load_duplicates(docs, "id", "key", ["source", "doc_id"], "source").select("doc_id", "outcome")


@R.add(
    "chk9_10_entries",
    """WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '{"id": ' || (event_id * 37) || ', "Key": "k"}' WHEN 1 THEN '{"Key": null}' WHEN 2 THEN '{"id": "s"}' ELSE '{"id": 5, "Key": ""}' END AS js FROM events)
    SELECT CAST(event_id AS VARCHAR) AS row_key, 'missing-fields' AS code FROM e WHERE event_id % 4 IN (1, 2)
    UNION ALL SELECT CAST(event_id AS VARCHAR), 'missing-id' FROM e WHERE event_id % 4 = 1 UNION ALL SELECT CAST(event_id AS VARCHAR), 'invalid-id-range' FROM e WHERE event_id % 4 = 0 AND event_id * 37 > 65535""",
)
def entries(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    js = F.when(k % 4 == 0, F.concat(F.lit('{"id": '), (k * 37).cast("string"), F.lit(', "Key": "k"}'))).when(k % 4 == 1, '{"Key": null}').when(k % 4 == 2, '{"id": "s"}').otherwise('{"id": 5, "Key": ""}')
    rows = table(spark, d, "events").select("event_id", js.alias("js"))
    return E.check_required_fields(rows, "entries", "js", ["id", "Key"], row_key("event_id")).unionByName(E.check_id_range(rows, "entries", "js", "id", row_key("event_id"))).select("row_key", "code")
