"""JSON entries: presence and range of fields, definitions and their use."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcheck.violations import violations


def check_required_fields(entries: DataFrame, table: str, json_col: str, required: Sequence[str], key: Column) -> DataFrame:
    """Entries without some of the named fields (a JSON null is there), with the missing ones in order."""
    have = F.coalesce(F.json_object_keys(F.col(json_col)), F.array().cast("array<string>"))
    missing = F.array_except(F.array(*map(F.lit, required)), have)
    rows = entries.select(key.alias("row_key"), F.col(json_col).alias("value"), missing.alias("__missing")).filter(F.size("__missing") > 0)
    return violations(rows, table, "required-fields", "missing-fields", "error", args={"fields": F.array_join("__missing", ",")})


def check_id_range(entries: DataFrame, table: str, json_col: str, field: str, key: Column, low: int = 0, high: int = 65535) -> DataFrame:
    """Numeric ids out of range, and entries without an id; ids that are strings are not checked."""
    v = F.try_parse_json(F.col(json_col))
    has = F.array_contains(F.coalesce(F.json_object_keys(F.col(json_col)), F.array().cast("array<string>")), field)
    one = F.try_variant_get(v, f"$.{field}", "variant")
    kind = F.schema_of_variant(one)
    number = F.when(kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL"), F.try_variant_get(v, f"$.{field}", "double"))
    rows = entries.select(key.alias("row_key"), F.col(json_col).alias("value"), F.when(~has, "missing-id").when(~number.between(low, high), "invalid-id-range").alias("__code")).filter("__code IS NOT NULL")
    return violations(rows, table, "id-range", F.col("__code"), "error", col=field)


def collect_used(tables: dict[str, DataFrame], texts: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """``key``: every non-empty cell of the tables, and every ``@token`` in the texts.

    Columns whose name starts with '*' are left out; of columns whose names
    differ only in case, the last counts.
    """
    out = None
    for df in tables.values():
        last = {c.lower(): c for c in df.columns if not c.startswith("*")}
        cols = list(last.values())
        cells = df.select(*(F.col(f"`{c}`").cast("string").alias(c) for c in cols)).unpivot([], cols, "col", "key").filter("key <> ''").select("key")
        out = cells if out is None else out.unionByName(cells)
    if texts is not None:
        tokens = texts.select(F.explode(F.regexp_extract_all(text_col, F.lit("@([A-Za-z0-9_]+)"), F.lit(1))).alias("key"))
        out = tokens if out is None else out.unionByName(tokens)
    return out.distinct()


def collect_used_rows(rows: DataFrame, headers: DataFrame, texts: DataFrame | None = None, text_col: str = "text", file_cols: Sequence[str] = ("path",), stem: Column | None = None, known: Sequence[str] | None = None, excluded: Sequence[str] = (), skip_header: str = "@skipdocs") -> DataFrame:
    """``key``: evidence of use from tables whose rows may be shorter or longer than their header.

    ``rows``: the file columns and ``cells``; ``headers``: the file columns and
    ``header``.  Headers are compared in lower case; those that start with '*' do
    not count; of repeated ones the last column counts.  A row with fewer cells
    than the header has counted columns is left out.  A column named
    ``skip_header`` gives the key ``true`` where its cell is not empty, or is not
    there.  ``known`` and ``excluded`` name the tables (by ``stem``) that count,
    for a version of the rules.
    """
    files = headers
    if stem is not None and known is not None:
        files = files.filter(stem.isin(*known))
    if stem is not None and excluded:
        files = files.filter(~stem.isin(*excluded))
    # what a header says about its columns is worked out once a file
    named = files.select(*file_cols, F.posexplode("header").alias("at", "name")).withColumn("name", F.lower("name")).filter("NOT startswith(name, '*')")
    last = named.groupBy(*file_cols, "name").agg(F.max("at").alias("at"), F.count("*").alias("n"), F.collect_set(F.when(F.col("name") == skip_header, F.col("at"))).alias("skips"))
    known_columns = last.groupBy(*file_cols).agg(F.collect_list("at").alias("__at"), F.sum("n").alias("__n"), F.flatten(F.collect_list("skips")).alias("__skips"))
    kept = rows.join(known_columns, list(file_cols)).filter(F.size("cells") >= F.col("__n"))
    cells = F.filter(F.transform("__at", lambda i: F.get("cells", i)), lambda c: c.isNotNull() & (c != ""))
    marked = F.exists("__skips", lambda i: F.coalesce(F.get("cells", i) != "", F.lit(True)))
    out = kept.select(F.explode(F.concat(cells, F.when(marked, F.array(F.lit("true"))).otherwise(F.array().cast("array<string>")))).alias("key"))
    if texts is not None:
        out = out.unionByName(texts.select(F.explode(F.regexp_extract_all(text_col, F.lit("@([A-Za-z0-9_]+)"), F.lit(1))).alias("key")))
    return out.distinct()


def check_unused(definitions: DataFrame, used: DataFrame, table: str, id_number: Column, key: Column, row_key: Column, above: float, is_text: Column | None = None) -> DataFrame:
    """Definitions with a number above the threshold whose key nobody uses; empty keys are skipped, keys that are no text always reported."""
    text = is_text if is_text is not None else F.lit(True)
    rows = definitions.select(row_key.alias("row_key"), key.cast("string").alias("value"), id_number.alias("__id"), text.alias("__text")).filter((F.col("__id") > above) & (~F.col("__text") | (F.col("value") != "")))
    named = rows.filter("__text")
    loose = named.join(used.select(F.col("key").alias("value")).distinct(), "value", "left_anti").select(rows.columns)
    return violations(loose.unionByName(rows.filter("NOT __text")), table, "unused", "unused-definition", "warning")


