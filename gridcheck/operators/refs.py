"""Reference checks and look-ups: anti joins and left joins on normalised keys.

The target side is reduced to its distinct keys.  The source side is reduced
to its distinct keys too before it meets the target, so that a value that a
third of all rows have is looked up once; only misses go back to the rows.
Whether a side is broadcast is left to Spark, which knows its size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcheck.functions.scalar import ascii_lower, fixed4_key, is_blank, trimmed
from gridcheck.violations import violations

RESOLVERS = {"ascii-ci": ascii_lower, "fixed4": fixed4_key, "exact": lambda c: c}
#: What an unknown value is, by the policy.
POLICIES = {"error": "error", "warning": "warning"}


def keys_of(df: DataFrame, col: str, resolver: str = "ascii-ci", first_col: str | None = None, distinct: bool = True) -> DataFrame:
    """Normalised keys of a target column, distinct unless they become so later; blanks and comment rows are none."""
    from gridcheck.operators.columns import drop_comment_rows

    rows = drop_comment_rows(df, first_col) if first_col else df
    value = F.col(col).cast("string")
    keys = rows.filter(~is_blank(value)).select(RESOLVERS[resolver](value).alias("key"))
    return keys.distinct() if distinct else keys


def union_keys(targets: Sequence[tuple[DataFrame, str]], resolver: str = "ascii-ci") -> DataFrame:
    out = None
    for df, col in targets:
        keys = keys_of(df, col, resolver)
        out = keys if out is None else out.unionByName(keys)
    return out.distinct()


def misses(long: DataFrame, keys: DataFrame, resolver: str = "ascii-ci", skip: Sequence[str] = ()) -> DataFrame:
    """Rows of the long form whose non-blank value has no key."""
    rows = long.filter(~is_blank(F.col("value"))).withColumn("__key", RESOLVERS[resolver](F.col("value")))
    if skip:
        rows = rows.filter(~F.col("value").isin(*skip))
    missing = rows.select("__key").distinct().join(keys, F.col("__key") == F.col("key"), "left_anti")
    return rows.join(missing, "__key", "left_semi").drop("__key")


def check_reference(long: DataFrame, table: str, keys: DataFrame | None, target: str, resolver: str = "ascii-ci", policy: str = "error", skip: Sequence[str] = (), rule: str = "reference") -> DataFrame:
    """Values without a key in the target.  No target (None) or policy 'ignore': no violations."""
    if keys is None or policy not in POLICIES:
        return violations(long.filter(F.lit(False)), table, rule, "unresolved")
    return violations(misses(long, keys, resolver, skip), table, rule, "unresolved", POLICIES[policy], args={"target": F.lit(target)})


def check_enum(long: DataFrame, table: str, values: DataFrame | Sequence[str] | None, resolver: str = "ascii-ci", policy: str = "error") -> DataFrame:
    """A reference to a declared list; an empty list is unavailable."""
    if values is None or (not isinstance(values, DataFrame) and not len(values)):
        return check_reference(long, table, None, "enum", rule="enum")
    if not isinstance(values, DataFrame):
        values = long.sparkSession.createDataFrame([(v,) for v in values], "value string")
    return check_reference(long, table, keys_of(values, values.columns[0], resolver), "enum", resolver, policy, rule="enum")


def resolve_location(df: DataFrame, col: str, target: DataFrame, target_col: str, line: str, resolver: str = "ascii-ci") -> DataFrame:
    """``df`` with ``target_line`` and ``target_value`` of the row it refers to; of repeats, the last."""
    value = F.col(target_col).cast("string")
    last = target.filter(~is_blank(value)).groupBy(RESOLVERS[resolver](value).alias("__key")).agg(F.max(line).alias("target_line"), F.max_by(value, F.col(line)).alias("target_value"))
    return df.withColumn("__key", RESOLVERS[resolver](F.col(col).cast("string"))).join(last, "__key", "left").drop("__key")


def first_occurrence(df: DataFrame, col: str, line: str, resolver: str = "ascii-ci") -> DataFrame:
    """The first line of each value: ``key``, ``first_line``."""
    value = F.col(col).cast("string")
    return df.filter(~is_blank(value)).groupBy(RESOLVERS[resolver](value).alias("key")).agg(F.min(line).alias("first_line"))


def check_forward_reference(df: DataFrame, table: str, key_col: str, ref_col: str, line: str, resolver: str = "ascii-ci") -> DataFrame:
    """References within a table: to a later first definition, or to none."""
    first = first_occurrence(df, key_col, line, resolver)
    value = F.col(ref_col).cast("string")
    rows = df.filter(~is_blank(value)).select(F.col(key_col).cast("string").alias("row_key"), F.col(line).cast("int").alias("line"), F.lit(ref_col).alias("col"), value.alias("value"), RESOLVERS[resolver](value).alias("key"))
    found = rows.join(first, "key", "left").filter(F.col("first_line").isNull() | (F.col("first_line") > F.col("line")))
    return violations(found, table, "forward-reference", F.when(F.col("first_line").isNull(), "unresolved-base").otherwise("forward-reference"), "warning", args={"first_line": F.coalesce(F.col("first_line").cast("string"), F.lit(""))})


def expand_keys(df: DataFrame, code: str, flag: str | None = None, low: int = 3, high: int = 96, step: int = 3) -> DataFrame:
    """More keys: each code with the levels low, low+step, ..., high behind it, where the flag is a nonzero integer."""
    rows = df.filter(F.coalesce(F.col(flag).cast("string").try_cast("bigint") != 0, F.lit(False))) if flag else df
    value = F.col(code).cast("string")
    levels = F.transform(F.sequence(F.lit(low), F.lit(high), F.lit(step)), lambda n: F.concat(value, n.cast("string")))
    return rows.filter(~is_blank(value)).select(value.alias("__v"), levels.alias("__levels")).dropDuplicates(["__v"]).select(F.explode("__levels").alias("key")).distinct()


def resolve_tiered(df: DataFrame, col: str, tiers: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """``df`` with ``kind`` and ``target_value`` of the first tier that knows the value.

    A tier is (kind, target, column, resolver), the best first; a fixed-length
    tier is asked only for values of at most four bytes.
    """
    value = F.col(col).cast("string")
    targets, asked = None, []
    for rank, (kind, target, target_col, resolver) in enumerate(tiers):
        v = F.col(target_col).cast("string")
        one = target.filter(~is_blank(v)).groupBy(F.concat(F.lit(f"{rank}:"), RESOLVERS[resolver](v)).alias("__key")).agg(F.min(v).alias("target_value")).select("__key", "target_value", F.lit(kind).alias("kind"), F.lit(rank).alias("__rank"))
        targets = one if targets is None else targets.unionByName(one)
        own = F.concat(F.lit(f"{rank}:"), RESOLVERS[resolver](value))
        asked.append(F.when(F.octet_length(value) <= 4, own) if resolver == "fixed4" else own)
    distinct = df.select(value.alias("__value")).distinct().select("*", F.col("__value").alias(col)).withColumn("__asked", F.array_compact(F.array(*asked)))
    found = distinct.select("__value", F.explode("__asked").alias("__key")).join(targets, "__key").groupBy("__value").agg(F.min_by(F.struct("kind", "target_value"), "__rank").alias("__hit"))
    return df.join(found, value == F.col("__value"), "left").withColumns({"kind": F.col("__hit.kind"), "target_value": F.col("__hit.target_value")}).drop("__value", "__hit")


def with_trim_hint(unresolved: DataFrame, keys: DataFrame, resolver: str = "ascii-ci") -> DataFrame:
    """Whether an unresolved value would resolve without the white space at its ends."""
    return unresolved.withColumn("__key", RESOLVERS[resolver](trimmed(F.col("value")))).join(keys.select(F.col("key").alias("__key"), F.lit(True).alias("__there")), "__key", "left").withColumn("trimmed_match", F.coalesce("__there", F.lit(False))).drop("__key", "__there")


def enrich(df: DataFrame, col: str, target: DataFrame, target_col: str, value_cols: Mapping[str, str], order: str, resolver: str = "ascii-ci") -> DataFrame:
    """``df`` with columns of the target's first matching row (by ``order``); ``value_cols``: new name -> target column."""
    key = RESOLVERS[resolver](F.col(target_col).cast("string"))
    first = target.groupBy(key.alias("__key")).agg(*(F.min_by(v, order).alias(name) for name, v in value_cols.items()))
    return df.withColumn("__key", RESOLVERS[resolver](F.col(col).cast("string"))).join(first, "__key", "left").drop("__key")


def referential_summary(edges: Sequence[tuple[str, DataFrame, str, str, DataFrame, str]], resolver: str = "exact") -> DataFrame:
    """Per reference (source table and column, target table and column): rows that match and that miss."""
    out = None
    for source, df, col, target, tdf, tcol in edges:
        keys = keys_of(tdf, tcol, resolver).withColumn("hit", F.lit(True))
        value = F.col(col).cast("string")
        # counted per distinct value before the join: a hot value is one row
        counts = df.filter(~is_blank(value)).groupBy(RESOLVERS[resolver](value).alias("key")).agg(F.count("*").alias("n"))
        one = counts.join(keys, "key", "left").agg(F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).cast("long").alias("n_match"), F.coalesce(F.sum(F.when(F.col("hit").isNull(), F.col("n"))), F.lit(0)).cast("long").alias("n_miss"))
        one = one.select(F.lit(source).alias("source_table"), F.lit(col).alias("source_col"), F.lit(target).alias("target_table"), F.lit(tcol).alias("target_col"), "n_match", "n_miss")
        out = one if out is None else out.unionByName(one)
    return out
