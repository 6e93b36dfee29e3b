"""The checks on streams."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcheck.operators import columns as C
from gridcheck.operators.refs import RESOLVERS, keys_of
from gridcheck.violations import violations


def stream_check_columns(stream: DataFrame, table: str, key: Column, kinds: Mapping[str, str]) -> DataFrame:
    """Type violations of a stream's rows; no state."""
    return C.check_columns(C.melt(stream, key, list(kinds)), table, kinds)


def stream_check_reference(stream: DataFrame, table: str, key: Column, col: str, target: DataFrame, target_col: str, resolver: str = "ascii-ci", policy: str = "error") -> DataFrame:
    """Rows whose value has no key in a static table."""
    long = C.melt(stream, key, [col])
    rows = long.filter("trim(value) <> ''").withColumn("__key", RESOLVERS[resolver](F.col("value")))
    missing = rows.join(keys_of(target, target_col, resolver), F.col("__key") == F.col("key"), "left_anti").drop("__key")
    return violations(missing, table, "reference", "unresolved", policy)


def without_repeats(stream: DataFrame, cols: Sequence[str], ts: str, delay: str) -> DataFrame:
    """The stream without rows that repeat the columns within the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(cols))


def stream_severity_counts(stream: DataFrame, ts: str, window: str, delay: str) -> DataFrame:
    """Running counts of severities per window of event time."""
    timed = stream.withColumn("ts", F.col(ts).cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", window), "severity").agg(F.count("*").alias("n"))
