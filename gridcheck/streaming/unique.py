"""Uniqueness on a stream: a state per value with a timeout that ends it, handed to Python with the rows of many values at a time."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from tempfile import SpooledTemporaryFile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

from gridcheck.violations import violations

#: A value's rows of a batch wait in memory up to so many bytes, then on the executor's disk.
WAITING = 16 << 20


def _repeats(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """A value's rows but its first, with the first's key; the first is state until the watermark passes the value's last time."""
    if state.hasTimedOut:
        state.remove()
        return
    known = state.get if state.exists else None
    best, until = None, known[1] if known else 0
    with SpooledTemporaryFile(max_size=WAITING) as waiting:
        chunks = 0
        for chunk in rows:
            us, keys = chunk["us"].tolist(), chunk["row_key"].tolist()
            if not keys:
                continue
            until = max(until, max(us) // 1000 + 1)
            least = min(zip(us, keys, strict=True))
            best = min(best or least, least)
            pickle.dump((keys, chunk["value"].tolist()), waiting)
            chunks += 1
        first = known[0] if known else best[1]
        left = known is None
        waiting.seek(0)
        for _ in range(chunks):
            keys, values = pickle.load(waiting)
            if left and first in keys:  # the first row itself is no repeat, its copies are
                at = keys.index(first)
                del keys[at], values[at]
                left = False
            if keys:
                yield pd.DataFrame({"first": [first] * len(keys), "row_key": keys, "value": values})
    state.update((first, until))
    state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))


def stream_check_unique(stream: DataFrame, table: str, col: str, key: Column, ts: str, delay: str) -> DataFrame:
    """Every occurrence of a value after the first, as a violation with the first's key.

    A value's first key is state, kept until the watermark passes its last time:
    repeats that are further apart than the delay are not seen.  Within a batch
    the first is the earliest, then the smallest key.  Blank values are ignored.
    A value with most of the rows passes in Arrow batches, which wait on the
    executor's disk until the first row among all of them is known.  State
    belongs in the RocksDB state store (``STATE_STORE``), outside the heap.
    """
    rows = stream.select(key.alias("row_key"), F.col(col).cast("string").alias("value"), F.col(ts).cast("timestamp").alias("ts")).filter("trim(value) <> '' AND ts IS NOT NULL")
    timed = rows.withColumns({"key": F.lower("value"), "us": F.unix_micros("ts")}).withWatermark("ts", delay)
    found = timed.groupBy("key").applyInPandasWithState(_repeats, "first string, row_key string, value string", "first string, until long", "append", "EventTimeTimeout")
    return violations(found, table, "unique", "duplicate", "error", col=col, args={"first": F.col("first")})


#: Session settings for state outside the heap.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
