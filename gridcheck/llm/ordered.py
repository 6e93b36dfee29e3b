"""Positions and running sums within groups; no group is held whole."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridcheck.operators.ordered import folded as folded

from .common import written


def group_key(name: str) -> Column:
    """A group's id as text that is never null: '=' and the id, or nothing for a null id."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit(""))


def runs(batch: pa.RecordBatch, name: str) -> list[tuple[int, int]]:
    """Where equal values of a sorted column begin and end."""
    import pyarrow.compute as pc

    column, n = batch.column(name), batch.num_rows
    if not n:
        return []
    cuts = (np.flatnonzero(pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n]))


def numbered(rows: DataFrame, group: str, order: Sequence[Column], sums: Mapping[str, Column], name: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0 within the group) and, for each of ``sums``, the sum over earlier rows of the group.

    The rows are sorted once over range partitions, so a group with a third of
    all rows lies in many of them; each partition counts from 0, and what earlier
    partitions hold of its first group is added afterwards, from a table with a
    row for each partition at most.  ``group`` is a text column without nulls;
    a row number comes last in the order, so no key is too frequent to be split.
    """
    keys = [F.col(group), *order, F.monotonically_increasing_id()]
    labelled = rows.select("*", *(k.alias(f"__k{i}") for i, k in enumerate(keys[1:])), *(c.cast("long").alias(f"__v_{s}") for s, c in sums.items()))
    by = [group, *(f"__k{i}" for i in range(len(keys) - 1))]
    ordered = labelled.repartitionByRange(*by).sortWithinPartitions(*by).drop(*by[1:])
    sums = list(sums)  # names alone go to the tasks
    kept = [f for f in ordered.schema if not f.name.startswith("__v_")]
    schema = T.StructType([*kept, *(T.StructField(n, T.LongType()) for n in ("pos", *sums, *(f"__v_{s}" for s in sums))), T.StructField("__part", T.LongType()), T.StructField("__head", T.BooleanType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, last, carried = TaskContext.get().partitionId(), None, None, [0] * (1 + len(sums))
        for batch in batches:
            out = {n: np.zeros(batch.num_rows, np.int64) for n in ("pos", *sums)}
            head = np.zeros(batch.num_rows, bool)
            values = [np.ones(batch.num_rows, np.int64), *(batch.column(f"__v_{s}").to_numpy(zero_copy_only=False) for s in sums)]
            for at, end in runs(batch, group):
                key = batch.column(group)[at].as_py()
                first = key if first is None else first
                if key != last:
                    last, carried = key, [0] * (1 + len(sums))
                head[at:end] = key == first
                for i, (n, v) in enumerate(zip(("pos", *sums), values)):
                    total = np.cumsum(v[at:end])
                    out[n][at:end] = carried[i] + total - v[at:end]
                    carried[i] += int(total[-1])
            columns = [batch.column(f.name) for f in kept] + [pa.array(out[n]) for n in ("pos", *sums)] + [batch.column(f"__v_{s}") for s in sums]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(batch.num_rows, part, np.int64)), pa.array(head)], names=schema.names)

    table = written(ordered.mapInArrow(count, schema), name)
    before = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = table.groupBy(group, "__part").agg(F.count("*").alias("pos"), *(F.sum(f"__v_{s}").alias(s) for s in sums))
    spans = totals.join(totals.groupBy(group).agg(F.count("*").alias("__n")).filter("__n > 1"), group)
    # a group of several partitions is the first group of all of them but its first
    offsets = spans.select("__part", *(F.sum(n).over(before).alias(f"__o_{n}") for n in ("pos", *sums))).filter("__o_pos IS NOT NULL").withColumn("__head", F.lit(True))
    joined = table.join(F.broadcast(offsets), ["__part", "__head"], "left")
    return joined.select(*(f.name for f in kept), *((F.col(n) + F.coalesce(F.col(f"__o_{n}"), F.lit(0))).alias(n) for n in ("pos", *sums)))
