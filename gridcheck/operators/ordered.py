"""Folds over sorted groups: no group is held whole."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def folded(rows: DataFrame, group: str, order: Sequence[str], fold: Callable[[], Callable], columns: Sequence[str], result: str) -> DataFrame:
    """One row for each group: a fold over its rows in order, in memory of one batch.

    ``fold()`` makes the state of a group: ``add(row values of columns)`` and
    ``done() -> tuple`` of the ``result`` columns.  Rows are sorted (with spill)
    and go by in batches; of a group only its state is held.
    """
    names = [c.split(" ")[0] for c in result.split(", ")]
    ordered = rows.select(group, *order, *(c for c in columns if c not in order)).repartition(F.col(group)).sortWithinPartitions(group, *order)
    schema = T.StructType.fromDDL(f"{group} string, {result}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {f.name: f for f in _arrow(schema)}
        key, state, ended = None, None, []

        def close() -> None:
            if state is not None:
                ended.append((key, *state.done()))

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                values = [part.column(c).to_pylist() for c in columns]
                for k, *row in zip(part.column(group).to_pylist(), *values):
                    if state is None or k != key:
                        close()
                        key, state = k, fold()
                    state.add(*row)
                if len(ended) >= 256:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[n].type) for n, c in zip([group, *names], zip(*ended))], names=[group, *names])
                    ended.clear()
        close()
        if ended:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds[n].type) for n, c in zip([group, *names], zip(*ended))], names=[group, *names])

    return ordered.mapInArrow(run, schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
