"""Helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcheck.operators.groups import connected_components as connected_components
from gridcheck.storage import dropped as dropped
from gridcheck.storage import shared_dir as shared_dir
from gridcheck.storage import written as written

#: ASCII white space: 0x09-0x0D and the blank; ``bytes.split()`` splits on just these.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bucket_of(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(id_col).cast("string")) % n


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The rows of some columns; a few hundred at a time become Python values."""
    for at in range(0, batch.num_rows, 256):
        part = batch.slice(at, 256)
        yield from zip(*(part.column(n).to_pylist() for n in names))


def released() -> None:
    """Gives free memory back to the system; a worker that waits for its next task would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def ending(task: Callable[[Iterator], Iterator], *forget: Callable[[], None]) -> Callable[[Iterator], Iterator]:
    """``task``, after which its worker forgets what it remembered and releases its memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            for f in forget:
                f()
            released()

    return run


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squeezed(values: np.ndarray) -> bytes:
    """The numbers compressed, one plane for each of their bytes: the high ones are nearly empty."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes())


def loosened(blob: bytes, kind: type) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def by_bytes(batches: Iterator[pa.RecordBatch], name: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a text column has about ``most`` bytes in each, or one row."""
    import pyarrow.compute as pc

    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(lengths) // most
        starts = np.append(0, np.flatnonzero(group[1:] != group[:-1]) + 1) if len(group) else []
        for at, end in zip(starts, np.append(starts[1:], len(group))):
            yield batch.slice(int(at), int(end - at))


def row_ids() -> Iterator[int]:
    """Numbers no other task of the stage gives: partition, then a counter."""
    from pyspark import TaskContext

    context = TaskContext.get()
    start = (context.partitionId() if context else 0) << 33
    while True:
        yield start
        start += 1
