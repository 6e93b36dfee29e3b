"""Files of token ids in a canonical, length-limited Huffman code.

1. The texts are encoded once; their ids lie compressed in a table beside the
   counts of all ids of each batch.
2. The code comes from the counts over all documents (a row for each id of the
   vocabulary, however large the corpus).
3. A range shuffle puts the documents in order.  Each partition packs whole
   documents into blocks of about ``BLOCK`` ids: the bits, the distance between
   checkpoints in bits, and the documents with their numbers of ids.  A block
   can be decoded without any other.

A folder holds all that a reader needs: ``blocks``, ``starts`` (how many ids lie
before each part) and ``header`` (version, end id, totals, and the code as one
length for each id, from which the canonical code follows).
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import huffman
from .byte_bpe import encoder, forget
from .common import dropped, ending, rows_of, shared_dir, written

BLOCK = 1 << 16
#: Ids in one range partition, about.
PARTITION = 8 << 20

VERSION = 1


@dataclass(frozen=True)
class TokenFiles:
    """Token files in a folder: blocks, ids before each part, and the header's row."""

    path: str
    blocks: DataFrame
    starts: DataFrame
    end_id: int
    n_documents: int
    n_tokens: int
    lengths: np.ndarray


def open_tokens(spark: SparkSession, path: str) -> TokenFiles:
    """The files of a folder, from what is written there alone."""
    head = spark.read.parquet(f"{path}/header").first()
    if head.version != VERSION:
        raise ValueError(f"token files of version {head.version}")
    if (head.limit, head.step) != (huffman.LIMIT, huffman.STEP):
        raise ValueError("token files with other limits of codes or checkpoints")
    return TokenFiles(path, spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/starts"), head.end_id, head.n_documents, head.n_tokens, np.frombuffer(head.lengths, np.uint8))


def _squeeze(ids: np.ndarray) -> bytes:
    """Low and high bytes apart, each compressed."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=1).compress
    low = pack((ids & 255).astype(np.uint8).tobytes())
    return len(low).to_bytes(4, "little") + low + pack((ids >> 8).astype(np.uint8).tobytes())


def _loosen(blob: bytes) -> np.ndarray:
    import zstandard

    open_, cut = zstandard.ZstdDecompressor().decompress, 4 + int.from_bytes(blob[:4], "little")
    low, high = (np.frombuffer(open_(x), np.uint8).astype(np.uint16) for x in (blob[4:cut], blob[cut:]))
    return low | high << 8


def write_tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, folder: str | None = None) -> TokenFiles:
    """Encodes every text, adds ``end_id``, and writes all ids in order of the id column.

    The files go to ``folder``, by default a new one in the shared folder.

    Null and empty texts have just the end id.  A null id comes first; rows
    with the same id are in the order of their ids' checksum.  An empty table
    gives files without blocks.  A very long text is in one block, whatever its
    length; a task holds one such block.  Other columns are not read.
    """
    folder = folder or f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("check", T.LongType()), T.StructField("n", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    end = np.array([end_id], "<u2").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take = encoder(path).encode
        for batch in batches:
            ids = [np.frombuffer(take(t) + end, "<u2") for (t,) in rows_of(batch, "text")]
            if not ids:
                continue
            counts = np.bincount(np.concatenate(ids), minlength=1 << 16).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([_squeeze(x) for x in ids], pa.binary()), pa.array([zlib.compress(counts, 1), *[None] * (len(ids) - 1)], pa.binary())],
                names=schema.names,
            )

    encoded = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(encode, schema), "ids")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for (blob,) in rows_of(batch, "counts"):
                total += np.frombuffer(zlib.decompress(blob), "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"token": pa.array(used, pa.int64()), "n": pa.array(total[used], pa.int64())})

    found = encoded.select("counts").dropna().mapInArrow(totals, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(1 << 16, np.int64)
    counts[found.token.to_numpy(np.int64)] = found.n.to_numpy(np.int64)
    lengths = huffman.code_lengths(counts)
    known = docs.sparkSession.sparkContext.broadcast(lengths)
    parts = int(max(1, counts.sum() // PARTITION + 1))
    block_schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("before", T.LongType()), T.StructField("doc_ids", T.ArrayType(id_type)), T.StructField("n_tokens", T.ArrayType(T.IntegerType())), T.StructField("bits", T.BinaryType()), T.StructField("steps", T.BinaryType())])

    def encode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget(path)  # all texts are encoded
        lengths, part = known.value, TaskContext.get().partitionId()
        codes = huffman.canonical_codes(lengths)
        names: list = []
        held: list[np.ndarray] = []
        size, block, before = 0, 0, 0

        def closed() -> pa.RecordBatch:
            bits, steps = huffman.pack(np.concatenate(held), codes, lengths)
            row = {"part": part, "block": block, "before": before, "doc_ids": list(names), "n_tokens": [len(x) for x in held], "bits": bits, "steps": steps}
            names.clear(), held.clear()
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(block_schema)
        for batch in batches:
            for name, blob in rows_of(batch, "id", "ids"):
                names.append(name)
                held.append(_loosen(blob))
                size += len(held[-1])
                if size >= BLOCK:
                    yield closed()
                    block, before, size = block + 1, before + size, 0
        if held:
            yield closed()

    ordered = encoded.select("id", "check", "ids").repartitionByRange(parts, "id", "check").sortWithinPartitions("id", "check")
    blocks = written(ordered.select("id", "ids").mapInArrow(ending(encode_blocks), block_schema), "tokens", f"{folder}/blocks")
    dropped(encoded)
    # a row for each PARTITION ids
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    written(sizes.select("part", F.coalesce(before, F.lit(0).cast("long")).alias("part_start")), "starts", f"{folder}/starts")
    total = blocks.agg(F.sum(F.size("doc_ids")).alias("n")).first()["n"] or 0
    head = [(VERSION, end_id, int(total), int(counts.sum()), huffman.LIMIT, huffman.STEP, bytearray(lengths.tobytes()))]
    written(docs.sparkSession.createDataFrame(head, "version int, end_id int, n_documents long, n_tokens long, limit int, step int, lengths binary").coalesce(1), "header", f"{folder}/header")
    return open_tokens(docs.sparkSession, folder)


def read_tokens(files: TokenFiles) -> DataFrame:
    """Decodes every block: one row per document with start, n_tokens and ids."""
    id_type = files.blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType()), T.StructField("ids", T.BinaryType())])
    return _decoded(files, schema, True)


def read_checks(files: TokenFiles) -> DataFrame:
    """As ``read_tokens``, with the checksum of the ids (32 bits each) in their place."""
    id_type = files.blocks.schema["doc_ids"].dataType.elementType
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_crc32", T.LongType())])
    return _decoded(files, schema, False)


def _decoded(files: TokenFiles, schema: T.StructType, with_ids: bool) -> DataFrame:
    known = files.blocks.sparkSession.sparkContext.broadcast(files.lengths)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        codes, arrow = huffman.decoding_table(known.value), to_arrow_schema(schema)
        for batch in batches:
            for part_start, before, names, sizes, bits, steps in rows_of(batch, "part_start", "before", "doc_ids", "n_tokens", "bits", "steps"):
                ends = np.cumsum(sizes)
                ids = huffman.unpack(bits, steps, int(ends[-1]), codes).astype("<u4")
                starts = ends - sizes
                own = [ids[a:b].tobytes() for a, b in zip(starts, ends)]
                columns = [names, part_start + before + starts, np.asarray(sizes, np.int64), [zlib.crc32(x) for x in own], *([own] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return files.blocks.join(files.starts, "part").select("part_start", "before", "doc_ids", "n_tokens", "bits", "steps").mapInArrow(ending(decode), schema)
