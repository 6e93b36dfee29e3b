"""Mixing sources to target weights, block by block.

The words of each source stand in one line, document after document, cut into
blocks of ``block_words``.  A source's target gives its number of slots.  The
slots are dealt to output shards by multinomial draws under the condition that
each source's counts over all shards add up to its slots: a binary tree of
hypergeometric draws, of which a shard follows one path, so that shards are
drawn independently on the executors.  Slot q of a source with N blocks takes
block perm(q mod N) of pass q div N; perm is a keyed Feistel permutation of the
source and the pass.  So no block is used twice before all were used once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, written

#: Rows that stand in one order together when places in a source's line are found.
ORDERED = 10_000


@dataclass(frozen=True)
class SourcePlan:
    """One source: its words, target, blocks and slots; ``key`` is never null."""

    number: int
    key: str
    size: int
    target: float
    blocks: int
    slots: int


def source_key(source_col: str) -> Column:
    """The source with a mark in front; the empty string for null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))


def water_fill(sizes: Sequence[int], weights: Sequence[float], most: float) -> list[float]:
    """Shares of the total by weight, none above ``most`` times its size."""
    caps, left, out = [float(most * s) for s in sizes], float(sum(sizes)), [0.0] * len(sizes)
    open_ = [i for i, s in enumerate(sizes) if s > 0]
    while open_:
        whole = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / whole > caps[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = caps[i]
        left -= sum(caps[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def plan_sources(totals: dict[str, int], weights: Sequence[float], most: int, block_words: int) -> list[SourcePlan]:
    keys = sorted((k for k in totals if k), key=str) + [k for k in totals if not k]
    sizes = [totals[k] for k in keys]
    own = [weights[i % len(weights)] for i in range(len(keys))]
    out = []
    for i, (key, size, target) in enumerate(zip(keys, sizes, water_fill(sizes, own, most))):
        blocks = -(-size // block_words)
        slots = min(most * blocks, round(target * blocks / size)) if size else 0
        out.append(SourcePlan(i, key, size, target, blocks, slots))
    return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` taken without replacement from ``good`` + ``bad`` are good.

    By inversion, from the mode outwards as far as 12 standard deviations (less
    than 1e-30 of the mass lies beyond), so that any sizes below 2 ** 53 work.
    """
    whole = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mean = n * (good / whole)
    spread = math.sqrt(max(mean * (bad / whole) * (whole - n) / max(1, whole - 1), 0.0))
    low, high = max(low, int(mean - 12 * spread) - 40), min(high, int(mean + 12 * spread) + 40)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log(good - k) + np.log(n - k) - np.log(k + 1) - np.log(bad - n + k + 1)
    mass = np.append(0.0, np.cumsum(steps))
    mass = np.exp(mass - mass.max())
    sums = np.cumsum(mass)
    return low + int(np.searchsorted(sums, rng.random() * sums[-1], "right"))


def split_draw(rng: np.random.Generator, counts: np.ndarray, n: int) -> np.ndarray:
    """How many of each kind are among ``n`` taken from ``counts``, kind by kind."""
    out, left = np.zeros_like(counts), int(counts.sum())
    for i, c in enumerate(counts.tolist()):
        if n <= 0:
            break
        left -= c
        if c:
            out[i] = hypergeometric(rng, c, left, n)
            n -= int(out[i])
    return out


def shard_counts(slots: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Each source's first slot in a shard, and how many it has there."""
    total = int(slots.sum())
    low, high, first, here = 0, shards, np.zeros_like(slots), slots.copy()
    while high - low > 1:
        middle = (low + high) // 2
        n = total * middle // shards - total * low // shards
        rng = np.random.default_rng([seed, low, high])
        left = split_draw(rng, here, n)
        if shard < middle:
            here, high = left, middle
        else:
            first, here, low = first + left, here - left, middle
    return first, here


def permuted(index: np.ndarray, size: int, key: int) -> np.ndarray:
    """A keyed permutation of 0..size-1: four Feistel rounds, again while outside."""
    if size < 2:
        return index.copy()
    half = (int(size - 1).bit_length() + 1) // 2
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([key & (2**63 - 1), size]).integers(1, 2**62, 4, dtype=np.uint64) | np.uint64(1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> np.uint64(half), x & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= k
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(index.astype(np.uint64))
    while (over := out >= size).any():
        out[over] = once(out[over])
    return out.astype(np.int64)


class Mix:
    """A mix of ``docs``, decided by sizes, sources and the seed alone.

    ``sized`` has a row for each input row (``row``, the id, ``source``,
    ``src``, ``size``, ``start`` in its source's line); ``sources`` the plan.
    The table of sources (not of documents) comes to the driver, about 100 bytes
    for each: it is meant for up to some 100,000 sources.  Tables that grow with
    the documents are joined by sorting, never broadcast.

    Null and empty texts have size 0 and are never taken; a null source is a
    source of its own, the last; repeated rows are documents of their own.  An
    empty table gives an empty mix; a very long text is many blocks, counted in
    one row.  Ties in the order (equal hashes) go by id, then row.  ``row_col`` may name a column that numbers
    the rows; else they are numbered as the sizes are written.  The order within a source is that of a
    hash of id and text, so reruns agree wherever the rows lie.
    """

    def __init__(self, docs: DataFrame, weights: Sequence[float] = (5, 2, 1), most: int = 3, block_words: int = 128, shard_words: int = 1 << 24, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None) -> None:
        self.spark, self.seed, self.block_words, self.most = docs.sparkSession, seed, block_words, most
        self.id_col, self.text_col = id_col, text_col
        text = F.coalesce(F.col(text_col), F.lit(""))
        measured = written(
            docs.select(
                (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(source_col).alias("src"),
                F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"), F.xxhash64(F.col(id_col).cast("string"), text).alias("place"),
            ),
            "sizes",
        )
        found = measured.groupBy("src").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        self.sources = plan_sources({r.src: r.size for r in found}, weights, most, block_words)
        ranges = max(1, sum(r.n for r in found) // ORDERED)
        plans = self.spark.createDataFrame([(p.number, p.key, p.size, p.target) for p in self.sources], "number int, src string, source_size long, target double")
        measured = measured.withColumn("range", F.pmod(F.col("place"), F.lit(ranges)).cast("long"))
        before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
        in_range = Window.partitionBy("src", "range").orderBy("place", "id", "row").rowsBetween(Window.unboundedPreceding, -1)
        zero = F.lit(0).cast("long")
        # sums of ranges in two steps: neither orders more than some thousands of rows, until there are 1e11 documents
        sums = measured.groupBy("src", "range").agg(F.sum("size").alias("n")).withColumn("part", F.expr("range div 4096"))
        parts = sums.groupBy("src", "part").agg(F.sum("n").alias("n")).select("src", "part", F.coalesce(F.sum("n").over(before("src", "part")), zero).alias("base"))
        starts = sums.join(parts, ["src", "part"]).select("src", "range", (F.col("base") + F.coalesce(F.sum("n").over(before("src", "part", "range")), zero)).alias("first"))
        self.sized = (
            measured.join(starts.hint("merge"), ["src", "range"])
            .withColumn("start", F.col("first") + F.coalesce(F.sum("size").over(in_range), zero))
            .join(plans, "src")
            .select("row", "id", "source", "number", "size", "start", "source_size", "target")
        )
        self.slots = sum(p.slots for p in self.sources)
        self.shards = max(1, -(-self.slots * block_words // shard_words))

    def slot_blocks(self) -> DataFrame:
        """The mix itself: for each slot of each shard its source (number) and block."""
        plans, shards, seed = self.sources, self.shards, self.seed
        slots = np.array([p.slots for p in plans], np.int64)

        def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard in batch.column("id").to_pylist():
                    firsts, counts = shard_counts(slots, shards, shard, seed)
                    for plan, first, n in zip(plans, firsts, counts):
                        for at in range(first, first + n, 1 << 16):
                            q = np.arange(at, min(at + (1 << 16), first + n))
                            turn, blocks = q // plan.blocks, np.zeros(len(q), np.int64)
                            for t in np.unique(turn):
                                blocks[turn == t] = permuted(q[turn == t] % plan.blocks, plan.blocks, seed + 7919 * plan.number + 104729 * int(t))
                            yield pa.RecordBatch.from_pydict({"shard": pa.array(np.full(len(q), shard), pa.int64()), "slot": pa.array(q, pa.int64()), "number": pa.array(np.full(len(q), plan.number), pa.int32()), "block": pa.array(blocks, pa.int64())})

        if not self.slots:
            return self.spark.createDataFrame([], "shard long, slot long, number int, block long")
        return self.spark.range(shards, numPartitions=min(shards, 4096)).mapInArrow(draw, "shard long, slot long, number int, block long")

    def parts(self) -> DataFrame:
        """The parts of documents that blocks hold, with how often the mix takes each.

        A row has ``row``, the words ``low`` to ``high`` (exclusive) of its text, and ``uses``.
        """
        words = self.block_words
        uses = self.slot_blocks().groupBy("number", "block").agg(F.count("*").alias("uses"))
        blocks = self.sized.filter("size > 0").select("row", "number", "start", "size", F.explode(F.sequence(F.expr(f"start div {words}"), F.expr(f"(start + size - 1) div {words}"))).alias("block"))
        low, high = F.greatest(F.col("block") * words - F.col("start"), F.lit(0)), F.least((F.col("block") + 1) * words - F.col("start"), F.col("size"))
        return blocks.join(uses.hint("merge"), ["number", "block"]).select("row", low.alias("low"), high.alias("high"), "uses")

    def taken(self) -> DataFrame:
        """Each document with its size, its source's size and target, and the words the mix takes."""
        taken = self.parts().groupBy("row").agg(F.sum((F.col("high") - F.col("low")) * F.col("uses")).alias("taken"))
        return self.sized.join(taken.hint("merge"), "row", "left").select(F.col("id").alias(self.id_col), "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed_documents(docs: DataFrame, n_chars_col: str | None = "n_chars", **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: one for each time a document is taken.

    Copy k has the words of all blocks taken k times or more; words that stand
    together keep the white space between them, gaps become a line feed.
    ``n_chars_col``, if there, gets the length of the new text.

    Null and empty texts are never taken.  Repeated rows are taken each by
    itself; a null source is a source of its own.  A very long text is many
    blocks, of which its copies hold those that were taken.  Ties as in ``Mix``.
    An empty table gives an empty one; other columns are copied, whatever their names.
    """
    kept = written(docs.withColumn("__row", F.monotonically_increasing_id()), "unmixed")
    mix = Mix(kept, row_col="__row", **options)
    text_col, schema = mix.text_col, docs.schema
    parts = mix.parts().groupBy("row").agg(F.sort_array(F.collect_list(F.struct("low", "high", "uses"))).alias("__parts"))
    joined = kept.join(parts.withColumnRenamed("row", "__row").hint("merge"), "__row").drop("__row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, texts = [], []
            for i, (text, parts) in enumerate(zip(batch.column(text_col).to_pylist(), batch.column("__parts").to_pylist())):
                for copy in copies(text, [(p["low"], p["high"], p["uses"]) for p in parts]):
                    which.append(i)
                    texts.append(copy)
            out = batch.take(pa.array(which, pa.int64()))
            new = {text_col: texts} | ({n_chars_col: [len(t) for t in texts]} if n_chars_col in schema.names else {})
            yield pa.RecordBatch.from_arrays([pa.array(new[n], out.column(n).type) if n in new else out.column(n) for n in schema.names], names=schema.names)

    return joined.mapInArrow(cut, schema)


def copies(text: str, parts: list[tuple[int, int, int]]) -> list[str]:
    """The text of each copy, from its (first word, end, uses)."""
    import re

    spans = [m.span() for m in re.finditer(WORD_PATTERN, text)]
    out = []
    for k in range(1, max(u for _, _, u in parts) + 1):
        runs: list[list[int]] = []
        for low, high, uses in parts:
            if uses < k:
                continue
            if runs and runs[-1][1] == low:
                runs[-1][1] = high
            else:
                runs.append([low, high])
        out.append("\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs))
    return out
