"""Benchmark decontamination with suffix arrays over the training text.

The words of a piece of the documents (about ``PIECE`` bytes) become numbers, 0
for every word that no benchmark item has.  The suffixes that start with as many
benchmark words as the shortest window are a shard: they are put in order of all
their words, as far as the longest item goes.  Every suffix of the benchmark
that has a whole window is searched in each shard by bisection.  That gives

* where its window occurs (a range of the shard's suffixes), hence the hit words;
* its place among the shard's suffixes.  The longest match of a training suffix
  is that with the benchmark suffix just before or after it in this order, so
  one pass over the places finds the longest verbatim match of each document,
  in which item, and where.

Shards need nothing from each other: the documents are not shuffled.

The benchmark is the query set.  It goes to the tasks in blocks of at most
``block_bytes``, made once for all tasks; with more than one block the marks of
a document are merged by row afterwards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_bytes, row_ids, written

#: Bytes of text whose suffixes are one shard; a longer text is a shard of its own.
PIECE = 8 << 20
#: Letters a-z, digits and all bytes of characters beyond ASCII stay; A-Z are lowered; the rest parts words.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()

RESULT = {"n_words": T.LongType(), "n_hit": T.LongType(), "items": T.ArrayType(T.StringType()), "longest_match": T.LongType(), "match_item": T.StringType(), "match_start": T.LongType(), "item_start": T.LongType(), "hits": T.BinaryType()}
NO_MATCH = ([], 0, None, None, None, b"")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(WORD_BYTES).split() if text else []


def row_keys(rows: np.ndarray) -> np.ndarray:
    """Rows of word numbers as byte strings that compare in the same order."""
    return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * rows.shape[1]}").ravel()


class Line:
    """Word numbers one after the other; a 0 ends a text, and all suffixes in it."""

    def __init__(self, ids: np.ndarray, width: int) -> None:
        self.ids, self.width = np.append(ids, np.zeros(width, np.uint32)), width
        gaps = np.flatnonzero(self.ids == 0)
        #: words up to the next 0
        self.run = gaps[np.searchsorted(gaps, np.arange(len(ids) + 1))] - np.arange(len(ids) + 1)

    def rows(self, starts: np.ndarray, level: int) -> np.ndarray:
        """The words ``level * width`` to the next level of some suffixes, 0 past their ends."""
        at = level * self.width + np.arange(self.width)
        rows = self.ids[np.minimum(starts[:, None] + at, len(self.ids) - 1)]
        rows[at >= self.run[starts][:, None]] = 0
        return rows

    def keys(self, starts: np.ndarray, level: int) -> np.ndarray:
        return row_keys(self.rows(starts, level))

    def in_order(self, starts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes sorted by their first ``depth`` words or more, and their first-level keys."""
        keys = self.keys(starts, 0)
        order = np.argsort(keys, kind="stable")
        starts, keys = starts[order], keys[order]
        new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        level = 1
        while level * self.width < depth:
            group = np.cumsum(new)
            tied = np.flatnonzero(np.bincount(group, minlength=1)[group] > 1)
            tied = tied[self.run[starts[tied]] >= level * self.width]
            if not len(tied):
                break
            # equal suffixes all go on, or all end here
            number = np.unique(self.keys(starts[tied], level), return_inverse=True)[1]
            by = np.lexsort((number, group[tied]))
            starts[tied], number = starts[tied[by]], number[by]
            new[tied[1:]] |= number[1:] != number[:-1]
            level += 1
        return starts, keys


class Queries:
    """The items of a block as one line of word numbers, and their suffixes in order."""

    def __init__(self, items: list[tuple[str, str]], window: int) -> None:
        self.window, self.names = window, [name for name, _ in items]
        self.number: dict[bytes, int] = {}
        lines = [[self.number.setdefault(w, len(self.number) + 1) for w in words_of(text)] for _, text in items]
        lengths = np.array([len(x) for x in lines], np.int64)
        self.begins = np.cumsum(lengths + 1) - (lengths + 1)
        self.depth = int(lengths.max(initial=0))
        line = np.zeros(int((lengths + 1).sum()), np.uint32)
        for at, x in zip(self.begins, lines):
            line[at : at + len(x)] = x
        self.line = Line(line, window)
        sizes = np.minimum(lengths, window)
        n = np.where(lengths > 0, lengths - sizes + 1, 0)
        starts = np.repeat(self.begins - (np.cumsum(n) - n), n) + np.arange(n.sum())
        self.starts = self.line.in_order(starts, self.depth)[0]
        self.item = np.searchsorted(self.begins, self.starts, "right") - 1
        self.size = sizes[self.item]
        self.shortest = int(self.size.min()) if len(self.starts) else 0

    @cached_property
    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct windows as lowest and highest keys, the window of each suffix, the first suffix of each."""
        rows = self.line.rows(self.starts, 0)
        low, first, which = np.unique(row_keys(rows), return_index=True, return_inverse=True)
        rows = rows[first]
        rows[rows == 0] = 2**32 - 1  # a short item may go on with any word
        return low, row_keys(rows), which, first

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "windows"}


def _bisected(line: Line, starts: np.ndarray, level: int, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, after: bool) -> np.ndarray:
    """Where each wanted key belongs among its own range of suffixes, by the words of a level."""
    low, high = low.copy(), high.copy()
    while len(at := np.flatnonzero(low < high)):
        middle = (low[at] + high[at]) // 2
        keys = line.keys(starts[middle], level)
        right = keys <= wanted[at] if after else keys < wanted[at]
        low[at[right]], high[at[~right]] = middle[right] + 1, middle[~right]
    return low


def _common(a: Line, i: np.ndarray, b: Line, k: np.ndarray, depth: int) -> np.ndarray:
    """How many words each two suffixes have in common at the start."""
    length, open_, level = np.zeros(len(i), np.int64), np.arange(len(i)), 0
    while len(open_) and level * a.width < depth:
        x = a.rows(i[open_], level)
        same = (x == b.rows(k[open_], level)) & (x != 0)
        n = np.where(same.all(1), a.width, same.argmin(1))
        length[open_] += n
        open_, level = open_[n == a.width], level + 1
    return length


def searched(line: Line, queries: Queries) -> tuple[np.ndarray, ...]:
    """Occurring windows as (position, window), and of these positions the (position, match length, suffix)."""
    none = np.zeros(0, np.int64)
    if not queries.shortest:
        return none, none, none, none, none
    starts = np.flatnonzero(line.run[:-1] >= queries.shortest)
    starts, keys = line.in_order(starts, queries.depth)
    window_low, window_high, which, first_of = queries.windows
    low, high = np.searchsorted(keys, window_low, "left"), np.searchsorted(keys, window_high, "right")
    n = np.maximum(high - low, 0)
    windows = np.repeat(np.arange(len(n)), n)
    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
    if not len(at):
        return none, none, none, none, none
    # the place of every suffix whose window occurs among the shard's suffixes, level by level
    own = np.flatnonzero(n[which] > 0)
    place, end = low[which[own]], high[which[own]]
    open_, level = np.flatnonzero(queries.size[own] == queries.window), 1
    while len(open_) and level * queries.window < queries.depth:
        wanted = queries.line.keys(queries.starts[own[open_]], level)
        first = _bisected(line, starts, level, wanted, place[open_], end[open_], False)
        last = _bisected(line, starts, level, wanted, place[open_], end[open_], True)
        place[open_], end[open_] = first, last
        open_, level = open_[(first < last) & (queries.line.run[queries.starts[own[open_]]] > (level + 1) * queries.window)], level + 1
    hit = np.unique(at)
    after = np.searchsorted(place, hit, "right")
    before, after = own[np.maximum(after - 1, 0)], own[np.minimum(after, len(own) - 1)]
    one, two = (_common(line, starts[hit], queries.line, queries.starts[k], queries.depth) for k in (before, after))
    length, suffix = np.maximum(one, two), np.where(one >= two, before, after)
    # without a whole window of a long item: the longest short item that occurs here
    order = np.lexsort((-queries.size[first_of[windows]], at))
    best = first_of[windows[order[np.searchsorted(at[order], hit)]]]
    short = length < queries.window
    return starts[at], windows, starts[hit], np.where(short, queries.size[best], length), np.where(short, best, suffix)


def marks(texts: list[str | None], queries: Queries) -> list[tuple]:
    """For each text the values of RESULT."""
    number, per_text = queries.number, [words_of(t) for t in texts]
    counts = np.array([len(w) for w in per_text], np.int64)
    starts = np.cumsum(counts + 1) - (counts + 1)  # a 0 parts the texts
    ids = np.zeros(int((counts + 1).sum()), np.uint32)
    for at, words in zip(starts, per_text):
        if words:
            ids[at : at + len(words)] = np.fromiter((number.get(w, 0) for w in words), np.uint32, len(words))
    del per_text
    out: list[tuple] = [(int(n), 0, *NO_MATCH) for n in counts]
    places, windows, hit, length, suffix = searched(Line(ids, queries.window), queries)
    if not len(places):
        return out
    _, _, which, first = queries.windows
    edge = np.zeros(len(ids) + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, places + queries.size[first[windows]], -1)
    marked = np.cumsum(edge)[:-1] > 0
    # suffixes of a window, in order: their items are those the window occurs for
    by_window = np.argsort(which, kind="stable")
    bounds = np.searchsorted(which[by_window], np.arange(len(first) + 1))
    owner = np.searchsorted(starts, places, "right") - 1
    seen = np.unique(owner * len(first) + windows)
    owner, windows = seen // len(first), seen % len(first)
    order = np.lexsort((hit, -length, np.searchsorted(starts, hit, "right")))
    of = np.searchsorted(starts, hit[order], "right") - 1
    best = dict(zip(*(x.tolist() for x in np.unique(of, return_index=True))))
    for i in np.unique(owner):
        mine = windows[slice(*np.searchsorted(owner, [i, i + 1]))]
        items = {queries.names[k] for w in mine for k in queries.item[by_window[bounds[w] : bounds[w + 1]]]}
        bits = marked[starts[i] : starts[i] + counts[i]]
        top = order[best[i]]
        k = queries.item[suffix[top]]
        out[i] = (int(counts[i]), int(bits.sum()), sorted(items), int(length[top]), queries.names[k], int(hit[top] - starts[i]), int(queries.starts[suffix[top]] - queries.begins[k]), np.packbits(bits).tobytes())
    return out


def _merged(rows: list[tuple]) -> tuple:
    """The marks of one text by several blocks of items."""
    bits = [np.frombuffer(r[-1], np.uint8) for r in rows if r[-1]]
    hits = np.bitwise_or.reduce(bits) if bits else np.zeros(0, np.uint8)
    best = min(rows, key=lambda r: (-r[3], r[5] if r[5] is not None else -1, r[4] or ""))
    return (rows[0][0], int(np.unpackbits(hits).sum()), sorted({x for r in rows for x in r[2]}), *best[3:7], hits.tobytes())


def contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 13, block_bytes: int = 4 << 20) -> DataFrame:
    """The rows of ``docs`` with n_words, n_hit, items, longest_match, match_item, match_start, item_start and hits.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter item.  ``n_hit`` counts the words of the document inside any
    occurrence of a window, ``items`` lists the items (as text, sorted) with
    occurring windows, ``hits`` has the hit words as bits.  ``longest_match`` is
    the length in words of the longest verbatim match with one item that has a
    whole window; it starts at word ``match_start`` of the document and at word
    ``item_start`` of ``match_item`` (both from 0; of equal ones the first).

    Null and empty texts have no words, hence no hits; items with a null id or
    text are left out; repeated rows keep a row each; an empty benchmark marks
    nothing.  A very long text is a shard of its own in one task.  A column of
    ``docs`` named like a result is replaced by it.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).dropna()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    kept = [c for c in docs.columns if c.lower() not in RESULT]

    def scanned(rows: DataFrame, block: int) -> DataFrame:
        mine = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        known = spark.sparkContext.broadcast(Queries(sorted(tuple(r) for r in mine.collect()), window))
        fields = [f for f in rows.schema if f.name in kept or f.name == "__row"]
        schema = T.StructType([*fields, *(T.StructField(k, v) for k, v in RESULT.items())])

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            queries, arrow, names = known.value, to_arrow_schema(schema), [f.name for f in fields]
            for batch in by_bytes(batches, text_col, PIECE):
                found = zip(*marks(batch.column(text_col).to_pylist(), queries))
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *(pa.array(list(v), arrow.field(k).type) for v, k in zip(found, RESULT))], names=schema.names)

        return rows.mapInArrow(scan, schema)

    if blocks == 1:
        return scanned(docs.select(*dict.fromkeys([*kept, text_col])), 0)

    schema = T.StructType([T.StructField("__row", T.LongType()), *docs.select(*kept).schema])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = row_ids()
        for batch in batches:
            numbers = pa.array([next(ids) for _ in range(batch.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([numbers, *batch.columns], names=["__row", *kept])

    rows = written(docs.select(*kept).mapInArrow(numbered, schema), "decontaminate")
    parts = None
    for block in range(blocks):
        # texts without a hit need no merging; their words are counted by the first block
        part = scanned(rows.select("__row", text_col), block).select("__row", *RESULT)
        part = part if block == 0 else part.filter("n_hit > 0")
        parts = part if parts is None else parts.unionByName(part)
    result = T.StructType([T.StructField("__row", T.LongType()), *(T.StructField(k, v) for k, v in RESULT.items())])

    def merge(group: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(result)
        found = _merged(list(zip(*(group.column(n).to_pylist() for n in RESULT))))
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip((group.column("__row")[0].as_py(), *found), arrow)], schema=arrow)

    return rows.join(parts.groupBy("__row").applyInArrow(merge, result), "__row").select(*kept, *RESULT)


def is_contaminated(least_hits: int = 1, share: int = 20):
    """At least 1/``share`` of the words, and ``least_hits`` of them, are hit."""
    return (F.col("n_hit") >= least_hits) & (share * F.col("n_hit") >= F.col("n_words"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with just their columns.

    Null and empty texts stay, whatever the benchmark; rows are judged one by
    one, so repeated rows share a verdict.
    """
    clash = [c for c in docs.columns if c.lower() in RESULT]
    safe = docs.withColumnsRenamed({c: f"__kept_{c}" for c in clash})
    if (text := options.get("text_col", "text")) in clash:
        options["text_col"] = f"__kept_{text}"
    found = contamination(safe, benchmark, **options).filter(~is_contaminated())
    return found.select(*safe.columns).withColumnsRenamed({f"__kept_{c}": c for c in clash})


def items_digest(items: str = "items"):
    return F.sha2(F.array_join(items, ","), 256)

