"""Exact Jaccard self-join of word n-gram sets, by partitioning the universe.

1. Count filter.  A set with a partner at similarity t shares at least t of its
   n-grams with another set.  Each task packs the n-gram hashes of its distinct
   sets by hash range; each range finds the hashes that two or more sets have;
   sets with too few of them are out.  Only sets that remain are joined.
2. Pigeonhole.  Sizes fall into bands that grow by 1/t, so partners are in the
   same or neighbouring bands.  For the pairs that start in a band, two sets
   differ in at most H n-grams.  The universe is cut into m segments by hash.
   With identity keys (the n-grams of one segment), m > H segments leave one
   equal in both sets; with one-deletion neighbourhoods (a segment, or it
   without one n-gram) half as many do.  ``allocate`` takes what costs less,
   by the number of keys and the keys too small to select.
3. Links are verified on the sets themselves.  Candidates are tested best first
   while components grow; pairs inside a component need no test.  After each
   round the count filter is applied again to the sets that share a key with
   another component, now by component: a set that does not share t of its
   n-grams with sets of other components has all its links.  What is still
   open is compared in full: each set with the blocks of sets where a set of
   another component has one of its keys.

4. All links are inside components.  They are counted there, in blocks of sets;
   n-grams that many sets of a block have are counted by products of matrices.
   No pair becomes a row.

N-grams are compared by 64-bit hashes, equal sets by 128 bits: two different
n-grams of one comparison agree with a chance of 2 ** -64 for each pair of them.
The filters hold only 32 bits within a range; that may keep a set that has no
partner, never lose one that has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, dropped, ending, loosened, mixed, released, rows_of, squeezed, written

#: N-gram hashes that one hash range holds, about.
RANGE = 2_000_000
#: Ranges that a packet of a task is dealt to at once; more are dealt to in two steps.
FAN = 2048
#: N-grams, and documents, that a task packs together.
SENT, ROWS = 750_000, 100_000
#: Sets whose counts are summed together, about.
BUCKET = 10_000
#: N-grams of open sets, or of a component's, that one block holds, about.
CHUNK = 250_000
#: N-grams that one set in so many of a block has, or more, are counted by a product of matrices.
OFTEN = 32
#: Pairs of sets whose shared n-grams are counted at once, about.
CELLS = 1 << 17
#: Candidate sets that may be sent to every task as ids.
BROADCAST_IDS = 1_000_000
#: Words whose hashes a task remembers; then it starts afresh.
REMEMBERED = 200_000
#: Bytes of sets and keys that a task returns at once, about.
RETURNED = 4 << 20
#: Cost of a key whose segment has at most one n-gram, in keys.
SMALL_KEY = 20


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > REMEMBERED:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 7)
        return found


_words = _Words()


def _forget() -> None:
    _words.clear()


def ngram_set(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's n-grams of words.

    A-Z are lowered, words end at ASCII white space.  A text with fewer words
    has one n-gram, all its words; without words the set is empty.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    size = min(n, len(words))
    out = np.zeros(len(words) - size + 1, np.uint64)
    for k in range(size):
        out = mixed(out + hashes[k : len(words) - size + 1 + k] + np.uint64(0x9E3779B97F4A7C15 + size))
    return np.unique(out)


def fingerprint(grams: np.ndarray) -> tuple[int, int]:
    """128 bits for a set, as two signed numbers."""
    if not len(grams):
        return 0, 0
    a = np.add.reduce(mixed(grams)) ^ np.uint64(len(grams))
    b = np.add.reduce(mixed(grams * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)))
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def partners_differ(a: int, b: int, percent: int) -> int:
    """Most n-grams in just one of two sets of these sizes at the similarity."""
    return ((100 - percent) * (a + b)) // (100 + percent)


@lru_cache(None)
def bands(percent: int, most: int) -> list[tuple[int, int]]:
    """Size bands (low, high) up to ``most``; a partner's size is at most 100/percent times a set's."""
    out, low = [], 1
    while low <= most:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return out


@lru_cache(None)
def band_of(size: int, percent: int) -> int:
    return next(i for i, (low, high) in enumerate(bands(percent, size)) if low <= size <= high)


@lru_cache(None)
def allocate(band: int, percent: int) -> tuple[int, int, bool]:
    """Segments, the most differences H, and whether keys are one-deletion neighbourhoods.

    Identity keys leave room for empty segments, which have no key.
    """
    low, high = (pair := bands(percent, 10**12))[band]
    upper = min(high * 100 // percent, pair[band + 1][1])
    differ = partners_differ(high, upper, percent)
    typical = (low + high) / 2

    def small(mean: float) -> float:
        return math.exp(-mean) * (1 + mean)

    m, empty = differ + 1, 0.0
    for _ in range(8):
        empty = m * math.exp(-low / m)
        m = differ + 1 + math.ceil(empty + 3 * math.sqrt(empty))
    half = (differ + 2) // 2
    identity = m * (1 + SMALL_KEY * small(typical / m))
    deletion = typical + half + SMALL_KEY * half * (math.exp(-typical / half) * (1 + typical / half + (typical / half) ** 2 / 2))
    return (m, differ, False) if identity <= deletion and m < typical else (half, differ, True)


def segment_keys(grams: np.ndarray, percent: int) -> np.ndarray:
    """The keys of a set for the pairs that start in its band and in the band below."""
    band = band_of(len(grams), percent)
    out = []
    for i in (band - 1, band):
        if i < 0:
            continue
        segments, differ, deletion = allocate(i, percent)
        keys, filled = _keys(grams, i, segments, deletion)
        out.append(keys)
        if not deletion and segments - filled >= segments - differ:
            # so many empty segments that all equal ones may be empty: neighbourhoods instead, besides
            out.append(_keys(grams, i, (differ + 2) // 2, True)[0])
    return np.unique(np.concatenate(out)).astype(np.int64)


def _keys(grams: np.ndarray, instance: int, segments: int, deletion: bool) -> tuple[np.ndarray, int]:
    salt = np.uint64((instance * 2 + deletion + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
    spread = mixed(grams + salt)
    segment = (spread % np.uint64(segments)).astype(np.int64)
    order = np.argsort(segment, kind="stable")
    segment, spread = segment[order], mixed(spread[order])
    firsts = np.flatnonzero(np.append(True, segment[1:] != segment[:-1]))
    sums, own = np.add.reduceat(spread, firsts), segment[firsts]
    marked = lambda s, which: mixed(s + mixed(which.astype(np.uint64) * np.uint64(3) + salt))
    keys = [marked(sums, own)]
    if deletion:
        less = np.repeat(sums, np.diff(np.append(firsts, len(segment)))) - spread
        keys.append(marked(less, segment))
        missing = np.setdiff1d(np.arange(segments), own)
        keys.append(marked(np.zeros(len(missing), np.uint64), missing))
    return np.concatenate(keys), len(firsts)


PACKET = T.StructType([T.StructField("range", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("hashes", "fans", "sids", "labels"))])


def _cut(grams: np.ndarray, fans: np.ndarray, sids: np.ndarray, labels: np.ndarray, ranges: int, wide: bool) -> Iterator[dict]:
    """A packet for each range: hashes of n-grams, how many each set has there, the sets' numbers and labels.

    ``wide`` keeps the hashes as they are, for packets that are cut again.
    """
    where = ((grams >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)
    owner = np.repeat(np.arange(len(sids), dtype=np.int32), fans)
    order = np.argsort(where, kind="stable")
    where, grams, owner = where[order], grams[order], owner[order]
    firsts = np.flatnonzero(np.append(True, where[1:] != where[:-1])) if len(where) else []
    for low, high in zip(firsts, np.append(firsts[1:], len(where))):
        used, n = np.unique(owner[low:high], return_counts=True)
        hashes = grams[low:high] if wide else mixed(grams[low:high]).astype(np.uint32)
        yield {"range": int(where[low]), "hashes": hashes.tobytes(), "fans": squeezed(n.astype(np.uint32)), "sids": sids[used].tobytes(), "labels": None if labels is sids else labels[used].tobytes()}


def _sets_in(columns: dict[str, list], wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sets of several packets, end to end: hashes, fans, sids, labels."""
    sids = np.concatenate([np.frombuffer(x, np.int64) for x in columns["sids"]])
    labels = sids if columns["labels"][0] is None else np.concatenate([np.frombuffer(x, np.int64) for x in columns["labels"]])
    hashes = np.concatenate([np.frombuffer(x, np.uint64 if wide else np.uint32) for x in columns["hashes"]])
    return hashes, np.concatenate([loosened(x, np.uint32) for x in columns["fans"]]).astype(np.int64), sids, labels


COUNTS = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("sids", T.BinaryType()), T.StructField("shared", T.BinaryType())])


def _dealt(sids: np.ndarray, shared: np.ndarray, buckets: int, coarse: bool) -> list[dict]:
    """Rows of COUNTS, one for each bucket of sets; for each group of buckets while ``coarse``."""
    again = -(-buckets // FAN)
    bucket = ((mixed(sids.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) // (again if coarse else 1)
    order = np.argsort(bucket, kind="stable")
    bucket, sids, shared = bucket[order], sids[order], shared[order]
    firsts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    return [{"bucket": int(bucket[a]), "sids": sids[a:b].tobytes(), "shared": squeezed(shared[a:b].astype(np.uint32))} for a, b in zip(firsts, np.append(firsts[1:], len(bucket)))]


def _added(columns: dict[str, list]) -> tuple[np.ndarray, np.ndarray]:
    """The sets of several rows of COUNTS, each once, with their sums."""
    sids, which = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in columns["sids"]]), return_inverse=True)
    counts = np.concatenate([loosened(x, np.uint32) for x in columns["shared"]])
    return sids, np.bincount(which, counts, len(sids)).astype(np.int64)


def _shared_counts(packets: DataFrame, ranges: int, buckets: int, extra: T.StructType) -> DataFrame:
    """COUNTS: how many of a set's n-grams in a range sets of other labels have too.

    Rows of ``packets`` with a negative range pass through with the columns of
    ``extra``.  Beyond ``FAN`` ranges the packets have been cut by the first
    ``FAN`` alone; they are cut again here, so that no task writes a row for
    each range of a large input.
    """
    if ranges > FAN:
        again = -(-ranges // FAN)
        schema = packets.schema

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            arrow = _arrow(schema)
            held: list[dict] = []

            def flushed() -> pa.RecordBatch:
                hashes, fans, sids, labels = _sets_in({k: [h[k] for h in held] for k in PACKET.names}, True)
                held.clear()
                rows = list(_cut(hashes, fans, sids, labels, FAN * again, False))
                return pa.RecordBatch.from_pylist(rows, schema=arrow)

            size = 0
            for batch in batches:
                for k in range(batch.num_rows):
                    if batch.column("range")[k].as_py() < 0:
                        yield batch.slice(k, 1)
                        continue
                    row = {n: batch.column(n)[k].as_py() for n in PACKET.names}
                    if held and (row["range"] != held[0]["range"] or size > SENT * 8):
                        yield flushed()
                        size = 0
                    held.append(row)
                    size += len(row["hashes"])
            if held:
                yield flushed()

        salt = F.pmod(F.xxhash64("sids"), F.lit(again // 8 + 1))
        packets = packets.repartition("range", salt).sortWithinPartitions("range").mapInArrow(split, schema)

    counts = T.StructType([*COUNTS, *extra])

    def shared(group: pa.Table) -> pa.Table:
        arrow = _arrow(counts)
        if group.column("range")[0].as_py() < 0:
            flat = {c: pa.chunked_array([x.flatten() for x in group.column(f"{c}s").chunks], arrow.field(c).type) for c in extra.names}
            size = len(flat[extra.names[0]])
            return pa.Table.from_arrays([flat[f.name] if f.name in flat else pa.nulls(size, f.type) for f in arrow], schema=arrow)
        hashes, fans, sids, labels = _sets_in({n: group.column(n).to_pylist() for n in PACKET.names}, False)
        del group
        # a set that several tasks sent counts once
        _, one = np.unique(sids, return_index=True)
        if len(one) < len(sids):
            keep = np.zeros(len(sids), bool)
            keep[one] = True
            hashes, fans, sids, labels = hashes[np.repeat(keep, fans)], fans[keep], sids[keep], labels[keep]
        number = np.unique(labels, return_inverse=True)[1].astype(np.int32)
        owner = np.repeat(np.arange(len(sids), dtype=np.int32), fans)
        order = np.argsort(hashes)
        hashes, owner = hashes[order], owner[order]
        del order
        firsts = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
        of = number[owner]
        several = np.minimum.reduceat(of, firsts) < np.maximum.reduceat(of, firsts)
        found = np.bincount(owner[np.repeat(several, np.diff(np.append(firsts, len(hashes))))], minlength=len(sids))
        used = np.flatnonzero(found)
        rows = _dealt(sids[used], found[used], buckets, True)
        del hashes, owner, of, several
        released()
        return pa.Table.from_pylist(rows, schema=arrow)

    return packets.groupBy("range").applyInArrow(shared, counts)


def _summed(counts: DataFrame, name: str, buckets: int) -> DataFrame:
    """(name, shared): the counts of each set over all ranges, summed bucket by bucket.

    Beyond ``FAN`` buckets the rows are of groups of buckets; they are summed in
    part and dealt to the buckets here.
    """
    if buckets > FAN:

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, list] = {"bucket": [], "sids": [], "shared": []}

            def flushed() -> pa.RecordBatch:
                rows = _dealt(*_added(held), buckets, False)
                for x in held.values():
                    x.clear()
                return pa.RecordBatch.from_pylist(rows, schema=_arrow(COUNTS))

            for batch in batches:
                for row in rows_of(batch, "bucket", "sids", "shared"):
                    if held["bucket"] and (row[0] != held["bucket"][0] or sum(map(len, held["sids"])) > SENT * 8):
                        yield flushed()
                    for k, x in zip(held, row):
                        held[k].append(x)
            if held["bucket"]:
                yield flushed()

        salt = F.pmod(F.xxhash64("sids"), F.lit(buckets // FAN // 8 + 1))
        counts = counts.repartition("bucket", salt).sortWithinPartitions("bucket").mapInArrow(split, COUNTS)

    def added(group: pa.Table) -> pa.Table:
        sids, sums = _added({k: group.column(k).to_pylist() for k in ("sids", "shared")})
        return pa.table({name: pa.array(sids, pa.int64()), "shared": pa.array(sums, pa.int64())})

    return counts.groupBy("bucket").applyInArrow(added, f"{name} long, shared long")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _filtered(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(id, key, n, a, b) of every document, and (a, shared) of the sets."""
    id_type = docs.schema["id"].dataType
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, buckets = int(total // (6 * RANGE)) + 1, int(total // (600 * BUCKET)) + 1
    extra = T.StructType([T.StructField("id", id_type), *(T.StructField(c, T.LongType()) for c in ("key", "n", "a", "b"))])
    sent = T.StructType([*PACKET, *(T.StructField(f"{f.name}s", T.ArrayType(f.dataType)) for f in extra)])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        arrow, here, number = _arrow(sent), TaskContext.get().partitionId(), 0

        def part(rows: list[tuple], sets: dict[int, np.ndarray]) -> pa.RecordBatch:
            # documents travel in groups of their own, below 0: as many as there are ranges, so a group stays small
            columns = {f"{f.name}s": list(x) for f, x in zip(extra, zip(*rows))}
            out = [{"range": -1 - (here * 1009 + number) % max(4096, ranges), **columns}]
            if sets:
                sids = np.array(list(sets), np.int64)
                fans = np.array([len(s) for s in sets.values()], np.int64)
                out += _cut(np.concatenate(list(sets.values())), fans, sids, sids, min(ranges, FAN), ranges > FAN)
            return pa.RecordBatch.from_pylist(out, schema=arrow)

        rows, sets, held = [], {}, 0
        for batch in batches:
            for name, key, text in rows_of(batch, "id", "key", "text"):
                grams = ngram_set(text, n)
                a, b = fingerprint(grams)
                rows.append((name, key, len(grams), a, b))
                if len(grams) and a not in sets:
                    sets[a] = grams
                    held += len(grams)
                if held > SENT or len(rows) > ROWS:
                    yield part(rows, sets)
                    rows, sets, held, number = [], {}, 0, number + 1
        if rows:
            yield part(rows, sets)

    parts = written(_shared_counts(docs.mapInArrow(ending(send, _forget), sent), ranges, buckets, extra), "shared")
    return parts.filter("bucket IS NULL").select(*extra.names), _summed(parts.filter("bucket IS NOT NULL").select(*COUNTS.names), "a", buckets)


def _may_link(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``cid`` of the sets (``members``: cid, label) that share enough n-grams with other labels."""
    open_sets = sets.select("cid", "n", "grams").join(members, "cid")
    total = sets.select("cid", "n").join(members, "cid").agg(F.sum("n")).first()[0] or 0
    ranges, buckets = int(total // RANGE) + 1, int(total // (100 * BUCKET)) + 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = _arrow(PACKET)

        def part(held: dict[int, tuple[int, np.ndarray]]) -> pa.RecordBatch:
            grams = [g for _, g in held.values()]
            fans, labels = np.array([len(g) for g in grams], np.int64), np.array([x for x, _ in held.values()], np.int64)
            rows = list(_cut(np.concatenate(grams), fans, np.array(list(held), np.int64), labels, min(ranges, FAN), ranges > FAN))
            return pa.RecordBatch.from_pylist(rows, schema=arrow)

        held, size = {}, 0
        for batch in batches:
            for cid, label, grams in rows_of(batch, "cid", "label", "grams"):
                held[cid] = label, np.frombuffer(grams, np.uint64)
                size += len(held[cid][1])
                if size > SENT:
                    yield part(held)
                    held, size = {}, 0
        if held:
            yield part(held)

    counts = _shared_counts(open_sets.select("cid", "label", "grams").mapInArrow(ending(send), PACKET), ranges, buckets, T.StructType([]))
    enough = _summed(counts, "cid", buckets).join(sets.select("cid", "n"), "cid").filter(F.col("shared") * 100 >= F.col("n") * percent)
    return written(enough.select("cid").distinct(), "may-link")


def _labelled(docs: DataFrame, n: int, percent: int, rounds: int, best: int, counted: bool) -> DataFrame:
    """(id, key, n, component, class) of each row of docs (id, key, text); n_links too if they are ``counted``.

    ``component`` and ``class`` are the first row, as (no id, id, key), of the
    component and of the rows with the same set; null for rows without n-grams.
    """
    rows, shared = _filtered(docs, n)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    classes = rows.filter("n > 0").groupBy("a", "b").agg(first.alias("class"), F.first("n").alias("n"))
    alive = written(classes.join(shared, "a").filter(F.col("shared") * 100 >= F.col("n") * percent).select("a", "b", "class", "n", F.monotonically_increasing_id().alias("cid")), "alive")
    wanted = alive.select(_ref(F.col("class.id"), F.col("class.key")).alias("ref"), "cid", "a", "b")
    if wanted.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        sent: set[int] = set()
        size = 0

        def part() -> pa.RecordBatch:
            cids, sizes, blobs, keys = zip(*held)
            held.clear()
            return pa.RecordBatch.from_pydict({"cid": pa.array(cids, pa.int64()), "n": pa.array(sizes, pa.int64()), "grams": pa.array(blobs, pa.binary()), "keys": pa.array(keys, pa.list_(pa.int64()))})

        for batch in batches:
            for cid, a, b, text in rows_of(batch, "cid", "a", "b", "text"):
                if cid in sent:
                    continue  # a repeated row
                grams = ngram_set(text, n)
                if fingerprint(grams) == (a, b):
                    sent.add(cid)
                    held.append((cid, len(grams), grams.tobytes(), segment_keys(grams, percent)))
                    size += grams.nbytes + held[-1][-1].nbytes
                if size > RETURNED:
                    yield part()
                    size = 0
        if held:
            yield part()

    refs = docs.select(_ref(F.col("id"), F.col("key")).alias("ref"), "text")
    sets = _once(written(refs.join(wanted, "ref").mapInArrow(ending(sets_of, _forget), "cid long, n long, grams binary, keys array<long>"), "sets"))
    keys = sets.select("cid", F.explode("keys").alias("key"))
    common = keys.groupBy("key").agg(F.max("cid").alias("last"), F.min("cid").alias("pivot")).filter("pivot < last").drop("last")
    keys = written(keys.join(common, "key").select("key", "cid", "pivot"), "keys")

    links = _links(keys, sets, rounds, best, percent)
    dropped(keys)
    labels = connected_components(links)
    linked = alive.join(labels.withColumnRenamed("node", "cid"), "cid")
    if counted:
        linked = linked.join(_degrees(labels, sets, percent), "cid", "left")
    dropped(sets)
    lowest = linked.groupBy("label").agg(F.min("class").alias("component"))
    numbers = [F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")] if counted else []
    linked = linked.join(lowest, "label").select("a", "b", "component", *(["n_links"] if counted else []))
    classes = classes.drop("n").join(linked, ["a", "b"], "left")
    named = rows.join(classes, ["a", "b"], "left")
    return named.select("id", "key", "n", F.coalesce("component", "class").alias("component"), "class", *numbers)


def _once(sets: DataFrame) -> DataFrame:
    """One row of each set: rows repeated in several tasks gave several; only these are dealt anew."""
    again = sets.groupBy("cid").agg(F.count("*").alias("copies")).filter("copies > 1").select("cid")
    if not again.limit(1).count():
        return sets
    again = written(again, "repeated")
    left = written(sets.join(again, "cid", "left_anti").unionByName(sets.join(again, "cid", "left_semi").dropDuplicates(["cid"])), "sets")
    dropped(sets)
    return left


def _ref(name: Column, key: Column) -> Column:
    """What rows are looked up by: the id, or the hash of a text without one."""
    return F.coalesce(F.concat(F.lit("="), name.cast("string")), key.cast("string"))


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, rounds: int = 2, best: int = 1) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, class_id, n_links.

    Two documents link when 100 * shared >= ``percent`` * all n-grams of both.
    ``component_id`` is the smallest id reachable by links; ``class_id`` the
    smallest id of the documents with the same set; ``n_links`` how many other
    sets its set links with, all of them.

    Null and empty texts have no n-grams, link with nothing and are their own
    component.  Rows with the same set link, whatever their ids.  Rows with a
    null id link like others; they get the smallest other id of their component,
    null if none has one.  A very long text is one set: a task holds a few.  An
    empty table gives an empty result; other columns are not read.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    found = _labelled(docs, n, percent, rounds, best, True)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component.id")).otherwise(F.col("id")).alias("component_id"), F.when(F.col("n") > 0, F.col("class.id")).otherwise(F.col("id")).alias("class_id"), "n_links")


def _links(keys: DataFrame, sets: DataFrame, rounds: int, best: int, percent: int) -> DataFrame:
    """Verified links that connect all sets that links connect."""
    spark = keys.sparkSession
    found = tested = spark.createDataFrame([], "a long, b long")
    pivots = keys.filter("cid <> pivot").select(F.col("pivot").alias("a"), F.col("cid").alias("b"))
    for turn in range(rounds + 1):
        if turn:
            mine = _open(keys, sets, connected_components(found), percent)
            if mine is None:
                break
            if turn > 1:
                dropped(keys)
            # sets that may not link now will not later: components only grow
            keys = mine.select("key", "cid")
            if turn == rounds:
                found = found.union(_in_blocks(mine, sets, percent))
                dropped(mine)
                break
            # a set of the lowest component of each key, against the sets of others
            low = mine.groupBy("key").agg(F.min("label").alias("low"))
            mine = mine.join(low, "key")
            pivot = mine.filter("label = low").groupBy("key").agg(F.max("cid").alias("pivot"))
            pivots = mine.filter("label > low").join(pivot, "key").select(F.least("pivot", "cid").alias("a"), F.greatest("pivot", "cid").alias("b"))
        order = Window.partitionBy("b").orderBy(F.col("equal").desc(), "a")
        pairs = pivots.groupBy("a", "b").agg(F.count("*").alias("equal")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)
        pairs = written(pairs.select("a", "b").join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = tested.union(pairs)
        found = found.union(written(verified(pairs, sets, percent), "links"))
    return found.distinct()


def _open(keys: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame | None:
    """(key, cid, label) where sets of several components, which may link to others, share a key; None if nowhere."""

    def several(rows: DataFrame, name: str) -> DataFrame:
        by_key = rows.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
        return written(rows.join(by_key, "key"), name)

    mine = several(keys.join(labels.withColumnRenamed("node", "cid"), "cid", "left").select("key", "cid", F.coalesce("label", "cid").alias("label")), "open")
    if not mine.limit(1).count():
        return None
    left = several(mine.join(_may_link(mine.select("cid", "label").distinct(), sets, percent), "cid").select("key", "cid", "label"), "left-open")
    dropped(mine)
    return left if left.limit(1).count() else None


def _in_blocks(open_keys: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between sets of different components that share a key.

    A set's home is the key that most open sets have of its keys.  Sets of one
    home lie in blocks of about CHUNK n-grams, small homes together in one.  A
    set visits the blocks where sets of other components have a key of its; of
    two blocks, the sets of one visit the other.  A block and about CHUNK
    n-grams of its visitors meet as one row and are compared inside the task,
    set by set through an index of n-grams; no pair becomes a row.  Such a row
    gives as many links as join components, no more.
    """
    often = open_keys.groupBy("key").agg(F.count("*").alias("often"))
    homes = open_keys.join(often, "key").groupBy("cid").agg(F.first("label").alias("label"), F.max(F.struct("often", "key"))["key"].alias("home"))
    members = written(homes.join(sets.select("cid", "n"), "cid"), "members")
    total = members.groupBy("home").agg(F.sum("n").alias("total"))
    small = F.col("total") * 2 < CHUNK
    pools = int((total.filter(small).agg(F.sum("total")).first()[0] or 0) // CHUNK) + 1
    part = F.pmod(F.xxhash64("cid"), F.ceil(F.col("total") / CHUNK).cast("long"))
    block = F.when(small, F.xxhash64(F.lit("small"), F.pmod(F.xxhash64("home"), F.lit(pools)))).otherwise(F.xxhash64("home", part))
    placed = written(members.join(total, "home").select("cid", "label", "n", block.alias("block")), "placed")
    dropped(members)

    keyed = open_keys.select("key", "cid").join(placed.select("cid", "label", "block"), "cid")
    there = keyed.groupBy("key", F.col("block").alias("at")).agg(F.min("label").alias("low"), F.max("label").alias("high"))
    visits = written(keyed.join(there, "key").filter("block >= at AND (low <> label OR high <> label)").select("cid", "at").distinct(), "visits")
    guests = visits.join(placed.select("cid", "label", "n"), "cid")
    parts = guests.groupBy("at").agg(F.ceil(F.sum("n") / CHUNK).cast("long").alias("parts"))
    guests = guests.join(parts, "at").select("cid", "at", "label", F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"))
    packed = lambda rows, *by: rows.join(sets.select("cid", "grams"), "cid").repartition(*by).groupBy(*by).agg(F.collect_list(F.struct("cid", "label", "grams")).alias("sets"))
    blocks = written(packed(placed.select("cid", "label", F.col("block").alias("at")), "at"), "blocks")
    both = packed(guests, "at", "part").withColumnRenamed("sets", "x").join(blocks.withColumnRenamed("sets", "y"), "at")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links: list[tuple[int, int]] = []
            for k in range(batch.num_rows):  # a row is large: one at a time
                joined: dict[int, int] = {}

                def root(label: int, joined=joined) -> int:
                    while (up := joined.get(label, label)) != label:
                        joined[label] = label = joined.get(up, up)
                    return label

                xs, ys = (batch.column(c)[k].as_py() for c in ("x", "y"))
                grams = [np.frombuffer(y["grams"], np.uint64) for y in ys]
                sizes, labels = np.array([len(g) for g in grams]), np.array([y["label"] for y in ys])
                every, owner = np.concatenate(grams), np.repeat(np.arange(len(ys)), sizes)
                order = np.argsort(every, kind="stable")
                every, owner = every[order], owner[order]
                for x in xs:
                    own = np.frombuffer(x["grams"], np.uint64)
                    low, high = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
                    n = high - low
                    at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    both = np.bincount(owner[at], minlength=len(ys))
                    hit = np.flatnonzero((100 * both >= percent * (len(own) + sizes - both)) & (labels != x["label"]))
                    _, first = np.unique(labels[hit], return_index=True)
                    for y in (ys[k] for k in hit[first]):
                        if (one := root(x["label"])) != (two := root(y["label"])):
                            joined[one] = two
                            links.append((min(x["cid"], y["cid"]), max(x["cid"], y["cid"])))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    links = written(both.select("x", "y").mapInArrow(ending(compare), "a long, b long").distinct(), "links")
    for rows in (blocks, visits, placed):
        dropped(rows)
    return links


def _shared(xs: list[np.ndarray], ys: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """How many n-grams each of ``xs`` shares with each of ``ys``: (first row, counts), some rows at a time."""
    every, owner = np.concatenate(ys), np.repeat(np.arange(len(ys)), [len(y) for y in ys])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    firsts = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
    grams, having = every[firsts], np.diff(np.append(firsts, len(every)))
    often = np.flatnonzero(having >= max(8, len(ys) // OFTEN))
    column = np.full(len(grams), -1)
    column[often] = np.arange(len(often))
    at = np.repeat(column, having)
    right = np.zeros((len(often), len(ys)), np.float32)
    right[at[at >= 0], owner[at >= 0]] = 1
    step = max(1, CELLS // len(ys))
    for first in range(0, len(xs), step):
        part = xs[first : first + step]
        own, who = np.concatenate(part), np.repeat(np.arange(len(part)), [len(x) for x in part])
        place = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        known = grams[place] == own
        place, who = place[known], who[known]
        at = column[place]
        left = np.zeros((len(part), len(often)), np.float32)
        left[who[at >= 0], at[at >= 0]] = 1
        place, who = place[at < 0], who[at < 0]
        n = having[place]
        seen = np.repeat(firsts[place] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        single = np.bincount(np.repeat(who, n) * len(ys) + owner[seen], minlength=len(part) * len(ys))
        # counts below 2 ** 24 are exact in a product of single precision; longer sets are blocks of their own
        yield first, single.reshape(len(part), len(ys)) + np.rint(left @ right).astype(np.int64)


def _partners(xs: list[np.ndarray], ys: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """With how many of ``ys`` each of ``xs`` links, and with how many of ``xs`` each of ``ys``."""
    of_x, of_y = np.zeros(len(xs), np.int64), np.zeros(len(ys), np.int64)
    n_x, n_y = np.array([len(x) for x in xs]), np.array([len(y) for y in ys])
    for first, both in _shared(xs, ys):
        link = 100 * both >= percent * (n_x[first : first + len(both), None] + n_y - both)
        of_x[first : first + len(both)] = link.sum(1)
        of_y += link.sum(0)
    return of_x, of_y


def _degrees(labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(cid, n_links): how many other sets of its component each set links with.

    A component's sets are cut into blocks of about CHUNK n-grams, those of a
    large one by size first: bands that are not neighbours have no links.
    Blocks are compared with themselves where they are, others as pairs.
    """
    members = sets.select("cid", "n", "grams").join(labels.withColumnRenamed("node", "cid"), "cid")
    width = max(math.log(100 / percent) * 1.001, 0.02)
    total = members.groupBy("label").agg(F.sum("n").alias("total"))
    banded = members.join(total, "label").withColumn("band", F.when(F.col("total") <= CHUNK, 0).otherwise(F.floor(F.log("n") / width)).cast("long")).drop("total")
    blocks = banded.groupBy("label", "band").agg(F.ceil(F.sum("n") / CHUNK).cast("long").alias("blocks"))
    dealt = banded.join(blocks, ["label", "band"]).withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    packed = written(dealt.groupBy("label", "band", "blocks", "block").agg(F.collect_list(F.struct("cid", "grams")).alias("x")), "blocks")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a row is large: one at a time
                groups = [batch.column(c)[k].as_py() for c in batch.schema.names]
                grams = [[np.frombuffer(s["grams"], np.uint64) for s in g] for g in groups]
                found = _partners(grams[0], grams[-1], percent)
                if len(groups) == 1:  # each set met itself
                    found = (found[0] - 1,)
                cids = [s["cid"] for g in groups for s in g]
                yield pa.RecordBatch.from_pydict({"cid": pa.array(cids, pa.int64()), "n_links": pa.array(np.concatenate(found), pa.int64())})

    lower = packed.filter("block > 0").select("label", "x", "band", F.explode(F.sequence(F.lit(0).cast("long"), F.col("block") - 1)).alias("block"))
    above = blocks.select("label", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    upper = packed.join(above, ["label", "band"]).select("label", "x", (F.col("band") + 1).alias("band"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("above") - 1)).alias("block"))
    pairs = lower.unionByName(upper).join(packed.select("label", "band", "block", F.col("x").alias("y")), ["label", "band", "block"]).select("x", "y")
    schema = "cid long, n_links long"
    each = packed.select("x").mapInArrow(ending(counted), schema).unionByName(pairs.mapInArrow(ending(counted), schema))
    found = written(each.groupBy("cid").agg(F.sum("n_links").alias("n_links")), "degrees")
    dropped(packed)
    return found


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sets are as similar as asked for."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for a, b, x, y in rows_of(batch, "a", "b", "x", "y"):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    links.append((a, b))
            yield pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    near = pairs.join(sets.select(F.col("cid").alias("b"), F.col("grams").alias("y"), F.col("n").alias("n_b")), "b").join(sets.select(F.col("cid").alias("a"), F.col("grams").alias("x"), F.col("n").alias("n_a")), "a")
    close = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    return near.filter(close).select("a", "b", "x", "y").mapInArrow(ending(check), "a long, b long")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, rounds: int = 2, best: int = 1) -> DataFrame:
    """The rows of ``docs`` that are the first of their component: by id (null ones last), then by a hash of the text.

    Of rows with the same id and text, one stays.  Rows without n-grams all
    stay.  Decided by row: another text with the id of a copy is not touched.
    Very long texts and an empty table as in ``ngram_components``; all columns
    are returned as they are.
    """
    key = F.xxhash64(text_col)
    found = _labelled(docs.select(F.col(id_col).alias("id"), key.alias("key"), F.col(text_col).alias("text")), n, percent, rounds, best, False)
    found = written(found.filter("n > 0").select(_ref(F.col("id"), F.col("key")).alias("__ref"), F.col("key").alias("__key"), (_ref(F.col("component.id"), F.col("component.key")) != _ref(F.col("id"), F.col("key"))).alias("other"), (F.col("component.key") != F.col("key")).alias("text")), "components")
    go = found.filter("other OR text").select("__ref", "__key").distinct()
    again = found.filter("NOT (other OR text)").groupBy("__ref", "__key").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    keyed = docs.withColumns({"__ref": _ref(F.col(id_col), key), "__key": key})
    left = keyed.join(go, ["__ref", "__key"], "left_anti")
    # rows that repeat id and text are few; only they are compared
    once = left.join(again, ["__ref", "__key"], "left_anti")
    more = left.join(again, ["__ref", "__key"], "left_semi").dropDuplicates(["__ref", "__key"])
    return once.unionByName(more).select(*docs.columns)
