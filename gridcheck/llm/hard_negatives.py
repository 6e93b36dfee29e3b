"""Hard negatives of anchors, by a multiway tree of split points with distance ranges.

Score is the integer inner product with the anchor, so a row with score s lies at
the distance sqrt(|a|^2 + |x|^2 - 2 s) from it: a window of scores is an annulus
around the anchor, the wider the more the norms below a subtree differ.

Each node of the tree has a few split points; a row goes to the nearest, which cuts
space along hyperplanes.  For every pair of a split point i and a subtree j the node
stores the least and the largest distance from i to the rows of j.  A search compares
its annulus with them: by the triangle inequality, j can be left out if the distances
that its rows would have from i lie outside what is stored.  What is left ends in
leaves, whose rows are all compared exactly.

The tree is fitted on a bounded sample, its ranges come from all rows.  Leaves that
are large (a vector of a third of all rows) are dealt to several parts.  Rows meet the
anchors part by part: a task holds the rows of one part, anchors go by in batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table as table
from .common import written

#: Split points of a node.
WAYS = 8
#: Rows of a leaf that is wished for, of a part at most (about), and leaves at most.
LEAF_ROWS, PART_ROWS, LEAVES = 4096, 16384, 1024
#: Rows that fit the tree, about (each is drawn with the same chance), and numbers in them and in the rows of a part.
SAMPLE, SAMPLE_SIZE, PART_SIZE = 8192, 1 << 20, 1 << 21
#: Relative room for the rounding of distances.
SLACK = 1e-9
LOWEST = -(1 << 62)


@dataclass
class Node:
    """Split points with their squared norms; ``child``: a node, or -1 - leaf; ranges over all rows."""

    points: np.ndarray
    child: list[int] = field(default_factory=list)
    near: np.ndarray | None = None  # [i, j]: the least distance from point i to the rows of subtree j
    far: np.ndarray | None = None
    norm: np.ndarray | None = None  # [j]: least and largest squared norm, and the number of rows


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2.0 * (x @ points.T)
    return np.sqrt(np.maximum(squares, 0.0))


class Tree:
    """Split points fitted on ``sample`` (float64 rows), with about ``leaves`` leaves."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 5) -> None:
        self.nodes: list[Node] = []
        self.leaves, self.width = 0, sample.shape[1]
        self.most = max(1, len(sample) // max(1, leaves))
        self.root = self._grow(sample, np.random.default_rng(seed), 0)

    def _grow(self, rows: np.ndarray, rng: np.random.Generator, depth: int) -> int:
        points = self._split_points(rows, rng) if len(rows) > self.most and depth < 12 else rows[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        at = len(self.nodes)
        self.nodes.append(Node(points))
        nearest = distances(rows, points).argmin(1)
        for j in range(len(points)):
            child = self._grow(rows[nearest == j], rng, depth + 1)
            self.nodes[at].child.append(child)
        return at

    def _split_points(self, rows: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """Of some rows, those that are far from each other: each is the farthest from all before."""
        some = np.unique(rows[rng.permutation(len(rows))[: 4 * WAYS]], axis=0)
        chosen = [int(rng.integers(len(some)))]
        gap = distances(some, some[chosen])[:, 0]
        while len(chosen) < WAYS and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, distances(some, some[chosen[-1:]])[:, 0])
        return some[chosen]

    def walk(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows, their distances to its split points, the nearest) for every node that rows pass."""
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if at < 0 or not len(rows):
                continue
            d = distances(x[rows], self.nodes[at].points)
            nearest = d.argmin(1)
            yield at, rows, d, nearest
            todo += [(child, rows[nearest == j]) for j, child in enumerate(self.nodes[at].child)]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int64)
        for at, rows, _, nearest in self.walk(x):
            child = np.array(self.nodes[at].child)[nearest]
            out[rows[child < 0]] = -1 - child[child < 0]
        return out

    def ranges(self, x: np.ndarray) -> Iterator[tuple[int, int, int, float, float, int]]:
        """(node, subtree, split point, least, largest, rows) over some rows; split point -1: squared norms."""
        norms = (x * x).sum(1)
        for at, rows, d, nearest in self.walk(x):
            for j in np.unique(nearest).tolist():
                mine = nearest == j
                own, n = norms[rows[mine]], int(mine.sum())
                yield at, j, -1, float(own.min()), float(own.max()), n
                low, high = d[mine].min(0), d[mine].max(0)
                yield from ((at, j, i, float(low[i]), float(high[i]), n) for i in range(len(low)))

    def learn(self, found: list[tuple[int, int, int, float, float, int]]) -> None:
        for node in self.nodes:
            m = len(node.points)
            node.near, node.far, node.norm = np.full((m, m), np.inf), np.full((m, m), -np.inf), np.tile([np.inf, -np.inf, 0.0], (m, 1))
        for at, j, i, low, high, n in found:
            node = self.nodes[at]
            if i < 0:
                node.norm[j] = low, high, n
            else:
                node.near[i, j], node.far[i, j] = low, high

    def leaf_counts(self) -> np.ndarray:
        out = np.zeros(max(1, self.leaves), np.int64)
        for node in self.nodes:
            for j, child in enumerate(node.child):
                if child < 0:
                    out[-1 - child] = int(node.norm[j, 2])
        return out

    def reached(self, anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, queries that may have rows of it with a score in [low, high])."""
        norms = (anchors * anchors).sum(1)
        todo = [(self.root, np.arange(len(anchors)))]
        while todo:
            at, q = todo.pop()
            if at < 0:
                if len(q):
                    yield -1 - at, q
                continue
            node = self.nodes[at]
            d = distances(anchors[q], node.points)
            for j, child in enumerate(node.child):
                if not node.norm[j, 2]:
                    continue
                # the annulus, wide enough for every norm below
                outer = norms[q] + node.norm[j, 1] - 2.0 * low[q]
                inner = norms[q] + node.norm[j, 0] - 2.0 * high[q]
                room = SLACK * (1.0 + norms[q] + node.norm[j, 1])
                r2, r1 = np.sqrt(np.maximum(outer + room, 0.0)), np.sqrt(np.maximum(inner - room, 0.0))
                least = np.maximum(np.maximum(d - r2[:, None], r1[:, None] - d), 0.0)
                slack = SLACK * (1.0 + d + r2[:, None])
                meets = (node.far[:, j][None, :] >= least - slack) & (node.near[:, j][None, :] <= d + r2[:, None] + slack)
                todo.append((child, q[(outer + room >= 0) & meets.all(1)]))


# batches of rows as numbers


def vectors_of(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(256 x) of each component, short vectors filled with zeros, and which rows take part."""
    n = len(column)
    lengths = column.value_lengths()
    lengths = np.where(np.array(column.is_valid()), lengths.fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = column.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(n), lengths)
    fine = np.array(column.is_valid())
    fine[row[~np.isfinite(values)]] = False
    out = np.zeros((n, width))
    place = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = np.isfinite(values) & (place < width)
    out[row[inside], place[inside]] = np.floor(256.0 * values[inside])
    return out, fine


def products(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles while these are exact, else in whole numbers of any size, cut to 62 bits."""
    if len(a) and len(x) and np.sqrt((a * a).sum(1).max()) * np.sqrt((x * x).sum(1).max()) >= 2.0**52:
        whole = lambda m: np.vectorize(int, otypes=[object])(m)
        return np.clip(whole(a) @ whole(x).T, LOWEST, -LOWEST).astype(np.int64)
    return (a @ x.T).astype(np.int64)


def first(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the ``n`` largest, of equal ones the first."""
    if len(scores) > n:
        least = np.partition(scores, len(scores) - n)[len(scores) - n]
        some = np.flatnonzero(scores >= least)
        return some[np.argsort(-scores[some], kind="stable")[:n]]
    return np.argsort(-scores, kind="stable")


class HardNegatives:
    """The search over one table of vectors.

    ``window``: a negative's score lies between these percents of its positive's;
    ``k`` positives an anchor, ``k`` negatives a positive.  Anchors are rows whose
    id is divisible by ``every``.

    Rows with a null label, a null vector or a component that is null or not finite
    take no part.  Rows with null ids are never anchors and come last among equal
    scores.  Repeated rows are rows of their own (an anchor is left out of its own
    positives once); of equal scores and ids any comes first.  Vectors that are
    shorter than others count as filled with zeros, empty ones too.  Without rows,
    anchors or positives there is no result.  Columns beside id, vector and label
    are ignored.  Scores beyond 62 bits are cut to that.
    """

    def __init__(self, rows: DataFrame, every: int = 100, k: int = 5, window: tuple[int, int] = (80, 100), id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> None:
        self.k, self.window, self.every = k, window, every
        self.rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"), F.monotonically_increasing_id().alias("row")).filter("label IS NOT NULL AND v IS NOT NULL")
        self.vector_type = dict(self.rows.dtypes)["v"]
        size = self.rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
        self.n, self.width = size.n, max(1, size.width or 1)
        self._fit()

    def _fit(self) -> None:
        wished = max(64, min(SAMPLE, SAMPLE_SIZE // self.width))
        chance = min(1.0, wished / max(1, self.n))
        mixed = F.pmod(F.xxhash64("id", "row"), F.lit(1 << 40))
        sample = self.rows.filter(mixed < int(chance * (1 << 40))).select("id", "label", "v").limit(4 * wished).toArrow()
        x, fine = vectors_of(_whole(sample.column("v")), self.width)
        self.sample = x[fine]
        self.sample_ids = sample.column("id").to_numpy()[fine]
        self.sample_labels = sample.column("label").to_numpy()[fine]
        self.tree = tree = Tree(self.sample, min(LEAVES, max(1, self.n // LEAF_ROWS)))
        width = self.width

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: dict[tuple[int, int, int], list] = {}
            for batch in batches:
                x, fine = vectors_of(batch.column("v"), width)
                for at, j, i, low, high, n in tree.ranges(x[fine]):
                    old = found.get((at, j, i))
                    found[at, j, i] = [low, high, n] if old is None else [min(old[0], low), max(old[1], high), old[2] + n]
            out = [(*key, *value) for key, value in found.items()]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["node", "subtree", "point", "low", "high", "n"])

        if tree.nodes:  # rows of the result: WAYS * (WAYS + 1) for each node, whatever the input
            ranges = self.rows.select("v").mapInArrow(measure, "node int, subtree int, point int, low double, high double, n long")
            tree.learn([tuple(r) for r in ranges.groupBy("node", "subtree", "point").agg(F.min("low"), F.max("high"), F.sum("n")).collect()])
            counts = tree.leaf_counts()
        else:
            counts = np.array([self.n])
        self.parts = np.maximum(1, -(-counts // max(64, min(PART_ROWS, PART_SIZE // self.width))))
        self.first_part = np.concatenate([[0], np.cumsum(self.parts)])
        every = int(self.first_part[-1])
        self.tasks = every if every <= 2048 else max(2048, every // 16)

    def _dealt(self) -> DataFrame:
        """All rows with their part."""
        tree, width, parts, firsts = self.tree, self.width, self.parts, self.first_part

        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x, fine = vectors_of(batch.column("v"), width)
                leaf = tree.leaf_of(x)
                salt = batch.column("salt").to_numpy().astype(np.uint64)
                part = firsts[leaf] + (salt % parts[leaf].astype(np.uint64)).astype(np.int64)
                out = pa.RecordBatch.from_arrays([pa.array(part), batch.column("id"), batch.column("label"), batch.column("v")], names=["part", "id", "label", "v"])
                yield out.filter(pa.array(fine))

        rows = self.rows.select("id", "label", "v", F.pmod(F.xxhash64("id", "row"), F.lit(1 << 40)).alias("salt"))
        return rows.mapInArrow(deal, f"part long, id long, label long, v {self.vector_type}")

    def _asked(self, queries: DataFrame) -> DataFrame:
        """Anchors with their score windows (``aid``, ``q``, ``id``, ``label``, ``v``, ``low``, ``high``), once for each part they must meet."""
        tree, width, parts, firsts = self.tree, self.width, self.parts, self.first_part

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    a, _ = vectors_of(batch.column("v"), width)
                    low, high = (batch.column(n).to_numpy().astype(np.float64) for n in ("low", "high"))
                    for leaf, q in tree.reached(a, low, high) if tree.nodes else [(0, np.arange(len(a)))]:
                        sub = batch.take(pa.array(q))
                        for part in range(int(firsts[leaf]), int(firsts[leaf] + parts[leaf])):
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), part)), *sub.columns], names=["part", *sub.schema.names])

        return queries.select("aid", "q", "id", "label", "v", "low", "high").mapInArrow(route, f"part long, aid long, q int, id long, label long, v {self.vector_type}, low long, high long")

    def _met(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """For each query the first ``k`` rows of each part, of its own label or of others, with a score in its window."""
        width = self.width
        none = lambda t: F.lit(None).cast(t)
        rows = self._dealt().select("part", F.lit(0).alias("kind"), none("long").alias("aid"), none("int").alias("q"), "id", "label", "v", none("long").alias("low"), none("long").alias("high"))
        both = rows.unionByName(self._asked(queries).withColumn("kind", F.lit(1)))
        dealt = both.repartition(self.tasks, "part").sortWithinPartitions("part", "kind")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, held, part = None, [], None
            for batch in batches:
                keys, kinds = batch.column("part").to_numpy(), batch.column("kind").to_numpy()
                cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                    if a == b:
                        continue
                    if keys[a] != at:
                        at, held, part = keys[a], [], None
                    piece = batch.slice(a, b - a)
                    if kinds[a] == 0:
                        held.append(piece)
                        continue
                    if part is None:
                        part, held = _Part(held, width), []
                    for i in range(0, piece.num_rows, 128):
                        yield part.search(piece.slice(i, 128), same, k)

        return dealt.mapInArrow(meet, "aid long, q int, id long, score long, self boolean")

    def _queries(self, found: DataFrame, same: bool) -> DataFrame:
        """Queries whose lower bound is raised to what the k-th best row of the sample has: no worse row can be a result."""
        width, k, sample, labels = self.width, self.k + same, self.sample, self.sample_labels

        def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for at in range(0, whole.num_rows, 128):
                    batch = whole.slice(at, 128)
                    a, _ = vectors_of(batch.column("v"), width)
                    low, high = batch.column("low").to_numpy().copy(), batch.column("high").to_numpy()
                    fits = (batch.column("label").to_numpy()[:, None] == labels[None, :]) == same
                    scores = products(a, sample)
                    scores = np.where(fits & (scores >= low[:, None]) & (scores <= high[:, None]), scores, LOWEST)
                    if scores.shape[1] >= k:
                        low = np.maximum(low, np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k])
                    yield batch.set_column(batch.schema.get_field_index("low"), "low", pa.array(low))

        return found.mapInArrow(bound, f"aid long, q int, id long, label long, v {self.vector_type}, low long, high long")

    def anchors(self) -> DataFrame:
        width = self.width

        def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(vectors_of(batch.column("v"), width)[1]))

        chosen = self.rows.filter(F.col("id") % self.every == 0).select(F.col("row").alias("aid"), F.lit(0).alias("q"), "id", "label", "v", F.lit(LOWEST).alias("low"), F.lit(-LOWEST).alias("high"))
        return chosen.mapInArrow(usable, chosen.schema)

    def triples(self) -> DataFrame:
        """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``."""
        anchors = written(self._queries(self.anchors(), True), "anchors")
        order = Window.partitionBy("aid").orderBy(F.desc("score"), F.asc_nulls_last("id"), F.desc("self"))
        # an anchor meets itself among the rows of its label: one more is asked for, and it is left out once
        best = self._met(anchors, True, self.k + 1).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= self.k + 1)
        selves = F.sum(F.col("self").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        positives = best.withColumn("selves", selves).filter("NOT (self AND selves = 1)").withColumn("q", (F.col("rank") - F.least("selves", F.lit(1))).cast("int")).filter(F.col("q") <= self.k)
        positives = written(positives.select("aid", "q", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        # low: the least whole score s with 100 s >= percent * positive score
        least, most = self.window
        low, high = F.expr(f"-((-{least} * positive_score) div 100)"), F.expr(f"({most} * positive_score) div 100")
        low = low + F.when(low * 100 < F.col("positive_score") * least, 1).otherwise(0)
        high = high - F.when(high * 100 > F.col("positive_score") * most, 1).otherwise(0)
        asked = anchors.drop("low", "high", "q").join(positives, "aid").select("aid", "q", "id", "label", "v", low.alias("low"), high.alias("high")).filter("low <= high")
        queries = written(self._queries(asked, False), "queries")
        first_of = Window.partitionBy("aid", "q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        negatives = self._met(queries, False, self.k).withColumn("rank", F.row_number().over(first_of)).filter(F.col("rank") <= self.k)
        named = positives.join(anchors.select("aid", F.col("id").alias("anchor_id")), "aid")
        return negatives.join(named, ["aid", "q"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _whole(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


class _Part:
    """The rows of one part, by id, nulls last."""

    def __init__(self, held: list[pa.RecordBatch], width: int) -> None:
        self.width = width
        if not held:
            self.ids = pa.array([], pa.int64())
            self.labels, self.x = np.zeros(0, np.int64), np.zeros((0, width))
            return
        rows = pa.Table.from_batches([b.select(["id", "label", "v"]) for b in held]).sort_by([("id", "ascending")])
        self.ids = _whole(rows.column("id"))
        self.labels = rows.column("label").to_numpy()
        self.x = vectors_of(_whole(rows.column("v")), width)[0]

    def search(self, queries: pa.RecordBatch, same: bool, k: int) -> pa.RecordBatch:
        a = vectors_of(queries.column("v"), self.width)[0]
        out: dict[str, list] = {n: [] for n in ("aid", "q", "at", "score", "self")}
        low, high, labels, ids = (queries.column(n).to_pylist() for n in ("low", "high", "label", "id"))
        scores = products(a, self.x)
        for i, (aid, q) in enumerate(zip(queries.column("aid").to_pylist(), queries.column("q").to_pylist())):
            s = scores[i]
            some = np.flatnonzero(((self.labels == labels[i]) == same) & (s >= low[i]) & (s <= high[i]))
            best = some[first(s[some], k)]
            for at in best.tolist():
                out["aid"].append(aid)
                out["q"].append(q)
                out["at"].append(at)
                out["score"].append(int(s[at]))
                out["self"].append(bool(same and self.ids[at].as_py() == ids[i] and (self.x[at] == a[i]).all()))
        return pa.RecordBatch.from_arrays([pa.array(out["aid"], pa.int64()), pa.array(out["q"], pa.int32()), self.ids.take(pa.array(out["at"], pa.int64())), pa.array(out["score"], pa.int64()), pa.array(out["self"], pa.bool_())], names=["aid", "q", "id", "score", "self"])
