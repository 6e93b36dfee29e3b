"""Language-model scores by a weighted backoff automaton.

The model is a bigram or trigram model with absolute discounting over unigrams
with add-``alpha`` smoothing.  Every word that was seen as a history is a state,
and with trigrams every bigram is.  A kept bigram or trigram is an arc of its
history's state; every state has a failure arc, which weighs the mass left over
and leads from a bigram to its last word's state and from there to the root,
where all words have arcs.  A text is scored in one traversal from left to right that adds up
log-probabilities: the state after a word is the bigram that ends there, so the
arcs that a text follows are those of its n-grams, found when they are numbered.

Neither the vocabulary nor the bigrams fit one machine, so no machine holds
the automaton.  Documents form blocks; a block asks for what occurs in it:

1. Each block is written as its distinct words and a sequence of word numbers.
2. It sends its words and bigrams, with their counts in training documents, to
   the hash range of the (first) word.  A range adds up the counts of all
   blocks, decides which bigrams to keep, works out the mass that each state
   leaves over, and answers each block in the order of its question.
   Histories that hold more than ``HOT`` of all words (at most 1 / HOT of them)
   are spread over all ranges by the second word; their sums are a small table.
   Trigrams go with their first two words, in the order of those, and those of
   bigrams above ``HOT`` are spread by the third word.
3. Block and answers meet; they make the part of the automaton that the block
   needs, and the block's documents are traversed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_of, ending, mixed, released, rows_of, written
from .common import loosened as _unzip
from .common import squeezed as _zip

#: Words in one block, about; a longer text is a block of its own.
BLOCK = 1_500_000
#: Words whose bigrams one hash range holds, about.
RANGE = 2_000_000
#: Share of all words above which a history, a word or two, is spread.
HOT = 1e-3
#: Stands for the end of a text among the hashes of words.
END = 0x5E5D0E4D
NEXT_BYTES = 5


def _short(hashes: np.ndarray) -> np.ndarray:
    """NEXT_BYTES bytes of a second mix of the hashes, as numbers."""
    return mixed(hashes + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(64 - 8 * NEXT_BYTES)


def _pair_hashes(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    return mixed(mixed(first) + second)


def _hot_numbers(hot: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Where the hashes stand in the sorted ``hot``; -1 for others."""
    if not len(hot):
        return np.full(len(hashes), -1, np.int16)
    at = np.minimum(np.searchsorted(hot, hashes), len(hot) - 1).astype(np.int16)
    return np.where(hot[at] == hashes, at, np.int16(-1))


def _at(mask: np.ndarray) -> np.ndarray:
    return np.flatnonzero(mask).astype(np.int32)


def _by(numbers: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The numbers in the order of their keys."""
    return numbers[np.argsort(keys, kind="stable")]


def _pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :NEXT_BYTES]).tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, NEXT_BYTES)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :NEXT_BYTES] = raw
    return out.view("<u8").ravel()


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, sorted, and which one each is, in less memory than ``np.unique`` takes."""
    order = np.argsort(codes)
    codes = codes[order]
    new = np.ones(len(codes), bool)
    new[1:] = codes[1:] != codes[:-1]
    which = np.empty(len(order), np.int32)
    which[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return codes[new], which


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 1_000_000:
            self.clear()
        found = self[word] = xxhash.xxh64_intdigest(word, 11)
        return found


_words = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words and of the end."""
    words = text.encode().lower().split() if text else []
    out = np.full(len(words) + 1, END, np.uint64)
    if words:
        out[:-1] = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    return out


class Block:
    """A block's words (hashes, most frequent first), sequence and documents."""

    def __init__(self, words: np.ndarray, sequence: np.ndarray, lengths: np.ndarray, held: np.ndarray) -> None:
        self.words, self.sequence, self.lengths, self.held = words, sequence, lengths, held
        self.ends = np.cumsum(lengths) - 1
        self.trained = np.repeat(~held, lengths)

    def counts(self) -> np.ndarray:
        """Each word's count in training documents."""
        return np.bincount(self.sequence[self.trained], minlength=len(self.words))

    def bigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (first, second) as numbers of words, by first; counts in training documents; which one starts at each place, or -1."""
        inside = np.ones(len(self.sequence), bool)
        inside[self.ends] = False
        at = np.flatnonzero(inside).astype(np.int32)
        return self._distinct(at, self.sequence[at], self.sequence[at + 1])

    def _distinct(self, at: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct pairs of numbers, sorted, with counts in training documents; which one is at each place, or -1."""
        codes = left.astype(np.uint64)
        codes <<= np.uint64(32)
        codes |= right.astype(np.uint64)
        codes, which = _numbered(codes)
        counts = np.bincount(which[self.trained[at]], minlength=len(codes)).astype(np.int32)
        starts = np.full(len(self.sequence), -1, np.int32)
        starts[at] = which
        return (codes >> np.uint64(32)).astype(np.int32), (codes & np.uint64(0xFFFFFFFF)).astype(np.int32), counts, starts

    def trigrams(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (bigram, third) as numbers, by bigram; counts in training documents; which one starts at each place, or -1."""
        at = np.flatnonzero((starts[:-1] >= 0) & (starts[1:] >= 0)).astype(np.int32)
        return self._distinct(at, starts[at], self.sequence[at + 2])


class Question:
    """What a block asks each range, always in the same order."""

    def __init__(self, block: Block, hot: np.ndarray, hot_pairs: np.ndarray, ranges: int, order: int) -> None:
        self.block = block
        self.first, self.second, self.times, self.starts = block.bigrams()
        where = lambda h: ((mixed(h) >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int32)
        edges = np.arange(ranges + 1, dtype=np.int32)
        word_range = where(block.words)
        self.hot_number = _hot_numbers(hot, block.words)
        is_hot = self.hot_number[self.first] >= 0
        self.word_order = _by(np.arange(len(block.words), dtype=np.int32), word_range)
        self.word_bounds = np.searchsorted(word_range[self.word_order], edges)
        # within a range: by the place of the first word there, then as they come
        place = np.empty(len(block.words), np.int32)
        place[self.word_order] = np.arange(len(block.words), dtype=np.int32)
        plain, spread = _at(~is_hot), _at(is_hot)
        self.plain = _by(plain, place[self.first[plain]])
        self.plain_bounds = np.searchsorted(word_range[self.first[self.plain]], edges)
        # where a bigram or trigram of a hot history goes depends on its last word alone
        spread_range = where(mixed(block.words))
        self.spread = _by(spread, spread_range[self.second[spread]])
        self.spread_bounds = np.searchsorted(spread_range[self.second[self.spread]], edges)
        if order < 3:
            return
        self.pair, self.third, self.times3, self.starts3 = block.trigrams(self.starts)
        # a range's bigrams are its plain ones, then its spread ones; trigrams come in that order
        self.pair_bounds = (self.plain_bounds + self.spread_bounds).astype(np.int32)
        self.pair_place = np.empty(len(self.first), np.int32)
        for r in range(ranges):
            _, plain, spread = self.parts(r)
            self.pair_place[plain] = self.pair_bounds[r] + np.arange(len(plain))
            self.pair_place[spread] = self.pair_bounds[r] + len(plain) + np.arange(len(spread))
        self.hot_pair = _hot_numbers(hot_pairs, _pair_hashes(block.words[self.first], block.words[self.second])) if len(hot_pairs) else np.full(len(self.first), -1, np.int16)
        is_hot = self.hot_pair[self.pair] >= 0
        plain, spread = _at(~is_hot), _at(is_hot)
        self.plain3 = _by(plain, self.pair_place[self.pair[plain]])
        self.plain3_bounds = np.searchsorted(self.pair_place[self.pair[self.plain3]], self.pair_bounds)
        self.spread3 = _by(spread, spread_range[self.third[spread]])
        self.spread3_bounds = np.searchsorted(spread_range[self.third[self.spread3]], edges)

    def parts(self, r: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, plain bigrams and spread bigrams of a range, as numbers in the block."""
        cut = lambda order, bounds: order[bounds[r] : bounds[r + 1]]
        return cut(self.word_order, self.word_bounds), cut(self.plain, self.plain_bounds), cut(self.spread, self.spread_bounds)

    def parts3(self, r: int) -> tuple[np.ndarray, np.ndarray]:
        """Plain and spread trigrams of a range, as numbers in the block."""
        return self.plain3[self.plain3_bounds[r] : self.plain3_bounds[r + 1]], self.spread3[self.spread3_bounds[r] : self.spread3_bounds[r + 1]]


class Automaton:
    """The part of the automaton that a block needs.

    The states are the root, the words and the bigrams of the block.  ``root``
    are the weights of the root's arcs, ``ways`` those of the ways from the first
    word of a bigram over its second: the arc, or the failure arc and the rest.
    ``ways3`` are the same from a bigram over the third word.
    """

    def __init__(self, q: Question, root: np.ndarray, ways: np.ndarray, ways3: np.ndarray | None = None) -> None:
        self.q, self.root, self.ways, self.ways3 = q, root, ways, ways3

    def scores(self) -> np.ndarray:
        """Traverses all texts of the block."""
        block = self.q.block
        steps = self.root[block.sequence]
        at = np.flatnonzero(self.q.starts >= 0)
        steps[at + 1] = self.ways[self.q.starts[at]]
        if self.ways3 is not None:
            at = np.flatnonzero(self.q.starts3 >= 0)
            steps[at + 2] = self.ways3[self.q.starts3[at]]
        return np.add.reduceat(steps, np.cumsum(block.lengths) - block.lengths)


def _blocks(docs: DataFrame, order: int) -> DataFrame:
    """Rows (block, ids, held, lengths, words, sequence, tops, pair_tops), in the shared folder."""
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(docs.schema["id"].dataType)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("lengths", T.ArrayType(T.LongType())), T.StructField("words", T.BinaryType()), T.StructField("sequence", T.BinaryType()), T.StructField("tops", T.ArrayType(T.LongType())), *(T.StructField(n, T.ArrayType(T.LongType())) for n in ("top_counts", "pair_tops", "pair_counts"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, number = to_arrow_schema(schema), TaskContext.get().partitionId() << 33

        def row(ids: list, held: list, hashes: list) -> pa.RecordBatch:
            words, which, counts = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            by = np.argsort(-counts, kind="stable")
            rank = np.empty(len(by), np.uint32)
            rank[by] = np.arange(len(by), dtype=np.uint32)
            often = by[: np.searchsorted(-counts[by], -HOT * counts.sum() / 10, "right")]
            lengths, sequence, pairs, times = [len(h) for h in hashes], rank[which], np.zeros(0, np.uint64), np.zeros(0, np.int64)
            if order > 2:
                # a bigram that is frequent is of frequent words
                near = sequence < len(often)
                near[np.cumsum(lengths) - 1] = False
                at = np.flatnonzero(near[:-1] & (sequence[1:] < len(often)))
                codes, times = np.unique(sequence[at].astype(np.int64) << 32 | sequence[at + 1].astype(np.int64), return_counts=True)
                codes, times = codes[times >= HOT * counts.sum() / 10], times[times >= HOT * counts.sum() / 10]
                pairs = _pair_hashes(words[by[codes >> 32]], words[by[codes & 0xFFFFFFFF]])
            values = [number, ids, held, lengths, words[by].tobytes(), _zip(sequence), words[often].astype(np.int64), counts[often], pairs.astype(np.int64), times]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, arrow)], schema=arrow)

        ids, held, hashes, size = [], [], [], 0
        for batch in batches:
            for name, out, text in rows_of(batch, "id", "held", "text"):
                ids.append(name)
                held.append(out)
                hashes.append(word_hashes(text))
                size += len(hashes[-1])
                if size >= BLOCK:
                    yield row(ids, held, hashes)
                    ids, held, hashes, size, number = [], [], [], 0, number + 1
        if ids:
            yield row(ids, held, hashes)

    return written(docs.mapInArrow(ending(cut), schema), "blocks")


def _block(words: bytes, sequence: bytes, lengths: list[int], held: list[bool]) -> Block:
    return Block(np.frombuffer(words, np.uint64), _unzip(sequence, np.uint32), np.array(lengths, np.int64), np.array(held, bool))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, alpha: float = 0.1, discount: float = 0.75, least: int = 2, order: int = 2) -> DataFrame:
    """One row per input row: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from rows whose crc32 of the id as text, modulo ``folds``, is not 0;
    all rows are scored.  A-Z are lowered, words end at ASCII white space, an
    end follows the last one.  ``base_score`` is the unigram log10 probability,
    ``score`` the automaton's; n-grams below ``least`` have no arc, their
    counts stay in the mass that failure arcs give on.  ``order`` is 2 for
    bigrams, 3 for trigrams over them.

    A null or empty text is just its end.  A row with a null id is held out.
    Repeated rows are learnt and scored each.  Without training rows all words
    are unknown.  Other columns are not read; an empty table gives an empty
    result.  A very long text is a block of its own, scored whole.  There are no
    ties to break: scores are sums over a row's own text.
    """
    spark = docs.sparkSession
    held = F.coalesce(bucket_of(id_col, folds) == 0, F.lit(True))
    blocks = _blocks(docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text")), order)
    total = blocks.select(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    ranges = int(total // RANGE + 1)

    def often(hashes: str, counts: str) -> np.ndarray:
        tops = blocks.select(F.explode(F.arrays_zip(hashes, counts)).alias("x")).groupBy(F.col(f"x.{hashes}").alias("hash")).agg(F.sum(f"x.{counts}").alias("n")).filter(F.col("n") >= 0.9 * HOT * total)
        return np.sort(np.array([r.hash for r in tops.collect()], np.int64).astype(np.uint64))

    hot, hot_pairs = often("tops", "top_counts"), often("pair_tops", "pair_counts")
    sent_hot = spark.sparkContext.broadcast((hot, hot_pairs))
    binary = lambda *names: [T.StructField(n, T.BinaryType()) for n in names]
    asked = T.StructType([T.StructField("range", T.LongType()), T.StructField("block", T.LongType()), *binary("words", "counts", "fans", "nexts", "times", "hot_first", "hot_nexts", "hot_times", "fans3", "nexts3", "times3", "hot_first3", "hot_nexts3", "hot_times3")])
    answered = T.StructType([T.StructField("block", T.LongType()), T.StructField("range", T.LongType()), *binary("counts", "left", "times", "hot_times", "kinds3", "lost3", "times3", "hot_times3"), T.StructField("tokens", T.LongType()), T.StructField("types", T.LongType()), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("hot_taken", "hot_taken3"))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, words, sequence, lengths, out in rows_of(batch, "block", "words", "sequence", "lengths", "held"):
                block = _block(words, sequence, lengths, out)
                q, counts = Question(block, *sent_hot.value, ranges, order), block.counts()
                rows = []
                for r in range(ranges):
                    mine, plain, spread = q.parts(r)
                    fans = np.bincount(_places(mine, q.first[plain]), minlength=len(mine))
                    rows.append({
                        "range": r, "block": number, "words": block.words[mine].tobytes(), "counts": _zip(counts[mine].astype(np.uint64)), "fans": _zip(fans.astype(np.uint32)),
                        "nexts": _pack(_short(block.words[q.second[plain]])), "times": _zip(q.times[plain].astype(np.uint64)),
                        "hot_first": _zip(q.hot_number[q.first[spread]].astype(np.uint16)), "hot_nexts": _pack(_short(block.words[q.second[spread]])), "hot_times": _zip(q.times[spread].astype(np.uint64)),
                    })
                    if order > 2:
                        plain3, spread3 = q.parts3(r)
                        fans3 = np.bincount(q.pair_place[q.pair[plain3]] - q.pair_bounds[r], minlength=len(plain) + len(spread))
                        rows[-1] |= {
                            "fans3": _zip(fans3.astype(np.uint32)), "nexts3": _pack(_short(block.words[q.third[plain3]])), "times3": _zip(q.times3[plain3].astype(np.uint64)),
                            "hot_first3": _zip(q.hot_pair[q.pair[spread3]].astype(np.uint16)), "hot_nexts3": _pack(_short(block.words[q.third[spread3]])), "hot_times3": _zip(q.times3[spread3].astype(np.uint64)),
                        }
                    if len(rows) == 16 or r == ranges - 1:
                        yield pa.RecordBatch.from_pylist(rows, schema=_arrow(asked))
                        rows = []

    def answer(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        words = [np.frombuffer(x["words"], np.uint64) for x in rows]
        known, which = np.unique(np.concatenate(words), return_inverse=True)
        counts = np.zeros(len(known), np.int64)
        np.add.at(counts, which, np.concatenate([_unzip(x["counts"], np.uint64) for x in rows]).astype(np.int64))
        first = np.repeat(which, np.concatenate([_unzip(x["fans"], np.uint32) for x in rows]).astype(np.int64))
        plain = _Summed(first, [_unpack(x["nexts"]) for x in rows], [_unzip(x["times"], np.uint64) for x in rows], least)
        taken = np.zeros(len(known))
        np.add.at(taken, plain.first, plain.times - discount)
        left = 1 - taken / np.maximum(counts, 1)
        spread = _Summed(np.concatenate([_unzip(x["hot_first"], np.uint16) for x in rows]).astype(np.int64), [_unpack(x["hot_nexts"]) for x in rows], [_unzip(x["hot_times"], np.uint64) for x in rows], least)
        hot_taken = np.zeros(len(sent_hot.value[0]))
        np.add.at(hot_taken, spread.first, spread.times - discount)
        if order > 2:
            # the histories of trigrams: plain bigrams, then spread ones, with the numbers of their sums
            pairs = [np.concatenate([plain.numbers(i), np.int32(len(plain.total)) + spread.numbers(i)]) for i in range(len(rows))]
            first = np.concatenate([np.repeat(p, _unzip(x["fans3"], np.uint32).astype(np.int64)) for p, x in zip(pairs, rows)])
            plain3 = _Summed(first, [_unpack(x["nexts3"]) for x in rows], [_unzip(x["times3"], np.uint64) for x in rows], least)
            both = np.concatenate([plain.total, spread.total])
            kinds3 = np.bincount(plain3.first, minlength=len(both))
            lost3 = np.maximum(both - np.bincount(plain3.first, plain3.times, len(both)).astype(np.int64), 0)
            spread3 = _Summed(np.concatenate([_unzip(x["hot_first3"], np.uint16) for x in rows]).astype(np.int64), [_unpack(x["hot_nexts3"]) for x in rows], [_unzip(x["hot_times3"], np.uint64) for x in rows], least)
            hot_taken3 = np.bincount(spread3.first, spread3.times - discount, len(sent_hot.value[1]))
        out, at = [], 0
        for i, x in enumerate(rows):
            own = which[at : at + len(words[i])]
            at += len(words[i])
            once = i == 0
            out.append({"block": x["block"], "range": x["range"], "counts": _zip(counts[own].astype(np.uint64)), "left": _zip(left[own]), "times": _zip(plain.of(i)), "hot_times": _zip(spread.of(i)), "tokens": int(counts.sum()) if once else 0, "types": int((counts > 0).sum()) if once else 0, "hot_taken": hot_taken.tolist() if once else None})
            if order > 2:
                out[-1] |= {"kinds3": _zip(kinds3[pairs[i]].astype(np.uint32)), "lost3": _zip(lost3[pairs[i]].astype(np.uint64)), "times3": _zip(plain3.of(i)), "hot_times3": _zip(spread3.of(i)), "hot_taken3": hot_taken3.tolist() if once else None}
        found = pa.Table.from_pylist(out, schema=_arrow(answered))
        rows.clear()
        out.clear()
        del words, plain, spread, which, first
        released()  # a worker that waits for its next group would keep what this one took
        return found

    answers = written(blocks.select("block", "words", "sequence", "lengths", "held").mapInArrow(ending(ask), asked).repartition(ranges, "range").groupBy("range").applyInArrow(answer, answered), "answers")
    sums = answers.agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = sums.tokens or 0, sums.types or 0

    def summed(name: str, n: int) -> np.ndarray:
        out = np.zeros(n)
        for r in answers.select(F.posexplode(name)).groupBy("pos").agg(F.sum("col").alias("taken")).collect():
            out[r.pos] = r.taken
        return out

    sent_taken = spark.sparkContext.broadcast((summed("hot_taken", len(hot)), summed("hot_taken3", len(hot_pairs))))
    result = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("held_out", T.BooleanType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    floor = tokens + alpha * (types + 1)

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        arrow, out = _arrow(result), []
        replies = {r["range"]: r for batch in right.to_batches() for r in batch.to_pylist()}
        for x in left.to_pylist():
            block = _block(x["words"], x["sequence"], x["lengths"], x["held"])
            q = Question(block, *sent_hot.value, ranges, order)
            counts, mass, times = np.zeros(len(block.words), np.int64), np.ones(len(block.words)), np.zeros(len(q.first), np.int64)
            for r in range(ranges):
                mine, plain, spread = q.parts(r)
                reply = replies[r]
                counts[mine] = _unzip(reply["counts"], np.uint64)
                mass[mine] = _unzip(reply["left"], np.float64)
                times[plain], times[spread] = _unzip(reply["times"], np.uint64), _unzip(reply["hot_times"], np.uint64)
            is_hot = q.hot_number >= 0
            mass[is_hot] = 1 - sent_taken.value[0][q.hot_number[is_hot]] / np.maximum(counts[is_hot], 1)
            p = (counts + alpha) / floor
            kept = _at(times >= max(least, 1))
            ways = mass[q.first] * p[q.second]
            ways[kept] += (times[kept] - discount) / counts[q.first[kept]]
            del kept
            ways3 = _trigram_ways(q, replies, ways, times, sent_taken.value[1], discount, least) if order > 2 else None
            scores = Automaton(q, np.log10(p), np.log10(ways), ways3).scores()
            firsts = np.cumsum(block.lengths) - block.lengths
            base = np.add.reduceat(np.log10(p)[block.sequence], firsts)
            n_known = np.add.reduceat((counts > 0).astype(np.int64)[block.sequence], firsts)
            columns = [x["ids"], x["held"], block.lengths, n_known, np.full(len(firsts), tokens), base, scores]
            out.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow))
            del q, counts, mass, times, ways, ways3, scores, base
        replies.clear()
        released()
        return pa.Table.from_batches(out, schema=arrow)

    asking = blocks.select("block", "ids", "held", "lengths", "words", "sequence").groupBy("block")
    return asking.cogroup(answers.select("block", "range", "counts", "left", "times", "hot_times", "kinds3", "lost3", "times3", "hot_times3").groupBy("block")).applyInArrow(score, result)


def _trigram_ways(q: Question, replies: dict, ways: np.ndarray, times: np.ndarray, hot_taken: np.ndarray, discount: float, least: int) -> np.ndarray:
    """Weights of the ways from the block's bigrams over third words."""
    taken, times3 = np.zeros(len(times)), np.zeros(len(q.pair), np.int64)
    for r, reply in replies.items():
        _, plain, spread = q.parts(r)
        plain3, spread3 = q.parts3(r)
        mine = np.concatenate([plain, spread])
        taken[mine] = times[mine].astype(np.int64) - _unzip(reply["lost3"], np.uint64).astype(np.int64) - discount * _unzip(reply["kinds3"], np.uint32)
        times3[plain3], times3[spread3] = _unzip(reply["times3"], np.uint64), _unzip(reply["hot_times3"], np.uint64)
    is_hot = q.hot_pair >= 0
    taken[is_hot] = hot_taken[q.hot_pair[is_hot]]
    left = 1 - taken / np.maximum(times, 1)
    lower = np.empty(len(q.pair), np.int32)
    at = np.flatnonzero(q.starts3 >= 0)
    lower[q.starts3[at]] = q.starts[at + 1]
    ways3 = left[q.pair] * ways[lower]
    kept = times3 >= max(least, 1)
    ways3[kept] += (times3[kept] - discount) / times[q.pair[kept]]
    return np.log10(ways3)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _places(values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands among the values."""
    if not len(wanted):
        return np.zeros(0, np.int64)
    order = np.argsort(values)
    return order[np.searchsorted(values[order], wanted)]


class _Summed:
    """N-grams of several questions with their counts added up, and those kept."""

    def __init__(self, first: np.ndarray, nexts: list[np.ndarray], times: list[np.ndarray], least: int) -> None:
        pairs = first.astype(np.uint64)
        pairs <<= np.uint64(8 * NEXT_BYTES)
        pairs |= np.concatenate(nexts)
        self.bounds = np.cumsum([0, *map(len, nexts)])
        pairs, self.which = _numbered(pairs)
        total = np.zeros(len(pairs), np.int64)
        np.add.at(total, self.which, np.concatenate(times).astype(np.int64))
        self.total = total
        kept = np.flatnonzero(total >= max(least, 1))
        self.first, self.times = (pairs[kept] >> np.uint64(8 * NEXT_BYTES)).astype(np.int64), total[kept]

    def numbers(self, i: int) -> np.ndarray:
        """The numbers of question i's n-grams among the sums, in its order."""
        return self.which[self.bounds[i] : self.bounds[i + 1]]

    def of(self, i: int) -> np.ndarray:
        """The totals for question i, in its order."""
        return self.total[self.numbers(i)].astype(np.uint64)
