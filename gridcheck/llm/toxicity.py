"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. A lexicon of words and word beginnings is mined from a bounded, balanced
   sample of labelled training rows.
2. Every document gets the votes of all voters (fixed lexicons, mined lexicons
   of several strengths, patterns) and the mined entries it has.  With
   ``VOTERS`` voters there are at most 2 ** VOTERS patterns of votes, so the
   counts of patterns, over all documents, fit the driver.
3. The label model is one exponential family per class over vote patterns: a
   weight for each voter (its accuracy) and for each pair that stays correlated
   within a class.  It is fitted to the pattern counts by EM; a known label
   enters as a vote with an error rate of its own.
4. A logistic regression on the mined entries and the votes is trained on the
   posterior labels of a bounded sample of rows with and without labels that are
   not held out, and scores all.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, rows_of, written
from .quality_model import labelled

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that may be lexicon entries.
BEGINNINGS = (3, 4, 5, 6)
#: An entry that occurs this often is an entry of its own.
TIMES = (2, 3, 5)

#: Common English words of abuse, by what they say.
LEXICONS = {
    "mind": "idiot moron stupid dumb imbecile fool dimwit brainless ignorant",
    "worth": "worthless pathetic loser useless failure nobody pitiful",
    "disgust": "disgusting trash garbage scum filth vermin vile rotten",
    "scorn": "clown joke freak creep coward liar hypocrite",
    "threat": "kill die hang hurt destroy burn",
    "hate": "hate despise loathe",
}
LEXICON_SETS = [frozenset(v.split()) for v in LEXICONS.values()]
#: Mined lexicons: entries whose share of toxic documents is at least this.
STRENGTHS = (0.95, 0.85, 0.65)
VOTER_NAMES = (*LEXICONS, "two_listed", *(f"mined_{s}" for s in STRENGTHS), "two_mined", "four_mined", "shouting", "insisting")
VOTERS = len(VOTER_NAMES)


def _times(name: str, n: int) -> list[str]:
    """An entry, and the same marked where it occurs at least so many times."""
    return [name, *(f"{name}#{t}" for t in TIMES if n >= t)]


def entries(text: str | None) -> set[str]:
    """Lower-case words, beginnings of words marked with a hyphen, and how often both occur."""
    words = Counter(WORD.findall(text.lower())) if text else Counter()
    starts: Counter = Counter()
    for w, n in words.items():
        for k in BEGINNINGS:
            if len(w) >= k:
                starts[w[:k] + "-"] += n
    return {e for counts in (words, starts) for name, n in counts.items() for e in _times(name, n)}


@dataclass(frozen=True)
class Lexicon:
    """Mined entries with their numbers, the names without counts, the share of toxic documents."""

    number: dict[str, int]
    names: frozenset[str]
    share: list[float]

    def found(self, words: Counter) -> list[int]:
        """The numbers of the entries that a text's words have."""
        number, names = self.number, self.names
        counts = Counter({w: n for w, n in words.items() if w in names})
        for w, n in words.items():
            for k in BEGINNINGS:
                if len(w) >= k and (start := w[:k] + "-") in names:
                    counts[start] += n
        return sorted(number[e] for name, n in counts.items() for e in _times(name, n) if e in number)


def votes(text: str, words: Counter, found: list[int], lexicon: Lexicon) -> int:
    """The voters that say toxic, as bits."""
    listed = [len(words.keys() & s) for s in LEXICON_SETS]
    strong = [sum(lexicon.share[i] >= s for i in found) for s in STRENGTHS]
    says = [*(n > 0 for n in listed), sum(listed) >= 2, *(n > 0 for n in strong), strong[1] >= 2, strong[2] >= 4]
    capitals = sum(map(str.isupper, text.split())) if text else 0
    says += [capitals >= 10, text.count("!") >= 5]
    return sum(1 << i for i, s in enumerate(says) if s)


def pattern_bits() -> np.ndarray:
    return (np.arange(1 << VOTERS)[:, None] >> np.arange(VOTERS)) & 1


class LabelModel:
    """P(votes | class) proportional to exp(weights . votes + pair weights . pairs), for both classes.

    ``posterior[g][p]``: probability of toxic given pattern p and the label
    (g = 0: none, 1: label 0, 2: label 1).  A label is one more vote, which is
    wrong at a rate that EM estimates between 0.5 and 3 percent: labels that are
    worse are still believed as if they were wrong at 3; strong votes can overrule one.
    """

    def __init__(self, counts: np.ndarray, turns: int = 25, most_pairs: int = 8, prior: float = 0.1) -> None:
        bits = pattern_bits().astype(np.float32)
        self.pairs: list[tuple[int, int]] = []
        self.error = 0.02
        total = counts.sum(0)
        lexical = bits[:, : VOTERS - 2]
        # start: two or more lexical voters, or the label
        q = np.stack([np.clip((lexical.sum(1) >= 2).astype(float), 0.02, 0.9), np.full(len(bits), 0.05), np.full(len(bits), 0.9)])
        self.prior = prior
        self.weights = [np.zeros(VOTERS), np.zeros(VOTERS)]
        for turn in range(turns):
            if turn == turns // 3 and total.sum() > 0:
                self.pairs = self._correlated(counts, q, bits, most_pairs)
                self.weights = [np.append(w[:VOTERS], np.zeros(len(self.pairs))) for w in self.weights]
            x = np.concatenate([bits, *(bits[:, i : i + 1] * bits[:, j : j + 1] for i, j in self.pairs)], 1)
            logs = []
            for c in (0, 1):
                mass = (counts * (q if c else 1 - q)).sum(0)
                self.weights[c] = self._fit(x, mass, self.weights[c])
                e = x @ self.weights[c]
                logs.append(e - (e.max() + np.log(np.exp(e - e.max()).sum())))
            toxic = (counts * q).sum()
            self.prior = float((toxic + 1) / (counts.sum() + 2 / prior * 0.5))
            with_label = counts[1:]
            wrong = (with_label[0] * q[1]).sum() + (with_label[1] * (1 - q[2])).sum()
            self.error = float(np.clip((wrong + 1) / (with_label.sum() + 20), 0.005, 0.03))
            odds = logs[1] - logs[0] + np.log(self.prior / (1 - self.prior))
            seen = np.log((1 - self.error) / self.error)
            q = 1 / (1 + np.exp(-np.clip(np.stack([odds, odds - seen, odds + seen]), -30, 30)))
        self.posterior = q
        self.accuracies = {n: tuple(float(((counts * p).sum(0) * bits[:, i]).sum() / max(1e-9, (counts * p).sum())) for p in (1 - q, q)) for i, n in enumerate(VOTER_NAMES)}

    @staticmethod
    def _fit(x: np.ndarray, mass: np.ndarray, w: np.ndarray, ridge: float = 1.0) -> np.ndarray:
        """Newton steps to the weights whose expected votes are those observed."""
        n = mass.sum() + 1e-9
        target = mass @ x
        for _ in range(6):
            e = x @ w
            p = np.exp(e - e.max())
            p /= p.sum()
            mean = p @ x
            cov = (x * p[:, None]).T @ x - np.outer(mean, mean)
            step = np.linalg.solve(n * cov + ridge * np.eye(len(w)), target - n * mean - ridge * w)
            w = w + np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-4:
                break
        return w

    @staticmethod
    def _correlated(counts: np.ndarray, q: np.ndarray, bits: np.ndarray, most: int) -> list[tuple[int, int]]:
        """Pairs whose votes are the most correlated within the classes."""
        found: dict[tuple[int, int], float] = {}
        for part in (1 - q, q):
            mass = (counts * part).sum(0)
            n = mass.sum() + 1e-9
            mean = mass @ bits / n
            cov = (bits * mass[:, None]).T @ bits / n - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-6))
            corr = np.abs(cov / np.outer(sd, sd)) * np.sqrt(n / counts.sum())
            for i in range(VOTERS):
                for j in range(i + 1, VOTERS):
                    found[i, j] = max(found.get((i, j), 0.0), float(corr[i, j]))
        return [p for p, c in sorted(found.items(), key=lambda x: -x[1])[:most] if c > 0.1]


def train_linear(rows: list[list[int]], y: np.ndarray, size: int, epochs: int = 200, ridge: float = 1e-4) -> np.ndarray:
    """Logistic regression on 0/1 features (the last weight is the offset), by adaptive gradient steps.

    Toxic rows weigh as the fourth root of how rare they are: nearer to as found than to even.
    """
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    columns = np.array([c for r in rows for c in r], np.int64)
    rare = max(1.0, (len(y) - y.sum()) / max(1.0, y.sum())) ** 0.25
    weight = 1 + (rare - 1) * y
    w, speed = np.zeros(size + 1), np.full(size + 1, 1e-8)
    for _ in range(epochs):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(at, w[columns], len(rows)) + w[-1], -30, 30)))
        off = weight * (p - y)
        g = np.append(np.bincount(columns, off[at], size), off.sum()) / max(1, len(rows)) + ridge * np.append(w[:-1], 0)
        speed += g * g
        w -= 0.5 * g / np.sqrt(speed)
    return w


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 5,
    threshold: float = 0.5,
    mining_rows: int = 8_000,
    training_rows: int = 40_000,
) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, votes.

    Learns labels only from rows whose crc32 of the id as text, modulo
    ``folds``, is not 0.  Bounds: the lexicon is mined from about
    ``mining_rows`` rows of each label, which bounds its entries too (each is in
    five toxic rows of these or more), and the linear model is trained on about
    ``training_rows`` labelled rows and as many without a label (chosen by a hash
    of the id); votes are counted over all documents.

    Null and empty texts get no votes and the score of the offset alone.  A very
    long text is read whole, by one task.  Ties of a score with the threshold
    count as toxic.  Rows
    with a null id are held out.  Repeated rows are scored, and counted, each.
    Without labels only the fixed lexicons and patterns vote, and the label
    model alone scores.  Other columns are not read; an empty table gives an
    empty result.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    held = F.coalesce(bucket_of(id_col, folds) == 0, F.lit(True))
    texts = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    known = written(labelled(labels.filter(F.coalesce(bucket_of(id_col, folds) != 0, F.lit(False))), label_col, id_col).withColumn("label", F.col("label").cast("int")), "labels")
    sizes = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1_000_000))
    share = lambda label: min(1.0, mining_rows / max(1, sizes.get(label, 0)))
    chosen = known.filter(draw < F.when(F.col("label") == 1, int(share(1) * 1e6)).otherwise(int(share(0) * 1e6)))

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            out = pa.RecordBatch.from_pydict({"entry": pa.array(names, pa.string()), "clean": pa.array([seen[0][k] for k in names], pa.int64()), "toxic": pa.array([seen[1][k] for k in names], pa.int64())})
            seen[0].clear(), seen[1].clear()
            return out

        for batch in batches:
            for text, label in rows_of(batch, "text", "label"):
                seen[label].update(entries(text))
                if len(seen[0]) + len(seen[1]) > 400_000:
                    yield flush()
        yield flush()

    # at most mining_rows ids of each label
    sample = texts.select("id", "text").join(F.broadcast(chosen), "id").select("text", "label")
    mined = sample.mapInArrow(mine, "entry string, clean long, toxic long").groupBy("entry").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # counts in the sample stand for counts among all labelled rows
    rate = lambda c, label: F.col(c) / max(share(label), 1e-9)
    # two documents more on the clean side keep chance finds low
    precision = F.col("toxic") / (F.col("toxic") + rate("clean", 0) * share(1) + 2)
    least = 5
    best = mined.filter(F.col("toxic") >= least).select("entry", precision.alias("share"), (precision * F.log1p("toxic")).alias("worth")).filter(F.col("share") >= min(STRENGTHS) - 0.2).orderBy(F.desc("worth"), "entry").collect()
    lexicon = Lexicon({r.entry: i for i, r in enumerate(best)}, frozenset(r.entry.split("#")[0] for r in best), [r.share for r in best])
    sent = spark.sparkContext.broadcast(lexicon)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = sent.value
        for batch in batches:
            patterns, lists = [], []
            for (text,) in rows_of(batch, "text"):
                words = Counter(WORD.findall(text.lower())) if text else Counter()
                found = lexicon.found(words)
                patterns.append(votes(text or "", words, found, lexicon))
                lists.append(found)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held"), pa.array(patterns, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], names=["id", "held", "pattern", "found"])

    voted = written(texts.mapInArrow(vote, f"id {id_type}, held boolean, pattern long, found array<int>"), "votes")
    training = written(voted.filter(~F.col("held")).join(known, "id").select("id", "pattern", "found", "label"), "training")
    counts = np.zeros((3, 1 << VOTERS))
    for r in voted.groupBy("pattern").agg(F.count("*").alias("n")).collect():
        counts[0, r.pattern] = r.n
    for r in training.groupBy("pattern", "label").agg(F.count("*").alias("n")).collect():
        counts[0, r.pattern] -= r.n
        counts[1 + r.label, r.pattern] = r.n
    counts = np.maximum(counts, 0)
    base = sizes.get(1, 0) / max(1, sum(sizes.values())) if sizes else 0.05
    model = LabelModel(counts, prior=min(0.5, max(0.01, base)))
    free = max(1, int(counts[0].sum()))
    some = voted.filter(~F.col("held") & (draw < int(1e6 * min(1.0, training_rows / free)))).join(known.select("id"), "id", "left_anti")
    part = training.filter(draw < int(1e6 * min(1.0, training_rows / max(1, sum(sizes.values()))))).select("pattern", "found", (F.col("label") + 1).alias("known"))
    part = part.unionByName(some.select("pattern", "found", F.lit(0).alias("known"))).toArrow().to_pydict()
    features = len(best) + VOTERS
    as_row = lambda pattern, found: [*found, *(len(best) + i for i in range(VOTERS) if pattern >> i & 1)]
    weights = None
    if training.limit(1).count():
        y = np.array([model.posterior[k][p] for p, k in zip(part["pattern"], part["known"])])
        weights = train_linear([as_row(p, f) for p, f in zip(part["pattern"], part["found"])], y, features)
    learnt = spark.sparkContext.broadcast((weights, model.posterior[0]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, posterior = learnt.value
        for batch in batches:
            out = []
            for pattern, found in rows_of(batch, "pattern", "found"):
                out.append(float(posterior[pattern]) if weights is None else 1 / (1 + np.exp(-np.clip(weights[-1] + weights[as_row(pattern, found)].sum(), -30, 30))))
            p = np.array(out, float)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), batch.column("pattern")], names=[id_col, "held_out", "score", "predicted", "votes"])

    return voted.mapInArrow(score, f"{id_col} {id_type}, held_out boolean, score double, predicted int, votes long")
