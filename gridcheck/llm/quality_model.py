"""Quality scores by regularised quadratic discriminant analysis.

Each text becomes a row of transformed statistics, computed once and written.
The classes' moments (sums and products of features) add up over all labelled
training rows; each class covariance is shrunk towards the pooled one and
towards its own mean variance.  Cholesky factors are computed once and sent to
the tasks.  The score is the difference of Mahalanobis log-densities, put on a
probability scale by a logistic fit to a histogram of the training scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, rows_of, written

FEATURES = (
    "log_words", "word_length", "word_spread", "symbols", "upper", "digits", "bangs", "stops", "commas", "distinct", "top_word",
    "repeated", "same_next", "line_words", "dup_lines", "bare_signs", "short_words", "beyond_ascii", "long_words",
)
SYMBOLS = re.compile(r"[#*$%&|<>]")
CLIP = 40.0
BINS = 1024


def statistics(text: str | None) -> list[float]:
    """Transformed statistics of a text, all about 0 to 5; zeros for a text without words."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), max(1, len(text))
    lengths = np.fromiter(map(len, words), float, n)
    counts = Counter(words)
    share = lambda k, of=n: math.sqrt(k / max(1, of))
    threes = Counter(zip(words, words[1:], words[2:]))
    lines = [x for x in text.split("\n") if x.strip()]
    raw = text.encode()
    upper, digits = sum(map(str.isupper, words)), sum(1 for w in words if any(map(str.isdigit, w)))
    return [
        math.log1p(n) / 2, math.log1p(lengths.mean()), math.log1p(lengths.std()), share(len(SYMBOLS.findall(text)), chars) * 3, share(upper), share(digits), share(text.count("!"), n), share(text.count("."), n), share(text.count(","), n),
        len(counts) / n, share(counts.most_common(1)[0][1]), share(sum(v for v in threes.values() if v > 1)), share(sum(map(str.__eq__, words, words[1:]))),
        math.log1p(n / max(1, len(lines))), share(len(lines) - len(set(lines)), len(lines)), share(sum(1 for w in words if not any(map(str.isalnum, w)))), share(int((lengths <= 3).sum())), share(len(raw) - len(text), chars), share(int((lengths > 15).sum())),
    ]


class Discriminant:
    """Two Gaussian classes with shrunk covariances; keeps the inverse Cholesky factors."""

    def __init__(self, n: np.ndarray, sums: np.ndarray, products: np.ndarray, to_pooled: float = 0.1, to_mean: float = 0.02) -> None:
        means = sums / n[:, None]
        scatter = [products[c] - n[c] * np.outer(means[c], means[c]) for c in (0, 1)]
        pooled = (scatter[0] + scatter[1]) / n.sum()
        self.means, self.factors, self.constants = means, [], []
        for c in (0, 1):
            cov = (1 - to_pooled) * scatter[c] / n[c] + to_pooled * pooled
            cov = (1 - to_mean) * cov + (to_mean * np.trace(cov) / len(cov) + 1e-6) * np.eye(len(cov))
            lower = np.linalg.cholesky(cov)
            self.factors.append(np.linalg.inv(lower))
            self.constants.append(float(math.log(n[c] / n.sum()) - np.log(np.diag(lower)).sum()))

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log-density and prior of class 1 minus those of class 0, bounded."""
        side = [self.constants[c] - 0.5 * (((x - self.means[c]) @ self.factors[c].T) ** 2).sum(1) for c in (0, 1)]
        return np.clip(side[1] - side[0], -CLIP, CLIP)


def logistic_fit(x: np.ndarray, up: np.ndarray, down: np.ndarray) -> tuple[float, float]:
    """Slope (never negative) and offset of a weighted logistic regression, by Newton steps."""
    a, b = 0.3, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(a * x + b)))
        w = (up + down) * p * (1 - p)
        g = np.array([((up - (up + down) * p) * x).sum() - 1e-3 * a, (up - (up + down) * p).sum()])
        h = np.array([[(w * x * x).sum() + 1e-3, (w * x).sum()], [(w * x).sum(), w.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = max(0.0, a + float(np.clip(step[0], -0.5, 0.5))), b + float(np.clip(step[1], -2, 2))
    return a, b


def labelled(labels: DataFrame, label_col: str, id_col: str) -> DataFrame:
    """One label (0 or 1) per id; ids with a null id, without a label or with both are left out."""
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    return known.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"), F.max(label_col).alias("__high")).filter("label = __high").drop("__high")


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", folds: int = 5, threshold: float = 0.3) -> DataFrame:
    """One row per input row: id, held_out, score, predicted, log_ratio.

    Learns from all labelled rows whose crc32 of the id as text, modulo
    ``folds``, is not 0; only the text is an input of the score.

    Null and empty texts get the score of their (all zero) statistics.  Rows
    with a null id are held out.  Repeated rows are scored, and learnt, each.
    Without labels of both classes every score is the share of class 1 (0.5
    without any).  Other columns are not read; an empty table gives an empty
    result.  A very long text is read whole, in one row; equal texts get
    equal scores, so ties need no order.
    """
    id_type, d = docs.schema[id_col].dataType.simpleString(), len(FEATURES)
    held = F.coalesce(bucket_of(id_col, folds) == 0, F.lit(True))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for (t,) in rows_of(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held"), pa.array(x, pa.list_(pa.float64()))], names=["id", "held", "x"])

    rows = written(docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text")).mapInArrow(measure, f"id {id_type}, held boolean, x array<double>"), "features")
    training = written(rows.filter(~F.col("held")).join(labelled(labels, label_col, id_col), "id").select("x", F.col("label").cast("int").alias("label")), "training")

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, d + 1, d + 1))
        for batch in batches:
            x = np.c_[np.ones(batch.num_rows), np.array(batch.column("x").to_pylist()).reshape(-1, d)]
            y = np.array(batch.column("label").to_pylist(), int)
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        at = np.indices(total.shape).reshape(3, -1)
        yield pa.RecordBatch.from_pydict({"c": at[0], "i": at[1], "j": at[2], "v": total.ravel()})

    total = np.zeros((2, d + 1, d + 1))
    for r in training.mapInArrow(moments, "c long, i long, j long, v double").groupBy("c", "i", "j").agg(F.sum("v").alias("v")).collect():
        total[r.c, r.i, r.j] = r.v
    n = total[:, 0, 0]
    model, scale = None, (0.0, float(math.log(n[1] / n[0])) if n.min() > 0 else 0.0 if n.sum() == 0 else math.copysign(CLIP, n[1] - n[0]))
    if n.min() > 1:
        model = Discriminant(n, total[:, 0, 1:], total[:, 1:, 1:])
        sent = docs.sparkSession.sparkContext.broadcast(model)

        def differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = sent.value.difference(np.array(batch.column("x").to_pylist()).reshape(-1, d))
                yield pa.RecordBatch.from_arrays([pa.array(((s + CLIP) * (BINS / (2 * CLIP))).astype(np.int64)), batch.column("label")], names=["bin", "label"])

        found = training.mapInArrow(differences, "bin long, label int").groupBy("bin").agg(F.count_if(F.col("label") == 1).alias("up"), F.count_if(F.col("label") == 0).alias("down")).orderBy("bin").collect()
        centre = (np.array([r.bin for r in found]) + 0.5) * (2 * CLIP / BINS) - CLIP
        scale = logistic_fit(centre, np.array([r.up for r in found], float), np.array([r.down for r in found], float))
    known = docs.sparkSession.sparkContext.broadcast((model, scale))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, (a, b) = known.value
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, d)
            s = model.difference(x) if model else np.zeros(len(x))
            p = 1 / (1 + np.exp(-(a * s + b)))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held"), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(s)], names=[id_col, "held_out", "score", "predicted", "log_ratio"])

    return rows.mapInArrow(score, f"{id_col} {id_type}, held_out boolean, score double, predicted int, log_ratio double")
