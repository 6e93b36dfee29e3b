import math
import random
import re
import zlib

import numpy as np
from helpers import ODD, frame

from gridcheck.llm.quality_model import FEATURES, quality_scores


def stated(text):
    """The statistics, each from its words."""
    words = (text or "").split()
    if not words:
        return [0.0] * len(FEATURES)
    n, chars = len(words), len(text)
    size = [len(w) for w in words]
    mean = sum(size) / n
    root = lambda k, of: math.sqrt(k / max(of, 1))
    having = lambda test: sum(1 for w in words if test(w))
    threes = [tuple(words[k : k + 3]) for k in range(n - 2)]
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        math.log1p(n) / 2, math.log1p(mean), math.log1p(math.sqrt(sum((s - mean) ** 2 for s in size) / n)), 3 * root(len(re.findall(r"[#*$%&|<>]", text)), chars),
        root(having(str.isupper), n), root(having(lambda w: re.search(r"\d", w)), n), root(text.count("!"), n), root(text.count("."), n), root(text.count(","), n),
        len(set(words)) / n, root(max(words.count(w) for w in set(words)), n), root(sum(1 for t in threes if threes.count(t) > 1), n), root(sum(1 for a, b in zip(words, words[1:]) if a == b), n),
        math.log1p(n / max(1, len(lines))), root(len(lines) - len(set(lines)), len(lines)), root(having(lambda w: not re.search(r"[^\W_]", w)), n),
        root(sum(1 for s in size if s <= 3), n), root(len(text.encode()) - chars, chars), root(sum(1 for s in size if s > 15), n),
    ]


def density(x, rows, pooled):
    """Log-density of a Gaussian with the shrunk covariance of the rows, by determinant and solving."""
    d = rows.shape[1]
    cov = 0.9 * np.cov(rows.T, bias=True) + 0.1 * pooled
    cov = 0.98 * cov + (0.02 * np.trace(cov) / d + 1e-6) * np.eye(d)
    gap = x - rows.mean(0)
    return -0.5 * np.einsum("ij,ij->i", gap, np.linalg.solve(cov, gap.T).T) - 0.5 * np.linalg.slogdet(cov)[1]


def test_moments_shrinkage_and_scores_match_brute_force(spark):
    rng = random.Random(9)
    vocabulary = "the of a to and data model Text WORLD 42 x1 été, end. well! #tag *** incomprehensibilities".split()
    rows = [r for r in ODD if r[0] != 5]
    for i in range(100, 400):
        words = [rng.choice(vocabulary[: rng.randint(2, len(vocabulary))]) for _ in range(rng.randint(1, 50))]
        rows.append((i, "".join(w + rng.choice([" ", " ", " ", "\n"]) for w in words)))
    label = {i: int(rng.random() < (0.75 if t.count(" ") > 15 else 0.3)) for i, t in rows if i is not None and i >= 100}
    table = spark.createDataFrame([(i, y) for i, y in label.items()], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_scores(frame(spark, rows), table).collect()}

    x = np.array([stated(t) for _, t in rows])
    y = np.array([label.get(i, -1) if i is not None and zlib.crc32(str(i).encode()) % 5 else -1 for i, _ in rows])
    up, down = x[y == 1], x[y == 0]
    gaps = np.concatenate([up - up.mean(0), down - down.mean(0)])
    pooled = gaps.T @ gaps / len(gaps)
    ratio = density(x, up, pooled) - density(x, down, pooled) + math.log(len(up) / len(down))
    ratio = np.clip(ratio, -40, 40)
    assert len(up) > 50 and len(down) > 50 and np.abs(ratio).max() > 1
    assert np.allclose([got[i].log_ratio for i, _ in rows], ratio, atol=1e-6)

    # scores are one logistic function of the ratios, at the best fit to the training rows' bins
    logit = np.array([math.log(got[i].score / (1 - got[i].score)) for i, _ in rows])
    a, b = np.polyfit(ratio, logit, 1)
    assert a > 0 and np.allclose(a * ratio + b, logit, atol=1e-6)
    centre = (np.floor((ratio[y >= 0] + 40) * 12.8) + 0.5) / 12.8 - 40
    miss = y[y >= 0] - 1 / (1 + np.exp(-(a * centre + b)))
    assert abs((miss * centre).sum() - 1e-3 * a) < 1e-3 and abs(miss.sum()) < 1e-3
    assert all(r.predicted == int(r.score >= 0.3) for r in got.values())
