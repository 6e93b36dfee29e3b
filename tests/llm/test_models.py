import math
import random
import zlib
from collections import Counter

import numpy as np
from helpers import ODD, empty, frame

from gridcheck.llm.lm_score import score_texts
from gridcheck.llm.quality_model import quality_scores
from gridcheck.llm.toxicity import LabelModel, VOTERS, pattern_bits, toxicity_scores


def test_language_model_matches_brute_force(spark):
    rng = random.Random(2)
    rows = ODD + [(i, " ".join(rng.choice("the of a to in is on it at by".split()) if rng.random() < 0.7 else rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(0, 60)))) for i in range(100, 400)]
    unigrams, bigrams, total, words = Counter(), Counter(), 0, []
    for i, t in rows:
        w = (t or "").encode().lower().split() + [b"\0end"]
        words.append(w)
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            unigrams.update(w)
            bigrams.update(zip(w, w[1:]))
            total += len(w)
    kept = {k: v for k, v in bigrams.items() if v > 1}
    taken = Counter()
    for (h, _), c in kept.items():
        taken[h] += c - 0.75
    p = lambda w: (unigrams[w] + 0.1) / (total + 0.1 * (len(unigrams) + 1))
    assert abs(sum(p(w) for w in unigrams) + 0.1 / (total + 0.1 * (len(unigrams) + 1)) - 1) < 1e-9
    want = []
    for (i, _), w in zip(rows, words):
        score = math.log10(p(w[0]))
        for h, x in zip(w, w[1:]):
            left = 1 - taken[h] / max(1, unigrams[h])
            score += math.log10((kept[h, x] - 0.75) / unigrams[h] + left * p(x)) if (h, x) in kept else math.log10(left) + math.log10(p(x))
        want.append((str(i), len(w), sum(unigrams[x] > 0 for x in w), total, round(sum(math.log10(p(x)) for x in w), 6), round(score, 6)))
    got = [(str(r.doc_id), r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in score_texts(frame(spark, rows)).collect()]
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:4] == b[:4] and np.allclose(a[4:], b[4:], atol=1e-5)
    assert len(got) == len(want) and score_texts(empty(spark)).count() == 0


def labelled_texts(n=600):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8)))
    rows, labels = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(30, 120))]
        bad, rude = rng.random() < 0.2, rng.random() < 0.2
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 2 else [w + " |" for w in words]
        if rude:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scum", "zorgling", "zorgoth", "loser"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(not bad), int(rude)))
    return rows, labels


def accuracy(got, labels, at):
    truth = {i: x[at] for i, *x in labels}
    held = [(r.predicted, truth[r.doc_id]) for r in got if r.held_out and r.doc_id in truth]
    return sum(a == b for a, b in held) / len(held)


def test_classifiers(spark):
    rows, labels = labelled_texts()
    docs = frame(spark, rows + [(10_000 + i if i is not None else None, t) for i, t in ODD])
    table = spark.createDataFrame(labels + [(0, None, None), (None, 1, 1), (7, 1 - labels[7][1], 1 - labels[7][2])], "doc_id long, quality int, toxic int")
    for fn, at, col in ((quality_scores, 0, "quality"), (toxicity_scores, 1, "toxic")):
        got = fn(docs, table, col).collect()
        assert len(got) == len(rows) + len(ODD)
        assert all(0 <= r.score <= 1 and r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
        assert accuracy(got, labels, at) > 0.93
        assert fn(empty(spark), table, col).count() == 0
        none = fn(docs, table.limit(0), col).collect()
        assert len(none) == len(got) and all(0 <= r.score <= 1 for r in none)


def test_label_model_finds_the_good_voters():
    rng = np.random.default_rng(0)
    truth = rng.random(20000) < 0.1
    votes = rng.random((20000, VOTERS)) < np.where(truth[:, None], 0.6, 0.02)
    votes[:, -1] = rng.random(20000) < 0.1  # says nothing
    patterns = votes @ (1 << np.arange(VOTERS))
    counts = np.zeros((3, 1 << VOTERS))
    counts[0] = np.bincount(patterns, minlength=1 << VOTERS)
    model = LabelModel(counts)
    assert 0.05 < model.prior < 0.2
    assert ((model.posterior[0][patterns] > 0.5) == truth).mean() > 0.98
    assert pattern_bits().shape == (1 << VOTERS, VOTERS)


def test_label_model_finds_accuracies_and_overrules_a_label():
    """Votes of known rates for each class, hardly any labels: EM finds the rates; strong votes beat a wrong label."""
    from gridcheck.llm.toxicity import VOTERS, LabelModel

    rng = np.random.default_rng(2)
    toxic = rng.random(20_000) < 0.2
    rate = np.where(toxic[:, None], np.linspace(0.5, 0.8, VOTERS), np.linspace(0.02, 0.1, VOTERS))
    bits = rng.random(rate.shape) < rate
    pattern = bits @ (1 << np.arange(VOTERS))
    group = np.where(rng.random(len(toxic)) < 0.05, 1 + toxic, 0)
    counts = np.stack([np.bincount(pattern[group == g], minlength=1 << VOTERS) for g in range(3)]).astype(float)
    model = LabelModel(counts)
    found = np.array(list(model.accuracies.values()))
    assert np.abs(found[:, 1] - np.linspace(0.5, 0.8, VOTERS)).max() < 0.05 and np.abs(found[:, 0] - np.linspace(0.02, 0.1, VOTERS)).max() < 0.05
    assert ((model.posterior[0][pattern] > 0.5) == toxic).mean() > 0.97
    every, none = (1 << VOTERS) - 1, 0
    assert model.posterior[1][every] > 0.5 > model.posterior[2][none]
    assert model.posterior[2][1] > model.posterior[0][1] > model.posterior[1][1]
