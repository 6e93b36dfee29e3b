import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, frame

from gridcheck.llm import lm_score, queries


@pytest.mark.parametrize("block, span, hot", [(3_000_000, 2_000_000, 1e-3), (900, 700, 1e-3), (900, 700, 0.02)])
def test_trigrams_and_singletons_match_brute_force(spark, monkeypatch, block, span, hot):
    monkeypatch.setattr(lm_score, "RANGE", span)
    monkeypatch.setattr(lm_score, "BLOCK", block)
    monkeypatch.setattr(lm_score, "HOT", hot)
    rng = random.Random(4)
    rows = ODD[:5] + [(i, " ".join(rng.choice("the of a to".split()) if rng.random() < 0.7 else rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(rng.randint(0, 60)))) for i in range(100, 300)]
    n1, n2, n3, texts = Counter(), Counter(), Counter(), []
    for i, t in rows:
        w = (t or "").encode().lower().split() + [b"\0end"]
        texts.append(w)
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            n1.update(w)
            n2.update(zip(w, w[1:]))
            n3.update(zip(w, w[1:], w[2:]))
    k2, k3, total = Counter(h for h, _ in n2), Counter((a, b) for a, b, _ in n3), sum(n1.values())
    p1 = lambda w: (n1[w] + 0.1) / (total + 0.1 * (len(n1) + 1))
    p2 = lambda a, b: (max(n2[a, b] - 0.75, 0) + 0.75 * k2[a] * p1(b)) / n1[a] if n1[a] else p1(b)
    p3 = lambda a, b, c: (max(n3[a, b, c] - 0.75, 0) + 0.75 * k3[a, b] * p2(b, c)) / n2[a, b] if n2[a, b] else p2(b, c)
    assert abs(sum(p3(b"the", b"of", w) for w in n1) + 0.1 / (total + 0.1 * (len(n1) + 1)) * 0.75 * k3[b"the", b"of"] / n2[b"the", b"of"] * 0.75 * k2[b"of"] / n1[b"of"] - 1) < 1e-9
    want = []
    for (i, _), w in zip(rows, texts):
        ps = [p1(w[0]), *(p2(*x) for x in list(zip(w, w[1:]))[:1]), *(p3(*x) for x in zip(w, w[1:], w[2:]))]
        want.append((str(i), len(w), sum(map(math.log10, ps))))
    monkeypatch.setattr(queries, "table", lambda *_: frame(spark, rows))
    got = [(str(r.doc_id), r.n_tokens, r.score) for r in queries.op2_lm_score(spark, "").collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want)):
        assert a[:2] == b[:2] and np.isclose(a[2], b[2], atol=1e-6)
