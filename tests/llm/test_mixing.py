import math
from collections import Counter

import numpy as np
from helpers import empty, frame
from pyspark.sql import functions as F

from gridcheck.llm.mixing import Mix, copies, hypergeometric, mixed_documents, permuted, shard_counts, water_fill


def test_permutations_and_shards():
    for n in (1, 2, 3, 5, 64, 100, 999):
        assert sorted(permuted(np.arange(n), n, 123).tolist()) == list(range(n))
    slots = np.array([100, 20, 3, 0, 7777])
    first = np.zeros(5, np.int64)
    for shard in range(13):
        start, here = shard_counts(slots, 13, shard, 5)
        assert (start == first).all()
        first += here
    assert (first == slots).all()


def test_draws_of_any_size():
    rng = np.random.default_rng(1)
    slots = np.array([10**12, 3 * 10**11, 5, 0, 7 * 10**9])
    first = np.zeros(5, np.int64)
    for shard in range(4):
        start, here = shard_counts(slots, 4, shard, 5)
        assert (start == first).all() and (here >= 0).all()
        first += here
        share = slots / slots.sum()
        assert abs(here.sum() - slots.sum() // 4) <= 1
        assert (np.abs(here - here.sum() * share) <= 8 * np.sqrt(here.sum() * share * (1 - share)) + 5).all()
    assert (first == slots).all()
    # against the definition, for small ones
    for good, bad, n in ((5, 7, 4), (1, 9, 3), (6, 2, 7), (4, 0, 2), (0, 4, 2)):
        got = np.bincount([hypergeometric(rng, good, bad, n) for _ in range(6000)], minlength=n + 1) / 6000
        want = [math.comb(good, k) * math.comb(bad, n - k) / math.comb(good + bad, n) for k in range(n + 1)]
        assert np.abs(got - want).max() < 0.03


def test_taken_matches_brute_force(spark):
    """The words of each source laid end to end, cut into blocks, and every slot's block counted."""
    rows = [(i, " ".join(f"w{k}" for k in range((i * 37) % 91)), "abc"[i % 3] if i % 11 else None) for i in range(300)] + [(7, "again " * 9, "a"), (None, "no id", "b"), (8, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = Mix(docs, block_words=16, shard_words=640)
    assert mix.shards > 5
    place = {(r.doc_id, r.text): r.p for r in docs.select("doc_id", "text", F.xxhash64(F.col("doc_id").cast("string"), F.coalesce("text", F.lit(""))).alias("p")).collect()}
    ranges = max(1, len(rows) // 10_000)
    uses = Counter((r.number, r.block) for r in mix.slot_blocks().collect())
    want = []
    for plan in mix.sources:
        own = sorted((r for r in rows if (plan.key and plan.key[1:] or None) == r[2]), key=lambda r: (place[r[0], r[1]] % ranges, place[r[0], r[1]], r[0] or -1))
        at = 0
        for i, text, _ in own:
            size = len((text or "").split())
            want.append((str(i), size, sum(uses[plan.number, w // 16] for w in range(at, at + size))))
            at += size
        assert at == plan.size and sum(uses[plan.number, b] for b in range(plan.blocks)) == plan.slots
    assert sorted(want) == sorted((str(r.doc_id), r["size"], r.taken) for r in mix.taken().collect())


def test_water_fill():
    assert np.allclose(water_fill([100, 100, 100], [5, 2, 1], 3), [187.5, 75, 37.5])
    got = water_fill([10, 200, 0, 100], [5, 2, 9, 1], 3)
    assert got[0] == 30 and got[2] == 0 and np.isclose(sum(got), 310) and np.isclose(got[1] / got[3], 2)


def test_mix(spark):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(50 + i % 70))) for i in range(600)] + [(1, None), (2, ""), (None, "no id " * 20), (3, "same " * 40), (3, "same " * 40)]
    docs = frame(spark, rows).selectExpr("doc_id", "text", "CASE doc_id % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'a' WHEN 2 THEN 'é' END AS source", "score AS size", "0L AS n_chars")
    mix = Mix(docs, block_words=16)
    got = mix.taken().collect()
    assert len(got) == len(rows) and all(r.size == len((t or "").split()) for r, t in zip(sorted(got, key=lambda r: (str(r.doc_id), r.size)), [t for _, t in sorted(rows, key=lambda x: (str(x[0]), len((x[1] or "").split())))]))
    assert all(r.taken <= 3 * r.size for r in got)
    total = sum(r.size for r in got)
    for source, weight in (("a", 5), ("b", 2), ("é", 1), (None, 5)):
        mine = [r for r in got if r.source == source]
        assert np.isclose(mine[0].target, min(total * weight / 13, 3 * mine[0].source_size), rtol=0.2)
        assert abs(sum(r.taken for r in mine) - mine[0].target) < 0.03 * mine[0].target + 16
    again = Mix(docs.repartition(7), block_words=16).taken().collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixed_documents(docs, block_words=16)
    assert mixed.columns == docs.columns
    rows = mixed.collect()
    assert sum(len(r.text.split()) for r in rows) == sum(r.taken for r in got) and all(len(r.text) == r.n_chars for r in rows)


def test_copies():
    assert copies(" a  b\nc d ", [(0, 2, 2), (2, 4, 1)]) == ["a  b\nc d", "a  b"]
    assert copies("a b c d", [(0, 1, 1), (3, 4, 1)]) == ["a\nd"]


def test_odd_rows(spark):
    assert Mix(frame(spark)).taken().count() == 10
    assert Mix(empty(spark)).taken().count() == 0
    assert mixed_documents(empty(spark)).count() == 0
