import random

import numpy as np
import pytest

from gridcheck.llm import ngram_join as J


def brute(rows, percent=80):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * len(a | sets[j]):
                label[find(i)] = find(j)
    out = {}
    for i in range(len(rows)):
        out.setdefault(find(i), []).append(i)
    ids = {}
    for group in out.values():
        known = [rows[k][0] for k in group if rows[k][0] is not None]
        for k in group:
            ids[k] = min(known) if known else None
    return [len(s) for s in sets], ids


def near_copies(seed, n=90):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = []
    for size in (0, 1, 3, 4, 5, 6, 7, 9, 12, 20, 40, 90, 300):
        base = [word() for _ in range(size)]
        for _ in range(n // 13):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, size // 30, size // 25, size // 20])):
                if copy:
                    copy[rng.randrange(len(copy))] = word()
            if rng.random() < 0.3:
                copy += [word() for _ in range(rng.randrange(1 + size // 8))]
            rows.append((len(rows), " ".join(copy).upper() if rng.random() < 0.2 else " ".join(copy)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, rounds, best", [(1, 2, 3), (2, 1, 1)])
def test_components_match_brute_force(spark, seed, rounds, best):
    rows = near_copies(seed)
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), rows[5], (None, rows[7][1]), (1003, rows[7][1])]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_shingles string")
    got = J.ngram_components(docs, rounds=rounds, best=best).collect()
    sizes, ids = brute(rows)
    want = sorted(((rows[k][0], sizes[k], ids[k]) for k in range(len(rows))), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_rows_without_ids_are_bridges(spark):
    """A set that only rows without an id have links others, and is found by others."""
    words = [f"w{k}" for k in range(60)]
    changed = lambda *at: " ".join(f"x{k}" if k in at else w for k, w in enumerate(words))
    rows = [(None, changed(0)), (7, changed()), (9, changed(0, 1, 59, 58, 57)), (11, changed(57, 58, 59, 56, 55)), (None, None), (None, "alone in the world of texts")]
    got = J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes, ids = brute(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(((rows[k][0], sizes[k], ids[k]) for k in range(len(rows))), key=str)
    assert ids[0] == 7


def test_many_ranges_are_dealt_to_in_two_steps(spark, monkeypatch):
    monkeypatch.setattr(J, "RANGE", 100)
    monkeypatch.setattr(J, "FAN", 3)
    monkeypatch.setattr(J, "SENT", 500)
    monkeypatch.setattr(J, "BUCKET", 2)
    rows = near_copies(3)
    got = J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    _, ids = brute(rows)
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((rows[k][0], ids[k]) for k in range(len(rows)))


@pytest.mark.parametrize("rounds", [1, 2])
def test_one_large_group_and_a_passage_in_all(spark, rounds, monkeypatch):
    """Copies of one text in a chain, and pairs of copies that share a passage."""
    monkeypatch.setattr(J, "CHUNK", 2_000)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    passage, text, rows = [word() for _ in range(60)], [word() for _ in range(80)], []
    for _ in range(120):
        text = list(text)
        text[rng.randrange(80)] = word()
        rows.append(" ".join(text))
    for _ in range(25):
        own = [word() for _ in range(rng.choice([12, 14, 16, 40]))]
        rows += [" ".join(own + passage), " ".join(own + passage + [word()])]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    got = J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), rounds=rounds).collect()
    _, ids = brute(rows)
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((rows[k][0], ids[k]) for k in range(len(rows)))


def test_no_rows(spark):
    assert J.ngram_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_one_of_each(spark):
    rows = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (3, None), (5, "q r s"), (5, "q r s"), (6, "t u v w x y z")]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, component_id int")
    got = J.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in got.collect() if r.text) == [(1, "a b c d e f g"), (5, "q r s"), (6, "t u v w x y z")]
    assert sum(r.text is None for r in got.collect()) == 2


def test_one_of_each_goes_by_row(spark):
    """A copy's id does not take another text with it; rows without ids are copies as well."""
    a, b, c = "a b c d e f g", "q r s t u v w x", "k l m n o p"
    rows = [(5, a), (5, b), (3, b), (None, a), (None, c), (None, c), (None, None)]
    got = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(5, a), (3, b), (None, c), (None, None)], key=str)


def test_keys_meet_for_all_linked_sizes():
    """Pairs at the limit of similarity, of all small sizes, share a key."""
    rng = np.random.default_rng(0)
    for a in range(1, 70):
        for b in range(a, min(a * 5 // 4 + 2, 90)):
            for _ in range(2):
                both = -(-4 * (a + b) // 9)  # least shared n-grams
                if both > a:
                    continue
                pool = rng.integers(0, 2**63, a + b - both, dtype=np.uint64)
                x, y = np.unique(pool[:a]), np.unique(pool[a - both :])
                assert np.intersect1d(J.segment_keys(x, 80), J.segment_keys(y, 80)).size


def test_repeated_rows_of_one_document_stay_one_set(spark):
    """Rows repeated by id and text, or without an id, in many tasks: one set each, so pairs do not multiply."""
    import time

    words = [f"w{i}" for i in range(40)]
    a, b, c = " ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"x{i}" for i in range(30))
    rows = [(1, a)] * 50_000 + [(2, b)] * 50_000 + [(None, a)] * 300 + [(3, c)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    began = time.time()
    got = {tuple(r) for r in J.ngram_components(docs, n=5, percent=80).select("doc_id", "n_shingles", "component_id").collect()}
    assert got == {(1, 36, 1), (2, 36, 1), (None, 36, 1), (3, 26, 3)}
    assert time.time() - began < 240
    assert sorted(r.doc_id for r in J.one_of_each(docs).collect()) == [1, 3]


def degrees(rows, percent=80):
    """How many other sets each row's set links with, by brute force."""
    shingles = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        shingles.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    every = set(shingles) - {frozenset()}
    return [sum(x != y and 100 * len(x & y) >= percent * len(x | y) for y in every) if x else 0 for x in shingles]


@pytest.mark.parametrize("chunk, cells", [(250_000, 1 << 17), (300, 64)])
def test_every_link_counts(spark, monkeypatch, chunk, cells):
    """Copies of copies in groups where components need few of the links, in one block and in many."""
    monkeypatch.setattr(J, "CHUNK", chunk)
    monkeypatch.setattr(J, "CELLS", cells)
    rows = near_copies(6)
    words = [f"w{k}" for k in range(70)]
    for k in range(40):
        rows.append((2000 + k, " ".join([*words[: 50 + k // 2], f"own{k}"])))
    rows += [(3000, None), (3001, ""), (3002, rows[-1][1].upper())]
    got = {r.doc_id: r.n_links for r in J.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = degrees(rows)
    assert got == {i: n for (i, _), n in zip(rows, want)}
    assert max(want) > 20


def test_a_chain_of_keys_is_not_compared_with_all_of_itself(spark, monkeypatch, tmp_path):
    """Keys make one group of many sets, each with a key of two others: what tasks compare grows with the sets, not with their square."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(J, "CHUNK", 1_000)
    rng = np.random.default_rng(1)
    plain, seen = J.ending, str(tmp_path)

    def counting(task, *forget):
        def run(batches):
            import uuid

            for batch in batches:
                with open(f"{seen}/{uuid.uuid4().hex}", "w") as f:
                    f.write(str(batch.nbytes))
                yield from task(iter([batch]))

        return plain(run, *forget)

    monkeypatch.setattr(J, "ending", counting)
    grams = [np.unique(rng.integers(0, 2**63, 50, dtype=np.uint64)) for _ in range(800)]
    for k in range(0, 800, 8):  # every eighth is a near copy of the set before it
        grams[k] = np.unique(np.append(grams[k - 1][:-2], grams[k][:2])) if k else grams[k]
    sets = spark.createDataFrame([(k, len(g), g.tobytes()) for k, g in enumerate(grams)], "cid long, n long, grams binary")
    keys = spark.createDataFrame([(key, k, k) for k in range(800) for key in (k, k + 1)], "key long, cid long, label long")
    open_keys = keys.join(keys.groupBy("key").count().filter("count > 1"), "key").select("key", "cid", "label")
    got = {tuple(r) for r in J._in_blocks(open_keys, sets, 80).collect()}
    assert got == {(k - 1, k) for k in range(8, 800, 8)}
    compared = sum(int(p.read_text()) for p in tmp_path.iterdir())
    assert compared < 15 * sets.agg(F.sum("n")).first()[0] * 8  # in a square: 80 times
