import random

import pytest
from helpers import empty, frame

from gridcheck.llm.decontaminate import Queries, contamination, decontaminated, is_contaminated, marks, words_of

def reference_marks(texts: list[str | None], items: list[tuple[str, str]], window: int) -> list[tuple[int, int, list[str]]]:
    """Compares every window with every place."""
    out = []
    for text in texts:
        words, hit, named = words_of(text), set(), set()
        for item, item_text in items:
            own = words_of(item_text)
            size = min(window, len(own))
            for at in range(len(own) - size + 1 if own else 0):
                for p in range(len(words) - size + 1):
                    if words[p : p + size] == own[at : at + size]:
                        hit |= set(range(p, p + size))
                        named.add(item)
        out.append((len(words), len(hit), sorted(named)))
    return out


def test_marks_match_brute_force():
    rng = random.Random(0)
    for _ in range(150):
        text = lambda n: " ".join(rng.choice("abcé"[: rng.choice([2, 3, 4])]) for _ in range(n))
        items = [(str(i), text(rng.randint(0, 8))) for i in range(rng.randint(0, 4))]
        texts = [rng.choice([None, "", text(rng.randint(0, 30)), text(10) + " X! " + text(5)]) for _ in range(5)]
        got = marks(texts, Queries(items, 4))
        assert [m[:3] for m in got] == reference_marks(texts, items, 4)
        for text, m in zip(texts, got):
            assert m[3] == longest(text, items, 4)
            if m[3]:
                own = words_of(dict(items)[m[4]])[m[6] : m[6] + m[3]]
                assert len(own) == m[3] and words_of(text)[m[5] : m[5] + m[3]] == own


def longest(text, items, window):
    """The longest match inside one item that has a whole window of it."""
    words, best = words_of(text), 0
    for _, item_text in items:
        own = words_of(item_text)
        size = min(window, len(own)) or window
        for i in range(len(words)):
            for k in range(len(own)):
                n = 0
                while i + n < len(words) and k + n < len(own) and words[i + n] == own[k + n]:
                    n += 1
                best = max(best, n if n >= size else 0)
    return best


def test_a_match_does_not_go_on_in_another_item():
    items = [("1", "a b c d"), ("2", "b c d e"), ("3", "c d e f")]
    (found,) = marks(["a b c d e f"], Queries(items, 3))
    assert found[1] == 6 and found[2] == ["1", "2", "3"] and found[3:7] == (4, "1", 0, 0)


def test_long_repeats_and_long_items():
    """Many equal suffixes, in one piece and in pieces of their own."""
    item = " ".join(f"w{k % 7}" for k in range(60)) + " tail"
    texts = ["x " * 50 + item] * 30 + ["w0 w1 w2 w3 w4 w5 w6 " * 300, "w0 " * 5000]
    together, alone = marks(texts, Queries([("1", item)], 13)), [marks([t], Queries([("1", item)], 13))[0] for t in texts]
    assert together == alone
    assert together[0][3:7] == (61, "1", 50, 0) and together[30][3] == 60 and together[31][1] == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_contamination(spark, block_bytes):
    passage = " ".join(f"w{i}" for i in range(15))
    docs = frame(spark, [(1, None), (2, ""), (3, passage.upper()), (3, passage.upper()), (4, "x " * 1000 + passage), (5, "short item"), (6, "clean text of words"), (None, passage)])
    items = spark.createDataFrame([(10, passage), (9, passage), (8, "Short, ITEM!"), (7, None), (None, "clean text"), (6, "")], "item_id long, text string")
    got = contamination(docs, items, window=13, block_bytes=block_bytes)
    assert got.columns == ["doc_id", "text", "source", "lang", "kept", "score", "n_words", "n_hit", "items", "longest_match", "match_item", "match_start", "item_start", "hits"]
    rows = sorted(((r.doc_id or 0, r.n_words, r.n_hit, r.longest_match, tuple(r["items"])) for r in got.collect()))
    assert rows == [(0, 15, 15, 15, ("10", "9")), (1, 0, 0, 0, ()), (2, 0, 0, 0, ()), (3, 15, 15, 15, ("10", "9")), (3, 15, 15, 15, ("10", "9")), (4, 1015, 15, 15, ("10", "9")), (5, 2, 2, 2, ("8",)), (6, 4, 0, 0, ())]
    assert sorted(r.doc_id or 0 for r in got.filter(is_contaminated()).collect()) == [0, 3, 3, 5]
    left = decontaminated(docs, items, window=13, block_bytes=block_bytes)
    assert left.columns == docs.columns and sorted((r.doc_id, r.n_words, r.items) for r in left.collect()) == [(1, -1, "x"), (2, -1, "x"), (4, -1, "x"), (6, -1, "x")]


def test_no_rows(spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination(empty(spark), items).count() == 0
    assert contamination(frame(spark), items.limit(0)).filter("n_hit > 0").count() == 0


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_odd_rows(spark, block_bytes):
    items = spark.createDataFrame([(1, "word word word"), (2, "next line last")], "item_id long, text string")
    got = contamination(frame(spark), items, window=3, block_bytes=block_bytes).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit) for r in got if r.n_hit) == [(5, 30000, 30000), (7, 10, 3)]  # a wide blank is no ASCII white space
    assert len(got) == 10
