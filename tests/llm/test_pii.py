import random
import re

from helpers import ODD, empty, frame
from pyspark.sql import functions as F

from gridcheck.llm.pii import FEATURES, KINDS, boost, evidence, personal_data, redacted, spans_text, tree_scores


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in out)


def test_base_spans_match_brute_force(spark):
    rng = random.Random(5)
    parts = ["a", "é", "@", ".", "-", " ", "+", "1", "45", "(", ")", "23", "x.y@z.d", "_", "%", "4111 1111 1111 1111", "10.0.0.1", "+1 (555) 010-1234", "\n", "256", "😀"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(1500)] + ["1" * 50000, "a" * 50000, "1." * 20000, "+" + "1(" * 20000, "a@" * 20000, "1 " * 30000]
    rows = [*ODD, *((100 + i, t) for i, t in enumerate(texts))]
    got = personal_data(frame(spark, rows)).select("doc_id", spans_text(F.col("base")).alias("base")).collect()
    assert sorted(((r.doc_id, r.base) for r in got), key=str) == sorted(((i, base(t or "")) for i, t in rows), key=str)
    assert personal_data(empty(spark)).count() == 0


def corpus(n=400, seed=3):
    """Texts with personal data in base formats, and numbers that only look like it."""
    rng = random.Random(seed)
    number = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card():
        d = "4" + number(14)
        return d + next(c for c in "0123456789" if luhn(d + c))

    out = []
    for _ in range(n):
        out += [f"please contact ann{number(2)}@site{number(1)}.org today", f"call +1 555 {number(3)} {number(4)} now", f"card {card()} is valid", f"order {number(16)} shipped", f"version {number(3)}.{number(3)}.9.1 of it", f"server 10.0.{rng.randrange(256)}.7 is up", f"part +{number(1)} {number(3)}"]
    return [(1000 + i, t) for i, t in enumerate(out)]


def test_added_spans_leave_base_spans_alone(spark):
    planted = [(1, "mail: joe (at) host (dot) org"), (2, "call (555) 010-1234 or +1 (555) 010-9999"), (3, "server 2001:db8:0:0:0:0:0:1 is up"), (4, "page 1234 5678"), (5, "x joe@host.org y"), (6, "card 4111.1111.1111.1111 it is"), (7, "order 4111.1111.1111.1112 it is")]
    docs = frame(spark, planted + corpus())
    got = {r.doc_id: (r.base, r.added) for r in personal_data(docs).select("doc_id", spans_text(F.col("base")).alias("base"), spans_text(F.col("added")).alias("added")).collect()}
    assert got[1] == ("", "email:6:29") and got[2] == ("phone:23:40", "phone:5:19") and got[3] == ("", "ip:7:27") and got[4] == ("", "") and got[5] == ("email:2:14", "")
    assert got[6] == ("", "card:5:24") and got[7] == ("", "")
    assert {r.doc_id: r.text for r in redacted(docs).collect()}[2] == "call [phone] or [phone]"


def test_many_matches_in_one_text(spark):
    import time

    text = "".join(f"mail u{k}@host.org or (555) 010-{1000 + k % 9000}; " for k in range(25_000))
    start = time.time()
    (row,) = personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).select(F.size("base").alias("n"), F.element_at("base", -1).alias("last")).collect()
    assert row.n == 25_000 and text[row.last["start"] : row.last["end"]] == "u24999@host.org" and time.time() - start < 90


def test_evidence_is_lent_by_the_base_pattern():
    cell = dict.fromkeys(FEATURES, 0)
    counts = [(cell | {"generator": 3, "cue": 1}, 90, 10, 0), (cell | {"generator": 3, "cue": 2}, 0, 100, 0), (cell | {"generator": 10, "cue": 1}, 0, 0, 40), (cell | {"generator": 10, "cue": 2}, 0, 0, 40)]
    cells = evidence(counts, 0.1)
    scores = dict(zip((str(c) for c, _, _ in cells), tree_scores(boost(cells), cells)))
    assert scores[str(cell | {"generator": 10, "cue": 1})] > 0 > scores[str(cell | {"generator": 10, "cue": 2})]
    assert evidence([(cell | {"generator": 10}, 0, 0, 5)], 0.1) == [] and len(KINDS) == 4
