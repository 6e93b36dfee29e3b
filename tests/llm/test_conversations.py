import hashlib
import random
from functools import lru_cache
import zlib

import numpy as np

from gridcheck.llm import chat_windows as W
from gridcheck.llm import turn_repair as R
from gridcheck.llm.ordered import group_key, numbered

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def turns(spark, rows):
    return spark.createDataFrame([(*r, "x", -1, True) for r in rows], "conv_id long, turn long, role string, text string, g string, pos int, part boolean")


def odd_rows():
    rng = random.Random(7)
    rows = []
    for c in [*range(60), None, 1000]:
        n = 1200 if c == 1000 else rng.randint(1, 12)  # one conversation of most rows, in several chunks
        for t in range(n):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]) if c != 1000 or rng.random() < 0.1 else ("user", "assistant")[t % 2]
            text = rng.choice(["ok.", "yes!", "no", None, "", " \n", "a # b <c> \\d", "x y z?", "</turn> ### user: ", "é漢 " * rng.randint(1, 9)])
            rows.append((c, rng.choice([t, t, t, None]) if t % 5 == 4 else t, role, text))
    rows += [(2000, 0, "system", "be brief."), (2000, 1, "user", "word " * 3000), (2000, 2, "assistant", "w" * 50000 + ".")]
    rows += [(2001, 0, "user", "same."), (2001, 0, "user", "same."), (2001, 0, "user", "same.")]
    rng.shuffle(rows)
    return rows


def in_order(rows):
    key = lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), sha(r[3]))
    out = {}
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append(r)
    return out


def brute_repair(rows):
    """Damage, faults and cheapest edits by trying all paths with memory: the least (cost, audit)."""
    hurt, ids = [], {r[0] for r in rows}
    for c, t, role, text in rows:
        role, text = (" " if role is None else role), (" " if text is None else text)
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        hurt += [(c, t, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    placed, out = in_order(hurt), {}
    for c in ids:
        mine, seen, faults = placed.get(c, []), set(), []
        for _, _, role, text in mine:
            kept = text.strip(" \t\n\x0b\x0c\r")
            faults.append(1 if not kept else 2 if (role, text) in seen else 3 if kept[-1] not in ".!?" else 0)
            seen.add((role, text))
        nexts = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

        @lru_cache(None)
        def best(i, state, inserted):
            found = [(0, "", ())] if i == len(mine) and state in ("", "a") else []
            if inserted < 2:
                role = "assistant" if state == "u" else "user"
                cost, audit, lines = best(i, role[0], inserted + 1)
                found.append((cost + 2, "I" + audit, (role + ":", *lines)))
            if i < len(mine):
                role, text, f = mine[i][2], mine[i][3], faults[i]
                add = lambda extra, letter, line, to: (lambda r: (r[0] + extra, letter + r[1], (*line, *r[2])))(best(i + 1, to, 0))
                found.append(add(3, "D", (), state))
                if f in (0, 3):
                    found += [add(f // 3, "K", (f"{role}:{text}",), nexts[state, role[:1]])] if (state, role[:1]) in nexts else []
                    found += [add(2 + f // 3, "R", (f"{to}:{text}",), to[0]) for to in ("user", "assistant") if (state, to[0]) in nexts]
            return min(found) if found else (10**9, "", ())

        for i in range(len(mine), -1, -100):  # keeps the recursion shallow
            [best(i, s, n) for s in ("", "s", "u", "a") for n in (2, 1, 0)]
        cost, audit, lines = best(0, "", 0)
        numbers = [t for _, t, _, _ in mine if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out[c] = (gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, sha("\n".join(lines)))
    return out


def repair(spark, rows):
    df = turns(spark, rows)
    found = R.repaired_turns(R.damaged(df), df.select("conv_id", group_key("conv_id").alias("g")).distinct())
    return {r.conv_id: tuple(r)[1:] for r in found.collect()}


def test_repair_equals_brute_force(spark, monkeypatch):
    rows = odd_rows()
    want = brute_repair(rows)
    assert repair(spark, rows) == want
    monkeypatch.setattr(R, "CHUNK", 7)
    monkeypatch.setattr(R, "FAN", 5)  # several levels of maps
    assert repair(spark, rows) == want
    assert repair(spark, rows[:0]) == {}


def test_chunks_converge_to_the_whole_run():
    """Guessed ends, fix-up until vectors differ by a constant: the same costs as one run, and seldom a whole chunk."""
    rng = random.Random(1)
    codes = bytes(rng.choice([0, 1, 1, 2, 2, 3, 5, 9, 13, 14]) for _ in range(3000))
    whole = R.backward([codes], R.END[None])[0]
    parts = [codes[i : i + 100] for i in range(0, 3000, 100)]
    ends = [np.zeros(4, np.int64)] * 29 + [R.END]
    starts = [R.backward([p], e[None])[0, 0] for p, e in zip(parts, ends)]
    passes = 0
    while again := [i for i in range(29) if not R.same_shape(ends[i], starts[i + 1])]:
        told = list(starts)
        for i in again:
            starts[i] = R.fixed_up(parts[i], ends[i], told[i + 1], starts[i])
            ends[i] = told[i + 1]
        passes += 1
    assert 1 <= passes < 5
    total = starts[0] + sum((starts[i + 1] - ends[i])[0] for i in range(29))
    assert (total == whole[0]).all()


def test_windows_read_back_what_was_said(spark):
    rows = odd_rows()
    df = turns(spark, rows)
    want = {}
    for c, mine in in_order([(c, t, r or "", x or "") for c, t, r, x in rows]).items():
        learnt = "".join(r[3] for r in mine if r[2] == "assistant")
        want[c] = (len(mine), sha("".join(f"{r[2]}\n{r[3]}\n" for r in mine)), len(learnt), sha(learnt))
    for budget in (W.Budget(), W.Budget(60, 15, 10), W.Budget(7, 0, 0)):
        windows = W.write_windows(df, budget=budget)
        found = windows.collect()
        got = {r.conv_id: tuple(r)[1:] for r in W.read_digests(windows).collect()}
        assert {c: r[:4] for c, r in got.items()} == want
        for w in found:
            assert len(W.parsed(w.text)) == w.n_system + w.n_history + w.n_turns
            longest = max(len(x.split()) + W.MARKS for _, x in W.parsed(w.text))
            assert w.n_tokens <= max(budget.window, budget.history + budget.system + max(longest, 2 * budget.cell) + (longest if w.n_system else 0))
        if budget.window == 60:
            later = [w for w in found if w.conv_id == 1000 and w.start]
            assert any(w.n_history for w in later) and any(w.n_system for w in found)
    assert W.write_windows(df.limit(0)).count() == 0


def test_positions_and_sums_over_range_partitions(spark):
    from pyspark.sql import functions as F

    rows = [("hot", i, i % 5) for i in range(5000)] + [(f"g{i % 50}", i, i % 3) for i in range(1000)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, at long, n int").repartition(8)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = sorted(map(tuple, numbered(df, "g", [F.col("at")], {"total": F.col("n")}, "numbers").collect()))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    want, seen = [], {}
    for g, at, n in sorted(rows):
        pos, total = seen.get(g, (0, 0))
        want.append((g, at, n, pos, total))
        seen[g] = pos + 1, total + n
    assert got == want
