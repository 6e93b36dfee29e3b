"""Repairing the turn structure of conversations by cheapest edits.

A conversation is well formed if its role initials read ``(s?(ua)+)?``.  Its rows
pass an automaton of four states (nothing yet, after s, after u, after a); a row
may be kept, given another role or deleted, and empty turns may be inserted, each
at a cost.  The cheapest costs to the end are a Viterbi recursion from the last
row to the first.

It runs in chunks of rows at once.  The last chunk of a conversation starts from
the true end costs, every other one from a guess (zeros).  Fix-up passes then give
each chunk what its successor found and run it again, but only until the new
vector and the old one differ by the same constant in all states: from there on
they always will.  When no chunk has to run again, the constants between chunks
add up to the true costs.  Edits are then traced chunk by chunk from the state in
which each is entered, which comes from composing the chunks' maps from entry to
exit state in a tree.

Conversations are told apart by id (null is one); of a conversation any number of
rows may lie in any number of tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written
from .ordered import folded, group_key, numbered

#: Rows of a conversation that one task runs through at once.
CHUNK = 256
#: Chunks whose maps are composed at once.
FAN = 1024
SPACE = " \t\n\x0b\x0c\r"
NOT_SPACE = r"[^\x20\x09-\x0D]"

START, AFTER_S, AFTER_U, AFTER_A = range(4)
RANK = {"s": 0, "u": 1, "a": 2}
OTHER = 3
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
DELETE, CHANGE, INSERT, LEFT = 3, 2, 2, 1
#: (state, initial) -> state
NEXT = {(START, 0): AFTER_S, (START, 1): AFTER_U, (AFTER_S, 1): AFTER_U, (AFTER_U, 2): AFTER_A, (AFTER_A, 1): AFTER_U}
#: The one role, user or assistant, that may follow each state, and the state after it.
WANTED = [("user", AFTER_U), ("user", AFTER_U), ("assistant", AFTER_A), ("user", AFTER_U)]
FAR = 1 << 40


def _closed(v: np.ndarray) -> np.ndarray:
    """Costs when empty turns may be inserted first; more than two in a row never pay."""
    for _ in range(2):
        v = np.minimum(v, INSERT + v[..., [to for _, to in WANTED]])
    return v


#: Costs to the end behind the last row.
END = _closed(np.array([0, FAR, FAR, 0], np.int64))


def _steps() -> np.ndarray:
    """For each code (initial + 4 * fault) the costs from state to state over its row."""
    steps = np.full((17, 4, 4), FAR, np.int64)
    for code in range(16):
        initial, fault = code % 4, code // 4
        for s in range(4):
            steps[code, s, s] = DELETE
            if fault in (BLANK, DUPLICATE):
                continue
            left = LEFT if fault == TRUNCATED else 0
            steps[code, s, WANTED[s][1]] = CHANGE + left
            if (s, initial) in NEXT:
                steps[code, s, NEXT[s, initial]] = left
    np.fill_diagonal(steps[16], 0)  # behind a chunk's end
    return steps


STEPS = _steps()


def before_row(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs to the end before a row, from those behind it; any number of rows at once."""
    return _closed((STEPS[code] + after[..., None, :]).min(-1))


def backward(codes: list[bytes], ends: np.ndarray) -> np.ndarray:
    """Costs before each row, and behind the last, of several chunks: (chunk, row, state).

    Shorter chunks are padded in front of what is behind them, so row i stays row i.
    """
    longest = max(map(len, codes))
    table = np.full((len(codes), longest), 16, np.int64)
    for i, c in enumerate(codes):
        table[i, : len(c)] = np.frombuffer(c, np.uint8)
    out = np.empty((len(codes), longest + 1, 4), np.int64)
    out[:, longest] = ends
    for i in range(longest - 1, -1, -1):
        padding = (table[:, i] == 16)[:, None]
        out[:, i] = np.where(padding, out[:, i + 1], before_row(table[:, i], out[:, i + 1]))
    return out


def same_shape(a: np.ndarray, b: np.ndarray) -> bool:
    return bool(((a - b) == (a - b)[0]).all())


def fixed_up(codes: bytes, old_end: np.ndarray, new_end: np.ndarray, old_start: np.ndarray) -> np.ndarray:
    """A chunk's start costs for another end, run only until old and new differ by a constant."""
    old, new = old_end, new_end
    for c in reversed(codes):
        if same_shape(old, new):
            return old_start + (new - old)[0]
        old, new = before_row(np.int64(c), old), before_row(np.int64(c), new)
    return new


def trace(codes: bytes, costs: np.ndarray, state: int, last: bool) -> tuple[int, list[tuple[str, list[str], str | None]]]:
    """The state behind a chunk, and each row's (audit letters, roles inserted before it, new role).

    The new role is null for a kept row and empty for a deleted one.  Of edits
    that cost the same, the first letter is taken: D, I, K, R.  Behind the last
    chunk comes a row of inserted turns.
    """
    out: list[tuple[str, list[str], str | None]] = []
    costs = costs.tolist()
    for i, code in enumerate(codes):
        initial, fault = code % 4, code // 4
        fixed, left = fault in (BLANK, DUPLICATE), LEFT if fault == TRUNCATED else 0
        letters, roles = "", []
        while True:
            role, to = WANTED[state]
            now, after = costs[i], costs[i + 1]
            if now[state] == DELETE + after[state]:
                out.append((letters + "D", roles, ""))
                break
            if now[state] == INSERT + now[to]:
                letters, roles, state = letters + "I", [*roles, role], to
                continue
            kept = NEXT.get((state, initial))
            if not fixed and kept is not None and now[state] == left + after[kept]:
                out.append((letters + "K", roles, None))
                state = kept
                break
            out.append((letters + "R", roles, role))
            state = to
            break
    if last:
        letters, roles = "", []
        while state not in (START, AFTER_A):
            letters, roles, state = letters + "I", [*roles, WANTED[state][0]], WANTED[state][1]
        out.append((letters, roles, ""))
    return state, out


def damaged(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``g``, ``turn``, ``role``, ``text`` of the rows, with faults by crc32 of ``conv:turn``; nulls are one blank there and in role and text."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col))) % 20
    rows = turns.select(group_key(conv_col).alias("g"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return rows.select("g", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("__copy")).drop("__copy")


def _codes(rows: DataFrame) -> DataFrame:
    """Each row's code, ``pos`` in its conversation: a chunk is a row with the codes in order."""
    initial = F.substring("role", 1, 1)
    last = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    light = rows.select("g", "pos", "role", "sha", F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER).alias("initial"), (~F.col("text").rlike(NOT_SPACE)).alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    first = light.filter("NOT blank").groupBy("g", "role", "sha").agg(F.min("pos").alias("pos")).select("g", "pos", F.lit(True).alias("first"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(SOUND)
    coded = light.join(first, ["g", "pos"], "left").select("g", "pos", (F.col("initial") + 4 * fault).alias("code"))
    packed = coded.groupBy("g", F.expr(f"pos div {CHUNK}").alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("rows"))
    return packed.select("g", "chunk", F.transform("rows", lambda r: r["code"]).alias("codes"))


_VECTORS = "g string, chunk long, codes array<int>, last boolean, end array<long>, start array<long>, counts array<long>"


def _bytes(codes: list[int]) -> bytes:
    return bytes(codes)


def _first_run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Start costs of each chunk from the true end or a guess, and its counts of faults and illegal pairs."""
    legal = {(0, 1), (1, 2), (2, 1)}
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            codes = [_bytes(c) for c in batch.column("codes").to_pylist()]
            last = batch.column("last").to_pylist()
            ends = np.where(np.array(last)[:, None], END, np.zeros(4, np.int64))
            starts = backward(codes, ends)[:, 0]
            counts = []
            for c in codes:
                a = np.frombuffer(c, np.uint8)
                initials = (a % 4).tolist()
                counts.append([*(int((a // 4 == f).sum()) for f in (BLANK, DUPLICATE, TRUNCATED)), sum(p not in legal for p in zip(initials, initials[1:]))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("g"), batch.column("chunk"), batch.column("codes"), batch.column("last"), pa.array(ends.tolist(), pa.list_(pa.int64())), pa.array(starts.tolist(), pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))],
                names=["g", "chunk", "codes", "last", "end", "start", "counts"],
            )


def _differs(a: str, b: str) -> Column:
    """Whether two vectors differ by more than a constant."""
    d = F.zip_with(a, b, lambda x, y: x - y)
    return F.exists(d, lambda x: x != F.get(d, F.lit(0)))


def _fix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends, starts = [], []
        for codes, end, start, told, again in zip(*(batch.column(n).to_pylist() for n in ("codes", "end", "start", "told", "again"))):
            if again:
                start = fixed_up(_bytes(codes), np.array(end), np.array(told), np.array(start)).tolist()
                end = told
            ends.append(end)
            starts.append(start)
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("g", "chunk", "codes", "last")] + [pa.array(ends, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64())), batch.column("counts")], names=["g", "chunk", "codes", "last", "end", "start", "counts"])


def converged(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Chunks of conversations of several chunks, run again until each fits its successor; and the number of passes."""
    passes = 0
    while True:
        told = vectors.filter("chunk > 0").select("g", (F.col("chunk") - 1).alias("chunk"), F.col("start").alias("told"))
        asked = vectors.join(told, ["g", "chunk"], "left").withColumn("again", F.coalesce(_differs("end", "told"), F.lit(False)))
        if not asked.filter("again").limit(1).count():
            return vectors, passes
        turned = written(asked.mapInArrow(_fix, _VECTORS), "vectors")
        dropped(vectors)
        vectors, passes = turned, passes + 1


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk the state behind it for each state before it."""
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            codes = [_bytes(c) for c in batch.column("codes").to_pylist()]
            costs = backward(codes, np.array(batch.column("end").to_pylist(), np.int64))
            maps = [[trace(c, v, s, False)[0] for s in range(4)] for c, v in zip(codes, costs)]
            yield pa.RecordBatch.from_arrays([batch.column("g"), batch.column("chunk"), pa.array(maps, pa.list_(pa.int32()))], names=["g", "chunk", "exit"])


def entries(maps: DataFrame) -> DataFrame:
    """``g``, ``chunk``, ``state``: the state in which each chunk is entered, from all chunks' maps (``exit``).

    Maps of FAN neighbours are composed to one, those again, until one is left for
    each conversation; then states go down the same way.
    """
    spans = maps.groupBy("g", F.expr(f"chunk div {FAN}").alias("up")).agg(F.sort_array(F.collect_list(F.struct("chunk", "exit"))).alias("below"))
    spans = written(spans, "spans")
    if spans.filter("up > 0").limit(1).count():
        nothing = F.array(*(F.lit(s) for s in range(4)))
        whole = F.aggregate("below", nothing, lambda a, x: F.transform(a, lambda s: F.get(x["exit"], s)))
        states = entries(spans.select("g", F.col("up").alias("chunk"), whole.alias("exit"))).withColumnRenamed("chunk", "up")
        spans = spans.join(states, ["g", "up"])
    else:
        spans = spans.withColumn("state", F.lit(START))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, int, int]] = []
            for g, below, state in zip(*(batch.column(n).to_pylist() for n in ("g", "below", "state"))):
                for x in below:
                    out.append((g, x["chunk"], state))
                    state = x["exit"][state]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()), pa.array([r[1] for r in out], pa.int64()), pa.array([r[2] for r in out], pa.int32())], names=["g", "chunk", "state"])

    return spans.select("g", "below", "state").mapInArrow(down, "g string, chunk long, state int")


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            codes = [_bytes(c) for c in batch.column("codes").to_pylist()]
            costs = backward(codes, np.array(batch.column("end").to_pylist(), np.int64))
            out = []
            for g, chunk, c, v, state, last in zip(batch.column("g").to_pylist(), batch.column("chunk").to_pylist(), codes, costs, batch.column("state").to_pylist(), batch.column("last").to_pylist()):
                out += [(g, chunk, i, *edit) for i, edit in enumerate(trace(c, v, state, last)[1])]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), k) for x, k in zip(zip(*out), kinds)], names=["g", "chunk", "at", "letters", "inserts", "role_to"])


class _Repaired:
    """Reads a conversation's edits and rows in order: each edit comes before its row."""

    def __init__(self) -> None:
        self.digest, self.letters, self.role_to, self.begun = hashlib.sha256(), [], None, False

    def line(self, role: str, text: str) -> None:
        self.digest.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True

    def add(self, part: int, letters: str | None, inserts: list[str] | None, role_to: str | None, role: str | None, text: str | None) -> None:
        if part == 0:
            self.letters.append(letters)
            self.role_to = role_to
            for r in inserts:
                self.line(r, "")
        elif self.role_to != "":
            self.line(role if self.role_to is None else self.role_to, text)

    def done(self) -> tuple:
        return "".join(self.letters), self.digest.hexdigest()


def repaired_turns(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each of ``conversations`` (column ``g``): gaps, faults, cost, audit and digest of the repaired turns.

    ``rows`` has ``g``, ``turn`` (long), ``role`` and ``text``, none of the last
    two null.  They are taken by turn, nulls first; ties go by role, then by
    SHA-256 of the text, and rows equal in all of these are alike anyway.  Texts
    of any length count whole: equal texts are found by SHA-256.  An initial is a
    role's first character; other initials than s, u and a (none too, for an empty
    role) can't be kept.  A group without rows has zeros, an empty audit and the
    digest of nothing; an empty table gives no rows.  Other columns are ignored.
    """
    rows = rows.select("g", "turn", "role", "text", F.sha2("text", 256).alias("sha"))
    rows = written(numbered(rows, "g", [F.coalesce("turn", F.lit(-(1 << 63))), F.col("turn").isNotNull(), F.col("role"), F.col("sha")], {}, "turns"), "placed")
    gaps = rows.groupBy("g").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"), F.expr(f"max(pos) div {CHUNK}").alias("last_chunk"))
    chunks = _codes(rows).join(gaps.select("g", "last_chunk"), "g").select("g", "chunk", "codes", (F.col("chunk") == F.col("last_chunk")).alias("last"))
    vectors = written(chunks.mapInArrow(_first_run, _VECTORS), "vectors")
    several = vectors.filter("chunk > 0 OR NOT last")
    if several.limit(1).count():
        several, _ = converged(written(several, "vectors"))
        states = entries(several.mapInArrow(_exits, "g string, chunk long, exit array<int>"))
    else:
        states = vectors.limit(0).select("g", "chunk", F.lit(0).alias("state"))
    single = vectors.filter("chunk = 0 AND last").withColumn("state", F.lit(START))
    every = single.unionByName(several.join(states, ["g", "chunk"]))
    # what lies between a chunk and its successor: the constant of their costs, a pair of initials
    initial = lambda i: F.element_at("codes", i) % 4
    after = several.filter("chunk > 0").select("g", (F.col("chunk") - 1).alias("chunk"), F.get("start", F.lit(0)).alias("found"), initial(1).alias("initial"))
    pair = F.concat(initial(-1).cast("string"), F.col("initial").cast("string"))
    between = several.join(after, ["g", "chunk"]).select("g", (F.col("found") - F.get("end", F.lit(0))).alias("cost"), *(F.lit(0).cast("long").alias(n) for n in ("blank", "duplicate", "truncated")), (~pair.isin("01", "12", "21")).cast("long").alias("illegal"))
    own = every.select("g", F.when(F.col("chunk") == 0, F.get("start", F.lit(0))).otherwise(0).alias("cost"), *(F.get("counts", F.lit(i)).alias(n) for i, n in enumerate(("blank", "duplicate", "truncated", "illegal"))))
    sums = own.unionByName(between).groupBy("g").agg(*(F.sum(n).alias(n) for n in ("blank", "duplicate", "truncated", "illegal", "cost")))
    edits = every.mapInArrow(_edits, "g string, chunk long, at long, letters string, inserts array<string>, role_to string").withColumn("pos", F.col("chunk") * CHUNK + F.col("at"))
    none = F.lit(None).cast("string")
    parts = edits.select("g", "pos", F.lit(0).alias("part"), "letters", "inserts", "role_to", none.alias("role"), none.alias("text")).unionByName(rows.select("g", "pos", F.lit(1).alias("part"), none.alias("letters"), F.lit(None).cast("array<string>").alias("inserts"), none.alias("role_to"), "role", "text"))
    read = folded(parts, "g", ["pos", "part"], _Repaired, ["part", "letters", "inserts", "role_to", "role", "text"], "audit string, repaired_sha256 string")
    found = conversations.join(gaps.select("g", "gaps"), "g", "left").join(sums, "g", "left").join(read, "g", "left")
    zero = lambda n: F.coalesce(F.col(n), F.lit(0).cast("long")).alias(n)
    own_columns = [c for c in conversations.columns if c != "g"]
    return found.select(*own_columns, *(zero(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
