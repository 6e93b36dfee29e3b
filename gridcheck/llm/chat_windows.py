r"""Conversations as training texts: windows of whole turns within a token budget.

A turn is written as ``### role: text </turn>`` and a line feed.  In roles and
texts a backslash goes before each ``\``, ``#`` and ``<`` (and ``:`` in roles), so
neither mark can occur inside one, and taking the backslashes away gives back what
was there.

Sums of the tokens of earlier turns choose the windows: turns of at most ``cell``
tokens whose sums fall into the same multiple of ``cell``, and that no longer turn
parts, stand together, so they have at most twice ``cell``; a longer turn has a
window of its own.  A window begins with the conversation's system turn, if its
first turn is one, and repeats the turns before it that fit into ``history``
tokens.  What is repeated carries no loss: each assistant text is under the loss
mask once, in the window that holds it first.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, written
from .ordered import folded, group_key, numbered

#: Tokens of a turn's marks.
MARKS = 4
TURN_END = " </turn>\n"
HEADER = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)
ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Turns of a conversation whose windows share one copy of its system turn while joined.
BLOCK = 1 << 16


@dataclass(frozen=True)
class Budget:
    """Tokens of a window (``window``), of these for repeated turns (``history``) and for the system turn (``system``).

    What is left is for new turns, twice ``cell``.  A turn alone above that, or
    a longer system turn, makes its window larger: turns are never cut.
    """

    window: int = 2048
    history: int = 256
    system: int = 512

    @property
    def cell(self) -> int:
        return max(1, (self.window - self.history - self.system) // 2)


def escaped(c: Column, also: str = "") -> Column:
    return F.regexp_replace(c, rf"([\\#<{also}])", r"\\$1")


def formatted_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("### "), escaped(role, ":"), F.lit(": "), escaped(text), F.lit(TURN_END))


def word_tokens(text: Column) -> Column:
    """A turn's tokens: its words and its marks."""
    return F.regexp_count(text, F.lit(WORD_PATTERN)) + MARKS


def chat_windows(turns: DataFrame, budget: Budget = Budget(), tokens=word_tokens, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The windows of all conversations: ``conv_id``, ``start``, ``n_system``, ``n_history``, ``n_turns``, ``n_tokens``, ``text``, ``loss``.

    ``start`` is the place of its first new turn in the conversation, ``loss``
    the code points under the loss mask: spans of ``start`` and ``end``
    (exclusive), each the text of a new assistant turn.  ``tokens`` gives a text
    column's tokens, 1 at least.

    Turns go by turn, nulls first; ties by role, then SHA-256 of the text.  Null
    roles and texts are empty; a null id is a conversation of its own; an empty
    table has no windows; other columns are ignored.  A text of any length stays whole.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), group_key(conv_col).alias("g"), F.col(turn_col).cast("long").alias("turn"), said(role_col).alias("role"), said(text_col).alias("text"))
    size = tokens(F.col("text")).cast("long")
    rows = rows.select("conv_id", "g", "turn", formatted_turn(F.col("role"), F.col("text")).alias("line"), (F.col("role") == "assistant").alias("learnt"), (F.col("role") == "system").alias("sys"), size.alias("n"), F.length(formatted_turn(F.col("role"), F.lit(""))).alias("mark"), "role", F.sha2("text", 256).alias("sha"))
    order = [F.coalesce("turn", F.lit(-(1 << 63))), F.col("turn").isNotNull(), F.col("role"), F.col("sha")]
    placed = numbered(rows, "g", order, {"tokens": F.col("n"), "longer": (F.col("n") > budget.cell).cast("long")}, "turns").drop("role", "sha", "turn")
    placed = placed.withColumns({"first_system": F.col("sys") & (F.col("pos") == 0), "own": F.when(F.col("n") > budget.cell, F.lit(-1)).otherwise(F.expr(f"tokens div {budget.cell}"))})

    light = placed.select("g", "pos", "tokens", "n", "longer", "own", "first_system")
    members = light.groupBy("g", "longer", "own").agg(F.min("pos").alias("start"), F.min("tokens").alias("begun"))
    # repeated turns: those whose tokens, and all up to the window, fit into the history; a turn has a token at least,
    # so a bucket holds no more turns than tokens
    h = max(1, budget.history)
    bucket = lambda c: F.expr(f"{c} div {h}")
    near = light.filter("NOT first_system").select("g", "pos", "tokens", F.explode(F.array(bucket("tokens"), bucket("tokens") + 1)).alias("bucket"))
    starts = members.select("g", "start", "begun", bucket("begun").alias("bucket"))
    repeated = near.join(starts, ["g", "bucket"]).filter((F.col("pos") < F.col("start")) & (F.col("begun") - F.col("tokens") <= budget.history)).select("g", "pos", "start", F.lit(1).alias("part"))
    new = light.join(members, ["g", "longer", "own"]).select("g", "pos", "start", F.lit(2).alias("part"))
    # the system turn goes to every window but that which holds it, through one copy for each block of turns
    ends = light.groupBy("g").agg(F.max("pos").alias("last"))
    systems = light.filter("first_system").select("g").join(ends, "g").select("g", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"last div {BLOCK}"))).alias("block"))
    retained = members.filter("start > 0").select("g", "start", F.expr(f"start div {BLOCK}").alias("block")).join(systems, ["g", "block"]).select("g", F.lit(0).cast("long").alias("pos"), "start", F.lit(0).alias("part"), "block")
    # a system turn is copied in blocks too, not sent as often as there are windows to one place
    uses = repeated.unionByName(new).select("g", "pos", "start", "part", F.lit(0).cast("long").alias("block")).unionByName(retained)
    columns = ["conv_id", "g", "pos", "block", "line", "learnt", "n", "mark"]
    more = placed.filter("first_system").join(systems, "g").filter("block > 0").select(*columns)
    lines = placed.withColumn("block", F.lit(0).cast("long")).select(*columns).unionByName(more).join(uses, ["g", "pos", "block"])
    turn = F.struct("part", "pos", "line", "learnt", "n", "mark")
    windows = lines.groupBy("g", "start").agg(F.any_value("conv_id").alias("conv_id"), F.sort_array(F.collect_list(turn)).alias("turns"))
    return windows.mapInArrow(_assembled, _WINDOW.format(id=dict(turns.dtypes)[conv_col]))


_WINDOW = "conv_id {id}, start long, n_system int, n_history int, n_turns int, n_tokens long, text string, loss array<struct<start:long,end:long>>"


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 64):
            batch = whole.slice(at, 64)
            out = {n: [] for n in ("n_system", "n_history", "n_turns", "n_tokens", "text", "loss")}
            for turns in batch.column("turns").to_pylist():
                place, loss = 0, []
                for t in turns:
                    if t["part"] == 2 and t["learnt"]:
                        # behind "### assistant: ", before the end mark
                        loss.append({"start": place + t["mark"] - len(TURN_END), "end": place + len(t["line"]) - len(TURN_END)})
                    place += len(t["line"])
                for n, part in (("n_system", 0), ("n_history", 1), ("n_turns", 2)):
                    out[n].append(sum(t["part"] == part for t in turns))
                out["n_tokens"].append(sum(t["n"] for t in turns))
                out["text"].append("".join(t["line"] for t in turns))
                out["loss"].append(loss)
            spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("start"), *(pa.array(out[n], pa.int32()) for n in ("n_system", "n_history", "n_turns")), pa.array(out["n_tokens"], pa.int64()), pa.array(out["text"], pa.string()), pa.array(out["loss"], spans)],
                names=["conv_id", "start", *out],
            )


def parsed(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text: (role, text)."""
    out = []
    for turn in text.split(TURN_END)[:-1]:
        head = HEADER.match(turn)
        out.append((ESCAPED.sub(r"\1", head[1]), ESCAPED.sub(r"\1", turn[head.end() :])))
    return out


class _Read:
    """A conversation read back from its windows in order."""

    def __init__(self) -> None:
        self.turns, self.chars, self.size, self.all, self.learnt = 0, 0, 0, hashlib.sha256(), hashlib.sha256()

    def add(self, n_system: int, n_history: int, text: str, loss: list[dict]) -> None:
        for role, said in parsed(text)[n_system + n_history :]:
            self.all.update(f"{role}\n{said}\n".encode())
            self.turns += 1
        for span in loss:
            said = ESCAPED.sub(r"\1", text[span["start"] : span["end"]])
            self.learnt.update(said.encode())
            self.chars += len(said)
        self.size += len(text)

    def done(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.chars, self.learnt.hexdigest(), self.size


def read_digests(windows: DataFrame) -> DataFrame:
    """Each conversation as its windows give it: turns, text under the loss mask, and size of all windows."""
    rows = windows.select(group_key("conv_id").alias("g"), "conv_id", "start", "n_system", "n_history", "text", "loss")
    found = folded(rows, "g", ["start"], _Read, ["n_system", "n_history", "text", "loss"], "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    kind = dict(windows.dtypes)["conv_id"]
    return found.select(F.when(F.col("g") != "", F.substring("g", 2, 1 << 30)).cast(kind).alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def with_conversation(turns: DataFrame, conv_id: int, said: list[tuple[str, str]]) -> DataFrame:
    """``turns`` and one more conversation of the given (role, text)."""
    kinds = dict(turns.dtypes)
    more = turns.sparkSession.createDataFrame([(conv_id, i, r, t) for i, (r, t) in enumerate(said)], "conv_id long, turn long, role string, text string")
    names = ["conv_id", "turn", "role", "text"]
    return turns.select(*names).unionByName(more.select(*(F.col(c).cast(kinds[c]) for c in names)))


def write_windows(turns: DataFrame, path: str | None = None, **options) -> DataFrame:
    """The windows written as Parquet, to ``path`` or in the shared folder, and read from there."""
    return written(chat_windows(turns, **options), "windows", path)
