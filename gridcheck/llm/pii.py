"""Personal data: base patterns, and more spans chosen by boosted trees.

Everything that touches rows is DataFrame functions.  One pass proposes spans:
the four base patterns and generators with high recall (their spans may
overlap), each with a few small features of its format and its surroundings.
A combination of feature values is a *cell*; there are at most ``CELLS``
of them whatever the corpus, so the counts of cells fit the driver.  Trees
boosted on these counts become CASE expressions; thresholds come from the spans
held out of training.  The base spans always stay.

What the counts say of a generator that no base pattern judges comes from the
corpus too: spans that the base pattern of its kind accepts or rejects stand for
the same data written in the generator's format (digits, check sum, cues and
edges do not change with it), and its own candidates, of which nothing is known,
count as rejected at a rate of ``doubt``.

Overlaps are found by running maxima over the spans of a text in order, so the
work for a text with many spans does not grow with their square.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

KINDS = ("email", "ip", "card", "phone")

#: Base patterns; possessive and with a look behind where that changes no match
#: but keeps the time linear and the stack flat on very long runs.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT, _DOT = r"(?:\(at\)|\[at\]|\{at\})", r"(?:\.|\(dot\)|\[dot\]|\{dot\})"
#: More generators: (kind, pattern, a pattern that a text must have).
MORE = [
    ("email", rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}+ ?{_AT} ?[A-Za-z0-9-]++(?: ?{_DOT} ?[A-Za-z0-9-]++){{1,6}}", r"[(\[{]at[)\]}]"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++){1,6}", r" at [A-Za-z0-9-]+ dot "),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]:[0-9A-Fa-f]"),
    ("ip", r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}(?![0-9A-Za-z:])", r"[0-9A-Fa-f]::[0-9A-Fa-f]"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{1,3}[0-9]{4}){3}(?![0-9])", r"[0-9]{4}[\x20._/-]{1,3}[0-9]{4}"),
    ("card", r"(?<![0-9])[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5}(?![0-9])", r"[0-9]{4}"),
    ("phone", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])", r"[0-9]{3}[)\x20.-]"),
    ("phone", r"(?<![0-9+.-])0[0-9]{1,4}[\x20/-][0-9]{2,4}(?:[\x20-]?[0-9]{2,4}){1,3}(?![0-9-])", r"0[0-9]{1,4}[\x20/-]"),
]
GENERATORS = [*((k, p, "@" if k == "email" else r"\+[0-9]" if k == "phone" else r"[0-9]") for k, p in BASE.items()), *MORE]
#: A text without any of these has no candidates.
ANY = r"[0-9@]|[(\[{]at[)\]}]| at [A-Za-z0-9-]+ dot |[A-Fa-f]:[A-Fa-f:]"

#: Words in front of a span that speak for its kind, or against personal data.
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|reach)\b[^.]{0,12}$",
    "ip": r"(?i)\b(?:ip|host|server|address|client)\b[^.]{0,12}$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|payment)\b[^.]{0,12}$",
    "phone": r"(?i)\b(?:tel|phone|call|mobile|cell|fax|contact|whatsapp)\b[^.]{0,12}$",
}
AGAINST = r"(?i)(?:\b(?:version|isbn|issn|doi|page|section|order|invoice|serial|part|id|no)\b[^.]{0,6}|[$€£#v])$"
BEFORE = 32
#: Lengths that are summed together when places are found.
TOGETHER = 128

FEATURES = {"generator": len(GENERATORS), "luhn": 2, "digits": 6, "cue": 3, "left": 2, "right": 2, "flat": 2}
CELLS = int(np.prod(list(FEATURES.values())))

OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        x = F.substring(digits, -i, F.lit(1)).cast("int") * (1 + (i - 1) % 2)
        return x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def base_valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern is accepted."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(rf"^{OCTET}\.{OCTET}\.{OCTET}\.{OCTET}$")
    if kind == "card":
        return F.when(F.length(_digits(m)).between(16, 19), luhn(_digits(m))).otherwise(False)
    return F.length(_digits(m)).between(8, 15)


def _found(number: int) -> Column:
    """Matches of a generator in ``__text``, as an array of strings."""
    _, pattern, needs = GENERATORS[number]
    have = F.col("__text").rlike(needs) if needs != "@" else F.contains("__text", F.lit("@"))
    return F.when(F.col("__any") & have, F.regexp_extract_all("__text", F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _gaps(number: int) -> Column:
    """What stands before, between and after the matches."""
    return F.when(F.size(f"m{number}") > 0, F.split("__text", GENERATORS[number][1], -1))


def _sum(array: Column) -> Column:
    return F.aggregate(array, F.lit(0), lambda a, x: a + x)


def _steps(number: int) -> Column:
    """From the start of each match to that of the next, in code points; the first from the start of the text."""
    matches, gaps = F.col(f"m{number}"), F.col(f"g{number}")
    return F.transform(matches, lambda m, i: F.length(F.get(gaps, i)) + F.coalesce(F.length(F.get(matches, i - 1)), F.lit(0)))


def _parts(number: int) -> Column:
    """The steps summed ``TOGETHER`` at a time."""
    steps = F.col(f"l{number}")
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(steps) / TOGETHER).cast("int")), lambda k: _sum(F.slice(steps, k * TOGETHER + 1, TOGETHER)))


def _bases(number: int) -> Column:
    parts = F.col(f"c{number}")
    return F.transform(parts, lambda _, k: _sum(F.slice(parts, F.lit(1), k)))


def _located(number: int) -> Column:
    """Matches with their places, what is around them, and the base verdict.

    Around a match is what stands since the match before the last, at most
    ``BEFORE`` characters, and the next character.
    """
    kind = GENERATORS[number][0]
    matches, gaps, steps, bases = (F.col(f"{x}{number}") for x in "mglb")

    def one(m: Column, i: Column) -> Column:
        part = F.floor(i / TOGETHER).cast("int")
        start = F.get(bases, part) + _sum(F.slice(steps, part * TOGETHER + 1, i % TOGETHER + 1))
        near = F.concat(F.coalesce(F.get(matches, i - 1), F.lit("")), F.get(gaps, i))
        return F.struct(
            F.lit(number).alias("generator"), start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match"),
            F.right(near, F.lit(BEFORE)).alias("before"),
            F.left(F.concat(F.get(gaps, i + 1), F.coalesce(F.get(matches, i + 1), F.lit(""))), F.lit(1)).alias("after"),
            (base_valid(kind, m) if number < len(BASE) else F.lit(None).cast("boolean")).alias("base"),
        )

    return F.transform(matches, one)


def _features(c: Column) -> Column:
    """A candidate with its features as small integers."""
    digits = _digits(c["match"])
    n = F.length(digits)
    by_kind = lambda f: F.element_at(F.array(*(F.lit(f(k)) for k, _, _ in GENERATORS)), c["generator"] + 1)
    cue = F.when(c["before"].rlike(AGAINST), 2)
    for kind, pattern in CUES.items():
        cue = cue.when((by_kind(lambda k: k) == kind) & c["before"].rlike(pattern), 1)
    level = F.when(n == 0, 0).when(n < 8, 1).when(n < 12, 2).when(n < 16, 3).when(n < 20, 4).otherwise(5)
    return F.struct(
        c["generator"].alias("generator"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"),
        by_kind(lambda k: KINDS.index(k)).alias("kind"),
        F.pmod(F.xxhash64(c["match"]), F.lit(5)).cast("int").alias("fold"),
        F.when(n.between(12, 19), luhn(digits)).otherwise(False).cast("int").alias("luhn"),
        level.alias("digits"), cue.otherwise(0).alias("cue"),
        c["before"].rlike(r"[A-Za-z0-9_]$").cast("int").alias("left"), c["after"].rlike(r"[A-Za-z0-9_]").cast("int").alias("right"),
        digits.rlike(r"^(\d)\1*$").cast("int").alias("flat"),
    )


def candidates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with ``spans``: all candidates with their features."""
    kept = [c for c in docs.columns if c != text_col]
    step = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    step = step.select("*", F.col("__text").rlike(ANY).alias("__any"))
    numbers, known = range(len(GENERATORS)), []
    step = step.select(*kept, "__text", *(_found(i).alias(f"m{i}") for i in numbers))
    for name, of in (("g", _gaps), ("l", _steps), ("c", _parts), ("b", _bases)):
        known += [f"m{i}" for i in numbers] if name == "g" else []
        step = step.select(*kept, *(["__text"] if name == "g" else []), *known, *(of(i).alias(f"{name}{i}") for i in numbers))
        known += [f"{name}{i}" for i in numbers]
    step = step.select(*kept, F.concat(*(_located(i) for i in numbers)).alias("found"))
    return step.select(*kept, F.transform("found", _features).alias("spans"))


@dataclass(frozen=True)
class Tree:
    """Two levels: tests (feature, value) for equality, and four leaves."""

    root: tuple[str, int]
    yes: tuple[str, int]
    no: tuple[str, int]
    leaves: tuple[float, float, float, float]  # yes-yes, yes-no, no-yes, no-no

    def column(self, c: Column) -> Column:
        test = lambda t: c[t[0]] == t[1]
        a, b, d, e = self.leaves
        return F.when(test(self.root), F.when(test(self.yes), a).otherwise(b)).otherwise(F.when(test(self.no), d).otherwise(e))


Cells = list[tuple[dict[str, int], float, float]]


def evidence(counts: list[tuple[dict[str, int], int, int, int]], doubt: float) -> Cells:
    """Cells with what speaks for and against them, from counts (cell, accepted, rejected, not judged).

    For a generator without judge: the judged cells of its kind's base pattern,
    scaled to as many as its own candidates, and of these ``doubt`` each against.
    Other formats of IP addresses have other digits, so there these are spread
    as among the generator's own candidates.
    """
    out: Cells = [(c, float(up), float(down)) for c, up, down, _ in counts if up + down]
    for g in range(len(BASE), len(GENERATORS)):
        base = KINDS.index(GENERATORS[g][0])
        own = [(c, n) for c, _, _, n in counts if c["generator"] == g and n]
        lent = [(c, up, down) for c, up, down, _ in counts if c["generator"] == base and up + down]
        if not own or not lent:
            continue
        scale = sum(n for _, n in own) / sum(up + down for _, up, down in lent)
        if GENERATORS[g][0] == "ip":
            whole = sum(n for _, n in own)
            shares = {d: sum(n for c, n in own if c["digits"] == d) / whole for d in {c["digits"] for c, _ in own}}
            lent = [(c | {"digits": d}, up * share, down * share) for c, up, down in lent for d, share in shares.items()]
        out += [(c | {"generator": g}, up * scale, down * scale) for c, up, down in lent]
        out += [(c, 0.0, doubt * n) for c, n in own]
    return out


def boost(cells: Cells, rounds: int = 40, rate: float = 0.3) -> list[Tree]:
    """Boosts trees of two levels on counted cells, by Newton steps on the log loss."""
    if not cells:
        return []
    tests = [(f, v) for f, n in FEATURES.items() for v in range(n) if n > 2 or v]
    x = np.array([[c[f] == v for f, v in tests] for c, _, _ in cells])
    up, down = (np.array([c[i] for c in cells], float) for i in (1, 2))
    weight, score, trees = up + down, np.zeros(len(cells)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        g, h = up - weight * p, weight * p * (1 - p)

        def best(mask: np.ndarray, g=g, h=h) -> tuple[int, float]:
            gy, hy = (g * mask) @ x, (h * mask) @ x
            gn, hn = (g * mask).sum() - gy, (h * mask).sum() - hy
            gain = gy**2 / (hy + 1) + gn**2 / (hn + 1)
            return int(gain.argmax()), float(gain.max())

        options = []
        for r in range(len(tests)):
            (y, a), (n, b) = best(x[:, r]), best(~x[:, r])
            options.append((a + b, r, y, n))
        _, r, y, n = max(options)
        parts = [x[:, r] & x[:, y], x[:, r] & ~x[:, y], ~x[:, r] & x[:, n], ~x[:, r] & ~x[:, n]]
        leaves = tuple(float(np.round(rate * g[m].sum() / (h[m].sum() + 1), 9)) for m in parts)
        trees.append(Tree(tests[r], tests[y], tests[n], leaves))
        score += sum(m * v for m, v in zip(parts, leaves))
    return trees


def tree_scores(trees: list[Tree], cells: Cells) -> np.ndarray:
    out = np.zeros(len(cells))
    for t in trees:
        for i, (c, _, _) in enumerate(cells):
            on = lambda q, c=c: c[q[0]] == q[1]
            out[i] += t.leaves[(0 if on(t.yes) else 1) if on(t.root) else (2 if on(t.no) else 3)]
    return out


def calibrate(scores: np.ndarray, cells: Cells, precision: float) -> dict[str, float]:
    """Per kind, the lowest score above which held-out spans keep the precision.

    Scores are log odds: the limit is never below the odds that the precision
    stands for, and goes down to these where all held-out spans of a kind keep it.
    """
    out, odds = {}, float(np.log(precision / (1 - precision)))
    for kind in KINDS:
        own = [i for i, (c, _, _) in enumerate(cells) if GENERATORS[c["generator"]][0] == kind]
        own.sort(key=lambda i: -scores[i])
        up = down = 0.0
        out[kind] = float("inf")
        for k, i in enumerate(own):
            up, down = up + cells[i][1], down + cells[i][2]
            if up >= precision * (up + down) and (k + 1 == len(own) or scores[own[k + 1]] < scores[i]):
                out[kind] = max(float(scores[i]), odds) if k + 1 < len(own) else odds
    return out


@dataclass(frozen=True)
class Model:
    trees: list[Tree]
    thresholds: dict[str, float]


def _meets(condition: Column, *by: str) -> Column:
    """Whether a span overlaps another one, of the same ``by``, that meets the condition."""
    order = ["start", "end", "generator"]
    before = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    one = F.max(F.when(condition, F.col("end"))).over(before) > F.col("start")
    two = F.min(F.when(condition, F.col("start"))).over(after) < F.col("end")
    return F.coalesce(one, F.lit(False)) | F.coalesce(two, F.lit(False))


def train(spans: DataFrame, precision: float = 0.85, doubt: float = 0.1) -> Model:
    """Fits trees and thresholds to the counts of cells of all candidates (rows with ``row`` and a span's fields).

    A span of a base pattern counts as accepted or rejected.  So does a span of
    another generator that overlaps an accepted or, failing that, a rejected one
    of its kind; for the others see ``evidence``.  Spans are held out by a hash
    of their text; thresholds come from their evidence alone.
    """
    base = F.col("base")
    yes, any_ = _meets(F.coalesce(base, F.lit(False)), "row", "kind"), _meets(base.isNotNull(), "row", "kind")
    judged = spans.withColumn("y", F.when(base.isNotNull(), base).when(yes, True).when(any_, False))
    y = F.col("y")
    rows = judged.groupBy(*FEATURES, (F.col("fold") == 0).alias("held_out")).agg(F.count_if(y).alias("up"), F.count_if(~y).alias("down"), F.count_if(y.isNull()).alias("open")).collect()
    named = lambda r: {f: r[f] for f in FEATURES}
    # candidates that nothing is known of are not labels: all of them count on both sides
    unknown = [(named(r), 0, 0, r.open) for r in rows if r.open]
    part = lambda held: evidence(sorted([(named(r), r.up, r.down, 0) for r in rows if r.held_out == held] + unknown, key=str), doubt)
    trees, held = boost(part(False)), part(True)
    return Model(trees, calibrate(tree_scores(trees, held), held, precision))


def _chosen(spans: DataFrame, model: Model) -> DataFrame:
    """(row, kind, start, end) of spans that no base span overlaps and whose score passes, best first, none overlapping another."""
    free = spans.withColumn("taken", _meets(F.coalesce(F.col("base"), F.lit(False)), "row")).filter("base IS NULL AND NOT taken")
    score = F.lit(0.0)
    for tree in model.trees:
        score = score + tree.column(F.struct(*FEATURES))
    limits = F.array(*(F.lit(model.thresholds[k]) for k in KINDS))
    passing = free.withColumn("score", score).filter(F.col("score") >= F.element_at(limits, F.col("kind") + 1) - 1e-6)
    order = Window.partitionBy("row").orderBy("start", "end", "generator")
    ends = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    groups = passing.withColumn("new", F.when(F.col("start") < ends, 0).otherwise(1)).withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # spans that overlap one after the other: a few
    ranked = groups.groupBy("row", "group").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("rank"), "start", "end", "kind"))).alias("x"))
    none = F.array().cast("array<struct<rank:double,start:int,end:int,kind:int>>")
    best = F.aggregate("x", none, lambda a, s: F.when(F.exists(a, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])), a).otherwise(F.concat(a, F.array(s))))
    return ranked.select("row", F.explode(best).alias("s")).select("row", "s.kind", "s.start", "s.end")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", precision: float = 0.85, doubt: float = 0.1) -> DataFrame:
    """One row per input row: the id, ``base`` and ``added`` spans (kind, start, end), sorted.

    Null and empty texts have no spans.  Repeated rows keep a row each.  A very
    long text is searched in one task, in time that follows its length and its
    number of matches.  Of candidates with equal scores that overlap, the first
    stays.  Other columns are not read.  On an empty table, or one without base
    spans of a kind, nothing is added (of that kind).
    """
    found = written(candidates(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).withColumn("row", F.monotonically_increasing_id()), "candidates")
    spans = found.filter(F.size("spans") > 0).select("row", F.explode("spans").alias("c")).select("row", "c.*")
    model = train(spans, precision, doubt)
    place = F.struct("kind", "start", "end")
    added = _chosen(spans, model).groupBy("row").agg(F.sort_array(F.collect_list(place)).alias("added"))
    base = F.sort_array(F.transform(F.filter("spans", lambda c: F.coalesce(c["base"], F.lit(False))), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return found.join(added, "row", "left").select(F.col("id").alias(id_col), base.alias("base"), F.coalesce("added", none).alias("added"))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", F.element_at(names, c["kind"] + 1), c["start"], c["end"])), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda c: c["kind"] == KINDS.index(kind))).cast("long")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Id and text with every span replaced by its kind in brackets.

    Ids must be unique here: the spans are joined to the texts by id.
    """
    found = personal_data(docs, id_col, text_col, **options)
    spans = F.sort_array(F.transform(F.concat("base", "added"), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    names = F.array(*map(F.lit, KINDS))
    text = F.col(text_col)

    def put(a: Column, c: Column) -> Column:
        new = F.concat(a["out"], F.substring(text, a["at"] + 1, F.greatest(c["start"] - a["at"], F.lit(0))), F.when(c["start"] >= a["at"], F.concat(F.lit("["), F.element_at(names, c["kind"] + 1), F.lit("]"))).otherwise(""))
        return F.struct(new.alias("out"), F.greatest(a["at"], c["end"]).alias("at"))

    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    end = lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text)))
    return docs.select(id_col, text_col).join(found.select(id_col, spans.alias("__spans")), id_col).select(id_col, F.aggregate("__spans", begin, put, end).alias(text_col))
