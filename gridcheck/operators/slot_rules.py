"""Checks on numbered slots of a row (item 1, weight 1, item 2, ...).

They take the slot form that ``columns.slots`` makes, with all slots of a row,
empty ones too, and look at a row's slots in order.  Slots are regrouped into
one array per row, so that each rule is an expression on that array.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcheck.functions.scalar import int_prefix, strip_outer_quotes, wrap_uint
from gridcheck.operators.columns import INTEGER
from gridcheck.violations import violations


def slot_array(rows: DataFrame, key: Column, items: Sequence[str], weights: Sequence[str] = (), keep: Sequence[str] = ()) -> DataFrame:
    """``row_key`` and ``s``: an array of (slot, item, weight), straight from the wide row, no shuffle."""
    have = set(rows.columns)
    cell = lambda names, k: F.col(names[k]).cast("string") if k < len(names) and names[k] in have else F.lit(None).cast("string")
    structs = [F.struct(F.lit(k + 1).alias("slot"), cell(items, k).alias("item"), cell(weights, k).alias("weight")) for k in range(len(items))]
    return rows.select(key.alias("row_key"), *keep, F.array(*structs).alias("s"))


def _empty(x: Column) -> Column:
    return x["item"].isNull() | (strip_outer_quotes(x["item"]) == "")


def filled(v: Column) -> Column:
    return v.isNotNull() & (v != "")


def first_gap(s: Column) -> Column:
    """The slot of the first empty item; null if all are filled."""
    return F.array_min(F.transform(F.filter(s, _empty), lambda x: x["slot"]))


def check_first_gap(arrays: DataFrame, table: str) -> DataFrame:
    """After the first empty item: items and weights (``after-first-gap``); its own weight (``orphaned``).

    An absent item column (null) ends the list too, but its weight is not reported.
    """
    rows = arrays.withColumn("__gap", first_gap(F.col("s"))).filter("__gap IS NOT NULL").select("row_key", "__gap", F.explode("s").alias("x"))
    both = F.array(F.struct(F.lit("item").alias("part"), F.col("x.item").alias("value")), F.struct(F.lit("weight").alias("part"), F.col("x.weight").alias("value")))
    cells = rows.select("row_key", "__gap", F.col("x.slot").alias("slot"), F.col("x.item").isNull().alias("__absent"), F.explode(both).alias("c")).select("*", "c.*").filter(filled(F.col("value")))
    after = F.col("slot") > F.col("__gap")
    own = (F.col("slot") == F.col("__gap")) & (F.col("part") == "weight") & ~F.col("__absent")
    found = cells.filter(after | own)
    return violations(found, table, "first-gap", F.when(after, "after-first-gap").otherwise("orphaned"), col=F.concat("part", F.col("slot").cast("string")), args={"gap": F.col("__gap")})


def check_weight(arrays: DataFrame, table: str, resolved: DataFrame | None = None) -> DataFrame:
    """Weights of slots before the gap: blank, no integer, or not positive.

    With ``resolved`` (row_key, slot) only slots whose item resolved are
    checked; slots without a weight column have nothing to check.
    """
    rows = arrays.withColumn("__gap", F.coalesce(first_gap(F.col("s")), F.lit(1 << 30))).select("row_key", "__gap", F.explode("s").alias("x")).select("row_key", "__gap", "x.*").filter((F.col("slot") < F.col("__gap")) & F.col("weight").isNotNull())
    if resolved is not None:
        rows = rows.join(resolved, ["row_key", "slot"], "left_semi")
    found = rows.withColumn("__code", weight_code(F.col("weight"))).filter("__code IS NOT NULL")
    return violations(found, table, "weight", F.col("__code"), col=F.concat(F.lit("weight"), F.col("slot").cast("string")), value=F.col("weight"))


def weight_code(weight: Column) -> Column:
    """What is wrong with a weight; null if nothing."""
    v = strip_outer_quotes(weight)
    return F.when(F.trim(v) == "", "blank-omission").when(~v.rlike(INTEGER), "noncanonical").when(v.rlike(r"^(?:-[0-9]+|[+-]?0+)$"), "nonpositive-omission")


def declared_count(s: Column, declared: Column) -> tuple[Column, Column, Column]:
    """What is wrong with a declared number (null: nothing), the number, and the sum over filled slots."""
    n = F.trim(declared)
    quantity = lambda x: F.coalesce(F.when(wrap_uint(x["weight"], 8) > 0, wrap_uint(x["weight"], 8)), F.lit(1).cast("long"))
    actual = F.aggregate(F.filter(s, lambda x: ~_empty(x)), F.lit(0).cast("long"), lambda a, x: a + quantity(x))
    code = F.when(n.isNull() | (n == "") | (n == "0"), "no-inputs").when(~n.rlike("^[0-9]+$"), "invalid-numinputs").when(n.try_cast("long") != actual, "count-mismatch")
    return code, n, actual


def check_declared_count(arrays: DataFrame, table: str, n_col: str) -> DataFrame:
    """A declared number against the sum over filled slots of their quantity (a byte; absent or 0 is 1)."""
    code, n, actual = declared_count(F.col("s"), F.col(n_col).cast("string"))
    rows = arrays.withColumn("__n", n).withColumn("__actual", actual)
    found = rows.withColumn("__code", code).filter("__code IS NOT NULL")
    return violations(found, table, "declared-count", F.col("__code"), col=n_col, value=F.col("__n"), args={"expected": F.coalesce("__n", F.lit("")), "actual": F.col("__actual")})


def slot_probability(arrays: DataFrame, no_drop: Column, picks: Column) -> DataFrame:
    """Per slot: its weight over ``total``, and the chance of at least one hit in all picks.

    Slots count up to the first blank item or absent weight column; ``total``
    is the positive weights and a positive ``no_drop``.  Blank picks are 1.
    """
    number = lambda c: F.coalesce(int_prefix(c), F.lit(0).cast("long"))
    gap = F.coalesce(F.array_min(F.transform(F.filter("s", lambda x: _empty(x) | x["weight"].isNull()), lambda x: x["slot"])), F.lit(1 << 30))
    rows = arrays.withColumn("__gap", gap).withColumn("__live", F.filter("s", lambda x: (x["slot"] < F.col("__gap")) & (number(x["weight"]) > 0)))
    total = F.greatest(number(no_drop.cast("string")), F.lit(0).cast("long")) + F.aggregate("__live", F.lit(0).cast("long"), lambda a, x: a + number(x["weight"]))
    times = F.when(F.coalesce(F.trim(picks.cast("string")), F.lit("")) == "", F.lit(1).cast("long")).otherwise(number(picks.cast("string")))
    rows = rows.withColumn("total", total).withColumn("picks", times).filter("picks > 0").select("row_key", "total", "picks", F.explode("__live").alias("x"))
    per_roll = number(F.col("x.weight")) / F.col("total")
    return rows.select("row_key", F.col("x.slot").alias("slot"), "total", per_roll.alias("per_roll"), (1 - F.pow(1 - per_roll, F.col("picks"))).alias("at_least_once"))


def check_ordinal_dependency(arrays: DataFrame, table: str, inputs: Sequence[str], keywords: Sequence[str]) -> DataFrame:
    """Slot k with one of the keywords needs input column k to be filled (``arrays`` keeps the inputs)."""
    filled = F.array(*(F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) for c in inputs))
    rows = arrays.withColumn("__filled", filled).select("row_key", "__filled", F.explode("s").alias("x")).select("row_key", "__filled", "x.*")
    found = rows.filter(F.lower("item").isin(*(k.lower() for k in keywords)) & ~F.coalesce(F.get("__filled", F.col("slot") - 1), F.lit(False)))
    return violations(found, table, "ordinal-dependency", "missing-input", col=F.concat(F.lit("slot"), F.col("slot").cast("string")), value=F.col("item"))
