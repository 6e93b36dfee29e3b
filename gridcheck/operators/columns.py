"""Projections, row filters and checks of single columns.

The checks run on the long form of a table, one row per (row, column):
``melt`` reads the table once for all columns, and every check is a predicate
on ``value``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridcheck.functions.scalar import SPACE, is_blank, visible_space, wrap_uint
from gridcheck.violations import violations

INTEGER = r"^[+-]?[0-9]+$"
STORED_BOOLEAN = r"^-?[0-9]+$"
FLOAT = r"^[+-]?(?:[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def melt(df: DataFrame, key: Column, cols: Sequence[str]) -> DataFrame:
    """``row_key``, ``col``, ``value`` of the columns, as text; absent (null) cells are left out."""
    wide = df.select(key.alias("row_key"), *(F.col(c).cast("string").alias(c) for c in cols))
    return wide.unpivot(["row_key"], list(cols), "col", "value").filter(F.col("value").isNotNull())


def drop_comment_rows(df: DataFrame, first_col: str) -> DataFrame:
    """Without rows whose first cell, left-trimmed, starts with '*'."""
    return df.filter(~F.coalesce(F.ltrim(F.col(first_col).cast("string")).startswith("*"), F.lit(False)))


def active_rows(df: DataFrame, col: str, trim: bool = True) -> DataFrame:
    """Rows that an enable column turns on: all without the column; not if it is blank or 0."""
    if col not in df.columns:
        return df
    v = F.col(col).cast("string")
    v = F.trim(v) if trim else v
    return df.filter(F.coalesce((v != "") & (v != "0"), F.lit(False)))


def column_values(df: DataFrame, col: str, first_col: str | None = None) -> DataFrame:
    """All non-blank values of a column, comment rows excluded."""
    rows = drop_comment_rows(df, first_col) if first_col else df
    return rows.select(F.col(col).cast("string").alias("value")).filter(~is_blank(F.col("value")))


def filtered_column_values(df: DataFrame, a: str, b: str, v: str) -> DataFrame:
    """Values of ``a`` in rows where ``b`` is exactly ``v``."""
    return df.filter(F.col(b).cast("string") == v).select(F.col(a).cast("string").alias("value"))


def expand_numbered(columns: Sequence[str], pattern: str) -> list[str]:
    """``name#`` as name1, name2, ... until the first that is absent (any case)."""
    have, out, k = {c.lower(): c for c in columns}, [], 1
    while (name := pattern.replace("#", str(k)).lower()) in have:
        out.append(have[name])
        k += 1
    return out


def slots(df: DataFrame, key: Column, families: Mapping[str, str | Sequence[str]], n: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """One row per slot: ``row_key``, ``slot`` and a text column per family.

    A family is a pattern with '#' or a list of columns.  Columns that are
    absent give null.  There are as many slots as the first family has columns,
    or ``n``.
    """
    named = {f: ([p.replace("#", str(k + 1)) for k in range(n)] if n else expand_numbered(df.columns, p)) if isinstance(p, str) else list(p) for f, p in families.items()}
    have = {c.lower(): c for c in df.columns}
    count = n or len(next(iter(named.values())))
    cell = lambda f, k: F.col(have[named[f][k].lower()]).cast("string") if k < len(named[f]) and named[f][k].lower() in have else F.lit(None).cast("string")
    structs = [F.struct(F.lit(k + 1).alias("slot"), *(cell(f, k).alias(f) for f in named)) for k in range(count)]
    return df.select(key.alias("row_key"), *keep, F.explode(F.array(*structs)).alias("s")).select("row_key", *keep, "s.*")


def prefix_gate(rows: DataFrame, selector: str, allowed: Column, also: Column | None = None) -> DataFrame:
    """Slots whose own and all earlier selectors are allowed (and ``also`` holds for the slot)."""
    before = Window.partitionBy("row_key").orderBy("slot").rowsBetween(Window.unboundedPreceding, 0)
    gated = rows.withColumn("__open", F.min(F.coalesce(allowed, F.lit(False)).cast("int")).over(before)).filter("__open = 1").drop("__open")
    return gated.filter(also) if also is not None else gated


def selector_allowed(selector: str) -> Column:
    """Selectors 1 to 25, or 36."""
    n = F.col(selector).try_cast("int")
    return n.between(1, 25) | (n == 36)


def display_context(df: DataFrame, key: Column, cols: Sequence[str]) -> DataFrame:
    """``row_key`` and the row's first non-blank cell, trimmed."""
    cells = F.array(*(F.trim(F.col(c).cast("string")) for c in cols))
    return df.select(key.alias("row_key"), F.get(F.filter(cells, lambda x: x.isNotNull() & (x != "")), F.lit(0)).alias("display"))


# checks on the long form: what they return is the condition of a violation


def not_integer(v: Column) -> Column:
    return (v != "") & ~(v.rlike(INTEGER) & v.try_cast("bigint").isNotNull())


def not_float(v: Column) -> Column:
    return (v != "") & ~v.rlike(FLOAT)


def not_boolean(v: Column) -> Column:
    return ~is_blank(v) & ~v.isin("0", "1")


def not_stored_boolean(v: Column) -> Column:
    """Filled, but no decimal of any length; a plus sign is not read."""
    return ~is_blank(v) & ~v.rlike(STORED_BOOLEAN)


def stored_boolean(v: Column, kind: str = "general") -> Column:
    """What a stored boolean means: any bit ('general'), or any bit of the low byte ('stored'); null if it is none."""
    return F.when(v.rlike(STORED_BOOLEAN), wrap_uint(v, 32 if kind == "general" else 8) != 0)


def not_uint(v: Column, bits: int) -> Column:
    """A decimal outside 0 to 2 ** bits - 1 (what is no decimal is left to other checks)."""
    top = str((1 << bits) - 1)
    digits = F.regexp_replace(F.regexp_replace(v, r"^[+-]", ""), r"^0+(?=.)", "")
    large = (F.length(digits) > len(top)) | ((F.length(digits) == len(top)) & (digits > top))
    return v.rlike(INTEGER) & (large | (v.startswith("-") & (digits != "0")))


def too_many_bytes(v: Column, n: int) -> Column:
    return F.octet_length(v) >= n


def too_many_chars(v: Column, n: int = 255) -> Column:
    return F.length(v) > n


#: name: (condition, message key)
CHECKS = {
    "int": (not_integer, "diag.integer.invalid"),
    "float": (not_float, "diag.float.invalid"),
    "boolean": (not_boolean, "diag.boolean.invalid"),
    "stored_boolean": (not_stored_boolean, "diag.stored_boolean.invalid"),
}


def check_columns(long: DataFrame, table: str, kinds: Mapping[str, str], severity: str = "warning") -> DataFrame:
    """Type violations of a melted table in one pass; ``kinds``: column -> name in CHECKS."""
    v, condition, code = F.col("value"), None, None
    for kind in dict.fromkeys(kinds.values()):
        mine = F.col("col").isin(*(c for c, k in kinds.items() if k == kind)) & CHECKS[kind][0](v)
        condition = mine if condition is None else condition | mine
        code = F.when(mine, CHECKS[kind][1]) if code is None else code.when(mine, CHECKS[kind][1])
    if condition is None:
        return violations(long.filter(F.lit(False)), table, "type", "type", severity)
    return violations(long.filter(condition).withColumn("__code", code), table, "type", F.col("__code"), severity, message_key=F.col("__code"))


def check_uint(long: DataFrame, table: str, cols: Sequence[str], bits: int) -> DataFrame:
    """Decimals out of range, with the value that is stored after the fold."""
    bad = long.filter(F.col("col").isin(*cols) & not_uint(F.col("value"), bits))
    return violations(bad, table, "uint", f"uint{bits}-range", args={"stored": wrap_uint(F.col("value"), bits)})


def check_max_bytes(long: DataFrame, table: str, cols: Sequence[str], n: int = 64) -> DataFrame:
    bad = long.filter(F.col("col").isin(*cols) & too_many_bytes(F.col("value"), n))
    return violations(bad, table, "max-bytes", "too-long", args={"bytes": F.octet_length("value"), "limit": F.lit(n)})


def check_max_chars(long: DataFrame, table: str, cols: Sequence[str], n: int = 255) -> DataFrame:
    bad = long.filter(F.col("col").isin(*cols) & too_many_chars(F.col("value"), n))
    return violations(bad, table, "max-chars", "too-long", args={"over": F.length("value") - n, "limit": F.lit(n)})


def check_code_range(df: DataFrame, table: str, key: Column, col: str, low: int = 0, high: int = 15, fallback: int = 1, labels: Sequence[str] = (), when: Column | None = None) -> DataFrame:
    """A code in [low, high]; else what takes effect: the value folded to a byte, or the fallback.

    Codes of violations: not-integer, negative, wraps-into-range, falls-back, and
    wraps-negative for a negative value that the fold brings into the range.
    """
    rows = df.filter(when) if when is not None else df
    long = rows.select(key.alias("row_key"), F.lit(col).alias("col"), F.col(col).cast("string").alias("value")).filter("value <> ''")
    fine, code, args = code_range(F.col("value"), low, high, fallback, labels)
    return violations(long.filter(~fine), table, "code-range", code, args=args)


def code_range(v: Column, low: int = 0, high: int = 15, fallback: int = 1, labels: Sequence[str] = ()) -> tuple[Column, Column, dict[str, Column]]:
    """Whether a filled code is in the range; else what is said of it, and what takes effect."""
    folded = wrap_uint(v, 8)
    effective = F.when(folded.between(low, high), folded).otherwise(fallback)
    digits = F.regexp_replace(F.regexp_replace(v, r"^\+", ""), r"^0+(?=.)", "")
    fine = v.rlike(r"^\+?[0-9]+$") & (F.length(digits) <= 4) & digits.try_cast("int").between(low, high)
    code = F.when(~v.rlike(INTEGER), "not-integer").when(v.startswith("-") & folded.between(low, high), "wraps-negative").when(v.startswith("-"), "negative").when(folded.between(low, high), "wraps-into-range").otherwise("falls-back")
    shown = F.when(v.rlike(INTEGER), effective).otherwise(fallback)
    args = {"effective": shown}
    if labels:
        args["label"] = F.get(F.array(*map(F.lit, labels)), shown.cast("int") - low)
    return fine, code, args


def with_whitespace_hint(df: DataFrame, col: str = "value") -> DataFrame:
    """How much white space leads and trails (all of a blank value does both), and the value with blanks and tabs made visible."""
    v = F.col(col)
    ends = {"leading": f"^[{SPACE}]+", "trailing": f"[{SPACE}]+\\z"}
    return df.withColumns({name: F.length(v) - F.length(F.regexp_replace(v, end, "")) for name, end in ends.items()} | {"visible": visible_space(v)})


def family_of(col: str) -> str:
    """A numbered column's family: its name with the number as '#'."""
    return re.sub(r"\d+$", "#", col)
