"""Mini-lists in a cell (``base,modifier,...``), as arrays of tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcheck.functions.scalar import ascii_lower, is_blank, strip_outer_quotes
from gridcheck.violations import violations

# lists


def split_modifiers(df: DataFrame, key: Column, col: str) -> DataFrame:
    """One row per token: ``row_key``, ``pos`` (0 is the base), ``token``; ``value`` is the whole cell.

    One pair of outer quotes goes; commas split exactly, nothing is trimmed.
    """
    value = F.col(col).cast("string")
    cells = df.filter(~is_blank(value)).select(key.alias("row_key"), value.alias("value"))
    return cells.select("row_key", "value", F.posexplode(F.split(strip_outer_quotes(F.col("value")), ",", -1)).alias("pos", "token"))


def token_arrays(df: DataFrame, key: Column, col: str) -> DataFrame:
    """As ``split_modifiers``, with all tokens of a cell in the array ``tokens``."""
    value = F.col(col).cast("string")
    return df.filter(~is_blank(value)).select(key.alias("row_key"), value.alias("value"), F.split(strip_outer_quotes(value), ",", -1).alias("tokens"))


def base_of(tokens: Column) -> Column:
    """The base: the first token, or the second behind ``qty=n``."""
    first = F.get(tokens, F.lit(0))
    return F.when(ascii_lower(first).startswith("qty=") & (F.size(tokens) > 1), F.get(tokens, F.lit(1))).otherwise(first)


def first_unknown(tokens: Column, flags: Sequence[str], assignments: Sequence[str] = (), pairs: Sequence[str] = ()) -> Column:
    """The place of the first token behind the base that is no modifier; null if all are."""
    low = lambda t: ascii_lower(F.trim(t))
    is_flag = lambda t: low(t).isin(*(f.lower() for f in flags)) if flags else F.lit(False)
    is_assign = lambda t: t.contains("=") & low(F.substring_index(t, "=", 1)).isin(*(a.lower() for a in assignments)) if assignments else F.lit(False)
    is_pair = lambda t: low(t).isin(*(p.lower() for p in pairs)) if pairs else F.lit(False)
    base = F.when(low(F.get(tokens, F.lit(0))).startswith("qty="), 1).otherwise(0)

    def known(i: Column) -> Column:
        t = F.get(tokens, i)
        return is_flag(t) | is_assign(t) | (is_pair(t) & (F.size(tokens) > i + 1)) | ((i - 1 > base) & is_pair(F.get(tokens, i - 1)))

    rest = F.when(F.size(tokens) > base + 1, F.sequence(base + 1, F.size(tokens) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_min(F.filter(rest, lambda i: ~F.coalesce(known(i), F.lit(False))))


def check_modifiers(arrays: DataFrame, table: str, flags: Sequence[str], assignments: Sequence[str] = (), pairs: Sequence[str] = (), col: str = "list") -> DataFrame:
    """Tokens behind the base: the first that is not recognised starts what is ignored.

    ``flags`` stand alone, ``assignments`` are ``key=value``, ``pairs`` are
    ``key,value`` and take the next token along.  ``qty=n`` may precede the
    base.  One violation per cell, with ``stopped_at``.
    """
    rows = arrays.withColumn("__stop", first_unknown(F.col("tokens"), flags, assignments, pairs))
    found = rows.filter("__stop IS NOT NULL")
    return violations(found, table, "modifiers", "ignored-suffix", col=col, args={"stopped_at": F.get("tokens", F.col("__stop")), "position": F.col("__stop")})


def check_base(arrays: DataFrame, table: str, keys: DataFrame | None, normal=ascii_lower, col: str = "list") -> tuple[DataFrame, DataFrame]:
    """Violations of bases that are empty or unresolved, and the arrays that are to be checked further.

    Without targets (None) nothing is reported and all cells stay.
    """
    if keys is None:
        return violations(arrays.filter(F.lit(False)), table, "base", "unresolved-base", col=col), arrays
    rows = arrays.withColumn("__base", base_of(F.col("tokens"))).withColumn("__key", normal(F.col("__base")))
    there = rows.select("__key").distinct().join(keys, F.col("__key") == F.col("key"), "left_semi").withColumn("__there", F.lit(True))
    rows = rows.join(there, "__key", "left")
    bad = rows.filter(F.col("__there").isNull())
    found = violations(bad, table, "base", F.when(F.col("__base") == "", "empty-base").otherwise("unresolved-base"), "error", col=col, args={"base": F.col("__base")})
    return found, rows.filter("__there").select(*arrays.columns)
