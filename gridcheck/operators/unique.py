"""Uniqueness, and loading records that must be unique by two keys at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcheck.functions.scalar import is_blank
from gridcheck.storage import written
from gridcheck.violations import violations


def check_unique(df: DataFrame, table: str, cols: Sequence[str], order: str, key: Column, severity: str = "error", scope: Column | None = None) -> DataFrame:
    """Every occurrence of a value after the first, with the first's key and place; within a scope, if there is one.

    Values are compared in Unicode lower case, untrimmed; blanks are ignored.
    Keys that occur twice are found by one aggregation; only their rows are
    read again, no unique key is sorted.  Values of more than 64 bytes are sent
    and compared as their SHA-256.
    """
    where = F.coalesce(scope.cast("string"), F.lit("")) if scope is not None else F.lit("")
    wide = df.select(key.alias("row_key"), F.col(order).alias("__order"), where.alias("__scope"), *(F.col(c).cast("string").alias(c) for c in cols))
    low = F.lower("value")
    short = F.when(F.octet_length(low) <= 64, low).otherwise(F.concat(F.lit("\0"), F.sha2(low, 256)))
    long = wide.unpivot(["row_key", "__order", "__scope"], list(cols), "col", "value").filter(~is_blank(F.col("value"))).withColumn("__key", short)
    by = ["col", "__scope", "__key"]
    repeated = long.groupBy(*by).agg(F.min_by(F.struct("__order", "row_key"), F.struct("__order", "row_key")).alias("__first"), F.count("*").alias("__n")).filter("__n > 1")
    later = long.join(repeated, by).filter(F.struct("__order", "row_key") != F.col("__first"))
    return violations(later, table, "unique", "duplicate", severity, args={"first": F.col("__first.row_key"), "first_line": F.col("__first.__order")})


def check_unique_key(df: DataFrame, table: str, cols: Sequence[str], severity: str = "error") -> DataFrame:
    """Composite keys that several rows have, one violation per key with its count."""
    text = F.concat_ws("|", *(F.col(c).cast("string") for c in cols))
    many = df.groupBy(*cols).agg(F.count("*").alias("n")).filter("n > 1")
    return violations(many.withColumn("row_key", text), table, "unique-key", "duplicate", severity, col=",".join(cols), value=text, args={"count": F.col("n")})


def distinct_values(tables: dict[str, DataFrame]) -> DataFrame:
    """Distinct ASCII-lower-cased non-blank values of every column of every table."""
    from functools import reduce

    from gridcheck.functions.scalar import ascii_lower

    parts = []
    for name, df in tables.items():
        long = df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)).unpivot([], df.columns, "col", "value")
        parts.append(long.filter(~is_blank(F.col("value"))).select(F.lit(name).alias("table"), "col", ascii_lower(F.col("value")).alias("value")))
    return reduce(DataFrame.unionByName, parts).distinct()


def identity(df: DataFrame, col: str) -> Column:
    """What makes two values of a column the same, as text; null for what equals nothing.

    A JSON value (VARIANT) keeps its type: 1 is not "1", 1 is 1.0, 0 is -0, null
    equals null, arrays and objects equal nothing, not even themselves.  Numbers
    are compared as doubles.  Other columns are compared as text.
    """
    v = F.col(col)
    if dict(df.dtypes)[col] != "variant":
        return v.cast("string")
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return (
        F.when(v.isNull() | kind.startswith("ARRAY") | kind.startswith("OBJECT"), F.lit(None).cast("string")).when(F.is_variant_null(v), "null")
        .when(kind == "BOOLEAN", F.concat(F.lit("b:"), F.try_variant_get(v, "$", "string"))).when(kind == "STRING", F.concat(F.lit("s:"), F.try_variant_get(v, "$", "string")))
        .otherwise(F.concat(F.lit("n:"), F.when(number == 0, F.lit(0.0)).otherwise(number).cast("string")))
    )


def load_duplicates(records: DataFrame, id_col: str, key_col: str, order: Sequence[str], file_col: str | None = None) -> DataFrame:
    """Records in order, each loaded unless its id, else its key, is already loaded.

    Returns ``records`` with ``outcome``: loaded, duplicate-id or duplicate-key
    (with ``-cross-file`` if the loaded record is of another file).  Ids and keys
    may be JSON values (see ``identity``).  What is
    rejected registers nothing, so a record rejected for its key does not block
    a later one with its id.  Empty keys and null ids or keys are not
    registered and reject nothing.

    In rounds of joins, whatever the size of connected groups: a record that is
    the first undecided one of both its id and its key loads, those that meet
    what is loaded are rejected, until none is undecided.
    """
    from functools import reduce

    name = F.coalesce(F.col(file_col).cast("string"), F.lit("")) if file_col else F.lit("")
    place = F.struct(*(c for o in order for c in (F.col(o).isNull().alias(f"{o}_null"), F.col(o))), F.monotonically_increasing_id().alias("row"))
    own_key = identity(records, key_col)
    empty = "s:" if dict(records.dtypes)[key_col] == "variant" else ""
    given = records.select("*", identity(records, id_col).alias("__id"), F.when(own_key != empty, own_key).alias("__key"), name.alias("__file"), place.alias("__place"))
    kept = [c for c, t in records.dtypes if t != "variant"]
    # JSON values can't be written as they are: as text, and parsed again
    as_text = [F.to_json(c).alias(c) for c, t in records.dtypes if t == "variant"]
    rows = written(given.select(*kept, *as_text, "__id", "__key", "__file", "__place"), "records")
    undecided, rounds = rows.select("__id", "__key", "__file", "__place"), []
    while True:
        ids = undecided.filter("__id IS NOT NULL").groupBy("__id").agg(F.min("__place").alias("__first_id"))
        keys = undecided.filter("__key IS NOT NULL").groupBy("__key").agg(F.min("__place").alias("__first_key"))
        first = (F.coalesce("__first_id", "__place") == F.col("__place")) & (F.coalesce("__first_key", "__place") == F.col("__place"))
        step = written(undecided.join(ids, "__id", "left").join(keys, "__key", "left").select("__id", "__key", "__file", "__place", first.alias("__loads")), "step")
        won = step.filter("__loads").drop("__loads")
        rounds.append(won)
        undecided = written(step.filter("NOT __loads").drop("__loads").join(won.select("__id"), "__id", "left_anti").join(won.select("__key"), "__key", "left_anti"), "undecided")
        if not undecided.limit(1).count():
            break
    loaded = written(reduce(DataFrame.unionByName, rounds), "loaded")
    # an id or a key is loaded once; a record that came later meets the id first
    of_id = loaded.filter("__id IS NOT NULL").select("__id", F.col("__place").alias("__id_place"), F.col("__file").alias("__id_file"))
    of_key = loaded.filter("__key IS NOT NULL").select("__key", F.col("__file").alias("__key_file"))
    done = rows.join(loaded.select("__place", F.lit(True).alias("__loads")), "__place", "left").join(of_id, "__id", "left").join(of_key, "__key", "left")
    said = lambda kind, file: F.when(F.col(file) == F.col("__file"), kind).otherwise(f"{kind}-cross-file")
    outcome = F.when(F.col("__loads"), "loaded").when(F.col("__id_place") < F.col("__place"), said("duplicate-id", "__id_file")).otherwise(said("duplicate-key", "__key_file"))
    back = [F.parse_json(c).alias(c) if t == "variant" else F.col(c) for c, t in records.dtypes]
    return done.select(*back, outcome.alias("outcome"))
