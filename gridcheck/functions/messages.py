"""Messages: templates with ``{name}`` in several locales, and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcheck.functions.scalar import catalog_placeholders


def locale_id(c: Column) -> Column:
    """Locale names compare without case, '-' and '_' alike."""
    return F.replace(F.lower(c), F.lit("_"), F.lit("-"))


def render_messages(found: DataFrame, catalog: DataFrame, locale: str, fallback: str = "en") -> DataFrame:
    """``found`` with ``message``: the template of its key, filled with its args.

    ``catalog`` has locale, key and template.  A key the locale lacks, and a
    locale nobody has, fall back to ``fallback``; a key nobody has is shown.
    """
    named = catalog.select(locale_id(F.col("locale")).alias("l"), F.col("key").alias("message_key"), "template")
    own = named.filter(F.col("l") == locale.lower().replace("_", "-")).groupBy("message_key").agg(F.min("template").alias("__own"))
    base = named.filter(F.col("l") == fallback).groupBy("message_key").agg(F.min("template").alias("__base"))
    template = F.coalesce("__own", "__base", "message_key")
    filled = F.aggregate(F.coalesce(F.map_entries("args"), F.array().cast("array<struct<key:string,value:string>>")), template, lambda t, e: F.replace(t, F.concat(F.lit("{"), e["key"], F.lit("}")), F.coalesce(e["value"], F.lit(""))))
    return found.join(own, "message_key", "left").join(base, "message_key", "left").withColumn("message", filled).drop("__own", "__base")


def check_catalog_parity(catalog: DataFrame, base: str = "en") -> DataFrame:
    """Differences from the base locale: missing and extra keys, other placeholders."""
    rows = catalog.select(locale_id(F.col("locale")).alias("locale"), "key", catalog_placeholders(F.col("template")).alias("names"))
    main = rows.filter(F.col("locale") == base).select("key", F.col("names").alias("base_names"))
    others = rows.filter(F.col("locale") != base)
    every = others.select("locale").distinct().join(main, F.lit(True))
    missing = every.join(others.select("locale", "key"), ["locale", "key"], "left_anti").select("locale", "key", F.lit("missing-key").alias("code"))
    extra = others.join(main, "key", "left_anti").select("locale", "key", F.lit("extra-key").alias("code"))
    differ = others.join(main, "key").filter(F.col("names") != F.col("base_names")).select("locale", "key", F.lit("placeholders").alias("code"))
    return missing.unionByName(extra).unionByName(differ)
