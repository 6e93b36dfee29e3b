"""Scalar functions on columns; all are built from Spark's own functions.

Three notions of case and of blank matter to the checks: exact, ASCII-only
lower case (references) and Unicode lower case (uniqueness); empty, white space
only, and absent (null).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.translate(c, UPPER, LOWER)


#: White space as Unicode has it, for the inside of a character class.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def is_blank(c: Column) -> Column:
    """Null, empty or white space only; what begins with one of ! to ~ is seen not to be by a comparison."""
    text = c.cast("string")
    return c.isNull() | ~(((text >= "!") & (text < "\x7f")) | text.rlike(f"[^{SPACE}]"))


def trimmed(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(F.regexp_replace(c, f"^[{SPACE}]+", ""), f"[{SPACE}]+\\z", "")


def fixed4_bytes(c: Column) -> Column:
    """The first four UTF-8 bytes, padded with blanks."""
    return F.rpad(F.encode(c, "UTF-8"), 4, F.unhex(F.lit("20")))


def fixed4_key(c: Column) -> Column:
    return F.lower(F.hex(fixed4_bytes(c)))


def fixed4_display(c: Column) -> Column:
    """The four bytes as text; a cut character shows as U+FFFD."""
    return F.make_valid_utf8(fixed4_bytes(c).cast("string"))


def utf16_len(c: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(c, "UTF-16LE")) / 2).cast("int")


def wrap_uint(c: Column, bits: int) -> Column:
    """A signed decimal of any length, folded modulo 2 ** bits; null for anything else."""
    modulus = 1 << bits
    digits = F.regexp_replace(c, "^[+-]", "")
    folded = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0).cast("long"), lambda a, i: (a * 10 + F.substring(digits, i, F.lit(1)).cast("long")) % modulus)
    signed = F.when(c.startswith("-") & (folded > 0), modulus - folded).otherwise(folded)
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), signed)


def strip_outer_quotes(c: Column, trim: bool = False) -> Column:
    """Without one pair of outer double quotes; ``trim`` trims before and after."""
    v = F.trim(c) if trim else c
    bare = F.when((F.length(v) >= 2) & v.startswith('"') & v.endswith('"'), F.substring(v, F.lit(2), F.length(v) - 2)).otherwise(v)
    return F.trim(bare) if trim else bare


#: What trims a string before it becomes a number: white space and line ends.
NUMBER_SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def text_number(c: Column) -> Column:
    """A string coerced to a number the loose way: '' is 0, 0x/0b/0o prefixes, Infinity; else NaN; null is 0."""
    v = F.regexp_replace(F.regexp_replace(c, f"^{NUMBER_SPACE}+", ""), f"{NUMBER_SPACE}+$", "")
    based = lambda base: F.conv(F.substring(v, F.lit(3), F.length(v)), base, 10).cast("double")
    return (
        F.when(c.isNull() | (v == ""), F.lit(0.0))
        .when(v.rlike(r"^0[xX][0-9a-fA-F]{1,16}$"), based(16))
        .when(v.rlike(r"^0[bB][01]{1,64}$"), based(2))
        .when(v.rlike(r"^0[oO][0-7]{1,21}$"), based(8))
        .when(v.rlike(r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"), v.try_cast("double"))
        .when(v.rlike(r"^\+?Infinity$"), F.lit(float("inf")))
        .when(v == "-Infinity", F.lit(float("-inf")))
        .otherwise(F.lit(float("nan")))
    )


def variant_number(v: Column) -> Column:
    """A JSON value (VARIANT) coerced to a number: null 0, booleans 0 or 1, strings as ``text_number``, [] 0, [x] as x, objects NaN."""
    kind = F.schema_of_variant(v)
    flat = variant_text(v)
    return (
        F.when(v.isNull() | F.is_variant_null(v), F.lit(0.0))
        .when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double"))
        .when(kind.startswith("OBJECT"), F.lit(float("nan")))
        .when(kind.startswith("ARRAY") | (kind == "STRING"), text_number(flat))
        .otherwise(F.try_variant_get(v, "$", "double"))
    )


def variant_text(v: Column) -> Column:
    """A JSON value as a string: strings bare, arrays joined by commas (nulls empty), objects '[object Object]'."""
    kind = F.schema_of_variant(v)
    one = lambda x: F.when(F.is_variant_null(x), "").when(F.schema_of_variant(x).startswith("OBJECT"), "[object Object]").otherwise(F.try_variant_get(x, "$", "string"))
    return (
        F.when(F.is_variant_null(v), F.lit("null"))
        .when(kind.startswith("OBJECT"), F.lit("[object Object]"))
        .when(kind.startswith("ARRAY"), F.array_join(F.transform(F.try_variant_get(v, "$", "array<variant>"), one), ","))
        .otherwise(F.try_variant_get(v, "$", "string"))
    )


def format_description(c: Column) -> Column:
    """Line-break tags become blank lines; ``$!file#field!$`` becomes a bold mention."""
    v = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n\n")
    v = F.regexp_replace(v, r"\$!([^#!]+)#([^!]+)!\$", "**$2** ($1)")
    return F.regexp_replace(v, r"\$!([^#!]+)!\$", "**$1**")


def html_to_text(c: Column) -> Column:
    """List items become bullets, other tags go, ends are trimmed."""
    v = F.regexp_replace(c, r"(?i)<li[^>]*>", "\n- ")
    return F.trim(F.regexp_replace(v, r"<[^>]*>", ""))


def format_percent(x: Column) -> Column:
    """A share as a percentage: four decimals, trailing zeros gone."""
    return F.concat(F.regexp_replace(F.format_string("%.4f", x * 100), r"\.?0+$", ""), F.lit("%"))


def int_prefix(c: Column) -> Column:
    """The integer a string starts with, after white space; null if none."""
    return F.regexp_extract(c, r"^\s*([+-]?\d+)", 1).try_cast("long")


def path_stem(c: Column) -> Column:
    """Lower-case file name without its last extension."""
    name = F.regexp_extract(c, r"([^/\\]*)$", 1)
    return F.lower(F.when(F.instr(name, ".") > 1, F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name))


def path_ext(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/\\.][^/\\]*\.([^./\\]*)$", 1)


def path_parent(c: Column) -> Column:
    return F.regexp_extract(c, r"^(.*)[/\\][^/\\]*$", 1)


#: How a blank and a tab are shown.
BLANK_MARK, TAB_MARK = "␠", "⇥"


def visible_space(c: Column) -> Column:
    """Blanks and tabs made visible."""
    return F.translate(c, " \t", BLANK_MARK + TAB_MARK)


def catalog_placeholders(c: Column) -> Column:
    """The distinct ``{name}`` placeholders of a template, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)\}"), F.lit(1))))
