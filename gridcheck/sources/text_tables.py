"""Delimited text tables: finding files, decoding, cells with line and column."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridcheck.functions.scalar import ascii_lower, path_ext, path_parent, path_stem, utf16_len
from gridcheck.operators.ordered import folded

TABLE_EXTENSIONS = ("txt", "tsv", "tbl", "csv")
#: Windows-1252 differs from Latin-1 in 0x80 to 0x9F: fixed values, undefined ones stay as they are.
LATIN1_SPECIALS = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_SPECIALS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"

#: Cells whose lengths are summed together.
SUMMED = 128


def discover(spark: SparkSession, root: str, exts: Sequence[str] = TABLE_EXTENSIONS, recursive: bool = True, ignore_case: bool = True) -> DataFrame:
    """``path``, ``stem``, ``ext``, ``bytes`` of the files with one of the extensions; their content is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root)
    rows = files.select("path", path_stem(F.col("path")).alias("stem"), path_ext(F.col("path")).alias("ext"), F.col("length").alias("bytes"))
    ext = F.lower("ext") if ignore_case else F.col("ext")
    return rows.filter(ext.isin(*(e.lower() if ignore_case else e for e in exts)))


def cp1252(content: Column) -> Column:
    return F.translate(F.decode(content, "ISO-8859-1"), LATIN1_SPECIALS, CP1252_SPECIALS)


def decode_text(df: DataFrame, encoding: str = "auto", content_col: str = "content") -> DataFrame:
    """``df`` with ``text``, ``detected_encoding`` and ``decode_error``.

    utf-8 is lossy and drops a mark; latin-1 maps bytes to code points; utf-16
    takes the order of its mark, else the declared one, and an odd length is an
    error.  auto: by the mark, else UTF-8 if valid, else Windows-1252.
    """
    b = F.col(content_col)
    head = F.upper(F.hex(F.substring(b, 1, 3)))
    le, be, u8 = head.startswith("FFFE"), head.startswith("FEFF"), head == "EFBBBF"
    after = lambda n: F.substring(b, F.lit(n + 1), F.octet_length(b))
    odd = F.octet_length(b) % 2 == 1
    text16 = lambda body, name: F.when(~odd, F.decode(body, name))
    as_text = lambda body: body.cast("string")
    if encoding == "auto":
        valid = F.is_valid_utf8(as_text(b))
        kind = F.when(le, "utf-16-le").when(be, "utf-16-be").when(u8, "utf-8-bom").when(valid, "utf-8").otherwise("windows-1252")
        text = (
            F.when(le, text16(after(2), "UTF-16LE")).when(be, text16(after(2), "UTF-16BE"))
            .when(u8, F.when(F.is_valid_utf8(as_text(after(3))), as_text(after(3)))).when(valid, as_text(b)).otherwise(cp1252(b))
        )
        error = F.when((le | be) & odd, "odd length").when(u8 & ~F.is_valid_utf8(as_text(after(3))), "invalid UTF-8")
    elif encoding == "utf-8":
        kind, text, error = F.lit("utf-8"), F.make_valid_utf8(as_text(F.when(u8, after(3)).otherwise(b))), F.lit(None).cast("string")
    elif encoding == "latin-1":
        kind, text, error = F.lit("latin-1"), F.decode(b, "ISO-8859-1"), F.lit(None).cast("string")
    elif encoding in ("utf-16-le", "utf-16-be"):
        default = "UTF-16LE" if encoding.endswith("le") else "UTF-16BE"
        kind = F.when(le, "utf-16-le").when(be, "utf-16-be").otherwise(encoding)
        text = F.when(le, text16(after(2), "UTF-16LE")).when(be, text16(after(2), "UTF-16BE")).otherwise(text16(b, default))
        error = F.when(odd, "odd length")
    else:
        raise ValueError(f"unknown encoding: {encoding}")
    return df.withColumns({"text": text, "detected_encoding": kind, "decode_error": error})


def text_lines(files: DataFrame, text_col: str = "text") -> DataFrame:
    """One row per line of each file's text: the other columns, ``line`` (from 0) and ``content``."""
    kept = [c for c in files.columns if c != text_col]
    unified = F.regexp_replace(F.col(text_col), r"\r\n?", "\n")
    return files.select(*kept, F.posexplode(F.split(unified, "\n", -1)).alias("line", "content"))


def cells_of(lines: DataFrame, delimiter: str = "\t", file_cols: Sequence[str] = ("path",)) -> DataFrame:
    """Cells of the lines: ``col_idx``, ``col_name`` (null beyond the header), ``col_start`` in UTF-16 units, ``value``.

    Line 0 is the header and not returned; a plain split, no quoting; empty
    trailing fields stay; a blank line is one empty cell; rows may be ragged.
    A last line feed does not start one more row.
    """
    parts = F.split(F.col("content"), f"\\Q{delimiter}\\E", -1)
    rows = lines.select(*file_cols, "line", parts.alias("cells"))
    header = rows.filter("line = 0").select(*(F.col(c).alias(f"__{c}") for c in file_cols), F.col("cells").alias("header"))
    on = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in file_cols]
    rows = rows.filter("line > 0").join(header, on).drop(*(f"__{c}" for c in file_cols))
    # a cell starts after those before it: sums of ``SUMMED`` cells, and within these
    total = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + y)
    part = lambda i: F.floor(i / SUMMED).cast("int")
    rows = rows.withColumn("lengths", F.transform("cells", lambda y: utf16_len(y) + utf16_len(F.lit(delimiter))))
    rows = rows.withColumn("sums", F.transform(F.sequence(F.lit(0), part(F.size("lengths"))), lambda k: total(F.slice("lengths", k * SUMMED + 1, F.lit(SUMMED)))))
    rows = rows.withColumn("sums", F.transform("sums", lambda _, k: total(F.slice("sums", F.lit(1), k))))
    starts = F.transform("lengths", lambda _, i: F.get("sums", part(i)) + total(F.slice("lengths", part(i) * SUMMED + 1, i % SUMMED)))
    rows = rows.withColumn("starts", starts).select(*file_cols, "line", "header", F.posexplode(F.arrays_zip(F.col("cells").alias("value"), F.col("starts").alias("start"))).alias("col_idx", "c"))
    return rows.select(*file_cols, "line", "col_idx", F.get("header", F.col("col_idx")).alias("col_name"), F.col("c.start").alias("col_start"), F.col("c.value").alias("value"))


def read_delimited(spark: SparkSession, path: str, delimiter: str = "\t", encoding: str = "auto") -> DataFrame:
    """Cells of all files at ``path``, each decoded as a whole (for files that fit a task)."""
    files = decode_text(spark.read.format("binaryFile").load(path).select("path", "content"), encoding).filter("decode_error IS NULL").select("path", F.regexp_replace("text", r"(\r\n|\r|\n)\z", "").alias("text"))
    return cells_of(text_lines(files), delimiter)


def read_delimited_large(spark: SparkSession, path: str, delimiter: str = "\t") -> DataFrame:
    """Cells of UTF-8 files of any size, cut into splits.

    Each line knows its place within its split; the lines of all splits are
    counted, a file's splits (few) are summed up in order, and the sums give
    the line numbers.
    """
    lines = spark.read.text(path).select(F.regexp_replace("value", "\r$", "").alias("content"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("__at"))
    ranges = lines.groupBy("path", "block").agg(F.min("__at").alias("__first"), F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = lines.join(ranges, ["path", "block"]).select("path", (F.col("__before") + F.col("__at") - F.col("__first")).cast("int").alias("line"), "content")
    return cells_of(numbered, delimiter)


def header_map(cells: DataFrame, file_cols: Sequence[str] = ("path",)) -> DataFrame:
    """Columns by lower-cased header: ``first_idx`` for look-ups, ``last_idx`` for rows as objects; empty names are hidden."""
    named = cells.filter("col_name IS NOT NULL AND col_name <> ''").select(*file_cols, F.lower("col_name").alias("name"), "col_idx").distinct()
    return named.groupBy(*file_cols, "name").agg(F.min("col_idx").alias("first_idx"), F.max("col_idx").alias("last_idx"))


def wide_rows(cells: DataFrame, cols: Sequence[str], file_cols: Sequence[str] = ("path",)) -> DataFrame:
    """Cells as rows again: ``line`` and a column per name (any case; the first of a repeated header)."""
    low = cells.filter("col_name IS NOT NULL").withColumn("__name", F.lower("col_name"))
    return low.groupBy(*file_cols, "line").agg(*(F.min_by(F.when(F.col("__name") == c.lower(), F.col("value")), F.when(F.col("__name") == c.lower(), F.col("col_idx"))).alias(c) for c in cols))


def plain_path(path: Column) -> Column:
    """A manifest's path as it is compared: '/' for '\\', ASCII lower case."""
    return ascii_lower(F.replace(path, F.lit("\\"), F.lit("/")))


def verify_manifest(files: DataFrame, manifest: DataFrame, totals: DataFrame | None = None, encodings: Sequence[str] = ("utf-8", "windows-1252")) -> DataFrame:
    """Differences of files (path, content) from a manifest (dataset, path, bytes, encoding, sha256): ``path``, ``code``.

    Beside each file's size and hash: its encoding (one of ``encodings``, and
    UTF-8 must be valid as such), hashes that are none, repeated paths and stems.
    ``totals`` (dataset, files, bytes, digest) are checked against what the
    manifest adds up to; there ``path`` is the dataset.
    """
    listed = manifest.select("dataset", F.col("path").alias("named"), plain_path(F.col("path")).alias("path"), "bytes", F.lower("encoding").alias("encoding"), F.lower("sha256").alias("sha256"))
    have = files.select(plain_path(F.col("path")).alias("p"), F.col("path").alias("found"), F.octet_length("content").alias("n"), F.sha2("content", 256).alias("sha"), F.is_valid_utf8(F.col("content").cast("string")).alias("utf8"))
    both = listed.join(have, F.col("path") == F.col("p"), "full_outer")
    code = (
        F.when(F.col("p").isNull(), "missing").when(F.col("path").isNull(), "not-listed").when(~F.col("sha256").rlike("^[0-9a-f]{64}$"), "hash-format").when(~F.col("encoding").isin(*encodings), "unknown-encoding")
        .when(F.col("n") != F.col("bytes"), "size").when(F.col("sha") != F.col("sha256"), "sha256").when((F.col("encoding") == "utf-8") & ~F.col("utf8"), "encoding")
    )
    found = both.select(F.coalesce("named", "found").alias("path"), code.alias("code")).filter("code IS NOT NULL")
    repeated = listed.groupBy("dataset", "path").agg(F.count("*").alias("n"), F.min("named").alias("named")).filter("n > 1").select(F.col("named").alias("path"), F.lit("repeated-path").alias("code"))
    stems = listed.withColumn("stem", path_stem(F.col("path"))).groupBy("dataset", "stem").agg(F.count("*").alias("n"), F.min("named").alias("path")).filter("n > 1").select("path", F.lit("repeated-stem").alias("code"))
    found = found.unionByName(repeated).unionByName(stems)
    if totals is None:
        return found
    sums = dataset_digests(manifest).select(F.col("dataset").alias("d"), F.col("files").alias("f"), F.col("bytes").alias("b"), F.col("digest").alias("g"))
    said = totals.join(sums, F.col("dataset") == F.col("d"), "full_outer")
    wrong = F.array_compact(F.array(F.when(F.col("d").isNull(), "missing-dataset"), F.when(F.col("dataset").isNull(), "not-listed-dataset"), F.when(F.col("f") != F.col("files"), "file-count"), F.when(F.col("b") != F.col("bytes"), "total-bytes"), F.when(F.col("g") != F.lower("digest"), "digest")))
    return found.unionByName(said.select(F.coalesce("dataset", "d").alias("path"), F.explode(wrong).alias("code")))


class _Digest:
    """The hash of a dataset's lines as they go by."""

    def __init__(self) -> None:
        self.files, self.bytes, self.hash = 0, 0, hashlib.sha256()

    def add(self, sha256: str, path: str, size: int | None) -> None:
        self.files += 1
        self.bytes += size or 0
        self.hash.update(f"{sha256}  {path}\n".encode())

    def done(self) -> tuple:
        return self.files, self.bytes, self.hash.hexdigest()


def dataset_digests(manifest: DataFrame) -> DataFrame:
    """Per dataset: files, bytes, and sha256 over its lines of ``<sha>  <path>``, by path (lower case, '/').

    Lines are sorted with spill and hashed as they go by: a dataset of any size
    needs no more memory than a batch.
    """
    lines = manifest.select(F.coalesce("dataset", F.lit("")).alias("dataset"), F.lower("sha256").alias("sha256"), plain_path(F.col("path")).alias("path"), F.col("bytes").cast("long").alias("size"))
    return folded(lines, "dataset", ["path", "sha256"], _Digest, ["sha256", "path", "size"], "files long, bytes long, digest string")


def overlay_sources(catalog: DataFrame) -> DataFrame:
    """The winning table of each stem: ``tier`` 0 (open), 1 (primary), 2 (reference), 3 (bundled), then path text.

    ``catalog``: scope, stem, path, tier, readable.  A stem that is there but
    unreadable in a higher tier blocks lower tiers.  Paths of the primary tier
    do not count in the reference tier.
    """
    primary = catalog.filter("tier = 1").select("scope", "path").distinct()
    kept = catalog.filter("tier <> 2").unionByName(catalog.filter("tier = 2").join(primary, ["scope", "path"], "left_anti"))
    best = kept.groupBy("scope", "stem").agg(F.min("tier").alias("tier"))
    return kept.join(best, ["scope", "stem", "tier"]).filter("readable").groupBy("scope", "stem", "tier").agg(F.min("path").alias("path"))


def overlay_rows(base: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Rows of ``patch``, and rows of ``base`` whose key it lacks."""
    return patch.unionByName(base.join(patch.select(key).distinct(), key, "left_anti"))


def with_scope(df: DataFrame, marker: str | None = None, path_col: str = "path") -> DataFrame:
    """``df`` with ``scope``: the parent folder, or what stands before ``/marker/`` in the path (any case)."""
    c = F.col(path_col)
    return df.withColumn("scope", F.regexp_extract(c, f"(?i)^(.*)/{marker}/", 1) if marker else path_parent(c))


def load_rank(df: DataFrame, order: Sequence[str], name_col: str = "stem") -> DataFrame:
    """``df`` with ``load_rank``: the place in the list, behind it for unknown names."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(name_col)) if order else F.lit(0)
    return df.withColumn("load_rank", F.when(place > 0, place).otherwise(len(order) + 1).cast("int"))


def read_json_entries(files: DataFrame, text_col: str = "text", file_col: str = "path") -> DataFrame:
    """``file``, ``entry``, ``v`` (VARIANT), ``keys``, ``error``: elements of top-level arrays.

    Other JSON gives no rows; invalid JSON gives one row with ``error``.
    """
    clean = F.regexp_replace(F.col(text_col), "^\\uFEFF", "")
    rows = files.select(F.col(file_col).alias("file"), clean.alias("text"), F.try_parse_json(clean).alias("v"))
    bad = rows.filter("v IS NULL").select("file", F.lit(None).cast("int").alias("entry"), F.lit(None).cast("variant").alias("v"), F.lit(None).cast("array<string>").alias("keys"), F.lit("Json/Syntax").alias("error"))
    arrays = rows.filter(F.schema_of_variant("v").startswith("ARRAY"))
    good = arrays.select("file", F.posexplode(F.try_variant_get("v", "$", "array<variant>")).alias("entry", "v"))
    return good.select("file", "entry", "v", F.json_object_keys(F.to_json("v")).alias("keys"), F.lit(None).cast("string").alias("error")).unionByName(bad)


def load_stats(decoded: DataFrame) -> DataFrame:
    """How many files were found, decoded and failed."""
    return decoded.agg(F.count("*").alias("discovered"), F.count_if(F.col("decode_error").isNull()).alias("parsed"), F.count_if(F.col("decode_error").isNotNull()).alias("failed"))
