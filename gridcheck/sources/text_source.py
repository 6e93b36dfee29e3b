"""A data source for folders of delimited text: ``spark.read.format("text_tables")``.

Files are cut into parts at record ends, whatever their encoding, so a file of any
size is read by many tasks.  A part knows the bytes it may begin in; its first record
starts behind the first record end at or before them.  Lines are numbered in two
steps: a part's task numbers its own, and what earlier parts of the file hold is added
from a count of each part (``numbered_lines``).  Folders and files that can't be read
come as rows with ``error``, and stop nothing.
"""

from __future__ import annotations

import codecs
import os
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from gridcheck.sources.text_tables import TABLE_EXTENSIONS, cells_of

#: Bytes that one step reads, and bytes in which a record end is sought at once.
READ = 1 << 20
#: Bytes of the parts that one task reads one after the other, about; larger parts are a task each.
TASK = 8 << 20
#: What a task takes a part for, at least: files may be small.
OPENED = 1 << 14
_SCHEMA = "path string, stem string, part int, parts int, at long, content string, encoding string, error string"


@dataclass
class _Part(InputPartition):
    path: str
    part: int
    parts: int
    start: int
    end: int
    encoding: str
    skip: int
    error: str | None = None


@dataclass
class _Parts(InputPartition):
    parts: list[_Part]


def _together(parts: list[_Part]) -> list[_Parts]:
    """Parts in their order, as many to a task as have TASK bytes."""
    out, size = [], TASK
    for p in parts:
        if size >= TASK:
            out.append(_Parts([]))
            size = 0
        out[-1].parts.append(p)
        size += max(p.end - p.start, OPENED)
    return out


def walked(root: str, extensions: tuple[str, ...], recursive: bool, ignore_case: bool) -> list[tuple[str, str | None]]:
    """Files with one of the extensions, and folders that can't be listed with their error; by path."""
    found: list[tuple[str, str | None]] = []
    wanted = {e.lower() for e in extensions} if ignore_case else set(extensions)

    def fits(name: str) -> bool:
        ext = os.path.splitext(name)[1][1:]
        return (ext.lower() if ignore_case else ext) in wanted

    def visit(folder: str) -> None:
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.path)
        except OSError as e:
            found.append((folder, e.strerror or str(e)))
            return
        for entry in entries:
            try:
                if entry.is_dir():
                    if recursive:
                        visit(entry.path)
                elif fits(entry.name):
                    found.append((entry.path, None))
            except OSError as e:
                found.append((entry.path, e.strerror or str(e)))

    if os.path.isfile(root):
        return [(root, None)]
    visit(root)
    return sorted(found)


def encoding_of(path: str, size: int, declared: str) -> tuple[str, int, str | None]:
    """A file's encoding, the bytes of its mark, and what is wrong with it.

    auto: by the mark; else UTF-8 if the whole file is valid as such, else
    Windows-1252.
    """
    with open(path, "rb") as f:
        head = f.read(3)
        mark16 = {b"\xff\xfe": "utf-16-le", b"\xfe\xff": "utf-16-be"}.get(head[:2])
        if mark16 and (declared == "auto" or declared.startswith("utf-16")):
            return mark16, 2, "odd length" if size % 2 else None
        if declared.startswith("utf-16"):
            return declared, 0, "odd length" if size % 2 else None
        marked = head == b"\xef\xbb\xbf"
        if declared != "auto":
            return declared, 3 if marked and declared == "utf-8" else 0, None
        decoder = codecs.getincrementaldecoder("utf-8")()
        f.seek(3 if marked else 0)
        try:
            while block := f.read(READ):
                decoder.decode(block)
            decoder.decode(b"", True)
        except UnicodeDecodeError:
            return ("utf-8", 3, "invalid UTF-8") if marked else ("windows-1252", 0, None)
        return "utf-8", 3 if marked else 0, None


def text_of(raw: bytes, encoding: str) -> str:
    """Lossy for UTF-8; undefined bytes of Windows-1252 stay what they are."""
    if encoding == "windows-1252":
        return raw.decode("cp1252", "gridcheck-keep")
    return raw.decode("latin-1" if encoding == "latin-1" else encoding, "replace")


codecs.register_error("gridcheck-keep", lambda e: ("".join(chr(b) for b in e.object[e.start : e.end]), e.end))


def records(f, start: int, end: int, first: int, size: int, unit: int, little: bool) -> Iterator[tuple[int, bytes]]:
    """(place, bytes) of the records that begin in [start, end); CR, LF and CR LF end a record.

    ``first`` is where the file's first record begins; ``unit`` the bytes of a
    code unit.  A record end that lies across parts belongs to the part before.
    """
    lf, cr = (b"\n\0", b"\r\0") if unit == 2 and little else (b"\0\n", b"\0\r") if unit == 2 else (b"\n", b"\r")

    def find(buffer: bytes, mark: bytes, at: int) -> int:
        while (k := buffer.find(mark, at)) >= 0 and k % unit:
            at = k + 1
        return k

    def next_end(buffer: bytes, at: int) -> tuple[int, int]:
        """Where a record ends and how long its mark is; (-1, 0) for not yet known."""
        a, b = find(buffer, lf, at), find(buffer, cr, at)
        if b >= 0 and (a < 0 or b < a):
            if len(buffer) < b + 2 * unit:
                return b, -unit  # an LF may follow
            return b, 2 * unit if buffer[b + unit : b + 2 * unit] == lf else unit
        return a, unit if a >= 0 else 0

    # from one unit before the start: is it the end of a record?
    at = start
    if start > first:
        f.seek(start - unit)
        before, here = f.read(unit), f.read(unit)
        if not (before == lf or (before == cr and here != lf)):
            # the record that began earlier goes on: to its end
            buffer, base = b"", start
            f.seek(start)
            while True:
                k, n = next_end(buffer, 0)
                if n > 0:
                    at = base + k + n
                    break
                block = f.read(READ)
                if not block:
                    if n < 0:
                        at = base + k + unit
                        break
                    return
                keep = buffer[k:] if n < 0 else buffer[-unit:] if len(buffer) > READ else buffer
                base += len(buffer) - len(keep)
                buffer = keep + block
    f.seek(at)
    buffer, base, pos = b"", at, 0
    while base + pos < end:
        k, n = next_end(buffer, pos)
        if n > 0:
            yield base + pos, buffer[pos:k]
            pos = k + n
            continue
        block = f.read(READ)
        if not block:
            if base + pos < size:
                yield base + pos, buffer[pos:k] if n < 0 else buffer[pos:]
            return
        base, buffer, pos = base + pos, buffer[pos:] + block, 0


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        get = lambda name, default: options.get(name, options.get(name.lower(), default))
        self.root = get("path", None)
        if not self.root:
            raise ValueError("text_tables: no path given")
        self.root = self.root.removeprefix("file://")
        self.extensions = tuple(e.strip() for e in get("extensions", ",".join(TABLE_EXTENSIONS)).split(","))
        self.recursive, self.ignore_case = get("recursive", "true") == "true", get("ignoreCase", "true") == "true"
        self.encoding, self.bytes = get("encoding", "auto"), max(16, int(get("partBytes", str(64 << 20))))

    def partitions(self) -> list[_Parts]:
        out = []
        for path, error in walked(self.root, self.extensions, self.recursive, self.ignore_case):
            if error is None:
                try:
                    size = os.path.getsize(path)
                    encoding, skip, error = encoding_of(path, size, self.encoding)
                except OSError as e:
                    error = e.strerror or str(e)
            if error is not None:
                out.append(_Part(path, 0, 1, 0, 0, self.encoding, 0, error))
                continue
            step = self.bytes - self.bytes % 2
            cuts = [skip, *range(skip + step, size, step), max(size, skip)]
            out += [_Part(path, i, len(cuts) - 1, a, b, encoding, skip) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        return _together(out)

    def read(self, partition: _Parts) -> Iterator[tuple]:
        for p in partition.parts:
            yield from self._part(p)

    def _part(self, p: _Part) -> Iterator[tuple]:
        stem = os.path.splitext(os.path.basename(p.path))[0].lower()
        if p.error is not None:
            yield p.path, stem, 0, 1, None, None, None, p.error
            return
        try:
            with open(p.path, "rb") as f:
                unit = 2 if p.encoding.startswith("utf-16") else 1
                size, empty = os.path.getsize(p.path), True
                for at, raw in records(f, p.start, p.end, p.skip, size, unit, p.encoding == "utf-16-le"):
                    empty = False
                    yield p.path, stem, p.part, p.parts, at, text_of(raw, p.encoding), p.encoding, None
                if empty and size == p.skip:
                    yield p.path, stem, 0, 1, p.skip, "", p.encoding, None
        except OSError as e:
            yield p.path, stem, p.part, p.parts, None, None, None, e.strerror or str(e)


class TextTables(DataSource):
    """Options: path, extensions, recursive, ignoreCase, encoding (auto, utf-8, latin-1, windows-1252, utf-16-le/be), partBytes.

    The path is one that all executors see as a folder (a mounted store); for
    other stores there is ``read_delimited``.
    """

    @classmethod
    def name(cls) -> str:
        return "text_tables"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))


def read_text_tables(spark: SparkSession, path: str, **options: str | int | bool) -> DataFrame:
    """The records of all files: ``path``, ``stem``, ``part``, ``at`` (byte), ``content``, ``encoding``, and ``error`` for what can't be read."""
    spark.dataSource.register(TextTables)
    said = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    return spark.read.format("text_tables").options(**said).load(path)


def numbered_lines(records_: DataFrame) -> DataFrame:
    """``path``, ``line`` (from 0), ``content``: records by their place in the file.

    A part numbers its own; parts of a file are counted and summed up in order.
    """
    rows = records_.filter("error IS NULL").select("path", "part", "at", "content", F.monotonically_increasing_id().alias("__at"))
    counts = rows.groupBy("path", "part").agg(F.count("*").alias("n"), F.min("__at").alias("__first"))
    before = Window.partitionBy("path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("path", "part", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    return rows.join(starts, ["path", "part"]).select("path", (F.col("__before") + F.col("__at") - F.col("__first")).cast("int").alias("line"), "content")


def read_cells(spark: SparkSession, path: str, delimiter: str = "\t", **options: str | int | bool) -> tuple[DataFrame, DataFrame]:
    """Cells of all files, as ``text_tables.cells_of`` gives them; and what could not be read: ``path``, ``error``."""
    rows = read_text_tables(spark, path, **options)
    return cells_of(numbered_lines(rows), delimiter), rows.filter("error IS NOT NULL").select("path", "error")
