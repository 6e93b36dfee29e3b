"""Quality rules: statistics of each text, and lines that many documents share.

Everything is DataFrame functions.  The statistics come from one pass over the
texts, which also writes the hashes of each document's normalised lines.  The
lines' frequencies are counted per host over documents, of which equal texts and
verified near copies count once, so that copies do not make the lines of one
document look like boilerplate.  Near copies are sought among the texts that
share the smallest and the largest hash of their three-word windows; a text is
one if its windows are ``SIMILAR`` to those of the first text among these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_PATTERN, written

SYMBOLS = r"[#*$%&|<>]"
#: Frequent lines that may go to every task; beyond it the join shuffles, each line spread over parts of its texts.
BROADCAST_LINES = 200_000
#: Jaccard similarity in percent from which a text counts as a copy.
SIMILAR = 80


def _zero() -> Column:
    return F.lit(0).cast("long")


def _normal(line: Column) -> Column:
    """Lower case, digits alike, white space alike."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), r"[\x20\x09-\x0D]+", " "))


def _repeated_places() -> Column:
    """Where windows found twice or more start, from ``ordered`` hashes with positions."""
    twice = F.filter("ordered", lambda x, k: ((k > 0) & (F.get("ordered", k - 1)["h"] == x["h"])) | ((k < F.size("ordered") - 1) & (F.get("ordered", k + 1)["h"] == x["h"])))
    return F.sort_array(F.transform(twice, lambda x: x["i"]))


def _windows(words: Column, window: int) -> Column:
    n = F.size(words)
    return F.when(n >= window, F.transform(F.sequence(F.lit(0), n - window), lambda i: F.xxhash64(*(words[i + k] for k in range(window))))).otherwise(F.array().cast("array<bigint>"))


def _text_key(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def text_statistics(docs: DataFrame, text_col: str = "text", window: int = 3) -> DataFrame:
    """``docs`` without its text, with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, family, text_key and lines (hash and words of each line with words).

    A null text has no words and no lines.  Columns of ``docs`` with these names
    must be renamed before.
    """
    kept = [c for c in docs.columns if c != text_col]
    text = F.col("__text")
    step = docs.select(*kept, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    step = step.select("*", F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0)).alias("words"), F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD_PATTERN)).alias("filled"))
    n = F.size("words")
    words = F.col("words")
    step = step.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("filled") - F.size(F.array_distinct("filled"))).cast("long").alias("n_dup_lines"),
        _windows(words, window).alias("hashes"),
        _text_key(text).alias("text_key"),
        F.transform("filled", lambda x: F.struct(F.xxhash64(_normal(x)).alias("line"), F.regexp_count(x, F.lit(WORD_PATTERN)).alias("words"))).alias("lines"),
    )
    named = [*kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "text_key", "lines"]
    family = F.when(F.size("hashes") > 0, F.xxhash64(F.array_min("hashes"), F.array_max("hashes"))).otherwise(F.col("text_key.a")).alias("family")
    unique = F.size(F.array_distinct("hashes")) == F.size("hashes")
    step = step.select(*named, family, F.when(~unique, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("ordered"))
    step = step.select(*named, "family", F.when(F.col("ordered").isNotNull(), _repeated_places()).alias("at"))
    gaps = F.transform("at", lambda p, k: F.least(F.lit(window), F.coalesce(F.get("at", k + 1) - p, F.lit(window))))
    covered = F.aggregate(gaps, _zero(), lambda a, x: a + x)
    return step.select(*named, "family", F.coalesce(covered, _zero()).alias("n_repeat_words"))


def near_copies(docs: DataFrame, stats: DataFrame, host_col: str, text_col: str = "text", window: int = 3) -> DataFrame:
    """``text_key`` and ``unit`` of a host's texts that are near copies of the text with key ``unit``.

    Only texts whose family has others are read again and compared, each with
    the first text of its family alone.
    """
    texts = stats.groupBy(host_col, "family", "text_key").agg(F.lit(1).alias("x"))
    shared = texts.groupBy(host_col, "family").agg(F.min("text_key").alias("unit"), F.count("*").alias("n")).filter("n > 1")
    open_texts = texts.join(shared, [host_col, "family"]).select(host_col, "text_key", "unit")
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(host_col, _text_key(text).alias("text_key"), text.alias("__text")).join(open_texts, [host_col, "text_key"]).dropDuplicates([host_col, "text_key"])
    words = read.select(host_col, "text_key", "unit", F.regexp_extract_all("__text", F.lit(WORD_PATTERN), F.lit(0)).alias("words"))
    sets = written(words.select(host_col, "text_key", "unit", F.array_distinct(_windows(F.col("words"), window)).alias("hashes")), "windows")
    first = sets.filter("text_key = unit").select(host_col, "unit", F.col("hashes").alias("others"))
    both = F.size(F.array_intersect("hashes", "others"))
    similar = 100 * both >= SIMILAR * (F.size("hashes") + F.size("others") - both)
    return written(sets.filter("text_key <> unit").join(first, [host_col, "unit"]).filter(similar).select(host_col, "text_key", "unit"), "copies")


def frequent_lines(stats: DataFrame, copies: DataFrame, host_col: str, least_docs: int = 50, share: float = 0.02, small_docs: int = 30) -> DataFrame:
    """Per host, the lines of at least ``least_docs`` documents, or of ``small_docs`` and more than ``share`` of the host's.

    Equal texts and ``copies`` of one text are one document.  The limit never
    rises above ``least_docs``, whatever the size of the host.

    A row has the host (never null), the line's hash and ``n_docs``.  Two levels of
    aggregation: no task gathers all documents of a line or of a host.
    """
    folded = stats.join(copies, [host_col, "text_key"], "left").select(host_col, F.coalesce("unit", "text_key").alias("unit"), "lines")
    lines = folded.select(host_col, "unit", F.explode(F.array_distinct(F.col("lines.line"))).alias("line"))
    of_line = lines.groupBy(host_col, "line", "unit").agg(F.lit(1).alias("x")).groupBy(host_col, "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min(least_docs, small_docs))
    of_host = folded.groupBy(host_col, "unit").agg(F.lit(1).alias("x")).groupBy(host_col).agg(F.count("*").alias("n_host"))
    return of_line.join(of_host, host_col).filter((F.col("n_docs") >= least_docs) | (F.col("n_docs") > share * F.col("n_host"))).select(host_col, "line", "n_docs")


def with_frequent(lines: DataFrame, frequent: DataFrame, host_col: str) -> DataFrame:
    """The rows of ``lines`` (host, text_key, line and more) whose line is in ``frequent``.

    A frequent line is a hot key by its nature, so beyond ``BROADCAST_LINES`` the
    rows of a line are dealt to as many parts as there are shuffle partitions,
    by their text.  Only parts that a line has rows in are looked up, at most one
    row for each, so neither side has a key that many rows share.
    """
    if frequent.count() <= BROADCAST_LINES:
        return lines.join(F.broadcast(frequent), [host_col, "line"])
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lines.withColumn("__part", F.pmod(F.col("text_key.b"), F.lit(parts)).cast("int"))
    there = dealt.select(host_col, "line", "__part").distinct().join(frequent, [host_col, "line"])
    return dealt.join(there, [host_col, "line", "__part"]).drop("__part")


def quality_rules(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    least_words: int = 50,
    most_repeated: int = 50,
    least_docs: int = 50,
    share: float = 0.02,
    left_share: float = 0.4,
    left_words: int = 25,
    small_docs: int = 30,
) -> DataFrame:
    """The columns of ``docs`` but the text, with the statistics and the verdicts.

    ``base_failed``: fewer than ``least_words`` words, or more than
    ``most_repeated`` percent of them in repeated three-word windows.
    ``n_removed_words``, ``n_removed_lines``: what is in lines that are
    frequent on the document's host.  ``depleted``: some are, and what is left
    is less than ``left_share`` of the words or fewer than ``left_words``.
    ``kept``: neither failed nor depleted.

    Null and empty texts fail.  A null host is a host of its own.  Repeated
    rows keep a row each and count once.  An empty table gives an empty result.
    Columns of ``docs`` with the name of a result are replaced.
    """
    return _verdicts(docs, host_col, text_col, least_words, most_repeated, least_docs, share, left_share, left_words, small_docs).drop("removed")


def _verdicts(
    docs: DataFrame,
    host_col: str = "source",
    text_col: str = "text",
    least_words: int = 50,
    most_repeated: int = 50,
    least_docs: int = 50,
    share: float = 0.02,
    left_share: float = 0.4,
    left_words: int = 25,
    small_docs: int = 30,
) -> DataFrame:
    """``quality_rules`` with ``removed``, the hashes of the text's frequent lines, or null."""
    own = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "family", "text_key", "lines", "words", "filled", "hashes", "ordered", "at", "base_failed", "depleted", "kept", "n_removed_words", "n_removed_lines", "removed"}
    kept = [c for c in docs.columns if c != text_col and c.lower() not in own]
    host = F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("__host_key")
    stats = written(text_statistics(docs.select(*kept, host, text_col), text_col), "statistics")
    copied = near_copies(docs.select(host, text_col), stats, "__host_key", text_col)
    frequent = written(frequent_lines(stats, copied, "__host_key", least_docs, share, small_docs).select("__host_key", "line"), "lines")
    lines = stats.select("__host_key", "text_key", F.explode("lines").alias("x")).select("__host_key", "text_key", F.col("x.line").alias("line"), F.col("x.words").alias("words"))
    removed = (
        with_frequent(lines, frequent, "__host_key")
        # copies of a text bring the same lines again: a text's lines count as often as its copies, which are divided out
        .groupBy("__host_key", "text_key")
        .agg(F.sum("words").alias("w"), F.count("*").alias("l"), F.collect_set("line").alias("removed"))
    )
    copies = stats.groupBy("__host_key", "text_key").agg(F.count("*").alias("copies"))
    removed = removed.join(copies, ["__host_key", "text_key"]).select("__host_key", "text_key", F.expr("w div copies").alias("n_removed_words"), F.expr("l div copies").alias("n_removed_lines"), "removed")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    left = F.col("n_words") - F.col("n_removed_words")
    depleted = (F.col("n_removed_words") > 0) & ((left < left_share * F.col("n_words")) | (left < left_words))
    return (
        stats.drop("lines", "family")
        .join(removed, ["__host_key", "text_key"], "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", _zero()))
        .withColumn("n_removed_lines", F.coalesce("n_removed_lines", _zero()))
        .withColumn("base_failed", failed)
        .withColumn("depleted", depleted)
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .drop("__host_key", "text_key")
    )


def kept_documents(docs: DataFrame, host_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that the rules keep, without the lines that are frequent on their host.

    ``n_chars``, if there is one, is that of the text that is left.
    The verdict depends on host and text alone, so both join it back to the
    rows: by the host and two 64-bit hashes of the text.

    Null, empty and short texts fail the base rules and go.  Repeated rows are
    kept or rejected alike, each a row; a null host is a host of its own.  A very
    long text is one row, read whole.  Equal texts tie and share a verdict.  An
    empty table gives an empty one; all other columns stay as they are.
    """
    key = [F.coalesce(F.concat(F.lit("="), F.col(host_col).cast("string")), F.lit("")).alias("__h"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__a"), F.xxhash64(F.lit(1), F.coalesce(F.col(text_col), F.lit(""))).alias("__b")]
    verdicts = _verdicts(docs.select(*key, F.col(host_col).alias("host"), F.col(text_col).alias("text")), "host", "text", **options)
    kept = verdicts.filter("kept").select("__h", "__a", "__b", F.col("removed").alias("__gone")).dropDuplicates(["__h", "__a", "__b"])
    keyed = docs.select("*", *key).join(kept, ["__h", "__a", "__b"])
    left = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda x: ~(x.rlike(WORD_PATTERN) & F.array_contains("__gone", F.xxhash64(_normal(x))))), "\n")
    keyed = keyed.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(left))
    if "n_chars" in docs.columns:
        keyed = keyed.withColumn("n_chars", F.when(F.col("__gone").isNull(), F.col("n_chars")).otherwise(F.length(text_col)).cast(docs.schema["n_chars"].dataType))
    return keyed.select(*docs.columns)
