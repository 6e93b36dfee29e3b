"""Token counts by counting the pieces of each distinct pre-token once.

A SentencePiece BPE model whose pieces hold the word marker only in front and
never hold a line feed cannot merge across these places, so a text falls into
pre-tokens that the model encodes independently.  The corpus has far fewer
distinct pre-tokens than pre-tokens:

1. each task counts the pre-tokens of its rows; one shuffle sums them,
2. the library encodes each distinct pre-token once, keeping only how many
   pieces it has,
3. per-document pre-token frequencies are joined to these counts and summed.

The most frequent pre-tokens (at most ``hot_entries``, whatever the corpus) go
to the tasks as a broadcast, which does the join for most of the text and
leaves no frequent key for the shuffled join of all others.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_ids, rows_of, written

#: A run of blanks with the word after it, or a line feed with what follows.
PRE_TOKEN = re.compile(r" +[^ \n]*|\n[^ \n]*")
#: Distinct pre-tokens that a task keeps before it passes them on.
FLUSH = 400_000
MARK = "▁"


@lru_cache(1)
def _model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p in pieces):
        raise ValueError("the model's pieces cross pre-tokens")
    if model.encode("a  b Ａ", out_type=str)[0] != MARK + "a" or model.decode(model.encode("a  b Ａ")) != "a  b Ａ":
        raise ValueError("the model normalises its input")
    return model


def pre_tokens(text: str) -> list[str]:
    """The pre-tokens of a text, as the model sees it: with a blank in front."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    return PRE_TOKEN.findall(" " + text)


def piece_counts(tokens: list[str], path: str) -> list[int]:
    """How many pieces each pre-token has.

    The library puts one blank before what it encodes: it takes the place of
    the first blank here, and is taken off again before a line feed.
    """
    model = _model(path)
    found = model.encode([t[1:] if t[0] == " " else t for t in tokens], num_threads=1)
    return [1 if t == " " else len(ids) - (t[0] == "\n") for t, ids in zip(tokens, found)]


def count_tokens(
    docs: DataFrame,
    model_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    hot_entries: int = 100_000,
) -> DataFrame:
    """One row per input row: id, n_bytes, n_tokens, over_limit, n_pre_tokens.

    Null and empty texts have no bytes and no tokens.  Repeated rows and rows
    with a null or repeated id keep a row each.  Other columns are not read.
    An empty table gives an empty result.  A very long text is cut into its
    pre-tokens in one row.  Ties among the most frequent pre-tokens change only
    how they are joined.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(text_col).alias("text"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"token": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})
            seen.clear()
            return out

        for batch in batches:
            for (text,) in rows_of(batch, "text"):
                seen.update(pre_tokens(text))
                if len(seen) > FLUSH:
                    yield flush()
        yield flush()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("token").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("n"), pa.array(piece_counts(tokens, model_path), pa.int64())], names=["token", "n", "pieces"])

    vocabulary = written(
        texts.mapInArrow(local, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).mapInArrow(encoded, "token string, n long, pieces long"),
        "pieces",
    )
    levels = sorted(((r.level, r.n) for r in vocabulary.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    least, entries = None, 0
    for level, n in levels:
        if entries + n > hot_entries:
            break
        least, entries = 2**level, entries + n
    frequent = vocabulary.filter(F.col("n") >= least).select("token", "pieces").toArrow().to_pydict() if entries else {"token": [], "pieces": []}
    hot = docs.sparkSession.sparkContext.broadcast(dict(zip(frequent["token"], frequent["pieces"])))

    def per_document(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, ids = hot.value, row_ids()
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("row", "n_bytes", "n_pre_tokens", "n_hot", "rest", "times")}
            for (text,) in rows_of(batch, "text"):
                tokens = pre_tokens(text)
                pieces = list(map(known.get, tokens))
                rest = Counter([t for t, p in zip(tokens, pieces) if p is None])
                out["row"].append(next(ids))
                out["n_bytes"].append(len(text.encode()) if text else 0)
                out["n_pre_tokens"].append(len(tokens))
                out["n_hot"].append(sum(filter(None, pieces)))
                out["rest"].append(list(rest))
                out["times"].append(list(rest.values()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(v, kind) for v, kind in zip(out.values(), kinds))], names=["id", *out])

    rows = written(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(per_document, f"id {id_type}, row long, n_bytes long, n_pre_tokens long, n_hot long, rest array<string>, times array<int>"),
        "frequencies",
    )
    rare = vocabulary if least is None else vocabulary.filter(F.col("n") < least)
    counted = (
        rows.select("row", F.explode(F.arrays_zip("rest", "times")).alias("x"))
        .select("row", F.col("x.rest").alias("token"), F.col("x.times").alias("times"))
        .join(rare.select("token", "pieces"), "token")
        .groupBy("row")
        .agg(F.sum(F.col("times") * F.col("pieces")).alias("n_rest"))
    )
    n_tokens = F.col("n_hot") + F.coalesce("n_rest", F.lit(0).cast("long"))
    return (
        rows.select("row", "id", "n_bytes", "n_pre_tokens", "n_hot")
        .join(counted, "row", "left")
        .select(F.col("id").alias(id_col), "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"), "n_pre_tokens")
    )
