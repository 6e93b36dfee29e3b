"""From raw documents to token files: five stages, each a table for the next.

``run`` writes what each stage returns to the shared folder and reads it as the
next stage's documents.  All stages but the last keep the columns of
``documents``.

Null and empty texts end with the first stage, which rejects texts of fewer than 50
words.  Repeated rows are rejected or kept alike there, and the second stage leaves
one of them.  Very long texts pass every stage whole.  An empty table gives an empty
table at each stage, and token files of no documents.  Columns beyond those of
``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridcheck.llm.common import table, written
from gridcheck.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, without the lines that are frequent on their host."""
    from gridcheck.llm.quality_rules import kept_documents

    return kept_documents(docs, host_col="source")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the smallest id."""
    from gridcheck.llm.ngram_join import one_of_each

    return one_of_each(docs, n=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without much of the benchmark."""
    from gridcheck.llm.decontaminate import decontaminated

    return decontaminated(docs, table(spark, sf_dir, "benchmark"), window=13)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or what the mix takes of them, as often as it takes them."""
    from gridcheck.llm.mixing import mixed_documents

    return mixed_documents(docs, weights=(5, 2, 1), most=3)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token files of all texts, read back: doc_id, start, n_tokens, ids_crc32."""
    from gridcheck.llm.token_files import read_checks, write_tokens

    return read_checks(write_tokens(docs, tokenizer_path("byte_bpe_50k.json"), end_id=2))


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard", deduplicate),
    ("decontaminate", decontaminate),
    ("mixing", mix),
    ("token_ids", tokens),
]

#: SQL has no byte-pair encoding, and no keyed permutations of blocks: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir).select("doc_id", "start", "n_tokens", "ids_crc32")
