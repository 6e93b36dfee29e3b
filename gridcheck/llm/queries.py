"""The operators bound to the tables of a data directory.

Each query runs its operator, with production parameters, over the whole
table and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .oracles import ORACLES as ORACLES


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file of a public tokenizer lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity_scores

    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "toxic", folds=5, threshold=0.5)


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score_texts

    return score_texts(table(spark, sf_dir, "documents"), folds=10, alpha=0.1, least=1, order=3)


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import ngram_components

    return ngram_components(table(spark, sf_dir, "documents"), n=5, percent=80)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    found = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words", "n_removed_lines")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import Mix

    return Mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), most=3).taken().drop("source")


def op6_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_model import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", folds=5, threshold=0.3)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import read_checks, write_tokens

    return read_checks(write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import contamination, is_contaminated, items_digest

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination(docs, table(spark, sf_dir, "benchmark"), window=13).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest().alias("items_sha256"), is_contaminated().alias("contaminated"), "longest_match", "match_item", "match_start", "item_start"
    )


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import KINDS, count_kind, personal_data, spans_text

    base, every = F.col("base"), F.sort_array(F.concat("base", "added"))
    return personal_data(table(spark, sf_dir, "documents")).select(
        "doc_id", *(count_kind(base, k).alias(f"n_{k}") for k in KINDS), F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(every).alias("spans"), F.size("added").cast("long").alias("n_added")
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import HardNegatives

    rows, label = table(spark, sf_dir, "embeddings"), F.col("label").cast("long")
    mislabelled = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return HardNegatives(mislabelled, every=100, k=5, window=(80, 100)).triples()


def op12_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_windows import read_digests, with_conversation, write_windows
    from .oracles import PROBE

    turns = with_conversation(table(spark, sf_dir, "conversations"), -7, [("user", PROBE), ("assistant", PROBE)])
    return read_digests(write_windows(turns))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ordered import group_key
    from .turn_repair import damaged, repaired_turns

    turns = table(spark, sf_dir, "conversations")
    return repaired_turns(damaged(turns), turns.select("conv_id", group_key("conv_id").alias("g")).distinct())


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_score": op2_lm_score,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_quality_rules": op4_quality_rules,
    "op5_mixing": op5_mixing,
    "op6_quality_model": op6_quality_model,
    "op7_token_counts": op7_token_counts,
    "op8_token_ids": op8_token_ids,
    "op9_decontaminate": op9_decontaminate,
    "op10_pii": op10_pii,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_chat_windows": op12_chat_windows,
    "op13_turn_repair": op13_turn_repair,
}
