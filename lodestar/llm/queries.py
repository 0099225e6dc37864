"""The registered queries of the text operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import dedup_lines

    return dedup_lines(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), with_text=True).drop("kept", "spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import classes

    return classes(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import matches

    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sentencepiece_lattice import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import apply_rules

    out = apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly_score")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import count_documents

    return count_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")).select("doc_id", "n_tokens")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversations import damage, digest

    return digest(damage(table(spark, sf_dir, "conversations")))


def op12_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lattice_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def tokenizer_path(name: str) -> str:
    """A vocabulary file of the public tokenizers on this machine; executors read their own copy."""
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from . import conversations, lattice_dedup, line_dedup, resampling

    return {"op1_line_dedup": line_dedup.SQL, "op11_conversations": conversations.SQL, "op12_embedding_dedup": lattice_dedup.SQL, "op13_resampling": resampling.SQL}
