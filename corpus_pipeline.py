"""A training corpus from `documents`: quality rules, line dedup, near-duplicate removal, decontamination, encoding and decoding.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.  `run` writes each
stage's rows as Parquet into the shared folder and reads them back as the next one's docs.  All but the last stage
return the columns of docs; the last returns doc_id, n_tokens, ids_crc32, ids and text_md5, of the text decoded from ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestar.llm import decontaminate, line_dedup, ngram_join, quality, sentencepiece_lattice
from lodestar.llm.common import materialise, table
from lodestar.llm.queries import tokenizer_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, those without ten words (null and empty texts) among them.

    Each row is judged by its text alone; without usable labels only the base rules reject."""
    return quality.filter_documents(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated windows go, all but the first in the order of id and row; a document that loses all its lines goes.

    Texts without a line to lose, null and empty ones included, stay as they are."""
    return line_dedup.remove_repeats(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of the least id; rows that share an id stay or go together.

    Rows without words (null, empty, blank) or with a null id link with nothing and stay."""
    return ngram_join.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; repeated rows alike.  Null and empty texts hold nothing and stay."""
    return decontaminate.filter_documents(docs, table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each row's text and a digest of the text that they decode to; null and empty texts have no ids.

    Equal texts get equal ids, and a row comes out for every row that comes in."""
    return sentencepiece_lattice.round_trip(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding", encoding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return docs


#: The first stage's forest isn't SQL; tests hold the pipeline against a plain version.
ORACLE_SQL = None
