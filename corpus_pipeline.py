"""From raw documents to packed training sequences: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagemill.llm import decontam, ngram_join, packing, suffix_dedup, toxicity
from pagemill.llm.common import staged, table
from pagemill.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go. Null and empty texts match nothing and stay; repeated rows fare alike."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def join_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their 5-word shingles the one with the smallest id stays.

    Null and blank texts link with nothing and stay, as do rows with a null id; rows that repeat an id stay or go together.
    """
    return ngram_join.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of 50-byte strings that a smaller document has go from the texts; documents left empty go.

    Null, empty and short texts stay as they are, and so do rows with a null id; rows that share an id don't cut each other.
    """
    return suffix_dedup.without_repeats(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edits allowed for, go, each by its own text; null and empty ones stay."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left and their places in sequences of 1024 tokens. A null or empty text is one piece, the end id."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", join_near_copies),
    ("suffix_array_dedup", cut_repeats),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("best_fit_packing", pack_sequences),
]
ORACLE_SQL = None  # tokens, trained scores and byte spans are beyond SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES in turn over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
