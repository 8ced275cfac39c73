"""The corpus pipeline: documents pass five stages in turn. Each stage reads what
its predecessor wrote; all but the last keep the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lendspark.llm import decontaminate, ngram_join, packing, secret_scan, toxicity
from lendspark.llm.common import read_table, staged
from lendspark.llm.queries import remainder, tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score reaches their language's threshold go. Learns
    from the labelled rows that the query of the operator learns from."""
    labels = read_table(spark, sf_dir, "labels").where(remainder(4) != 2)
    model = toxicity.train(docs.where(remainder(4) != 2), labels)
    return toxicity.drop_toxic(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest
    id: five-word shingles, similarity 0.8 or more."""
    return ngram_join.drop_near_copies(docs, words=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.drop_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; all documents stay."""
    return secret_scan.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of sequences of 4096 tokens."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("n-gram Jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_benchmark), ("secret scans", redact_secrets),
          ("packing", pack_sequences)]

ORACLE_SQL = None      # trained models and tokenizers have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
