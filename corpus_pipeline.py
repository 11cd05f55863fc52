"""Corpus pipeline: from documents to token ids in five stages.

Rejected documents go, one of each near-duplicate group stays, secrets are masked, sources are mixed to their weights,
and the mix is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyroll.llm import mixing, ngram_join, piece_dropout, quality, secrets
from tallyroll.llm.common import staged, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier, fitted on the labelled ones among them, keep."""
    return quality.kept_documents(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8: that of the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mix; the copies of one document have draws of their own."""
    return piece_dropout.encode_pieces(piece_dropout.numbered_copies(docs, "copy"), draw="copy")


STAGES = [
    ("quality_rules", quality_rules), ("ngram_jaccard_join", near_duplicates), ("secret_scans", secret_scans), ("mix_sources", mix_sources),
    ("sentencepiece_codec", encode)]
#: No SQL says what a trained classifier keeps or how a draw falls; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next reads them."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
