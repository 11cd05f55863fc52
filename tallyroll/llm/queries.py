"""Named queries of the operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyroll.llm import chat, hard_negatives, licenses, mixing, ngram_join, piece_dropout, quality, secrets, spelling, substring_dedup, token_counts, token_files, topk
from tallyroll.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_substring_dedup")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query("op2_top_k", topk.ORACLE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op3_token_files")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.documents_token_files(table(spark, sf_dir, "documents"))


@query("op4_mix_sources")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


@query("op5_token_counts")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.documents_token_counts(table(spark, sf_dir, "documents"))


@query("op6_chat_format", chat.ORACLE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.conversation_digests(table(spark, sf_dir, "conversations"))


@query("op7_quality_rules")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_secret_scans")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query("op9_piece_dropout")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_dropout.encode_pieces(table(spark, sf_dir, "documents"))


@query("op10_ngram_jaccard")
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.documents_components(table(spark, sf_dir, "documents"))


@query("op11_hard_negatives", hard_negatives.ORACLE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


@query("op12_spelling_variants", spelling.ORACLE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


@query("op13_license_scans", licenses.ORACLE)
def _(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))
