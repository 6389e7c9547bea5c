"""From raw documents to packed training sequences, one operator a stage.

Rows of one id stand or fall together only where near copies are dropped; the other stages judge
each row. Rows with a null id are judged like others and are nobody's copy.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language_id, packing, partenum, quality_rules, staging, surrogates
from tidemark.llm.queries import SURROGATE_KEY, WORD_BPE

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Less sure languages are rejected; texts without a letter always are.
LEAST_SURE = 0.3
#: Near copies: shingles of five words, similarity of 0.8 or more.
SHINGLE, PERCENT = 5, 80


def small_batches(stage: Stage) -> Stage:
    """The stage, with texts that go to Python workers in batches of bounded size."""
    @wraps(stage)
    def bounded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        staging.small_batches(spark)
        return stage(spark, docs, sf_dir)

    return bounded


@small_batches
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is found."""
    net = language_id.fit(docs.where(~staging.held_out(F.col("doc_id"))))
    found = language_id.annotate(docs, net)
    sure = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= LEAST_SURE)
    return found.where(sure).select(*docs.columns)


@small_batches
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the weighted rules take for good."""
    return quality_rules.keep(docs)


@small_batches
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of the smallest id of each group of near copies."""
    linked = partenum.link(docs, SHINGLE, PERCENT)
    copies = staging.stage(linked.where("doc_id <> component_id").select("doc_id").distinct())
    return docs.join(staging.bounded(copies, copies.count()), "doc_id", "left_anti").select(*docs.columns)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put surrogates in the place of personal data; the column of lengths follows."""
    replaced = surrogates.replace(docs, SURROGATE_KEY).select(*docs.columns)
    return replaced.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else replaced


@small_batches
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences: one row a piece of a document, with its sequence and place."""
    return packing.pack(packing.pieces(docs, public_tokenizers.path(WORD_BPE)))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language), ("quality_rules", quality), ("near_copies", near_copies),
    ("surrogates", private_data), ("packing", packed),
]
#: The trained and the evolved stages have no SQL; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each stage's rows are written and read again."""
    docs = staging.table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = staging.stage(stage(spark, docs, sf_dir))
    return docs
