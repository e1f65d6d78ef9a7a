"""Corpus pipeline over documents: quality, language, near-duplicates, benchmark items, mixture.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before
kept and returns the columns of documents, the last one the mixture's. ``run``
writes what a stage returns as Parquet in the shared folder and reads it back
for the next.

All stages keep the columns of documents as they are, whatever extra columns
these have and however they are named. Null and empty texts are rated like any
text by the quality stage and have no language, so they go in the second stage.
Repeated rows and ties: one row stays, that of the smallest doc_id. An empty
table stays empty. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import decontaminate, langid, mixture, parity_join, quality
from weftline.llm.common import Scratch, hash_fold, table

#: Least calibrated probability of the language of a kept document.
LEAST_LANGUAGE_SCORE = 0.3


def _packed(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as a struct, so that an operator's own columns clash with none of the table's."""
    return docs.select("doc_id", "text", F.struct("*").alias("row"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts good."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(hash_fold("doc_id", 5) != 0))
    return quality.rate(_packed(docs), model).where("predicted = 1").select("row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified with some certainty; those without letters go, as do those in which no language has LEAST_LANGUAGE_SCORE."""
    model = langid.fit(docs.where(hash_fold("doc_id", 4) != 2))
    rated = langid.identify(_packed(docs), model)
    return rated.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)).select("row.*")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates."""
    return parity_join.near_duplicates_removed(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return decontaminate.decontaminate(_packed(docs), table(spark, sf_dir, "benchmark")).select("row.*")


def mixture_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words taken of each document for the target weights of the sources."""
    return mixture.mix(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("benchmark", benchmark_stage),
    ("mixture", mixture_stage),
]

#: Trained models and seeded choices are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), docs)
    return STAGES[-1][1](spark, docs, sf_dir)
