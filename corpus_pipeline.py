"""From raw documents to token ids: filter by language and quality, drop near copies and leaks, encode.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows its predecessor kept.  The first two judge each row by
itself, so equal ids and rows without an id are judged like any other; the next two judge by id, and rows without an id stay.  Stages that filter return
rows of ``docs`` with all their columns; the last returns the digests of the encoded documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxframe.llm import decontaminate as leaks
from luxframe.llm import language_id, ngram_join, quality_rules, sentencepiece_codec
from luxframe.llm.queries import PIECES
from luxframe.llm.textual import carried, prepare, released
from luxframe.session import checkpoint_folder

LEAST_LANGUAGE_SCORE = 0.4  # share of the text's letters in its main language


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without one main language, go."""
    prepare(spark)
    rows, kind = carried(docs)
    found = language_id.identify(rows, language_id.learn(docs), {"row": kind})
    clear = (F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return released(found.where(clear), docs)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the limits or the outlier rule reject go."""
    prepare(spark)
    rows, kind = carried(docs)
    return released(quality_rules.judge(rows, carry={"row": kind}).where("kept"), docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays."""
    prepare(spark)
    return ngram_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    prepare(spark)
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and checksums of ids and decoded texts."""
    prepare(spark)
    return sentencepiece_codec.digests(docs, PIECES)


STAGES = [
    ("language_id", identify_language),
    ("quality_rules", apply_quality_rules),
    ("ngram_join", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("sentencepiece", encode_pieces),
]
ORACLE_SQL = None  # the conditional field, the covariance estimate and the tokenizer are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    folder = f"{checkpoint_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
