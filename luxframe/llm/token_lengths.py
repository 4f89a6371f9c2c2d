"""Exact histogram of encoded lengths with suffix sums.

Documents are added up by encoded length (partial sums in the tasks, so a length that a third of all
documents share is one row per task).  The suffix sums of the histogram answer, for every context limit,
how many documents and ids lie at or beyond it and how many ids remain when longer documents are cut.
Sums run inside blocks of ``BLOCK`` lengths and over one row per block, so no task holds the histogram.

Null and empty texts are encoded as empty.  Repeated rows count each time.  No rows give no histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from luxframe.llm.sentencepiece_codec import Codec, read_model
from luxframe.llm.textual import map_texts

BLOCK = 1024


def encoded_lengths(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens`` with begin and end ids."""
    model = read_model(model_path)
    return map_texts(docs, lambda texts: [pa.array(Codec.of(model).lengths(texts))], "n_tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """``n_tokens, n_docs`` for every length that occurs."""
    return lengths.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def with_suffix_sums(counted: DataFrame) -> DataFrame:
    """Add, for a limit of ``n_tokens`` ids, what the documents of at least that length hold.

    ``docs_from``/``tokens_from``: documents that reach the limit and their ids;
    ``total_tokens``: ids of all documents; ``truncated_tokens``: ids that remain after cutting at the limit;
    ``docs_upto``: documents that fit.
    """
    weighed = counted.withColumn("tokens", F.col("n_tokens") * F.col("n_docs")).withColumn(
        "block", F.floor(F.col("n_tokens") / BLOCK)
    )
    later = W.orderBy(F.desc("block")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(F.lit(1))
    blocks = weighed.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("tokens").alias("t"))
    blocks = blocks.select(
        "block",
        *[F.coalesce(F.sum(c).over(later), F.lit(0)).alias(f"{c}_later") for c in "dt"],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in "dt"],
    )
    upward = W.partitionBy("block").orderBy(F.desc("n_tokens"))
    summed = weighed.join(blocks, "block").withColumns(
        {
            "docs_from": F.col("d_later") + F.sum("n_docs").over(upward),
            "tokens_from": F.col("t_later") + F.sum("tokens").over(upward),
        }
    )
    return summed.select(
        "n_tokens",
        "n_docs",
        "docs_from",
        "tokens_from",
        F.col("t_all").alias("total_tokens"),
        (F.col("t_all") - F.col("tokens_from") + F.col("docs_from") * F.col("n_tokens")).alias("truncated_tokens"),
        (F.col("d_all") - F.col("docs_from") + F.col("n_docs")).alias("docs_upto"),
    )


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """Smallest length that at least ``share`` of all documents do not exceed; null without documents."""
    total = F.col("docs_upto") + F.col("docs_from") - F.col("n_docs")
    return sums.where(F.col("docs_upto") >= F.ceil(total * F.lit(share))).agg(F.min("n_tokens").alias("n_tokens"))


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """Documents beyond ``limit`` ids, and ids that remain after cutting there, for any limit.

    The nearest occurring length at or above the limit knows all that lies beyond it.
    """
    beyond = F.col("n_tokens") >= limit
    docs, tokens = (F.coalesce(F.max(F.when(beyond, F.col(c))), F.lit(0)) for c in ("docs_from", "tokens_from"))
    total = F.coalesce(F.max("total_tokens"), F.lit(0))
    return sums.agg(docs.alias("docs_from"), (total - tokens + docs * limit).alias("truncated_tokens"))
