"""The queries of this package over the given tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from luxframe.llm import (
    arrow_sequences,
    chat_format,
    decontaminate,
    language_id,
    lm_score,
    ngram_join,
    quality_rules,
    rank_queue_bpe,
    rule_classifier,
    sentencepiece_codec,
    token_alignment,
    token_lengths,
    vector_codes,
)
from luxframe.llm.textual import prepare, scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
EXTRA_CHAT = "</s>[INST] ok [/INST]"


def query(run: Query) -> Query:
    def call(spark: SparkSession, folder: str) -> DataFrame:
        prepare(spark)
        return run(spark, folder)

    QUERIES[run.__name__] = call
    return call


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@query
def op1_sentencepiece(spark, folder):
    return sentencepiece_codec.digests(table(spark, folder, "documents"), PIECES)


@query
def op2_chat_format(spark, folder):
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXTRA_CHAT).alias("text"),
    )
    return chat_format.digests(scratch(chat_format.format_chats(given.unionByName(extra))))


def _escaped(column: str) -> str:
    text = f"replace({column}, '\\', '\\\\')"
    for control in chat_format.Template().controls:
        text = f"replace({text}, '{control}', '{control[0]}\\{control[1:]}')"
    return text


_SHAPE = chat_format.Template()
ORACLES["op2_chat_format"] = f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA_CHAT}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_CHAT}'
), placed AS (
  SELECT *, coalesce(lag(role) OVER w, 'start') AS before, lead(role) OVER w IS NULL AS last
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text))
    AS loss_sha256,
  sum({len(_SHAPE.head) + 1 + len(_SHAPE.tail)} + length(replace({_escaped("role")}, chr(10), '\\' || chr(10)))
    + length({_escaped("text")}))::BIGINT AS formatted_chars,
  bool_and(CASE before WHEN 'start' THEN role IN ('system', 'user') WHEN 'system' THEN role = 'user'
    WHEN 'user' THEN role = 'assistant' WHEN 'assistant' THEN role = 'user' ELSE false END
    AND (NOT last OR role IN ('user', 'assistant'))) AS valid
FROM placed GROUP BY conv_id
"""


@query
def op3_lm_score(spark, folder):
    return lm_score.score(table(spark, folder, "documents"))


@query
def op4_quality_rules(spark, folder):
    return quality_rules.judge(table(spark, folder, "documents")).drop("lang", "source")


@query
def op5_language_id(spark, folder):
    return language_id.predict(table(spark, folder, "documents"))


@query
def op6_ngram_join(spark, folder):
    return ngram_join.link(table(spark, folder, "documents"))


@query
def op7_token_lengths(spark, folder):
    lengths = token_lengths.encoded_lengths(table(spark, folder, "documents"), PIECES)
    return token_lengths.with_suffix_sums(scratch(token_lengths.histogram(lengths)))


@query
def op8_rule_classifier(spark, folder):
    return rule_classifier.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query
def op9_arrow_sequences(spark, folder):
    return arrow_sequences.digests(table(spark, folder, "documents"), BYTES)


@query
def op10_decontaminate(spark, folder):
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query
def op11_rank_queue_bpe(spark, folder):
    return rank_queue_bpe.digests(table(spark, folder, "documents"), RANKS, public_tokenizers.PATTERN)


@query
def op12_token_alignment(spark, folder):
    return token_alignment.digests(table(spark, folder, "documents"), BYTES, PIECES)


@query
def op13_vector_codes(spark, folder):
    return vector_codes.digests(table(spark, folder, "embeddings"))


def _lloyd_sql() -> str:
    """Every distance of every round, without the short way of the operator."""
    parts, entries = vector_codes.PARTS, vector_codes.ENTRIES
    steps = [
        f"""odd AS (SELECT DISTINCT vec_id FROM (SELECT vec_id, UNNEST(embedding) AS x FROM embeddings) WHERE x IS NULL OR NOT isfinite(x)),
vec AS (SELECT vec_id, label, len(embedding) // {parts} AS wide, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id NOT IN (SELECT vec_id FROM odd)),
cmp AS (SELECT vec_id, (i - 1) // wide AS place, (i - 1) % wide AS j, CAST(floor({vector_codes.SCALE} * CAST(x AS DOUBLE)) AS BIGINT) AS v
  FROM (SELECT vec_id, wide, UNNEST(embedding) AS x, UNNEST(range(1, len(embedding) + 1)) AS i FROM vec)),
first_ids AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM vec QUALIFY entry < {entries}),
book0 AS (SELECT place, entry, j, v AS c FROM cmp JOIN first_ids USING (vec_id))"""
    ]
    for k in range(vector_codes.ROUNDS + 1):
        steps.append(
            f"""dist{k} AS (SELECT vec_id, place, entry, CAST(sum((v - c) * (v - c)) AS BIGINT) AS d
  FROM cmp JOIN book{k} USING (place, j) GROUP BY ALL),
near{k} AS (SELECT vec_id, place, entry, d FROM dist{k}
  QUALIFY row_number() OVER (PARTITION BY vec_id, place ORDER BY d, entry) = 1)"""
        )
        if k < vector_codes.ROUNDS:
            steps.append(
                f"""mean{k} AS (SELECT place, entry, j, sum(v)::BIGINT AS total, count(*) AS n
  FROM cmp JOIN near{k} USING (vec_id, place) GROUP BY ALL),
book{k + 1} AS (SELECT b.place, b.entry, b.j,
  coalesce((total - ((total % n) + n) % n) // n, c) AS c FROM book{k} b LEFT JOIN mean{k} m ON m.place = b.place AND m.entry = b.entry AND m.j = b.j)"""
            )
    last = vector_codes.ROUNDS
    return f"""WITH {", ".join(steps)},
coded AS (SELECT vec_id, string_agg(printf('%02x', entry), '' ORDER BY place) AS code, sum(d)::BIGINT AS error FROM near{last} GROUP BY ALL),
labelled AS (SELECT vec.vec_id, label, code, error FROM coded JOIN vec USING (vec_id))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY place, entry, j)) FROM book{last}) AS codebooks_sha256 FROM labelled"""


ORACLES["op13_vector_codes"] = _lloyd_sql()


@query
def pipeline(spark, folder):
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


