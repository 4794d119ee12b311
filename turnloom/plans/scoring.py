"""Queries that score utterances and sessions of the annotated corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.functions.lexicon import TERMS
from turnloom.operators.score import FEATURES, drivers, lexicon_counts, ml_lexicon_vector, previous_text, score_utterances, session_features, tokens
from turnloom.plans.fixtures import CORPUS, SCORED_CORPUS, corpus_turns, sql_round, sql_scored, space_words, sql_space_words
from turnloom.session import table


def _client(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_turns(spark, sf_dir).where("speaker = 'client'").select("transcript_id", "idx", "text")


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus_turns(spark, sf_dir)
    return t.select("transcript_id", "idx", F.size(tokens(F.col("text"))).alias("n_tokens"), space_words(F.col("text")).alias("n_space_words"))


def lexicon_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = lexicon_counts(corpus_turns(spark, sf_dir).select("transcript_id", "text"))
    names = [f"c_{n}" for n in TERMS] + ["c_mixed", "c_distance"]
    return counted.groupBy("transcript_id").agg(*[F.sum(F.col(c).cast("double")).alias(c) for c in names])


def utterance_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_utterances(_client(spark, sf_dir)).select("transcript_id", "idx", F.col("n_words").cast("double").alias("n_words"), *FEATURES, "process_mean")


def document_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents, whatever its stored label: the label is null, wrong or in capitals at times, and scoring does not need it."""
    return score_utterances(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.col("n_words").cast("double").alias("n_words"), *FEATURES)


def ml_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ml_lexicon_vector(score_utterances(_client(spark, sf_dir))).select("transcript_id", "idx", *[f"v_{i}" for i in range(1, 13)])


def session_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session_features(score_utterances(_client(spark, sf_dir)), "transcript_id")


def driver_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drivers(score_utterances(_client(spark, sf_dir)), "transcript_id").select("transcript_id", "side", "rank", "idx", "process_mean", F.substring("text", 1, 600).alias("text"))


def prev_utterance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return previous_text(corpus_turns(spark, sf_dir), "transcript_id").where("speaker = 'client'").select("transcript_id", "idx", "prev_text")


QUERIES = {
    "token_counts": token_counts, "lexicon_totals": lexicon_totals, "utterance_scores": utterance_scores, "document_scores": document_scores,
    "ml_vector": ml_vector,
    "session_vectors": session_vectors, "driver_turns": driver_turns, "prev_utterance": prev_utterance,
}

_CLIENT = f"WITH {CORPUS}, client AS (SELECT transcript_id, idx, text FROM corpus WHERE speaker = 'client'),{sql_scored('client')}"
_W = "sqrt(greatest(1.0::DOUBLE, n_words))"
_mean = lambda f: sql_round(
    f"CASE WHEN sum({_W}) FILTER (n_words >= 5) IS NOT NULL THEN sum({f} * {_W}) FILTER (n_words >= 5) / sum({_W}) FILTER (n_words >= 5) ELSE sum({f} * {_W}) / sum({_W}) END", 4
)
SESSION_VECTORS = f"""SELECT transcript_id, {', '.join(f'{_mean(f)} AS {f}' for f in FEATURES)},
  count(*)::DOUBLE AS n_client_turns, sum(n_words) AS n_client_words, {sql_round('sum(n_words) / greatest(1.0::DOUBLE, count(*)::DOUBLE)', 2)} AS mean_turn_length
FROM scored GROUP BY transcript_id"""
SQL = {
    "token_counts": f"WITH {CORPUS} SELECT transcript_id, idx, len(regexp_extract_all(lower(text), '[a-z'']+')) AS n_tokens, {sql_space_words('text')} AS n_space_words FROM corpus",
    "lexicon_totals": f"WITH {CORPUS},{sql_scored('corpus')} SELECT transcript_id, {', '.join(f'sum(c_{n}) AS c_{n}' for n in [*TERMS, 'mixed', 'distance'])} FROM scored_c GROUP BY transcript_id",
    "utterance_scores": f"{_CLIENT} SELECT transcript_id, idx, n_words, {', '.join(FEATURES)}, process_mean FROM scored",
    "document_scores": f"WITH d AS (SELECT doc_id, text FROM documents),{sql_scored('d')} SELECT doc_id, n_words, {', '.join(FEATURES)} FROM scored",
    "ml_vector": f"{_CLIENT} SELECT transcript_id, idx, {', '.join(f'{f} AS v_{i}' for i, f in enumerate(FEATURES, 1))}, least(1.0::DOUBLE, n_words / 60.0::DOUBLE) AS v_11, contains(text, '?')::INT::DOUBLE AS v_12 FROM scored",
    "session_vectors": f"{_CLIENT} {SESSION_VECTORS}",
    "driver_turns": f"""{_CLIENT}, r AS (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY process_mean DESC, idx) AS hi,
  row_number() OVER (PARTITION BY transcript_id ORDER BY process_mean, idx DESC) AS lo FROM scored WHERE n_words >= 12)
SELECT transcript_id, 'strongest' AS side, hi AS rank, idx, process_mean, substr(text, 1, 600) AS text FROM r WHERE hi <= 5
UNION ALL SELECT transcript_id, 'weakest', lo, idx, process_mean, substr(text, 1, 600) FROM r WHERE lo <= 5""",
    "prev_utterance": f"WITH {CORPUS}, p AS (SELECT *, coalesce(lag(text) OVER (PARTITION BY transcript_id ORDER BY idx), '') AS prev_text FROM corpus) SELECT transcript_id, idx, prev_text FROM p WHERE speaker = 'client'",
}
