"""Tokens, utterance scores and session feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.lexicon import FIRST_PERSON, MIXED_EMOTION, OTHER_PERSON, SELF_DISTANCING, TERMS, evidence, term_count, total, word_runs
from turnloom.functions.numeric import clamp, round_n

DIMENSIONS = ("self_agency", "future_orientation", "emotional_granularity", "problem_ownership", "reflection_depth")
AUXILIARY = ("hopelessness", "solution_focus", "absolutism", "self_focus_balance", "rumination")
FEATURES = DIMENSIONS + AUXILIARY
# Scores of an utterance without words.
EMPTY_SCORES = dict(zip(FEATURES, (0.5, 0.5, 0.25, 0.5, 0.2, 0.0, 0.0, 0.0, 0.8889, 0.0)))
EVIDENCE = {
    "self_agency+": "agency_active", "self_agency-": "agency_passive", "future_orientation+": "future", "future_orientation-": "rumination", "emotional_granularity+": "emotion_3", "emotional_granularity-": "emotion_1",
    "problem_ownership+": "ownership_internal", "problem_ownership-": "ownership_external", "reflection_depth+": "insight", "reflection_depth-": "absolutist", "hopelessness": "hopelessness",
}


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"^\s+|\s+$", ""), F.lit(" "))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def share(pos: Column, neg: Column) -> Column:
    """Smoothed positive share: 0.5 without evidence."""
    return (pos + F.lit(1.0)) / (pos + neg + F.lit(2.0))


def saturate(count: Column, half: float, n: Column) -> Column:
    """Rate per 100 words mapped to 0..1, one half at ``half``; 0 without words."""
    rate = F.try_divide(F.lit(100.0) * count, n)
    return F.when(n == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), rate / (rate + F.lit(half))))


def lexicon_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``toks``, ``n_words`` and a column c_<list> per word list, counted once."""
    low = df.withColumn("low_", padded(F.coalesce(F.col(text), F.lit(""))))
    low = low.withColumn("runs_", word_runs(F.col("low_")))
    counts = {f"c_{name}": term_count(F.col("low_"), F.col("runs_"), name) for name in TERMS}
    counts |= {"c_mixed": total(F.col("low_"), MIXED_EMOTION), "c_distance": total(F.col("low_"), SELF_DISTANCING), "toks": tokens(F.col("low_"))}
    own = low.withColumns(counts)
    among = lambda words: F.size(F.filter("toks", lambda t: t.isin(*words)))
    fine = F.array(*[F.lit(t) for t in TERMS["emotion_2"] + TERMS["emotion_3"]])
    return own.withColumns({
        "n_words": F.size("toks"), "c_first": among(FIRST_PERSON), "c_other": among(OTHER_PERSON), "c_distinct": F.size(F.array_intersect("toks", fine)),
    })


def score_utterances(df: DataFrame, text: str = "text", keep_evidence: bool = False) -> DataFrame:
    """``df`` with n_words, the ten scores (four decimals) and process_mean; a null text scores like the empty one."""
    own = lexicon_counts(df, text)
    c = lambda name: F.col(f"c_{name}").cast("double")
    n = F.col("n_words").cast("double")
    fine = c("emotion_2") + 2.0 * c("emotion_3") + 1.5 * c("mixed")
    depth = 2.0 * c("insight") + c("causal") + 0.75 * c("tentative") + c("distance")
    values = {
        "self_agency": share(c("agency_active"), c("agency_passive")),
        "future_orientation": share(c("future"), c("past") + 2.0 * c("rumination")),
        "emotional_granularity": F.least(F.lit(1.0), 0.5 * share(fine, 1.5 * c("emotion_1")) + 0.3 * saturate(0.25 * c("emotion_1") + fine, 3.0, n) + 0.2 * F.least(F.lit(1.0), c("distinct") / 4.0)),
        "problem_ownership": share(c("ownership_internal"), c("ownership_external") + 1.5 * c("self_blame")),
        "reflection_depth": F.least(F.lit(1.0), 0.6 * saturate(depth, 4.0, n) + 0.4 * share(depth, 1.5 * c("absolutist"))),
        "hopelessness": saturate(c("hopelessness"), 1.5, n),
        "solution_focus": saturate(c("solution_focus"), 2.0, n),
        "absolutism": saturate(c("absolutist"), 2.5, n),
        "self_focus_balance": F.greatest(F.lit(0.0), 1.0 - F.abs(share(c("first"), c("other")) - 0.55) / 0.45),
        "rumination": saturate(c("rumination"), 1.5, n),
    }
    scored = own.withColumns({k: round_n(v, 4) for k, v in values.items()})
    if keep_evidence:
        found = F.map_from_arrays(F.array(*[F.lit(k) for k in EVIDENCE]), F.array(*[evidence(F.col("low_"), v) for v in EVIDENCE.values()]))
        scored = scored.withColumn("evidence", F.map_filter(found, lambda _, v: F.size(v) > 0))
    mean = sum((F.col(d) for d in DIMENSIONS[1:]), F.col(DIMENSIONS[0])) / 5.0
    return scored.withColumn("process_mean", mean).drop("low_", "runs_", "toks", *[x for x in own.columns if x.startswith("c_") and x not in df.columns])


def session_features(utterances: DataFrame, *keys: str, min_words: int = 5) -> DataFrame:
    """One row per ``keys`` from scored client utterances: sqrt-length weighted means, turn and word counts.

    Utterances of fewer than ``min_words`` words only count where a session has no longer one. One aggregation computes both variants, so there is a single
    shuffle with map-side sums.
    """
    w = F.sqrt(F.greatest(F.lit(1.0), F.col("n_words").cast("double")))
    long_ = F.col("n_words") >= min_words
    aggs = [F.sum(F.when(long_, w)).alias("w_long"), F.sum(w).alias("w_all"), F.count(F.lit(1)).cast("double").alias("n_client_turns"), F.sum("n_words").cast("double").alias("n_client_words")]
    for f in FEATURES:
        aggs += [F.sum(F.when(long_, F.col(f) * w)).alias(f"{f}_long"), F.sum(F.col(f) * w).alias(f"{f}_all")]
    sums = utterances.groupBy(*keys).agg(*aggs)
    means = {f: round_n(F.when(F.col("w_long").isNotNull(), F.col(f"{f}_long") / F.col("w_long")).otherwise(F.col(f"{f}_all") / F.col("w_all")), 4) for f in FEATURES}
    mean_length = round_n(F.col("n_client_words") / F.greatest(F.lit(1.0), F.col("n_client_turns")), 2)
    return sums.select(*keys, *[v.alias(k) for k, v in means.items()], "n_client_turns", "n_client_words", mean_length.alias("mean_turn_length"))


def with_silent_sessions(sessions: DataFrame, features: DataFrame, *keys: str) -> DataFrame:
    """Features of every session; one without client speech scores like the empty utterance."""
    zero = dict.fromkeys(("n_client_turns", "n_client_words", "mean_turn_length"), 0.0)
    return sessions.select(*keys).distinct().join(features, list(keys), "left").fillna(EMPTY_SCORES | zero)


def drivers(utterances: DataFrame, *keys: str, order: str = "idx", k: int = 5, min_words: int = 12) -> DataFrame:
    """The ``k`` strongest and weakest longer utterances per session by process_mean, with their rank."""
    rich = utterances.where(F.col("n_words") >= min_words)
    top = rich.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("process_mean"), F.asc(order)))).withColumn("side", F.lit("strongest"))
    low = rich.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc("process_mean"), F.desc(order)))).withColumn("side", F.lit("weakest"))
    return top.where(F.col("rank") <= k).unionByName(low.where(F.col("rank") <= k))


def previous_text(turns: DataFrame, *keys: str, order: str = "idx", text: str = "text") -> DataFrame:
    """``turns`` with prev_text: what was said just before, by anyone; empty at the start."""
    w = Window.partitionBy(*keys).orderBy(order)
    return turns.withColumn("prev_text", F.coalesce(F.lag(text).over(w), F.lit("")))


def ml_lexicon_vector(scored: DataFrame, text: str = "text") -> DataFrame:
    """The ten scores, min(1, n/60) and whether a question is asked, as twelve columns v_1..v_12."""
    extra = [F.least(F.lit(1.0), F.col("n_words") / 60.0), F.contains(F.col(text), F.lit("?")).cast("double")]
    return scored.withColumns({f"v_{i}": c for i, c in enumerate([F.col(f) for f in FEATURES] + extra, 1)})


def clipped(x: Column) -> Column:
    return clamp(x, 0.0, 1.0)
