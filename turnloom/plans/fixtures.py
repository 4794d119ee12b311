"""Inputs that several queries share, as DataFrames and as SQL fragments for the twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.lexicon import FIRST_PERSON, INTERVENTIONS, MIXED_EMOTION, OTHER_PERSON, SELF_DISTANCING, TERMS, is_phrase
from turnloom.operators.score import DIMENSIONS, score_utterances
from turnloom.session import table

# Labels that name a role, as the parser compares them.
THERAPIST_LABELS = ("therapist", "t", "th", "counselor", "counsellor", "clinician", "doctor", "dr", "psychologist", "interviewer", "ellie", "helper")
CLIENT_LABELS = ("client", "c", "cl", "patient", "pt", "participant", "help-seeker", "helpseeker", "caller", "user")


EDGES = r"^[ \t\r\n]+|[ \t\r\n]+$"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, EDGES, "")


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, '{EDGES}', '', 'g')"


def plain_label(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z0-9_]", "")


def label_role(label: Column) -> Column:
    plain = plain_label(label)
    base = F.regexp_replace(plain, "[0-9_]+$", "")
    return F.when(plain.isin(*THERAPIST_LABELS) | base.isin(*THERAPIST_LABELS), "therapist").when(plain.isin(*CLIENT_LABELS) | base.isin(*CLIENT_LABELS), "client")


def space_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def corpus_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """annotated_corpus with one row per utterance (the latest loaded wins), known roles and visible text."""
    raw = table(spark, sf_dir, "annotated_corpus")
    w = Window.partitionBy("transcript_id", "utterance_id").orderBy(F.desc("loaded_at"), F.desc_nulls_last("utterance_text"), F.desc_nulls_last("interlocutor"))
    one = raw.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1")
    return one.select(
        "transcript_id", F.col("utterance_id").alias("idx"), label_role(F.col("interlocutor")).alias("speaker"), strip(F.col("utterance_text")).alias("text"),
        "spoken_at", "client_talk_type", F.col("main_therapist_behaviour").alias("behaviour"), "mi_quality",
    ).where("speaker is not null and text <> ''")


def scored_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns; only what the client says is scored on its words, a therapist's turn has the scores of silence and no process_mean."""
    turns = corpus_turns(spark, sf_dir).withColumn("n_space_words", space_words(F.col("text"))).withColumn("own_", F.when(F.col("speaker") == "client", F.col("text")))
    scored = score_utterances(turns, "own_").drop("own_")
    return scored.withColumn("process_mean", F.when(F.col("speaker") == "client", F.col("process_mean")))


def _in(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_role(label: str) -> str:
    plain = f"regexp_replace(lower({label}), '[^a-z0-9_]', '', 'g')"
    base = f"regexp_replace({plain}, '[0-9_]+$', '')"
    return (
        f"CASE WHEN {plain} IN ({_in(THERAPIST_LABELS)}) OR {base} IN ({_in(THERAPIST_LABELS)}) THEN 'therapist' "
        f"WHEN {plain} IN ({_in(CLIENT_LABELS)}) OR {base} IN ({_in(CLIENT_LABELS)}) THEN 'client' END"
    )


def sql_round(x: str, n: int) -> str:
    return f"(round_even(({x}) * {10**n}.0::DOUBLE, 0) / {10**n}.0::DOUBLE)"


CORPUS = f"""
corpus AS (
  SELECT transcript_id, utterance_id AS idx, {sql_role('interlocutor')} AS speaker, {sql_strip('utterance_text')} AS text, spoken_at, client_talk_type,
    main_therapist_behaviour AS behaviour, mi_quality
  FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id, utterance_id
          ORDER BY loaded_at DESC, utterance_text DESC NULLS LAST, interlocutor DESC NULLS LAST) AS rn FROM annotated_corpus)
  WHERE rn = 1 AND speaker IS NOT NULL AND text <> '')"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_term_count(low: str, name: str) -> str:
    """Term by term, straight from the definition."""
    parts = [f"(length({low}) - length(replace({low}, {_quote(t)}, ''))) // {len(t)}" for t in TERMS[name] if is_phrase(t)]
    parts += [f"len(regexp_extract_all({low}, {_quote(chr(92) + 'b' + t + chr(92) + 'b')}))" for t in TERMS[name] if not is_phrase(t)]
    return "(" + " + ".join(parts) + ")"


def sql_pattern_count(low: str, patterns: list[str]) -> str:
    return "(" + " + ".join(f"len(regexp_extract_all({low}, {_quote(p)}))" for p in patterns) + ")"


def sql_scored(source: str, text: str = "text", out: str = "scored") -> str:
    """CTEs that score ``source``: <out>_c with the counts and <out> with the scores."""
    sh = lambda p, n: f"(({p}) + 1.0::DOUBLE) / (({p}) + ({n}) + 2.0::DOUBLE)"

    def sat(count: str, half: float) -> str:
        rate = f"(100.0::DOUBLE * ({count}) / n_words)"
        return f"(CASE WHEN n_words = 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {rate} / ({rate} + {half}::DOUBLE)) END)"

    counts = ",\n    ".join(f"{sql_term_count('low', n)}::DOUBLE AS c_{n}" for n in TERMS)
    fine = "(c_emotion_2 + 2.0::DOUBLE * c_emotion_3 + 1.5::DOUBLE * c_mixed)"
    depth = "(2.0::DOUBLE * c_insight + c_causal + 0.75::DOUBLE * c_tentative + c_distance)"
    values = {
        "self_agency": sh("c_agency_active", "c_agency_passive"),
        "future_orientation": sh("c_future", "c_past + 2.0::DOUBLE * c_rumination"),
        "emotional_granularity": f"least(1.0::DOUBLE, 0.5::DOUBLE * {sh(fine, '1.5::DOUBLE * c_emotion_1')} + 0.3::DOUBLE * {sat('0.25::DOUBLE * c_emotion_1 + ' + fine, 3.0)} + 0.2::DOUBLE * least(1.0::DOUBLE, c_distinct / 4.0::DOUBLE))",
        "problem_ownership": sh("c_ownership_internal", "c_ownership_external + 1.5::DOUBLE * c_self_blame"),
        "reflection_depth": f"least(1.0::DOUBLE, 0.6::DOUBLE * {sat(depth, 4.0)} + 0.4::DOUBLE * {sh(depth, '1.5::DOUBLE * c_absolutist')})",
        "hopelessness": sat("c_hopelessness", 1.5),
        "solution_focus": sat("c_solution_focus", 2.0),
        "absolutism": sat("c_absolutist", 2.5),
        "self_focus_balance": f"greatest(0.0::DOUBLE, 1.0::DOUBLE - abs({sh('c_first', 'c_other')} - 0.55::DOUBLE) / 0.45::DOUBLE)",
        "rumination": sat("c_rumination", 1.5),
    }
    scores = ",\n    ".join(f"{sql_round(v, 4)} AS {k}" for k, v in values.items())
    mean = "(" + " + ".join(DIMENSIONS) + ") / 5.0::DOUBLE"
    return f"""
{out}_t AS (SELECT *, ' ' || lower(regexp_replace(coalesce({text}, ''), '^\\s+|\\s+$', '', 'g')) || ' ' AS low FROM {source}),
{out}_k AS (SELECT *, regexp_extract_all(low, '[a-z'']+') AS toks FROM {out}_t),
{out}_c AS (
  SELECT *, len(toks)::DOUBLE AS n_words,
    {counts},
    {sql_pattern_count('low', MIXED_EMOTION)}::DOUBLE AS c_mixed, {sql_pattern_count('low', SELF_DISTANCING)}::DOUBLE AS c_distance,
    len(list_filter(toks, lambda t: list_contains([{_in(FIRST_PERSON)}], t)))::DOUBLE AS c_first,
    len(list_filter(toks, lambda t: list_contains([{_in(OTHER_PERSON)}], t)))::DOUBLE AS c_other,
    len(list_distinct(list_filter(toks, lambda t: list_contains([{_in(TERMS['emotion_2'] + TERMS['emotion_3'])}], t))))::DOUBLE AS c_distinct
  FROM {out}_k),
{out}_v AS (SELECT * EXCLUDE (n_words), n_words, {scores} FROM {out}_c),
{out} AS (SELECT *, {mean} AS process_mean FROM {out}_v)"""


def sql_space_words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''))"


def sql_tag(text: str) -> str:
    whens = " ".join(
        f"WHEN regexp_matches(trim({text}), {_quote('(?i)' + '|'.join(f'(?:{p})' for p in patterns))}) THEN '{name}'" for name, patterns in INTERVENTIONS
    )
    return f"CASE {whens} WHEN ends_with(trim({text}), '?') THEN 'open_question' ELSE 'other' END"


TURNS = f"""
turns AS (SELECT * EXCLUDE (process_mean), CASE WHEN speaker = 'client' THEN process_mean END AS process_mean, {sql_space_words('text')} AS n_space_words FROM scored)"""
SCORED_CORPUS = f"WITH {CORPUS},{sql_scored('corpus')},{TURNS}"
