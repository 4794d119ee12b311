"""From transcripts to the index: parse, score, aggregate, standardise against the client's own baseline, and follow over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.operators import trajectory as T
from turnloom.operators.index import COHORT_SD, WEIGHTS, absolute_index, baselines, confidence_notes, index_sessions
from turnloom.operators.parse import CLIENT_LABELS, LABEL, LEADING_STAMP, THERAPIST_LABELS, guess_speaker, merge_speaker_runs, parse_transcripts
from turnloom.operators.score import AUXILIARY, DIMENSIONS, EMPTY_SCORES, FEATURES, score_utterances, session_features, with_silent_sessions
from turnloom.plans.fixtures import _in, sql_role, sql_round as R, sql_scored, sql_space_words
from turnloom.plans.scoring import SESSION_VECTORS
from turnloom.plans.series import _LAST6, _X6, sql_trend
from turnloom.session import cut, table

KEYS = ("client_id", "session_number")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transcript per client and session number: the latest uploaded wins; at least 20 characters of text."""
    t = table(spark, sf_dir, "transcripts")
    w = Window.partitionBy(*KEYS).orderBy(F.desc("created_at"), F.desc("session_id"))
    one = t.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1")
    return one.select(*KEYS, "transcript").where(F.length(F.regexp_replace("transcript", r"^[ \t\r\n]+|[ \t\r\n]+$", "")) >= 20)


def parsed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_transcripts(sessions(spark, sf_dir), *KEYS)[0]


def parse_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_transcripts(sessions(spark, sf_dir), *KEYS)[1]


def _features(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sessions(spark, sf_dir)
    client = parse_transcripts(s, *KEYS)[0].where("speaker = 'client'")
    return with_silent_sessions(s, session_features(score_utterances(client), *KEYS), *KEYS)


def transcript_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _features(spark, sf_dir)


def client_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines(_features(spark, sf_dir))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = cut(_features(spark, sf_dir))  # one small row per session, used twice
    return index_sessions(f, baselines(f))


def index_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, parts = [f"z_{d}" for d in DIMENSIONS], [f"contribution_{d}" for d in DIMENSIONS]
    return _indexed(spark, sf_dir).select(*KEYS, *z, *parts, "tpi", "confidence")


def index_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _indexed(spark, sf_dir)
    return x.select(*KEYS, "confidence", F.array_join(confidence_notes(F.col("n_client_words"), F.col("n_client_turns"), F.col("provisional")), "; ").alias("notes"))


def absolute_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = absolute_index(_features(spark, sf_dir))
    return a.select(*KEYS, "absolute_tpi", "absolute_confidence", *[f"part_{d}" for d in DIMENSIONS], *[f"abs_z_{d}" for d in DIMENSIONS])


def index_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the momentum of every client's index."""
    return T.momentum(T.positions(_indexed(spark, sf_dir), "client_id", "session_number", "tpi"), "client_id")


def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_speaker_runs(table(spark, sf_dir, "utterances_raw").distinct(), "session_id")


def speaker_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = table(spark, sf_dir, "utterances_raw").distinct()
    return u.select("session_id", "idx", guess_speaker(F.coalesce("text", F.lit("")), F.col("idx")).alias("guess"))


QUERIES = {
    "parsed_turns": parsed_turns, "parse_info": parse_info, "transcript_features": transcript_features, "client_baselines": client_baselines, "index_series": index_series,
    "index_confidence": index_confidence, "absolute_scores": absolute_scores, "index_momentum": index_momentum, "speaker_runs": speaker_runs, "speaker_guess": speaker_guess,
}

_re = lambda p: "'" + p.replace("'", "''") + "'"
_ENDS = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"
_SESSIONS = """
sess AS (SELECT client_id, session_number, transcript FROM (SELECT *, row_number() OVER (PARTITION BY client_id, session_number ORDER BY created_at DESC, session_id DESC) AS rn FROM transcripts)
  WHERE rn = 1 AND length(regexp_replace(transcript, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')) >= 20)"""
PARSE = f"""{_SESSIONS},
sl AS (SELECT client_id, session_number, regexp_split_to_array(transcript, {_ENDS}) AS l FROM sess),
ln AS (SELECT client_id, session_number, unnest(l) AS line, unnest(range(len(l))) AS pos FROM sl),
lb AS (SELECT *, regexp_replace(line, {_re(LEADING_STAMP)}, '') AS bare FROM ln WHERE regexp_matches(line, '[^\\s\\x0b]')),
lc AS (SELECT client_id, session_number, pos, nullif(regexp_extract(bare, {_re(LABEL)}, 1), '') AS raw_label,
  regexp_replace(CASE WHEN regexp_extract(bare, {_re(LABEL)}, 1) <> '' THEN regexp_extract(bare, {_re(LABEL)}, 2) ELSE line END, '^[\\s\\x0b]+|[\\s\\x0b]+$', '', 'g') AS said FROM lb),
ld AS (SELECT *, count(raw_label) OVER (PARTITION BY client_id, session_number ORDER BY pos) AS turn FROM lc),
rw AS (SELECT client_id, session_number, turn - 1 AS idx, max(raw_label) AS raw_label, regexp_replace(string_agg(said, ' ' ORDER BY pos), '^ ', '') AS text FROM ld WHERE turn > 0 GROUP BY client_id, session_number, turn),
rl AS (SELECT *, regexp_replace(lower(raw_label), '[^a-z0-9_]', '', 'g') AS label, {sql_role('raw_label')} AS known FROM rw),
sa AS (SELECT client_id, session_number, label, max(known) AS known, avg(length(text) - length(replace(text, '?', ''))) AS asks, avg({sql_space_words('text')}) AS words FROM rl GROUP BY ALL),
ro AS (SELECT *, coalesce(known, CASE WHEN row_number() OVER (PARTITION BY client_id, session_number, known IS NULL ORDER BY asks DESC, words, label) = 1
    AND count(*) OVER (PARTITION BY client_id, session_number, known IS NULL) > 1 THEN 'therapist' ELSE 'client' END) AS speaker FROM sa),
trn AS (SELECT client_id, session_number, idx::INT AS idx, ro.speaker, raw_label, text FROM rl JOIN ro USING (client_id, session_number, label) WHERE text <> '')"""
_FEAT = f"""{PARSE},
cl AS (SELECT client_id, session_number, text FROM trn WHERE speaker = 'client'),{sql_scored('cl')},
fs AS ({SESSION_VECTORS.replace('transcript_id', 'client_id, session_number')}),
feat AS (SELECT s.client_id, s.session_number, {', '.join(f'coalesce({k}, {v}::DOUBLE) AS {k}' for k, v in {**EMPTY_SCORES, **dict.fromkeys(('n_client_turns', 'n_client_words', 'mean_turn_length'), 0.0)}.items())}
  FROM (SELECT DISTINCT client_id, session_number FROM sess) s LEFT JOIN fs USING (client_id, session_number))"""
_lam = "(n_baseline / (n_baseline + 3.0::DOUBLE))"
_BASE = f"""{_FEAT},
f2 AS (SELECT *, row_number() OVER (PARTITION BY client_id ORDER BY session_number) AS rn FROM feat),
b1 AS (SELECT client_id, count(*) AS n_baseline, {', '.join(f'sum(round({d} * 10000)::BIGINT)::DOUBLE / count(*) / 10000.0::DOUBLE AS m_{d}, coalesce(stddev_samp({d}), 0.0) AS s_{d}' for d in DIMENSIONS)} FROM f2 WHERE rn <= 2 GROUP BY client_id),
base AS (SELECT client_id, {', '.join(f'{R(f"m_{d}", 4)} AS mu_{d}, {R(f"greatest(0.015::DOUBLE, {_lam} * s_{d} + (1 - {_lam}) * {COHORT_SD[d]}::DOUBLE)", 4)} AS sd_{d}' for d in DIMENSIONS)}, n_baseline, n_baseline < 2 AS provisional FROM b1)"""
_conf = lambda prov: R(f"least(1.0::DOUBLE, CASE WHEN n_client_words < 300 THEN 0.55::DOUBLE WHEN n_client_words < 800 THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN n_client_turns < 10 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END * CASE WHEN {prov} THEN 0.6::DOUBLE ELSE 1.0::DOUBLE END)", 3)
_IDX = f"""{_BASE},
z1 AS (SELECT feat.*, provisional, {', '.join(f'{R(f"({d} - mu_{d}) / sd_{d}", 4)} AS z_{d}' for d in DIMENSIONS)} FROM feat JOIN base USING (client_id)),
z2 AS (SELECT *, {', '.join(f'{R(f"{10.0 * WEIGHTS[d]!r}::DOUBLE * z_{d}", 3)} AS contribution_{d}' for d in DIMENSIONS)} FROM z1),
idx AS (SELECT *, {R('greatest(0.0::DOUBLE, least(100.0::DOUBLE, 50.0::DOUBLE + ' + ' + '.join(f'contribution_{d}' for d in DIMENSIONS) + '))', 2)} AS tpi, {_conf('provisional')} AS confidence FROM z2)"""
_abs = " + ".join(["0.0::DOUBLE", *[f"{WEIGHTS[d]}::DOUBLE * {d}" for d in DIMENSIONS]])
MOMENTUM = f"""series AS (SELECT client_id, row_number() OVER (PARTITION BY client_id ORDER BY session_number) AS n, tpi AS y, count(*) OVER (PARTITION BY client_id) AS total FROM idx), {_LAST6},{sql_trend('o', 'series', '(n - 1)', 'o_')},{sql_trend('rc', 'last6', _X6, 'r_')},
vol AS (SELECT client_id, max(total) AS n, max(y) - min(y) AS spread, coalesce(stddev_samp(y), 0.0) AS vol, avg(y) FILTER (n > total - 3) AS r3 FROM last6 GROUP BY client_id),
mom AS (SELECT client_id, n, CASE WHEN n < 3 THEN 'insufficient_data'
    WHEN (r_slope > 1.0 AND r_p < 0.20) OR (r_slope > 0.6 AND o_slope > 0.4 AND o_p < 0.15) THEN 'gaining'
    WHEN (-r_slope > 1.0 AND r_p < 0.20) OR (-r_slope > 0.6 AND -o_slope > 0.4 AND o_p < 0.15) THEN 'regressing'
    WHEN spread < 6.0 OR abs(r_slope) <= 0.25 THEN 'plateauing' ELSE 'steady' END AS state,
  CASE WHEN n >= 3 THEN {R('r3', 2)} END AS recent_mean, CASE WHEN n >= 3 THEN {R('vol', 2)} END AS volatility, r_slope, o_slope
FROM vol JOIN o USING (client_id) JOIN rc USING (client_id))"""
SQL = {
    "parsed_turns": f"WITH {PARSE} SELECT * FROM trn",
    "parse_info": f"""WITH {PARSE}, ig AS (SELECT client_id, session_number, count(*) FILTER (turn = 0) AS n_ignored FROM ld GROUP BY ALL),
fo AS (SELECT client_id, session_number, count(*) AS n_labels, bool_or(known IS NULL) AS inferred, min(speaker) = max(speaker) AS single_role FROM ro GROUP BY ALL)
SELECT ig.*, coalesce(n_labels, 0) AS n_labels, coalesce(inferred, false) AS inferred, coalesce(single_role, true) AS single_role FROM ig LEFT JOIN fo USING (client_id, session_number)""",
    "transcript_features": f"WITH {_FEAT} SELECT client_id, session_number, {', '.join(FEATURES)}, n_client_turns, n_client_words, mean_turn_length FROM feat",
    "client_baselines": f"WITH {_BASE} SELECT * FROM base",
    "index_series": f"WITH {_IDX} SELECT client_id, session_number, {', '.join(f'z_{d}, contribution_{d}' for d in DIMENSIONS)}, tpi, confidence FROM idx",
    "index_confidence": f"""WITH {_IDX} SELECT client_id, session_number, confidence, concat_ws('; ', CASE WHEN n_client_words < 300 THEN 'few client words: noisy' WHEN n_client_words < 800 THEN 'short session: read with care' END,
  CASE WHEN n_client_turns < 10 THEN 'few client turns' END, CASE WHEN provisional THEN 'baseline still provisional' END) AS notes FROM idx""",
    "absolute_scores": f"""WITH {_FEAT} SELECT client_id, session_number, {R(f'greatest(0.0::DOUBLE, least(100.0::DOUBLE, 100.0::DOUBLE * ({_abs})))', 2)} AS absolute_tpi, {_conf('true')} AS absolute_confidence,
  {', '.join(f'{R(f"100.0::DOUBLE * {WEIGHTS[d]}::DOUBLE * {d}", 3)} AS part_{d}, {R(f"({d} - 0.5::DOUBLE) / {COHORT_SD[d]}::DOUBLE", 4)} AS abs_z_{d}' for d in DIMENSIONS)} FROM feat""",
    "index_momentum": f"WITH {_IDX}, {MOMENTUM} SELECT * FROM mom",
    "speaker_runs": """WITH u AS (SELECT DISTINCT * FROM utterances_raw), s AS (SELECT session_id, idx, coalesce(speaker, 'client') AS speaker, text FROM u WHERE ltrim(rtrim(text, ' '), ' ') <> ''),
n AS (SELECT *, coalesce((lag(speaker) OVER (PARTITION BY session_id ORDER BY idx) <> speaker)::INT, 1) AS f FROM s), r AS (SELECT *, sum(f) OVER (PARTITION BY session_id ORDER BY idx) AS turn_no FROM n)
SELECT session_id, turn_no, min(speaker) AS speaker, count(*) AS n_lines, string_agg(text, ' ' ORDER BY idx, text) AS text FROM r GROUP BY session_id, turn_no""",
    "speaker_guess": "SELECT session_id, idx, CASE WHEN ends_with(rtrim(coalesce(text, ''), ' '), '?') OR ends_with(rtrim(coalesce(text, ''), ' '), '？') OR idx = 0 THEN 'therapist' ELSE 'client' END AS guess FROM (SELECT DISTINCT * FROM utterances_raw)",
}
