"""Queries that place measurements beside turns, and that describe and fuse the channels of a session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnloom.functions.numeric import round_n
from turnloom.operators import align as A
from turnloom.operators import signals as S
from turnloom.operators.store import latest_wins
from turnloom.plans.fixtures import space_words, sql_round as R, sql_space_words
from turnloom.session import table


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "aligned_turns").where("session_id is not null and idx is not null and start_s >= 0 and not isnan(start_s) and not isnan(end_s) and end_s > start_s")
    one = latest_wins(t, ["session_id", "idx"], F.asc("start_s"), F.asc("end_s"), F.desc_nulls_last("text"))
    return one.select("session_id", "idx", "speaker", "start_s", "end_s", "timing_source", "process_mean", space_words(F.coalesce("text", F.lit(""))).alias("n_words"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A track of speech rates, one sample in the middle of each turn."""
    t = _turns(spark, sf_dir)
    return t.select("session_id", round_n((F.col("start_s") + F.col("end_s")) / 2, 3).alias("t"), (F.col("n_words") / (F.col("end_s") - F.col("start_s"))).alias("rate"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points five seconds after each turn begins."""
    return _turns(spark, sf_dir).select("session_id", round_n(F.col("start_s") + 5.0, 3).alias("t")).distinct()


def _track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as frames of a pose track."""
    e = table(spark, sf_dir, "events").where("value is not null")
    f = e.groupBy("user_id", F.unix_timestamp("ts").alias("t")).agg(F.max("value").alias("v"), F.min("value").alias("u"), F.max((F.col("event_type") == "click").cast("int")).alias("c"))
    return f.select(
        "user_id", "t", F.col("v").alias("gesture_amplitude"), (F.col("u") / 2).alias("head_motion"), (F.col("v") / (F.col("u") + 1)).alias("posture_openness"), ((F.col("v") - 20) / 100).alias("lean"),
        (F.col("c") == 1).alias("arms_crossed"), (F.col("v") >= 1).alias("pose_present"),
    )


def line_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "utterances_raw").distinct().select("session_id", "idx", A.stamp_seconds(F.col("text")).alias("at_s")).where("at_s is not null").distinct()


def turn_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _turns(spark, sf_dir)
    return A.positional_times(t, t, "session_id", "idx")


def timing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _turns(spark, sf_dir).groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n_turns"), F.sum((F.col("timing_source") == "explicit").cast("int")).alias("n_stamps"), F.sum((F.col("timing_source") == "diarisation").cast("int")).alias("n_segments"), F.max("end_s").alias("duration"),
    )
    return s.select("session_id", "n_turns", A.timing_source(F.col("n_turns"), F.coalesce("n_stamps", F.lit(0)), F.coalesce("n_segments", F.lit(0)), F.col("duration")).alias("source"))


def moment_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.linked_moments(_points(spark, sf_dir), _turns(spark, sf_dir), "session_id")


def turn_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.slice_means(_turns(spark, sf_dir), _samples(spark, sf_dir), "session_id", "rate")
    return s.withColumn("mean_value", round_n(F.col("mean_value"), 4))


def convergent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.convergences(_turns(spark, sf_dir), _samples(spark, sf_dir), "session_id", "rate")


def moment_utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.turn_at(_points(spark, sf_dir), _turns(spark, sf_dir), "session_id")


def moment_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.nearest_within(_points(spark, sf_dir), _turns(spark, sf_dir).select("session_id", F.col("start_s").alias("preview_t")), "session_id")


def track_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.signal_summary(_track(spark, sf_dir), "user_id")


def track_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.moment_tags(_track(spark, sf_dir), "user_id").select("user_id", "t", "tags")


def track_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.visual_z(_track(spark, sf_dir), "user_id")


def _voice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech rate and pauses of the client's turns, and the index of what is said, per session."""
    t = _turns(spark, sf_dir)
    w = Window.partitionBy("session_id").orderBy("start_s", "idx")
    t = t.withColumn("pause", F.greatest(F.lit(0.0), F.col("start_s") - F.lag("end_s").over(w)))
    said = F.col("speaker") == "client"
    score = F.when(said & ~F.isnan("process_mean"), F.col("process_mean"))
    return t.groupBy("session_id").agg(
        round_n(F.try_divide(F.sum(F.when(said, F.col("n_words"))) * 1.4, F.sum(F.when(said, F.col("end_s") - F.col("start_s")))), 6).alias("syllable_rate"), round_n(F.sum("pause") / F.max("end_s"), 6).alias("pause_ratio"),
        round_n(F.max("pause"), 6).alias("longest_pause_s"), round_n(100 * F.avg(score), 4).alias("tpi"),
    )


def session_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of each session's words, shifted by the voice and, where there is a track of the same number, by the picture."""
    v = _voice(spark, sf_dir)
    picture = S.visual_z(_track(spark, sf_dir), "user_id").withColumnRenamed("user_id", "session_id")
    j = v.join(picture, "session_id", "left")
    a, n_a = S.channel_score({k: S.norm_z(F.col(k), k) for k in ("syllable_rate", "pause_ratio", "longest_pause_s")}, S.ACOUSTIC_SIGNS)
    p, n_p = S.channel_score({k: F.col(f"{k}_z") for k in ("expressivity_range", "gesture_amplitude", "head_motion", "posture_openness", "arms_crossed_ratio")}, S.VISUAL_SIGNS)
    f = j.select("session_id", "tpi", round_n(a, 4).alias("az"), round_n(p, 4).alias("vz"), n_a.alias("n_voice"), n_p.alias("n_picture"), F.lit(0.8).alias("conf"))
    mode = S.input_mode(F.col("tpi").isNotNull(), F.col("az").isNotNull(), F.col("vz").isNotNull())
    out = S.fuse(f, "tpi", "az", "vz", "conf")
    return out.select("session_id", "az", "vz", "n_voice", "n_picture", "fused", "shift", "modalities", "agreement", S.index_without_text(F.col("az"), F.col("vz")).alias("without_text"), mode.alias("mode"))


def frame_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of a label as a series of frames: fourteen coordinates are seven landmarks."""
    names = [f"{p}_{x}" for p in ("ls", "rs", "lw", "rw", "le", "re", "nose") for x in "xy"]
    e = table(spark, sf_dir, "embeddings").select("label", "vec_id", *[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    g = S.pose_geometry(e, "label", t="vec_id")
    return g.select("label", "vec_id", *[round_n(F.col(c), 4).alias(c) for c in ("gesture_amplitude", "head_motion", "posture_openness", "lean")], "arms_crossed")


def vector_loudness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coordinate of a vector as a sample."""
    return S.loudness(table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double")), "vec_id")


_names = """line_stamps turn_positions timing_sources moment_links turn_slices convergent_turns moment_utterances moment_previews track_summary track_tags track_z session_fusion
frame_geometry vector_loudness""".split()
QUERIES = {n: globals()[n] for n in _names}

_T = f"""turns AS (SELECT session_id, idx, speaker, start_s, end_s, timing_source, process_mean, {sql_space_words("coalesce(text, '')")} AS n_words FROM (
  SELECT *, row_number() OVER (PARTITION BY session_id, idx ORDER BY start_s, end_s, text DESC NULLS LAST) AS rn FROM aligned_turns
  WHERE session_id IS NOT NULL AND idx IS NOT NULL AND start_s >= 0 AND NOT isnan(start_s) AND NOT isnan(end_s) AND end_s > start_s) WHERE rn = 1),
smp AS (SELECT session_id, {R('(start_s + end_s) / 2', 3)} AS t, n_words / (end_s - start_s) AS rate FROM turns),
pts AS (SELECT DISTINCT session_id, {R('start_s + 5.0::DOUBLE', 3)} AS t FROM turns)"""
_IN = "hit AS (SELECT p.session_id, t, arg_min(idx, idx) AS in_idx FROM pts p JOIN turns i ON p.session_id = i.session_id AND t BETWEEN start_s AND end_s GROUP BY p.session_id, t)"
_TRACK = """track AS (SELECT user_id, t, v AS gesture_amplitude, u / 2 AS head_motion, v / (u + 1) AS posture_openness, (v - 20) / 100 AS lean, c = 1 AS arms_crossed, v >= 1 AS pose_present FROM (
  SELECT user_id, floor(epoch(ts))::BIGINT AS t, max(value) AS v, min(value) AS u, max((event_type = 'click')::INT) AS c FROM events WHERE value IS NOT NULL GROUP BY ALL))"""
_PZ = lambda c: R(f"avg({c}) FILTER (pose_present) / coalesce(nullif(stddev_pop({c}) FILTER (pose_present), 0), 1e-6)", 4) + f" AS {c}_z"
_VZ = f"""vis AS (SELECT user_id, count(*) FILTER (pose_present) AS n_pose, {R('stddev_pop(gesture_amplitude) / (coalesce(nullif(avg(gesture_amplitude), 0), 1e-6) + 1e-6)', 4)} AS expressivity_range_z,
  {_PZ('gesture_amplitude')}, {_PZ('head_motion')}, {_PZ('posture_openness')}, {R('(avg(arms_crossed::INT) - 0.15::DOUBLE) / 0.12::DOUBLE', 4)} AS arms_crossed_ratio_z FROM track GROUP BY user_id HAVING count(*) FILTER (pose_present) >= 5)"""


def _channel(z: dict[str, str], signs: dict[str, float]) -> str:
    has = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {abs(signs[k])}::DOUBLE ELSE 0.0 END" for k, c in z.items())
    total = " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {signs[k]}::DOUBLE * {c} ELSE 0.0 END" for k, c in z.items())
    return f"CASE WHEN {' OR '.join(f'{c} IS NOT NULL' for c in z.values())} THEN greatest(-3.0::DOUBLE, least(3.0::DOUBLE, ({total}) / ({has}))) END"


_A = {k: f"{k}_nz" for k in ("syllable_rate", "pause_ratio", "longest_pause_s")}
_P = {k: f"{k}_z" for k in ("expressivity_range", "gesture_amplitude", "head_motion", "posture_openness", "arms_crossed_ratio")}
_count = lambda z: " + ".join(f"({c} IS NOT NULL)::INT" for c in z.values())
_D = lambda a, b: f"sqrt(({a}_x - {b}_x) * ({a}_x - {b}_x) + ({a}_y - {b}_y) * ({a}_y - {b}_y))"
_MV = lambda p: f"sqrt(({p}_x - lag({p}_x) OVER w) * ({p}_x - lag({p}_x) OVER w) + ({p}_y - lag({p}_y) OVER w) * ({p}_y - lag({p}_y) OVER w))"
_LM = ", ".join(f"embedding[{i}]::DOUBLE AS {p}_{x}" for i, (p, x) in enumerate(((p, x) for p in ("ls", "rs", "lw", "rw", "le", "re", "nose") for x in "xy"), 1))
SQL = {
    "line_stamps": r"""WITH s AS (SELECT DISTINCT session_id, idx, regexp_extract(text, '[\[(]?(\d{1,2}):(\d{2}):(\d{2})[\])]?', ['h', 'm', 's']) AS a, regexp_extract(text, '[\[(](\d{1,2}):(\d{2})[\])]', ['m', 's']) AS b FROM utterances_raw WHERE text IS NOT NULL)
SELECT DISTINCT session_id, idx, CASE WHEN a.h <> '' THEN try_cast(a.h AS INT) * 3600 + try_cast(a.m AS INT) * 60 + try_cast(a.s AS INT) ELSE try_cast(b.m AS INT) * 60 + try_cast(b.s AS INT) END AS at_s FROM s WHERE a.h <> '' OR b.m <> ''""",
    "turn_positions": f"""WITH {_T}, a AS (SELECT session_id, idx, row_number() OVER (PARTITION BY session_id ORDER BY idx) AS i FROM turns), b AS (SELECT session_id, start_s, end_s, row_number() OVER (PARTITION BY session_id ORDER BY start_s, end_s) AS i FROM turns)
SELECT session_id, idx, start_s, end_s FROM a JOIN b USING (session_id, i)""",
    "timing_sources": f"""WITH {_T}, s AS (SELECT session_id, count(*) AS n_turns, count(*) FILTER (timing_source = 'explicit') AS st, count(*) FILTER (timing_source = 'diarisation') AS sg, max(end_s) AS d FROM turns GROUP BY session_id)
SELECT session_id, n_turns, CASE WHEN d <= 0 THEN 'none' WHEN st >= greatest(3, n_turns // 3) THEN 'explicit' WHEN sg > 0 AND sg >= n_turns THEN 'diarisation' ELSE 'estimated' END AS source FROM s""",
    "moment_links": f"""WITH {_T}, {_IN},
near AS (SELECT p.session_id, t, arg_min(idx, {{'g': least(abs(t - start_s), abs(t - end_s)), 'i': idx}}) AS near_idx FROM pts p JOIN turns i USING (session_id) GROUP BY p.session_id, t),
low AS (SELECT p.session_id, t, arg_min(idx, {{'p': process_mean, 'i': idx}}) AS low_idx FROM pts p JOIN turns i ON p.session_id = i.session_id AND speaker = 'client' AND process_mean IS NOT NULL AND NOT isnan(process_mean) AND abs((start_s + end_s) / 2 - t) <= 6.0 GROUP BY p.session_id, t)
SELECT session_id, t, coalesce(in_idx, near_idx) AS idx, in_idx IS NOT NULL AS inside, CASE WHEN low_idx <> coalesce(in_idx, near_idx) THEN low_idx END AS nearby_idx FROM pts JOIN near USING (session_id, t) LEFT JOIN hit USING (session_id, t) LEFT JOIN low USING (session_id, t)""",
    "turn_slices": f"WITH {_T} SELECT i.session_id, idx, count(*) AS n_samples, {R('avg(rate)', 4)} AS mean_value FROM turns i JOIN smp s ON s.session_id = i.session_id AND t BETWEEN start_s AND end_s WHERE end_s - start_s >= 0.5 GROUP BY i.session_id, idx",
    "convergent_turns": f"""WITH {_T}, c AS (SELECT *, (process_mean - avg(process_mean) OVER w) / coalesce(nullif(coalesce(stddev_samp(process_mean) OVER w, 0), 0), 1e-6) AS lz FROM turns WHERE speaker = 'client' AND n_words >= 8 AND process_mean IS NOT NULL AND NOT isnan(process_mean) WINDOW w AS (PARTITION BY session_id)),
g AS (SELECT session_id, avg(rate) AS gm, coalesce(nullif(coalesce(stddev_samp(rate), 0), 0), 1e-6) AS gs FROM smp GROUP BY session_id),
m AS (SELECT c.session_id, idx, any_value(lz) AS lz, avg(rate) AS r FROM c JOIN smp s ON s.session_id = c.session_id AND t BETWEEN start_s AND end_s GROUP BY c.session_id, idx),
z AS (SELECT session_id, idx, lz, (r - gm) / gs AS gz FROM m JOIN g USING (session_id)),
o AS (SELECT session_id, idx, {R('lz', 2)} AS language_z, {R('gz', 2)} AS movement_z, {R('abs(lz - gz)', 3)} AS divergence, CASE WHEN lz < -0.7::DOUBLE AND gz > 0.7::DOUBLE THEN 'low_language_high_movement' WHEN lz > 0.7::DOUBLE AND gz < -0.7::DOUBLE THEN 'strong_language_stillness' ELSE 'agree' END AS pattern FROM z)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY divergence DESC, idx) AS rank FROM o) WHERE rank <= 5""",
    "moment_utterances": f"""WITH {_T}, {_IN}, near AS (SELECT p.session_id, t, arg_min(idx, {{'g': abs(t - start_s), 's': start_s, 'i': idx}}) AS near_idx FROM pts p JOIN turns i USING (session_id) GROUP BY p.session_id, t)
SELECT session_id, t, coalesce(in_idx, near_idx) AS idx FROM near LEFT JOIN hit USING (session_id, t)""",
    "moment_previews": f"WITH {_T} SELECT p.session_id, t, arg_min(start_s, {{'g': abs(start_s - t), 's': start_s}}) AS preview_t FROM pts p JOIN turns i ON p.session_id = i.session_id AND abs(start_s - t) <= 1.5 GROUP BY p.session_id, t",
    "track_summary": f"""WITH {_TRACK} SELECT user_id, count(*) AS n_frames, count(*) FILTER (pose_present) AS n_pose, {R('avg(gesture_amplitude)', 4)} AS gesture_mean, {R('stddev_pop(gesture_amplitude)', 4)} AS gesture_sd, {R('avg(head_motion)', 4)} AS head_mean,
  {R('avg(posture_openness) FILTER (pose_present)', 4)} AS openness_mean, {R('avg(arms_crossed::INT)', 4)} AS crossed_ratio, count(*) >= 20 AND count(*) FILTER (pose_present) >= 15 AS enough FROM track GROUP BY user_id""",
    "track_tags": f"""WITH {_TRACK}, m AS (SELECT *, avg(gesture_amplitude) OVER w AS g, avg(head_motion) OVER w AS h, avg(posture_openness) FILTER (pose_present) OVER w AS o FROM track WINDOW w AS (PARTITION BY user_id))
SELECT user_id, t, concat_ws(';', CASE WHEN arms_crossed THEN 'arms_crossed' END, CASE WHEN g <> 0 AND gesture_amplitude > 1.6::DOUBLE * g THEN 'high_gesture' WHEN g <> 0 AND gesture_amplitude < 0.45::DOUBLE * g THEN 'low_gesture' END,
  CASE WHEN o <> 0 AND posture_openness > 1.35::DOUBLE * o THEN 'open_posture' WHEN o <> 0 AND posture_openness < 0.65::DOUBLE * o THEN 'closed_posture' END, CASE WHEN h <> 0 AND head_motion > 2 * h THEN 'head_shift' END,
  CASE WHEN abs(lean) > 0.14::DOUBLE THEN CASE WHEN lean < 0 THEN 'leaned_away' ELSE 'leaned_toward' END END) AS tags FROM m""",
    "track_z": f"WITH {_TRACK}, {_VZ} SELECT * FROM vis",
    "session_fusion": f"""WITH {_T}, {_TRACK}, {_VZ}, q AS (SELECT *, greatest(0.0::DOUBLE, start_s - lag(end_s) OVER (PARTITION BY session_id ORDER BY start_s, idx)) AS pause FROM turns),
qq AS (SELECT session_id, sum(n_words) FILTER (speaker = 'client') * 1.4::DOUBLE / nullif(sum(end_s - start_s) FILTER (speaker = 'client'), 0) AS sr, sum(CASE WHEN pause >= 0 THEN pause END) / max(end_s) AS pr, max(CASE WHEN pause >= 0 THEN pause END) AS lp, 100 * avg(process_mean) FILTER (speaker = 'client' AND NOT isnan(process_mean)) AS tp FROM q GROUP BY session_id),
v AS (SELECT session_id, {R('sr', 6)} AS syllable_rate, {R('pr', 6)} AS pause_ratio, {R('lp', 6)} AS longest_pause_s, {R('tp', 4)} AS tpi FROM qq),
n AS (SELECT v.*, vis.* EXCLUDE (user_id, n_pose), {', '.join(f"{R(f'({k} - {S.ACOUSTIC_NORMS[k][0]}::DOUBLE) / {S.ACOUSTIC_NORMS[k][1]}::DOUBLE', 4)} AS {k}_nz" for k in _A)} FROM v LEFT JOIN vis ON v.session_id = vis.user_id),
z AS (SELECT session_id, tpi, {R(_channel(_A, S.ACOUSTIC_SIGNS), 4)} AS az, {R(_channel(_P, S.VISUAL_SIGNS), 4)} AS vz, {_count(_A)} AS n_voice, {_count(_P)} AS n_picture FROM n),
s AS (SELECT *, greatest(-4.0::DOUBLE, least(4.0::DOUBLE, coalesce(10.0::DOUBLE * 0.15::DOUBLE * az, 0.0) + coalesce(10.0::DOUBLE * 0.10::DOUBLE * vz, 0.0))) * 0.8::DOUBLE AS sh, 1 + (az IS NOT NULL)::INT + (vz IS NOT NULL)::INT AS modalities FROM z)
SELECT session_id, az, vz, n_voice, n_picture, CASE WHEN tpi IS NOT NULL THEN {R('greatest(0.0::DOUBLE, least(100.0::DOUBLE, tpi + sh))', 2)} END AS fused, {R('sh', 2)} AS shift, modalities,
  CASE WHEN modalities = 1 THEN 'text_only' WHEN abs(sh) < 1.0 THEN 'converging' WHEN sh > 0 THEN 'channels_support_higher' ELSE 'channels_suggest_caution' END AS agreement,
  {R('greatest(0.0::DOUBLE, least(100.0::DOUBLE, 50.0::DOUBLE + 10.0::DOUBLE * (0.6::DOUBLE * coalesce(az, 0.0) + 0.4::DOUBLE * coalesce(vz, 0.0))))', 2)} AS without_text,
  CASE WHEN tpi IS NOT NULL AND az IS NOT NULL AND vz IS NOT NULL THEN 'full_multimodal' WHEN tpi IS NOT NULL AND az IS NOT NULL THEN 'text_audio' WHEN tpi IS NOT NULL AND vz IS NOT NULL THEN 'text_video' WHEN az IS NOT NULL AND vz IS NOT NULL THEN 'audio_video'
    WHEN tpi IS NOT NULL THEN 'text_only' WHEN vz IS NOT NULL THEN 'video_only' WHEN az IS NOT NULL THEN 'audio_only' ELSE 'none' END AS mode FROM s""",
    "frame_geometry": f"""WITH e AS (SELECT label, vec_id, {_LM} FROM embeddings), g AS (SELECT *, greatest({_D('ls', 'rs')}, 1e-6::DOUBLE) AS wide, {_MV('lw')} + {_MV('rw')} AS hands, {_MV('nose')} AS head FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, vec_id, {R('coalesce(hands / (2 * wide), 0.0)', 4)} AS gesture_amplitude, {R('coalesce(head / wide, 0.0)', 4)} AS head_motion, {R('abs(le_x - re_x) / wide', 4)} AS posture_openness, {R('(nose_x - (ls_x + rs_x) / 2) / wide', 4)} AS lean,
  (lw_x < rw_x AND ls_x > rs_x) OR (lw_x > rw_x AND ls_x < rs_x) AS arms_crossed FROM g""",
    "vector_loudness": f"SELECT vec_id, {R('sqrt(avg(x * x))', 6)} AS rms FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY vec_id",
}
