"""Signal operators over regular tracks: episodes, moments, arcs and bounded fusion with other channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.numeric import clamp, round_n

# Weights of the channels and the largest shift they may cause.
W_ACOUSTIC, W_VISUAL, MAX_SHIFT = 0.15, 0.10, 4.0


def episodes(signals: DataFrame, *keys: str, t: str, hit: Column, min_s: float) -> DataFrame:
    """Contiguous runs of ``hit`` that last ``min_s`` or longer: (keys, start_t, end_t, duration, n), as gaps and islands."""
    w = Window.partitionBy(*keys)
    h = signals.withColumn("hit_", F.coalesce(hit, F.lit(False)))
    i = h.withColumn("island_", F.row_number().over(w.orderBy(t)) - F.row_number().over(Window.partitionBy(*keys, "hit_").orderBy(t))).where("hit_")
    runs = i.groupBy(*keys, "island_").agg(F.min(t).alias("start_t"), F.max(t).alias("end_t"), F.count(F.lit(1)).alias("n"))
    return runs.withColumn("duration", F.col("end_t") - F.col("start_t")).where(F.col("duration") >= min_s).drop("island_")


def outlier_episodes(signals: DataFrame, *keys: str, t: str, value: str, sds: float = 1.2, min_s: float = 20.0) -> DataFrame:
    """Episodes above mean + ``sds`` population deviations ('opening') and below mean - ``sds`` ('closure') of the key's own track."""
    w = Window.partitionBy(*keys)
    z = signals.withColumns({"m_": F.avg(value).over(w), "s_": F.stddev_pop(value).over(w)})
    high = episodes(z, *keys, t=t, hit=F.col(value) > F.col("m_") + sds * F.col("s_"), min_s=min_s).withColumn("kind", F.lit("opening"))
    return high.unionByName(episodes(z, *keys, t=t, hit=F.col(value) < F.greatest(F.lit(0.0), F.col("m_") - sds * F.col("s_")), min_s=min_s).withColumn("kind", F.lit("closure")))


def arc(signals: DataFrame, *keys: str, t: str, value: str) -> DataFrame:
    """First against last third and first against second half of a track, and its largest value's distance in deviations."""
    w = Window.partitionBy(*keys)
    n = signals.withColumns({"i_": F.row_number().over(w.orderBy(t)) - 1, "n_": F.count(F.lit(1)).over(w)})
    part = lambda cond: F.avg(F.when(cond, F.col(value)))
    s = n.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), part(F.col("i_") < F.floor(F.col("n_") / 3)).alias("first_third"), part(F.col("i_") >= F.col("n_") - F.ceil(F.col("n_") / 3)).alias("last_third"),
        part(F.col("i_") < F.floor(F.col("n_") / 2)).alias("first_half"), part(F.col("i_") >= F.floor(F.col("n_") / 2)).alias("second_half"), F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.max(value).alias("top"),
    )
    ratio = F.try_divide(F.col("last_third"), F.col("first_third"))
    return s.select(
        *keys, "n", round_n(F.col("first_third"), 6).alias("first_third"), round_n(F.col("last_third"), 6).alias("last_third"), F.when(ratio >= 1.4, "rising").when(ratio <= 0.6, "fading").otherwise("level").alias("engagement"),
        round_n(F.col("second_half") - F.col("first_half"), 6).alias("half_shift"), (F.col("top") > F.col("m") + 2 * F.col("s")).alias("spike"),
    )


def moments(signals: DataFrame, *keys: str, t: str, tracks: tuple[str, ...], k: int = 8, least: int = 10) -> DataFrame:
    """Up to ``k`` times per key where the tracks change most at once, at least max(3, n // (2k + 1)) rows apart; keys under ``least`` rows have none.

    The choice depends on what was chosen before, so it is a fold over the candidates in order of salience. Only local leaders can be chosen early, but any row may be chosen later, so all rows of one
    key pass through the fold; a track is one recording and bounded by its length.
    """
    w = Window.partitionBy(*keys)
    z = signals
    for c in tracks:
        z = z.withColumn(f"z_{c}", F.try_divide(F.col(c) - F.avg(c).over(w), F.when(F.stddev_pop(c).over(w) > 0, F.stddev_pop(c).over(w)).otherwise(F.lit(1e-6))))
    o = w.orderBy(t)
    change = sum((F.coalesce(F.abs(F.col(f"z_{c}") - F.lag(f"z_{c}").over(o)), F.lit(0.0)) for c in tracks), F.lit(0.0))
    s = z.withColumns({"i_": F.row_number().over(o) - 1, "salience": round_n(change, 6)})
    g = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct((-F.col("salience")).alias("s"), (-F.col("i_")).alias("i"), F.col(t).alias("t")))).alias("c")).where(F.col("n") >= least)
    gap = F.greatest(F.lit(3), F.floor(F.col("n") / (2 * k + 1)).cast("int"))
    empty = F.slice(F.col("c"), 1, 0)
    chosen = F.aggregate("c", empty, lambda a, x: F.when((F.size(a) < k) & ~F.exists(a, lambda b: F.abs(b["i"] - x["i"]) <= gap), F.concat(a, F.array(x))).otherwise(a))
    return g.select(*keys, F.explode(chosen).alias("m")).select(*keys, F.col("m.t").alias(t), (-F.col("m.s")).alias("salience"))


def fuse(df: DataFrame, tpi: str, acoustic_z: str, visual_z: str, confidence: str) -> DataFrame:
    """``df`` with the index shifted by the other channels: at most MAX_SHIFT points times confidence; missing channels shift nothing."""
    a, v = clamp(F.col(acoustic_z), -3.0, 3.0), clamp(F.col(visual_z), -3.0, 3.0)
    has_a, has_v = F.col(acoustic_z).isNotNull(), F.col(visual_z).isNotNull()
    raw = F.when(has_a, 10.0 * W_ACOUSTIC * a).otherwise(0.0) + F.when(has_v, 10.0 * W_VISUAL * v).otherwise(0.0)
    shift = clamp(raw, -MAX_SHIFT, MAX_SHIFT) * F.col(confidence)
    n = F.lit(1) + has_a.cast("int") + has_v.cast("int")
    agree = F.when(n == 1, "text_only").when(F.abs(shift) < 1.0, "converging").when(shift > 0, "channels_support_higher").otherwise("channels_suggest_caution")
    return df.withColumns({"fused": round_n(clamp(F.col(tpi) + shift, 0.0, 100.0), 2), "shift": round_n(shift, 2), "modalities": n, "agreement": agree})


# Norms (mean, deviation) of single recordings, and the sign and weight of each feature in its channel.
ACOUSTIC_NORMS = {
    "f0_cv": (0.18, 0.06), "f0_range": (45.0, 20.0), "energy_cv": (0.35, 0.12), "pause_ratio": (0.22, 0.10), "longest_pause_s": (1.2, 0.8),
    "hnr": (8.0, 4.0), "syllable_rate": (3.5, 1.2), "jitter": (0.015, 0.010), "shimmer": (0.04, 0.025),
}
ACOUSTIC_SIGNS = {"f0_cv": 1.0, "f0_range": 1.0, "energy_cv": 1.0, "pause_ratio": -0.6, "longest_pause_s": -0.4, "hnr": 0.5, "syllable_rate": 0.3}
VISUAL_SIGNS = {"expressivity_range": 1.0, "au_activity": 0.6, "gesture_amplitude": 0.8, "head_motion": 0.3, "posture_openness": 0.5, "arms_crossed_ratio": -0.7}


def norm_z(value: Column, name: str) -> Column:
    """Deviations of an acoustic feature from its norm, four decimals."""
    mean, sd = ACOUSTIC_NORMS[name]
    return round_n((value - F.lit(mean)) / F.lit(sd), 4)


def channel_score(z: dict[str, Column], signs: dict[str, float]) -> tuple[Column, Column]:
    """Signed, weighted mean of the features that are there, clamped to +-3 and null without any; and how many are there."""
    known = {k: c for k, c in z.items() if k in signs}
    has = lambda c: c.isNotNull()
    total = sum((F.when(has(c), abs(signs[k])).otherwise(0.0) for k, c in known.items()), F.lit(0.0))
    score = sum((F.when(has(c), signs[k] * c).otherwise(0.0) for k, c in known.items()), F.lit(0.0))
    n = sum((has(c).cast("int") for c in known.values()), F.lit(0))
    return F.when(n > 0, clamp(F.try_divide(score, total), -3.0, 3.0)), n


def visual_z(signals: DataFrame, *keys: str, pose: str = "pose_present", crossed: str = "arms_crossed", least: int = 5) -> DataFrame:
    """``(keys, <feature>_z...)`` of a pose track: mean over population deviation where a pose is seen, the spread of the gestures over their mean, and crossed arms against their norm; keys with fewer poses have none."""
    use = lambda c: F.when(F.col(pose), F.col(c))
    ratio = lambda c: round_n(F.avg(use(c)) / F.coalesce(F.nullif(F.stddev_pop(use(c)), F.lit(0.0)), F.lit(1e-6)), 4).alias(f"{c}_z")
    spread = round_n(F.stddev_pop("gesture_amplitude") / (F.coalesce(F.nullif(F.avg("gesture_amplitude"), F.lit(0.0)), F.lit(1e-6)) + 1e-6), 4).alias("expressivity_range_z")
    arms = round_n((F.avg(F.col(crossed).cast("double")) - 0.15) / 0.12, 4).alias("arms_crossed_ratio_z")
    s = signals.groupBy(*keys).agg(F.sum(F.col(pose).cast("int")).alias("n_pose"), spread, *[ratio(c) for c in ("gesture_amplitude", "head_motion", "posture_openness")], arms)
    return s.where(F.col("n_pose") >= least)


def signal_summary(signals: DataFrame, *keys: str, pose: str = "pose_present", crossed: str = "arms_crossed") -> DataFrame:
    """Frames, poses, means and population deviations of a pose track, openness only where a pose is seen, and whether there is enough to speak of (20 frames, 15 poses)."""
    r = lambda c: round_n(c, 4)
    s = signals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), F.sum(F.col(pose).cast("int")).alias("n_pose"), r(F.avg("gesture_amplitude")).alias("gesture_mean"), r(F.stddev_pop("gesture_amplitude")).alias("gesture_sd"),
        r(F.avg("head_motion")).alias("head_mean"), r(F.avg(F.when(F.col(pose), F.col("posture_openness")))).alias("openness_mean"), r(F.avg(F.col(crossed).cast("double"))).alias("crossed_ratio"),
    )
    return s.withColumn("enough", (F.col("n_frames") >= 20) & (F.col("n_pose") >= 15))


def moment_tags(signals: DataFrame, *keys: str, pose: str = "pose_present", crossed: str = "arms_crossed", lean: str = "lean") -> DataFrame:
    """``signals`` with ``tags``: what stands out in a frame against the means of its key."""
    w = Window.partitionBy(*keys)
    g, h, o = F.avg("gesture_amplitude").over(w), F.avg("head_motion").over(w), F.avg(F.when(F.col(pose), F.col("posture_openness"))).over(w)
    ga, hm, po = F.col("gesture_amplitude"), F.col("head_motion"), F.col("posture_openness")
    tags = F.array(
        F.when(F.col(crossed), "arms_crossed"), F.when((g != 0) & (ga > 1.6 * g), "high_gesture").when((g != 0) & (ga < 0.45 * g), "low_gesture"), F.when((o != 0) & (po > 1.35 * o), "open_posture").when((o != 0) & (po < 0.65 * o), "closed_posture"),
        F.when((h != 0) & (hm > 2.0 * h), "head_shift"), F.when(F.abs(F.col(lean)) > 0.14, F.when(F.col(lean) < 0, "leaned_away").otherwise("leaned_toward")),
    )
    return signals.withColumn("tags", F.array_join(F.array_compact(tags), ";"))


def pose_geometry(landmarks: DataFrame, *keys: str, t: str = "t") -> DataFrame:
    """Frame features from landmarks (ls, rs: shoulders, lw, rw: wrists, le, re: elbows, nose; each _x and _y): movement per shoulder width since the frame before, elbow span, lean and crossed arms."""
    w = Window.partitionBy(*keys).orderBy(t)
    c = F.col
    far = lambda ax, ay, bx, by: F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    wide = F.greatest(far(c("ls_x"), c("ls_y"), c("rs_x"), c("rs_y")), F.lit(1e-6))
    moved = lambda p: far(c(f"{p}_x"), c(f"{p}_y"), F.lag(f"{p}_x").over(w), F.lag(f"{p}_y").over(w))
    crossed = (c("lw_x") < c("rw_x")) & (c("ls_x") > c("rs_x")) | (c("lw_x") > c("rw_x")) & (c("ls_x") < c("rs_x"))
    return landmarks.withColumns({
        "gesture_amplitude": F.coalesce((moved("lw") + moved("rw")) / (2 * wide), F.lit(0.0)), "head_motion": F.coalesce(moved("nose") / wide, F.lit(0.0)),
        "posture_openness": F.abs(c("le_x") - c("re_x")) / wide, "lean": (c("nose_x") - (c("ls_x") + c("rs_x")) / 2) / wide, "arms_crossed": crossed, "pose_present": c("ls_x").isNotNull() & c("rs_x").isNotNull(),
    })


def index_without_text(acoustic: Column, visual: Column) -> Column:
    """50 and ten points a deviation, three fifths of it from the voice, two from the picture; a missing channel adds nothing."""
    return round_n(clamp(50.0 + 10.0 * (0.6 * F.coalesce(acoustic, F.lit(0.0)) + 0.4 * F.coalesce(visual, F.lit(0.0))), 0.0, 100.0), 2)


def input_mode(has_text: Column, has_audio: Column, has_video: Column) -> Column:
    """Which of text, sound and picture there are, as one of eight names."""
    return (
        F.when(has_text & has_audio & has_video, "full_multimodal").when(has_text & has_audio, "text_audio").when(has_text & has_video, "text_video").when(has_audio & has_video, "audio_video")
        .when(has_text, "text_only").when(has_video, "video_only").when(has_audio, "audio_only").otherwise("none")
    )


def loudness(samples: DataFrame, *keys: str, value: str = "x") -> DataFrame:
    """Root mean square of the samples of each key."""
    return samples.groupBy(*keys).agg(round_n(F.sqrt(F.avg(F.col(value) * F.col(value))), 6).alias("rms"))
