"""Clock operators: timing turns, and joining points to intervals by containment or nearness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.numeric import round_n


def proportional_times(turns: DataFrame, *keys: str, order: str, words: str, duration: str) -> DataFrame:
    """``turns`` with start_s and end_s: the duration shared out by words (at least one a turn)."""
    w = Window.partitionBy(*keys)
    n = F.greatest(F.lit(1), F.col(words)).cast("double")
    upto = F.sum(n).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum(n).over(w)
    return turns.withColumns({"start_s": F.col(duration) * (upto - n) / total, "end_s": F.col(duration) * upto / total})


def interpolated_times(turns: DataFrame, *keys: str, order: str, stamp: str, duration: str) -> DataFrame:
    """``turns`` with start_s and end_s where some carry a stamp: missing starts lie evenly between the stamps around them, before the first at 0,
    after the last at the last; an end is the next start, the last one the duration or a second after the start."""
    w = Window.partitionBy(*keys).orderBy(order)
    pos = turns.withColumn("i_", F.row_number().over(w))
    known = F.when(F.col(stamp).isNotNull(), F.struct(F.col("i_").alias("i"), F.col(stamp).alias("t")))
    near = pos.withColumns({"p_": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "x_": F.first(known, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))})
    frac = F.try_divide(F.col("i_") - F.col("p_.i"), F.col("x_.i") - F.col("p_.i"))
    start = F.when(F.col(stamp).isNotNull(), F.col(stamp)).when(F.col("p_").isNotNull() & F.col("x_").isNotNull(), F.col("p_.t") + frac * (F.col("x_.t") - F.col("p_.t"))).when(F.col("p_").isNotNull(), F.col("p_.t")).otherwise(0.0)
    timed = near.withColumn("start_s", start)
    return timed.withColumn("end_s", F.coalesce(F.lead("start_s").over(w), F.greatest(F.col(duration), F.col("start_s") + 1))).drop("i_", "p_", "x_")


def containing_interval(points: DataFrame, intervals: DataFrame, key: str, t: str = "t", start: str = "start_s", end: str = "end_s", order: str = "idx", bin_s: float = 30.0) -> DataFrame:
    """The first interval (by ``order``) that contains each point, ends included: (key, t, order, start, end).

    Both sides are cut into bins of ``bin_s`` and equi-joined on key and bin, so a long key is spread over its bins and no pair outside a shared bin is formed.
    """
    p = points.select(key, F.col(t).alias("t_"), F.floor(F.col(t) / bin_s).alias("bin_")).distinct()
    i = intervals.where(F.col(end) >= F.col(start)).select(key, F.col(order).alias("o_"), F.col(start).alias("s_"), F.col(end).alias("e_"))
    i = i.withColumn("bin_", F.explode(F.sequence(F.floor(F.col("s_") / bin_s), F.floor(F.col("e_") / bin_s))))
    hit = p.join(i, [key, "bin_"]).where("t_ >= s_ and t_ <= e_")
    best = hit.groupBy(key, "t_").agg(F.min(F.struct("o_", "s_", "e_")).alias("b"))
    return best.select(key, F.col("t_").alias(t), F.col("b.o_").alias(order), F.col("b.s_").alias(start), F.col("b.e_").alias(end))


def nearest_interval(points: DataFrame, intervals: DataFrame, key: str, t: str = "t", start: str = "start_s", end: str = "end_s", order: str = "idx") -> DataFrame:
    """The interval whose boundary is nearest to each point (ties: the first by ``order``), found by two as-of look-ups instead of a join of all pairs.

    Boundaries and points of a key are merged in time order; the last boundary before and the first after a point are its only candidates.
    """
    bounds = intervals.select(key, F.explode(F.array(F.struct(F.col(start).alias("at"), F.col(order).alias("o")), F.struct(F.col(end).alias("at"), F.col(order).alias("o")))).alias("b")).select(key, F.col("b.at").alias("at_"), F.col("b.o").alias("o_"))
    bounds = bounds.groupBy(key, "at_").agg(F.min("o_").alias("o_"))
    both = bounds.select(key, "at_", "o_", F.lit(0).alias("p_")).union(points.select(key, F.col(t).alias("at_"), F.lit(None).cast(dict(bounds.dtypes)["o_"]), F.lit(1)).distinct())
    w = Window.partitionBy(key).orderBy("at_", "p_")
    cand = F.when(F.col("o_").isNotNull(), F.struct(F.col("at_").alias("at"), F.col("o_").alias("o")))
    near = both.withColumns({"b_": F.last(cand, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "a_": F.first(cand, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))}).where("p_ = 1")
    opts = F.array_compact(F.array(F.when(F.col("b_").isNotNull(), F.struct((F.col("at_") - F.col("b_.at")).alias("gap"), F.col("b_.o").alias("o"))), F.when(F.col("a_").isNotNull(), F.struct((F.col("a_.at") - F.col("at_")).alias("gap"), F.col("a_.o").alias("o")))))
    best = F.array_min(opts)
    return near.where(F.size(opts) > 0).select(key, F.col("at_").alias(t), best["o"].alias(order), best["gap"].alias("gap"))


# A clock with hours anywhere in a line, or minutes and seconds in brackets.
LONG_STAMP, SHORT_STAMP = r"[\[(]?(\d{1,2}):(\d{2}):(\d{2})[\])]?", r"[\[(](\d{1,2}):(\d{2})[\])]"


def stamp_seconds(line: Column) -> Column:
    """Seconds of the first clock in a line; null without one."""
    part = lambda p, i: F.regexp_extract(line, p, i).cast("int")
    long_ = part(LONG_STAMP, 1) * 3600 + part(LONG_STAMP, 2) * 60 + part(LONG_STAMP, 3)
    return F.when(line.rlike(LONG_STAMP), long_).when(line.rlike(SHORT_STAMP), part(SHORT_STAMP, 1) * 60 + part(SHORT_STAMP, 2))


def positional_times(turns: DataFrame, segments: DataFrame, key: str, order: str, start: str = "start_s", end: str = "end_s") -> DataFrame:
    """``(key, order, start_s, end_s)``: the turns of a key take the times of its segments one after the other, where there are at least as many segments as turns."""
    w = Window.partitionBy(key)
    t = turns.select(key, order, F.row_number().over(w.orderBy(order)).alias("i_"), F.count(F.lit(1)).over(w).alias("n_"))
    s = segments.select(key, F.col(start).alias("start_s"), F.col(end).alias("end_s"), F.row_number().over(w.orderBy(start, end)).alias("i_"), F.count(F.lit(1)).over(w).alias("m_"))
    return t.join(s, [key, "i_"]).where("m_ >= n_").select(key, order, "start_s", "end_s")


def timing_source(n_turns: Column, n_stamps: Column, n_segments: Column, duration: Column) -> Column:
    """How the turns of a session are timed: 'explicit' by enough stamps, 'diarisation' by enough segments, 'estimated' by a duration, else 'none'."""
    enough = n_stamps >= F.greatest(F.lit(3), F.floor(n_turns / 3))
    return (
        F.when((n_turns == 0) | (F.coalesce(duration, F.lit(0.0)) <= 0), "none").when(enough, "explicit").when((n_segments > 0) & (n_segments >= n_turns), "diarisation").otherwise("estimated")
    )


def linked_moments(points: DataFrame, turns: DataFrame, key: str, window_s: float = 6.0, bin_s: float = 30.0) -> DataFrame:
    """Each point (key, t) with the turn it lies in, else the one whose boundary is nearest, and the lowest-scoring client turn whose middle lies within ``window_s``.

    ``turns(key, idx, speaker, start_s, end_s, process_mean)``. Result: key, t, idx, inside, nearby_idx (null where that is the same turn or there is none). All three parts are joins on time bins or merges in time order, none forms all pairs.
    """
    inside = containing_interval(points, turns, key, bin_s=bin_s).select(key, "t", F.col("idx").alias("in_"))
    near = nearest_interval(points, turns, key).select(key, "t", F.col("idx").alias("near_"))
    mid = (F.col("start_s") + F.col("end_s")) / 2
    client = turns.where("speaker = 'client' and process_mean is not null and not isnan(process_mean)").select(key, F.col("idx").alias("c_"), mid.alias("mid_"), F.col("process_mean").alias("pm_"))
    client = client.withColumn("bin_", F.explode(F.sequence(F.floor((F.col("mid_") - window_s) / bin_s), F.floor((F.col("mid_") + window_s) / bin_s))))
    at = points.select(key, "t", F.floor(F.col("t") / bin_s).alias("bin_")).distinct()
    low = at.join(client, [key, "bin_"]).where(F.abs(F.col("mid_") - F.col("t")) <= window_s).groupBy(key, "t").agg(F.min(F.struct("pm_", "c_")).alias("low_"))
    j = points.select(key, "t").distinct().join(near, [key, "t"]).join(inside, [key, "t"], "left").join(low, [key, "t"], "left")
    active = F.coalesce("in_", "near_")
    return j.select(key, "t", active.alias("idx"), F.col("in_").isNotNull().alias("inside"), F.when(F.col("low_.c_") != active, F.col("low_.c_")).alias("nearby_idx"))


def slice_means(turns: DataFrame, samples: DataFrame, key: str, value: str, least_s: float = 0.5, bin_s: float = 30.0) -> DataFrame:
    """``(key, idx, n_samples, mean_value)``: samples (key, t, value) inside each turn of ``least_s`` seconds or more, joined on time bins and summed up there."""
    i = turns.where(F.col("end_s") - F.col("start_s") >= least_s).select(key, "idx", "start_s", "end_s")
    i = i.withColumn("bin_", F.explode(F.sequence(F.floor(F.col("start_s") / bin_s), F.floor(F.col("end_s") / bin_s))))
    s = samples.where(F.col(value).isNotNull()).select(key, "t", F.col(value).alias("v_"), F.floor(F.col("t") / bin_s).alias("bin_"))
    return s.join(i, [key, "bin_"]).where("t >= start_s and t <= end_s").groupBy(key, "idx").agg(F.count(F.lit(1)).alias("n_samples"), F.avg("v_").alias("mean_value"))


def convergences(turns: DataFrame, samples: DataFrame, key: str, value: str, words: str = "n_words", k: int = 5, least_words: int = 8) -> DataFrame:
    """The ``k`` client turns per key whose language and movement lie furthest apart: z of the score among the key's client turns (sample deviation) against z of the mean sample in the turn."""
    w = Window.partitionBy(key)
    client = turns.where((F.col("speaker") == "client") & (F.col(words) >= least_words) & F.col("process_mean").isNotNull() & ~F.isnan("process_mean"))
    sd = lambda x: F.coalesce(F.nullif(F.stddev_samp(x).over(w), F.lit(0.0)), F.lit(1e-6))
    c = client.withColumn("lz_", (F.col("process_mean") - F.avg("process_mean").over(w)) / sd("process_mean"))
    track = samples.where(F.col(value).isNotNull()).groupBy(key).agg(F.avg(value).alias("gm_"), F.coalesce(F.nullif(F.stddev_samp(value), F.lit(0.0)), F.lit(1e-6)).alias("gs_"))
    j = c.join(slice_means(client, samples, key, value, least_s=0.0), [key, "idx"]).join(track, key).withColumn("gz_", (F.col("mean_value") - F.col("gm_")) / F.col("gs_"))
    pattern = F.when((F.col("lz_") < -0.7) & (F.col("gz_") > 0.7), "low_language_high_movement").when((F.col("lz_") > 0.7) & (F.col("gz_") < -0.7), "strong_language_stillness").otherwise("agree")
    out = j.select(key, "idx", round_n(F.col("lz_"), 2).alias("language_z"), round_n(F.col("gz_"), 2).alias("movement_z"), round_n(F.abs(F.col("lz_") - F.col("gz_")), 3).alias("divergence"), pattern.alias("pattern"))
    return out.withColumn("rank", F.row_number().over(w.orderBy(F.desc("divergence"), "idx"))).where(F.col("rank") <= k)


def turn_at(points: DataFrame, turns: DataFrame, key: str) -> DataFrame:
    """``(key, t, idx)``: the turn each point lies in, else the one that starts nearest (ties: the earlier turn)."""
    inside = containing_interval(points, turns, key).select(key, "t", F.col("idx").alias("in_"))
    near = nearest_interval(points, turns.withColumn("end_s", F.col("start_s")), key).select(key, "t", F.col("idx").alias("near_"))
    return near.join(inside, [key, "t"], "left").select(key, "t", F.coalesce("in_", "near_").alias("idx"))


def nearest_within(points: DataFrame, previews: DataFrame, key: str, tolerance: float = 1.5) -> DataFrame:
    """``(key, t, preview_t)``: the preview (key, preview_t) nearest to each point, the earlier of two, if it is not further than ``tolerance``; points without one are left out."""
    both = lambda d: F.floor((F.col("preview_t") + d) / (2 * tolerance))
    p = previews.select(key, "preview_t").distinct().withColumn("bin_", F.explode(F.array_distinct(F.array(both(-tolerance), both(tolerance)))))
    at = points.select(key, "t", F.floor(F.col("t") / (2 * tolerance)).alias("bin_")).distinct()
    gap = F.abs(F.col("preview_t") - F.col("t"))
    hit = at.join(p, [key, "bin_"]).where(gap <= tolerance)
    return hit.groupBy(key, "t").agg(F.min(F.struct(gap.alias("g"), "preview_t")).alias("b")).select(key, "t", F.col("b.preview_t").alias("preview_t"))
