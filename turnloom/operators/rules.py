"""Rule operators over aggregates: goals, focus dimensions, early warnings, next moves and short notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.numeric import mean_of_rounded, round_n
from turnloom.operators.score import DIMENSIONS

# The movement of a goal in deviations, and P(change follows) by state and family from the annotated corpus.
GOAL_MOVE = 0.3
CORPUS_PRIOR = [
    ("stuck", "question", 0.268), ("stuck", "reflection", 0.260), ("stuck", "other", 0.244), ("stuck", "therapist_input", 0.253),
    ("middling", "question", 0.412), ("middling", "reflection", 0.382), ("middling", "other", 0.331), ("middling", "therapist_input", 0.265),
    ("moving", "question", 0.479), ("moving", "reflection", 0.455), ("moving", "other", 0.415), ("moving", "therapist_input", 0.296),
]


def evaluate_goals(goals: DataFrame, scored: DataFrame, key: str = "client_id", number: str = "session_number") -> DataFrame:
    """Each goal (key, number, dimension) against the latest earlier session: moved_toward, moved_away, held, pending, no_comparison or invalid."""
    w = Window.partitionBy(key).orderBy(number)
    z = F.map_from_arrays(F.array(*[F.lit(d) for d in DIMENSIONS]), F.array(*[F.col(f"z_{d}") for d in DIMENSIONS]))
    s = scored.select(key, number, z.alias("z_"), F.lag(number).over(w).alias("before_"), F.lag(z).over(w).alias("zb_"))
    j = goals.join(s, [key, number], "left")
    delta = F.try_element_at("z_", F.col("dimension")) - F.try_element_at("zb_", F.col("dimension"))
    status = (
        F.when(~F.col("dimension").isin(*DIMENSIONS), "invalid").when(F.col("z_").isNull(), "pending").when(F.col("zb_").isNull(), "no_comparison")
        .when(delta >= GOAL_MOVE, "moved_toward").when(delta <= -GOAL_MOVE, "moved_away").otherwise("held")
    )
    return j.select(*goals.columns, status.alias("status"), round_n(delta, 3).alias("delta_sd"), F.col("before_").alias("compared_with"))


def target_dimensions(scored: DataFrame, base: DataFrame, key: str = "client_id", order: str = "session_number") -> DataFrame:
    """Per key and dimension: mean of the last three sessions against the baseline in deviations, drift since the start, sessions below, and rank from the lowest."""
    w = Window.partitionBy(key)
    n = scored.select(key, order, *DIMENSIONS).withColumns({"i_": F.row_number().over(w.orderBy(order)), "n_": F.count(F.lit(1)).over(w)}).where("n_ >= 3")
    long_ = n.unpivot([key, "i_", "n_"], list(DIMENSIONS), "dimension", "x")
    mu = F.map_from_arrays(F.array(*[F.lit(d) for d in DIMENSIONS]), F.array(*[F.struct(F.col(f"mu_{d}").alias("m"), F.col(f"sd_{d}").alias("s")) for d in DIMENSIONS]))
    j = long_.join(base.select(key, mu.alias("b_")), key).withColumn("b_", F.element_at("b_", F.col("dimension")))
    early = F.col("i_") <= F.greatest(F.lit(2), F.floor(F.col("n_") / 3))
    s = j.groupBy(key, "dimension").agg(
        F.max("n_").alias("n_sessions"), mean_of_rounded(F.when(F.col("i_") > F.col("n_") - 3, F.col("x"))).alias("r_"), mean_of_rounded(F.when(early, F.col("x"))).alias("e_"),
        F.sum((F.col("x") < F.col("b_.m")).cast("int")).alias("sessions_below"), F.first("b_").alias("b_"),
    )
    pos = F.array_position(F.array(*[F.lit(d) for d in DIMENSIONS]), F.col("dimension"))
    out = s.withColumn("recent_z", round_n((F.col("r_") - F.col("b_.m")) / F.col("b_.s"), 3))
    return out.select(key, "dimension", "n_sessions", "recent_z", round_n(F.col("r_") - F.col("e_"), 4).alias("drift"), "sessions_below", F.row_number().over(w.orderBy("recent_z", pos)).alias("rank"))


def early_warning(scored: DataFrame, states: DataFrame, key: str = "client_id", order: str = "session_number") -> DataFrame:
    """Score, level and reasons of a short series from its last values; needs four sessions.

    Slope, level, spread, hopeless or ruminating language and fewer words count, and from six sessions on a ``state`` of plateauing in ``states(key, state)``, one row per key.
    """
    w = Window.partitionBy(key)
    n = scored.withColumns({"back": F.row_number().over(w.orderBy(F.desc(order))), "n_": F.count(F.lit(1)).over(w)}).where("n_ >= 4")
    at = lambda k, c: F.max(F.when(F.col("back") == k, F.col(c)))
    last4 = F.when(F.col("back") <= 4, F.col("tpi"))
    s = n.groupBy(key).agg(
        F.max("n_").alias("n"), at(1, "tpi").alias("y1"), at(3, "tpi").alias("y3"), (F.max(last4) - F.min(last4)).alias("spread"), at(1, "hopelessness").alias("hope"), at(1, "rumination").alias("rum"),
        at(1, "n_client_words").alias("words"), F.avg(F.when(F.col("back") > 1, F.col("n_client_words"))).alias("prior"),
    )
    slope = (F.col("y1") - F.col("y3")) / 2
    # What each reason weighs.
    reasons = {
        "falling": (slope < -2.0, 0.35), "drifting_down": ((slope < -0.8) & (slope >= -2.0), 0.18), "below_baseline": (F.col("y1") < 44, 0.2), "wide_spread": ((F.col("n") >= 5) & (F.col("spread") > 18), 0.15),
        "hopelessness": (F.col("hope") > 0.3, 0.25), "rumination": (F.col("rum") > 0.3, 0.12), "fewer_words": ((F.col("prior") > 0) & (F.col("words") < 0.6 * F.col("prior")), 0.2),
        "plateau": ((F.col("n") >= 6) & F.coalesce(F.col("state") == "plateauing", F.lit(False)), 0.1),
    }
    score = sum((F.when(c, v).otherwise(0.0) for c, v in reasons.values()), F.lit(0.0))
    why = F.array_join(F.array_compact(F.array(*[F.when(c, k) for k, (c, _) in reasons.items()])), ";")
    s = s.join(states.select(key, "state"), key, "left")
    return s.withColumns({"score": round_n(F.least(F.lit(1.0), score), 3), "reasons": why}).select(key, "n", "score", "reasons", F.when(F.col("score") >= 0.55, "elevated").when(F.col("score") >= 0.3, "watch").otherwise("none").alias("level"))


def client_state(tpi: Column) -> Column:
    return F.when(tpi <= 45, "stuck").when(tpi >= 56, "moving").otherwise("middling")


def next_moves(latest: DataFrame, profile: DataFrame, key: str) -> DataFrame:
    """Ranked moves for each key's current state: its own history where two cells of four or more exchanges exist and one helped, else the corpus prior."""
    now = latest.select(key, client_state(F.col("tpi")).alias("state"))
    own = now.join(profile.where("n >= 4"), [key, "state"]).select(key, "state", F.col("intervention").alias("move"), F.col("mean_lift").alias("score"), "n")
    w = Window.partitionBy(key)
    own = own.withColumns({"c_": F.count(F.lit(1)).over(w), "top_": F.max("score").over(w)}).where("c_ >= 2 and top_ > 0.01").drop("c_", "top_").withColumn("source", F.lit("own"))
    prior = latest.sparkSession.createDataFrame([(s, f, p, 0) for s, f, p in CORPUS_PRIOR], "state string, move string, score double, n long")
    rest = now.join(own.select(key).distinct(), key, "left_anti").join(F.broadcast(prior), "state").select(key, "state", "move", "score", "n").withColumn("source", F.lit("corpus"))  # twelve rows
    return own.unionByName(rest).withColumn("rank", F.row_number().over(w.orderBy(F.desc("score"), "move")))


def session_note(scored: DataFrame) -> Column:
    """A short note in a fixed order of sentences; it describes measurements only."""
    w, tpi = F.col("n_client_words"), F.col("tpi")
    best = F.array_max(F.array(*[F.struct(F.col(f"contribution_{d}").alias("c"), F.lit(-i).alias("i"), F.lit(d.replace("_", " ")).alias("d")) for i, d in enumerate(DIMENSIONS)]))
    parts = F.array(
        F.when(tpi >= 58, "The index lies above the client's own baseline.").when(tpi <= 42, "The index lies below the client's own baseline.").otherwise("The index lies near the client's own baseline."),
        F.when(best["c"] >= 0.6, F.concat(F.lit("Most of it comes from "), best["d"], F.lit("."))), F.when(F.col("confidence") < 0.6, "The session is short, so read it with care."),
        F.when(F.col("hopelessness") > 0.25, "Words of hopelessness are frequent."), F.when(F.col("rumination") > 0.25, "Backward-looking words are frequent."), F.when(w == 0, "The client is not heard."),
    )
    return F.array_join(F.array_compact(parts), " ")


def distinct_phrases(phrases: Column, most: int = 2) -> Column:
    """The first ``most`` of an array of phrases of which none contains another."""
    return F.aggregate(phrases, F.slice(phrases, 1, 0), lambda a, p: F.when((F.size(a) < most) & ~F.exists(a, lambda q: F.contains(q, p) | F.contains(p, q)), F.concat(a, F.array(p))).otherwise(a))
