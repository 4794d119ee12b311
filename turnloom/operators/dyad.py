"""Two-speaker operators: interventions, turn pairs, lift per intervention, and response by client state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.functions.lexicon import FAMILY_DEFAULT, FAMILY_OF, INTERVENTIONS
from turnloom.functions.numeric import erf, mean_of_rounded, round_n, safe_corr, sd_or_zero
from turnloom.operators.blocks import carried
from turnloom.session import cut


def tag_intervention(text: Column, family: Column | None = None) -> Column:
    """Name of the first matching kind of move; with ``family``, only kinds of that family count and its default names the rest."""
    t = F.trim(text)
    out = F.when(F.endswith(t, F.lit("?")), "open_question").otherwise("other")
    if family is not None:
        out = F.lit("other")
        for name, default in FAMILY_DEFAULT.items():
            out = F.when(family == name, default).otherwise(out)
    for name, patterns in reversed(INTERVENTIONS):
        hit = t.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))
        out = F.when(hit & (family == FAMILY_OF[name]) if family is not None else hit, name).otherwise(out)
    return out


def turn_pairs(turns: DataFrame, *keys: str, order: str = "idx", min_next_words: int = 5) -> DataFrame:
    """Each therapist turn with the nearest client turn on either side and its lift.

    ``turns`` carry speaker, text, n_words (white-space words) and process_mean for client turns. The following client turn needs ``min_next_words`` words.
    """
    client = F.when(F.col("speaker") == "client", F.struct(F.col("process_mean").alias("pm"), F.col("n_space_words").alias("words")))
    move = F.when(F.col("speaker") == "therapist", tag_intervention(F.col("text"))).alias("intervention")
    rows = cut(turns.select(*keys, order, "speaker", move, "process_mean", "n_space_words"))  # scores and tags are worked out once
    near = carried(carried(rows, client, order, *keys, out="before_"), client, order, *keys, out="after_", ahead=True)
    pairs = near.where("speaker = 'therapist' and before_ is not null and after_.words >= %d" % min_next_words)
    return pairs.select(
        *keys, F.col(order).alias("therapist_idx"), "intervention",
        round_n(F.col("before_.pm"), 4).alias("before"), round_n(F.col("after_.pm"), 4).alias("after"), round_n(F.col("after_.pm") - F.col("before_.pm"), 4).alias("lift"),
    )


def intervention_impact(pairs: DataFrame, *keys: str, min_n: int = 3) -> DataFrame:
    """Lift per intervention: n, mean, sd, a normal 95 % interval, and whether it is reliable."""
    sums = pairs.groupBy(*keys, "intervention").agg(F.count(F.lit(1)).alias("n"), mean_of_rounded(F.col("lift")).alias("m"), sd_or_zero(F.col("lift")).alias("s"))
    se = F.col("s") / F.sqrt(F.col("n").cast("double"))
    return sums.select(
        *keys, "intervention", "n", round_n(F.col("m"), 4).alias("mean_lift"), round_n(F.col("s"), 4).alias("sd"),
        round_n(F.col("m") - 1.96 * se, 4).alias("ci_lo"), round_n(F.col("m") + 1.96 * se, 4).alias("ci_hi"),
        ((F.col("n") >= min_n) & (F.abs(F.col("m")) > 1.96 * se)).alias("reliable"),
    )


def top_moments(pairs: DataFrame, *keys: str, k: int = 5) -> DataFrame:
    """The ``k`` exchanges with the largest and the smallest lift per key, with rank."""
    opening = Window.partitionBy(*keys).orderBy(F.desc("lift"), "therapist_idx")
    closing = Window.partitionBy(*keys).orderBy("lift", F.desc("therapist_idx"))
    top = pairs.withColumns({"side": F.lit("opening"), "rank": F.row_number().over(opening)}).where(F.col("rank") <= k)
    low = pairs.withColumns({"side": F.lit("closing"), "rank": F.row_number().over(closing)}).where(F.col("rank") <= k)
    return top.unionByName(low).select(*keys, "side", "rank", "therapist_idx", "intervention", "lift")


def pooled_impact(impact: DataFrame, *keys: str) -> DataFrame:
    """Session means pooled by their number of pairs."""
    n = F.col("n").cast("double")
    sums = impact.groupBy(*keys, "intervention").agg(F.sum("n").alias("n"), (F.sum(n * F.col("mean_lift")) / F.sum(n)).alias("m"))
    return sums.select(*keys, "intervention", "n", round_n(F.col("m"), 4).alias("mean_lift"))


def state_of(value: Column, low: Column, high: Column) -> Column:
    return F.when(value <= low, "stuck").when(value >= high, "moving").otherwise("middling")


def response_profile(pairs: DataFrame, *keys: str, min_per_cell: int = 3, min_pairs: int = 12) -> DataFrame:
    """Lift by intervention and the client's state before, with states cut at the sorted values n//3 and 2n//3.

    The two cut points are exact order statistics found by ranking within keys; keys with fewer than ``min_pairs`` pairs and cells with fewer than ``min_per_cell`` are left out.
    """
    w = Window.partitionBy(*keys)
    ranked = pairs.withColumns({"r_": F.row_number().over(w.orderBy("before")) - 1, "n_": F.count(F.lit(1)).over(w)}).where(F.col("n_") >= min_pairs)
    cut = lambda k: F.max(F.when(F.col("r_") == F.floor(k * F.col("n_") / 3), F.col("before"))).over(w)
    cells = ranked.withColumns({"lo_": cut(1), "hi_": cut(2)}).withColumn("state", state_of(F.col("before"), F.col("lo_"), F.col("hi_")))
    sums = cells.groupBy(*keys, "intervention", "state").agg(F.count(F.lit(1)).alias("n"), mean_of_rounded(F.col("lift")).alias("m"), sd_or_zero(F.col("lift")).alias("s"))
    return sums.where(F.col("n") >= min_per_cell).select(
        *keys, "intervention", "state", "n", round_n(F.col("m"), 4).alias("mean_lift"), round_n(F.col("s"), 4).alias("sd"), round_n(F.col("s") / F.sqrt(F.col("n").cast("double")), 4).alias("se")
    )


def dependence(profile: DataFrame, *keys: str) -> DataFrame:
    """Per intervention with two or more states: spread of the means over states, whether it depends on the state, and whether its sign flips."""
    s = profile.groupBy(*keys, "intervention").agg(F.count(F.lit(1)).alias("n_states"), F.max("mean_lift").alias("hi"), F.min("mean_lift").alias("lo"))
    return s.where("n_states >= 2").select(*keys, "intervention", "n_states", round_n(F.col("hi") - F.col("lo"), 4).alias("spread"), ((F.col("hi") > 0) & (F.col("lo") < 0)).alias("sign_flip"), ((F.col("hi") - F.col("lo")) > 0.02).alias("depends"))


def best_moves(profile: DataFrame, *keys: str) -> DataFrame:
    """The move with the largest positive mean lift per state (ties: alphabetical)."""
    w = Window.partitionBy(*keys, "state").orderBy(F.desc("mean_lift"), "intervention")
    return profile.where("mean_lift > 0").withColumn("r_", F.row_number().over(w)).where("r_ = 1").select(*keys, "state", "intervention", "n", "mean_lift")


def triples(turns: DataFrame, *keys: str, order: str = "idx", min_words: int = 5) -> DataFrame:
    """Strictly adjacent client - therapist - client turns with ``min_words`` words on both sides, and the label of the next client turn."""
    rows = cut(turns.select(*keys, order, "speaker", "behaviour", "n_space_words", "process_mean", "client_talk_type"))
    row = F.struct("speaker", "n_space_words", "process_mean", "client_talk_type")
    around = carried(carried(rows, row, order, *keys, out="p"), row, order, *keys, out="x", ahead=True)
    return around.where(
        f"speaker = 'therapist' and p.speaker = 'client' and x.speaker = 'client' and p.n_space_words >= {min_words} and x.n_space_words >= {min_words}"
    ).select(
        *keys, F.col(order).alias("therapist_idx"), "behaviour", F.col("p.process_mean").alias("before"), F.col("x.process_mean").alias("after"),
        (F.col("x.process_mean") - F.col("p.process_mean")).alias("lift"), (F.col("x.client_talk_type") == "change").alias("next_change"),
    )


def state_conditional(rows: DataFrame, min_cell: int = 10) -> DataFrame:
    """P(change follows) per behaviour and state, states cut at the interpolated terciles of ``before`` over all rows; null in cells under ``min_cell``."""
    cuts = rows.agg(F.percentile("before", F.array(F.lit(1 / 3), F.lit(2 / 3))).alias("c"))
    held = rows.join(F.broadcast(cuts)).withColumn("state", state_of(F.col("before"), F.col("c")[0], F.col("c")[1]))  # one row of cut points
    sums = held.groupBy("behaviour", "state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce(F.col("next_change"), F.lit(False)).cast("int")).alias("n_change"))
    return sums.select("behaviour", "state", "n", "n_change", F.when(F.col("n") >= min_cell, round_n(F.col("n_change") / F.col("n"), 4)).alias("p_change"))


def chi2_yates(a: Column, b: Column, c: Column, d: Column) -> tuple[Column, Column]:
    """Chi-square of a 2x2 table with continuity correction, and its p with one degree of freedom; null where a margin is 0."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    n = a + b + c + d
    gap = F.greatest(F.lit(0.0), F.abs(a * d - b * c) - n / 2.0)
    stat = F.try_divide(n * gap * gap, (a + b) * (c + d) * (a + c) * (b + d))
    return stat, F.greatest(F.lit(0.0), 1.0 - erf(F.sqrt(stat / 2.0)))


def lead_lag(series: DataFrame, dims: tuple[str, ...], *keys: str, order: str = "session_number", min_sessions: int = 6) -> DataFrame:
    """Which dimension's change precedes which: correlations of first differences one step apart, both ways, for every ordered pair.

    One aggregation holds the correlation of every difference with every next difference; its cells become rows, so nothing is joined.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    d = series.withColumns({"n_": F.count(F.lit(1)).over(Window.partitionBy(*keys)), **{f"d_{x}": F.col(x) - F.lag(x).over(w) for x in dims}}).where(F.col("n_") >= min_sessions)
    d = d.withColumns({f"x_{x}": F.lead(f"d_{x}").over(w) for x in dims})
    pairs = [(a, b) for a in dims for b in dims if a != b]
    sums = d.groupBy(*keys).agg(*[safe_corr(F.col(f"d_{a}"), F.col(f"x_{b}")).alias(f"c_{a}_{b}") for a, b in pairs])
    cells = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c_{a}_{b}").alias("fwd"), F.col(f"c_{b}_{a}").alias("rev")) for a, b in pairs])
    both = sums.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.a", "x.b", "x.fwd", "x.rev").where("fwd is not null and rev is not null")
    asym = F.col("fwd") - F.col("rev")
    return both.select(*keys, "a", "b", round_n(F.col("fwd"), 4).alias("fwd"), round_n(F.col("rev"), 4).alias("rev"), round_n(asym, 4).alias("asymmetry"), ((asym > 0.25) & (F.col("fwd") > 0.2)).alias("strong"))
