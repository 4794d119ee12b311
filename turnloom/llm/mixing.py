"""Mixing sources to target weights: entropy balancing of document rates, rounded into copies."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: how this public vocabulary cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain_source(source: Column) -> Column:
    """One spelling per source: lower case, runs of other signs than letters and digits as one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(source), r"[^\p{L}\p{N}]+", "_"), "^_|_$", "")


def _counter(ranks: bytes):
    import tiktoken

    pairs = (line.split() for line in ranks.splitlines() if line)
    return tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in pairs}, special_tokens={})


def token_counts(docs: DataFrame, doc_id: str, text: str, keep: dict[str, Column], tokenizer: str = TOKENIZER) -> DataFrame:
    """``(doc_id, *keep, n_tokens)`` for rows with an id; null texts have 0 tokens. The vocabulary (under 2 MB) is read on the driver and sent out."""
    shared = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_bytes())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _counter(shared.value).encode_ordinary
        for pdf in batches:
            yield pdf.drop(columns="t__").assign(n_tokens=[0 if t is None else len(encode(t)) for t in pdf["t__"]])

    rows = docs.select(F.col(doc_id).alias("id__"), *[c.alias(k) for k, c in keep.items()], F.col(text).alias("t__")).where("id__ is not null")
    out = rows.drop("t__").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in out) + ", n_tokens long"
    return spread(rows).mapInPandas(count, schema).withColumnRenamed("id__", doc_id)


def plan_budgets(targets: dict[str, tuple[float, int]], tokens: dict[str, int], total: int | None = None) -> dict[str, float]:
    """Wanted tokens per source.

    Shares are divided by their sum over the sources that have any tokens. Without ``total``, it is the largest at which every such source reaches its share within its repeats;
    with it, a source that would need more is held at its most and falls short.
    """
    have = {s: (w, cap) for s, (w, cap) in targets.items() if w > 0 and tokens.get(s, 0) > 0}
    weight = sum(w for w, _ in have.values())
    most = {s: cap * tokens[s] for s, (_, cap) in have.items()}
    if total is None:
        total = min((most[s] * weight / w for s, (w, _) in have.items()), default=0)
    return {s: min(most[s], total * w / weight) for s, (w, _) in have.items()}


def tilt(histogram: DataFrame, budgets: dict[str, float], caps: dict[str, int], means: dict[str, float], tolerance: float = 1e-9, max_rounds: int = 80) -> dict[str, float]:
    """Multipliers of the convex dual, one per source: rates min(cap, exp(lambda * tokens / mean)) meet the token budgets.

    ``histogram(source, n_tokens, n)`` holds the sufficient statistics of all documents. Each Newton round is one distributed aggregation of gradient and curvature for all
    sources at once, ``max_rounds`` at most, beyond which it raises; a step that leaves the bracket is replaced by its middle. A source that needs its cap throughout gets infinity.
    """
    lam, low, high = {}, {}, {}
    for s, b in budgets.items():
        full = b >= caps[s] * means[s][1] * (1 - 1e-12)
        lam[s], low[s], high[s] = (math.inf if full else 0.0), -math.inf, math.inf
    open_ = {s for s in lam if lam[s] != math.inf}
    for _ in range(max_rounds):
        if not open_:
            break
        g = F.lit(None).cast("double")
        cap = F.lit(None).cast("double")
        for s in open_:
            g = F.when(F.col("source") == s, F.lit(lam[s]) * F.col("n_tokens") / F.lit(means[s][0])).otherwise(g)
            cap = F.when(F.col("source") == s, F.lit(math.log(caps[s]))).otherwise(cap)
        unit = F.when(F.col("source").isNull(), F.lit(0.0))
        for s in open_:
            unit = F.when(F.col("source") == s, F.col("n_tokens") / F.lit(means[s][0])).otherwise(unit)
        rate = F.exp(F.least("g", "cap"))
        grad = F.sum(F.col("n") * F.col("n_tokens") * rate)
        curve = F.sum(F.when(F.col("g") < F.col("cap"), F.col("n") * F.col("n_tokens") * F.col("unit") * rate).otherwise(0.0))
        rows = (
            histogram.where(F.col("source").isin(*open_)).withColumns({"g": g, "cap": cap, "unit": unit})
            .groupBy("source").agg(grad.alias("total"), curve.alias("curve")).collect()
        )
        for r in rows:
            s, gap = r["source"], r["total"] - budgets[r["source"]]
            if abs(gap) <= tolerance * budgets[s]:
                open_.discard(s)
                continue
            low[s], high[s] = (lam[s], high[s]) if gap < 0 else (low[s], lam[s])
            step = lam[s] - gap / r["curve"] if r["curve"] else math.inf
            if not low[s] < step < high[s] or not math.isfinite(step):
                step = (low[s] + high[s]) / 2 if math.isfinite(low[s] + high[s]) else (2 * low[s] + 1 if math.isfinite(low[s]) else 2 * high[s] - 1)
            if step == lam[s]:
                open_.discard(s)
            lam[s] = step
    else:
        if open_:
            raise RuntimeError(f"multipliers of {sorted(open_)} did not settle in {max_rounds} rounds")
    return lam


def mix_sources(
    docs: DataFrame,
    targets: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    total_tokens: int | None = None,
    tokenizer: str = TOKENIZER,
    ranks: int = 64,
) -> DataFrame:
    """``(doc_id, source, n_tokens, rate, copies)`` of every document of a source with a target; copies may be 0.

    ``targets(source, target_share, max_repeats)`` is a small fixed table; a null or non-positive share is no target, max_repeats below 1 or null counts as 1,
    the first of several rows of one source (by share) holds. Sources are compared in one spelling; documents of other sources, without a source or
    without an id are left out; null and empty texts have no tokens and get no copies; a document given twice counts as two; empty tables give no rows.

    Rates come from entropy balancing (see ``tilt``). Copies are rounded systematically along the lengths of a source: each document gets its rate rounded down or
    up, and the running total never strays by one copy, so that totals hit the budget to about one document. Positions within a length come from hash
    buckets with offsets, so that a source or length that holds a third of all documents is never sorted in one task. Only per-source sums reach the driver.
    """
    wanted = {
        r["source"]: (r["target_share"], max(1, r["max_repeats"] or 1))
        for r in targets.select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats")
        .where("source is not null and target_share > 0").orderBy("source", F.desc("target_share"), F.desc("max_repeats")).collect()[::-1]
    }
    named = docs.where(plain_source(F.col(source)).isin(*wanted)) if wanted else docs.where("false")
    counted = cut(token_counts(named, doc_id, text, {"source": plain_source(F.col(source))}, tokenizer))
    histogram = cut(counted.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    sums = {r["source"]: (int(r["t"]), int(r["n"])) for r in histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("n_tokens")).alias("t"), F.sum("n").alias("n")).collect()}
    budgets = plan_budgets(wanted, {s: t for s, (t, _) in sums.items()}, total_tokens)
    caps = {s: wanted[s][1] for s in budgets}
    lam = tilt(histogram, budgets, caps, {s: (t / n, t) for s, (t, n) in sums.items()})
    rate = F.lit(0.0)
    for s, value in lam.items():
        mean = sums[s][0] / sums[s][1]
        own = F.lit(float(caps[s])) if value == math.inf else F.least(F.lit(float(caps[s])), F.exp(F.lit(value) * F.col("n_tokens") / F.lit(mean)))
        rate = F.when((F.col("source") == s) & (F.col("n_tokens") > 0), own).otherwise(rate)

    along = Window.partitionBy("source").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    starts = histogram.withColumn("rate", rate).select("source", "n_tokens", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(along), F.lit(0.0)).alias("before"))
    bucketed = counted.withColumn("rate", rate).withColumn("bucket", F.pmod(F.xxhash64(doc_id), F.lit(ranks)).cast("int"))
    upto = Window.partitionBy("source", "n_tokens").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = bucketed.groupBy("source", "n_tokens", "bucket").agg(F.count(F.lit(1)).alias("n")).select(
        "source", "n_tokens", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy("source", "n_tokens", "bucket").orderBy(F.xxhash64(doc_id, F.lit(1)), doc_id)
    placed = bucketed.withColumn("k", F.row_number().over(inside)).join(offsets, ["source", "n_tokens", "bucket"]).join(starts, ["source", "n_tokens"], "left")
    at = lambda k: F.floor(F.col("before") + F.col("rate") * k + F.lit(0.5 + 1e-9))
    k = F.col("k") + F.col("offset")
    copies = F.when(F.col("rate") > 0, at(k) - at(k - 1)).otherwise(F.lit(0))
    return placed.select(doc_id, "source", "n_tokens", "rate", copies.cast("int").alias("copies"))


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``(source, target_share, max_repeats, n_documents, source_tokens, mixed_documents, mixed_tokens, actual_share, most_copies)`` for every target."""
    per = mixed.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_documents"),
        F.sum("n_tokens").alias("source_tokens"),
        F.sum("copies").alias("mixed_documents"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"),
        F.max("copies").alias("most_copies"),
    )
    total = per.agg(F.sum("mixed_tokens").alias("all_tokens"))
    want = targets.select(plain_source(F.col("source")).alias("source"), "target_share", "max_repeats").where("source is not null").distinct()
    zero = {c: 0 for c in ("n_documents", "source_tokens", "mixed_documents", "mixed_tokens", "most_copies")}
    joined = want.join(per, "source", "left").fillna(zero).crossJoin(F.broadcast(total))  # one row
    share = F.coalesce(F.try_divide(F.col("mixed_tokens").cast("double"), F.col("all_tokens").cast("double")), F.lit(0.0))
    return joined.select("source", "target_share", "max_repeats", "n_documents", "source_tokens", "mixed_documents", "mixed_tokens", share.alias("actual_share"), "most_copies")
