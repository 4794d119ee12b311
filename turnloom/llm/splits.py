"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.session import cut, hot_join

# Words that stand for an absent code, after removing everything but letters and digits.
ABSENT_CODES = ("", "na", "none", "null", "nan", "unknown", "missing", "tbd", "notavailable", "notapplicable")


def plain_code(code: Column) -> Column:
    """One spelling per code: letters and digits in lower case; null for an absent code."""
    plain = F.regexp_replace(F.lower(code), r"[^\p{L}\p{N}]", "")
    return F.when(~plain.isin(*ABSENT_CODES), plain)


def code_ties(rows: DataFrame, record: str, *codes: str) -> DataFrame:
    """``(a, b)``: each record and the smallest record that shares one of its codes.

    The smallest record of a code stands for the code, so a code that a third of all rows carry adds one edge per record, never
    all pairs; it is found with map-side minima and joined back as one row per code.
    """
    pairs = None
    for i, c in enumerate(codes):
        part = rows.select(F.col(record).alias("a"), F.concat(F.lit(f"{i}:"), plain_code(F.col(c))).alias("code"))
        pairs = part if pairs is None else pairs.union(part)
    pairs = cut(pairs.where("a is not null and code is not null").distinct())
    least = pairs.groupBy("code").agg(F.min("a").alias("b"))
    return hot_join(pairs, least, "code").where("a <> b").select("a", "b").distinct()


def hook_and_shortcut(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest record of each component: ``(node, parent)`` for every node of an edge.

    Every round joins the parent table with itself (grandparents), hooks the parent and the node of one end of an edge onto
    the grandparent of the other end where that is smaller, and shortcuts each node to its grandparent; all three are minima per node
    with map-side combining. It ends when no grandparent changes. Lineage is cut every round.
    """
    e = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    parent = cut(e.select(F.col("a").alias("node")).distinct().withColumn("parent", F.col("node")))
    before, n = None, e.count()
    for _ in range(max_rounds):
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("gp"))
        near = hot_join(parent, up, "parent", rows=n).select("node", "parent", "gp")  # the root of a giant group is a hot key, as is a record with many edges
        other = near.select(F.col("node").alias("b"), F.col("gp").alias("other_gp"))
        least = hot_join(e, other, "b", rows=n).groupBy("a").agg(F.min("other_gp").alias("other_gp"))
        hooks = near.join(least, near.node == least.a, "left")
        moves = hooks.select(
            F.explode(
                F.array(
                    F.struct(F.col("node").alias("node"), F.least("gp", "other_gp").alias("to")),
                    F.struct(F.col("parent").alias("node"), F.least("gp", "other_gp").alias("to")),
                )
            ).alias("x")
        )
        parent = cut(moves.groupBy("x.node").agg(F.min("x.to").alias("parent")))
        now = tuple(parent.agg(F.sum(F.col("parent").cast("decimal(38,0)")), F.count(F.lit(1))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return parent


def related_groups(rows: DataFrame, record: str = "transcript_id", codes: tuple[str, ...] = ("client_code", "recording_code")) -> DataFrame:
    """``(record, group_id)`` for records tied to at least one other; group_id is the smallest record of the group.

    Codes are compared by their letters and digits in lower case; null, empty and placeholder codes tie nothing; rows without
    a record are ignored; repeated rows and several rows per record are fine; an empty table gives no rows; other columns are not looked at.
    """
    parents = hook_and_shortcut(code_ties(rows, record, *codes))
    return parents.select(F.col("node").alias(record), F.col("parent").alias("group_id"))


def closest_subset(sizes: dict[int, int], target: int) -> dict[int, int]:
    """How many groups of each size to take so that their total is as near to ``target`` as any choice gets (ties: the smaller total).

    Reachable totals are a bitset that is shifted by each size, its multiplicity split into powers of two; for each total only the
    size that reached it first is kept, which is enough to walk back. Totals above twice the target are never nearest (zero is nearer), so
    the bitset has 2 * target + 1 bits, and the walk table four bytes a total. No further size is tried once the target itself is reached.
    """
    limit = min(2 * target, sum(s * n for s, n in sizes.items()))
    mask = (1 << (limit + 1)) - 1
    reach, first, order = 1, np.zeros(limit + 1, np.uint32), sorted(sizes, reverse=True)
    for k, size in enumerate(order, 1):
        now, left, step = reach, min(sizes[size], limit // size), 1
        while left > 0:
            take = min(step, left)
            now |= (now << (take * size)) & mask
            left, step = left - take, step * 2
        fresh = np.unpackbits(np.frombuffer((now & ~reach).to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little")[: limit + 1]
        first[fresh.astype(bool)] = k
        reach = now
        if target <= limit and reach >> target & 1:
            break
    total = min((t for t in range(limit + 1) if reach >> t & 1), key=lambda t: (abs(t - target), t)) if limit < 4096 else _nearest(reach, limit, target)
    taken: dict[int, int] = {}
    while total:
        size, k = order[first[total] - 1], first[total]
        while total and first[total] == k:
            taken[size], total = taken.get(size, 0) + 1, total - size
    return taken


def _nearest(reach: int, limit: int, target: int) -> int:
    bits = np.unpackbits(np.frombuffer(reach.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little")[: limit + 1]
    totals = np.flatnonzero(bits)
    return int(totals[np.lexsort((totals, np.abs(totals - target)))[0]])


def split_records(
    records: DataFrame,
    ties: DataFrame,
    record: str = "transcript_id",
    codes: tuple[str, ...] = ("client_code", "recording_code"),
    shares: tuple[tuple[str, float], ...] = (("train", 0.8), ("validation", 0.1), ("test", 0.1)),
    ranks: int = 64,
) -> DataFrame:
    """``(record, group_id, split)`` for every distinct record: groups stay whole, and split totals are the closest the group sizes allow.

    The driver only sees how many groups there are of each size (at most about the square root of twice the number of records
    rows), never the groups. The last splits are filled first, the first one takes the rest. Which groups of a size go where is decided by a
    hash order, ranked in ``ranks`` hash buckets per size, so that one common size is not sorted in one task. Records without ties are groups
    of one; null records are left out; an empty table gives no rows.
    """
    ids = records.select(F.col(record).alias("node")).where("node is not null").distinct()
    groups = related_groups(ties, record, codes).select(F.col(record).alias("node"), "group_id")
    member = cut(ids.join(groups, "node", "left").select("node", F.coalesce("group_id", "node").alias("group_id")))
    sized = member.groupBy("group_id").agg(F.count(F.lit(1)).alias("size"))
    sized = cut(sized.withColumn("bucket", F.pmod(F.xxhash64("group_id"), F.lit(ranks)).cast("int")))
    buckets = sized.groupBy("size", "bucket").agg(F.count(F.lit(1)).alias("n"))
    left = {int(r["size"]): int(r["n"]) for r in sized.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(s * n for s, n in left.items())
    cuts: list[tuple[int, str, int]] = []
    used: dict[int, int] = {}
    for name, share in reversed(shares[1:]):
        taken = closest_subset({s: n for s, n in left.items() if n}, round(total * share))
        for s, n in taken.items():
            used[s], left[s] = used.get(s, 0) + n, left[s] - n
            cuts.append((s, name, used[s]))
    upto = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.select("size", "bucket", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("size", "bucket").orderBy("group_id")
    ranked = sized.join(offsets, ["size", "bucket"]).select(
        "group_id", "size", (F.row_number().over(inside) + F.col("offset")).alias("rank")
    )
    spark = records.sparkSession
    plan = spark.createDataFrame([(s, n, u) for s, n, u in cuts], "size long, split string, upto long")
    chosen = ranked.join(F.broadcast(plan.groupBy("size").agg(F.array_sort(F.collect_list(F.struct("upto", "split"))).alias("plan"))), "size", "left")
    hit = F.filter(F.coalesce("plan", F.array()), lambda p: p["upto"] >= F.col("rank"))
    label = F.coalesce(F.try_element_at(hit, F.lit(1))["split"], F.lit(shares[0][0]))
    return member.join(chosen.select("group_id", label.alias("split")), "group_id").select(F.col("node").alias(record), "group_id", "split")
