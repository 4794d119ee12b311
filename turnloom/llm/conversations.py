"""Rebuilding conversations from message rows: connected components over reply links, then ordering and validation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.session import cut, hot_join

# Spellings of the two roles, after lower-casing and removing everything but letters.
THERAPIST_NAMES = (
    "therapist", "t", "th", "counsellor", "counselor", "councelor", "clinician", "psychologist", "interviewer", "practitioner", "helper",
    "doctor", "coach",
)
CLIENT_NAMES = ("client", "c", "cl", "patient", "pt", "participant", "helpseeker", "interviewee")

VISIBLE = r"[\p{L}\p{N}]"
_SHIFT = 4_294_967_296


def role_of(label: Column) -> Column:
    """'therapist', 'client', or null where the spelling names neither."""
    plain = F.regexp_replace(F.lower(label), r"[^\p{L}]", "")
    return F.when(plain.isin(*THERAPIST_NAMES), "therapist").when(plain.isin(*CLIENT_NAMES), "client")


def star_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Smallest node of each connected component by alternating large-star and small-star joins.

    ``edges(a, b)`` with comparable node ids; loops and repeated edges are allowed, null ends are ignored. Returns
    ``(node, root)`` for every node with an edge to another. Each half-round groups on one node id with map-side minima and joins that one row per
    node back; edges of a hub are salted over many tasks (``hot_join``), so a hub never gathers its neighbours in one task. Lineage is cut every round.
    """
    e = edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct()
    e = cut(e)
    before, n = None, e.count()
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        e = hot_join(both, low.withColumnRenamed("u", "a"), "a", rows=2 * n).where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()

        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        near = hot_join(down, low, "a", rows=2 * n)
        e = cut(near.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low).distinct())

        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        n = now[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b"))).distinct()


def link_conversations(messages: DataFrame, message_id: str, *links: str) -> DataFrame:
    """Conversation of every message that carries no conversation id: ``(message_id, conversation_id)``.

    ``links`` name the columns that hold the id of the message replied to or quoted. A link to an id that is no message, a
    null link and a link to itself tie nothing; a message without ties is a conversation of its own; repeated rows count
    once; null message ids are left out.
    """
    ids = messages.select(F.col(message_id).alias("node")).where("node is not null").distinct()
    ties = messages.select(F.col(message_id).alias("a"), F.explode(F.array(*[F.col(c) for c in links])).alias("b"))
    known = ties.where("b is not null").join(ids.withColumnRenamed("node", "b"), "b", "left_semi").select("a", "b")
    whole = isinstance(messages.schema[message_id].dataType, (T.LongType, T.IntegerType, T.ShortType))
    roots = chained_components(known) if whole else star_components(known)
    return (
        ids.join(roots, "node", "left")
        .select(F.col("node").alias(message_id), F.coalesce("root", "node").alias("conversation_id"))
    )


def contracted(links: DataFrame) -> DataFrame:
    """``(node, root)``: every node of each partition with the smallest node it is tied to there; a node that several partitions know may have several.

    Links are first put in ranges of their ids, so that those of one conversation mostly lie together and long chains cost no rounds. Nodes are 64-bit numbers.
    """

    def run(batches):
        for pdf in batches:
            names, at = np.unique(pdf[["a", "b"]].to_numpy().ravel(), return_inverse=True)
            a, b = at.reshape(-1, 2).T
            root = np.arange(len(names))
            while True:
                low = root.copy()
                np.minimum.at(low, a, root[b])
                np.minimum.at(low, b, root[a])
                np.minimum.at(low, root, low.copy())
                low = low[low]
                if (low == root).all():
                    break
                root = low
            yield pd.DataFrame({"node": names, "root": names[root]})

    whole = links.where("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    return whole.repartitionByRange("a").sortWithinPartitions("a").mapInPandas(run, "node long, root long")


def chained_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` as ``star_components``, for graphs of long chains: the star joins only tie the roots that partitions found, where a node has more than one."""
    local = cut(contracted(links))
    node = local.groupBy("node").agg(F.min("root").alias("low"), F.collect_set("root").alias("all"))  # as many roots as partitions that know the node
    ties = node.where(F.size("all") > 1).select(F.explode("all").alias("a"), F.col("low").alias("b"))
    top = star_components(ties).withColumnRenamed("node", "low")
    return hot_join(node.select("node", "low"), top, "low", how="left").select("node", F.coalesce("root", "low").alias("root"))


def _utterances(rows: DataFrame, cid: str, uid: str, who: str, text: str, keep_text: bool) -> DataFrame:
    """One row per (conversation, number) with at least one visible text, and whether its rows agree.

    Roles are numbers (1 therapist, 2 client) and texts are compared by a 64-bit hash, so that the aggregation stays in hash maps.
    """
    said = F.trim(F.regexp_replace(F.col(text), r"^[\s ]+|[\s ]+$", ""))
    role = F.when(role_of(F.col(who)) == "therapist", 1).when(role_of(F.col(who)) == "client", 2)
    seen = rows.select(F.col(cid).alias("c"), F.col(uid).alias("u"), role.alias("role"), said.alias("said")).where(F.col("said").rlike(VISIBLE))
    print_ = F.xxhash64("said")
    return seen.groupBy("c", "u").agg(
        F.min("role").alias("role"),
        F.max("role").alias("role2"),
        F.max(F.col("role").isNull()).alias("no_role"),
        (F.min(print_) != F.max(print_)).alias("two_texts"),
        *[F.min("said").alias("said")] * keep_text,
    )


def reply_runs(utterances: DataFrame, block: int = 16) -> DataFrame:
    """Unbroken runs of consecutive numbers within blocks of ``block`` numbers: ``(c, lo, hi)``.

    Up to ``block`` replies in a row are contracted to one node before the star joins, which saves them rounds on what is a chain anyway; links between the runs of one
    conversation are theirs. A conversation that holds a large share of all rows is spread over its blocks.
    """
    from pyspark.sql import Window

    n = utterances.select("c", "u", F.floor(F.col("u") / block).alias("block"))
    w = Window.partitionBy("c", "block").orderBy("u")
    island = n.withColumn("island", F.col("u") - F.row_number().over(w))
    return island.groupBy("c", "block", "island").agg(F.min("u").alias("lo"), F.max("u").alias("hi")).select("c", "lo", "hi")


def _node(c: Column, u: Column) -> Column:
    return c.cast("long") * F.lit(_SHIFT) + (u.cast("long") + F.lit(2_147_483_648))


def broken_chains(utterances: DataFrame, block: int = 16) -> DataFrame:
    """Conversations whose reply links fall into more than one component: ``(c)``."""
    runs = cut(reply_runs(utterances, block))
    left = runs.select(F.col("c"), F.col("lo"), (F.col("lo") - 1).alias("prev"))
    right = runs.select(F.col("c").alias("c2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
    links = left.join(right, (left.c == right.c2) & (left.prev == right.hi2))
    roots = star_components(links.select(_node(F.col("c"), F.col("lo")).alias("a"), _node(F.col("c2"), F.col("lo2")).alias("b")))
    nodes = runs.select("c", _node(F.col("c"), F.col("lo")).alias("node"))
    component = nodes.join(roots, "node", "left").select("c", F.coalesce("root", "node").alias("root"))
    return component.groupBy("c").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("c")


def judge_conversations(
    rows: DataFrame,
    conversation: str = "transcript_id",
    number: str = "utterance_id",
    speaker: str = "interlocutor",
    text: str = "utterance_text",
    block: int = 16,
    keep_text: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """``(verdicts, utterances)``: one verdict row per conversation, and the visible utterances in one row each.

    A text is visible if it has a letter or digit; other rows and rows without a number are ignored, and rows without a
    conversation id belong to none. Each utterance replies to the one numbered before it; the links' components say whether
    a number is missing. The reason is null for a whole conversation, else the first that holds: 'empty' (nothing visible), 'broken' (a number is missing between the
    lowest and the highest, visible rows of one number differ in role or text, or a role cannot be told), 'missing_reply'
    (one role only, or the last utterance is not the client's). Repeated rows, and copies that differ in the spelling of the role or in
    surrounding blanks, count once; an empty table gives no rows; other columns are not looked at.
    """
    known = rows.where(F.col(conversation).isNotNull())
    every = known.select(F.col(conversation).alias("c")).distinct()
    seen = cut(_utterances(known.where(F.col(number).isNotNull()), conversation, number, speaker, text, keep_text))
    facts = seen.groupBy("c").agg(
        F.max(F.col("no_role") | (F.col("role") != F.col("role2")) | F.col("two_texts")).alias("torn"),
        (F.min("role") != F.max("role")).alias("two_roles"),
        F.max_by("role", "u").alias("last_role"),
        F.min("u").alias("first_u"),
    )
    gaps = broken_chains(seen, block).withColumn("gap", F.lit(True))
    reason = (
        F.when(F.col("first_u").isNull(), "empty")
        .when(F.coalesce("gap", F.lit(False)) | F.coalesce("torn", F.lit(True)), "broken")
        .when(~F.col("two_roles") | (F.col("last_role") != 2), "missing_reply")
    )
    verdicts = every.join(facts, "c", "left").join(gaps, "c", "left").select(F.col("c"), reason.alias("reason"), "first_u")
    return verdicts, seen


def dropped_conversations(rows: DataFrame, conversation: str = "transcript_id", **names) -> DataFrame:
    """Conversations to drop, with the reason; see ``judge_conversations``."""
    verdicts, _ = judge_conversations(rows, conversation, keep_text=False, **names)
    return verdicts.where("reason is not null").select(F.col("c").alias(conversation), "reason")


def rebuild_conversations(rows: DataFrame, conversation: str = "transcript_id", number: str = "utterance_id", **names) -> DataFrame:
    """The utterances of the whole conversations in order: ``(conversation, turn_no, number, role, text)``.

    Numbers of a whole conversation have no holes, so the turn number needs no sort over the conversation.
    """
    verdicts, seen = judge_conversations(rows, conversation, number, **names)
    whole = verdicts.where("reason is null").select("c", "first_u")
    return hot_join(seen, whole, "c").select(
        F.col("c").alias(conversation),
        (F.col("u") - F.col("first_u") + 1).cast("int").alias("turn_no"),
        F.col("u").alias(number),
        F.when(F.col("role") == 1, "therapist").otherwise("client").alias("role"),
        F.col("said").alias("text"),
    )
