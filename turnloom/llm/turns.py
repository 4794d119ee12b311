"""Clean, ordered speaker turns from transcripts and from recorder rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom.llm.transcript import Entry, label_of, parse, split_label, strip_stamps, without_hesitation, without_notes, words_said
from turnloom.session import cut, hot_join, spread

ROW = "key string, role string, start double, says boolean, asks boolean, text string"
MIN_OVERLAP = 3


def overlap(before: list[str], after: list[str], least: int = MIN_OVERLAP) -> int:
    """Words at the end of ``before`` that ``after`` repeats at its start: the longest suffix-prefix overlap of ``least`` words or more.

    The failure function of ``after`` runs once over the tail of ``before``, so the cost is linear.
    """
    a, b = [w.casefold() for w in before[-len(after) :]] if after else [], [w.casefold() for w in after]
    if len(a) < least or len(b) < least:
        return 0
    fail, k = [0] * len(b), 0
    for i in range(1, len(b)):
        while k and b[i] != b[k]:
            k = fail[k - 1]
        k += b[i] == b[k]
        fail[i] = k
    k = 0
    for w in a:
        while k and (k == len(b) or w != b[k]):
            k = fail[k - 1]
        k += k < len(b) and w == b[k]
    return k if k >= least else 0


def sweep(entries: list[Entry]) -> list[Entry]:
    """Entries by start time where each carries one (a sweep over the starts, ties by line); else as they stand."""
    if entries and all(e.start is not None for e in entries):
        return sorted(entries, key=lambda e: (e.start, e.line_no))
    return entries


def rolls_on(before: Entry | None, entry: Entry) -> bool:
    """Whether ``entry`` may be the next of rolling captions: it directly follows an entry of its speaker, and their cues overlap or touch or neither has a time.

    A stamp without an end shows no overlap, so stamped entries are left as they are.
    """
    if before is None or before.key != entry.key:
        return False
    if before.start is None and entry.start is None:
        return True
    return before.end is not None and entry.start is not None and entry.start <= before.end


def clean_entries(text: str) -> list[tuple]:
    """``(line_no, key, role, start, says, asks, text)`` of one transcript; words of rolling captions are removed from the later of two directly neighbouring entries.

    Whether an entry says or asks something is judged before that, so none is dropped for it; an entry without a time that only repeats keeps its words.
    """
    out, before, last = [], None, []
    for e in sweep(parse(text)[0]):
        said = without_notes(e.text)
        words = said.split()
        k = overlap(last, words) if rolls_on(before, e) else 0
        if k == len(words) and e.start is None:
            k = 0
        before, last = e, words
        out.append((e.line_no, e.key, e.role, e.start, words_said(said), "?" in said or "？" in said, without_hesitation(" ".join(words[k:]) if k else said)))
    return out


def roles_of(entries: list[tuple]) -> dict[str, str]:
    """The role of every label of one transcript, by the rule of ``speaker_roles``."""
    role: dict[str, str | None] = {}
    says: dict[str, int] = {}
    asks: dict[str, int] = {}
    for _, key, named, _, says_it, asks_it, _ in entries:
        role[key] = max(filter(None, (role.get(key), named)), default=None)
        says[key], asks[key] = says.get(key, 0) + says_it, asks.get(key, 0) + asks_it
    rate = {k: asks[k] / max(1, says[k]) for k in role}
    mean = {r: sum(own) / len(own) for r in ("therapist", "client") if (own := [rate[k] for k in role if role[k] == r])}
    first: dict[str, int] = {}
    for e in entries:
        first[e[1]] = min(first.get(e[1], e[0]), e[0])
    guess = {}
    if len(mean) == 2:
        guess = {k: "therapist" if abs(rate[k] - mean["therapist"]) < abs(rate[k] - mean["client"]) else "client" for k in role}
    elif mean:
        guess = dict.fromkeys(role, "client" if "therapist" in mean else "therapist")
    elif role:
        most = min(role, key=lambda k: (-rate[k], first[k]))
        guess = {k: "therapist" if k == most else "client" for k in role}
    return {k: role[k] or guess[k] for k in role}


def transcript_turns(text: str, pause: float | None = None) -> list[tuple[int, str, str]]:
    """``(line_no, speaker, text)`` of one transcript: entries without content dropped, neighbours of one speaker joined, line_no of the first entry.

    Entries come in the order of the sweep; ``pause`` also starts a new turn where the starts of neighbouring entries of one speaker lie further apart, in seconds.
    """
    entries = clean_entries(text)
    roles, turns, start = roles_of(entries), [], None
    for line_no, key, _, at, says, _, said in entries:
        if not says:
            continue
        far = pause is not None and at is not None and start is not None and at - start > pause
        if turns and turns[-1][1] == roles[key] and not far:
            turns[-1][2].append(said)
        else:
            turns.append((line_no, roles[key], [said]))
        start = at
    return [(n, who, " ".join(filter(None, parts))) for n, who, parts in turns]


def _pauses(text: str) -> list[float]:
    """Differences between the starts of neighbouring entries of one speaker."""
    entries = [e for e in clean_entries(text) if e[4]]
    roles = roles_of(entries)
    return [b[3] - a[3] for a, b in zip(entries, entries[1:]) if a[3] is not None and b[3] is not None and roles[a[1]] == roles[b[1]]]


def _each(make, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(s, *row) for s, t in zip(pdf["sid"].tolist(), pdf["t"]) for row in make(t)], columns=["sid", *columns])

    return run


def _transcripts(df: DataFrame, session: str, text: str) -> DataFrame:
    """``(sid, t)``: one text per session, the longest (ties: the last in order) where it has several different ones."""
    rows = df.select(F.col(session).alias("sid"), F.col(text).alias("t")).where("sid is not null and t is not null")
    return spread(rows, "sid").groupBy("sid").agg(F.max(F.struct(F.length("t").alias("n"), "t")).alias("m")).select("sid", "m.t")


def turns_of_transcripts(df: DataFrame, session: str = "session_id", text: str = "transcript", pause: float | None = None, keep_text: bool = True) -> DataFrame:
    """``(sid, line_no, speaker[, text])`` of every transcript. A transcript is one row, so all of it is done where it is read; texts are shuffled once, to count repeated rows once."""
    rows = _transcripts(df, session, text)
    sid = rows.schema["sid"].dataType.simpleString()
    if keep_text:
        return rows.mapInPandas(_each(lambda t: transcript_turns(t, pause), ["line_no", "speaker", "text"]), f"sid {sid}, line_no int, speaker string, text string")
    return rows.mapInPandas(_each(lambda t: [x[:2] for x in transcript_turns(t, pause)], ["line_no", "speaker"]), f"sid {sid}, line_no int, speaker string")


def calibrated_pause(df: DataFrame, session: str = "session_id", text: str = "transcript", quantile: float = 0.99) -> float | None:
    """The pause between neighbouring starts of one speaker that ``quantile`` of all such pauses of all transcripts stay under; null where none has times."""
    rows = _transcripts(df, session, text)
    pauses = rows.mapInPandas(_each(lambda t: [(p,) for p in _pauses(t)], ["pause"]), f"sid {rows.schema['sid'].dataType.simpleString()}, pause double")
    return pauses.agg(F.percentile_approx("pause", quantile, 10_000)).first()[0]


def _row(label: pd.Series, text: pd.Series) -> pd.DataFrame:
    """One recorder row: its label, and its text without stamps, notes and a repeated label."""
    out = []
    for stored, said in zip(label, text):
        stored = "" if stored is None else stored.strip()
        found = (label_of(stored) or (stored.casefold(), None)) if stored else (None, None)
        bare, at = strip_stamps(" ".join((said or "").split()))
        if inner := split_label(bare):
            if inner[0] == found[0] or inner[1] is not None and inner[1] == found[1]:
                bare = inner[2]
        rest = without_notes(bare)
        out.append((*found, at, words_said(rest), "?" in rest or "？" in rest, without_hesitation(rest)))
    return pd.DataFrame(out, columns=["key", "role", "start", "says", "asks", "text"]).astype({"start": "float64"})


def _carried(df: DataFrame, value: Column, order: str, block: int, inclusive: bool) -> DataFrame:
    """``df`` with ``carried``: the last non-null ``value`` at or (not inclusive) before each row of a session.

    The window runs within blocks of ``order``; one summary row per block carries the value on, so that a session that holds a large share of all rows is
    never sorted in one task.
    """
    own = df.withColumn("blk", F.floor(F.col(order) / block)).withColumn("val", value)
    inside = Window.partitionBy("sid", "blk").orderBy(order)
    end = 0 if inclusive else -1
    near = F.last("val", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, end))
    blocks = own.where("val is not null").groupBy("sid", "blk").agg(F.max_by("val", order).alias("v"))
    every = own.groupBy("sid", "blk").agg(F.count(F.lit(1)).alias("n")).join(blocks, ["sid", "blk"], "left")
    over = Window.partitionBy("sid").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    far = every.select("sid", "blk", F.last("v", ignorenulls=True).over(over).alias("far"))
    return own.withColumn("near", near).join(far, ["sid", "blk"]).withColumn("carried", F.coalesce("near", "far")).drop("near", "far", "val", "blk")


def entries_of_rows(
    df: DataFrame, session: str = "session_id", number: str = "idx", label: str = "raw_label", text: str = "text", block: int = 4096
) -> DataFrame:
    """``(sid, line_no, key, role, start, says, asks, text)`` from rows already cut: a labelled row with the unlabelled rows after it; line_no is the number of the labelled row."""
    rows = df.select(F.col(session).alias("sid"), F.col(number).cast("int").alias("n"), F.col(label).alias("l"), F.col(text).alias("t"))
    rows = rows.where("sid is not null and n is not null").distinct()
    own = cut(spread(rows).select("sid", "n", F.pandas_udf(_row, ROW)("l", "t").alias("r")).select("sid", "n", "r.*"))
    head = _carried(own, F.when(F.col("key").isNotNull(), F.col("n")), "n", block, inclusive=True).where("carried is not null")
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("n", "text"))))
    return head.groupBy("sid", F.col("carried").alias("line_no")).agg(
        F.min_by("key", "n").alias("key"),
        F.min_by("role", "n").alias("role"),
        F.min("start").alias("start"),
        F.max("says").alias("says"),
        F.max("asks").alias("asks"),
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text"),
    )


def speaker_roles(entries: DataFrame) -> DataFrame:
    """``(sid, key, speaker)``: the role of every label of a session.

    A label that names a role keeps it. Else, where the session's other labels name one role only, the label has the other one; where they name
    both, it goes with the role whose share of questions is nearer; where none does, the therapist is the label that asks in the largest share of its entries (ties: the one that comes first), and all others are the client.
    """
    labels = entries.groupBy("sid", "key").agg(
        F.max("role").alias("role"),
        (F.sum(F.col("asks").cast("int")) / F.greatest(F.sum(F.col("says").cast("int")), F.lit(1))).alias("rate"),
        F.min("line_no").alias("first"),
    )
    all_ = Window.partitionBy("sid")
    named = lambda r: F.max(F.when(F.col("role") == r, 1).otherwise(0)).over(all_) == 1
    rate = lambda r: F.avg(F.when(F.col("role") == r, F.col("rate"))).over(all_)
    rank = F.row_number().over(all_.orderBy(F.desc("rate"), "first"))
    near = F.abs(F.col("rate") - rate("therapist")) < F.abs(F.col("rate") - rate("client"))
    guess = (
        F.when(named("therapist") & named("client"), F.when(near, "therapist").otherwise("client"))
        .when(named("therapist"), "client")
        .when(named("client"), "therapist")
        .otherwise(F.when(rank == 1, "therapist").otherwise("client"))
    )
    return labels.select("sid", "key", F.coalesce("role", guess).alias("speaker"))


def _said(entries: DataFrame) -> DataFrame:
    label = F.concat_ws("\u0001", F.col("sid").cast("string"), "key")
    roles = speaker_roles(entries).select(label.alias("label"), "speaker")
    said = hot_join(entries.where("says").withColumn("label", label), roles, "label")
    return said.select("sid", "line_no", "speaker", *[c for c in ("start", "text") if c in entries.columns])


def speaker_turns(entries: DataFrame, block: int = 4096, pause: float | None = None) -> DataFrame:
    """``(sid, line_no, speaker, text)``: entries without content dropped, neighbours of one speaker joined, line_no of the first entry.

    ``pause`` also starts a new turn where the starts of neighbouring entries of one speaker lie further apart, in seconds.
    """
    said = _said(entries)
    before = _carried(said, F.struct("speaker", "start"), "line_no", block, inclusive=False)
    new = F.col("carried").isNull() | (F.col("carried.speaker") != F.col("speaker"))
    if pause is not None:
        new = new | F.coalesce(F.col("start") - F.col("carried.start") > pause, F.lit(False))
    heads = before.withColumn("head", F.when(new, F.col("line_no"))).drop("carried")
    whole = _carried(heads, F.col("head"), "line_no", block, inclusive=True)
    parts = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("line_no", "text"))))
    return whole.groupBy("sid", F.col("carried").alias("head_line"), "speaker").agg(
        F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("text")
    ).select("sid", F.col("head_line").alias("line_no"), "speaker", "text")


def turn_heads(entries: DataFrame, block: int = 4096) -> DataFrame:
    """``(sid, line_no, speaker)`` of the turns, without their text."""
    said = _said(entries).select("sid", "line_no", "speaker")
    before = _carried(said, F.col("speaker"), "line_no", block, inclusive=False)
    return before.where("carried is null or carried <> speaker").select("sid", "line_no", "speaker")


def session_turns(transcripts: DataFrame, rows: DataFrame, pause: float | None = None, keep_text: bool = True) -> DataFrame:
    """``(sid, line_no, speaker[, text])``: clean turns of transcripts and of recorder rows.

    A session that has a transcript and rows has turns from both. Null and blank transcripts, rows without session or number, rows before the first label and
    headers give no turn; repeated rows count once; a session with several different transcripts is read from the longest; empty tables give no rows; other columns are not looked at.
    """
    spoken = turns_of_transcripts(transcripts, pause=pause, keep_text=keep_text)
    entries = cut(entries_of_rows(rows))
    recorded = speaker_turns(entries, pause=pause) if keep_text else turn_heads(entries.drop("text"))
    return spoken.unionByName(recorded.withColumn("line_no", F.col("line_no").cast("int")))
