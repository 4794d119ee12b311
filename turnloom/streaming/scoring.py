"""Structured Streaming forms: scoring turns as they arrive, windowed counts with late data, deduplicated sessions and live turn merging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from turnloom.operators.index import baselines, index_sessions
from turnloom.operators.score import score_utterances


def score_stream(turns: DataFrame, text: str = "text") -> DataFrame:
    """Stateless scoring of each turn; the same expressions as in batch, so append mode gives the batch result."""
    return score_utterances(turns, text)


def windowed_counts(events: DataFrame, ts: str = "ts", key: str = "event_type", width: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Events per window and key; rows later than ``late`` behind the watermark are left out."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("from_ts"), key, "n")


def latest_sessions(sessions: DataFrame, ts: str = "created_at", late: str = "1 day") -> DataFrame:
    """Each (client, session number) once within the watermark, as the upsert key of the store."""
    return sessions.withWatermark(ts, late).dropDuplicatesWithinWatermark(["client_id", "session_number"])


def rescored(features: DataFrame, touched: DataFrame, key: str = "client_id") -> DataFrame:
    """The index of every session of the touched clients, against baselines built anew from their first sessions; other clients are not read past the semi join."""
    own = features.join(touched.select(key).distinct(), key, "left_semi")
    return index_sessions(own, baselines(own))


def rescore_clients(write):
    """A foreachBatch function that hands the clients touched by a batch to ``write(clients, batch_id)``, which rescores them whole."""

    def run(batch: DataFrame, batch_id: int) -> None:
        write(batch.select("client_id").distinct(), batch_id)

    return run


def merge_live_lines(lines: DataFrame, timeout_ms: int | None = None) -> DataFrame:
    """Turns from recognised lines (session_id, idx, speaker, text): a turn is emitted once another speaker begins, the session closes, or nothing comes for ``timeout_ms``.

    A row without a speaker closes its session: its open turn is emitted and its state removed. The state of a session is its open turn only. Lines of one batch are merged in
    the order of idx. With a timeout the query keeps waking up, so it never ends by itself; without one, an open turn waits for its session to go on or close.
    """
    columns = ["session_id", "first_idx", "speaker", "text"]

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        speaker, text, first = state.get if state.exists else ("", "", -1)
        done = []
        if state.hasTimedOut:
            state.remove()
            if text:
                yield pd.DataFrame([(key[0], first, speaker, text)], columns=columns)
            return
        closed = False
        for row in pd.concat(list(batches)).sort_values("idx").itertuples():
            if row.speaker is None or row.speaker != row.speaker:
                closed = True
            elif not (row.text or "").strip():
                continue
            elif row.speaker == speaker and text:
                text = f"{text} {row.text}"
                continue
            if text:
                done.append((key[0], first, speaker, text))
            speaker, text, first = ("", "", -1) if closed else (row.speaker, row.text, int(row.idx))
            if closed:
                break
        if closed:
            if state.exists:
                state.remove()
        else:
            state.update((speaker, text, first))
            if timeout_ms is not None:
                state.setTimeoutDuration(timeout_ms)
        if done:
            yield pd.DataFrame(done, columns=columns)

    timeout = GroupStateTimeout.NoTimeout if timeout_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    return lines.groupBy("session_id").applyInPandasWithState(
        update, "session_id long, first_idx int, speaker string, text string", "speaker string, text string, first int", "append", timeout
    )
