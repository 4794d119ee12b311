import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnloom.operators.index import baselines, index_sessions
from turnloom.streaming.scoring import latest_sessions, merge_live_lines, rescored, score_stream, windowed_counts


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def ends(spark, stream, tmp_path, name, mode="append"):
    """All that is there in micro-batches, then the end; a stream that does not end fails the test."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/cp_{name}").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120), "the stream did not end"
    finally:
        q.stop()
    return spark.table(name)


def files(spark, tmp_path, ddl, *batches):
    path = f"{tmp_path}/in"
    for rows in batches:
        spark.createDataFrame(rows, ddl).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path), spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)


def test_scoring_equals_batch(spark, tmp_path):
    rows = [(1, i, f"I decided to go {i} because I noticed it") for i in range(6)]
    batch, stream = files(spark, tmp_path, "session_id long, idx int, text string", rows[:3], rows[3:])
    cols = ["idx", "self_agency", "process_mean"]
    assert sorted(map(tuple, ends(spark, score_stream(stream), tmp_path, "scored").select(*cols).collect())) == sorted(map(tuple, score_stream(batch).select(*cols).collect()))


def test_windows_and_late_rows(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, d, h)
    ddl = "ts timestamp, event_type string"
    _, stream = files(spark, tmp_path, ddl, [(day(1, 1), "a"), (day(1, 2), "a")], [(day(5), "b")], [(day(5, 1), "b")], [(day(1, 3), "a")], [(day(9), "b")], [(day(9, 1), "b")])
    got = {(r.from_ts.day, r.event_type, r.n) for r in ends(spark, windowed_counts(stream), tmp_path, "windows").collect()}
    assert got == {(1, "a", 2), (5, "b", 2)}  # the row of the first day that came after the fifth is too late
    sliding = windowed_counts(spark.read.parquet(f"{tmp_path}/in"), width="2 days", slide="1 day")
    assert sliding.agg(F.sum("n")).first()[0] == 14


def test_sessions_once(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 12)
    rows = [(1, 1, t), (1, 2, t), (1, 1, t + dt.timedelta(hours=1))]
    _, stream = files(spark, tmp_path, "client_id long, session_number int, created_at timestamp", rows[:2], rows[2:])
    assert sorted((r[0], r[1]) for r in ends(spark, latest_sessions(stream), tmp_path, "once").collect()) == [(1, 1), (1, 2)]


def test_live_turns_over_batches(spark, tmp_path):
    lines = [(1, i, "client" if i % 3 else "therapist", f"part {i}") for i in range(8)] + [(1, 8, None, None), (2, 0, "client", "open"), (2, 1, "client", "  ")]
    _, stream = files(spark, tmp_path, "session_id long, idx int, speaker string, text string", lines[:5], lines[5:])
    got = {(r.first_idx, r.speaker, r.text) for r in ends(spark, merge_live_lines(stream), tmp_path, "live").collect()}
    assert got == {(0, "therapist", "part 0"), (1, "client", "part 1 part 2"), (3, "therapist", "part 3"), (4, "client", "part 4 part 5"), (6, "therapist", "part 6"), (7, "client", "part 7")}


def test_touched_clients_are_rescored_whole(spark):
    names = [f.name for f in _features(spark, [(1, 1)]).schema]
    all_ = _features(spark, [(c, n) for c in (1, 2) for n in range(1, 5)])
    assert names
    got = rescored(all_, spark.createDataFrame([(2,), (2,), (9,)], "client_id int"))
    want = index_sessions(all_.where("client_id = 2"), baselines(all_.where("client_id = 2")))
    key = lambda d: sorted((r.client_id, r.session_number, r.tpi) for r in d.collect())
    assert key(got) == key(want) and len(key(got)) == 4


def _features(spark, keys):
    from turnloom.operators.score import session_features, score_utterances

    rows = [(c, n, f"I decided to try number {n} because I noticed my part in it and it was hard {'and bad' * n}") for c, n in keys for _ in range(2)]
    return session_features(score_utterances(spark.createDataFrame(rows, "client_id int, session_number int, text string")), "client_id", "session_number")
