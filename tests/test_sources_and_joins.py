import pytest
from pyspark.sql import functions as F

from turnloom.operators.align import containing_interval, nearest_interval
from turnloom.operators.signals import episodes, moments
from turnloom.operators.store import cascade_delete, insert_new, upsert
from turnloom.sources.corpora import assemble_sessions, csv_utterances, ensure_table, json_metrics, markdown_table, media_files, sniff_delimiter, text_sessions, write_table


def test_text_and_csv_sources(spark, tmp_path):
    for case, name in (("c1", "b.txt"), ("c1", "a.txt"), ("c2", "x_7.txt")):
        (tmp_path / "txt" / case).mkdir(parents=True, exist_ok=True)
        (tmp_path / "txt" / case / name).write_text("Therapist: how are you today?\nClient: fine")
    (tmp_path / "txt" / "c2" / "tiny.txt").write_text("hi")
    got = {(r.client_code, r.session_number) for r in text_sessions(spark, str(tmp_path / "txt")).collect()}
    assert got == {("c1", 1), ("c1", 2), ("c2", 2)} or got == {("c1", 1), ("c1", 2), ("c2", 1)}
    named = text_sessions(spark, str(tmp_path / "txt"), r"(?P<client>[a-z]+)_(?P<session>\d+)\.txt").collect()
    assert [(r.client_code, r.session_number) for r in named] == [("x", 7)]
    (tmp_path / "u.csv").write_text('conv;who;said\nk_1;Therapist;"Hello; you"\nk_1;me;Hi\nk_2;T; \nk_2;x;Bye\n')
    u = csv_utterances(spark, str(tmp_path / "u.csv"), "conv", "who", "said")
    s = {r.conversation_id: r for r in assemble_sessions(u).collect()}
    assert s["k_1"].transcript == "THERAPIST: Hello; you\nCLIENT: Hi" and s["k_2"].session_number == 2 and s["k_1"].client_code == "k"
    with pytest.raises(ValueError):
        csv_utterances(spark, str(tmp_path / "u.csv"), "conv", "speaker", "said")
    assert sniff_delimiter("a\tb\n1\t2") == "\t"
    (tmp_path / "m.json").write_text('{"lr": {"acc": 0.5}, "nb": {"acc": 0.4}}')
    assert json_metrics(spark, str(tmp_path / "m.json")).count() == 2
    write_table(spark.range(20).withColumnRenamed("id", "client_id"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 20
    ahead = text_sessions(spark, str(tmp_path / "txt"), r"(?P<client>x(?=_))_(?P<session>\d+)\.txt").collect()
    assert [(r.client_code, r.session_number) for r in ahead] == [("x", 7)]


def test_tables_reports_and_media(spark, tmp_path):
    path = str(tmp_path / "new")
    assert ensure_table(spark, path, "id long, code string").count() == 0
    spark.createDataFrame([(1, "a|b")], "id long, code string").write.mode("append").parquet(path)
    again = ensure_table(spark, path, "id long, code string")
    assert again.count() == 1 and markdown_table(again) == "| id | code |\n| - | - |\n| 1 | a\\|b |"
    with pytest.raises(ValueError):
        markdown_table(spark.range(9), most=5)
    (tmp_path / "m").mkdir()
    for name, size in (("a.WAV", 10), ("b.mp4", 5000), ("c.txt", 1)):
        (tmp_path / "m" / name).write_bytes(b"x" * size)
    kinds = {"wav": "audio", "mp4": "video"}
    assert {(r.kind, r.length) for r in media_files(spark, str(tmp_path / "m"), kinds).collect()} == {("audio", 10), ("video", 5000)}
    assert [r.kind for r in media_files(spark, str(tmp_path / "m"), kinds, max_bytes=100).collect()] == ["audio"]


def test_joins_episodes_moments_and_store(spark):
    iv = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 5.0, 70.0), (1, 2, 200.0, 210.0)], "k int, idx int, start_s double, end_s double")
    pt = spark.createDataFrame([(1, 7.0), (1, 65.0), (1, 100.0), (1, 204.0), (2, 1.0)], "k int, t double")
    assert {(r.t, r.idx) for r in containing_interval(pt, iv, "k").collect()} == {(7.0, 0), (65.0, 1), (204.0, 2)}
    near = {r.t: (r.idx, r.gap) for r in nearest_interval(pt, iv, "k").collect()}
    assert near[100.0] == (1, 30.0) and near[7.0] == (1, 2.0) and 1.0 not in near
    sig = spark.createDataFrame([(1, float(i), 1.0 if 40 <= i <= 95 else 0.0, float(i % 2)) for i in range(200)], "k int, t double, v double, u double")
    ep = episodes(sig, "k", t="t", hit=F.col("v") > 0.5, min_s=20.0).collect()
    assert [(e.start_t, e.end_t, e.n) for e in ep] == [(40.0, 95.0, 56)]
    mo = sorted(r.t for r in moments(sig, "k", t="t", tracks=("v", "u")).collect())
    assert 40.0 in mo and len(mo) <= 8 and all(b - a > 11 for a, b in zip(mo, mo[1:]))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id int, v string")
    assert {tuple(r) for r in upsert(a, spark.createDataFrame([(2, "z"), (3, "w")], "id int, v string"), ["id"]).collect()} == {(1, "x"), (2, "z"), (3, "w")}
    assert insert_new(a, spark.createDataFrame([(2, "q"), (5, "n")], "id int, v string"), "id")[1].count() == 1
    assert [t.count() for t in cascade_delete(a.where("id = 1"), "id", (a, "id"), (a, "id"))] == [1, 1]
