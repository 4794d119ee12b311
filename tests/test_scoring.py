import re

from pyspark.sql import functions as F

from turnloom.functions.lexicon import TERMS, is_phrase
from turnloom.functions.text import clean_excerpt, clock, numbers_in, script_language
from turnloom.operators.index import baselines, index_sessions, within_person_z
from turnloom.operators.parse import merge_speaker_runs, parse_transcripts
from turnloom.operators.score import DIMENSIONS, EMPTY_SCORES, lexicon_counts, score_utterances, session_features, with_silent_sessions
from turnloom.operators.rules import early_warning
from turnloom.plans.registry import gather
from turnloom.session import hot_join


def naive(text, name):
    low = f" {text.lower().strip()} "
    return sum(low.count(t) if is_phrase(t) else len(re.findall(rf"\b{re.escape(t)}\b", low)) for t in TERMS[name])


TEXTS = [
    "I can't do it, nothing I can do about it. I had to leave and I have to stay, it's not up to me.", "Next week I will try to plan a small step, I chose to start and I decided to stop.",
    "over and over and over again I keep thinking what if I had", "self-compassion and compassion, compassion", "I'm going to try. I am going to. No one ever helps, he always, she never listens because of him.",
]


def test_counts_are_those_of_single_terms(spark):
    got = lexicon_counts(spark.createDataFrame([(t,) for t in TEXTS + ["Café, will_ will éwill WILL"]], "text string")).collect()
    for row in got:
        for name in TERMS:
            assert row[f"c_{name}"] == naive(row.text, name), (name, row.text)


def test_scores(spark):
    stuck = "I can't do anything, I have to stay, they always make me feel bad and nothing ever helps. I'm stuck and it was always like that."
    moving = "I decided to talk to her because I noticed my part in it, and maybe next week I will try a small step. I feel proud and a bit apprehensive."
    rows = [("stuck", stuck), ("moving", moving), ("empty", ""), ("null", None), ("short", "Okay then.")]
    got = {r.name: r for r in score_utterances(spark.createDataFrame(rows, "name string, text string"), keep_evidence=True).collect()}
    assert all(got["moving"][d] > got["stuck"][d] for d in DIMENSIONS)
    assert all(abs(got[k][f] - v) < 1e-9 for k in ("empty", "null") for f, v in EMPTY_SCORES.items())
    assert all(0.2 <= got["short"][d] <= 0.65 for d in DIMENSIONS)
    assert got["moving"].evidence["self_agency+"] == ["i decide", "i decided", "i decided to", "i will"] and "hopelessness" not in got["moving"].evidence


def test_sessions_baseline_and_index(spark):
    rows = [(1, n, f"{'I decided to try because I noticed my part in it' if n > 2 else 'it was like that and then it was over'} number {n}") for n in range(1, 5) for _ in range(3)]
    sessions = spark.createDataFrame([(1, n) for n in range(1, 6)], "client_id int, session_number int")
    f = with_silent_sessions(sessions, session_features(score_utterances(spark.createDataFrame(rows, "client_id int, session_number int, text string")), "client_id", "session_number"), "client_id", "session_number")
    out = {r.session_number: r for r in index_sessions(f, baselines(f)).collect()}
    assert abs(out[1].tpi - 50) < 0.01 and out[3].tpi > 55 and out[1].confidence < 0.5 and out[5].n_client_turns == 0


def test_parse_and_roles(spark):
    t = "Recorded\n[00:01] Therapist: How are you?\nClient: Fine.\nI think so.\n\nTherapist:  \nClient - Maybe so"
    u = "SPEAKER_00: I was at home and it was bad\nSPEAKER_01: What was bad?\nSPEAKER_00: All of it"
    s = spark.createDataFrame([(1, t), (2, u), (3, "no labels here"), (4, None), (5, ""), (6, "Therapist: So?\nClient - Well - I guess")], "sid int, transcript string")
    turns, info = parse_transcripts(s, "sid")
    got = [(r.sid, r.idx, r.speaker, r.text) for r in turns.orderBy("sid", "idx").collect()]
    # the label takes all it can up to the last separator in reach, so "Client - Well" is a label of its own
    assert {(r.raw_label, r.text) for r in turns.where("sid = 6 and idx = 1").collect()} == {("Client - Well ", "I guess")}
    assert got[:3] == [(1, 0, "therapist", "How are you?"), (1, 1, "client", "Fine. I think so."), (1, 3, "client", "Maybe so")]
    assert [(g[1], g[2]) for g in got if g[0] == 2] == [(0, "client"), (1, "therapist"), (2, "client")]
    i = {r.sid: r for r in info.collect()}
    assert i[1].n_ignored == 1 and i[2].inferred and not i[1].inferred and i[3].n_labels == 0
    lines = spark.createDataFrame([(1, 0, "a", "x"), (1, 1, "a", "y"), (1, 2, "b", " "), (1, 3, None, "z")], "sid int, idx int, speaker string, text string")
    assert [(r.speaker, r.text) for r in merge_speaker_runs(lines, "sid").orderBy("turn_no").collect()] == [("a", "x y"), ("client", "z")]


def test_text_helpers(spark):
    r = spark.range(1).select(
        script_language(F.lit("நான் ok")).alias("a"), script_language(F.lit("plain")).alias("b"), numbers_in(F.lit("6.0 or 6, then -3.25")).alias("c"), clock(F.lit(125.9)).alias("d"),
        clean_excerpt(F.lit("One two. Three")).alias("e"), clean_excerpt(F.lit("word " * 40)).alias("f"),
    ).first()
    assert (r.a, r.b, r.c, r.d, r.e) == ("ta", "en", ["-3.25", "6"], "02:05", "One two.") and r.f.endswith("…") and len(r.f) <= 81


def test_text_helpers_keep_the_small_print(spark):
    df = spark.createDataFrame([("123.456 and 123.46 and 1234.7, 12345.6, 0.00012345",), ("Take 3.5 mg daily? Yes! Then. Stop",), ("Is it? No! Go",), ("நா abcd",), ("ab ஏ எ ஆ अ",)], "t string")
    got = [tuple(r) for r in df.select(numbers_in(F.col("t")), clean_excerpt(F.col("t")), script_language(F.col("t"))).collect()]
    assert set(got[0][0]) == {"123.5", "1235", "12350.0", "1.234E-4"} or set(got[0][0]) == {"123.5", "1235", "12350.0", "1.235E-4"}
    assert got[1][1] == "Take 3.5 mg daily? Yes! Then." and got[2][1] == "Is it?"
    assert got[3][2] == "ta" and got[4][2] == "ta"


def test_early_warning_counts_a_plateau(spark):
    rows = [(1, n, 50.0, 0.0, 0.0, 100.0) for n in range(1, 7)] + [(2, n, 60.0 - 6 * n, 0.4, 0.0, 100.0 if n < 5 else 40.0) for n in range(1, 6)] + [(3, 1, 50.0, 0.0, 0.0, 9.0)]
    x = spark.createDataFrame(rows, "client_id int, session_number int, tpi double, hopelessness double, rumination double, n_client_words double")
    states = spark.createDataFrame([(1, "plateauing"), (2, "regressing")], "client_id int, state string")
    got = {r.client_id: (r.score, r.level, r.reasons) for r in early_warning(x, states).collect()}
    assert got == {1: (0.1, "none", "plateau"), 2: (1.0, "elevated", "falling;below_baseline;hopelessness;fewer_words")}


def test_a_baseline_without_spread(spark):
    df = spark.createDataFrame([(1, 2.0, True), (1, 2.0, True), (1, 3.0, False), (2, 1.0, True)], "k int, x double, b boolean")
    assert sorted((r.k, r.x, r.x_z) for r in within_person_z(df, "k", "x", "b").collect() if r.x_z) == [(1, 3.0, 1e6)]


def test_hot_join_spreads_a_hot_key(spark):
    left = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    right = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("w")).union(spark.createDataFrame([(7, 70)], "k long, w long"))
    for how in ("inner", "left"):
        a, b = (sorted(map(tuple, x.select("k", "v", "w").collect()), key=repr) for x in (hot_join(left, right, "k", how, parts=8, least=500), left.join(right, "k", how)))
        assert a == b and len(a) >= 1000


def test_documents_are_scored_whatever_their_label(spark, tmp_path):
    rows = [(1, "I will try.", "en"), (2, "I will try.", "EN"), (3, "I will try.", None), (4, "I will try.", "xx"), (5, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in gather()[0]["document_scores"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and len({got[i] for i in range(1, 5)}) == 1 and got[1][0] == 3.0 and got[5][0] == 0.0
