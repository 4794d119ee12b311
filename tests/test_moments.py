import itertools
import random

from pyspark.sql import functions as F

from turnloom.functions.text import duration_words, percent_change, valid_code
from turnloom.operators import align as A
from turnloom.operators import multilingual as L
from turnloom.operators import signals as S


def test_stamps_and_sources(spark):
    lines = ["[00:01:05] T: hi", "(02:10) C: yes", "12:34 said", "see 1:02:03 there", "none", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in lines], "t string").select(A.stamp_seconds(F.col("t"))).collect()]
    assert got == [65, 130, None, 3723, None, None]
    cases = [(9, 3, 0, 60.0), (12, 3, 12, 60.0), (12, 3, 11, 60.0), (5, 0, 0, None), (0, 0, 0, 9.0), (30, 10, 0, 1.0)]
    df = spark.createDataFrame(cases, "n int, s int, g int, d double")
    assert [r[0] for r in df.select(A.timing_source(F.col("n"), F.col("s"), F.col("g"), F.col("d"))).collect()] == ["explicit", "diarisation", "estimated", "none", "none", "explicit"]


def test_moments_against_every_pair(spark):
    rng = random.Random(4)
    turns, at = [], 0.0
    for i in range(60):
        start = at + rng.choice([0.0, 0.0, 4.0, 40.0]) - rng.choice([0.0, 1.0])
        at = max(start, 0.0) + rng.randint(1, 20)
        turns.append((1, i, rng.choice(["client", "therapist"]), max(start, 0.0), at, rng.choice([None, round(rng.random(), 3)])))
    points = [(1, float(rng.randint(-5, int(at) + 60))) for _ in range(80)] + [(2, 5.0)]
    t = spark.createDataFrame(turns, "k int, idx int, speaker string, start_s double, end_s double, process_mean double")
    p = spark.createDataFrame(points, "k int, t double")
    want = set()
    for k, x in set(points):
        own = [r for r in turns if r[0] == k]
        if not own:
            continue
        inside = [r[1] for r in own if r[3] <= x <= r[4]]
        idx = inside[0] if inside else min(own, key=lambda r: (min(abs(r[3] - x), abs(r[4] - x)), r[1]))[1]
        near = [r for r in own if r[2] == "client" and r[5] is not None and abs((r[3] + r[4]) / 2 - x) <= 6.0]
        low = min(near, key=lambda r: (r[5], r[1]))[1] if near else None
        want.add((k, x, idx, bool(inside), low if low != idx else None))
    assert {tuple(r) for r in A.linked_moments(p, t, "k").collect()} == want
    close = {(k, x, min(c)[1]) for k, x in set(points) if (c := [(abs(r[3] - x), r[3]) for r in turns if r[0] == k and abs(r[3] - x) <= 1.5])}
    assert {tuple(r) for r in A.nearest_within(p, t.select("k", F.col("start_s").alias("preview_t")), "k").collect()} == close
    assert A.linked_moments(p.limit(0), t, "k").collect() == [] and A.linked_moments(p, t.limit(0), "k").collect() == []


def test_channels(spark):
    z = {k: F.lit(v).cast("double") for k, v in {"f0_cv": 9.0, "hnr": None, "pause_ratio": -9.0, "unknown": 1.0}.items()}
    score, n = S.channel_score(z, S.ACOUSTIC_SIGNS)
    none, zero = S.channel_score({"hnr": F.lit(None).cast("double")}, S.ACOUSTIC_SIGNS)
    r = spark.range(1).select(score, n, none, zero, S.norm_z(F.lit(0.32), "pause_ratio"), S.index_without_text(F.lit(3.0), F.lit(-1.0)), S.index_without_text(F.lit(None), F.lit(None))).first()
    assert tuple(r) == (3.0, 2, None, 0, 1.0, 64.0, 50.0)
    f = S.fuse(spark.createDataFrame([(50.0, 3.0, 3.0, 1.0), (98.0, 3.0, None, 0.5), (50.0, None, None, 1.0)], "tpi double, a double, v double, c double"), "tpi", "a", "v", "c").collect()
    assert [(x.fused, x.shift, x.modalities) for x in f] == [(54.0, 4.0, 3), (100.0, 2.0, 2), (50.0, 0.0, 1)]
    modes = {tuple(m): spark.range(1).select(S.input_mode(*[F.lit(x) for x in m])).first()[0] for m in itertools.product([True, False], repeat=3)}
    assert len(set(modes.values())) == 8 and modes[False, False, False] == "none" and modes[True, True, False] == "text_audio"


def test_other_languages(spark):
    text = "Aufnahme 3\nzweite Zeile\nநோயாளி: நான் வந்தேன். சரி!\nமேலும் ஒன்று\nThis is a long sentence with many words: no label\nசிகிச்சையாளர்： ஏன்?\n\n"
    df = spark.createDataFrame([(1, text), (2, "T: One. Two? Three\nC: Four"), (3, None), (4, "  ")], "sid int, transcript string")
    got = {(r.sid, r.turn, r.label, r.text) for r in L.multilingual_turns(df, "sid").collect()}
    assert got == {
        (1, 0, "", "Aufnahme 3 zweite Zeile"), (1, 1, "CLIENT", "நான் வந்தேன். சரி! மேலும் ஒன்று This is a long sentence with many words: no label"), (1, 2, "THERAPIST", "ஏன்?"),
        (2, 0, "T", "One. Two? Three"), (2, 1, "C", "Four"),
    }
    turns, whole = L.translate_transcripts(df, "sid", translate=lambda s: F.concat(F.lit("<"), s, F.lit(">")))
    out = {r.sid: r for r in whole.collect()}
    assert out[1].language == "ta" and out[1].available and out[1].english_transcript.split("\n")[2] == "THERAPIST: <ஏன்?>" and "CLIENT: <நான் வந்தேன்.> <சரி!>" in out[1].english_transcript
    assert out[2].english_transcript == "T: One. Two? Three\nC: Four" and set(out) == {1, 2}
    failed = {r.sid: (r.available, r.english_transcript) for r in L.translate_transcripts(df, "sid", translate=lambda s: F.when(~s.contains("ஏன்"), s))[1].collect()}
    assert failed[1] == (False, None) and failed[2][0]


def test_small_wordings(spark):
    r = spark.range(1).select(duration_words(F.lit(89.4)), duration_words(F.lit(90.0)), duration_words(F.lit(725.0)), percent_change(F.lit(3.0), F.lit(4.0)), percent_change(F.lit(3.0), F.lit(0.0)), valid_code(F.lit(" AB-1 ")), valid_code(F.lit("A B")), valid_code(F.lit(" "))).first()
    assert tuple(r) == ("89 seconds", "1.5 minutes", "12.1 minutes", -25, 0, "AB-1", None, None)
