import random

import pytest

from turnloom.llm.transcript import label_of, parse, says_something, without_hesitation, without_notes
from turnloom.llm.turns import calibrated_pause, clean_entries, entries_of_rows, overlap, session_turns, speaker_turns, transcript_turns, turn_heads, turns_of_transcripts

T = "session_id long, transcript string, key string, sid int"
U = "session_id long, idx int, raw_label string, text string, says boolean"


@pytest.mark.parametrize(
    ("label", "want"),
    [("THERAPIST_1", ("therapist", "therapist")), ("Therapsit", ("therapist", "therapist")), ("Th..", ("therapist", "therapist")), ("[Cl]", ("client", "client")),
     ("CLEINT", ("client", "client")), ("PATIENT_02", ("client", "client")), ("Help-Seeker.", ("client", "client")), ("SPEAKER_00", ("speaker00", None)), ("Speaker B", ("speakerb", None)),
     ("S2 ", ("s2", None)), ("காலை", None), ("நோயாளி", ("client", "client")), ("Well", None), ("Three things", None), ("", None), ("Session 7", None)],
)
def test_labels(label, want):
    assert label_of(label) == want


def test_parse_layouts():
    text = "WEBVTT\n\n1\n00:00:01,000 --> 00:00:04,000\n<v Therapist>Um, how was it?\nWell - I guess so.\r\n[00:05] [client] Fine. [00:07]\n(01:02) T - [laughs]\n00:16.5 - C:\nyes I do\n- SPK_1： hello\nI thought: no\n7\n"
    entries, header = parse(text)
    assert header == ["WEBVTT"]
    assert [(e.line_no, e.key, e.start) for e in entries] == [(5, "therapist", 1.0), (7, "client", 5.0), (8, "therapist", 62.0), (9, "client", 16.5), (11, "spk1", None)]
    assert entries[0].text == "Um, how was it? Well - I guess so." and entries[3].text.split() == ["yes", "I", "do"] and entries[4].parts[1] == "I thought: no"


def test_text_rules():
    assert without_notes("a [long pause] b ((coughs)) *sighs* <noise> c ♪ {x} (3.5)") == "a b c"
    assert without_hesitation("um, I uh... went - er, home um - today") == "I went - home today"
    assert not says_something("Um, [laughs] uh... 00:03:12 hmm.") and says_something("Yes.") and says_something("நான்") and not says_something("")
    assert overlap("we went to the shop".split(), "to the shop and back".split()) == 3
    assert overlap("a b".split(), "a b c".split()) == 0 and overlap([], ["a"]) == 0 and overlap("x a b c".split(), "a b c".split()) == 3


def turns(spark, transcripts, rows, **kw):
    got = session_turns(spark.createDataFrame(transcripts, T), spark.createDataFrame(rows, U), **kw).collect()
    assert len(got) == len(set(got))
    return sorted(tuple(r) for r in got)


def test_turns_of_both_tables(spark):
    t = [(1, "Recorded in room 3\nTherapist: How are you?\nClient: um...\nTherapist: [laughs] And now?\nClient: Good.\nClient: Really\ngood.", "k", 1)] * 2
    t += [(2, "Speaker A: It was bad.\nSpeaker B: What was?\nSpeaker A: All of it.\nSpeaker B: Why?", "k", 1), (3, None, "k", 1), (4, "   ", "k", 1), (None, "T: x", "k", 1), (8, "(no audio)", "k", 1)]
    u = [(5, 0, None, "header", True), (5, 1, "SPK_1", "hm", True), (5, 2, "", "I went", True), (5, 4, "THERAPIST.", "[00:10] uh...", True), (5, 6, "SPK_1:", "home", True), (5, 9, "T", "Then?", True), (5, 9, "T", "Then?", True), (5, None, "T", "x", True)]
    want = [(1, 2, "therapist"), (1, 5, "client"), (2, 1, "client"), (2, 2, "therapist"), (2, 3, "client"), (2, 4, "therapist"), (5, 1, "client"), (5, 9, "therapist")]
    assert turns(spark, t, u, keep_text=False) == want
    texts = {r[:2]: r[3] for r in turns(spark, t, u)}
    assert set(texts) == {w[:2] for w in want}
    assert texts[1, 2] == "How are you? And now?" and texts[1, 5] == "Good. Really good." and texts[5, 1].endswith("I went home")
    both = turns(spark, [(5, "T: One?\nC: Two.", "k", 1), (5, "T: x", "k", 1)], u, keep_text=False)
    assert both == sorted([(5, 1, "therapist"), (5, 2, "client"), (5, 1, "client"), (5, 9, "therapist")])


LABELS = ["T", "C", "Speaker A", "Speaker B", "S9", "Client 2"]


@pytest.mark.parametrize("seed", range(6))
def test_rows_and_transcripts_give_the_same_turns(spark, seed):
    """The same entries as lines of a transcript, done in one place, and as rows, done by windows in blocks."""
    rng = random.Random(seed)
    some, lines = rng.sample(LABELS, rng.randint(1, 4)), []
    for _ in range(rng.randint(1, 60)):
        lines.append((rng.choice(some), rng.choice(["um.", "I went home.", "Why?", "What then? Yes.", "[noise]", "no no"])))
    want = transcript_turns("\n".join(f"{a}: {b}" for a, b in lines))
    rows = spark.createDataFrame([(1, i, a, b, True) for i, (a, b) in enumerate(lines, 1)], U)
    for block in (1, 7, 4096):
        entries = entries_of_rows(rows, block=block)
        assert sorted((r.line_no, r.speaker, r.text) for r in speaker_turns(entries, block).collect()) == want
        assert sorted((r.line_no, r.speaker) for r in turn_heads(entries, block).collect()) == [w[:2] for w in want]


def test_long_session_rolling_captions_and_pauses(spark):
    lines = [f"[00:{i // 60:02d}:{i % 60:02d}] {'T' if i % 3 else 'C'}: part {i} of it" for i in range(3000)]
    frame = lambda t: spark.createDataFrame([(1, t, "k", 1)], T)
    assert turns_of_transcripts(frame("\n".join(lines))).count() == 2000
    assert [x[2] for x in transcript_turns("C: so I went to the shop\nC: to the shop and bought it")] == ["so I went to the shop and bought it"]
    timed = "[00:00:01] C: one two\n[00:00:02] C: three\n[00:01:30] C: four"
    assert calibrated_pause(frame(timed), quantile=0.5) == 1.0 and len(transcript_turns(timed, 5.0)) == 2 and len(transcript_turns(timed)) == 1
    assert calibrated_pause(frame("C: one\nC: two")) is None
    late = "[00:00:09] T: And?\n[00:00:01] C: one two\n[00:00:02] C: three"
    assert transcript_turns(late) == [(2, "client", "one two three"), (1, "therapist", "And?")]


def test_real_repeats_stay(spark):
    text = "T: How was the week?\nC: I want to try again.\nT: What would help?\nC: I want to try again.\nT: What would help?\nC: I want to try again. Today."
    got = turns(spark, [(1, text, "k", 1)], [])
    assert [r[1:3] for r in got] == [(i, "client" if i % 2 == 0 else "therapist") for i in range(1, 7)] and [r[3] for r in got] == [line[3:] for line in text.split("\n")]
    said = lambda t: [r[6] for r in clean_entries(t)]
    assert said("[00:10] C: it was so bad\n[00:20] C: it was so bad") == ["it was so bad"] * 2 == said("C: it was so bad\nC: it was so bad")
    cue = "00:00:01,000 --> 00:00:04,000\nC: I went to the shop\n\n00:00:{},000 --> 00:00:09,000\nC: to the shop again"
    assert said(cue.format("04")) == ["I went to the shop", "again"] and said(cue.format("07")) == ["I went to the shop", "to the shop again"]
    rolled = clean_entries("00:00:01,000 --> 00:00:04,000\nC: so why was it?\n\n00:00:03,000 --> 00:00:05,000\nC: so why was it?")
    assert [r[4:] for r in rolled] == [(True, True, "so why was it?"), (True, True, "")]


def test_long_notes_and_odd_hesitation():
    assert without_notes("a [" + "long note " * 40 + "] b (" + "x" * 300 + ") c") == "a b c" and without_notes("3 * 4 and < 5 or > 6") == "3 * 4 and < 5 or > 6"
    assert without_hesitation("well—um—yes, (uh) so, you know, fine. Ähm") == "well— —yes, ( ) so, fine." and without_hesitation("no sounds here") == "no sounds here"


def test_empty(spark):
    assert turns(spark, [], []) == []
