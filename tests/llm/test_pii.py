import itertools
import random
import re

import numpy as np
import pytest

from turnloom.llm import pii
from turnloom.llm.pii_samples import COUNTER, HELD_OUT, HELD_OUT_COUNTER, SENTENCES, fingerprint, labelled

DDL = "session_id long, transcript string, origin string, row_id int"


def brute(scores, transition, start):
    t, n = scores.shape
    paths = itertools.product(range(n), repeat=t)
    return max(paths, key=lambda p: start[p[0]] + scores[range(t), p].sum() + sum(transition[a, b] for a, b in zip(p, p[1:])))


def test_viterbi_against_every_path():
    rng = np.random.default_rng(3)
    size = np.array([5, 4, 4, 1])
    scores, transition, start = rng.normal(size=(4, 5, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    got = pii.viterbi(scores, size, transition, start)
    for i, n in enumerate(size):
        assert tuple(got[i, :n]) == brute(scores[i, :n], transition, start)


@pytest.fixture(scope="module")
def tagger():
    return pii.trained()


def judged(tagger, held):
    hit, miss, extra = ({t: 0 for t in pii.TYPES} for _ in range(3))
    for pieces, found in zip(held, pii.mentions(["".join(p for p, _ in s) for s in held], pii.Decoder(tagger))):
        at, want = 0, []
        for text, kind in pieces:
            want += [(at, at + len(text), kind)] * bool(kind)
            at += len(text)
        for a, b, kind in want:
            ok = any(k == kind and x < b and a < y for x, y, k in found)
            hit[kind] += ok
            miss[kind] += not ok
        for x, y, kind in found:
            extra[kind] += not any(k == kind and x < b and a < y for a, b, k in want)
    return {k: (hit[k] / max(1, hit[k] + miss[k]), hit[k] / max(1, hit[k] + extra[k])) for k in pii.TYPES}


def test_held_out_sentences(tagger):
    """Sentences and values the tagger never saw, among labels, stamps and noise."""
    got = judged(tagger, labelled(24, 4711, HELD_OUT, HELD_OUT_COUNTER, 0))
    for kind, (recall, precision) in got.items():
        assert recall >= (0.82 if kind == "person" else 0.9) and precision >= 0.9, got


def test_no_sentence_is_in_both_parts():
    assert not set(SENTENCES + COUNTER) & set(HELD_OUT + HELD_OUT_COUNTER)


def test_stored_weights_belong_to_the_table():
    with np.load(pii.WEIGHTS) as kept:
        assert str(kept["mark"]) == fingerprint(pii.N_FILLS, pii.SEED)


def test_fitting_learns(tagger):
    small = pii.fit(labelled(1, 3, SENTENCES[::3], COUNTER[::5], 0), tagger.common, epochs=12, batch=16, least=1)
    got = judged(small, labelled(1, 3, SENTENCES[::3], COUNTER[::5], 0))
    assert all(r >= 0.8 for r, _ in got.values()), got


def test_tokens_are_those_of_a_plain_scan():
    plain = re.compile(r"[^\S\n]?(?:\n|\d+|(?:[^\W\d_]|[\u0300-\u036f\u0900-\u0963\u0970-\u0dff])+|[^\s])")
    texts = ["Ring me on 555-0133.", "", " a\n\n  b\tc", "Ähm, d'Anna — நான் 12x", "x\u200by \U0001f600\U0001f600 z1"]
    cut = pii.tokenize(texts)
    for i, t in enumerate(texts):
        own = [cut.text[a:b] for a, b, o in zip(cut.start, cut.end, cut.owner) if o == i]
        assert own == [m.group().strip(" \t") for m in plain.finditer(t)], t
    keys = {}
    for i, k in enumerate(cut.key):
        assert keys.setdefault(int(k), cut.token(i)) == cut.token(i)


def test_pruning_changes_nothing(tagger):
    """Labels from decoding whole texts, without leaving any stretch out."""
    texts = ["".join(p for p, _ in s) for s in labelled(1, 99)][:300]
    decoder, cut = pii.Decoder(tagger), pii.tokenize(texts)
    got = decoder.tag(cut)
    opens = np.diff(cut.owner, prepend=-1) > 0
    ahead = np.vstack((np.zeros(len(got)), decoder._scores(cut, decoder._ids(cut), opens))).T
    for i in range(len(texts)):
        own = cut.owner == i
        if own.any():
            want = pii.viterbi(ahead[own][None], np.array([own.sum()]), tagger.transition, tagger.start)[0]
            assert (want == got[own]).all(), texts[i]


def test_decoding_does_not_depend_on_the_batch(tagger):
    texts = ["".join(p for p, _ in s) for s in labelled(1, 5)][:60] + ["", "\n", "x" * 5000, "Ring me on 555-0133 after six.\n" * 700]
    one = [pii.mentions([t], pii.Decoder(tagger))[0] for t in texts]
    random.Random(1).shuffle(order := list(range(len(texts))))
    many = pii.mentions([texts[i] for i in order], pii.Decoder(tagger, room=10))
    assert [many[order.index(i)] for i in range(len(texts))] == one
    assert len(one[-1]) == 700
    assert pii.mentions(texts, pii.Decoder(tagger, lot=1), seam=500) == one  # the longest comes in six overlapping pieces


def test_exact_checks():
    assert not pii.plausible("phone", "12 34") and pii.plausible("phone", "five five five, zero one four zero")
    assert not pii.plausible("identity_number", "2021-11-03") and pii.plausible("identity_number", "AB 12 34 56 C")
    assert not pii.plausible("person", "Dr.") and pii.plausible("person", "Dr. Una") and not pii.plausible("person", "x@y")


def test_redaction_keeps_lines():
    assert pii.redacted("a 12\n34 b", [(2, 7, "phone")]) == "a [PHONE]\n b" and pii.redacted("x", []) == "x"


def test_tables(spark):
    rows = [(1, "Therapist: How are you?\nClient: Ring me on 07700 900123 after six.\nmy email is tomas.verlane@mail.example, I read it at night.", "x", 9), (2, None, "x", 9), (3, "", "x", 9),
            (None, "Ring me on 07700 900123.", "x", 9), (4, "It is on page 118 of the workbook.", "x", 9)]
    df = spark.createDataFrame(rows + rows[:1], DDL)
    part = (df, "transcripts", "session_id", "transcript")
    got = {tuple(r) for r in pii.personal_lines(part).collect()}
    assert got == {("transcripts", 1, 2, "phone"), ("transcripts", 1, 3, "email")}
    clean = pii.redact(part).where("row_id = 1").first().text
    assert clean == "Therapist: How are you?\nClient: Ring me on [PHONE] after six.\nmy email is [EMAIL], I read it at night."
    assert pii.personal_lines((df.limit(0), "a", "session_id", "transcript")).collect() == []
