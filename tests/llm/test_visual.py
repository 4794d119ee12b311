import random
import unicodedata

from turnloom.llm.visual import LOOK_ALIKES, consistent, equal_looking_pairs, form_classes, mapping, with_consistent_text


def test_forms():
    assert consistent("Ｔｈｅ　ｆｅｅ") == "The fee"
    assert consistent("n​o ch⁠ange﻿") == "no change"
    assert consistent("a b c") == "a b c"
    assert consistent("ﬁne été аре") == "fine été ape"
    assert consistent("e​́") == "é" and consistent("co­op") == "coop"
    assert consistent("“don’t” – x") == "\"don't\" - x"
    assert consistent("नमस्ते வணக்கம்") == "नमस्ते வணக்கம்"
    assert consistent("a\r\nb\rc\nd") == "a\nb\nc\nd"
    assert consistent("Case counts: É é E") == "Case counts: É é E"


def test_stable_and_idempotent():
    rng = random.Random(4)
    pool = list(mapping()) + [chr(o) for o in range(0x300, 0x330)] + list("abc \nAÉñ0९த்")
    for _ in range(3000):
        once = consistent("".join(rng.choice(pool) for _ in range(rng.randint(0, 12))))
        assert consistent(once) == once == unicodedata.normalize("NFC", once)
    assert all(len(p) == 3 for p in LOOK_ALIKES)


def test_disguise_round_trip():
    rng = random.Random(9)
    back = {}
    for p in LOOK_ALIKES:
        back.setdefault(p[2], []).append(p[0])
    plain = "Homework on the small step was not attempted, reasons explored without pressure. Élan à côté"
    for _ in range(200):
        t = unicodedata.normalize(rng.choice(["NFC", "NFD"]), plain)
        t = "".join(rng.choice(back.get(c, [c])) if rng.random() < 0.3 else chr(ord(c) + 0xFEE0) if "!" <= c <= "~" and rng.random() < 0.2 else c for c in t)
        t = "".join(c + rng.choice(["", "", "​", "⁠"]) for c in t).replace(" ", rng.choice([" ", " ", " "]))
        assert consistent(t) == plain


def test_pairs(spark):
    rows = [(1, "a b", "p", "q"), (2, "a b", "p", "q"), (3, "a b", "p", "q"), (4, "A b", "p", "q"), (5, "", "p", "q"), (6, "​", "p", "q"), (7, None, "p", "q"),
            (None, "a b", "p", "q"), (8, "ａ b", "p", "q"), (2, "a b", "p", "q"), (9, "x" * 300_000, "p", "q"), (10, "x" * 299_999 + "х", "p", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, same string, stored string")
    got = [tuple(r) for r in equal_looking_pairs(df).collect()]
    assert sorted(got) == [(1, 2), (1, 8), (2, 3), (2, 8), (3, 8), (5, 6), (9, 10)]
    assert equal_looking_pairs(df.limit(0)).collect() == []
    classes = {r.doc_id: (r.class_id, r.n_documents, r.n_stored) for r in form_classes(df).collect()}
    assert classes == {1: (1, 4, 3), 2: (1, 4, 3), 3: (1, 4, 3), 8: (1, 4, 3), 4: (4, 1, 1), 5: (5, 2, 2), 6: (5, 2, 2), 9: (9, 2, 2), 10: (9, 2, 2)}
    assert form_classes(df.limit(0)).collect() == []
    out = with_consistent_text(df.select("doc_id", "text")).collect()
    assert {r.doc_id: r.consistent_text for r in out}[7] is None
