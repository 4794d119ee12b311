import random

from turnloom.llm.conversations import chained_components, dropped_conversations, link_conversations, rebuild_conversations, star_components
from turnloom.session import hot_join

DDL = "transcript_id int, utterance_id int, interlocutor string, utterance_text string"


def verdicts(spark, rows, **kw):
    got = dropped_conversations(spark.createDataFrame(rows, DDL), **kw).collect()
    return {r[0]: r[1] for r in got}


def talk(tid, n, first=0):
    return [(tid, first + i, "T" if i % 2 == 0 else "Client ", f"line {i}") for i in range(n)]


def test_reasons(spark):
    rows = talk(1, 6) + talk(2, 5) + talk(3, 6)[:3] + talk(3, 6)[4:] + [(4, 0, "T", None), (4, 1, "C", "  ..."), (5, 0, "Pt", "only me")]
    rows += talk(6, 4) + [(6, 1, "client", " line 1 "), (6, 1, "patient", None)]
    rows += talk(7, 4) + [(7, 1, "client", "another line")]
    rows += talk(8, 4)[:3] + [(8, 3, "speaker", "hm 4")]
    rows += talk(9, 4) + [(9, 2, None, "line 2")]
    rows += talk(10, 4) + [(10, 9, "C", "-"), (10, None, "C", "lost"), (None, 1, "C", "nobody's")]
    rows += talk(11, 2) * 3
    assert verdicts(spark, rows) == {2: "missing_reply", 3: "broken", 4: "empty", 5: "missing_reply", 7: "broken", 8: "broken", 9: "broken"}


def test_long_chain_over_blocks(spark):
    whole, holed = talk(1, 400, 7), [r for r in talk(2, 400) if r[1] != 203]
    assert verdicts(spark, whole + holed, block=8) == {2: "broken"}
    turns = rebuild_conversations(spark.createDataFrame(whole + holed, DDL), block=8).collect()
    assert sorted((r.turn_no, r.utterance_id, r.role) for r in turns) == [(i + 1, 7 + i, "therapist" if i % 2 == 0 else "client") for i in range(400)]


def test_empty_and_clashing_columns(spark):
    assert verdicts(spark, []) == {}
    df = spark.createDataFrame([(*r, "x", 1, "r") for r in talk(1, 3)], DDL + ", c string, u int, reason string")
    assert [tuple(r) for r in dropped_conversations(df).collect()] == [(1, "missing_reply")]


def test_star_components_random(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 120), rng.randint(0, 120)) for _ in range(90)] + [(500 + i, 501 + i) for i in range(60)] + [(900, i + 901) for i in range(40)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for e in edges if e[0] != e[1] for x in e}
    got = star_components(spark.createDataFrame(edges + [(None, 1)], "a long, b long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_contraction_keeps_components(spark):
    rng = random.Random(8)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1400)]
    df = spark.createDataFrame(edges + [(None, 3)], "a long, b long").repartition(5)
    own = {(e[0], e[0]) for e in edges if e[0] == e[1]}  # a node tied to itself alone is its own root
    assert {tuple(r) for r in chained_components(df).collect()} | own == {tuple(r) for r in star_components(df).collect()} | own


def test_a_hub_is_spread(spark):
    """A hub with a third of all edges gets the same components as by plain joins, its edges salted."""
    edges = spark.range(3000).selectExpr("case when id % 3 = 0 then 5 else id end as a", "id + 1 as b")
    low = edges.groupBy("a").agg({"b": "min"}).withColumnRenamed("min(b)", "m")
    one, two = (sorted(map(tuple, hot_join(edges, low, "a", parts=4, least=n).collect())) for n in (100, 10**6))
    assert one == two and len(one) == 3000


def test_links_without_ids(spark):
    rows = [(1, None, None), (2, 1, None), (3, 2, None), (4, None, None), (5, 99, 4), (6, 6, None), (2, 1, None), (None, 1, None)]
    df = spark.createDataFrame(rows, "id long, reply_to long, quotes long")
    got = {tuple(r) for r in link_conversations(df, "id", "reply_to", "quotes").collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)}
