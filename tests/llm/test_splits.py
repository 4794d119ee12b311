import itertools
import random
from collections import Counter

from turnloom.llm.splits import closest_subset, related_groups, split_records

DDL = "transcript_id int, client_code string, recording_code string"


def test_groups_by_spelling_and_chain(spark):
    rows = [(5, "AC-1", "REC-1"), (3, "ac 1", None), (3, "AC_2", "n/a"), (9, " AC2 ", "-"), (8, "unknown", ""), (7, None, "N/A"), (6, "AC-7", "REC 1")]
    rows += [(None, "AC-1", "REC-1"), (3, "ac 1", None), (20, "1", None), (21, None, "1")]
    got = {tuple(r) for r in related_groups(spark.createDataFrame(rows, DDL)).collect()}
    assert got == {(3, 3), (5, 3), (6, 3), (9, 3)}


def test_random_groups_with_hub_and_chain(spark):
    rng = random.Random(1)
    rows = [(i, f"H-{1 if i % 3 == 0 else i}", f"R{rng.randint(0, 400)}") for i in range(1, 200)] + [(1000 + i, f"c{i}", f"c{i + 1}") for i in range(50)]
    rows += [(1000 + i, f"c{i + 1}", f"c{i}") for i in range(50)]
    root, code = {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for t, c, r in rows:
        for k in (("c", c.lower().replace("-", "")), ("r", r.lower())):
            a, b = find(t), find(code.setdefault(k, t))
            root[max(a, b)] = min(a, b)
    size = Counter(find(t) for t in {r[0] for r in rows})
    want = {(t, find(t)) for t, *_ in rows if size[find(t)] > 1}
    assert {tuple(r) for r in related_groups(spark.createDataFrame(rows, DDL)).collect()} == want


def test_closest_subset_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        sizes = {rng.randint(1, 30): rng.randint(1, 3) for _ in range(4)}
        target = rng.randint(0, 80)
        options = [sum(s * k for s, k in zip(sizes, ks)) for ks in itertools.product(*[range(n + 1) for n in sizes.values()])]
        taken = closest_subset(sizes, target)
        assert all(0 < n <= sizes[s] for s, n in taken.items())
        assert abs(sum(s * n for s, n in taken.items()) - target) == min(abs(o - target) for o in options)
    assert closest_subset({}, 10) == {} and closest_subset({7: 5000, 11: 3000}, 9001) and closest_subset({100: 1}, 3) == {}


def test_split_keeps_groups_and_shares(spark):
    ties = [(i, f"AC-{i // 7}" if i < 140 else None, None) for i in range(1, 400)]
    ids = spark.createDataFrame([(i, "x") for i in range(1, 1001)] * 2 + [(None, "x")], "transcript_id int, split string")
    got = split_records(ids, spark.createDataFrame(ties, DDL)).collect()
    assert len(got) == 1000 and Counter(r.split for r in got) == {"train": 800, "validation": 100, "test": 100}
    by = {}
    for r in got:
        by.setdefault(r.group_id, set()).add(r.split)
    assert all(len(v) == 1 for v in by.values())


def test_empty(spark):
    none = spark.createDataFrame([], DDL)
    assert related_groups(none).collect() == [] and split_records(none, none).collect() == []
    one = spark.createDataFrame([(1, None, None)], DDL)
    assert [r.split for r in split_records(one, none).collect()] == ["train"]
