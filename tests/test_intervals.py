import math
import random

from turnloom.operators.intervals import merge_intervals

DDL = "session_id long, start_s double, end_s double"


def brute(rows):
    by = {}
    for k, s, e in rows:
        if s is None or e is None or s != s or e != e or math.isinf(e) or s < 0 or round(e * 1000) <= round(s * 1000):
            continue
        by.setdefault(k, []).append((round(s * 1000), round(e * 1000)))
    out = set()
    for k, spans in by.items():
        cur = None
        for a, b in sorted(spans):
            if cur and a <= cur[1]:
                cur[1] = max(cur[1], b)
                continue
            if cur:
                out |= {(k, "period", *cur), (k, "gap", cur[1], a)}
            cur = [a, b]
        out.add((k, "period", *cur))
    return out


def run(spark, rows, **kw):
    got = merge_intervals(spark.createDataFrame(rows, DDL), **kw).collect()
    assert len(got) == len(set(got))
    return {tuple(r) for r in got}


def test_random_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for k in range(12):
        for _ in range(rng.randint(1, 60)):
            s = round(rng.uniform(0, 200), 3)
            rows.append((k, s, round(s + rng.choice([0.001, 0.5, 3, 40, 0, -1]), 3)))
    for width in (1_000, 7_000, 3_600_000):
        assert run(spark, rows, bin_ms=width) == brute(rows)


def test_hot_key_spans_bins_and_touches(spark):
    rows = [(1, float(i), float(i + 1)) for i in range(500)] + [(1, 600.0, 601.0), (1, 0.5, 550.25), (None, 1.0, 2.0)]
    assert run(spark, rows, bin_ms=2_000) == brute(rows)


def test_unusable_rows_repeats_and_empty(spark):
    rows = [(1, None, 2.0), (1, 1.0, None), (1, float("nan"), 2.0), (1, 3.0, 2.0), (1, -1.0, 2.0), (1, 2.0, 2.0), (1, 1.0, float("inf"))]
    assert run(spark, rows) == set()
    assert run(spark, [(2, 1.0, 2.0)] * 3) == {(2, "period", 1000, 2000)}
    assert run(spark, []) == set()


def test_clashing_extra_columns(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0, "x", 9, 8), (1, 3.0, 4.0, "y", 9, 8)], DDL + ", kind string, bin int, key int")
    assert {tuple(r) for r in merge_intervals(df).collect()} == brute([(1, 0.0, 1.0), (1, 3.0, 4.0)])
