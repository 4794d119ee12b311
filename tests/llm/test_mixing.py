import math
from collections import Counter

import pytest

from turnloom.llm.mixing import mix_report, mix_sources, plan_budgets

DOCS = "doc_id long, text string, source string, n_tokens int, copies int"
TARGETS = "source string, target_share double, max_repeats int"


def docs(**sizes):
    out, i = [], 0
    for s, (n, words) in sizes.items():
        for k in range(n):
            i += 1
            out.append((i, "word " * (words + k % 7), s.replace("_", "-").upper() if k % 2 else s, 1, 1))
    return out


def run(spark, rows, targets, **kw):
    t = spark.createDataFrame(targets, TARGETS)
    mixed = mix_sources(spark.createDataFrame(rows, DOCS), t, **kw)
    return mixed.collect(), {r["source"]: r for r in mix_report(mixed, t).collect()}


def test_shares_are_met(spark):
    rows = docs(clinic_notes=(900, 30), forum=(60, 12), manual=(200, 80), other=(500, 50)) + [(9001, None, "forum", 1, 1), (9002, "", "forum", 1, 1), (None, "word", "forum", 1, 1), (9003, "word", None, 1, 1)]
    mixed, report = run(spark, rows, [("Clinic Notes", 0.5, 1), ("forum", 0.1, 4), ("manual", 0.4, 2), ("none", 0.1, 2), ("zero", 0.0, 1), (None, 0.3, 1)])
    assert len(mixed) == 1162 and all(0 <= r.copies <= math.ceil(r.rate) and r.copies >= math.floor(r.rate) for r in mixed)
    for s, share, cap in (("clinic_notes", 0.5, 1), ("forum", 0.1, 4), ("manual", 0.4, 2)):
        assert abs(report[s].actual_share - share) < 0.01 and report[s].most_copies <= cap
    assert report["none"].mixed_tokens == 0 and {r.doc_id for r in mixed if r.copies} & {9001, 9002} == set()
    assert report["forum"].mixed_tokens == 4 * report["forum"].source_tokens  # the source that binds is used to its cap


def test_rates_are_tilted_and_exact(spark):
    rows = docs(a=(500, 10), b=(500, 10))
    mixed, report = run(spark, rows, [("a", 0.3, 3), ("b", 0.7, 1)])
    for s in "ab":
        own = [r for r in mixed if r.source == s]
        got = sum(r.rate * r.n_tokens for r in own)
        assert abs(got - report[s].mixed_tokens) < 60
        tilt = {round(math.log(r.rate) / r.n_tokens, 9) for r in own if r.rate < 1}
        assert len(tilt) <= 1
    assert Counter(r.copies for r in mixed if r.source == "b") == {1: 500}


def test_one_length_holds_everything(spark):
    rows = [(i, "same text here", "a", 1, 1) for i in range(3000)] + [(5000 + i, "same text here", "b", 1, 1) for i in range(1000)]
    mixed, report = run(spark, rows, [("a", 0.5, 1), ("b", 0.5, 2)], ranks=4)
    assert report["a"].mixed_documents == 2000 and report["b"].mixed_documents == 2000
    assert {r.copies for r in mixed if r.source == "a"} == {0, 1}


def test_given_total_falls_short_where_it_must(spark):
    rows = docs(a=(100, 10), b=(10, 10))
    _, report = run(spark, rows, [("a", 0.5, 1), ("b", 0.5, 2)], total_tokens=1600)
    assert abs(report["a"].mixed_tokens - 800) < 20 and report["b"].mixed_tokens == 2 * report["b"].source_tokens


@pytest.mark.parametrize(("rows", "targets"), [([], [("a", 0.5, 1)]), ([(1, "word", "a", 1, 1)], []), ([], [])])
def test_empty(spark, rows, targets):
    mixed, report = run(spark, rows, targets)
    assert mixed == [] and all(r.mixed_tokens == 0 and r.actual_share == 0 for r in report.values())


def test_budgets():
    assert plan_budgets({"a": (0.5, 1), "b": (0.5, 2)}, {"a": 100, "b": 30}) == {"a": 60, "b": 60}
    assert plan_budgets({}, {}) == {} and plan_budgets({"a": (1.0, 1)}, {}) == {}
