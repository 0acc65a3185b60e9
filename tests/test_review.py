"""Coverage of problems by cases against brute force."""

import random
import re
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as contract
from ampertrace.operators import review

SF = "/root/testdata/sf0.001"


def words(text):
    return {w for w in re.split("[^a-z0-9]+", text.lower()) if len(w) >= 4 and not w.isdigit()}


def brute(problems, cases):
    out = set()
    for i, a in problems:
        hits = {(i, j, len(words(a) & words(b)), "B") for j, b in cases if len(words(a) & words(b)) >= 2}
        out |= hits or {(i, None, 0, "C")}
    return out


def expanded(rows):
    """Pairs out of class pairs and members."""
    problems, cases, out = {}, {}, set()
    for r in rows:
        if r["problem_id"] is not None:
            problems.setdefault(r["problem_words"], []).append(r["problem_id"])
        elif r["case_id"] is not None:
            cases.setdefault(r["case_words"], []).append(r["case_id"])
    for r in rows:
        if r["coverage"]:
            ids = cases[r["case_words"]] if r["coverage"] == "B" else [None]
            out |= {(p, c, r["shared"], r["coverage"]) for p in problems[r["problem_words"]] for c in ids}
    return out


def test_coverage_by_classes(spark):
    problems = [(1, "brake pedal noise"), (2, "noise of brake pedal"), (3, "lamp"), (4, ""), (5, "window lever stuck noise")]
    cases = [(10 + k, "pedal brake noise") for k in range(30)] + [(50, "stuck window"), (51, "noise noise"), (52, "")]
    p = spark.createDataFrame(problems, "problem_id bigint, text string")
    c = spark.createDataFrame(cases, "case_id bigint, text string")
    assert {tuple(r) for r in review.coverage_candidates(p, c).collect()} == brute(problems, cases)
    rows = review.coverage_classes(p, c).collect()
    assert expanded(rows) == brute(problems, cases)
    # equal texts are one class: no row for each of the 60 pairs
    assert len(rows) == len(problems) + len(cases) + 4


def brute_top(problems, cases, n):
    rows = {" ".join(sorted(words(t))) for _, t in cases} - {""}
    often = Counter(w for r in rows for w in r.split())
    weight = {w: len(rows) * 100 // k for w, k in often.items()}
    out = set()
    for i, t in problems:
        scores = {r: sum(weight.get(w, 0) for w in words(t) & set(r.split())) for r in rows}
        best = sorted((s for s in scores.values() if s), reverse=True)
        out |= {(i, r, s, best.index(s) + 1) for r, s in scores.items() if s and best.index(s) < n}
    return out


@pytest.mark.parametrize("n", [1, 3])
def test_top_cases_equal_brute_force(spark, n):
    rng = random.Random(n)
    vocabulary = [f"word{c}" for c in "abcdefghij"] + [f"rare{c}" for c in "abcdefghijklmnop"]
    text = lambda: " ".join(rng.choices(vocabulary, [9] * 10 + [1] * 16, k=rng.randint(0, 6)))
    problems = [(i, text()) for i in range(60)] + [(90, "nothing shared anywhere"), (91, "")]
    cases = [(100 + i, text()) for i in range(120)] + [(400, "worda"), (401, "worda"), (402, "")]
    got = review.top_cases(spark.createDataFrame(problems, "problem_id bigint, text string"), spark.createDataFrame(cases, "case_id bigint, text string"), n)
    assert {tuple(r) for r in got.collect()} == brute_top(problems, cases, n)
    assert review.top_cases(spark.createDataFrame([], "problem_id bigint, text string"), spark.createDataFrame([], "case_id bigint, text string")).collect() == []


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")
def test_all_parts_are_cases(spark):
    part = spark.read.parquet(f"{SF}/part.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    problems = [(r["p_partkey"], f"{r['p_name']} {r['p_type']}") for r in part]
    cases = [(1000 + r["p_partkey"], f"{r['p_name']} {r['p_type']} {r['p_brand']}") for r in part]
    rows = contract.queries()["j23_coverage_classes"](spark, SF).collect()
    own = {x for x in expanded(rows) if x[1] is None or x[1] >= 1000}
    assert {r["case_id"] for r in rows if r["case_id"] is not None} == {c for c, _ in cases} | {r["item_id"] for r in items}
    assert {x for x in own if x[3] == "B"} == {x for x in brute(problems, cases) if x[3] == "B"}
