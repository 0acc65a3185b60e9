"""Slot-wise ordered operators against plain Python on skewed data."""

import random
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from ampertrace.operators import matching, ordered
from ampertrace.operators.quantiles import exact_quantiles

START = datetime(2024, 1, 1)


def skewed(n=600, seed=1):
    """Two thirds of the rows have one key; times repeat and cross slot borders."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.66 else rng.choice("abc")
        rows.append((key, START + timedelta(minutes=rng.randrange(0, 60 * 30)), i, rng.choice(["x", "y", None]), rng.randrange(5)))
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, "k string, ts timestamp, id long, v string, n int")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(5)


def by_key(rows):
    groups = {}
    for row in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(row[0], []).append(row)
    return groups


def test_segment_numbers_runs_like_a_loop(spark):
    rows = skewed()
    out = ordered.segment(
        frame(spark, rows), "k", ("ts", "id"), {"v": F.coalesce("v", F.lit("")), "ts": F.col("ts")},
        lambda row, prev: (row["v"] != prev["v"]) | (ordered.seconds_between(row["ts"], prev["ts"]) > 1200),
    ).collect()
    got = {r["id"]: (r["seq"], r["is_start"], r["prev"]["ts"] if r["prev"] else None) for r in out}
    assert len(got) == len(rows)
    for group in by_key(rows).values():
        seq, prev = 0, None
        for row in group:
            start = prev is None or (row[3] or "") != (prev[3] or "") or (row[1] - prev[1]).total_seconds() > 1200
            seq += start
            assert got[row[2]] == (seq, start, prev[1] if prev else None)
            prev = row


def test_history_next_and_running(spark):
    rows = skewed(seed=2)
    df = frame(spark, rows)
    history = ordered.with_history(
        df, "k", ("ts", "id"), previous={"id": F.col("id")},
        seen_before={"before": F.when(F.col("v").isNotNull(), F.struct("v", "id"))},
        seen_upto={"upto": F.when(F.col("v") == "x", F.col("id"))},
    )
    got = {r["id"]: r for r in history.collect()}
    nxt = {r["id"]: r["next"] for r in ordered.with_next(df, "k", ("ts", "id"), {"id": F.col("id")}).collect()}
    run = ordered.with_running(df, "k", ("ts", "id"), {"total": ("sum", F.col("n")), "top": ("max", F.col("n"))}, include_current=False)
    sums = {r["id"]: (r["total"], r["top"]) for r in run.collect()}
    for group in by_key(rows).values():
        last, upto, total, top = None, None, None, None
        for i, row in enumerate(group):
            r = got[row[2]]
            assert (r["prev"]["id"] if r["prev"] else None) == (group[i - 1][2] if i else None)
            assert (r["before"]["id"] if r["before"] else None) == last
            upto = row[2] if row[3] == "x" else upto
            assert r["upto"] == upto
            assert (nxt[row[2]]["id"] if nxt[row[2]] else None) == (group[i + 1][2] if i + 1 < len(group) else None)
            assert sums[row[2]] == (total, top)
            last = row[2] if row[3] is not None else last
            total, top = (total or 0) + row[4], max(top if top is not None else -1, row[4])


def test_exact_quantiles_match_numpy_for_a_hot_group(spark):
    rng = np.random.default_rng(3)
    rows = [("hot", float(v)) for v in rng.normal(size=30_001)] + [("tie", 1.0)] * 500 + [("two", 1.0), ("two", 4.0), ("one", 7.0)]
    rows += [("none", None)]
    df = spark.createDataFrame(rows, "k string, x double").repartition(6)
    for q in (0.5, 0.25):
        got = {r["k"]: r["m"] for r in exact_quantiles(df, ["k"], {"m": "x"}, q).collect()}
        assert set(got) == {"hot", "tie", "two", "one"}
        for key in got:
            values = [v for k, v in rows if k == key]
            assert abs(got[key] - np.quantile(values, q)) < 1e-12


def test_matching_joins_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["anna", "jan", "kowal", "lis", "ewa", "nowak"]
    sets = [(i, rng.sample(words, rng.randrange(1, 5))) for i in range(60)]
    terms = [(i, rng.sample(words, rng.randrange(1, 3))) for i in range(20)]
    left = spark.createDataFrame(sets, "s long, words array<string>")
    right = spark.createDataFrame(terms, "t long, need array<string>")
    got = {(r["s"], r["t"]) for r in matching.subset_pairs(left, "words", right, "need").collect()}
    assert got == {(s, t) for s, w in sets for t, n in terms if set(n) <= set(w)}

    texts = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(0, 12)))) for i in range(50)]
    parts = [(i, "".join(rng.choice("ab") for _ in range(rng.randrange(1, 6)))) for i in range(15)]
    left = spark.createDataFrame(texts, "s long, text string")
    right = spark.createDataFrame(parts, "t long, part string")
    got = {(r["s"], r["t"]) for r in matching.substring_pairs(left, "text", right, "part").collect()}
    assert got == {(s, t) for s, x in texts for t, p in parts if p in x}
