"""Whitening, toxicity and spelling variants against plain numpy and Python."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ampertrace.llm import spelling, toxicity, whitening
from tests.llm.test_native import ODD, table


# ---- whitening ----

def agree(a):
    values, vectors = whitening.directions(np.linalg.qr(a, mode="r"))
    want = np.linalg.svd(a, compute_uv=False) ** 2
    want = want[want > 1e-20 * max(float(want.max(initial=0)), 1e-300)]
    assert len(values) == len(want)
    if len(values):
        assert np.abs(values / want - 1).max() < 1e-9
        assert np.abs(vectors @ vectors.T - np.eye(len(values))).max() < 1e-7
        assert np.abs((a @ vectors.T).T @ (a @ vectors.T) - np.diag(values)).max() < 1e-7 * values[0]


def test_directions():
    rng = np.random.default_rng(0)
    for n in range(150):
        agree(rng.integers(-3, 4, size=(rng.integers(1, 20), rng.integers(1, 12))).astype(float))
    agree(rng.normal(size=(300, 64)))
    agree(rng.normal(size=(300, 64)) * np.geomspace(1, 1e-5, 64))
    agree(np.repeat(rng.normal(size=(100, 8)), 3, axis=1))
    agree(np.kron(np.eye(8), rng.normal(size=(20, 8))))
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    agree(np.diag(np.r_[np.ones(10), 1 + 1e-9 * np.arange(10), np.full(20, 0.5)]) @ q)
    for flat in (np.zeros((4, 3)), np.ones((5, 5)), np.eye(7), np.diag([3.0, 3, 2, 2, 1])):
        agree(flat)


def test_small_values_keep_their_digits():
    d, e = np.array([1.0, 1e-8, 1e-4, 3e-9]), np.array([1e-3, 1e-9, 1e-6])
    got = whitening.dqds(d, e)
    # the product of the values is that of the squared diagonal, to the last digits
    assert math.isclose(np.prod(got), np.prod(d**2), rel_tol=1e-12)


def test_whitening(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(400, 20)) @ rng.normal(size=(20, 20)) / 7).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(vectors)] + [(1000 + i, vectors[3].tolist(), 0) for i in range(300)]
    odd = [(1, None, 0), (2, [None] + [0.0] * 19, 0), (3, [float("nan")] * 20, 0), (4, [float("inf")] * 20, 0), (5, [1.0] * 19, 0), (6, [], 0)]
    extra = [(None, vectors[4].tolist(), 0)]
    df = spark.createDataFrame(rows + odd + extra, "vec_id bigint, embedding array<float>, x int").withColumn("n", F.lit(3)).repartition(7)
    got = whitening.whiten(df).toPandas()
    x = np.floor(64 * np.array([r[1] for r in rows + extra], dtype=np.float64).astype(np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    unique = np.unique(x, axis=0)
    n, sums = len(unique), unique.sum(axis=0)
    assert len(got) == 701 * 16 and set(got["n"]) == {n}
    centred = (unique - sums / n)
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:16], basis[:, ::-1][:, :16]
    share = got.groupby("component")["explained"].first().to_numpy()
    assert np.abs(share / (values / np.trace(centred.T @ centred / n)) - 1).max() < 1e-9
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    own = got[got["vec_id"] < 1000].sort_values(["vec_id", "component"])["whitened"].to_numpy().reshape(400, 16)
    want = (x[:400] - sums / n) @ basis / np.sqrt(values)
    assert np.abs(own - want * np.sign((own * want).sum(axis=0))).max() < 1e-8
    deviation = got[got["component"] == 1].dropna(subset="vec_id").set_index("vec_id")["deviation"]
    assert {i: int(d) for i, d in deviation.items()} == {r[0]: int(((n * v - sums) ** 2).sum()) for r, v in zip(rows, x)}
    assert got["vec_id"].isna().sum() == 16


def test_whitening_of_few_vectors(spark):
    of = lambda *v: spark.createDataFrame([(i, list(x)) for i, x in enumerate(v)], "vec_id int, embedding array<double>")
    assert whitening.whiten(of([1.0, 2.0])).collect() == []
    assert whitening.whiten(of([1.0, 2.0]).filter("false")).collect() == []
    assert whitening.whiten(of([1.0, 2.0], [1.0, 2.0])).collect() == []
    two = whitening.whiten(of([1.0, 2.0], [3.0, 2.0], [1e300, 2.0], [-1e300, 2.0])).collect()
    assert len(two) == 4 and {r["component"] for r in two} == {1} and all(math.isfinite(r["whitened"]) for r in two)
    assert {r["vec_id"]: r["deviation"] for r in two} == {0: 0, 1: 512**2, 2: None, 3: None}


def test_deviations_beyond_64_bits():
    x, sums = np.array([[1 << 40, 3], [5, 3]]), np.array([7, 6], dtype=object)
    assert whitening.deviations(x, 2, sums) == [None, 9]


# ---- toxicity ----

def test_risk_gradient_by_differences():
    rng = np.random.default_rng(2)
    logits, positive = rng.normal(size=30), np.arange(30) < 10
    risk, gradient = toxicity.risk_gradient(logits, positive, 0.2)
    for i in range(30):
        near = logits.copy()
        near[i] += 1e-6
        assert abs((toxicity.risk_gradient(near, positive, 0.2)[0] - risk) / 1e-6 - gradient[i]) < 1e-5
    # a bracket below zero: the step goes back, and the risk is that of the toxic examples alone
    learned = np.where(positive, 6.0, -6.0)
    risk, gradient = toxicity.risk_gradient(learned, positive, 0.9)
    assert risk == pytest.approx(0.9 * np.logaddexp(0, -6.0)) and (gradient[positive] > 0).all() and (gradient[~positive] < 0).all()


def test_features_are_sets():
    known = toxicity.WordFeatures()
    found, counts = toxicity.features(["Word word WORD", "", "word", "a1b2"], known)
    assert counts.tolist() == [3, 0, 3, 6] and found[:3].tolist() == found[3:6].tolist()
    model = toxicity.Classifier(np.arange(toxicity.BUCKETS, dtype=float), 1.0)
    want = [1.0 + sum(set(f)) for f in (found[:3].tolist(), [], found[3:6].tolist(), found[6:].tolist())]
    assert model.logits(found, counts).tolist() == pytest.approx(want)


def toxic_table(spark, n=900):
    rng = random.Random(4)
    texts, labels = list(ODD), []
    for i in range(len(ODD), n):
        words = [f"w{rng.randrange(400)}" if rng.random() < 0.5 else "abcdefgh"[rng.randrange(8)] * 3 + "xyz" for _ in range(rng.randint(5, 60))]
        bad = rng.random() < 0.15
        if bad:
            words[rng.randrange(len(words))] = rng.choice(["vilest", "vilely", "Scoundrel"])
        texts.append(" ".join(words))
        if rng.random() < 0.7:
            labels.append((i, int(bad)))
    return table(spark, texts, "score _t toxic"), spark.createDataFrame(labels + [(None, 1), (20, None)], "doc_id bigint, toxic int"), texts


def test_toxic_documents_are_found(spark):
    docs, labels, texts = toxic_table(spark)
    held = toxicity.fold(F.col("doc_id")) == 2
    model = toxicity.fit(docs.filter(~held), labels.filter(~held))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, model).collect()}
    assert set(got) == set(range(len(texts))) and all(0 <= s <= 1 for s in got.values())
    bad = {i for i, t in enumerate(texts) if t and re.search("vile|Scoundrel", t)}
    assert np.mean([(got[i] >= toxicity.THRESHOLD) == (i in bad) for i in got if i % 4 == 2]) > 0.97
    again = toxicity.score_documents(docs, toxicity.fit(docs.filter(~held), labels.filter(~held))).collect()
    assert {r["doc_id"]: r["score"] for r in again} == got
    assert toxicity.score_documents(docs.filter("false"), model).collect() == []


def test_one_sided_labels(spark):
    docs, labels, _ = toxic_table(spark, 40)
    score = lambda some: {r["score"] for r in toxicity.score_documents(docs, toxicity.fit(docs, some)).collect()}
    assert score(labels.filter("false")) == {1 / (1 + math.exp(40))}
    assert score(labels.filter("toxic = 0")) == {1 / (1 + math.exp(40))}
    assert min(score(labels.withColumn("toxic", F.lit(1)))) > 0.999


# ---- spelling variants ----

def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    counts = Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                counts[w] += 1
    counts = {w: n for w, n in counts.items() if n >= 5}
    form, out = {}, {}
    for w, n in counts.items():
        around = sorted((-counts[v], v) for v in counts if near(w, v))
        best = around[0] if around and -around[0][0] >= 5 * n else None
        form[w] = best and best[1]
        out[w] = (form[w], n, len(around), best and -best[0])
    root = {}
    for w in counts:
        r = w
        while form[r]:
            r = form[r]
        root[w] = r
    return {w: (f, root[w], n, k, m) for w, (f, n, k, m) in out.items()}


def test_acceptor_and_its_pairs():
    rng = random.Random(3)
    for _ in range(150):
        words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 5))) for _ in range(40)})
        assert {tuple(sorted(p)) for p in spelling.Acceptor(words).edit_pairs()} == {(a, b) for a in words for b in words if a < b and near(a, b)}
    same = spelling.Acceptor(sorted(a + b for a in "abcd" for b in ("ing", "ed", "s")))
    assert len(same.arcs) == 6  # start, three behind a letter or two, one end


def test_variants(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ÀÉabcd×"]
    long = "".join(rng.choice("xyz") for _ in range(700))
    stems += [long, long[:300] + "q" + long[300:], long[:650] + long[651:], "q" + long[1:]]
    weights = [rng.choice([1, 2, 10, 60]) for _ in stems]
    words = rng.choices(stems, weights, k=9000)
    docs = [(i, " ".join(w if rng.random() < 0.9 else w[: (k := rng.randrange(len(w)))] + w[k + 1 :] for w in words[30 * i : 30 * i + 30])) for i in range(300)]
    docs += [(i, (t or "")[:5000]) for i, t in enumerate(ODD, 400)] + [(500, "UPPER Words Upper" * 20)]
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id bigint, text string, n int").withColumn("word", F.lit(0)).repartition(5)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variants(frame).collect()}
    want = brute_variants(docs)
    assert got == want
    assert sum(f is not None for f, *_ in want.values()) > 5 and any(r != w and r != want[w][0] for w, (f, r, *_) in want.items())
    assert spelling.variants(frame.filter("false")).collect() == []


def test_roots_of_long_chains(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)], "word string, form string")
    assert {r["root"] for r in spelling.roots(forms).collect()} == {"w37"}
    assert spelling.roots(forms.filter("false")).collect() == []
