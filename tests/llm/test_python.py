"""Operators with Python tasks: BPE, packing, near duplicates, licences, the two models."""

import hashlib
import os
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ampertrace.llm import bpe, components, jaccard, langid, licenses, packing, quality
from tests.llm import brute
from tests.llm.test_native import ODD, table

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("word_bpe_49k.json")
TABLES = bpe.Tables.read(PATH)
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = bpe.Encoder(TABLES)
PARTS = [
    "a", "b", "the", "Σ", "ΣΑΣ", " ", "\x1c", "\x85", "\xa0", " ", "​", "İ", "ß", "½", "²", "😀", "'s", "'T", "<|endoftext|>", "<|startoftext|>", "<", "|>", "\n",
    "中", "ǅ", "﻿", "\xad", "aaa", "́", "é", "᠎", "　", "-", "!!!", "123", "don't", "Ａ",
]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS) | st.characters(exclude_categories=["Cs"]), max_size=14).map("".join))
def test_encoder_agrees_with_the_library(text):
    ids = ENCODER.encode([text])[0]
    assert ids.tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
    assert bpe.decode(TABLES, ids) == LIBRARY.decode(ids.tolist(), skip_special_tokens=False)


def test_encoder_takes_blocks_and_long_words():
    texts = ["", "ab3f" * 3000 + "a" * 5000, "x y", "", "Hello, World! " * 500]
    want = [LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]
    assert [i.tolist() for i in bpe.Encoder(TABLES).encode(texts)] == want


def test_token_digests(spark):
    docs = table(spark, ODD + ODD, "ids n_tokens _t")
    got = {r["doc_id"]: r for r in bpe.token_digests(docs, PATH).collect()}
    for i, t in enumerate(ODD + ODD):
        ids = LIBRARY.encode(t or "", add_special_tokens=False).ids
        assert got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert got[i]["decoded_sha256"] == brute.sha(LIBRARY.decode(ids, skip_special_tokens=False))
    assert bpe.token_digests(docs.filter("false"), PATH).collect() == []
    back = bpe.decode_documents(bpe.encode_documents(docs.limit(7), PATH), PATH).collect()
    assert all(r["text"] == LIBRARY.decode(LIBRARY.encode(ODD[r["doc_id"]] or "", add_special_tokens=False).ids, skip_special_tokens=False) for r in back)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=40))
def test_bins_are_valid_and_the_bound_holds(sizes):
    sizes = np.array(sizes)
    bins, offsets, filled, made, bound = packing.pack_group(sizes, 20)
    assert np.bincount(bins, weights=sizes).max() <= 20 and len(set(bins.tolist())) == made
    assert -(-int(sizes.sum()) // 20) <= bound <= made
    for b in range(made):
        own = sorted(zip(offsets[bins == b], sizes[bins == b]))
        assert [o for o, _ in own] == [0, *np.cumsum([s for _, s in own])[:-1]]


def test_bound_sees_large_pieces():
    assert packing.lower_bound(np.array([11] * 7), 20) == 7
    assert packing.lower_bound(np.array([7] * 9), 20) == 5
    assert packing.lower_bound(np.zeros(0, dtype=np.int64), 20) == 0


def check_packing(rows, texts, capacity=4096):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for i, t in enumerate(texts):
        ids = [*LIBRARY.encode(t or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[i], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in own] == [(k, s, min(capacity, len(ids) - s)) for k, s in enumerate(range(0, len(ids), capacity))]
        for r in own:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark):
    rng = random.Random(6)
    texts = ODD + ["the cat sat on " * rng.randint(1, 900) for _ in range(150)]
    rows = packing.pack_documents(table(spark, texts, "offset length _key"), PATH, partition_pieces=60).collect()
    used = check_packing(rows, texts)
    lengths = np.array([r["length"] for r in rows])
    # three partitions of about 60 pieces cost some bins against packing all at once
    assert packing.lower_bound(lengths, 4096) <= used <= 1.05 * packing.best_fit_decreasing(lengths, 4096)[1] + 1
    assert packing.pack_documents(table(spark, ["a"]).filter("false"), PATH).collect() == []


def test_packing_keeps_repeated_rows(spark):
    docs = table(spark, ["a b c"] * 5).withColumn("doc_id", F.lit(3))
    assert len(packing.pack_documents(docs, PATH, partition_pieces=2).collect()) == 5


def test_equal_rows_are_dealt_over_all_partitions(spark):
    pieces = spark.range(100_000).select(F.lit(None).cast("bigint").alias("doc_id"), F.lit(1000).cast("bigint").alias("length"))
    found = packing.pack(pieces, partition_pieces=10_000)
    sizes = found.placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.count_distinct("offset").alias("k"), F.count("*").alias("m")).collect()
    assert sum(r["m"] for r in sizes) == 100_000 and all(r["n"] <= 4096 and r["k"] == r["m"] for r in sizes)
    parts = found.certificates.filter("round = 0").collect()
    assert len(parts) == 10 and max(r["bins"] for r in parts) < 3000
    assert found.bins == len(sizes) and found.bound == 25_000 and found.bins <= 25_000 + 10


def test_certificates(spark):
    rng = np.random.default_rng(22)
    lengths = np.r_[rng.integers(1, 4097, 3000), np.full(500, 2049), np.full(200, 4096)]
    pieces = spark.createDataFrame([(int(n),) for n in lengths], "length bigint").repartition(3)
    found = packing.pack(pieces, partition_pieces=500)
    assert found.bound == packing.lower_bound(lengths, 4096)
    assert found.bins == found.placed.select("sequence_id").distinct().count() and found.placed.count() == len(lengths)
    rows = found.certificates.collect()
    assert all(r["bound"] <= r["bins"] for r in rows) and len({r["round"] for r in rows}) == found.rounds
    first = sum(r["bins"] for r in rows if r["round"] == 0)
    assert found.bins <= first and (found.rounds == 1 or found.bins < first or found.rounds == 2)


@pytest.mark.parametrize("partitions", [1, 4])
def test_near_groups(spark, partitions):
    rng = random.Random(partitions)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = list(ODD)
    for size in (1, 2, 4, 5, 6, 7, 9, 12, 20, 33, 60, 150, 400, 1500):
        base = [rng.choice(vocabulary) for _ in range(size)]
        passage = base[: size // 2]
        for _ in range(9):
            near = list(base)
            for _ in range(rng.randint(0, max(1, size // 40))):
                near[rng.randrange(size)] = rng.choice(vocabulary)
            texts.append(" ".join(near))
            texts.append(" ".join(near + near[:rng.randint(0, 3)]))
            texts.append(" ".join(passage + [rng.choice(vocabulary) for _ in range(size - len(passage))]))
    texts += [texts[-1].upper(), texts[-2] + "\n"] * 10
    docs = table(spark, texts, "sig cls size").repartition(partitions)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(docs).collect()}
    assert got == brute.near_components(list(enumerate(texts)))


def test_small_sets_lose_no_link(spark):
    """All sets over few words: many empty parts and links right at the threshold."""
    rng = random.Random(8)
    texts = []
    for _ in range(60):
        base = [f"v{rng.randrange(60)}" for _ in range(rng.randint(8, 40))]
        texts += [" ".join(base), " ".join(base[1:]), " ".join(base + ["q"]), " ".join(["r", *base]), " ".join(base[:-2])]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(table(spark, texts)).collect()}
    assert got == brute.near_components(list(enumerate(texts)))


def test_signatures_are_complete():
    """Every pair of sets at the threshold shares a signature, whatever the sizes."""
    rng = np.random.default_rng(9)
    for size in [*range(1, 60), 100, 333, 1000, 5000]:
        for _ in range(6):
            common = rng.integers(0, 2**63, size, dtype=np.uint64)
            spare = int(size / 0.8) - size
            a = int(rng.integers(0, spare + 1))
            p, q = (np.unique(np.r_[common, rng.integers(0, 2**63, n, dtype=np.uint64)]) for n in (a, spare - a))
            assert 100 * size >= 80 * (size + spare)
            signed = []
            for s in (p, q):
                bands = jaccard.bands_of(len(s))
                signed.append(set(np.concatenate([jaccard.sign(s, np.array([len(s)]), np.array([b]), 0)[0] for b in bands if jaccard.parts_of(b)[0]] or [s]).tolist()))
            assert signed[0] & signed[1] or not spare, size
            wide = [jaccard.sketch(s, jaccard.wide_bits(len(s))) for s in (p, q)]
            assert jaccard.may_be_similar(wide[0], len(p), wide[1], len(q)) and jaccard.may_be_similar(jaccard.sketch(p), len(p), wide[1], len(q))


def test_near_duplicates_leave_one(spark):
    base = " ".join(f"w{i}" for i in range(100))
    docs = table(spark, [None, "", base, base + " x", "other words are here now", base], "_gone component_id")
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 1, 2, 4]
    assert jaccard.near_groups(docs.filter("false")).collect() == []
    nameless = docs.withColumn("doc_id", F.when(F.col("doc_id") > 3, F.col("doc_id")))
    assert len(jaccard.near_groups(nameless).collect()) == 6


def near_texts(rng):
    """Texts of which half is one passage, with near copies and chains of them, and texts over few words."""
    passage = [f"p{i}" for i in range(30)]
    texts = [" ".join(passage + [f"w{rng.randrange(5000)}" for _ in range(30)]) for _ in range(150)]
    for t in texts[:40]:
        w = t.split()
        texts += [" ".join(w[:-2]), " ".join([*w, "x", "y"]), " ".join([*w[:45], "z", *w[45:]])]
    texts += [" ".join(passage + [f"u{rng.randrange(5000)}" for _ in range(rng.randint(3, 12))]) for _ in range(60)]
    for _ in range(40):
        base = [f"v{rng.randrange(40)}" for _ in range(rng.randint(5, 40))]
        texts += [" ".join(base), " ".join(base[1:]), " ".join(base + ["q"]), " ".join(["r", *base])]
    return texts


def test_copies_are_not_signed_again(spark):
    texts = [" ".join(f"w{(7 * i + j) % 50}x{i}" for j in range(40)) for i in range(20)]
    slim = spark.createDataFrame([(1000 * i + k, t) for i, t in enumerate(texts) for k in range(8)], "row bigint, _t string").repartition(4)
    classes = jaccard.numbered(slim.withColumn("doc_id", slim.row), 0).groupBy("cls").agg({"row": "min"}).toDF("cls", "row")
    signed = jaccard.signatures(slim, classes, 0)
    # each class is signed from its own row; the filter may let a few others through
    assert signed.select("cls").distinct().count() == 20
    assert signed.count() <= 1.2 * signed.distinct().count()
    rows = np.array([-(2**63), -1, 0, 5, 2**63 - 1])
    words = jaccard.row_filter(spark.createDataFrame([(1, r) for r in rows.tolist()], "cls bigint, row bigint"))
    assert jaccard.may_stand(rows, words).all()


def test_signatures_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(17)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (4, 5, 9, 40, 300, 7, 4)]
    sizes = np.array(list(map(len, sets)))
    bands = np.array([jaccard.band_of(n) for n in sizes.tolist()])
    sig, owner = jaccard.sign(np.concatenate(sets), sizes, bands, 0)
    for i, s in enumerate(sets):
        assert sorted(sig[owner == i].tolist()) == sorted(jaccard.sign(s, sizes[i : i + 1], bands[i : i + 1], 0)[0].tolist())


def test_shingle_sets():
    texts = [t or "" for t in ODD] + ["a b c d e f g", "A b\tc", "x " * 40, "one two three four five", "", "y" * 300_000 + " z " + "Y" * 300_000 + " y", "é\u00a0É", "long " * 70_000]
    elements, sizes = jaccard.shingle_sets(texts)
    assert sizes.tolist() == [len(brute.shingles(t)) for t in texts]
    alone = [jaccard.shingle_sets([t])[0] for t in texts]
    assert elements.tolist() == np.concatenate(alone).tolist() and all((np.diff(a.astype(object)) > 0).all() for a in alone)


def counted(monkeypatch, name, made):
    """Let a step of the join note the number of its rows."""
    inner = getattr(jaccard, name)

    def spy(rows):
        out = inner(rows)
        made.append((rows.count(), out.count()))
        return out

    monkeypatch.setattr(jaccard, name, spy)


@pytest.mark.parametrize("block", [7, 4096])
def test_common_passages(spark, monkeypatch, block):
    rounds, last = [], []
    counted(monkeypatch, "proposed", rounds)
    counted(monkeypatch, "all_pairs", last)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    texts = near_texts(random.Random(15))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_groups(table(spark, texts)).collect()}
    assert got == brute.near_components(list(enumerate(texts)))
    assert all(out <= rows for rows, out in rounds) and len(last) == 1


def test_a_chain_of_near_copies_is_one_component(spark, monkeypatch):
    """Each text is similar to some before and behind it, and to no other."""
    rounds, last = [], []
    counted(monkeypatch, "proposed", rounds)
    counted(monkeypatch, "all_pairs", last)
    words = [f"w{i}" for i in range(3200)]
    texts = [" ".join(words[3 * i : 3 * i + 120]) for i in range(1000)]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_groups(table(spark, texts)).collect()}
    assert set(got.values()) == {0} and len(got) == 1000
    # at most one pair for each row of a signature, where all pairs would be half a million
    assert all(out <= rows for rows, out in rounds) and sum(out for _, out in last) < 10_000


def test_blocks_cover_each_pair_across_components(spark):
    rng = random.Random(18)
    rows = [(sig, c, rng.choice([1, 1, 1, 1, 2, 3])) for sig in range(4) for c in range(60)]
    met = set()
    for r in jaccard.dealt(spark.createDataFrame(rows, "sig bigint, cls bigint, grp bigint")).groupBy("sig", "i", "j").agg(
        F.collect_list(F.when(F.col("first"), F.struct("cls", "grp"))).alias("p"), F.collect_list(F.when(~F.col("first"), F.struct("cls", "grp"))).alias("q")
    ).collect():
        both = [(x, y) for x in r["p"] for y in r["q"]] if r["i"] != r["j"] else [(x, y) for x in r["p"] + r["q"] for y in r["p"] + r["q"]]
        met |= {(r["sig"], *sorted((x["cls"], y["cls"]))) for x, y in both if x["grp"] != y["grp"]}
    assert met == {(s, c, d) for s, c, g in rows for t, d, h in rows if s == t and c < d and g != h}


def test_keep_one_takes_repeated_and_missing_identifiers(spark):
    one, two = (" ".join(f"{p}{i}" for i in range(100)) for p in "xy")
    rows = [(5, one), (5, two), (7, one + " more"), (None, two + " more"), (None, "all alone in here now"), (9, two), (9, two), (3, "ab"), (2, "AB")]
    docs = spark.createDataFrame(rows, "doc_id int, text string")
    groups = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.near_groups(docs).collect()), key=str)
    assert groups == sorted([(5, 5), (5, 5), (7, 5), (None, 5), (None, None), (9, 5), (9, 5), (3, 2), (2, 2)], key=str)
    assert {tuple(r) for r in jaccard.keep_one(docs).collect()} == {(5, one), (5, two), (None, "all alone in here now"), (2, "AB")}
    nameless = docs.withColumn("doc_id", F.lit(None).cast("int"))
    assert jaccard.keep_one(nameless).count() == 4


def test_word_vectors_and_pooling_by_loops(spark):
    texts = ["The cat! sat 12 on THE mat", "", "cat cat", None, "a b c d e"]
    known, (places, signs) = quality.WordBuckets(), quality.index_vectors()
    buckets = [[known[w] for w in quality.WORD.findall(t or "")] for t in texts]
    assert known["12"] == known["7"] and known["THE"] == known["AB"] != known["the"] and known["cat"] == known["Cat"]
    want = np.zeros((quality.BUCKETS, quality.DIMENSIONS), dtype=np.int64)
    for own in buckets:
        for i, word in enumerate(own):
            for j, neighbour in enumerate(own):
                if 0 < abs(i - j) <= quality.REACH:
                    for place, sign in zip(places[neighbour], signs[neighbour]):
                        want[word, place] += sign
    sums = quality.context_sums(table(spark, texts).withColumnRenamed("text", "_t").repartition(3)).collect()
    got = np.zeros_like(want)
    for r in sums:
        got[r["bucket"]] = r[1:]
    assert (got == want).all() and want.any()
    vectors = (want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    pooled = quality.pooled(vectors, [t or "" for t in texts], quality.WordBuckets())
    for own, row in zip(buckets, pooled):
        v = [vectors[b].astype(float) for b in own]
        mean = sum(v) / len(v) if v else np.zeros(quality.DIMENSIONS)
        apart = sum(abs(a - b) for a, b in zip(v, v[1:])) / (len(v) - 1) if len(v) > 1 else np.zeros(quality.DIMENSIONS)
        assert np.allclose(row, np.r_[mean, apart], atol=1e-6)


def test_temperature_is_the_best_of_the_grid():
    rng = np.random.default_rng(24)
    x = rng.normal(size=(600, 4))
    y = (x[:, 0] + rng.normal(size=600) > 0).astype(float)
    c = quality.train(x, y)
    order = np.random.default_rng(5).permutation(len(x))
    check = order[: len(order) // 5]
    loss = lambda t: float(np.mean([np.log1p(np.exp(-z / t if v else z / t)) for z, v in zip(c.logits(x[check]), y[check])]))
    grid = np.geomspace(0.25, 8, 60)
    assert abs(c.temperature - grid[int(np.argmin([loss(t) for t in grid]))]) < 1e-9
    assert np.allclose(c.score(x), 1 / (1 + np.exp(-c.logits(x) / c.temperature)))


def test_word_hashes():
    texts = ["The cat", "", "  the\tCAT\n", "x" * 300 + " the", "a" * 70_000 + " cat " * 60_000, "É é"]
    h, counts = jaccard.word_hashes(texts)
    words = [w for t in texts for w in brute.words(brute.ascii_lower(t))]
    assert counts.tolist() == [len(brute.words(t)) for t in texts]
    of = dict(zip(words, h.tolist()))
    assert [of[w] for w in words] == h.tolist() and len(set(of.values())) == len(of)


def test_pairs_in_runs():
    rng = np.random.default_rng(25)
    key = np.sort(rng.integers(0, 6, 30))
    met = {(int(i), int(j)) for x, y in jaccard.pairs_in(jaccard.run_ends(key)) for i, j in zip(x, y)}
    assert met == {(i, j) for i in range(30) for j in range(i + 1, 30) if key[i] == key[j]}


def test_components(spark):
    rng = random.Random(10)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(7, 7), (500, 501)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}


LICENSES = [
    "Released under the MIT License.", "mit license MIT\nlicense, mit-license cc by CC-BY", "x GNU General Public License gnu general public license", "apache license" * 2,
    "Ünder thé apache LICENSE 2", "gnu general public", "This work is licensed under CC BY 4.0",
]


def test_license_phrases(spark):
    rng = random.Random(11)
    parts = ["gnu", "General", "public", "license", "mit", "apache", "cc", "by", "the", "-", "permission"]
    texts = ODD + LICENSES + [" ".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(table(spark, texts, "labels score")).collect()}
    for i, t in enumerate(texts):
        n, starts, labels = brute.license_places(t)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, len(starts), min(starts, default=None), max(starts, default=None), labels), t
        assert set(labels.split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    assert licenses.scan_licenses(table(spark, ["a"]).filter("false")).collect() == []


def test_license_templates_and_matching_statistics():
    a = licenses.Automaton.build(licenses.TEMPLATES, licenses.PHRASES)
    for name, text in licenses.TEMPLATES.items():
        words = text.split()
        f = licenses.scan(a, "some other text " + text + " more text")
        assert (name, 3, 3 + a.sizes[name], 1.0) in f.spans
        damaged = " ".join(words[:20] + ["xx", "yy"] + words[20:])
        assert any(s[0] == name and s[3] > 0.9 for s in licenses.scan(a, damaged).spans)
    rng = random.Random(12)
    templates = {f"t{k}": " ".join(rng.choice("abc") for _ in range(30)) for k in range(3)}
    a = licenses.Automaton.build(templates, {"a b": "x"})
    corpus = [t.split() for t in templates.values()]
    inside = {tuple(c[i:j]) for c in corpus for i in range(len(c)) for j in range(i + 1, len(c) + 1)}
    words = [rng.choice("abcd") for _ in range(300)]
    longest = [next((n for n in range(i + 1, 0, -1) if tuple(words[i + 1 - n : i + 1]) in inside), 0) for i in range(len(words))]
    want = [(i + 1 - n, n) for i, n in enumerate(longest) if n >= licenses.LEAST_MATCH and (i + 1 == len(words) or longest[i + 1] <= n)]
    found, _ = licenses.runs(a, [w.encode() for w in words])
    assert [(s, n) for s, n, _ in found] == want


def brute_chain(matches):
    """The most words that any chain covers, over all chains."""
    best = 0

    def grow(last, covered):
        nonlocal best
        best = max(best, covered)
        for m in matches:
            more = licenses.gain(last, m)
            if more:
                grow(m, covered + more)

    for m in matches:
        grow(m, m[3])
    return best


def test_chains_cover_most():
    a = licenses.Automaton.build({"t": "a b c d e f g h x6 x7 x8 x9 y1 y2 a b c d z1 z2 z3 z4"}, {})
    # the first run stands at two places; only its second one goes on
    (span,) = licenses.scan(a, "q x6 x7 x8 x9 y1 y2 a b c d z1 z2 z3 z4").spans
    assert span == ("t", 1, 15, 14 / 22)
    rng = random.Random(23)
    for _ in range(200):
        matches = []
        for _ in range(rng.randint(1, 8)):
            start, size, place = rng.randint(0, 40), rng.randint(1, 6), rng.randint(6, 40)
            matches.append((start, start + size, place, size))
        ordered = sorted(matches, key=lambda m: (m[1], m[2], m[0]))
        first, end, covered = licenses.best_chain(ordered)
        assert covered == brute_chain(ordered)
        groups = list(licenses.apart(ordered))
        assert sorted(m for g in groups for m in g) == sorted(matches)
        for g in groups:
            for h in groups:
                if g is not h:
                    assert not any(licenses.gain(x, y) or x[0] < y[1] and y[0] < x[1] for x in g for y in h)
        found = licenses.best_chains(matches)
        assert max(c for *_, c in found) == covered and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
    many = " ".join([licenses.TEMPLATES["mit"]] * 3000)
    started = time.time()
    spans = [s for s in licenses.scan(licenses.Automaton.build(licenses.TEMPLATES, licenses.PHRASES), many).spans if s[3] == 1.0]
    assert len(spans) == 3000 and time.time() - started < 60


def test_backpropagation_through_time():
    rng = np.random.default_rng(1)
    net = langid.initial(["a", "b"], 3, rng)
    x = rng.integers(0, 256, (6, 4))
    d, weight = net.directions[0], rng.normal(size=(6, 3, 4))
    states, saved = langid.forward(d, x)
    g_table, g_inner = langid.backward(d, x, saved, weight)
    for w, g in ((d.inner, g_inner), (d.table, g_table)):
        for at in [(0, 0), (4, 2), (7, 1), (8, int(x[2, 1]) % w.shape[1])]:
            old = w[at]
            w[at] = old + 1e-5
            up = (langid.forward(d, x)[0] * weight).sum()
            w[at] = old - 1e-5
            down = (langid.forward(d, x)[0] * weight).sum()
            w[at] = old
            assert abs((up - down) / 2e-5 - g[at]) < 1e-6


def test_runner_equals_the_network():
    net = langid.initial(["a", "b", "c"], 4, np.random.default_rng(2))
    text = "Ein Satz, 12 Wörter!"
    x = np.frombuffer(text.encode(), dtype=np.uint8)[:, None]
    left, right = langid.forward(net.directions[0], x)[0], langid.forward(net.directions[1], x[::-1])[0][::-1]
    p = np.exp(net.out @ np.concatenate([left, right], axis=1) + net.bias)[:, :, 0]
    p /= p.sum(axis=1, keepdims=True)
    letter = langid.LETTER[x[:, 0]]
    want = (p * letter[:, None]).sum(axis=0) / letter.sum()
    got = langid.pooled(langid.Runner(net), [text, "", "x" * 300])
    assert np.allclose(got[0], want, atol=1e-5) and got[1].sum() == 0


def made_up(rng, letters, n):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(n))


def test_language_id(spark, monkeypatch):
    monkeypatch.setattr(langid, "STEPS", 150)
    rng = random.Random(13)
    rows = [(i, made_up(rng, "aeioust" if i % 2 else "kbdgrzü", rng.randint(2, 30)), "xx" if i % 2 else "yy") for i in range(200)]
    rows += [(900, None, "xx"), (901, "12 !", None), (902, "", "yy"), (903, "aeiou test", None), (None, "kdzü gr", "yy")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("lang_pred", F.lit(1))
    held = langid.remainder(F.col("doc_id"), 3) == 1
    got = {r["doc_id"]: r for r in langid.identify(docs, langid.fit(docs, held_out=held)).collect()}
    assert len(got) == len(rows)
    out = [(got[i]["lang_pred"], lang) for i, _, lang in rows[:200] if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(a == b for a, b in out) >= 0.95 * len(out)
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert all(0 <= r["score"] <= 1 for r in got.values())
    empty = docs.filter("false")
    assert langid.fit(empty) is None and langid.identify(empty, None).collect() == []
    assert {r["lang_pred"] for r in langid.identify(docs, None).collect()} == {"und"}


def test_quality(spark):
    rng = random.Random(14)
    good = lambda: made_up(rng, "aeioustrn", rng.randint(5, 60))
    bad = [lambda: good().replace(" ", "$$$ "), lambda: good().upper().replace(" ", "!! "), lambda: " ".join(w for w in good().split() for _ in range(9))]
    rows = [(i, good() if i % 3 else rng.choice(bad)()) for i in range(600)] + [(900, None), (901, ""), (902, "a")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"quality": F.lit(9), "score": F.lit(9)})
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(None, 1), (5, None)], "doc_id bigint, quality int")
    seen = labels.filter(quality.fold(F.col("doc_id")) != 0)
    got = {r["doc_id"]: r["score"] for r in quality.score_documents(docs, seen).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    out = [(got[i] >= 0.3, i % 3 > 0) for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in out) >= 0.95 * len(out)
    assert quality.score_documents(docs.filter("false"), labels).collect() == []
    unlabelled = {r["score"] for r in quality.score_documents(docs, labels.filter("false")).collect()}
    assert unlabelled == {0.5}
