"""Jaccard self-join of documents on word shingles, by PartEnum signatures.

Two sets of sizes r <= s with a Jaccard similarity of 0.8 or more differ in (r + s) / 9 elements at most, and s <= 1.25 r.
Sizes are cut into bands. For pairs whose smaller set lies in a band, k bounds the difference. The feature domain is partitioned
twice by hashes: into n = k // 2 + 1 + t parts, and each part into ``SUB`` parts of its own. k differing elements spoil two
and more elements in k // 2 parts at most, so t + 1 parts or more differ in one element at most, and that one lies in one of the ``SUB``.
A set signs all subsets of ``SUB`` - 1 of each part's sub-parts: similar sets share a signature, and others seldom do, as it speaks for several
elements. A set takes part in its own band and in those lower bands where its partners may lie.

A subset without elements says nothing and would be shared by very many sets, so it is not signed. A part with such a subset is
thin. That loses nothing where one of two sets has t thin parts or fewer: some agreeing part is not thin. A set with
more of them signs another partition of the domain as well, where the same holds, up to ``SEEDS`` of them; if it is unlucky in all, it
signs its empty subsets too.

Equal sets are one class, signed from the row that stands for it; a filter of those rows keeps most other rows from being signed again.
Classes that share a signature are candidates. Components, not pairs, are asked for, so:

1. The least class of a signature is its centre. Each class is tested against the centre with which it shares most signatures.
2. Rounds: a signature whose classes lie in one component, or in which no pair across components can be similar, is settled. The
   others propose a spanning forest of their components, one pair for each two that it would join; a pair is tested once, whatever
   number of signatures propose it. The rounds end when most of the proposed pairs turn out not to be similar.
3. Last, all pairs across components are compared within the signatures that are still open, in blocks: classes outside a
   signature's largest component with each other and with those inside. Nothing is left out, so the result is exact.

Pairs are compared by parity sketches before their sets are sent: each differing element turns one bit, so more differing bits
than the bound prove that a pair is not similar. Within signatures a sketch has 1024 bits; a pair that passes is compared by sketches
as wide as its sets are large, and what is left on the whole sets.

Elements are 64-bit hashes of shingles. Classes are numbered by 64 bits of a set's hash; a second 64 bits and the
size tell whether a number stands for two sets, and then everything is numbered by another seed.

Defined results: null and empty texts have an empty set and no links. A document of one to four words has its words as its
one shingle. Repeated rows are copies of each other. Rows that share an identifier are rows of their own, linked by their texts
only. Rows without identifier take part like others, but name no component; one of such rows only has a null name. A table without
rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import erfc, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampertrace.llm.arrays import column, spare
from ampertrace.llm.codes import arrow_type, blocks
from ampertrace.llm.components import components
from ampertrace.session import cut_lineage

SHINGLE = 5
BAND = 1.4
#: sub-parts of a part; all but one of them are signed
SUB = 3
SEEDS = 4
SKETCH_BITS = 1024
#: rows of candidates that are sent to all executors (16 bytes each) to read their texts; beyond it texts and candidates are shuffled
SENT_ROWS = 1_000_000
#: bytes of an element that a test compares: a chance of one in 10^9 that two sets of 500 seem to share one more
TESTED_BYTES = 6
#: pairs whose sketches are compared at once
COMPARED = 1 << 14
#: classes of one signature in a block, about
BLOCK = 4096
#: bits of the filter of rows that stand for classes: so many for each class, and in all at most
ROW_BITS, MOST_BITS = 8, 1 << 26
#: places of a row in that filter
ROW_PLACES = 3

U64 = np.uint64
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def salt(seed: int) -> np.uint64:
    return mix(np.array([seed + 1], dtype=np.uint64))[0]


#: bytes of text hashed at once; longer words are hashed one by one
SPAN, LONG_WORD = 1 << 18, 256
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))
_BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=None)
def powers(base: int) -> np.ndarray:
    """``base ** 0, base ** 1, ...`` of 64 bits."""
    out = np.full(SPAN + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z as a-z, text after text, and the number of words of each text.

    A word's hash is a polynomial in its bytes, the difference of two running sums over the text, moved to exponent 0.
    """
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    joined = b" ".join(raw).lower() + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    space = np.r_[True, _SPACE[data]]
    starts = np.flatnonzero(space[:-1] & ~space[1:])
    ends = np.flatnonzero(~space[:-1] & space[1:])
    bounds = np.cumsum(np.fromiter((len(r) + 1 for r in raw), dtype=np.int64, count=len(raw)))
    counts = np.diff(np.r_[0, np.searchsorted(starts, bounds)])
    h = np.empty(len(starts), dtype=np.uint64)
    up, down = powers(_BASE), powers(pow(_BASE, -1, 1 << 64))
    first = 0
    while first < len(starts):
        origin = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, origin + SPAN, side="right")))
        s, e = starts[first:last] - origin, np.minimum(ends[first:last] - origin, SPAN)
        part = _BYTES[data[origin : origin + e[-1]]]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        h[first:last] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        first = last
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        h[i] = xxhash.xxh3_64_intdigest(joined[starts[i] : ends[i]])
    return h, counts


def shingle_sets(texts: list[str], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sets of the texts as sorted distinct hashes, one set after the other, and their sizes."""
    h, counts = word_hashes(texts)
    made = np.where(counts > n, counts - n + 1, np.minimum(counts, 1))
    width = np.minimum(counts, n)
    total = np.repeat(width.astype(np.uint64), counts)
    for k in range(n):
        # where a shingle would run over the end of its text, it is left out below
        full = np.repeat(width > k, counts)[: max(0, len(h) - k)]
        total[: len(full)] += np.where(full, h[k:] * ODD[k], U64(0))
    kept = np.arange(len(h)) - np.repeat(np.cumsum(counts) - counts, counts) < np.repeat(made, counts)
    elements = mix(total[kept])
    stops = np.cumsum(made)
    for start, stop in zip((stops - made).tolist(), stops.tolist()):
        elements[start:stop].sort()
    new = np.ones(len(elements), dtype=bool)
    new[1:] = elements[1:] != elements[:-1]
    new[(stops - made)[made > 0]] = True
    owner = np.repeat(np.arange(len(texts)), made)[new]
    return elements[new], np.bincount(owner, minlength=len(texts))


@lru_cache(maxsize=None)
def band_start(number: int) -> int:
    if number == 0:
        return 1
    before = band_start(number - 1)
    return max(before + 1, int(before * BAND))


def band_of(size: int) -> int:
    number = 0
    while band_start(number + 1) <= size:
        number += 1
    return number


def more_than(t: int, n: int, p: float) -> float:
    """Chance of more than t hits in n trials, about."""
    return 0.5 * erfc((t + 0.5 - n * p) / sqrt(2 * n * p * (1 - p)))


@lru_cache(maxsize=None)
def parts_of(band: int) -> tuple[int, int]:
    """Number of parts of the domain in a band (0: similar sets are equal), and the spare agreements t.

    More spare parts leave fewer sets unlucky, but make all parts thinner; the t with the fewest signatures in all is taken.
    """
    least, most = band_start(band), band_start(band + 1) - 1
    k = most // 4
    if k == 0:
        return 0, 0
    best = (np.inf, 0, 0)
    for spare in range(1 + k):
        n = k // 2 + 1 + spare
        each = least / n
        # no element at all, or all in one sub-part
        thin = np.exp(-each) + SUB * np.exp(-each * (SUB - 1) / SUB) * (1 - np.exp(-each / SUB))
        unlucky = more_than(spare, n, thin)
        # sets that are unlucky in all partitions sign empty subsets, which many share
        best = min(best, (n * (1 + unlucky + unlucky**2 + 100 * unlucky**SEEDS), n, spare))
        if spare > 3 * n * thin + 20:
            break
    return best[1], best[2]


@lru_cache(maxsize=4096)
def bands_of(size: int) -> tuple[int, ...]:
    """The bands in which a set of this size meets partners: its own, and lower ones that reach 0.8 of its size."""
    own = band_of(size)
    found = [own]
    while found[-1] > 0 and 5 * (band_start(found[-1]) - 1) >= 4 * size:
        found.append(found[-1] - 1)
    return tuple(found)


def sign(elements: np.ndarray, sizes: np.ndarray, bands: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures, and the place of the set each belongs to, of sets that are not empty (``elements`` one after the other)."""
    shape = np.array([parts_of(int(b)) for b in bands], dtype=np.int64).reshape(-1, 2)
    parts, spare = shape[:, 0], shape[:, 1]
    hashed = mix(elements ^ salt(seed))
    offset = np.cumsum(parts) - parts
    part = (hashed % np.repeat(np.maximum(parts, 1), sizes).astype(np.uint64)).astype(np.int64)
    sub = ((hashed >> U64(40)) % U64(SUB)).astype(np.int64)
    place = (part + np.repeat(offset, sizes)) * SUB + sub
    total = int(parts.sum())
    # sums of 64-bit numbers by place: floats would round them, so the halves are added apart
    scrambled = mix(hashed)
    low = np.bincount(place, weights=(scrambled & U64(0xFFFFFFFF)).astype(np.float64), minlength=total * SUB).astype(np.uint64)
    high = np.bincount(place, weights=(scrambled >> U64(32)).astype(np.float64), minlength=total * SUB).astype(np.uint64)
    sums = (low + (high << U64(32))).reshape(total, SUB)
    found = np.bincount(place, minlength=total * SUB).reshape(total, SUB)
    subsets = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
    filled = found.sum(axis=1)[:, None] > found
    owner = np.repeat(np.arange(len(sizes)), parts)
    number = np.arange(total) - np.repeat(offset, parts)
    name = np.repeat(bands, parts).astype(np.uint64) * ODD[0] + number.astype(np.uint64) * ODD[1] + U64(seed)
    names = name[:, None] + np.arange(SUB, dtype=np.uint64)[None, :] * ODD[2]
    thin = np.bincount(owner, weights=~filled.all(axis=1), minlength=len(sizes))
    unlucky = np.flatnonzero(thin > spare)
    shown = filled
    out = []
    if len(unlucky):
        if seed + 1 < SEEDS:
            chosen = np.isin(np.repeat(np.arange(len(sizes)), sizes), unlucky)
            more, of = sign(elements[chosen], sizes[unlucky], bands[unlucky], seed + 1)
            out.append((more, unlucky[of]))
        else:
            shown = filled | np.isin(owner, unlucky)[:, None]
    # 48 bits: a signature shared by chance is one candidate more
    out.append((mix(subsets + names)[shown] >> U64(16), np.repeat(owner, SUB).reshape(total, SUB)[shown]))
    return np.concatenate([x for x, _ in out]), np.concatenate([o for _, o in out])


def class_numbers(elements: np.ndarray, sizes: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set."""
    full = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[full]

    def sums(k: int) -> np.ndarray:
        out = np.zeros(len(sizes), dtype=np.uint64)
        if len(starts):
            out[full] = np.add.reduceat(mix(elements ^ salt(1000 + 2 * seed + k)), starts)
        return out.view(np.int64)

    return sums(0), sums(1)


def sketch(s: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parities of the numbers of elements by their remainder."""
    return np.packbits((np.bincount((s & U64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_bits(size: int) -> int:
    """Width of the sketch that a pair is compared by: a power of two, no less than the set's size."""
    return max(SKETCH_BITS, 1 << (size - 1).bit_length())


def may_be_similar(a: bytes, na: int, b: bytes, nb: int) -> bool:
    """Whether sketches of the same elements' parities leave it open that two sets are similar; the wider one is folded."""
    x, y = np.frombuffer(a, dtype=np.uint8), np.frombuffer(b, dtype=np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return 5 * min(na, nb) >= 4 * max(na, nb) and 9 * int(np.bitwise_count(x ^ y).sum()) <= na + nb


def numbered(slim: DataFrame, seed: int) -> DataFrame:
    """``doc_id row n_shingles cls check`` of each document (``doc_id row _t``)."""
    kind, id_arrow = slim.schema["doc_id"].dataType.simpleString(), arrow_type(slim, "doc_id")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for rows, texts in blocks(batches, "_t"):
            elements, sizes = shingle_sets(texts)
            cls, check = class_numbers(elements, sizes, seed)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], type=id_arrow), pa.array([r[1] for r in rows], type=pa.int64()), pa.array(sizes), pa.array(cls), pa.array(check)],
                names=["doc_id", "row", "n_shingles", "cls", "check"],
            )

    return slim.mapInArrow(run, f"doc_id {kind}, row bigint, n_shingles bigint, cls bigint, check bigint")


def row_filter(classes: DataFrame) -> np.ndarray:
    """A Bloom filter, as words of 64 bits, of the rows of the classes (``cls row``); the driver holds no more than its bits."""
    bits = min(MOST_BITS, max(64, 1 << (ROW_BITS * classes.count() - 1).bit_length()))
    places = F.array(*[F.expr(f"((row & 4294967295L) + {k}L * (shiftrightunsigned(row, 32) | 1L)) & {bits - 1}L") for k in range(ROW_PLACES)])
    words = classes.select(F.explode(places).alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(p & 63L as int))")).alias("set")
    ).toArrow()
    out = np.zeros(bits // 64, dtype=np.uint64)
    out[words.column("word").to_numpy()] = words.column("set").to_numpy().view(np.uint64)
    return out


def may_stand(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Which rows may be in the filter: all that are, and a few others."""
    r = rows.view(np.uint64)
    good = np.ones(len(r), dtype=bool)
    for k in range(ROW_PLACES):
        p = ((r & U64(0xFFFFFFFF)) + U64(k) * ((r >> U64(32)) | U64(1))) & U64(64 * len(words) - 1)
        good &= (words[p >> U64(6)] >> (p & U64(63))) & U64(1) == 1
    return good


def signatures(slim: DataFrame, classes: DataFrame, seed: int) -> DataFrame:
    """``sig cls`` of the classes (``cls row``). A class is signed from its row, and seldom from others too; a task signs it once."""
    standing = slim.sparkSession.sparkContext.broadcast(row_filter(classes))

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen = set()
        needed = (b.filter(pa.array(may_stand(b.column("row").to_numpy(), standing.value))) for b in batches)
        for _, texts in blocks(needed, "_t"):
            elements, sizes = shingle_sets(texts)
            cls = class_numbers(elements, sizes, seed)[0]
            new = []
            for i, c in enumerate(cls.tolist()):
                if sizes[i] and c not in seen:
                    seen.add(c)
                    new.append(i)
            bands = {i: bands_of(int(sizes[i])) for i in new}
            owner = np.repeat(np.arange(len(sizes)), sizes)
            for turn in range(max(map(len, bands.values()), default=0)):
                own = np.array([i for i in new if len(bands[i]) > turn and parts_of(bands[i][turn])[0]], dtype=np.int64)
                if len(own):
                    chosen = np.zeros(len(sizes), dtype=bool)
                    chosen[own] = True
                    sig, of = sign(elements[chosen[owner]], sizes[own], np.array([bands[i][turn] for i in own.tolist()]), 0)
                    yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(cls[own][of])], names=["sig", "cls"])

    return slim.select("row", "_t").mapInArrow(run, "sig bigint, cls bigint")


def shared(signed: DataFrame) -> DataFrame:
    """``sig cls centre`` for signatures of two classes and more: each class but the least, with the least.

    Rows come sorted, so a signature is a run; only its first class is remembered, however long it is.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        last_sig = last_cls = centre = None
        for batch in batches:
            sig, cls = batch.column("sig").to_numpy(), batch.column("cls").to_numpy()
            if not len(sig):
                continue
            first = np.r_[last_sig is None or sig[0] != last_sig, sig[1:] != sig[:-1]]
            twice = ~first & (cls == np.r_[cls[0] if last_cls is None else last_cls, cls[:-1]])
            at = np.maximum.accumulate(np.where(first, np.arange(len(sig)), -1))
            least = np.where(at >= 0, cls[at], centre if centre is not None else 0)
            out = ~first & ~twice & (cls != least)
            last_sig, last_cls, centre = sig[-1], cls[-1], least[-1]
            yield pa.RecordBatch.from_arrays([pa.array(sig[out]), pa.array(cls[out]), pa.array(least[out])], names=["sig", "cls", "centre"])

    return signed.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(run, "sig bigint, cls bigint, centre bigint")


def read_sets(slim: DataFrame, wanted: DataFrame, seed: int, give: dict[str, tuple[pa.DataType, str, object]]) -> DataFrame:
    """``cls`` and what ``give`` makes of its elements, for classes ``cls row``; each is read from the row that stands for it."""
    side = F.broadcast(wanted) if wanted.count() <= SENT_ROWS else wanted.hint("shuffle_hash")
    texts = slim.join(side, "row").select("cls", "_t")

    def run(batches) -> Iterator[pa.RecordBatch]:
        seen = set()
        for rows, found in blocks(batches, "_t"):
            elements, sizes = shingle_sets(found)
            own = class_numbers(elements, sizes, seed)[0].tolist()
            kept, sets = [], []
            # rows may be repeated, and a row's number may stand for two rows
            for (c,), s, o in zip(rows, np.split(elements, np.cumsum(sizes)[:-1]), own):
                if c == o and c not in seen:
                    seen.add(c)
                    kept.append(c)
                    sets.append(s)
            columns = [pa.array([make(s) for s in sets], type=kind) for kind, _, make in give.values()]
            yield pa.RecordBatch.from_arrays([pa.array(kept, type=pa.int64()), *columns], names=["cls", *give])

    return texts.mapInArrow(run, ", ".join(["cls bigint", *[f"{name} {kind}" for name, (_, kind, _) in give.items()]]))


def sketches(slim: DataFrame, wanted: DataFrame, seed: int) -> DataFrame:
    """``cls row size narrow wide`` of the wanted classes (``cls row``)."""
    give = {
        "size": (pa.int64(), "bigint", len), "narrow": (pa.binary(), "binary", sketch),
        "wide": (pa.binary(), "binary", lambda s: sketch(s, wide_bits(len(s)))),
    }
    return read_sets(slim, wanted, seed, give).join(wanted, "cls")


def packed(s: np.ndarray) -> bytes:
    """The leading ``TESTED_BYTES`` of each element, in order."""
    return np.ascontiguousarray(s.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :TESTED_BYTES]).tobytes()


def unpacked(b) -> np.ndarray:
    full = np.zeros((len(b) // TESTED_BYTES, 8), dtype=np.uint8)
    full[:, :TESTED_BYTES] = np.frombuffer(b, dtype=np.uint8).reshape(-1, TESTED_BYTES)
    return full.view(">u8").ravel().astype(np.uint64)


def similar(pairs: DataFrame, sets: DataFrame, slim: DataFrame, seed: int) -> DataFrame:
    """Links ``a b``: those of the pairs ``x y`` of classes whose whole sets are similar.

    Elements are read and sent for the classes of those pairs only that their sketches leave open.
    """
    narrow = sets.select("cls", "size", "wide")
    both = pairs.join(narrow.toDF("x", "na", "wa"), "x").join(narrow.toDF("y", "nb", "wb"), "y").filter("5 * least(na, nb) >= 4 * greatest(na, nb)")

    def open_pairs(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wa, na, wb, nb = (batch.column(c).to_pylist() for c in ("wa", "na", "wb", "nb"))
            good = pa.array([may_be_similar(*p) for p in zip(wa, na, wb, nb)], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(good) for c in ("x", "y")], names=["x", "y"])

    left = cut_lineage(both.select("x", "y", "wa", "na", "wb", "nb").mapInArrow(open_pairs, "x bigint, y bigint"))
    met = left.select(F.col("x").alias("cls")).unionByName(left.select(F.col("y").alias("cls"))).distinct()
    wanted = cut_lineage(sets.select("cls", "row").join(met, "cls"))
    whole = read_sets(slim, wanted, seed, {"elements": (pa.binary(), "binary", packed)})
    sent = left.join(whole.toDF("y", "eb"), "y").join(whole.toDF("x", "ea"), "x").select("x", "y", "ea", "eb")

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                p, q = (unpacked(batch.column(c)[i].as_buffer()) for c in ("ea", "eb"))
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= 80 * (len(p) + len(q) - common))
            kept = pa.array(good, type=pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x").filter(kept), batch.column("y").filter(kept)], names=["a", "b"])

    return sent.mapInArrow(run, "a bigint, b bigint")


def near(x: np.ndarray, y: np.ndarray, size: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which pairs of places the sizes and the parity bits leave open."""
    n, m = size[x], size[y]
    good = 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)
    at = np.flatnonzero(good)
    for i in range(0, len(at), COMPARED):
        k = at[i : i + COMPARED]
        good[k] = 9 * np.bitwise_count(bits[x[k]] ^ bits[y[k]]).sum(axis=1, dtype=np.int64) <= n[k] + m[k]
    return good


def pairs_in(stop: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in the same run, the pairs of neighbours of all runs first (``stop``: behind each place's run)."""
    x, apart = np.arange(len(stop)), 1
    while True:
        x = x[x + apart < stop[x]]
        if not len(x):
            return
        yield x, x + apart
        apart += 1


def runs(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    new = np.zeros(max(0, len(keys[0]) - 1), dtype=bool)
    for k in keys:
        new |= k[1:] != k[:-1]
    edges = np.flatnonzero(np.r_[True, new, True]).tolist()
    return list(zip(edges[:-1], edges[1:]))


def by_runs(batches, keys: tuple[str, ...], use) -> Iterator[pa.RecordBatch]:
    """``use`` of tables of sorted rows that hold whole runs of equal keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        # the last run may go on in the next batch
        cut = runs(*[table.column(k).to_numpy() for k in keys])[-1][0]
        if cut:
            yield from use(table.slice(0, cut))
            held = table.slice(cut).to_batches()
    if held:
        yield from use(pa.Table.from_batches(held))


def root_of(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def run_ends(*keys: np.ndarray) -> np.ndarray:
    """For each row the place behind its run of equal keys."""
    edges = np.array(runs(*keys), dtype=np.int64).reshape(-1, 2)
    return np.repeat(edges[:, 1], edges[:, 1] - edges[:, 0])


def proposed(rows: DataFrame) -> DataFrame:
    """``sig x y``: pairs of classes that would join the components of each signature (``sig chunk cls grp size narrow``).

    A signature without such a pair has no two similar classes in different components, now or later.
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        def pairs_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            sig, chunk, cls, grp, size = (table.column(c).to_numpy() for c in ("sig", "chunk", "cls", "grp", "size"))
            bits = np.frombuffer(b"".join(table.column("narrow").to_pylist()), dtype=np.uint64).reshape(len(sig), -1)
            stop = run_ends(sig, chunk)
            # components of each run by number, joined as the pairs would join them
            order = np.lexsort((grp, stop))
            new = np.r_[True, (grp[order][1:] != grp[order][:-1]) | (stop[order][1:] != stop[order][:-1])]
            node = np.empty(len(sig), dtype=np.int64)
            node[order] = np.cumsum(new) - 1
            parent, label = list(range(int(new.sum()))), np.arange(int(new.sum()))
            found: list[tuple[int, int]] = []
            for x, y in pairs_in(stop):
                apart = label[node[x]] != label[node[y]]
                x, y = x[apart], y[apart]
                good = near(x, y, size, bits)
                before = len(found)
                for i, j in zip(x[good].tolist(), y[good].tolist()):
                    p, q = root_of(parent, int(node[i])), root_of(parent, int(node[j]))
                    if p != q:
                        parent[max(p, q)] = min(p, q)
                        found.append((i, j))
                if len(found) > before:
                    label = np.array(parent)
                    while (label != label[label]).any():
                        label = label[label]
            if found:
                i, j = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(sig[i]), pa.array(np.minimum(cls[i], cls[j])), pa.array(np.maximum(cls[i], cls[j]))], names=["sig", "x", "y"])

        yield from by_runs(batches, ("sig", "chunk"), pairs_of)

    keys = ("sig", "chunk")
    return rows.repartition(*keys).sortWithinPartitions(*keys, "cls").mapInArrow(run, "sig bigint, x bigint, y bigint")


def all_pairs(rows: DataFrame) -> DataFrame:
    """Pairs ``x y`` of classes in different components of a signature that sketches leave open (``sig i j first cls grp size narrow``).

    A run of ``sig i j`` holds two blocks, told by ``first``, or one (i = j).
    """

    def run(batches) -> Iterator[pa.RecordBatch]:
        def pairs_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            sig, i, j, cls, grp, size = (table.column(c).to_numpy() for c in ("sig", "i", "j", "cls", "grp", "size"))
            first, alone = table.column("first").to_numpy(), i == j
            bits = np.frombuffer(b"".join(table.column("narrow").to_pylist()), dtype=np.uint64).reshape(len(sig), -1)
            for x, y in pairs_in(run_ends(sig, i, j)):
                asked = (grp[x] != grp[y]) & (alone[x] | (first[x] != first[y]))
                x, y = x[asked], y[asked]
                good = near(x, y, size, bits)
                p, q = cls[x[good]], cls[y[good]]
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q))], names=["x", "y"])

        yield from by_runs(batches, ("sig", "i", "j"), pairs_of)

    keys = ("sig", "i", "j")
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "x bigint, y bigint").distinct()


def dealt(members: DataFrame) -> DataFrame:
    """Rows ``sig i j first cls grp`` of open signatures, copied to the block pairs in which they are compared (``sig cls grp``).

    Blocks 0, 1, ... hold the classes outside the signature's largest component, blocks -1, -2, ... those inside.
    """
    parts = cut_lineage(members.groupBy("sig", "grp").agg(F.count("*").alias("n")))
    shape = parts.groupBy("sig").agg(F.max_by("grp", F.struct("n", "grp")).alias("main"), F.max("n").alias("inside"), F.sum("n").alias("n"))
    shape = cut_lineage(shape.select(
        "sig", "main", F.ceil(F.col("inside") / BLOCK).cast("int").alias("ib"), F.ceil((F.col("n") - F.col("inside")) / BLOCK).cast("int").alias("ob")
    ).filter("ob > 0"))
    own = members.join(shape, "sig").withColumn("h", F.xxhash64("cls"))
    outside = own.filter("grp <> main").withColumn("own", F.pmod("h", "ob").cast("int"))
    with_each_other = outside.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ob") - 1))).select(
        "sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("first"), "cls", "grp"
    )
    with_inside = outside.withColumn("other", F.explode(F.sequence(F.lit(1), F.col("ib")))).select(
        "sig", (-F.col("other")).alias("i"), F.col("own").alias("j"), F.lit(False).alias("first"), "cls", "grp"
    )
    inside = own.filter("grp = main").withColumn("own", F.pmod("h", "ib").cast("int") + 1).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("ob") - 1))).select(
        "sig", (-F.col("own")).alias("i"), F.col("other").alias("j"), F.lit(True).alias("first"), "cls", "grp"
    )
    return with_each_other.unionByName(with_inside).unionByName(inside)


def open_members(members: DataFrame, named: DataFrame) -> DataFrame:
    """``sig cls grp`` of the members ``sig cls`` of signatures whose classes (``cls grp``) lie in several components."""
    rows = cut_lineage(members.join(named, "cls"))
    several = rows.groupBy("sig").agg(F.min("grp").alias("low"), F.max("grp").alias("high")).filter("low <> high").select("sig")
    return cut_lineage(rows.join(several, "sig", "left_semi"))


def joined_by(found: DataFrame, named: DataFrame) -> DataFrame:
    """``cls grp`` with the components that the links ``a b`` between classes join."""
    links = found.join(named.toDF("a", "ga"), "a").join(named.toDF("b", "gb"), "b").filter("ga <> gb").select(F.col("ga").alias("a"), F.col("gb").alias("b"))
    root = components(links).withColumnRenamed("node", "grp")
    return cut_lineage(named.join(root, "grp", "left").select("cls", F.coalesce("root", "grp").alias("grp")))


def class_components(slim: DataFrame, classes: DataFrame, seed: int) -> DataFrame:
    """``cls grp``: the component of each class (``cls row``) that shares a signature with another."""
    groups = cut_lineage(shared(signatures(slim, classes, seed)))
    members = groups.select("sig", "cls").unionByName(groups.select("sig", F.col("centre").alias("cls")).distinct())
    sets = cut_lineage(sketches(slim, cut_lineage(classes.join(members.select("cls").distinct(), "cls").select("cls", "row")), seed))
    # a class whose row is there twice may be there twice
    narrow = sets.select("cls", "size", "narrow")
    pairs = groups.groupBy(F.col("centre").alias("x"), F.col("cls").alias("y")).agg(F.count("*").alias("n"))
    tested = cut_lineage(pairs.groupBy("y").agg(F.max_by("x", F.struct("n", "x")).alias("x")).select("x", "y"))
    named = joined_by(cut_lineage(similar(tested, sets, slim, seed)), sets.select("cls").distinct().select("cls", F.col("cls").alias("grp")))
    while True:
        left = open_members(members, named)
        size = left.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
        chunked = left.join(size, "sig").withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(seed)), "chunks").cast("int"))
        asked = cut_lineage(proposed(chunked.select("sig", "chunk", "cls", "grp").join(narrow, "cls")))
        # the others are settled for good, but for those of several chunks, which have not met
        still = asked.select("sig").unionByName(size.filter("chunks > 1").select("sig")).distinct()
        left = cut_lineage(left.join(still, "sig", "left_semi"))
        members = left.select("sig", "cls")
        new = cut_lineage(asked.select("x", "y").distinct().join(tested, ["x", "y"], "left_anti"))
        links = cut_lineage(similar(new, sets, slim, seed))
        tested, number = tested.unionByName(new), links.count()
        if number:
            named = joined_by(links, named)
        if 2 * number <= new.count():
            break
    if number:
        left = open_members(members, named)
    if left.isEmpty():
        return named
    rest = cut_lineage(all_pairs(dealt(left).join(narrow, "cls")).join(tested, ["x", "y"], "left_anti"))
    return named if rest.isEmpty() else joined_by(cut_lineage(similar(rest, sets, slim, seed)), named)


def grouped(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """``doc_id row n_shingles cls root component_id`` of every row; the root is null for empty sets."""
    slim = docs.select(column(docs, id_).alias("doc_id"), F.xxhash64(column(docs, id_), column(docs, text)).alias("row"), column(docs, text).alias("_t"))
    seed = 0
    while True:
        table = cut_lineage(numbered(slim, seed))
        some = table.filter("n_shingles > 0")
        classes = cut_lineage(some.groupBy("cls").agg(
            F.min("doc_id").alias("node"), F.min("row").alias("row"), F.struct(F.min("check").alias("c"), F.min("n_shingles").alias("n")).alias("low"),
            F.struct(F.max("check").alias("c"), F.max("n_shingles").alias("n")).alias("high")))
        if classes.filter("low <> high").isEmpty():
            break
        seed += 1
    grp = class_components(slim, classes.select("cls", "row"), seed)
    named = cut_lineage(classes.join(grp, "cls", "left").select("cls", F.coalesce("grp", "cls").alias("root"), "node"))
    least = named.groupBy("root").agg(F.min("node").alias("component_id"))
    of_class = named.select("cls", "root").join(least, "root")
    return table.join(of_class, "cls", "left").select(
        "doc_id", "row", "n_shingles", "cls", F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"),
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def near_groups(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id n_shingles component_id`` of every document."""
    return grouped(docs, id_, text).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component, all columns as they were: the one with the smallest identifier.

    Rows without identifier come after those with one; of several texts of the smallest identifier the one with the smallest hash stays.
    Rows that are equal in identifier and text are one document here: all of them stay or none. Documents with an empty set stay.
    """
    rows = cut_lineage(grouped(docs, id_, text))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")
    first = rows.filter("root is not null").groupBy("root").agg(F.min(order).alias("kept"))
    gone_row, gone_id = spare(docs, "_gone_row", "_gone_id")
    gone = rows.join(first, "root").filter(F.col("row") != F.col("kept.row")).select(F.col("row").alias(gone_row), F.col("doc_id").alias(gone_id)).distinct()
    same = (F.xxhash64(column(docs, id_), column(docs, text)) == F.col(gone_row)) & column(docs, id_).eqNullSafe(F.col(gone_id))
    return docs.join(gone.hint("shuffle_hash"), same, "left_anti")
