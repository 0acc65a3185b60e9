"""Quality classifier on random-indexing word vectors.

Each of ``BUCKETS`` hash buckets of words has a fixed sparse index vector of a few +1 and -1. The context vector of a
word is the sum of the index vectors of its neighbours over the whole corpus: tasks add up integers in an array of fixed
size, Spark sums these by bucket, and the result, whose size does not depend on the corpus, is broadcast. Words are
runs of letters in lower case, runs of symbols, and one word each for numbers and for words in capitals.

A document is pooled to the mean of its words' vectors and the mean distance of neighbouring ones. A network of two
layers is trained in numpy on the pooled vectors of a bounded sample of labelled documents; a part of the sample that it
does not learn from calibrates its temperature.

Defined results: null and empty texts are pooled to zeros and get the score of that. Without labels of both kinds every
score is the share of good labels, 0.5 if there are none. Repeated rows get the same result; of several labels of a document the largest counts. A
table without rows gives none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.llm.arrays import column
from ampertrace.llm.codes import MOST_CODES, arrow_type, blocks

BUCKETS = 1 << 14
DIMENSIONS = 32
ENTRIES = 4
REACH = 2
#: labelled documents that the network learns from, at most
SAMPLE = 20_000
HIDDEN = 16
EPOCHS = 60
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class WordBuckets(dict):
    def __missing__(self, word: str) -> int:
        if word.isdigit():
            shape = "0"
        elif len(word) > 1 and word.isupper():
            shape = "AA"
        else:
            shape = word.lower()
        self[word] = bucket = xxhash.xxh3_64_intdigest(shape.encode("utf-8", "surrogatepass")) % BUCKETS
        return bucket


def word_buckets(texts: list[str], known: WordBuckets) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, text after text, and the number of words of each text."""
    if len(known) > MOST_CODES:
        known.clear()
    words: list[str] = []
    ends = []
    for t in texts:
        words += WORD.findall(t)
        ends.append(len(words))
    return np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words)), np.diff(np.r_[0, ends])


def index_vectors(seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each bucket's index vector."""
    rng = np.random.default_rng(seed)
    return rng.permuted(np.tile(np.arange(DIMENSIONS), (BUCKETS, 1)), axis=1)[:, :ENTRIES], rng.choice([-1, 1], (BUCKETS, ENTRIES))


def context_sums(slim: DataFrame) -> DataFrame:
    """``bucket v0 v1 ...``: whole numbers, so the order of addition does not matter."""
    names = [f"v{i}" for i in range(DIMENSIONS)]

    def run(batches) -> Iterator[pa.RecordBatch]:
        known, (places, signs) = WordBuckets(), index_vectors()
        sums = np.zeros(BUCKETS * DIMENSIONS, dtype=np.int64)
        for _, texts in blocks(batches, "_t"):
            bucket, counts = word_buckets(texts, known)
            text = np.repeat(np.arange(len(counts)), counts)
            for far in range(1, REACH + 1):
                same = text[:-far] == text[far:]
                a, b = bucket[:-far][same], bucket[far:][same]
                for word, neighbour in ((a, b), (b, a)):
                    at = word.astype(np.int64) * DIMENSIONS
                    for k in range(ENTRIES):
                        np.add.at(sums, at + places[neighbour, k], signs[neighbour, k])
        table = sums.reshape(BUCKETS, DIMENSIONS)
        met = np.flatnonzero(table.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(met), *[pa.array(np.ascontiguousarray(table[met, i])) for i in range(DIMENSIONS)]], names=["bucket", *names])

    partial = slim.select("_t").mapInArrow(run, ", ".join(["bucket bigint", *[f"{n} bigint" for n in names]]))
    return partial.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])


def word_vectors(slim: DataFrame) -> np.ndarray:
    """Context vectors of unit length; at most ``BUCKETS`` rows reach the driver."""
    rows = context_sums(slim).toPandas()
    table = np.zeros((BUCKETS, DIMENSIONS))
    table[rows["bucket"].to_numpy()] = rows.drop(columns="bucket").to_numpy()
    return (table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(vectors: np.ndarray, texts: list[str], known: WordBuckets) -> np.ndarray:
    """Mean vector and mean absolute difference of neighbours (text, 2 * DIMENSIONS)."""
    bucket, counts = word_buckets(texts, known)
    out = np.zeros((len(texts), 2 * DIMENSIONS))
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    starts = (np.cumsum(counts) - counts)[full]
    v = vectors[bucket]
    out[full, :DIMENSIONS] = np.add.reduceat(v, starts, axis=0) / counts[full, None]
    apart = np.zeros_like(v)
    np.abs(v[1:] - v[:-1], out=apart[1:])
    apart[starts] = 0
    out[full, DIMENSIONS:] = np.add.reduceat(apart, starts, axis=0) / np.maximum(counts[full, None] - 1, 1)
    return out


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.first + self.first_bias) @ self.second + self.second_bias

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Classifier:
    """Adam with weight decay on four fifths of the rows; the last fifth calibrates the temperature."""
    rng = np.random.default_rng(seed)
    width = x.shape[1]
    if len(set(y.tolist())) < 2:
        share = float(y.mean()) if len(y) else 0.5
        logit = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return Classifier(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), logit, 1.0)
    order = rng.permutation(len(x))
    learn, check = order[len(order) // 5 :], order[: len(order) // 5]
    c = Classifier(
        x[learn].mean(axis=0), x[learn].std(axis=0) + 1e-6, rng.normal(0, 1 / np.sqrt(width), (width, HIDDEN)), np.zeros(HIDDEN),
        rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0, 1.0,
    )
    z = (x - c.mean) / c.scale
    weights = [c.first, c.first_bias, c.second, np.zeros(1)]
    m, v, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    for _ in range(EPOCHS):
        shuffled = rng.permutation(learn)
        for i in range(0, len(shuffled), 128):
            part, step = shuffled[i : i + 128], step + 1
            h = np.tanh(z[part] @ weights[0] + weights[1])
            g = (1 / (1 + np.exp(-np.clip(h @ weights[2] + weights[3], -50, 50))) - y[part]) / len(part)
            g_h = np.outer(g, weights[2]) * (1 - h * h)
            grads = [z[part].T @ g_h + 1e-4 * weights[0], g_h.sum(axis=0), h.T @ g + 1e-4 * weights[2], g.sum(keepdims=True)]
            for k, grad in enumerate(grads):
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.001 * (grad * grad - v[k])
                weights[k] -= 0.005 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    c.second_bias = float(weights[3][0])
    if len(check):
        logits, truth = c.logits(x[check]), y[check]
        grid = np.geomspace(0.25, 8, 60)
        loss = [np.logaddexp(0, np.where(truth == 1, -logits, logits) / t).mean() for t in grid]
        c.temperature = float(grid[int(np.argmin(loss))])
    return c


def fold(id_: Column, by: int = 5) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(by))


def pooled_rows(slim: DataFrame, vectors, extra: list[str]) -> DataFrame:
    """The extra columns and the pooled vector of each row."""
    arrow = [arrow_type(slim, c) for c in extra]
    types = {f.name: f.dataType.simpleString() for f in slim.schema.fields}

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = WordBuckets()
        for rows, texts in blocks(batches, "_t"):
            x = pooled(vectors.value, texts, known)
            yield pa.RecordBatch.from_arrays([*[pa.array(c, type=k) for c, k in zip(zip(*rows), arrow)], pa.array(x.tolist(), type=pa.list_(pa.float64()))], names=[*extra, "_x"])

    return slim.select(*extra, "_t").mapInArrow(run, ", ".join([*[f"{c} {types[c]}" for c in extra], "_x array<double>"]))


def fit(docs: DataFrame, labels: DataFrame, vectors, id_: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Classifier:
    """Learn from the ``sample`` labelled documents with the smallest hashes of their identifiers."""
    own = labels.select(column(labels, id_).alias("_id"), column(labels, label).cast("long").alias("_y")).filter("_y is not null and _id is not null")
    drawn = own.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample)
    texts = docs.select(column(docs, id_).alias("_id"), column(docs, text).alias("_t"))
    rows = pooled_rows(texts.join(F.broadcast(drawn), "_id").select("_y", F.xxhash64("_id", "_t").alias("_h"), "_t"), vectors, ["_y", "_h"]).toPandas()
    rows = rows.sort_values("_h")
    x = np.array(rows["_x"].tolist()).reshape(len(rows), 2 * DIMENSIONS)
    return train(x, (rows["_y"].to_numpy() > 0).astype(float))


def score_documents(docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``doc_id score`` of every document; word vectors come from all texts, the network from the labels given."""
    context = docs.sparkSession.sparkContext
    slim = docs.select(column(docs, id_).alias("doc_id"), column(docs, text).alias("_t"))
    kind, id_arrow = slim.schema["doc_id"].dataType.simpleString(), arrow_type(slim, "doc_id")
    vectors = context.broadcast(word_vectors(slim))
    model = context.broadcast(fit(docs, labels, vectors, id_, text, label))

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = WordBuckets()
        for rows, texts in blocks(batches, "_t"):
            score = model.value.score(pooled(vectors.value, texts, known))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=id_arrow), pa.array(score)], names=["doc_id", "score"])

    return slim.mapInArrow(run, f"doc_id {kind}, score double")
