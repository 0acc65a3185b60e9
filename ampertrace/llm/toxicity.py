"""Toxicity by non-negative positive-unlabelled learning.

Nothing is known of a document without the label "toxic": it may be clean, or nobody has looked. So the classifiers learn from
confirmed toxic examples and from unlabelled text that holds toxic documents at the rate of the class prior p. The risk is

    p * L(toxic examples, 1) + max(0, L(unlabelled, 0) - p * L(toxic examples, 0))

with the logistic loss L: the toxic part that hides in the unlabelled text is subtracted, and where a batch makes the
bracket negative, which only a classifier can do that learns its examples by heart, the step goes the other way.

A document is the set of its features: words in lower case and beginnings of words, hashed to ``BUCKETS``. Only telling
features have a weight: those whose rate among toxic examples exceeds their rate in unlabelled text by ``TELLING`` standard
errors. ``MEMBERS`` linear classifiers learn from different shares of the sample; their mean logit is the score. The prior is the
share of toxic ones among the labels that may be learned from, which a caller can replace.

At most ``POSITIVES`` toxic and ``UNLABELLED`` other documents are learned from; all documents are counted to draw them evenly, and
each is scored on its whole text. The driver gets the feature numbers of the drawn documents only.

Defined results: null and empty texts have no features and get the score of that. Without toxic labels every score is 0; if all
labels are toxic it is 1. Repeated rows get the same score; of several labels of a document the largest counts, null labels do
not. A table without rows gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.llm.arrays import column
from ampertrace.llm.codes import MOST_CODES, arrow_type, blocks, ranges

BUCKETS = 1 << 18
#: lengths of the beginnings of words that are features
BEGINNINGS = (4, 5)
#: documents that are learned from, at most
POSITIVES = 6_000
UNLABELLED = 12_000
TELLING = 4.0
MEMBERS = 3
EPOCHS = 200
BATCH = 16_384
#: length of the step back against that of a step forward
BACK = 0.1
RATE = 0.05
SHRINK = 1e-3
THRESHOLD = 0.3
WORD = re.compile(r"[^\W\d_]+")


class WordFeatures(dict):
    """Features of each word: all, or those that ``useful`` marks."""

    def __init__(self, useful: np.ndarray | None = None):
        self.useful = useful

    def __missing__(self, word: str) -> tuple[int, ...]:
        forms = [word, *[f"^{word[:n]}{n}" for n in BEGINNINGS]]
        found = [xxhash.xxh3_64_intdigest(f.encode("utf-8", "surrogatepass")) % BUCKETS for f in forms]
        self[word] = kept = tuple(f for f in found if self.useful is None or self.useful[f])
        return kept


def features(texts: list[str], known: WordFeatures) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, one text after the other, and their number."""
    if len(known) > MOST_CODES:
        known.clear()
    sets = [set().union(*map(known.__getitem__, set(WORD.findall(t.lower())))) for t in texts]
    counts = np.fromiter(map(len, sets), dtype=np.int64, count=len(sets))
    return np.fromiter((f for s in sets for f in sorted(s)), dtype=np.int64, count=int(counts.sum())), counts


@dataclass
class Classifier:
    """A linear score of feature sets: ``bias`` plus the weights of the features there are."""

    weights: np.ndarray
    bias: float

    def logits(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(len(counts))
        full = counts > 0
        if full.any():
            total[full] = np.add.reduceat(self.weights[found], (np.cumsum(counts) - counts)[full])
        return total + self.bias

    def score(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        # numpy's exp over arrays differs in the last bit between processors
        return np.array([1 / (1 + math.exp(-z)) for z in np.clip(self.logits(found, counts), -40, 40).tolist()], dtype=np.float64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk_gradient(logits: np.ndarray, positive: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of a batch and its gradient by the logits (or that of the step back)."""
    n_p, n_u = max(1, positive.sum()), max(1, (~positive).sum())
    as_clean, as_toxic = np.logaddexp(0, logits), np.logaddexp(0, -logits)
    toxic = prior * as_toxic[positive].sum() / n_p
    clean = as_clean[~positive].sum() / n_u - prior * as_clean[positive].sum() / n_p
    p = sigmoid(logits)
    of_clean = np.where(positive, -prior * p / n_p, p / n_u)
    if clean < 0:
        return float(toxic), -BACK * of_clean
    return float(toxic + clean), of_clean + np.where(positive, prior * (p - 1) / n_p, 0)


def part(found: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and numbers of some of the documents."""
    return found[ranges((np.cumsum(counts) - counts)[rows], counts[rows])], counts[rows]


def learn(found: np.ndarray, counts: np.ndarray, positive: np.ndarray, useful: np.ndarray, prior: float, seed: int) -> Classifier:
    """Adam on the risk over batches of toxic and unlabelled documents in proportion; weights shrink by ``SHRINK`` a step."""
    rng = np.random.default_rng(seed)
    w, bias = np.zeros(len(useful)), float(np.log(prior / (1 - prior)))
    m, v, step = np.zeros(len(useful) + 1), np.zeros(len(useful) + 1), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(counts))
        for i in range(0, len(order), BATCH):
            rows, step = order[i : i + BATCH], step + 1
            f, c = part(found, counts, rows)
            _, g = risk_gradient(Classifier(w, bias).logits(f, c), positive[rows], prior)
            grad = np.append(np.bincount(f, weights=np.repeat(g, c), minlength=len(useful)), g.sum())
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
            w = np.sign(w - move[:-1]) * np.maximum(np.abs(w - move[:-1]) - SHRINK, 0)
            bias -= move[-1]
    weights = np.zeros(BUCKETS)
    weights[useful] = w
    return Classifier(weights, float(bias))


def telling(found: np.ndarray, counts: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """The features that are much more frequent in toxic examples than in unlabelled text."""
    of_toxic = np.repeat(positive, counts)
    p, u = positive.sum(), (~positive).sum()
    a, b = np.bincount(found[of_toxic], minlength=BUCKETS) / p, np.bincount(found[~of_toxic], minlength=BUCKETS) / u
    both = (a * p + b * u + 1) / (p + u)
    return np.flatnonzero(a - b > TELLING * np.sqrt(both * (1 - np.minimum(both, 0.999)) * (1 / p + 1 / u)))


def train(found: np.ndarray, counts: np.ndarray, positive: np.ndarray, prior: float) -> Classifier:
    """The mean of ``MEMBERS`` classifiers, each learned from the sample without its own share of it."""
    if not positive.any() or prior <= 0:
        return Classifier(np.zeros(BUCKETS), -np.inf)
    if prior >= 1 or positive.all():
        return Classifier(np.zeros(BUCKETS), np.inf)
    useful = telling(found, counts, positive)
    place = np.full(BUCKETS, -1)
    place[useful] = np.arange(len(useful))
    owner = np.repeat(np.arange(len(counts)), counts)[place[found] >= 0]
    found, counts = place[found][place[found] >= 0], np.bincount(owner, minlength=len(counts))
    share = np.random.default_rng(7).integers(0, MEMBERS + 1, len(counts))
    members = []
    for k in range(MEMBERS):
        rows = np.flatnonzero(share != k)
        if positive[rows].any() and not positive[rows].all():
            members.append(learn(*part(found, counts, rows), positive[rows], useful, prior, k))
    if not members:
        members = [learn(found, counts, positive, useful, prior, 0)]
    return Classifier(np.mean([c.weights for c in members], axis=0), float(np.mean([c.bias for c in members])))


def fold(id_: Column, by: int = 4) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(by))


def feature_rows(drawn: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, their numbers and the mark ``_p`` of the drawn documents (``_p _h _t``), in the order of ``_h``."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = WordFeatures()
        for rows, texts in blocks(batches, "_t"):
            found, counts = features(texts, known)
            ends = np.cumsum(counts)
            lists = [found[e - c : e].astype("<i4").tobytes() for e, c in zip(ends, counts)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], type=pa.int64()), pa.array(lists, type=pa.binary())], names=["_p", "_h", "_f"])

    table = drawn.select("_p", "_h", "_t").mapInArrow(run, "_p boolean, _h bigint, _f binary").toArrow().sort_by([("_h", "ascending"), ("_p", "ascending")])
    lists = [np.frombuffer(b, dtype="<i4") for b in table.column("_f").to_pylist()]
    counts = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.concatenate([np.zeros(0, dtype="<i4"), *lists]).astype(np.int64), counts, np.array(table.column("_p").to_pylist(), dtype=bool)


def fit(
    docs: DataFrame, labels: DataFrame, id_: str = "doc_id", text: str = "text", label: str = "toxic", prior: float | None = None,
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> Classifier:
    """Learn from the documents given: toxic ones by their labels, and an even sample of all as unlabelled text."""
    own = labels.select(column(labels, id_).alias("_id"), column(labels, label).cast("long").alias("_y")).filter("_y is not null and _id is not null")
    own = own.groupBy("_id").agg(F.max("_y").alias("_y"))
    texts = docs.select(column(docs, id_).alias("_id"), column(docs, text).alias("_t"))
    marked = own.agg(F.count("*").alias("n"), F.count_if(F.col("_y") > 0).alias("toxic")).first()
    if prior is None:
        prior = marked["toxic"] / marked["n"] if marked["n"] else 0.0
    if not marked["toxic"]:
        return Classifier(np.zeros(BUCKETS), -np.inf)
    toxic = own.filter("_y > 0").select("_id", F.xxhash64("_id").alias("_r")).orderBy("_r", "_id").limit(positives).select("_id")
    positive = texts.join(F.broadcast(toxic), "_id").select(F.lit(True).alias("_p"), F.xxhash64("_id", "_t").alias("_h"), "_t")
    share = int(1_000_003 * min(1.0, unlabelled / max(1, texts.count())))
    even = texts.select(F.lit(False).alias("_p"), F.xxhash64("_id", "_t", F.lit(1)).alias("_h"), "_t").filter(F.pmod(F.col("_h"), F.lit(1_000_003)) < share)
    return train(*feature_rows(positive.unionByName(even)), prior)


def score_documents(docs: DataFrame, model: Classifier, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id score`` of every document; only the text is looked at."""
    slim = docs.select(column(docs, id_).alias("doc_id"), column(docs, text).alias("_t"))
    kind, id_arrow = slim.schema["doc_id"].dataType.simpleString(), arrow_type(slim, "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches) -> Iterator[pa.RecordBatch]:
        known = WordFeatures(sent.value.weights != 0)
        for rows, texts in blocks(batches, "_t"):
            score = sent.value.score(*features(texts, known))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=id_arrow), pa.array(score)], names=["doc_id", "score"])

    return slim.mapInArrow(run, f"doc_id {kind}, score double")
