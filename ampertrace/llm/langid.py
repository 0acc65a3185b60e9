"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on windows of a bounded sample of documents, the same
number for each language at most, with a loss at every position. For prediction each whole text is cut into segments
of ``SEGMENT`` bytes; a pass from the left and one from the right label every position, and the probabilities of the
positions within letters are averaged over the document. The weights have a fixed size and are broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0. Documents without language or identifier
are predicted like others and not learned from. Repeated rows get the same result. Without any document to learn from all are ``und``. A table
without rows gives none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ampertrace.llm.arrays import column
from ampertrace.llm.codes import arrow_type, blocks

UNKNOWN = "und"
HIDDEN = 8
SEGMENT = 128
#: documents of each language, and windows of each document, that the network learns from
SAMPLE_PER_LANGUAGE = 400
WINDOWS = 8
#: bytes of a window; short ones teach the network to decide early, which short texts need
WINDOW = 24
STEPS = 800
BATCH = 256
#: segments that go through the network at once
WIDE = 2048


@dataclass
class Direction:
    """Gates update, reset and candidate, one below the other: ``table[:, byte]`` is what a byte adds, ``inner`` what the state adds."""

    table: np.ndarray
    inner: np.ndarray


@dataclass
class Network:
    languages: list[str]
    directions: tuple[Direction, Direction]
    out: np.ndarray
    bias: np.ndarray


def initial(languages: list[str], hidden: int, rng: np.random.Generator) -> Network:
    def direction() -> Direction:
        return Direction(rng.normal(0, 0.3, (3 * hidden, 256)), rng.normal(0, 1 / np.sqrt(hidden), (3 * hidden, hidden)))

    return Network(languages, (direction(), direction()), rng.normal(0, 0.3, (len(languages), 2 * hidden)), np.zeros((len(languages), 1)))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def forward(d: Direction, x: np.ndarray) -> tuple[np.ndarray, list]:
    """States after each byte of ``x`` (time, batch) and what backpropagation needs."""
    hidden = d.inner.shape[1]
    h = np.zeros((hidden, x.shape[1]))
    states, saved = [], []
    for t in range(len(x)):
        a, u = d.table[:, x[t]], d.inner @ h
        z, r = sigmoid(a[:hidden] + u[:hidden]), sigmoid(a[hidden : 2 * hidden] + u[hidden : 2 * hidden])
        n = np.tanh(a[2 * hidden :] + r * u[2 * hidden :])
        saved.append((h, z, r, n, u[2 * hidden :]))
        h = n + z * (h - n)
        states.append(h)
    return np.array(states), saved


def backward(d: Direction, x: np.ndarray, saved: list, grad_states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the byte table and of the inner weights."""
    g_table, g_inner = np.zeros_like(d.table), np.zeros_like(d.inner)
    hidden = d.inner.shape[1]
    g_h = np.zeros_like(grad_states[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, n, u_n = saved[t]
        g_h = g_h + grad_states[t]
        g_n = g_h * (1 - z) * (1 - n * n)
        g_z = g_h * (h - n) * z * (1 - z)
        g_r = g_n * u_n * r * (1 - r)
        g_in = np.concatenate([g_z, g_r, g_n])
        g_u = np.concatenate([g_z, g_r, g_n * r])
        np.add.at(g_table.T, x[t], g_in.T)
        g_inner += g_u @ h.T
        g_h = g_h * z + d.inner.T @ g_u
    return g_table, g_inner


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], hidden: int = HIDDEN, steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on windows (number, length) of bytes with the number of their language."""
    rng = np.random.default_rng(seed)
    net = initial(languages, hidden, rng)
    weights = [net.directions[0].table, net.directions[0].inner, net.directions[1].table, net.directions[1].inner, net.out, net.bias]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), BATCH)
        x, y = windows[pick].T, labels[pick]
        (left, saved_l), (right, saved_r) = forward(net.directions[0], x), forward(net.directions[1], x[::-1])
        both = np.concatenate([left, right[::-1]], axis=1)
        logits = net.out @ both + net.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[:, y, np.arange(BATCH)] -= 1
        p /= BATCH * len(x)
        g_both = net.out.T @ p
        g_l = backward(net.directions[0], x, saved_l, g_both[:, :hidden])
        g_r = backward(net.directions[1], x[::-1], saved_r, g_both[::-1, hidden:])
        grads = [*g_l, *g_r, np.einsum("tcb,thb->ch", p, both), p.sum(axis=(0, 2))[:, None]]
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


#: stands for what lies behind the end of a text
PAD = 256
#: bytes of letters: A-Z, a-z, and all bytes of characters beyond ASCII
LETTER = np.zeros(257, dtype=np.float32)
LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = 1


class Runner:
    """The network in single precision for many segments at once.

    Each gate has its own unbroken arrays (segment, unit), so that numpy works in long loops. Signs are folded into the
    weights: a gate is 1 / (1 + exp(v)). At ``PAD`` both gates are closed and the candidate is 0, which resets the state.
    """

    def __init__(self, net: Network):
        size = net.directions[0].inner.shape[1]
        self.size, count = size, len(net.languages)
        self.gate_table, self.gate_inner, self.new_table, self.new_inner = [], [], [], []
        for d in net.directions:
            table = np.concatenate([d.table, np.r_[np.full(2 * size, -80.0), np.zeros(size)][:, None]], axis=1).T.astype(np.float32)
            inner = d.inner.T.astype(np.float32)
            self.gate_table.append(np.stack([-table[:, :size], -table[:, size : 2 * size]]))
            self.gate_inner.append(np.stack([-inner[:, :size], -inner[:, size : 2 * size]]))
            self.new_table.append(np.ascontiguousarray(-2 * table[:, 2 * size :]))
            self.new_inner.append(np.ascontiguousarray(-2 * inner[:, 2 * size :]))
        self.out = [np.ascontiguousarray(o.T, dtype=np.float32) for o in (net.out[:, :size], net.out[:, size:])]
        self.bias = net.bias.astype(np.float32).T
        self.ones = np.ones((count, count), dtype=np.float32)
        self.letter = np.repeat(LETTER[:, None], count, axis=1)

    def step(self, k: int, x: np.ndarray, h: np.ndarray) -> np.ndarray:
        gates = np.matmul(h, self.gate_inner[k])
        gates += self.gate_table[k].take(x, axis=1)
        np.exp(gates, out=gates)
        gates += 1
        np.reciprocal(gates, out=gates)
        n = h @ self.new_inner[k]
        n *= gates[1]
        n += self.new_table[k].take(x, axis=0)
        np.exp(n, out=n)
        n += 1
        np.divide(2, n, out=n)
        n -= 1
        h = h - n
        h *= gates[0]
        h += n
        return h

    def position_sums(self, x: np.ndarray) -> np.ndarray:
        """Sums over letter positions of the languages' probabilities (segment, language); ``x`` is (time, segment)."""
        length, width = x.shape
        left = np.empty((length, width, self.size), dtype=np.float32)
        h = np.zeros((width, self.size), dtype=np.float32)
        for t in range(length):
            left[t] = h = self.step(0, x[t], h)
        total = np.zeros((width, len(self.ones)), dtype=np.float32)
        h = np.zeros((width, self.size), dtype=np.float32)
        for t in range(length - 1, -1, -1):
            h = self.step(1, x[t], h)
            p = left[t] @ self.out[0]
            p += h @ self.out[1]
            p += self.bias
            np.exp(p, out=p)
            p /= p @ self.ones
            p *= self.letter.take(x[t], axis=0)
            total += p
        return total


def pooled(runner: Runner, texts: list[str]) -> np.ndarray:
    """Mean probabilities of each text's letter positions (text, language)."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    segments = -(-sizes // SEGMENT)
    owner = np.repeat(np.arange(len(raw)), segments)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(segments) - segments, segments)
    flat = np.frombuffer(b"".join(raw) + bytes(SEGMENT), dtype=np.uint8)
    start = np.repeat(np.cumsum(sizes) - sizes, segments) + number * SEGMENT
    left = np.minimum(SEGMENT, sizes[owner] - number * SEGMENT)
    sums = np.zeros((len(raw), len(runner.ones)))
    places = np.arange(SEGMENT)[:, None]
    with np.errstate(over="ignore"):
        for i in range(0, len(owner), WIDE):
            part = slice(i, i + WIDE)
            x = flat[start[part][None, :] + places].astype(np.intp)
            x[places >= left[part][None, :]] = PAD
            np.add.at(sums, owner[part], runner.position_sums(x))
    return sums / np.maximum(sums.sum(axis=1, keepdims=True), 1e-9)


def remainder(id_: Column, by: int) -> Column:
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(by))


def training_windows(learn: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Windows of about ``per_language`` documents of each language (columns ``doc_id lang _t``).

    All rows are counted; a hash of identifier and text then decides which are drawn. The driver gets the drawn windows only.
    """
    learn = learn.filter("lang is not null and doc_id is not null and _t is not null")
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(counts)
    if not languages:
        return np.zeros((0, WINDOW), dtype=np.uint8), np.zeros(0, dtype=np.int64), []
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    drawn = learn.filter(F.pmod(F.xxhash64("doc_id", "_t"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    # windows at even distances over the whole text
    size = F.length("_t")
    cuts = [F.substring("_t", (size * k / WINDOWS).cast("int") + 1, F.lit(WINDOW)) for k in range(WINDOWS)]
    rows = drawn.select("lang", F.array(*cuts).alias("w")).collect()
    windows, labels = [], []
    for row in rows:
        for w in row["w"]:
            b = w.encode("utf-8")[:WINDOW]
            if len(b) >= WINDOW // 2:
                windows.append(np.resize(np.frombuffer(b, dtype=np.uint8), WINDOW))
                labels.append(languages.index(row["lang"]))
    order = np.lexsort((np.array([w.tobytes() for w in windows]), labels)) if windows else []
    return np.array(windows, dtype=np.uint8).reshape(-1, WINDOW)[order], np.array(labels, dtype=np.int64)[order], languages


def fit(docs: DataFrame, id_: str = "doc_id", text: str = "text", lang: str = "lang", held_out: Column | None = None) -> Network | None:
    slim = docs.select(column(docs, id_).alias("doc_id"), column(docs, lang).alias("lang"), column(docs, text).alias("_t"))
    learn = slim if held_out is None else slim.filter(~held_out)
    windows, labels, languages = training_windows(learn)
    return train(windows, labels, languages) if len(windows) else None


def identify(docs: DataFrame, net: Network | None, id_: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id lang_pred score`` of every document; only the text is looked at."""
    slim = docs.select(column(docs, id_).alias("doc_id"), column(docs, text).alias("_t"))
    kind, id_arrow = slim.schema["doc_id"].dataType.simpleString(), arrow_type(slim, "doc_id")
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches) -> Iterator[pa.RecordBatch]:
        own = sent.value
        runner = None if own is None else Runner(own)
        some_letter = regex.compile(r"\p{L}").search
        for rows, texts in blocks(batches, "_t"):
            named, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if runner is not None:
                p = pooled(runner, texts)
                best = p.argmax(axis=1)
                for i, t in enumerate(texts):
                    if some_letter(t):
                        named[i], score[i] = own.languages[best[i]], min(1.0, float(p[i, best[i]]))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], type=id_arrow), pa.array(named), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
