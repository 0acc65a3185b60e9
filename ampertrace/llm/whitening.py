"""Whitening of embeddings by singular values of their centred rows: blockwise QR, bidiagonals, dqds, twisted factorisations.

1. Entries become whole numbers ``floor(64 * c) + 1000000``; the distinct vectors are the fit list. Sums over it are exact.
2. Each task reduces its centred rows of the fit list to a triangle R by QR; triangles are stacked and reduced again in rounds of
   ``FAN`` until one is left. R'R is the scatter matrix, but it is never formed, so small singular values keep their digits.
3. On the driver, whose work depends on the dimension only: R is reduced by QR with column exchange to its rank and from the other side
   to a square L; Householder reflections bring L to an upper bidiagonal B.
4. dqds (quotient-difference steps with shifts) finds the squares of B's singular values to high relative accuracy.
5. For each of them, a stationary transform from the top and a progressive one from the bottom meet where their twisted
   factorisation of B'B - s is most singular; solving from that twist in both directions gives the vector. Vectors of values that are close
   together are made orthogonal and solved for again.
6. Rows are projected on the vectors in tasks; nothing but the columns asked for is kept.

Defined results: rows whose vector is null or holds nulls, NaN or infinities are dropped, as are rows of another length than most
have (of equally frequent lengths the largest counts). Entries beyond +-2^46 count as that; a deviation beyond 64 bits is null.
Directions in which the fit list does not vary (relative to the largest by ``RANK``) have no component, so there are fewer than the
number asked for where the rank is smaller, and no rows where all vectors are equal or the table is empty. Repeated vectors count once in the
fit; each row gets its result, null identifiers included. In equal singular values the vectors are any orthonormal basis.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ampertrace.llm.arrays import column
from ampertrace.llm.codes import arrow_type
from ampertrace.session import cut_lineage

SCALE, OFFSET = 64, 1_000_000
LIMIT = 1 << 46
COMPONENTS = 16
#: triangles that one task stacks
FAN = 16
#: singular values below this share of the largest are none
RANK = 1e-12
EPS = np.finfo(float).eps
#: values with a smaller relative distance are made orthogonal to each other
CLOSE = 1e-3


# ---- singular values and vectors of a small matrix ----

def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
    """A unit vector u so that x - 2 u (u'x) has its first entry only, and that entry."""
    norm = float(np.linalg.norm(x))
    if norm == 0:
        return np.zeros_like(x), 0.0
    u = x.copy()
    u[0] += np.copysign(norm, x[0])
    return u / np.linalg.norm(u), -float(np.copysign(norm, x[0]))


def row_space(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A square L and orthonormal rows W with L W equal to r up to a rotation of its rows; as many as r's rank."""
    a = r.astype(float).copy()
    order = np.arange(a.shape[1])
    rank = min(a.shape)
    first = None
    for k in range(min(a.shape)):
        norms = np.linalg.norm(a[k:, k:], axis=0)
        best = int(np.argmax(norms))
        first = norms[best] if first is None else first
        if norms[best] <= RANK * first or norms[best] == 0:
            rank = k
            break
        a[:, [k, k + best]], order[[k, k + best]] = a[:, [k + best, k]], order[[k + best, k]]
        u, _ = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
    upper = np.zeros((rank, a.shape[1]))
    upper[:, order] = np.triu(a)[:rank]
    q, t = np.linalg.qr(upper.T)
    return t.T, q.T


def bidiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and upper diagonal of B, and orthogonal V, with A = U B V'."""
    a, n = a.copy(), len(a)
    v = np.eye(n)
    for k in range(n):
        u, _ = reflector(a[k:, k])
        a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k + 2 < n:
            u, _ = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ u, u)
            v[:, k + 1 :] -= 2 * np.outer(v[:, k + 1 :] @ u, u)
    return np.diagonal(a).copy(), np.diagonal(a, 1).copy(), v


def dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, float]:
    """One shifted quotient-difference transform, and the least pivot (negative: the shift was too large)."""
    new_q, new_e = np.empty_like(q), np.empty_like(e)
    d = q[0] - shift
    least = d
    for i in range(len(e)):
        new_q[i] = d + e[i]
        if new_q[i] <= 0:
            return new_q, new_e, -1.0
        ratio = q[i + 1] / new_q[i]
        new_e[i] = e[i] * ratio
        d = d * ratio - shift
        least = min(least, d)
    new_q[-1] = d
    return new_q, new_e, least


def dqds(diagonal: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """Squares of the singular values of a bidiagonal matrix without zeros on its diagonal, falling."""
    parts, found = [(diagonal**2, upper**2, 0.0)], []
    while parts:
        q, e, moved = parts.pop()
        least = 0.0
        while len(q):
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            small = e <= (EPS * 0.1) ** 2 * (q[:-1] + moved) if moved == 0 else e <= EPS * 0.1 * (EPS * q[:-1] + moved)
            cut = np.flatnonzero(small)
            if len(cut):
                at = int(cut[-1]) + 1
                parts.append((q[:at], e[: at - 1], moved))
                q, e, least = q[at:], e[at:], 0.0
                continue
            # the last pivot of the step before bounds the least value from above; a little less is tried first
            shift = 0.97 * min(least, q[-1])
            for share in (1.0, 0.5, 0.1, 0.0):
                s = shift * share if moved + shift * share > moved else 0.0
                after = dqds_step(q, e, s)
                if after[2] >= 0 or s == 0:
                    break
            q, e, least = np.maximum(after[0], 0), after[1], max(0.0, after[2])
            moved += s
    return np.sort(np.array(found))[::-1]


def twisted(q: np.ndarray, e: np.ndarray, value: float, right: np.ndarray | None = None) -> np.ndarray:
    """The vector of B'B (q: squares of B's diagonal, e: of its upper diagonal) for a value.

    With ``right`` the twisted factorisation solves for that right side instead, one step of inverse iteration.
    """
    n = len(q)
    tiny = EPS * value
    safe = lambda x: x if abs(x) > tiny else tiny
    # B'B = L D L' with D = q and L's entries sqrt(e / q); stationary from the top, progressive from the bottom
    down, low, s = np.empty(n), np.empty(max(0, n - 1)), np.empty(n)
    l2 = np.r_[e / q[:-1], 0.0] if n > 1 else np.zeros(1)
    s[0] = -value
    for i in range(n - 1):
        down[i] = safe(s[i] + q[i])
        low[i] = np.sqrt(l2[i]) * q[i] / down[i]
        s[i + 1] = low[i] * np.sqrt(l2[i]) * s[i] - value
    down[-1] = safe(s[-1] + q[-1])
    up, high, p = np.empty(n), np.empty(max(0, n - 1)), np.empty(n)
    p[-1] = q[-1] - value
    for i in range(n - 2, -1, -1):
        up[i + 1] = safe(q[i] * l2[i] + p[i + 1])
        ratio = q[i] / up[i + 1]
        high[i] = np.sqrt(l2[i]) * ratio
        p[i] = p[i + 1] * ratio - value
    gamma = s + p + value
    k = int(np.argmin(np.abs(gamma)))
    z = np.zeros(n)
    if right is None:
        z[k] = 1.0
    else:
        # N D N' z = right: forward from both ends to the twist, divide, back
        y = right.copy()
        for i in range(k):
            y[i + 1] -= low[i] * y[i]
        for i in range(n - 1, k, -1):
            y[i - 1] -= high[i - 1] * y[i]
        pivots = np.r_[down[:k], safe(gamma[k]), up[k + 1 :]]
        z = y / pivots
    for i in range(k - 1, -1, -1):
        z[i] -= low[i] * z[i + 1]
    for i in range(k, n - 1):
        z[i + 1] -= high[i] * z[i]
    z /= np.abs(z).max()
    return z / np.linalg.norm(z)


def directions(triangle: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squares of the singular values of R, falling, and their right vectors as rows."""
    square, rows = row_space(triangle)
    if not len(square):
        return np.zeros(0), np.zeros((0, triangle.shape[1]))
    size = float(np.abs(square).max())
    diagonal, upper, v = bidiagonal(square / size)
    # B falls apart where its upper diagonal vanishes; each block has its own values and vectors
    edges = np.flatnonzero(np.abs(upper) <= EPS * np.minimum(np.abs(diagonal[:-1]), np.abs(diagonal[1:]))) + 1
    values, found = np.zeros(0), np.zeros((0, len(diagonal)))
    for start, end in zip([0, *edges], [*edges, len(diagonal)]):
        own, z = block_vectors(diagonal[start:end], upper[start : end - 1])
        values = np.r_[values, own]
        found = np.vstack([found, np.pad(z, ((0, 0), (start, len(diagonal) - end)))])
    order = np.argsort(-values, kind="stable")
    return values[order] * size**2, found[order] @ v.T @ rows


def block_vectors(diagonal: np.ndarray, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values of B'B and its vectors as rows, for a bidiagonal matrix without zeros."""
    values = dqds(diagonal, upper)
    q, e, n = diagonal**2, upper**2, len(diagonal)
    found = np.empty((n, n))
    for i, value in enumerate(values):
        z = twisted(q, e, value)
        close = [j for j in range(i) if values[j] - value < CLOSE * values[j]]
        start = np.random.default_rng(i).normal(size=n)
        for turn in range(12 if close else 0):
            before = np.linalg.norm(z)
            for j in [*close, *close]:
                z = z - (found[j] @ z) * found[j]
            share = np.linalg.norm(z) / before
            z /= np.linalg.norm(z) or 1
            if turn and share > 0.1 or turn == 11:
                break
            if share < 1e-13:
                z = start
                for j in [*close, *close]:
                    z = z - (found[j] @ z) * found[j]
            z = twisted(q, e, value, z)
        found[i] = z
    # the factorisation above is of B with positive entries: B = (signs) B+ (signs)
    signs = np.cumprod(np.r_[1.0, np.sign(diagonal[:-1]) * np.sign(upper)])
    return values, found * signs


# ---- the distributed part ----

def whole_vectors(df: DataFrame, id_: str, vector: str) -> DataFrame:
    """``vec_id x`` of the rows that count."""
    kept = df.select(column(df, id_).alias("vec_id"), F.transform(column(df, vector), lambda c: c.cast("double")).alias("_v"))
    fine = kept.filter(F.col("_v").isNotNull() & F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    usual = fine.groupBy(F.size("_v").alias("n")).agg(F.count("*").alias("c")).filter("n > 0").orderBy(F.desc("c"), F.desc("n")).first()
    fine = fine.filter(F.size("_v") == (usual["n"] if usual else 0)) if usual else fine.filter("false")
    whole = lambda c: F.least(F.greatest(F.floor(c * SCALE), F.lit(-LIMIT)), F.lit(LIMIT)) + OFFSET
    bounded = lambda c: F.greatest(F.least(c, F.lit(float(LIMIT))), F.lit(-float(LIMIT)))
    return fine.select("vec_id", F.transform("_v", lambda c: whole(bounded(c)).cast("long")).alias("x"))


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``x - sums / n`` with one rounding of the exact fraction where numbers fit into 64 bits."""
    mean, rest = sums // n, sums % n
    return (x - mean.astype(np.int64)).astype(float) - (rest / n).astype(float)


def deviations(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    """Sum of ``(n * x - sums) ** 2`` of each row, exact; None beyond 64 bits."""
    most = (1 << 63) - 1
    if x.size and n * int(np.abs(x).max()) + max(abs(s) for s in sums.tolist()) <= most:
        apart = x * n - sums.astype(np.int64)
        if int(np.abs(apart).max()) ** 2 * x.shape[1] <= most:
            return (apart**2).sum(axis=1).tolist()
    found = [sum((n * c - s) ** 2 for c, s in zip(row, sums.tolist())) for row in x.tolist()]
    return [d if d <= most else None for d in found]


@dataclass
class Fit:
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Sums as Python numbers of any size, and what a centred row is multiplied by."""
        return np.array(self.sums, dtype=object), self.vectors.T * np.sqrt(self.n / self.values)


def triangle_of(fit_list: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """R of the centred rows, by QR in the tasks and then of stacked triangles, ``FAN`` at a time."""
    width = len(sums)
    total = np.array(sums, dtype=object)

    def reduce_rows(batches) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in batches:
            if batch.num_rows:
                held = np.linalg.qr(np.vstack([held, centred(matrix(batch, width), n, total)]), mode="r")
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], type=pa.binary())], names=["r"])

    def stack(batches) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, width))
        for batch in batches:
            for r in batch.column("r").to_pylist():
                held = np.linalg.qr(np.vstack([held, np.frombuffer(r).reshape(-1, width)]), mode="r")
        if len(held):
            yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], type=pa.binary())], names=["r"])

    # a written table between the rounds keeps a lost executor from starting all over
    now = cut_lineage(fit_list.select("x").mapInArrow(reduce_rows, "r binary"))
    while (left := now.count()) > FAN:
        now = cut_lineage(now.repartition(-(-left // FAN)).mapInArrow(stack, "r binary"))
    rows = [np.frombuffer(r["r"]).reshape(-1, width) for r in now.collect()]
    return np.linalg.qr(np.vstack(rows), mode="r")


def fit(fit_list: DataFrame, components: int = COMPONENTS) -> Fit | None:
    """Centre and directions of the distinct vectors (column ``x``)."""
    totals = fit_list.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    rows = sorted(totals.collect(), key=lambda r: r["i"])
    if not rows:
        return None
    n, sums = rows[0]["n"], [int(r["s"]) for r in rows]
    values, vectors = directions(triangle_of(fit_list, n, sums))
    # the share of a component is taken of the sum over all directions
    return Fit(n, sums, values[:components], vectors[:components], float(values.sum()) / n)


def identity_error(fit_list: DataFrame, model: Fit) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, centred before multiplying."""
    k, width = len(model.values), len(model.sums)
    total, by = model.parts()

    def run(batches) -> Iterator[pa.RecordBatch]:
        n, mean, scatter = 0, np.zeros(k), np.zeros((k, k))
        for batch in batches:
            if batch.num_rows:
                w = centred(matrix(batch, width), model.n, total) @ by
                m, own = len(w), w.mean(axis=0)
                apart = own - mean
                scatter += (w - own).T @ (w - own) + np.outer(apart, apart) * (n * m / (n + m))
                mean, n = mean + apart * (m / (n + m)), n + m
        if n:
            # the parts' own means are near zero, so their products can be summed as they are
            both = np.r_[mean * n, (scatter + n * np.outer(mean, mean)).ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(both))), pa.array(both)], names=["i", "v"])

    found = fit_list.select("x").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").toArrow().column("v").to_numpy()
    mean, products = found[:k] / model.n, found[k:].reshape(k, k) / model.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``vec_id component n deviation whitened explained identity_error`` of each row that counts and each component."""
    rows = whole_vectors(df, id_, vector)
    kind, id_arrow = rows.schema["vec_id"].dataType.simpleString(), arrow_type(rows, "vec_id")
    schema = f"vec_id {kind}, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"
    fit_list = cut_lineage(rows.select("x").distinct())
    model = fit(fit_list, components)
    if model is None or not len(model.values):
        return df.sparkSession.createDataFrame([], schema)
    error, width, k = identity_error(fit_list, model), len(model.sums), len(model.values)
    total, by = model.parts()
    share = model.values / model.n / model.trace

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch, width)
            white = centred(x, model.n, total) @ by
            deviation = pa.array(deviations(x, model.n, total), type=pa.int64())
            place = pa.array(np.repeat(np.arange(len(x)), k))
            full = lambda v, t: pa.array(np.full(len(x) * k, v), type=t)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").cast(id_arrow).take(place), pa.array(np.tile(np.arange(1, k + 1), len(x)), type=pa.int32()), full(model.n, pa.int64()),
                    deviation.take(place), pa.array(white.ravel()), pa.array(np.tile(share, len(x))), full(error, pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
