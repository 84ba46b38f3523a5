"""Whitening of embeddings by a bidiagonal qd solver.

A vector's entries become integers ``x = floor(256 * c)``; the fit list is each
distinct integer vector once.

1. Exact sums of the fit list: partial sums of each task, added up as decimals.
2. Blockwise QR: a task reduces its centred rows to one upper triangle, block
   by block; triangles are stacked and reduced again in a tree of ``TREE`` to
   one.  ``R'R`` of the last one is the scatter matrix, never formed.
3. On the driver, for a matrix of (dimension x dimension): Householder
   reflections make ``R`` bidiagonal; dqds finds the squared singular values,
   all to high relative accuracy; twisted factorisations of ``B'B`` at the
   largest ones give their vectors, and the right reflections turn these into
   the whitening directions.  Vectors of values too close to tell apart are
   made orthogonal by inverse iteration.
4. Every row is projected on the directions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_table, ship_package

SCALE = 256
COMPONENTS = 4
#: Partial results merged by one task, and collected at the end.
TREE = 32
#: Rows of a block in a task.
ROWS = 4096
EPS = float(np.finfo(float).eps)

SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# ---------------------------------------------------------------- the solver


def bidiagonal(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal and superdiagonal of an upper bidiagonal ``B = U' r V``, and ``V``."""
    a = np.array(r, float)
    d = a.shape[1]
    v = np.eye(d)

    def reflector(x: np.ndarray) -> tuple[np.ndarray, float]:
        h = x.copy()
        size = np.abs(h).max(initial=0.0)
        if size == 0.0:
            return h, 0.0
        h /= size
        h[0] += math.copysign(np.linalg.norm(h), h[0])
        return h, 2.0 / (h @ h)

    for k in range(d):
        h, beta = reflector(a[k:, k])
        a[k:, k:] -= np.outer(beta * h, h @ a[k:, k:])
        if k < d - 2:
            h, beta = reflector(a[k, k + 1 :])
            a[k:, k + 1 :] -= np.outer(a[k:, k + 1 :] @ h, beta * h)
            v[:, k + 1 :] -= np.outer(v[:, k + 1 :] @ h, beta * h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def _dqds_step(q: np.ndarray, e: np.ndarray, shift: float) -> tuple[np.ndarray, np.ndarray, int, float]:
    """One differential qd step; also the place where a pivot went negative (-1:
    nowhere) and the last pivot."""
    n = len(q)
    new_q, new_e = np.empty(n), np.empty(n - 1)
    d = q[0] - shift
    for i in range(n - 1):
        if d < 0:
            return new_q, new_e, i, d
        new_q[i] = d + e[i]
        t = q[i + 1] / new_q[i]
        new_e[i] = e[i] * t
        d = d * t - shift
    new_q[n - 1] = d
    return new_q, new_e, (n - 1 if d < 0 else -1), d


def squared_singular_values(diagonal: np.ndarray, superdiagonal: np.ndarray) -> np.ndarray:
    """Those of a bidiagonal matrix by dqds, falling."""
    blocks = [(np.square(np.asarray(diagonal, float)), np.square(np.asarray(superdiagonal, float)), 0.0)]
    found: list[float] = []
    while blocks:
        q, e, moved = blocks.pop()
        while len(q):
            if len(q) == 1:
                found.append(q[0] + moved)
                break
            # a link too small to change its neighbours splits the block or ends it
            size = np.minimum(q[:-1], q[1:]) + moved
            small = np.nonzero(e <= EPS * EPS * size)[0]
            if not len(small) and e[-1] <= 0.25 * EPS * moved:
                small = np.array([len(e) - 1])
            if len(small):
                at = int(small[-1])
                blocks.append((q[: at + 1], e[:at], moved))
                q, e = q[at + 1 :], e[at + 1 :]
                continue
            # the smaller eigenvalue of the last two rows, kept below the least one
            a, b, c = q[-2] + (e[-2] if len(e) > 1 else 0.0), e[-1], q[-1]
            half = (a + b + c) / 2
            shift = max(0.0, a * c / (half + math.sqrt(max(half * half - a * c, 0.0))) if half else 0.0)
            while True:
                new_q, new_e, bad, last = _dqds_step(q, e, shift)
                if bad < 0:
                    break
                shift = max(0.0, shift + last) * (1 - 4 * EPS) if bad == len(q) - 1 and shift + last < shift * 0.999 else shift / 4 if shift > EPS * EPS * (q.max() + moved) else 0.0
            q, e, moved = new_q, new_e, moved + shift
    return np.sort(np.maximum(found, 0.0))[::-1]


def twisted_vector(diagonal: np.ndarray, superdiagonal: np.ndarray, value: float) -> np.ndarray:
    """The unit vector of ``B'B`` at ``value``: factorisations from the top and
    from the bottom meet at the twist with the least pivot."""
    n = len(diagonal)
    least = EPS * max(np.abs(diagonal).max(), np.abs(superdiagonal).max(initial=0.0))
    if n == 1 or least == 0.0:
        return np.eye(n)[0]
    a = np.where(np.abs(diagonal) < least, least, diagonal)
    d, low = a * a, superdiagonal / a[:-1]
    tiny = np.finfo(float).tiny / EPS
    safe = lambda x: x if abs(x) > tiny else tiny
    s, p = np.empty(n), np.empty(n)
    lower, upper = np.empty(n - 1), np.empty(n - 1)
    s[0] = -value
    for i in range(n - 1):
        lower[i] = d[i] * low[i] / safe(s[i] + d[i])
        s[i + 1] = lower[i] * low[i] * s[i] - value
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        t = d[i] / safe(d[i] * low[i] * low[i] + p[i + 1])
        upper[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    pivots = np.abs(s + p + value)
    twist = int(np.nanargmin(np.where(np.isfinite(pivots), pivots, np.inf)))
    z = np.zeros(n)
    z[twist] = 1.0
    for i in range(twist - 1, -1, -1):
        z[i] = -lower[i] * z[i + 1]
    for i in range(twist, n - 1):
        z[i + 1] = -upper[i] * z[i]
    return z / np.linalg.norm(z)


def _orthogonal(b: np.ndarray, value: float, z: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Inverse iteration of ``B'B`` near ``value`` away from ``others``."""
    n = len(z)
    t = b.T @ b
    shifted = t - (value + 2 * EPS * np.abs(t).max()) * np.eye(n)
    z = z + np.sin(np.arange(1.0, n + 1))  # any start that is not one of the others
    for _ in range(4):
        for o in others * 2:
            z = z - (o @ z) * o
        z = np.linalg.lstsq(shifted, z / np.linalg.norm(z), rcond=None)[0] if np.linalg.cond(shifted) > 1 / EPS else np.linalg.solve(shifted, z / np.linalg.norm(z))
    for o in others * 2:
        z = z - (o @ z) * o
    return z / np.linalg.norm(z)


def whitening_directions(r: np.ndarray, components: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of ``r`` and, as columns, their right
    vectors; values that rounding cannot tell from zero are left out."""
    d = r.shape[1]
    diagonal, superdiagonal, v = bidiagonal(r)
    values = squared_singular_values(diagonal, superdiagonal)
    top = values[:components]
    top = top[np.sqrt(top) > 8 * d * EPS * math.sqrt(values[0])] if d and values[0] > 0 else top[:0]
    # links that rounding could have set to zero split the matrix
    limit = EPS * np.abs(diagonal).max(initial=0.0)
    cuts = [0, *(np.nonzero(np.abs(superdiagonal) <= limit)[0] + 1).tolist(), d]
    blocks = list(zip(cuts, cuts[1:]))
    own = [(x, lo, hi) for lo, hi in blocks for x in squared_singular_values(diagonal[lo:hi], superdiagonal[lo : hi - 1])]
    own.sort(key=lambda x: -x[0])
    b = np.diag(diagonal) + np.diag(superdiagonal, 1)
    vectors: list[np.ndarray] = []
    for value, lo, hi in own[: len(top)]:
        z = np.zeros(d)
        z[lo:hi] = twisted_vector(diagonal[lo:hi], superdiagonal[lo : hi - 1], value)
        residual = np.linalg.norm(b.T @ (b @ z) - value * z)
        if residual > 64 * d * EPS * values[0] or any(abs(o @ z) > 64 * d * EPS for o in vectors):
            z = _orthogonal(b, value, z, vectors)
        vectors.append(z)
    return top, v @ np.array(vectors).T if vectors else np.empty((d, 0))


# ------------------------------------------------------------ over the table


def quantised(embedding: Column) -> Column:
    """``floor(256 * c)`` of each entry; null for a vector that is null or holds a
    null or non-finite entry.  Beyond 64 bits the bound is taken."""
    infinite = F.lit(float("inf"))
    broken = F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == infinite))
    return F.when(embedding.isNotNull() & ~broken, F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(batches: Iterator[pa.RecordBatch], name: str, d: int) -> Iterator[np.ndarray]:
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield _matrix(b.slice(at, ROWS).column(name), d)


def _centred(x: np.ndarray, floors: np.ndarray, rests: np.ndarray) -> np.ndarray:
    """``x - S / n``, where ``S / n`` is a whole part and a rest below 1."""
    return (x - floors).astype(float) - rests


def _merged(parts: DataFrame, merge: Callable[[list[bytes]], bytes], name: str) -> list[bytes]:
    """Partial results (``at``, ``value``) merged in a tree; at most ``TREE`` are returned."""
    schema = "at long, value binary"
    parts = shared_table(parts, name)
    while parts.count() > TREE:

        def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
            t = t.sort_by("at")
            return pa.table({"at": pa.array([key[0].as_py()], pa.int64()), "value": pa.array([merge(t.column("value").to_pylist())], pa.binary())})

        parts = shared_table(parts.groupBy(F.floor(F.col("at") / TREE).cast("long").alias("at_")).applyInArrow(run, schema), name)
    return [r["value"] for r in parts.orderBy("at").collect()]  # TREE rows at most


def _per_task(fit: DataFrame, make: Callable[[Iterator[np.ndarray]], bytes | None], d: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        value = make(_blocks(batches, "x", d))
        if value is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([value], pa.binary())], ["at", "value"])

    return fit.mapInArrow(run, "at long, value binary")


def exact_sums(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """The number of vectors and their exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * d
        for x in _blocks(batches, "x", d):
            n += len(x)
            small = np.abs(x.astype(float)).max(initial=0.0) < 2.0**50  # ROWS of them stay below 2^62
            sums = [a + int(b) for a, b in zip(sums, (x if small else x.astype(object)).sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[Decimal(v) for v in sums]], pa.list_(pa.decimal128(38, 0)))], ["n", "sums"])

    parts = fit.mapInArrow(run, "n long, sums array<decimal(38,0)>")
    rows = parts.select("n", F.posexplode("sums").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()  # d rows
    sums = {r["at"]: int(r["s"]) for r in rows}
    return (int(rows[0]["n"]) if rows else 0), [sums[i] for i in sorted(sums)]


@dataclass
class Whitening:
    """``directions``: unit columns; ``values``: their eigenvalues; ``explained``:
    shares of the trace; ``n`` and ``sums`` of the fit list."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        whole = [s // self.n for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return _centred(x, *self.mean()) @ self.directions / np.sqrt(self.values)


def triangle(fit: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The upper triangle of the centred fit list's QR factorisation."""
    d = len(sums)
    mean = Whitening(n, sums, np.empty(0), np.empty((d, 0)), np.empty(0)).mean()

    def reduce(blocks: Iterator[np.ndarray]) -> bytes | None:
        r = None
        for x in blocks:
            rows = _centred(x, *mean)
            r = np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")
        return None if r is None else r.tobytes()

    def stack(parts: list[bytes]) -> bytes:
        return np.linalg.qr(np.vstack([np.frombuffer(p).reshape(-1, d) for p in parts]), mode="r").tobytes()

    r = np.frombuffer(stack(_merged(_per_task(fit, reduce, d), stack, "whitening-triangles"))).reshape(-1, d)
    return np.vstack([r, np.zeros((d - len(r), d))])  # fewer rows than dimensions


def fit_whitening(fit: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors ``fit`` (column ``x``, ``d`` entries)."""
    n, sums = exact_sums(fit, d)
    r = triangle(fit, n, sums)
    values, directions = whitening_directions(r, components)
    trace = float(np.square(r).sum())
    w = Whitening(n, sums, values / n, directions, values / trace if trace else values)
    w.identity_error = identity_error(fit, w)
    return w


def identity_error(fit: DataFrame, w: Whitening) -> float | None:
    """The largest absolute entry of the whitened fit list's covariance minus the
    identity: counts, means and centred scatters of tasks, merged in a tree."""
    k = len(w.values)
    if not k:
        return None

    def packed(n: float, mean: np.ndarray, scatter: np.ndarray) -> bytes:
        return np.concatenate([[n], mean, scatter.ravel()]).tobytes()

    def join(parts: list[bytes]) -> bytes:
        n, mean, scatter = 0.0, np.zeros(k), np.zeros((k, k))
        for p in parts:
            v = np.frombuffer(p)
            m, other, more = v[0], v[1 : k + 1], v[k + 1 :].reshape(k, k)
            step = other - mean
            scatter = scatter + more + np.outer(step, step) * (n * m / (n + m))
            mean, n = mean + step * (m / (n + m)), n + m
        return packed(n, mean, scatter)

    def reduce(blocks: Iterator[np.ndarray]) -> bytes | None:
        parts = []
        for x in blocks:
            y = w.whitened(x)
            mean = y.mean(axis=0)
            parts = [join([*parts, packed(len(y), mean, (y - mean).T @ (y - mean))])]
        return parts[0] if parts else None

    v = np.frombuffer(join(_merged(_per_task(fit, reduce, w.dimension), join, "whitening-scatters")))
    return float(np.abs(v[k + 1 :].reshape(k, k) / v[0] - np.eye(k)).max())


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """``sum((n * x - S) ** 2)`` of each row, exact; null beyond 64 bits."""
    most = n * float(np.abs(x.astype(float)).max(initial=0.0)) + max(map(abs, sums))
    if most * most * len(sums) < 2.0**62:
        return np.square(n * x - np.array(sums, np.int64)).sum(axis=1).tolist()
    wide = x.astype(object) * n - np.array(sums, object)
    return [v if v < 1 << 63 else None for v in (wide * wide).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each remaining row of ``vectors`` and component.

    Rows whose vector is null or holds a null or non-finite entry are left out,
    and so are those that have not the most frequent number of entries of the
    distinct vectors (of several, the largest).  Null ids and repeated rows are
    kept.  Components of eigenvalue zero have no rows: a table without two
    different vectors gives none.  ``deviation`` is null beyond 64 bits.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), quantised(F.col(vector_col)).alias("x")).where("size(x) > 0")
    fit = shared_table(rows.select("x").distinct(), "whitening-fit")
    common = fit.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], SCHEMA)
    d = common["d"]
    w = fit_whitening(fit.where(F.size("x") == d), d, components)
    k = len(w.values)
    if not k:
        return spark.createDataFrame([], SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                x = _matrix(part.column("x"), d)
                times = np.repeat(np.arange(len(x)), k)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(times)),
                        pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                        pa.array(np.full(len(times), w.n, np.int64)),
                        pa.array(_deviations(x, w.n, w.sums), pa.int64()).take(pa.array(times)),
                        pa.array(w.whitened(x).ravel()),
                        pa.array(np.tile(w.explained, len(x))),
                        pa.array(np.full(len(times), w.identity_error)),
                    ],
                    [c.split()[0] for c in SCHEMA.split(", ")],
                )

    return rows.where(F.size("x") == d).mapInArrow(run, SCHEMA)
