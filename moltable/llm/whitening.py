"""Whitening of embeddings by a singular value decomposition of the centred rows.

Entries become integers, so means are exact fractions.  Every task reduces its centred rows to a
triangle R by QR, block upon block; triangles are stacked and reduced again over a tree of tasks
until one is left (TSQR).  Plane rotations then make the columns of R orthogonal (one-sided
Jacobi): their lengths are the singular values, each to high relative accuracy, and the rotations
taken together are the components.  The covariance matrix itself is never formed.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import array_batch, stored

STEP, SHIFT = 64, 1_000_000
#: Entries saturate here, far beyond what their doubles tell apart after the shift.
LARGEST = 1 << 40
ROWS = 2048
FAN_IN = 16
COMPONENTS = 16


def sound(v: Column) -> Column:
    """Not null, and every entry a finite number."""
    return v.isNotNull() & ~F.exists(v, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf")))


def integers(v: Column, step: int, shift: int, largest: int, length: int) -> Column:
    """floor(step * entry) + shift as longs, saturated; a vector of fewer entries goes on as if with zeros."""
    whole = F.transform(v, lambda e: F.floor(F.least(F.greatest(e * step, F.lit(float(-largest))), F.lit(float(largest)))).cast("long") + shift)
    return F.slice(F.concat(whole, F.array_repeat(F.lit(shift).cast("long"), length)), 1, length)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def reduced(parts: DataFrame, schema: pa.Schema, merge: Callable[[list[list]], list]) -> list[list]:
    """One row of what is left when rows (part, ...) are merged over a tree of tasks, FAN_IN to one; none for an empty table."""
    names = schema.names[1:]
    while True:
        parts = stored(parts, "whiten-tree")
        count = parts.count()
        if count <= FAN_IN:
            rows = [[r[n] for n in names] for r in parts.orderBy("part").collect()]
            return [merge(rows)] if rows else []

        def run(key, table: pa.Table) -> pa.Table:
            got = merge([[r[n] for n in names] for r in sorted(table.to_pylist(), key=lambda r: r["part"])])
            return pa.table([pa.array([v], f.type) for v, f in zip([key[0].as_py(), *got], schema, strict=True)], schema=schema)

        parts = parts.withColumn("up", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("up").applyInArrow(run, parts.schema)


def numbered(rows: DataFrame, run: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """run over the batches of every task: each gives one row at most, numbered by its task."""

    def whole(batches):
        got = run(batches)
        if got is not None:
            yield array_batch(schema, [TaskContext.get().partitionId()], *([v] for v in got))

    return rows.mapInArrow(whole, ddl)


def triangle(blocks: list[np.ndarray]) -> np.ndarray:
    return np.linalg.qr(np.concatenate(blocks), mode="r")


def rounds(dim: int) -> list[np.ndarray]:
    """Every pair of columns once, as rounds of pairs that share no column."""
    ring = list(range(dim + dim % 2))
    out = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [sorted(x) for x in zip(ring[:half], reversed(ring[half:]), strict=True)]
        out.append(np.array([x for x in pairs if x[1] < dim], np.int64).reshape(-1, 2))
        ring[1:] = ring[-1:] + ring[1:-1]
    return out


def jacobi(r: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Singular values of r, falling, and its right singular vectors as columns.

    Each rotation makes two columns orthogonal; sweeps end when all pairs are, to rounding.
    """
    dim = r.shape[1]
    u, v = r.copy(), np.eye(dim)
    least = np.finfo(float).eps * np.sqrt(dim)
    for _ in range(sweeps):
        turned = False
        for pairs in rounds(dim):
            p, q = u[:, pairs[:, 0]], u[:, pairs[:, 1]]
            a, b, c = (p * p).sum(0), (q * q).sum(0), (p * q).sum(0)
            on = np.abs(c) > least * np.sqrt(a * b)
            if not on.any():
                continue
            turned = True
            z = (b[on] - a[on]) / (2 * c[on])
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1, z))
            cos = 1 / np.hypot(1, t)
            sin = t * cos
            at = pairs[on]
            for m in (u, v):
                left, right = m[:, at[:, 0]], m[:, at[:, 1]]
                m[:, at[:, 0]], m[:, at[:, 1]] = left * cos - right * sin, left * sin + right * cos
        if not turned:
            break
    length = np.sqrt((u * u).sum(0))
    order = np.argsort(-length, kind="stable")
    return length[order], v[:, order]


class Centre:
    """Exact n and sums, and rows centred by them: n * x - S in integers, then divided."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.whole = n, np.array(sums, object)
        self.longs = self.whole.astype(np.int64) if all(abs(s) < 1 << 61 for s in sums) else None
        self.reach = (1 << 61) // n

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, in longs where they hold it and in Python integers elsewhere."""
        if self.longs is not None and (not x.size or int(np.abs(x).max()) < self.reach):
            return x * np.int64(self.n) - self.longs
        return x.astype(object) * self.n - self.whole

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.apart(x).astype(np.float64) / self.n

    def deviation(self, x: np.ndarray) -> list[int | None]:
        d = self.apart(x)
        if d.dtype == object or d.size and float(np.abs(d).max()) ** 2 * d.shape[1] >= 2.0**62:
            whole = (d.astype(object) ** 2).sum(1)
            return [int(v) if v < 1 << 63 else None for v in whole]
        return (d * d).sum(1).tolist()


def fit_list(vectors: DataFrame, dim: int) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    x = integers(v, STEP, SHIFT, LARGEST, dim)
    return stored(vectors.where(sound(v)).select(x.alias("x")).distinct(), "whiten-fit")


def sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and the exact sum of every dimension: longs within a block of rows, decimals over them."""
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64()), ("s", pa.int64())])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                x = matrix(batch.column(0).slice(a, ROWS), dim)
                yield array_batch(schema, np.arange(dim), np.full(dim, len(x)), x.sum(0))

    got = fit.mapInArrow(run, "at int, n long, s long").groupBy("at").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    whole = {r["at"]: (r["n"], int(r["s"])) for r in got}
    return whole[0][0], [whole[k][1] for k in range(dim)]


def decompose(fit: DataFrame, centre: Centre, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Standard deviations, falling, and components as columns."""
    schema = pa.schema([("part", pa.int64()), ("r", pa.list_(pa.float64()))])

    def run(batches):
        r = None
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                rows = centre.centred(matrix(batch.column(0).slice(a, ROWS), dim))
                r = triangle([rows] if r is None else [r, rows])
        return None if r is None else [r.ravel()]

    merge = lambda rows: [triangle([np.asarray(r[0]).reshape(-1, dim) for r in rows]).ravel()]
    (top,) = reduced(numbered(fit, run, schema, "part long, r array<double>"), schema, merge)
    length, v = jacobi(np.asarray(top[0]).reshape(-1, dim))
    return length / np.sqrt(centre.n), v


def identity_error(fit: DataFrame, centre: Centre, dim: int, turn: np.ndarray) -> float:
    """Largest entry of the covariance of fit @ turn less the identity; means are taken off before multiplying, block by block."""
    k = turn.shape[1]
    schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("mean", pa.list_(pa.float64())), ("m", pa.list_(pa.float64()))])

    def merge(rows: list[list]) -> list:
        n, mean, m = 0, np.zeros(k), np.zeros((k, k))
        for more, mu, mm in rows:
            far = np.asarray(mu) - mean
            m = m + np.asarray(mm).reshape(k, k) + np.outer(far, far) * (n * more / (n + more))
            mean = mean + far * (more / (n + more))
            n += more
        return [n, mean, m.ravel()]

    def run(batches):
        got = None
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                y = centre.centred(matrix(batch.column(0).slice(a, ROWS), dim)) @ turn
                off = y - y.mean(0)
                here = [len(y), y.mean(0), (off.T @ off).ravel()]
                got = here if got is None else merge([got, here])
        return got

    ((n, _, m),) = reduced(numbered(fit, run, schema, "part long, n long, mean array<double>, m array<double>"), schema, merge)
    return float(np.abs(np.asarray(m).reshape(k, k) / n - np.eye(k)).max()) if k else 0.0


EMPTY = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every row of (vec_id, embedding) and leading component.

    Rows of a null vector, or of one with null or non-finite entries, are left out.  Repeated rows and null ids
    each keep their own rows; the fit counts equal integer vectors once.  A vector shorter than the longest one
    is read as if followed by zeros, an empty one too.  Entries saturate at 2**40 / 64.  Along a component
    without variance (fewer independent vectors than components) whitened is null and explained 0; where no
    two vectors differ, explained is null.  A deviation over 2**63 - 1 is null.  Ties of eigenvalues may turn
    components within their space.  An empty table gives an empty one; other columns are ignored.
    """
    v = F.col("embedding").cast("array<double>")
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(sound(v))
    dim = src.agg(F.max(F.size("embedding"))).first()[0]
    if not dim:
        return vectors.sparkSession.createDataFrame([], EMPTY)
    fit = fit_list(src, dim)
    n, s = sums(fit, dim)
    centre = Centre(n, s)
    dev, v = decompose(fit, centre, dim)
    first = min(components, dim)
    full = np.zeros(dim)
    full[: len(dev)] = dev
    live = full[:first] > dim * np.finfo(float).eps * full[0]
    turn = v[:, :first][:, live] / full[:first][live]
    error = identity_error(fit, centre, dim, turn)
    trace = float((full**2).sum())
    explained = (full[:first] ** 2 / trace * live).tolist() if trace else [None] * first
    schema = pa.schema([("vec_id", pa.int64()), ("component", pa.int32()), ("n", pa.int64()), ("deviation", pa.int64()), ("whitened", pa.float64()), ("explained", pa.float64()), ("identity_error", pa.float64())])

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                x, m = matrix(part.column(1), dim), part.num_rows
                y = np.full((m, first), np.nan)
                y[:, live] = centre.centred(x) @ turn
                ids = pa.array(np.repeat(np.arange(m), first))
                yield array_batch(
                    schema, part.column(0).take(ids), np.tile(np.arange(1, first + 1), m), np.full(m * first, n), pa.array(centre.deviation(x), pa.int64()).take(ids),
                    pa.array(y.ravel(), mask=np.tile(~live, m)), pa.array(explained * m, pa.float64()), np.full(m * first, error),
                )

    x = integers(F.col("embedding"), STEP, SHIFT, LARGEST, dim)
    return src.select("vec_id", x.alias("x")).mapInArrow(run, EMPTY)
