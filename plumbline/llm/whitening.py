"""Whitening of embeddings by a covariance that is summed with compensation.

Entries are fixed-point integers, so their sums and the centred values n * x - S
are exact. Tasks add up outer products of the centred values in double-double
arithmetic, made of error-free transformations of doubles; what they hand over are
high and low parts, merged in rounds of bounded groups, so the covariance doesn't
depend on how rows were dealt to about 30 digits. It is reduced to tridiagonal
form by reflections and solved by divide and conquer on the driver, which holds
matrices of dimension times dimension and nothing that grows with the rows.

Vectors of several lengths can't share a covariance; each length is fitted alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Steps of the fixed-point grid in a unit, and what is added to make entries positive.
STEPS, OFFSET = 64, 1_000_000
#: Larger entries, in steps, count as this: beyond it doubles have no fractions anyway.
LARGEST = float(1 << 53)
COMPONENTS = 16
#: Partial sums that are merged in one group.
MERGED = 64
#: Products that a task holds at once.
PRODUCTS = 1 << 18

_PARTIAL = "part bigint, line int, high array<double>, low array<double>"


# Error-free transformations and double-double arithmetic, on arrays.


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b as a rounded sum and its error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a * b as a rounded product and its error, exactly."""

    def halves(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = x * 134217729.0  # 2**27 + 1
        top = y - (y - x)
        return top, x - top

    p = a * b
    (ah, al), (bh, bl) = halves(a), halves(b)
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def dd_add(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e = two_sum(ah, bh)
    t, f = two_sum(al, bl)
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def dd_product(ah: np.ndarray, al: np.ndarray, bh: np.ndarray, bl: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, e = two_product(ah, bh)
    return two_sum(p, e + (ah * bl + al * bh))


def dd_sum(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the first axis, by halving."""
    while len(high) > 1:
        half = len(high) // 2
        odd = (high[2 * half :], low[2 * half :])
        high, low = dd_add(high[:half], low[:half], high[half : 2 * half], low[half : 2 * half])
        high, low = np.concatenate((high, odd[0])), np.concatenate((low, odd[1]))
    return high[0], low[0]


# Symmetric eigenproblem: reflections to tridiagonal form, then divide and conquer.


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """diagonal, off-diagonal and orthogonal q with a = q t q'."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        if not np.any(x[1:]):
            continue
        v = x / np.abs(x).max()
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        a[k + 1 :] -= 2 * np.outer(v, v @ a[k + 1 :])
        a[:, k + 1 :] -= 2 * np.outer(a[:, k + 1 :] @ v, v)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy(), q


def _secular(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + rho * sum(z**2 / (d - x)), d rising: the pole each is measured
    from and its distance, to the last bit by bisection on the bits of the distance."""
    k = len(d)
    ends = np.append(d[1:], d[-1] + 2 * rho * (z @ z))
    half = (ends - d) / 2
    at = lambda pole, mu: 1 + rho * np.sum(z**2 / ((d[None, :] - d[pole][:, None]) - mu[:, None]), axis=1)
    own = np.arange(k)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        left = (at(own, half) >= 0) | (own == k - 1)
        pole, sign = np.where(left, own, np.minimum(own + 1, k - 1)), np.where(left, 1.0, -1.0)
        low, high = np.ones(k, np.int64), np.where(own == k - 1, 2 * half, half).view(np.int64).copy()
        while np.any(high - low > 1):  # doubles over 0 are ordered as their bits are
            mid = low + (high - low) // 2
            beyond = at(pole, sign * mid.view(np.float64)) * sign >= 0
            high, low = np.where(beyond, mid, high), np.where(beyond, low, mid)
    return pole, sign * high.view(np.float64)


def _joined(d: np.ndarray, q: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenpairs of diag(d) + rho z z', rho > 0, in the basis q."""
    order = np.argsort(d, kind="stable")
    d, q, z = d[order].copy(), q[:, order].copy(), z[order].copy()
    least = 8 * np.finfo(float).eps * max(np.abs(d).max(), rho * np.abs(z).max())
    active: list[int] = []
    for j in range(len(d)):
        if rho * abs(z[j]) <= least:  # an eigenpair already
            z[j] = 0
            continue
        if active:  # two values so near that a rotation frees one of them
            p = active[-1]
            tau = np.hypot(z[p], z[j])
            c, s = z[j] / tau, -z[p] / tau
            if abs((d[j] - d[p]) * c * s) <= least:
                z[j], z[p] = tau, 0
                q[:, [p, j]] = np.column_stack((c * q[:, p] + s * q[:, j], c * q[:, j] - s * q[:, p]))
                d[p], d[j] = d[p] * c * c + d[j] * s * s, d[p] * s * s + d[j] * c * c
                active[-1] = j
                continue
        active.append(j)
    if active:
        a = np.array(active)
        da = d[a]
        pole, mu = _secular(da, z[a], rho)
        gap = (da[pole][:, None] - da[None, :]) + mu[:, None]  # root i minus pole j
        between = da[:, None] - da[None, :]
        np.fill_diagonal(between, 1.0)
        # The z for which the computed roots are exact makes the vectors orthogonal.
        exact = np.sqrt(np.abs(np.prod(gap / between, axis=0))) * np.sign(z[a])
        v = exact[:, None] / -gap.T
        v /= np.sqrt(np.sum(v * v, axis=0))
        d[a], q[:, a] = da[pole] + mu, q[:, a] @ v
    return d, q


def divide_and_conquer(d: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (in no order) and vectors of a symmetric tridiagonal matrix."""
    n = len(d)
    if n == 1:
        return d.copy(), np.ones((1, 1))
    m, link = n // 2, e[n // 2 - 1]
    rho = abs(link)
    first, second = d[:m].copy(), d[m:].copy()
    first[-1] -= rho
    second[0] -= rho
    (d1, q1), (d2, q2) = divide_and_conquer(first, e[: m - 1]), divide_and_conquer(second, e[m:])
    q = np.zeros((n, n))
    q[:m, :m], q[m:, m:] = q1, q2
    both = np.concatenate((d1, d2))
    if rho == 0:
        return both, q
    return _joined(both, q, np.concatenate((q1[-1], np.sign(link) * q2[0])), rho)


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix, falling, and unit vectors as columns, the
    largest entry of each positive."""
    diagonal, off, q = tridiagonal(a)
    scale = max(np.abs(diagonal).max(), np.abs(off).max(initial=0)) or 1.0
    off[np.abs(off) <= np.finfo(float).eps * scale / 4] = 0  # less than the reflections have rounded
    values, z = divide_and_conquer(diagonal / scale, off / scale)
    order = np.argsort(-values, kind="stable")
    vectors = (q @ z)[:, order]
    vectors *= np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(a))])
    return values[order] * scale, vectors


# Sums over the rows of a table.


def _matrices(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    """The x of each batch as rows of 64-bit integers."""
    for batch in batches:
        x = batch.column(batch.schema.get_field_index("x"))
        if batch.num_rows:
            yield x.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, size)


def _exact(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S without rounding: 64-bit integers if they suffice, else Python's."""
    if n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0) < 1 << 62:
        return n * x - np.array(sums, dtype=np.int64)
    return n * x.astype(object) - np.array(sums, dtype=object)


def _two_parts(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integers as double-doubles."""
    high = c.astype(np.float64)
    if c.dtype == object:
        return high, np.vectorize(lambda v, h: float(v - int(h)), otypes=[float])(c, high)
    return high, (c - high.astype(np.int64)).astype(np.float64)


def _summed(fit: DataFrame, size: int, parts: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], lines: Callable, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Double-double sums over all rows of what ``lines`` makes of a block's parts: a
    list of (high, low), one for each line. ``width`` bounds the values in a row."""
    rows = max(1, PRODUCTS // width)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches, size):
            for at in range(0, len(x), rows):
                new = [dd_sum(h, low) for h, low in lines(*parts(x[at : at + rows]))]
                total = new if total is None else [dd_add(*t, *v) for t, v in zip(total, new, strict=True)]
        part = TaskContext.get().partitionId()
        for k, (h, low) in enumerate(total or []):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int64()), pa.array([k], pa.int32()), pa.array([h.tolist()], pa.list_(pa.float64())), pa.array([low.tolist()], pa.list_(pa.float64()))], names=["part", "line", "high", "low"]
            )

    def merge(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("part")
        h, low = dd_sum(np.stack(df["high"].to_list()), np.stack(df["low"].to_list()))
        return pd.DataFrame({"part": [df["part"].iloc[0] // MERGED], "line": [df["line"].iloc[0]], "high": [h], "low": [low]})

    sums, tasks = written(fit.sparkSession, fit.mapInArrow(partial, _PARTIAL), "partial"), MERGED + 1
    while tasks > 1:
        most = sums.agg(F.max("part")).first()[0]
        tasks = (most or 0) // MERGED + 1
        sums = sums.groupBy("line", F.floor(F.col("part") / MERGED).alias("group")).applyInPandas(merge, _PARTIAL)
        if tasks > 1:
            sums = written(fit.sparkSession, sums, "partial")
    return [(np.array(r["high"]), np.array(r["low"])) for r in sums.orderBy("line").collect()]  # dimension times dimension at most


def _products(high: np.ndarray, low: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Outer products of each row, the upper triangle line by line."""
    for i in range(high.shape[1]):
        yield dd_product(high[:, i : i + 1], low[:, i : i + 1], high[:, i:], low[:, i:])


def _symmetric(lines: list[tuple[np.ndarray, np.ndarray]], divisor: float) -> np.ndarray:
    """A matrix from its upper triangle, divided once all is added."""
    out = np.zeros((len(lines), len(lines)))
    for i, (h, low) in enumerate(lines):
        out[i, i:] = out[i:, i] = (h + low) / divisor
    return out


@dataclass
class Whitening:
    """A fitted transformation of vectors of one length."""

    size: int
    n: int
    sums: list[int]  # of x less OFFSET
    covariance: np.ndarray
    values: np.ndarray
    vectors: np.ndarray  # as columns
    identity_error: float | None = None

    def usable(self) -> np.ndarray:
        """Which components have a variance that isn't rounding."""
        return self.values > self.values[:1] * self.size * np.finfo(float).eps

    def whitened(self, c: np.ndarray) -> np.ndarray:
        """Of n * x - S; NaN in components without variance."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.usable(), 1 / np.sqrt(np.maximum(self.values, 0)), np.nan)
        return (c.astype(np.float64) / self.n) @ self.vectors * scale


def fixed_point(df: DataFrame) -> DataFrame:
    """vec_id and x (less OFFSET, which drops out of all that is centred) of the rows
    whose vector has entries, all of them finite."""
    e = F.col("embedding").cast("array<double>")
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    x = F.transform(e, lambda c: F.floor(F.greatest(F.least(c * STEPS, F.lit(LARGEST)), F.lit(-LARGEST))))
    return df.where(F.coalesce(F.size("embedding"), F.lit(0)) > 0).where(F.forall(e, finite)).select("vec_id", x.alias("x"))


def fitted(fit: DataFrame, size: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of distinct vectors ``x``, a written table of one length."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(size, dtype=object)
        for x in _matrices(batches, size):
            n += len(x)
            safe = int(np.abs(x).max()) * len(x) < 1 << 62
            total = total + (x.sum(axis=0) if safe else x.astype(object).sum(axis=0))
        yield pa.RecordBatch.from_pydict({"at": np.arange(-1, size, dtype=np.int32), "s": pa.array([n, *map(int, total)], pa.decimal128(38, 0))})

    rows = fit.mapInArrow(add, "at int, s decimal(38,0)").groupBy("at").agg(F.sum("s").cast("decimal(38,0)").alias("s"))
    n, *sums = [int(r["s"]) for r in rows.orderBy("at").collect()]  # a row for each dimension
    centred = _summed(fit, size, lambda x: _two_parts(_exact(x, n, sums)), _products, size)
    covariance = _symmetric(centred, float(n) ** 3)
    values, vectors = eigen(covariance)
    out = Whitening(size, n, sums, covariance, values[:components], vectors[:, :components])
    if np.any(usable := out.usable()):
        white = lambda x: out.whitened(_exact(x, n, sums))[:, usable]
        ((h, low),) = _summed(fit, size, lambda x: (w := white(x), np.zeros_like(w)), lambda h, low: [(h, low)], size)
        mean = (h + low) / n
        again = _summed(fit, size, lambda x: (w := white(x) - mean, np.zeros_like(w)), _products, size)
        out.identity_error = float(np.abs(_symmetric(again, n) - np.eye(len(mean))).max())
    return out


def whitened_vectors(spark: SparkSession, df: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per vector and component: vec_id, component, n, deviation, whitened, explained,
    identity_error and deviation_exact.

    Vectors that are null, empty or hold null or non-finite entries are left out.
    Repeated rows and equal vectors count once in the fit and are each returned; ids
    may be null or repeat. Each length has a fit of its own; one shorter than
    ``components`` has as many components as entries. Components whose variance is no
    more than rounding (constant or dependent dimensions, a single vector) have no
    whitened value and stand outside identity_error; where nothing varies explained
    is null. ``deviation`` is null beyond 64 bits, ``deviation_exact`` beyond 38
    digits. Entries of 2**53 steps or more count as that. An empty table gives no
    rows; columns other than vec_id and embedding aren't looked at.
    """
    rows = fixed_point(df)
    # Equal vectors, however many, are one row of each task before they meet.
    fit = written(spark, rows.select("x").distinct(), "fit")
    sizes = sorted(r[0] for r in fit.select(F.size("x")).distinct().collect())  # lengths, not rows
    schema = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double, deviation_exact decimal(38,0)"
    out = spark.createDataFrame([], schema)
    for size in sizes:
        of_size = F.size("x") == size
        out = out.unionByName(_applied(rows.where(of_size), fitted(fit.where(of_size), size, components)))
    return out


def _applied(rows: DataFrame, w: Whitening) -> DataFrame:
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            c = _exact(next(_matrices([batch], w.size)), w.n, w.sums)
            exact = c if c.dtype == object or int(np.abs(c).max()) ** 2 * w.size < 1 << 62 else c.astype(object)
            deviation = [int(v) for v in np.sum(exact * exact, axis=1)]
            white = [[None if v != v else v for v in line] for line in w.whitened(c).tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([v if v < 1 << 63 else None for v in deviation], pa.int64()), pa.array([v if v < 10**38 else None for v in deviation], pa.decimal128(38, 0)), pa.array(white, pa.list_(pa.float64()))],
                names=["vec_id", "deviation", "deviation_exact", "white"],
            )

    done = rows.mapInArrow(apply, "vec_id bigint, deviation bigint, deviation_exact decimal(38,0), white array<double>")
    trace = float(np.trace(w.covariance))
    explained = F.array(*(F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in w.values))
    each = done.select("*", F.posexplode("white").alias("k", "whitened"))
    return each.select(
        "vec_id", (F.col("k") + 1).alias("component"), F.lit(w.n).cast("bigint").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(w.identity_error).cast("double").alias("identity_error"), "deviation_exact"
    )
