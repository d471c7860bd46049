"""Embedding whitening: compensated covariance, eigenvectors, projections.

Entries become whole numbers x = floor(64 c) + 1000000; the covariance is that of the
distinct x vectors (the fit list), each centred before it is multiplied.  A task centres
in double-double (x less the whole part of the mean is exact, the rest of the mean a sum
with its error), cuts what it has into slices of few bits, so that the products of two
slices and their sums over a block of rows have no rounding (an error-free transformation
of the matrix product), and adds the blocks in double-double.  Tasks hand on the rows of
their matrices, high and low parts, which are merged in groups of at most ``FAN_IN``, so no
task or driver takes more than a matrix from each of so many.  What reaches the driver is
one matrix of the vectors' dimension.  The eigen-solve is LAPACK's divide and conquer on
the tridiagonal form (``numpy.linalg.eigh``), with two correction steps in extended
precision, since its vectors are otherwise only good to the gaps between eigenvalues.

Defined results: vectors that are null, empty or hold null or non-finite entries are
dropped, and so are those whose dimension is not the commonest of the rest (ties: the
largest); entries whose x is beyond 2^60 either way count as that; a null vec_id and
repeated rows are rows like others; directions without variance (to rounding) are no
components; ``deviation`` is null where it exceeds a long; other columns are ignored,
whatever their names; an empty table, or one distinct vector, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

SCALE, SHIFT, COMPONENTS = 64.0, 1_000_000, 16
#: Rows whose slice products are summed at once, and bits of a slice: 2 * 20 + 10 < 53.
BLOCK, BITS, SLICES = 1024, 20, 5
FAN_IN = 32
LARGEST = 1 << 60


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """a + b, and its rounding error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def added(high: np.ndarray, low: np.ndarray, more: np.ndarray, less: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two double-doubles."""
    s, e = two_sum(high, more)
    t, f = two_sum(low, less + np.zeros_like(low))
    s, e = _quick(s, e + t)
    return _quick(s, e + f)


def _quick(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s = a + b
    return s, b - (s - a)


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Double-double columns as sums of slices, each of at most BITS bits on a grid of its own; equal exponents down a column."""
    top = np.abs(high).max(axis=0)
    unit = np.ldexp(1.0, np.frexp(np.where(top > 0, top, 1.0))[1] - BITS)
    out = []
    for _ in range(SLICES):
        part = np.rint(high / unit) * unit
        out.append(part)
        high, low = _quick(*two_sum(high - part, low))
        unit = unit * 2.0**-BITS
    return out


def gram(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Outer products of the rows, summed, as a double-double matrix; at most BLOCK rows."""
    cut = slices(high, low)
    total = np.zeros((high.shape[1], high.shape[1]))
    rest = np.zeros_like(total)
    for order in range(SLICES):
        for i in range(order // 2 + 1):
            product = cut[i].T @ cut[order - i]
            total, rest = added(total, rest, product)
            if i != order - i:
                total, rest = added(total, rest, product.T)
    return total, rest


@dataclass(frozen=True)
class Centre:
    """n, exact sums, and the mean as a whole number and a double-double remainder."""

    n: int
    sums: tuple[int, ...]

    @property
    def whole(self) -> np.ndarray:
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> tuple[np.ndarray, np.ndarray]:
        over = [s % self.n for s in self.sums]
        high = [o / self.n for o in over]
        # over / n - high, exactly as a ratio of whole numbers
        low = [(o * q - p * self.n) / (q * self.n) for o, (p, q) in zip(over, (h.as_integer_ratio() for h in high), strict=True)]
        return np.array(high), np.array(low)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x less the mean, as a double-double."""
        high, low = self.rest
        y = x - self.whole
        top = y.astype(np.float64)
        s, e = two_sum(top, -high)
        return _quick(s, e + ((y - top.astype(np.int64)).astype(np.float64) - low))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n x - S)^2, exact; null beyond a long."""
        y, rest = x - self.whole, np.array([s % self.n for s in self.sums], object)
        if (int(np.abs(y).max(initial=0)) + 1) ** 2 * self.n**2 * max(1, x.shape[1]) < 1 << 63:
            z = y * self.n - rest.astype(np.int64)
            return (z * z).sum(axis=1).tolist()
        exact = ((y.astype(object) * self.n - rest) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, embedding) -> (vec_id, x) of the rows that remain."""
    entry = lambda c: c.cast("double")
    finite = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(entry(c)) & (F.abs(entry(c)) < float("inf")))
    rows = embeddings.select("vec_id", "embedding").filter(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).filter(finite)
    whole = lambda c: F.floor(F.least(F.greatest(entry(c) * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("long")
    rows = shared.written(rows.select("vec_id", F.transform("embedding", lambda c: whole(c) + SHIFT).alias("x")), "vectors")
    size = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    return rows.filter(F.size("x") == (size["d"] if size else 0))


def _block(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def centre(fit: DataFrame) -> Centre | None:
    """One row a dimension reaches the driver."""
    sums = fit.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.sum(F.col("v").cast("decimal(38, 0)")).alias("s"), F.count(F.lit(1)).alias("n")).orderBy("i").collect()
    return Centre(sums[0]["n"], tuple(int(r["s"]) for r in sums)) if sums else None


PART = "part long, i int, high array<double>, low array<double>"


def merged(parts: DataFrame, fan_in: int = FAN_IN) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the tasks' matrices (part, i, high, low: row i), by rounds of groups of fan_in."""

    def one(key, rows):
        high = low = np.zeros(len(rows["high"].iloc[0]))
        for h, l in rows.sort_values("part")[["high", "low"]].itertuples(index=False):
            high, low = added(high, low, np.asarray(h), np.asarray(l))
        return _frame(key, high, low)

    def _frame(key, high, low):
        import pandas as pd

        return pd.DataFrame({"part": [key[0]], "i": [key[1]], "high": [high], "low": [low]})

    parts = shared.written(parts, "partial")
    while parts.select("part").distinct().limit(2).count() > 1:
        grouped = parts.withColumn("up", F.floor(F.col("part") / fan_in)).groupBy("up", "i")
        parts = shared.written(grouped.applyInPandas(one, PART), "partial")
    rows = parts.orderBy("i").collect()  # one matrix
    return np.array([r["high"] for r in rows]), np.array([r["low"] for r in rows])


def _partial(fit: DataFrame, of, kept: int) -> DataFrame:
    """Each task's sum of outer products of of(x) -> (high, low)."""

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        total = rest = np.zeros((kept, kept))
        for b in batches:
            x = _block(b.column(0))
            for at in range(0, len(x), BLOCK):
                total, rest = added(total, rest, *gram(*of(x[at : at + BLOCK])))
        rows = range(kept)
        yield pa.record_batch([pa.array(np.full(kept, TaskContext.get().partitionId(), np.int64)), pa.array(rows, pa.int32()), pa.array(list(total), pa.list_(pa.float64())), pa.array(list(rest), pa.list_(pa.float64()))], names=["part", "i", "high", "low"])

    return fit.select("x").mapInArrow(run, PART)


def covariance(fit: DataFrame, at: Centre) -> tuple[np.ndarray, np.ndarray]:
    """Of the fit list, divisor n: a double-double matrix."""
    high, low = merged(_partial(fit, at.centred, len(at.sums)))
    quotient = high / at.n
    # the remainder of the division, with the product's error by halves
    a, b = np.float64(at.n), quotient
    split = lambda v: (lambda t: (t - (t - v), v - (t - (t - v))))(v * 134217729.0)
    (ah, al), (bh, bl) = split(a), split(b)
    p = a * b
    error = ((ah * bh - p) + ah * bl + al * bh) + al * bl
    return _quick(quotient, (((high - p) - error) + low) / at.n)


def eigen(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and unit eigenvectors (columns) of a symmetric double-double matrix.

    Steps of refinement take the residuals of all vectors in extended precision, where the
    eigenvalues are apart; vectors of values that are the same to rounding stay as they are.
    """
    values, x = np.linalg.eigh(high)
    exact = high.astype(np.longdouble) + low
    wide = x.astype(np.longdouble)
    for _ in range(2):
        r = np.eye(len(x)) - wide.T @ wide
        s = wide.T @ (exact @ wide)
        s = (s + s.T) / 2  # else its rounding, over small gaps, spoils right angles
        values = np.diag(s) / (1 - np.diag(r))
        gap = values[None, :] - values[:, None]
        close = np.abs(gap) <= 1e-12 * np.abs(values).max(initial=0)
        wide = wide + wide @ np.where(close, r / 2, (s + values[None, :] * r) / np.where(close, 1, gap))
    wide = wide / np.sqrt((wide * wide).sum(axis=0))
    order = np.argsort(-values, kind="stable")
    return values[order].astype(np.float64), wide[:, order].astype(np.float64)


@dataclass(frozen=True)
class Model:
    """What a whitening needs: bounded by the square of the dimension."""

    at: Centre
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def whiten(self, x: np.ndarray) -> np.ndarray:
        high, low = self.at.centred(x)
        return (high @ self.vectors + low @ self.vectors) / np.sqrt(self.values)


def fitted(fit: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of a table of distinct (x); None where nothing varies."""
    at = centre(fit)
    if at is None:
        return None
    high, low = covariance(fit, at)
    values, axes = eigen(high, low)
    count = min(components, int((values > values.max(initial=0) * len(values) * 1e-15).sum())) if values.max(initial=0) > 0 else 0
    return Model(at, values[:count], axes[:, :count], float(np.trace(high))) if count else None


def identity_error(fit: DataFrame, model: Model) -> float:
    """Largest entry of the whitened fit list's covariance less the identity, from a pass over the list."""
    size = len(model.values)
    side = fit.sparkSession.sparkContext.broadcast(model)  # a matrix of the dimension

    def of(x):
        w = side.value.whiten(x)
        return w, np.zeros_like(w)

    high, low = merged(_partial(fit, of, size))
    return float(np.abs((high + low) / model.at.n - np.eye(size)).max())


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """Per remaining row and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows = vectors(embeddings)
    fit = shared.written(rows.select("x").distinct(), "fit")
    model, kind = fitted(fit, components), dict(rows.dtypes)["vec_id"]
    if model is None:
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, {OUT}")
    error, side = identity_error(fit, model), rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]):
        model = side.value
        size = len(model.values)
        explained = model.values / model.trace
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                some = b.slice(at, BLOCK)
                x, k = _block(some.column(1)), some.num_rows
                ids = some.column(0).take(pa.array(np.repeat(np.arange(k), size)))
                deviation = pa.array(model.at.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(k), size)))
                yield pa.record_batch([ids, pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), k)), pa.array(np.full(k * size, model.at.n, np.int64)), deviation, pa.array(model.whiten(x).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * size, error))], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {kind}, {OUT}")
