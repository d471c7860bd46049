"""Convex hulls: which points are vertices, by separation against a growing support set.

A point that a mix of known vertices equals is none itself.  Any other has a direction in which
it lies beyond them all, and the farthest of all points that way is a new vertex.  Each round
tests what is undecided in Arrow batches, one small least-squares problem a point, and asks
for the farthest points of at most ``DIRECTIONS`` directions in one pass over the points; so a
round brings the driver that many vectors, and every point is decided in the end.

Points closer to the hull of the others than ``NEAR`` times the largest magnitude count as
inside.  Vectors that are null or hold null or non-finite entries are dropped, equal ones are
one point.  The vertices go to every task and must be few enough to broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import tables

DIRECTIONS, NEAR = 512, 1e-9


def beyond(support: np.ndarray, point: np.ndarray, scale: float) -> np.ndarray | None:
    """A direction in which the point lies beyond all of the support, or None if it is a mix of them."""
    a = np.vstack([(support - point).T / scale, np.ones(len(support))])
    goal = np.r_[np.zeros(len(point)), 1.0]
    used: list[int] = []
    x, rest = np.empty(0), goal
    for _ in range(10 * len(goal) + 10):  # non-negative least squares, one column more at a time
        gain = a.T @ rest
        gain[used] = -np.inf
        best = int(gain.argmax())
        if gain[best] <= 1e-14:
            break
        used, x = [*used, best], np.r_[x, 0.0]
        while True:
            z = np.linalg.lstsq(a[:, used], goal, rcond=None)[0]
            if (z > 0).all():
                x = z
                break
            low = np.flatnonzero(z <= 0)
            x = x + (x[low] / np.maximum(x[low] - z[low], 1e-300)).min() * (z - x)
            keep = x > 1e-14
            keep[low[np.argmin(x[low])]] = False
            used, x = [j for j, k in zip(used, keep, strict=True) if k], x[keep]
            if not used:
                break
        rest = goal - a[:, used] @ x
        if rest @ rest <= NEAR * NEAR:
            return None
    return rest[:-1]


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _farthest(points: DataFrame, directions: np.ndarray) -> list[tuple[float, ...]]:
    """The farthest point in each direction, of equally far ones the largest in order of entries."""

    def run(batches):
        for b in batches:
            x = _matrix(b.column(0))
            if len(x):
                x = x[np.lexsort(x.T[::-1])][::-1]  # the first of equals is the largest
                scores = x @ directions.T
                at = scores.argmax(0)
                yield pa.record_batch([pa.array(np.arange(len(directions), dtype=np.int32)), pa.array(scores[at, np.arange(len(directions))]), pa.array(x[at].tolist(), pa.list_(pa.float64()))], names=["at", "score", "key"])

    found = points.mapInArrow(run, "at int, score double, key array<double>").groupBy("at").agg(F.max(F.struct("score", "key")).alias("m"))
    return [tuple(r["key"]) for r in found.select("at", "m.key").orderBy("at").collect()]


def vertices(points: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(distinct points, vertices), both as key array<double>."""
    x = points.select(F.col(key).cast("array<double>").alias("key"))
    x = x.filter("key is not null and size(key) > 0 and forall(key, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    x = tables.saved(x.distinct(), "points")
    about = x.agg(F.min(F.size("key")).alias("least"), F.max(F.size("key")).alias("d"), F.max(F.array_max(F.transform("key", F.abs))).alias("scale")).first()
    spark = points.sparkSession
    if about["d"] is None:
        return x, x
    if about["least"] != about["d"]:
        raise ValueError("points must have one dimension")
    d, scale = about["d"], about["scale"] or 1.0
    known = dict.fromkeys(_farthest(x, np.vstack([np.eye(d), -np.eye(d)])))
    inside: set[tuple[float, ...]] = set()
    left = x
    while True:
        if len(known) > tables.BROADCAST_ROWS:
            raise ValueError(f"the hull has more than {tables.BROADCAST_ROWS} vertices")
        left = tables.saved(left.mapInArrow(_undecided(spark.sparkContext.broadcast((np.array(list(known)), inside)), scale), "key array<double>, gap double, way array<double>"), "undecided")
        asked = left.orderBy(F.desc("gap"), "key").limit(DIRECTIONS).collect()
        if not asked:
            return x, spark.createDataFrame([(list(k),) for k in known], "key array<double>")
        new = _farthest(x, np.array([r["way"] for r in asked]))
        # what rounding finds again lies no farther than a known vertex
        inside = {tuple(r["key"]) for r, k in zip(asked, new, strict=True) if k in known}
        known.update(dict.fromkeys(new))
        left = left.select("key")


def _undecided(shared, scale: float):
    def run(batches):
        support, inside = shared.value
        done = {tuple(k) for k in support.tolist()} | inside
        for b in batches:
            keys, gaps, ways = [], [], []
            for p in _matrix(b.column(0)) if b.num_rows else ():
                way = None if tuple(p.tolist()) in done else beyond(support, p, scale)
                if way is not None:
                    keys.append(p.tolist())
                    gaps.append(float(np.linalg.norm(way)))
                    ways.append(way.tolist())
            yield pa.record_batch([pa.array(keys, pa.list_(pa.float64())), pa.array(gaps, pa.float64()), pa.array(ways, pa.list_(pa.float64()))], names=["key", "gap", "way"])

    return run


def vertex_fraction(points: DataFrame, key: str = "key") -> DataFrame:
    """points, vertices, fraction."""
    every, found = vertices(points, key)
    n, h = every.count(), found.count()
    return points.sparkSession.createDataFrame([(n, h, h / n if n else None)], "points long, vertices long, fraction double")
