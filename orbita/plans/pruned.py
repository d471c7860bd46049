"""Nearest centers by pivots: a point meets only cells that can hold its nearest center.

Points are dealt into shares and a group's centers into blocks of bounded size; each share
meets each block in a task of its own, so neither a large group nor a popular center is one
task, and nothing is kept but the nearest so far.  There, some centers are pivots; every
center belongs to its nearest pivot's cell, whose radius is the farthest of them.  With u a
point's distance to the nearest center so far, a cell whose pivot is farther than u plus
the cell's radius can't hold anything nearer, by the triangle inequality.  First each point
meets its own pivot's cell, which lowers u; then the cells that are still in reach.  So the
result is exact.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, tables

#: Centers of a block, points of a share, and pivots of a block.
BLOCK_ROWS, SHARE_ROWS, PIVOTS = 1 << 17, 1 << 14, 4096
_SLACK = 1e-9


def _types(df: DataFrame, columns: list[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"{c} {kinds[c]}" for c in columns)


def among(x: np.ndarray, ids: np.ndarray, c: np.ndarray, most: int = PIVOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest of c for each row of x (its id, the smallest of equals; ids ascend), the squared distance, and the distances taken."""
    step = max(math.isqrt(len(c)), -(-len(c) // most), 1)
    pivots = c[::step]
    cell, apart = blocks.closest(c, pivots)
    radius = np.zeros(len(pivots))
    np.maximum.at(radius, cell, np.sqrt(apart))
    order = np.argsort(cell, kind="stable")
    held = np.split(order, np.searchsorted(cell[order], np.arange(1, len(pivots))))
    own, dist = blocks.closest(x, pivots)
    node, measured = ids[::step][own], np.full(len(x), len(pivots))

    def meet(rows: np.ndarray, some: np.ndarray) -> None:
        pick, exact = blocks.closest(x[rows], c[some])
        better = (exact < dist[rows]) | ((exact == dist[rows]) & (ids[some[pick]] < node[rows])) | np.isnan(dist[rows])
        node[rows], dist[rows] = np.where(better, ids[some[pick]], node[rows]), np.where(better, exact, dist[rows])
        measured[rows] += len(some)

    by_own = np.argsort(own, kind="stable")
    for rows in np.split(by_own, np.flatnonzero(np.diff(own[by_own])) + 1):
        if len(rows):
            meet(rows, held[own[rows[0]]])
    p2 = (pivots * pivots).sum(1)
    for k in range(0, len(x), high := max(1, (1 << 23) // len(pivots))):
        some = x[k : k + high]
        x2 = (some * some).sum(1, keepdims=True)
        # the expanded square is off by rounding of its terms
        low = np.sqrt(np.maximum(x2 - 2 * some @ pivots.T + p2, 0)) - np.sqrt(_SLACK * (1 + x2 + p2)) - radius
        low[np.arange(len(some)), own[k : k + high]] = np.inf
        for j in range(len(pivots)):
            rows = np.flatnonzero(low[:, j] <= np.sqrt(dist[k : k + high]) * (1 + _SLACK) + _SLACK) + k
            if len(rows) and len(held[j]):
                meet(rows, held[j])
    return node, dist, measured


def nearest(points: DataFrame, centers: DataFrame, by: list[str], block_rows: int = BLOCK_ROWS, share_rows: int = SHARE_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """by, key_id, node_id, dist2, measured: each point's nearest center, ties to the smaller id, and the distances taken for it.

    Points of groups without centers have no row.
    """
    centers = tables.saved(centers.select(*by, F.col("node_id").cast("long").alias("node_id"), F.transform("center", lambda x: x.cast("double")).alias("center")), "centers")
    points = points.select(*by, F.col("key_id").cast("long").alias("key_id"), "key")
    parts = points.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / share_rows).cast("int").alias("shares"))
    parts = tables.saved(parts.join(centers.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks")), by), "parts")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    of = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    left = points.join(tables.small(parts), by).withColumn("share", of("key_id", "shares")).withColumn("block", every("blocks"))
    right = centers.join(tables.small(parts), by).withColumn("block", of("node_id", "blocks")).withColumn("share", every("shares"))
    group = [*by, "block", "share"]

    def one(p: pa.Table, c: pa.Table) -> pa.Table:
        p, c = p.combine_chunks(), c.sort_by("node_id").combine_chunks()
        if not p.num_rows or not c.num_rows:
            return p.select([*by, "key_id"]).slice(0, 0).append_column("node_id", pa.array([], pa.int64())).append_column("dist2", pa.array([], pa.float64())).append_column("measured", pa.array([], pa.int64()))
        matrix = lambda column, n: blocks._matrix(blocks.one_array(column), n)
        node, dist, measured = among(matrix(p["key"], p.num_rows), c["node_id"].to_numpy(), matrix(c["center"], c.num_rows), pivots)
        return p.select([*by, "key_id"]).append_column("node_id", pa.array(node)).append_column("dist2", pa.array(dist)).append_column("measured", pa.array(measured.astype(np.int64)))

    met = left.select(*group, "key_id", "key").groupBy(*group).cogroup(right.select(*group, "node_id", "center").groupBy(*group)).applyInArrow(one, f"{_types(points, [*by, 'key_id'])}, node_id long, dist2 double, measured long")
    if (parts.agg(F.max("blocks")).first()[0] or 0) < 2:
        return met
    return met.groupBy(*by, "key_id").agg(F.min(F.struct("dist2", "node_id")).alias("m"), F.sum("measured").alias("measured")).select(*by, "key_id", "m.node_id", "m.dist2", "measured")
