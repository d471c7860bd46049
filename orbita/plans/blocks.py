"""Bulk inner products and nearest centers: Arrow batches times a broadcast matrix.

For sides that are counted first and small; otherwise callers take the join.
What a product of matrices leaves near a threshold is computed again in the order
of the SQL expression, so both ways give the same set, and hits the same scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _matrix(column, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, -1)


def ordered(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, summed in the order of the SQL expression."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += x[:, d] * y[:, d]
    return total


@dataclass(frozen=True)
class Asked:
    """Queries of one head, by column; ``slot`` numbers the queries of all heads."""

    slot: np.ndarray
    query_id: np.ndarray
    q_head: np.ndarray
    q: np.ndarray
    norm: np.ndarray
    threshold: np.ndarray
    scaling: np.ndarray


def asked(queries: DataFrame) -> dict[int, Asked]:
    """Queries by head, in the order of their ids; they are collected, so callers bound them."""
    t = queries.select("kv_head", "query_id", "q_head", F.transform("q", lambda x: x.cast("double")).alias("q"), "q_norm", "threshold", "scaling").toArrow().sort_by([("kv_head", "ascending"), ("query_id", "ascending"), ("q_head", "ascending")]).combine_chunks()
    heads, out = t["kv_head"].to_numpy(), {}
    for h in np.unique(heads):
        some = t.take(pa.array(np.flatnonzero(heads == h)))
        column = lambda c: some[c].to_numpy().astype(np.float64)  # noqa: E731, B023
        out[int(h)] = Asked(np.flatnonzero(heads == h), some["query_id"].to_numpy(), some["q_head"].to_numpy().astype(np.int32), _matrix(one_array(some["q"]), len(some)), column("q_norm"), column("threshold"), column("scaling"))
    return out


def one_array(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over all cores, whatever files they lie in."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism)


#: Pairs of a block: a product that stays in a core's cache.
PAIRS = 1 << 18


def tiles(rows: int, columns: int, most: int = PAIRS):
    """Slices of rows and of columns, whose products have at most so many pairs."""
    wide = max(1, min(columns, 2048))
    for k in range(0, rows, high := max(1, most // wide)):
        for j in range(0, columns, wide):
            yield slice(k, k + high), slice(j, j + wide)


def hits(x: np.ndarray, side: Asked) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of x, places in side, scores) of the pairs that reach their query's threshold, in parts of PAIRS about."""
    reach = np.sqrt((x * x).sum(1).max(initial=0))
    least = side.threshold - 1e-12 * (1 + side.norm * reach + np.abs(side.threshold))
    x_t, q_t, part, held = np.ascontiguousarray(x.T), np.ascontiguousarray(side.q.T), [], 0
    for r, c in tiles(len(x), len(side.slot)):
        t = side.threshold[c]
        # by rows and columns at once, nonzero takes several times as long
        k, j = np.divmod(np.flatnonzero(x[r] @ side.q[c].T >= least[c]), len(t))
        score = np.zeros(len(k))
        for a, b in zip(x_t[:, r], q_t[:, c], strict=True):  # in the order of the SQL expression
            score += a[k] * b[j]
        kept = score >= t[j]
        part.append((k[kept] + r.start, j[kept] + c.start, score[kept]))
        held += len(part[-1][0])
        if held >= PAIRS:
            yield tuple(map(np.concatenate, zip(*part, strict=True)))
            part, held = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*part, strict=True)))


HITS = "query_id long, q_head int, kv_head int, key_id long, score double"


def _rows(head: int, ids: np.ndarray, side: Asked, k: np.ndarray, j: np.ndarray, score: np.ndarray) -> pa.RecordBatch:
    return pa.record_batch([pa.array(side.query_id[j]), pa.array(side.q_head[j]), pa.array(np.full(len(j), head, np.int32)), pa.array(ids[k]), pa.array(score)], names=["query_id", "q_head", "kv_head", "key_id", "score"])


def _numbers(keys: DataFrame) -> DataFrame:
    whole = F.col("key").isNotNull() & F.forall("key", lambda x: x.isNotNull())
    return keys.selectExpr("cast(kv_head as int) kv_head", "cast(key_id as long) key_id", "key").filter(whole)


def scan(keys: DataFrame, queries: DataFrame, every: bool = False) -> DataFrame:
    """keys (kv_head, key_id, key) x queries -> hits (``every``: all pairs); queries are collected, so callers bound them.

    Keys are dealt: a file's row group is read by one task, which would be the whole work.
    """
    sides = keys.sparkSession.sparkContext.broadcast(asked(queries))

    def run(batches):
        for b in batches:
            heads, ids, vectors = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), b.num_rows)
            for h in np.unique(heads):
                if h not in sides.value:
                    continue
                own, side = np.flatnonzero(heads == h), sides.value[h]
                if vectors.shape[1] != side.q.shape[1]:
                    raise ValueError("queries and keys have different dimensions")
                if every:
                    for r, c in tiles(len(own), len(side.slot)):
                        score = vectors[own[r]] @ side.q[c].T * side.scaling[c]
                        k, j = np.indices(score.shape).reshape(2, -1)
                        yield _rows(h, ids[own], side, k + r.start, j + c.start, score.ravel())
                else:
                    for k, j, score in hits(vectors[own], side):
                        yield _rows(h, ids[own], side, k, j, score * side.scaling[j])

    return dealt(_numbers(keys)).mapInArrow(run, HITS)


#: Queries of a row of surviving ones.
ASKED = 2048


def _pairs(heads: np.ndarray, lists, sides: dict) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(head, rows, places in its side) that are still to be looked at: those in a row's list, or all of the head's queries where it has none."""
    whole = np.asarray(lists.is_null())
    for h in np.unique(heads[whole]):
        if h in sides:
            own = np.flatnonzero(whole & (heads == h))
            for r, c in tiles(len(own), len(sides[h].slot)):
                yield int(h), own[r], np.arange(c.start, min(c.stop, len(sides[h].slot)))
    for h in np.unique(heads[~whole]):
        yield int(h), np.flatnonzero(~whole & (heads == h)), None


def _listed(lists, rows: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, places), pair by pair, in parts of about PAIRS."""
    size = lists.value_lengths().to_numpy(zero_copy_only=False)[rows]
    part = np.cumsum(size) // PAIRS
    for p in np.unique(part):
        some = rows[part == p]
        places = lists.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
        yield np.repeat(some, size[part == p]), places


def surviving(nodes: DataFrame, sides, mode: str) -> DataFrame:
    """nodes (kv_head, node_id, center, radius, asked) -> kv_head, node_id, asked: the queries, by their places in the head's side, that can't exclude the node.

    ``asked`` before is what is left above (null: all queries of the head).  A node has a row for at most ASKED
    queries, so what levels hand down are numbers of queries, not the queries.
    """

    def kept(side: Asked, c, r, j) -> np.ndarray:
        bound = ordered(c, side.q[j]) + side.norm[j] * r
        return bound + 1e-9 * (1 + np.abs(side.threshold[j])) >= side.threshold[j] if mode == "exact" else bound > side.threshold[j]

    def run(batches):
        for b in batches:
            heads, ids, centers, radius, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), b.num_rows), b.column(3).to_numpy(), b.column(4)
            for h, rows, places in _pairs(heads, lists, sides.value):
                side = sides.value[h]
                if places is not None:
                    c, r, t = centers[rows], radius[rows], side.threshold[places]
                    rough = c @ side.q[places].T
                    rough += r[:, None] * side.norm[places]
                    off = 1e-8 * (1 + np.abs(t)) + 1e-12 * side.norm[places] * (np.sqrt((c * c).sum(1).max()) + r.max())
                    i, j = np.nonzero(rough >= t - off)
                    close = np.flatnonzero(rough[i, j] <= t[j] + off[j])
                    fine = np.ones(len(i), bool)
                    fine[close] = kept(side, c[i[close]], r[i[close]], places[j[close]])
                    yield from _lists(h, ids, rows[i[fine]], places[j[fine]])
                else:
                    for i, j in _listed(lists, rows):
                        fine = kept(side, centers[i], radius[i], j)
                        yield from _lists(h, ids, i[fine], j[fine])

    return nodes.selectExpr("cast(kv_head as int) kv_head", "cast(node_id as long) node_id", "center", "cast(radius as double) radius", "asked").mapInArrow(run, "kv_head int, node_id long, asked array<int>")


def _lists(head: int, ids: np.ndarray, rows: np.ndarray, places: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(rows):
        starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(rows)], pa.int32()), pa.array(places, pa.int32()))
        yield pa.record_batch([pa.array(np.full(len(starts), head, np.int32)), pa.array(ids[rows[starts]]), lists], names=["kv_head", "node_id", "asked"])


def scored(keys: DataFrame, sides, mode: str) -> DataFrame:
    """keys (kv_head, key_id, key, asked) -> hits (scan: all) of the queries that each key is asked by."""

    def run(batches):
        for b in batches:
            heads, ids, vectors, lists = b.column(0).to_numpy(), b.column(1).to_numpy(), _matrix(b.column(2), b.num_rows), b.column(3)
            for h in np.unique(heads):
                side = sides.value[int(h)]
                if vectors.shape[1] != side.q.shape[1]:
                    raise ValueError("queries and keys have different dimensions")
                for i, j in _listed(lists, np.flatnonzero(heads == h)):
                    score = ordered(vectors[i], side.q[j])
                    if mode == "exact":
                        kept = score >= side.threshold[j]
                        i, j, score = i[kept], j[kept], score[kept]
                    yield _rows(int(h), ids, side, i, j, score * side.scaling[j])

    return keys.selectExpr("cast(kv_head as int) kv_head", "cast(key_id as long) key_id", "key", "asked").mapInArrow(run, HITS)


def asked_by(nodes: DataFrame, sides) -> DataFrame:
    """nodes (kv_head, asked, keys) -> query_id, q_head, nodes and keys that each query is left with."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            heads, lists, weight = b.column(0).to_numpy(), b.column(1), b.column(2).to_numpy()
            for h in np.unique(heads):
                total = sums.setdefault(int(h), np.zeros((2, len(sides.value[int(h)].slot)), np.int64))
                for i, j in _listed(lists, np.flatnonzero(heads == h)):
                    total[0] += np.bincount(j, minlength=total.shape[1])
                    total[1] += np.bincount(j, weights=weight[i], minlength=total.shape[1]).astype(np.int64)
        for h, total in sums.items():
            some, side = np.flatnonzero(total[0]), sides.value[h]
            yield pa.record_batch([pa.array(side.query_id[some]), pa.array(side.q_head[some]), pa.array(total[0][some]), pa.array(total[1][some])], names=["query_id", "q_head", "nodes", "keys"])

    parts = nodes.select("kv_head", "asked", F.col("keys").cast("long").alias("keys")).mapInArrow(run, "query_id long, q_head int, nodes long, keys long")
    return parts.groupBy("query_id", "q_head").agg(F.sum("nodes").alias("nodes"), F.sum("keys").alias("keys"))


def filled(keys: DataFrame, queries: DataFrame, hits: DataFrame, fill: float) -> DataFrame:
    """A row for each query and key, ``fill`` where hits have none; a key's hits travel in one row beside it."""
    sides = keys.sparkSession.sparkContext.broadcast(asked(queries.withColumn("threshold", F.lit(0.0)).withColumn("q", F.array(F.lit(0.0)))))
    own = hits.groupBy("kv_head", "key_id").agg(F.collect_list(F.struct("query_id", "q_head", "score")).alias("found"))

    def run(batches):
        for b in batches:
            for h, key, found in zip(b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2), strict=True):
                if h not in sides.value:
                    continue
                side = sides.value[h]
                score = np.full(len(side.slot), fill)
                for f in found.as_py() or ():
                    at = np.searchsorted(side.query_id, f["query_id"])
                    while side.q_head[at] != f["q_head"]:
                        at += 1
                    score[at] = fill if f["score"] is None else f["score"]
                yield _rows(h, np.full(1, key), side, np.zeros(len(score), int), np.arange(len(score)), score)

    rows = keys.selectExpr("cast(kv_head as int) kv_head", "cast(key_id as long) key_id").join(own, ["kv_head", "key_id"], "left")
    return rows.mapInArrow(run, HITS)


def grouped(batch: pa.RecordBatch, columns: int, known) -> dict[tuple, list[int]]:
    """Rows of each known group; a group is what the first columns say."""
    at: dict[tuple, list[int]] = {}
    for i, g in enumerate(zip(*(batch.column(k).to_pylist() for k in range(columns)), strict=True)):
        if g in known:
            at.setdefault(g, []).append(i)
    return at


def distance2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed in the order of the SQL expression."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += (x[:, d] - y[:, d]) ** 2
    return total


def closest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the first of its nearest rows of c, and the squared distance.

    Rows too close to tell apart by the expanded square are measured again, in their order.
    """
    pick, dist, c2 = np.zeros(len(x), np.int64), np.full(len(x), np.nan), (c * c).sum(1)
    for k in range(0, len(x), high := max(1, PAIRS // len(c))):
        some = x[k : k + high]
        rough = some @ (-2 * c.T)
        rough += c2
        least = rough.min(1)
        i, j = np.nonzero(rough <= (least + 1e-9 * (1 + (some * some).sum(1)) + 1e-12 * np.abs(least))[:, None])
        exact = distance2(some[i], c[j])
        order = np.lexsort((j, exact, i))
        rows, first = np.unique(i[order], return_index=True)
        pick[k + rows], dist[k + rows] = j[order[first]], exact[order[first]]
    return pick, dist


def nearest(points: DataFrame, centers: DataFrame, by: list[str]) -> DataFrame:
    """points (by, key_id, key) -> by, key_id, node_id, dist2; centers are collected, so callers bound them; ties to the smaller node_id; points of groups without centers have no row."""
    groups: dict[tuple, list] = {}
    for r in centers.select(*by, "node_id", "center").orderBy("node_id").collect():
        groups.setdefault(tuple(r[c] for c in by), []).append(r)
    sides = points.sparkSession.sparkContext.broadcast({g: (np.array([r["node_id"] for r in rs]), np.array([r["center"] for r in rs], np.float64)) for g, rs in groups.items()})

    def run(batches):
        for b in batches:
            ids, vectors = b.column(len(by)).to_numpy(), _matrix(b.column(len(by) + 1), b.num_rows)
            node, dist, kept = np.zeros(len(ids), np.int64), np.full(len(ids), np.nan), np.zeros(len(ids), bool)
            for g, own in grouped(b, len(by), sides.value).items():
                n, c = sides.value[g]
                kept[own] = True
                pick, dist[own] = closest(vectors[own], c)
                node[own] = n[pick]
            yield pa.record_batch([*b.columns[: len(by) + 1], pa.array(node), pa.array(dist)], names=[*by, "key_id", "node_id", "dist2"]).filter(pa.array(kept))

    types = {f.name: f.dataType.simpleString() for f in points.schema}
    return points.select(*by, "key_id", "key").mapInArrow(run, ", ".join(f"{c} {types[c]}" for c in by) + ", key_id long, node_id long, dist2 double")


#: Queries of a row of maxima.
WIDE = 1024


def highest(points: DataFrame, queries: DataFrame) -> DataFrame:
    """points (cluster_id, point) x queries (query_id, q, q_norm) -> query_id, cluster_id, bound: the largest inner product with a cluster's points.

    Points are sorted by cluster in ranges; a range makes a row of maxima for a cluster and WIDE queries, and the
    few rows of a cluster that lies in several ranges are joined.  Queries are collected, so callers bound them.
    """
    one = queries.select(F.lit(0).alias("kv_head"), "query_id", F.lit(0).alias("q_head"), "q", "q_norm", F.lit(0.0).alias("threshold"), F.lit(1.0).alias("scaling"))
    side = points.sparkSession.sparkContext.broadcast(asked(one))
    schema = "part int, cluster_id long, top array<double>"

    def rows(cluster: int, top: np.ndarray) -> pa.RecordBatch:
        parts = [top[j : j + WIDE] for j in range(0, len(top), WIDE)]
        return pa.record_batch([pa.array(np.arange(len(parts), dtype=np.int32)), pa.array(np.full(len(parts), cluster)), pa.array(parts, pa.list_(pa.float64()))], names=["part", "cluster_id", "top"])

    def run(batches):
        if 0 not in side.value:
            return
        q, last, top = side.value[0].q, None, None
        for b in batches:
            ids, x = b.column(0).to_numpy(), _matrix(b.column(1), b.num_rows)
            for own in np.split(np.arange(len(ids)), np.flatnonzero(np.diff(ids)) + 1) if len(ids) else ():
                if ids[own[0]] != last:
                    if last is not None:
                        yield rows(last, top)
                    last, top = int(ids[own[0]]), np.full(len(q), -np.inf)
                for k, j in tiles(len(q), len(own)):
                    pick = (q[k] @ x[own[j]].T).argmax(1)
                    np.maximum(top[k], ordered(x[own[j]][pick], q[k]), out=top[k])
        if last is not None:
            yield rows(last, top)

    def told(batches):
        last, top = None, None

        def out():
            ids = side.value[0].query_id[last[0] * WIDE :][: len(top)]
            return pa.record_batch([pa.array(ids), pa.array(np.full(len(top), last[1])), pa.array(top)], names=["query_id", "cluster_id", "bound"])

        for b in batches:
            for part, cluster, new in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                new = new.values.to_numpy()
                if (part, cluster) == last:
                    top = np.maximum(top, new)
                    continue
                if last is not None:
                    yield out()
                last, top = (part, cluster), new
        if last is not None:
            yield out()

    ranged = points.selectExpr("cast(cluster_id as long) cluster_id", "point").withColumn("deal", F.xxhash64("point"))
    ranged = ranged.repartitionByRange(2 * points.sparkSession.sparkContext.defaultParallelism, "cluster_id", "deal").sortWithinPartitions("cluster_id").select("cluster_id", "point")
    tops = ranged.mapInArrow(run, schema)
    return tops.repartition("part", "cluster_id").sortWithinPartitions("part", "cluster_id").mapInArrow(told, "query_id long, cluster_id long, bound double")
