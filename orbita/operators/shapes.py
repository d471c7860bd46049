"""Pruning shapes: balls, boxes, hulls, ellipsoids over k-means, random or product-quantised clusters.

A shape table has cluster_id and what its gate needs.  Its gate bounds the
inner product with any member from above, so no key is ever lost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..plans import blocks, tables
from . import clustering, search

ALL = ["one"]
KINDS = ("ball", "box", "hull", "exact_ball", "ellipsoid")


def _one(keys: DataFrame) -> DataFrame:
    return keys.select(F.lit(0).alias("one"), "key_id", "key")


def random_clusters(keys: DataFrame, k: int = 100, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(members: key_id, key, cluster_id), (centers: cluster_id, center): nearest of k seeded keys."""
    points = _one(keys)
    centers = clustering.seeds(points, lambda n: F.least(F.lit(k), n), seed, ALL)
    near = clustering.nearest_assign(points, centers, ALL)
    return points.join(near, [*ALL, "key_id"]).select("key_id", "key", F.col("node_id").alias("cluster_id")), centers.select(F.col("node_id").alias("cluster_id"), "center")


def kmeans_clusters(keys: DataFrame, k: int = 100, iterations: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    points = _one(keys)
    first = clustering.seeds(points, lambda n: F.least(F.lit(k), n), seed, ALL)
    centers = clustering.lloyd(points, first, iterations, ALL)
    near = clustering.nearest_assign(points, centers, ALL)
    return points.join(near, [*ALL, "key_id"]).select("key_id", "key", F.col("node_id").alias("cluster_id")), centers.select(F.col("node_id").alias("cluster_id"), "center")


def pq_clusters(keys: DataFrame, m: int = 8, nbits: int = 8, seed: int = 42, iterations: int = 0) -> tuple[DataFrame, DataFrame]:
    """A cluster is what shares all codes; its center is the mean."""
    codes = clustering.pq_encode(keys, clustering.pq_train(keys, m, nbits, seed, iterations), m)
    ids = codes.groupBy("codes").agg(F.min("key_id").alias("cluster_id"))
    members = keys.select("key_id", "key").join(codes.join(ids, "codes"), "key_id").select("key_id", "key", "cluster_id")
    one = members.withColumn("one", F.lit(0))
    centers = clustering.means(one.select("one", "key_id", "key"), one.select("one", "key_id", F.col("cluster_id").alias("node_id")), ALL)
    return members, centers.select(F.col("node_id").alias("cluster_id"), "center")


def balls(members: DataFrame, centers: DataFrame) -> DataFrame:
    """center, radius; a center without members keeps radius 0."""
    far = members.join(centers, "cluster_id").groupBy("cluster_id").agg(F.max(vec.distance("key", "center")).alias("radius"))
    return centers.join(far, "cluster_id", "left").withColumn("radius", F.coalesce("radius", F.lit(0.0)))


def boxes(members: DataFrame, centers: DataFrame) -> DataFrame:
    """lo, hi by component."""
    parts = members.select("cluster_id", F.posexplode("key").alias("i", "x")).groupBy("cluster_id", "i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    got = parts.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("s")).select("cluster_id", F.transform("s", lambda s: s["lo"].cast("double")).alias("lo"), F.transform("s", lambda s: s["hi"].cast("double")).alias("hi"))
    return centers.join(got, "cluster_id", "left").select("cluster_id", F.coalesce("lo", "center").alias("lo"), F.coalesce("hi", "center").alias("hi"))


def hulls(members: DataFrame, centers: DataFrame) -> DataFrame:
    """The points themselves: their largest inner product is the hull's.  Stays one row a member, so no cluster is gathered."""
    return members.select("cluster_id", F.transform("key", lambda x: x.cast("double")).alias("point"))


def smallest_ball(x: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Badoiu and Clarkson's walk to the farthest point; the radius then covers all points, whatever the center."""
    c = x.mean(0)
    for i in range(1, rounds + 1):
        c = c + (x[((x - c) ** 2).sum(1).argmax()] - c) / (i + 1)
    return c, float(np.sqrt(((x - c) ** 2).sum(1).max()))


def covering_ellipsoid(x: np.ndarray, tol: float = 1e-5, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """(center, A^-1) by Khachiyan's weights, then scaled till every point is inside; a ball where points are few or flat."""
    n, d = x.shape
    if n > d + 1 and np.linalg.matrix_rank(x - x.mean(0)) == d:
        q = np.c_[x, np.ones(n)].T
        u = np.full(n, 1 / n)
        for _ in range(rounds):
            m = np.einsum("ij,ji->i", q.T @ np.linalg.inv((q * u) @ q.T), q)
            j = int(m.argmax())
            step = (m[j] - d - 1) / ((d + 1) * (m[j] - 1))
            new = (1 - step) * u
            new[j] += step
            gap, u = np.linalg.norm(new - u), new
            if gap < tol:
                break
        c = u @ x
        inverse = d * ((x - c).T * u) @ (x - c)
        reach = np.einsum("ij,jk,ik->i", x - c, np.linalg.inv(inverse), x - c).max()
        return c, inverse * max(1.0, reach * (1 + 1e-9))
    c, r = smallest_ball(x)
    return c, np.eye(d) * r * r


#: Points that a cluster's core set gains in a round, and rounds at most; sets end when nothing is farther than this share.
GAINED, ROUNDS, NEAR = 8, 60, 0.002


def _cored(members: DataFrame, fit, schema: str, distance) -> DataFrame:
    """Shapes from core sets: each round fits a shape to a cluster's few points and adds the members farthest outside.

    A round is one aggregate over all members, whose farthest are found by shares of a cluster, so no
    cluster is gathered; what grows is a table of clusters with at most GAINED points a round.  A
    cluster is done when its farthest member is inside to NEAR, and its shape is then scaled to hold it.
    """
    members = tables.saved(members.select("cluster_id", "key_id", F.transform("key", lambda x: x.cast("double")).alias("key")), "members")
    # a few more points than an ellipsoid needs
    start = F.pmod(F.xxhash64("key_id", F.lit(1)), (2 * (F.size("key") + 1)).cast("long"))
    core = members.groupBy("cluster_id", start.alias("share")).agg(F.min_by("key", "key_id").alias("key"))
    core = tables.saved(core.groupBy("cluster_id").agg(F.collect_list("key").alias("core")), "core")
    done = []
    for k in range(ROUNDS):
        shapes = tables.saved(core.mapInPandas(lambda frames: map(fit, frames), f"cluster_id long, core array<array<double>>, {schema}"), "fit")
        share = F.pmod(F.xxhash64("key_id"), F.lit(GAINED))
        far = members.join(tables.small(shapes.drop("core")), "cluster_id").groupBy("cluster_id", share.alias("share")).agg(F.max(F.struct(distance().alias("reach"), "key_id", "key")).alias("m"))
        gained = far.groupBy("cluster_id").agg(F.max("m.reach").alias("reach"), F.collect_list(F.when(F.col("m.reach") > 1 + NEAR / 2, F.col("m.key"))).alias("new"))
        met = tables.saved(shapes.join(gained, "cluster_id"), "met")
        last = F.lit(k == ROUNDS - 1)
        done.append(met.filter((F.col("reach") <= 1 + NEAR) | last).drop("core", "new"))
        core = met.filter((F.col("reach") > 1 + NEAR) & ~last).select("cluster_id", F.array_union("core", "new").alias("core"))
        if core.isEmpty():
            break
    return reduce(DataFrame.unionByName, done)


def exact_balls(members: DataFrame, centers: DataFrame | None = None) -> DataFrame:
    """Smallest enclosing balls to a share of NEAR; every member is inside."""

    def fit(p):
        balls = [smallest_ball(np.stack(c).astype(float), 500) for c in p["core"]]
        return p.assign(center=[c.tolist() for c, _ in balls], radius=[r for _, r in balls])

    reach = lambda: F.when(F.col("radius") > 0, vec.distance("key", "center") / F.col("radius")).when(vec.distance("key", "center") > 0, 2 + vec.distance("key", "center")).otherwise(0.0)
    found = _cored(members, fit, "center array<double>, radius double", reach)
    # the farthest member, not the fit, says how far the ball goes
    far = members.join(tables.small(found.select("cluster_id", "center")), "cluster_id").groupBy("cluster_id").agg(F.max(vec.distance("key", "center")).alias("radius"))
    return found.select("cluster_id", "center").join(far, "cluster_id")


def ellipsoids(members: DataFrame, centers: DataFrame | None = None, tol: float = 1e-5, rounds: int = 1000) -> DataFrame:
    """Covering ellipsoids of small volume; every member is inside."""

    def fit(p):
        got = [covering_ellipsoid(np.stack(c).astype(float), tol, rounds) for c in p["core"]]
        shapes = [np.linalg.pinv(a) for _, a in got]
        # directions without extent: whatever leaves them is outside
        flat = [np.eye(len(a)) - s @ a for (_, a), s in zip(got, shapes, strict=True)]
        return p.assign(center=[c.tolist() for c, _ in got], inv_shape=[a.tolist() for _, a in got], shape=[s.tolist() for s in shapes], flat=[f.tolist() for f in flat])

    def reach():
        d = F.zip_with("key", "center", lambda x, c: x - c)
        form = lambda m: F.greatest(vec.dot(F.transform(m, lambda r: vec.dot(r, d)), d), F.lit(0.0))
        return F.when(form("flat") > 1e-12 * (1 + vec.dot("key", "key")), 2.0).otherwise(F.sqrt(form("shape")))

    matrix = "array<array<double>>"
    found = _cored(members, fit, f"center array<double>, inv_shape {matrix}, shape {matrix}, flat {matrix}", reach)
    scale = F.greatest(F.lit(1.0), F.col("reach") * F.col("reach") * (1 + 1e-9))
    return found.select("cluster_id", "center", F.transform("inv_shape", lambda r: F.transform(r, lambda x: x * scale)).alias("inv_shape"))


MAKE = {"ball": balls, "box": boxes, "hull": hulls, "exact_ball": exact_balls, "ellipsoid": ellipsoids}


def bounds(kind: str, shapes: DataFrame, q: DataFrame) -> DataFrame:
    """(query_id, cluster_id, bound): the largest inner product that a shape allows; q (query_id, q, q_norm) is counted, shapes are many."""
    if kind == "hull" and q.count() <= tables.BROADCAST_ROWS:
        return blocks.highest(shapes.select("cluster_id", "point"), q)
    both = shapes.join(search.small(q.select("query_id", "q", "q_norm")))
    bound = {
        "ball": lambda: vec.ball_bound("center", "radius", "q", "q_norm"),
        "exact_ball": lambda: vec.ball_bound("center", "radius", "q", "q_norm"),
        "box": lambda: vec.box_bound("lo", "hi", "q"),
        "hull": lambda: vec.dot("q", "point"),
        "ellipsoid": lambda: vec.ellipsoid_bound("center", "inv_shape", "q"),
    }[kind]()
    if kind != "hull":  # a row a cluster
        return both.select("query_id", "cluster_id", bound.alias("bound"))
    return both.groupBy("query_id", "cluster_id").agg(F.max(bound).alias("bound"))


def intersecting(kind: str, shapes: DataFrame, q: DataFrame) -> DataFrame:
    """(query_id, clusters, hit, pct): shapes that reach a query's threshold; q has query_id, q, q_norm, threshold."""
    q = tables.saved(q.select("query_id", "q", "q_norm", "threshold"), "asked")
    per = bounds(kind, shapes, q).join(search.small(q.select("query_id", "threshold")), "query_id")
    got = per.groupBy("query_id").agg(F.count(F.lit(1)).alias("clusters"), F.sum((F.col("bound") >= F.col("threshold")).cast("long")).alias("hit"))
    return q.select("query_id").join(got, "query_id", "left").select("query_id", F.coalesce("clusters", F.lit(0)).alias("clusters"), F.coalesce("hit", F.lit(0)).alias("hit"), F.coalesce(100.0 * F.col("hit") / F.col("clusters"), F.lit(0.0)).alias("pct"))


def sweep(found: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """Bounds (by, query_id, cluster_id, bound) -> by, query_id, threshold, clusters, hit, pct for all thresholds in one pass.

    A bound counts once, at the last threshold that it reaches; what stands there and after is what reaches a threshold.
    """
    steps = sorted(set(thresholds))
    reached = F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= F.col("bound")))
    hist = found.groupBy(*by, "query_id", reached.alias("step")).agg(F.count(F.lit(1)).alias("c"))
    rows = hist.groupBy(*by, "query_id").agg(F.sum("c").alias("clusters"), F.collect_list(F.struct("step", "c")).alias("h"))  # a row a threshold
    each = rows.select(*by, "query_id", "clusters", "h", F.posexplode(F.array(*map(F.lit, steps))).alias("i", "threshold"))
    hit = F.aggregate(F.filter("h", lambda x: x["step"] > F.col("i")), F.lit(0).cast("long"), lambda s, x: s + x["c"])
    return each.select(*by, "query_id", "threshold", "clusters", hit.alias("hit")).withColumn("pct", 100.0 * F.col("hit") / F.col("clusters"))


def summary(pct: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by, query_id, pct) of some queries -> how many, and mean, deviation, least and largest pct."""
    return pct.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("queries"), F.avg("pct").alias("mean"), F.stddev_pop("pct").alias("std"), F.min("pct").alias("low"), F.max("pct").alias("high"))
