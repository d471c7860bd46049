"""Traversal, recall and distribution figures."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import thresholds, vec
from ..plans import blocks, ranks, selection, tables
from . import search
from .index import Index


def traversal(index: Index, q: DataFrame, mode: str = "exact") -> DataFrame:
    """query_id, q_head, level, total, active; level 0 counts the keys scored."""
    if q.count() <= tables.BROADCAST_ROWS:
        sides, parts = index.keys.sparkSession.sparkContext.broadcast(blocks.asked(q)), []
        held = index.leaf.groupBy("kv_head", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("keys"))
        for level, nodes in search.survivors(index, sides, mode).items():
            got = blocks.asked_by(nodes.join(held, ["kv_head", "node_id"], "left").fillna(0, ["keys"]) if level == 1 else nodes.withColumn("keys", F.lit(0)), sides)
            each = F.explode(F.array(*(F.struct(F.lit(n).alias("level"), F.col(c).alias("active")) for n, c in ((level, "nodes"), (0, "keys"))[: 2 if level == 1 else 1]))).alias("x")
            parts.append(got.select("query_id", "q_head", each).select("query_id", "q_head", "x.active", "x.level"))
    else:
        alive = search.active(index, q, mode)
        parts = [a.groupBy("query_id", "q_head").agg(F.count(F.lit(1)).alias("active")).withColumn("level", F.lit(level)) for level, a in alive.items()]
        parts.append(alive[1].withColumnRenamed("node_id", "parent_id").join(index.leaf, ["kv_head", "parent_id"]).groupBy("query_id", "q_head").agg(F.count(F.lit(1)).alias("active")).withColumn("level", F.lit(0)))
    seen = reduce(DataFrame.unionByName, parts)
    sizes = index.nodes.groupBy("level", "kv_head").agg(F.count(F.lit(1)).alias("total")).unionByName(index.keys.groupBy("kv_head").agg(F.count(F.lit(1)).alias("total")).withColumn("level", F.lit(0)))
    grid = search.small(q).select("query_id", "q_head", "kv_head").join(sizes, "kv_head")
    return grid.join(seen, ["query_id", "q_head", "level"], "left").select("query_id", "q_head", "level", "total", F.coalesce("active", F.lit(0)).alias("active"))


def rates(index: Index, q: DataFrame, mode: str = "exact") -> DataFrame:
    """query_id, q_head, parents_total, parents_passed, parent_rate, children_total, children_scored, child_rate; level 1 are the parents."""
    seen = traversal(index, q, mode).filter("level <= 1")
    at = lambda level, c: F.max(F.when(F.col("level") == level, F.col(c)))
    rows = seen.groupBy("query_id", "q_head").agg(at(1, "total").alias("parents_total"), at(1, "active").alias("parents_passed"), at(0, "total").alias("children_total"), at(0, "active").alias("children_scored"))
    return rows.withColumn("parent_rate", F.col("parents_passed") / F.col("parents_total")).withColumn("child_rate", F.col("children_scored") / F.col("children_total"))


def scanned_fraction(index: Index, q: DataFrame, mode: str = "exact") -> DataFrame:
    """query_id, q_head, fraction of the keys that are scored."""
    return traversal(index, q, mode).filter("level = 0").select("query_id", "q_head", (F.col("active") / F.col("total")).alias("fraction"))


def recall(truth: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, q_head, recall; only queries with true hits (others have recall 1)."""
    on = ["query_id", "q_head", "key_id"]
    got = truth.select(on).join(hits.select(on).withColumn("found", F.lit(1)), on, "left")
    return got.groupBy("query_id", "q_head").agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall"))


def ball_classes(balls: DataFrame, q: DataFrame) -> DataFrame:
    """query_id, side, balls."""
    return balls.join(search.small(q.select("query_id", "q", "threshold"))).groupBy("query_id", vec.ball_side("center", "radius", "q", "threshold").alias("side")).agg(F.count(F.lit(1)).alias("balls"))


def knn_radius(points: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, radius: distance to the k-th neighbour, the point itself counting as the first."""
    if queries.count() <= tables.BROADCAST_ROWS:
        rows = points.select(F.lit(0).alias("kv_head"), F.col("key_id").alias("id"), F.col("key").alias("point"), F.lit(0.0).alias("radius"))
        near = selection.least(rows, queries.withColumn("q_head", F.lit(0)).withColumn("kv_head", F.lit(0)), k + 1)
        return near.filter(F.size("some") > k).select("query_id", F.sqrt(F.col("some")[k]["value"]).alias("radius"))
    d = points.join(search.small(queries.select("query_id", "q"))).select("query_id", vec.distance("q", "key").alias("score"))
    return thresholds.selected(d, ["query_id"], {"radius": lambda n: F.lit(k + 1)}).filter("radius is not null").select("query_id", "radius")


def moments(keys: DataFrame) -> DataFrame:
    """Per component: mean, std, least, largest, median, skewness, kurtosis."""
    x = keys.select(F.posexplode("key").alias("dim", "v")).select("dim", F.col("v").cast("double").alias("v"))
    return x.groupBy("dim").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile("v", 0.5).alias("median"), F.skewness("v").alias("skew"), F.kurtosis("v").alias("kurt"))


def norm_stats(keys: DataFrame, by: list[str]) -> DataFrame:
    n = vec.norm("key")
    return keys.groupBy(*by).agg(F.avg(n).alias("mean"), F.stddev_samp(n).alias("std"), F.min(n).alias("low"), F.max(n).alias("high"))


def normal_fit(values: DataFrame) -> DataFrame:
    """(v) -> closed-form normal and uniform fits with log-likelihood, AIC and BIC."""
    s = values.agg(F.count("v").alias("n"), F.avg("v").alias("mu"), F.var_pop("v").alias("var"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    normal = -F.col("n") / 2 * (F.log(2 * F.lit(3.141592653589793) * F.col("var")) + 1)
    uniform = -F.col("n") * F.log(F.col("hi") - F.col("lo"))
    rows = s.select(F.explode(F.array(F.struct(F.lit("normal").alias("name"), F.col("mu").alias("a"), F.sqrt("var").alias("b"), normal.alias("loglik"), F.col("n")), F.struct(F.lit("uniform").alias("name"), F.col("lo").alias("a"), F.col("hi").alias("b"), uniform.alias("loglik"), F.col("n")))).alias("x")).select("x.*")
    return rows.select("name", "a", "b", "loglik", (4 - 2 * F.col("loglik")).alias("aic"), (2 * F.log("n") - 2 * F.col("loglik")).alias("bic"))


def mixture(values: DataFrame, k: int = 2, rounds: int = 10) -> tuple[list[tuple[float, float, float]], float, int]:
    """(v) -> [(weight, mean, variance)], log-likelihood and n of a mixture of k normals, by EM.

    It starts with equal weights, means spread evenly between least and largest, and the variance of
    all.  A round is one aggregate; what goes round the driver is three numbers a component.
    """
    s = values.agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.var_pop("v").alias("var")).first()
    if not s["n"] or not s["var"]:
        raise ValueError("a mixture needs values that differ")
    parts = [(1 / k, s["lo"] + (j + 0.5) * (s["hi"] - s["lo"]) / k, s["var"]) for j in range(k)]
    for _ in range(rounds):
        r, _ = _shares(parts)
        cells = [(F.sum(r[j]), F.sum(r[j] * (F.col("v") - mu)), F.sum(r[j] * (F.col("v") - mu) * (F.col("v") - mu))) for j, (_, mu, _) in enumerate(parts)]
        got = values.agg(*(c.alias(f"c{j}_{i}") for j, cell in enumerate(cells) for i, c in enumerate(cell))).first()
        new = []
        for j, (w, mu, var) in enumerate(parts):
            n, first, second = (got[f"c{j}_{i}"] for i in range(3))
            shift = first / n if n else 0.0
            # a component that holds nothing, or one value, keeps a little breadth
            new.append((n / s["n"], mu + shift, max(second / n - shift * shift, 1e-9 * s["var"])) if n else (0.0, mu, var))
        parts = new
    return parts, values.agg(F.sum(_shares(parts)[1])).first()[0], s["n"]


def _shares(parts: list[tuple[float, float, float]]) -> tuple[list, object]:
    """Each component's share of a value, and the log of the value's density."""
    logs = [F.lit(math.log(w) if w > 0 else -1e300) - 0.5 * (math.log(2 * math.pi * var) + (F.col("v") - mu) * (F.col("v") - mu) / var) for w, mu, var in parts]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    total = reduce(lambda a, b: a + b, (F.exp(x - top) for x in logs))
    return [F.exp(x - top) / total for x in logs], top + F.log(total)


def mixture_fit(values: DataFrame, k: int = 2, rounds: int = 10) -> DataFrame:
    """part, weight, mean, std of each component, and loglik, aic, bic of the whole."""
    parts, loglik, n = mixture(values, k, rounds)
    free = 3 * k - 1
    rows = [(j, w, mu, math.sqrt(var), loglik, 2 * free - 2 * loglik, free * math.log(n) - 2 * loglik) for j, (w, mu, var) in enumerate(parts)]
    return values.sparkSession.createDataFrame(rows, "part int, weight double, mean double, std double, loglik double, aic double, bic double")


# The polynomial of Abramowitz and Stegun 26.2.17, error below 7.5e-8.
_PHI = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(z):
    t = 1 / (1 + 0.2316419 * F.abs(z))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * reduce(lambda s, c: (s + c) * t, reversed(_PHI), F.lit(0.0))
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def kolmogorov_smirnov(values: DataFrame, cdfs: dict) -> DataFrame:
    """(v) -> name, ks: the largest distance between the values' distribution function and each cdf (a column over v).

    Equal values are counted first; their ranks are sums over ranges, not over one sorted list.
    """
    counted = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).filter("v is not null").withColumn("one", F.lit(0))
    counted = tables.saved(counted, "counted")
    n = counted.agg(F.sum("c")).first()[0] or 0
    below = ranks.running(counted, ["one"], ["v"], "c", "below")
    gaps = [F.max(F.greatest((F.col("below") + F.col("c")) / n - cdf, cdf - F.col("below") / n)).alias(name) for name, cdf in cdfs.items()]
    row = below.agg(*gaps) if n else below.limit(0).agg(*(F.max(F.lit(None).cast("double")).alias(name) for name in cdfs))
    return row.select(F.explode(F.array(*(F.struct(F.lit(name).alias("name"), F.col(name).alias("ks")) for name in cdfs))).alias("x")).select("x.*")


def fit_distances(values: DataFrame, k: int = 2, rounds: int = 10) -> DataFrame:
    """name, ks: of the normal, uniform and mixture fits."""
    s = values.agg(F.avg("v").alias("mu"), F.stddev_pop("v").alias("std"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    parts, _, _ = mixture(values, k, rounds)
    v = F.col("v")
    mixed = reduce(lambda a, b: a + b, (w * normal_cdf((v - mu) / math.sqrt(var)) for w, mu, var in parts))
    return kolmogorov_smirnov(values, {"normal": normal_cdf((v - s["mu"]) / s["std"]), "uniform": (v - s["lo"]) / (s["hi"] - s["lo"]), "mixture": mixed})


def cluster_sizes(codes: DataFrame, per_code: DataFrame) -> DataFrame:
    """(sub, code) uses and the codebook -> per subvector: mean, std, min, max and empty cells."""
    n = codes.groupBy("sub", "code").agg(F.count(F.lit(1)).alias("n"))
    every = per_code.select("sub", "code").join(n, ["sub", "code"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return every.groupBy("sub").agg(F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.min("n").alias("low"), F.max("n").alias("high"), F.sum((F.col("n") == 0).cast("long")).alias("empty"))


def best_by(df: DataFrame, group: str, what: str, cost: str) -> DataFrame:
    """The choice of least cost in each group, ties to the smaller choice."""
    return df.groupBy(group).agg(F.min(F.struct(cost, what)).alias("m")).select(group, f"m.{what}", f"m.{cost}")


def offsets(counts: DataFrame, by: str, order: str, n: str) -> DataFrame:
    """Exclusive prefix sums of counts inside each group."""
    return ranks.running(counts, [by], [order], n, "offset")
