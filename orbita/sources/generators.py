"""Seeded generators of keys: every value depends on the row's id and the seed alone, so partitioning doesn't matter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vec


def _uniform(seed: int, *parts: Column) -> Column:
    """In (0, 1), from a hash of the parts."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *parts), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def _normal(seed: int, *parts: Column) -> Column:
    return F.sqrt(-2 * F.log(_uniform(seed, *parts))) * F.cos(2 * math.pi * _uniform(seed + 1_000_003, *parts))


def _vector(d: int, f) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(d - 1)), f)


def _keys(spark: SparkSession, n: int, key: Column) -> DataFrame:
    return spark.range(n).select(F.lit(0).alias("kv_head"), F.col("id").alias("key_id"), key.alias("key"))


def gaussian(spark: SparkSession, n: int, d: int, seed: int = 0) -> DataFrame:
    return _keys(spark, n, _vector(d, lambda i: _normal(seed, F.col("id"), i)))


def cube(spark: SparkSession, n: int, d: int, seed: int = 0) -> DataFrame:
    """Uniform in [-1, 1]."""
    return _keys(spark, n, _vector(d, lambda i: 2 * _uniform(seed, F.col("id"), i) - 1))


def sphere(spark: SparkSession, n: int, d: int, seed: int = 0) -> DataFrame:
    return gaussian(spark, n, d, seed).withColumn("key", vec.normalized("key"))


def anisotropic(spark: SparkSession, n: int, d: int, seed: int = 0) -> DataFrame:
    """Variance exp(-i / (d / 4)) in component i."""
    return _keys(spark, n, _vector(d, lambda i: _normal(seed, F.col("id"), i) * F.exp(-i / (d / 4) / 2)))


def mixture(spark: SparkSession, n: int, d: int, components: int = 16, spread: float = 0.2, seed: int = 0, weights: list[float] | None = None) -> DataFrame:
    """Gaussian clusters; weights default to equal."""
    w = weights or [1.0] * components
    total, edges, run = sum(w), [], 0.0
    for x in w:
        run += x / total
        edges.append(run)
    u = _uniform(seed + 7, F.col("id"))
    which = F.aggregate(F.array(*map(F.lit, edges[:-1])) if len(edges) > 1 else F.array(F.lit(1.0)), F.lit(0), lambda s, e: s + (u >= e).cast("int"))
    rows = spark.range(n).withColumn("c", which)
    return rows.select(F.lit(0).alias("kv_head"), F.col("id").alias("key_id"), _vector(d, lambda i: _normal(seed + 11, F.col("c"), i) + spread * _normal(seed, F.col("id"), i)).alias("key"))


def zipf_clusters(spark: SparkSession, n: int, d: int, components: int = 16, power: float = 1.1, spread: float = 0.2, seed: int = 0) -> DataFrame:
    return mixture(spark, n, d, components, spread, seed, [1 / (i + 1) ** power for i in range(components)])


def zipf_scaled(spark: SparkSession, n: int, d: int, power: float = 1.0, seed: int = 0) -> DataFrame:
    """Component i scaled by 1 / (i + 1) ** power, then of unit length."""
    return _keys(spark, n, _vector(d, lambda i: _normal(seed, F.col("id"), i) / F.pow(i + 1, F.lit(power)))).withColumn("key", vec.normalized("key"))


def low_rank(spark: SparkSession, n: int, d: int, rank: int = 4, noise: float = 0.05, seed: int = 0) -> DataFrame:
    """s U' + noise, of unit length."""
    inner = lambda i: F.aggregate(F.sequence(F.lit(0), F.lit(rank - 1)), F.lit(0.0), lambda s, r: s + _normal(seed + 3, F.col("id"), r) * _normal(seed + 5, r, i))
    return _keys(spark, n, _vector(d, lambda i: inner(i) + noise * _normal(seed, F.col("id"), i))).withColumn("key", vec.normalized("key"))
