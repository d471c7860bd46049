"""Whole jobs over all keys and queries, without a row a pair."""

from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbita.functions import thresholds
from orbita.operators import clustering, index, metrics, search, shapes
from orbita.plans import blocks, pruned, selection

KEYS, QUERIES = "kv_head int, key_id long, key array<double>", "query_id long, q_head int, q array<double>, threshold double"


def some(spark, n=300, asks=70, heads=2, d=3, seed=1):
    """Keys with ties, copies and a head that no query asks; queries with one head that has no keys."""
    r = np.random.default_rng(seed)
    keys = [(h, i, [float(v) for v in r.integers(-3, 4, d)] if i % 3 else [float(v) for v in r.normal(size=d)]) for h in range(heads + 1) for i in range(n)]
    keys += [(0, n + i, [0.5] * d) for i in range(n)]
    q = [(i, h, [float(v) for v in r.normal(size=d)], 0.3) for i in range(asks) for h in (*range(heads), 9)]
    return spark.createDataFrame(keys, KEYS).repartition(3), search.queries(spark.createDataFrame(q, QUERIES)), keys, q


@pytest.mark.parametrize(("few", "held"), [(0, 1 << 21), (20, 50), (1024, 1 << 21)])
def test_places_of_pairs_equal_those_of_rows(spark, monkeypatch, few, held):
    monkeypatch.setattr(selection, "FEW", few)
    monkeypatch.setattr(selection, "HELD", held)
    k, q, keys, asks = some(spark)
    places = {"first": lambda n: F.lit(1), "last": lambda n: n, "third": lambda n: F.floor((n + 2) / 3), "far": lambda n: F.lit(400)}
    got = {(r["query_id"], r["q_head"]): r for r in thresholds.selected(selection.Pairs(k, q), ["query_id", "q_head"], places).collect()}
    assert set(got) == {(i, h) for i, h, _, _ in asks if h != 9}
    for i, h, v, _ in asks:
        if h != 9:
            s, x = sorted(reduce(lambda t, p: t + p[0] * p[1], zip(v, y), 0.0) for g, _, y in keys if g == h), got[i, h]  # sum() would compensate
            assert (x["n"], x["first"], x["last"], x["third"], x["far"]) == (len(s), s[0], s[-1], s[(len(s) + 2) // 3 - 1], s[399] if len(s) > 399 else None)


def test_keys_of_one_row_group_are_scanned_by_many_tasks(spark, tmp_path):
    k, q, keys, asks = some(spark)
    k.coalesce(1).write.parquet(f"{tmp_path}/one")
    one = spark.read.parquet(f"{tmp_path}/one")
    want = {(i, h, g) for i, h, v, t in asks for kv, g, y in keys if kv == h and reduce(lambda s, p: s + p[0] * p[1], zip(v, y), 0.0) >= t}
    for df, n in ((search.flat_scan(one, q), len(want)), (search.all_scores(one, q), sum(kv == h for _, h, _, _ in asks for kv, _, _ in keys))):
        got = df.withColumn("task", F.spark_partition_id()).collect()
        assert len(got) == n and len({r["task"] for r in got}) > 1
    got = [(r["query_id"], r["q_head"], r["key_id"]) for r in search.flat_scan(one, q).collect()]
    assert len(got) == len(want) and set(got) == want


def test_thresholds_and_neighbours_make_no_row_a_pair(spark):
    k, q, keys, asks = some(spark)
    for df in (thresholds.topk(selection.Pairs(k, q), ["query_id", "q_head"], 10), metrics.knn_radius(k.select("key_id", "key"), q.filter("q_head = 0"), 5)):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    got = {r["query_id"]: r["radius"] for r in metrics.knn_radius(k.select("key_id", "key"), q.filter("q_head = 0"), 5).collect()}
    x = np.array([y for _, _, y in keys])
    for i, h, v, _ in asks:
        if h == 0:
            assert got[i] == pytest.approx(np.sort(np.sqrt(((x - np.array(v)) ** 2).sum(1)))[5])
    assert metrics.knn_radius(k.select("key_id", "key").limit(5), q.filter("q_head = 0"), 5).isEmpty()


def test_few_centers_are_met_without_a_join(spark):
    k, _, _, _ = some(spark)
    centers = k.filter("key_id % 50 = 0").select("kv_head", F.col("key_id").alias("node_id"), F.col("key").alias("center"))
    near = clustering.nearest_assign(k, centers, ["kv_head"])
    assert "Join" not in near._jdf.queryExecution().optimizedPlan().toString() and near.count() == k.count()
    x, y = np.random.default_rng(2).normal(size=(500, 8)), np.random.default_rng(3).normal(size=(2000, 8))
    node, dist, measured = pruned.among(x, np.arange(2000), y)
    every = ((x[:, None] - y[None]) ** 2).sum(2)
    assert (node == every.argmin(1)).all() and np.allclose(dist, every.min(1)) and (measured <= 2000 + 45).all()


@pytest.mark.parametrize("mode", ["exact", "scan"])
def test_levels_hand_down_numbers_of_queries(spark, monkeypatch, mode):
    """The rows of one node for each surviving query, as lists; a level's rows are nodes, not pairs."""
    monkeypatch.setattr(blocks, "PAIRS", 500)
    k, q, keys, asks = some(spark)
    tree, side = index.build(k, 3, 4), blocks.asked(q)
    lists = search.survivors(tree, spark.sparkContext.broadcast(side), mode)
    for level, pairs in search.active(tree, q, mode).items():
        rows = lists[level].collect()
        got = sorted((r["kv_head"], r["node_id"], int(side[r["kv_head"]].query_id[j])) for r in rows for j in r["asked"])
        assert got == sorted((r["kv_head"], r["node_id"], r["query_id"]) for r in pairs.collect()) and len(rows) < len(got) / 4
    want = {(i, h, n) for i, h, v, t in asks for g, n, y in keys if g == h and np.dot(v, y) >= t}
    got = {(r["query_id"], r["q_head"], r["key_id"]) for r in search.tree_search(tree, q, mode).collect()}
    assert got == want if mode == "exact" else got >= want


def test_hulls_are_met_in_blocks(spark, monkeypatch):
    """Clusters over several ranges, one point clusters, more queries than a row of maxima; no row for a member and a query."""
    monkeypatch.setattr(blocks, "WIDE", 16)
    k, q, keys, asks = some(spark, n=60)
    members = k.filter("kv_head = 0").select(F.pmod(F.col("key_id") * F.col("key_id"), F.lit(7)).alias("cluster_id"), F.col("key").alias("point"))
    members = members.unionByName(spark.createDataFrame([(99, [9.0, 9.0, 9.0])], members.schema))
    df = shapes.bounds("hull", members, q.filter("q_head = 0"))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    got, points = {(r["query_id"], r["cluster_id"]): r["bound"] for r in df.collect()}, members.collect()
    want = {(i, c): max(np.dot(v, r["point"]) for r in points if r["cluster_id"] == c) for i, h, v, _ in asks if h == 0 for c in {r["cluster_id"] for r in points}}
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)
