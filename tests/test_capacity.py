"""Greedy choice of centers with room against point after point."""

import glob
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from orbita.operators import clustering
from orbita.plans import capacity, tables

POINTS, CENTERS = "g int, key_id long, key array<double>", "g int, node_id long, center array<double>"
INF, NAN = float("inf"), float("nan")


def one_by_one(points, centers, room):
    out = {}
    for g in {c[0] for c in centers}:
        ids = sorted(c[1] for c in centers if c[0] == g)
        y, left = np.array([next(c[2] for c in centers if c[:2] == (g, i)) for i in ids]), dict.fromkeys(ids, room)
        for _, k, x in sorted((p for p in points if p[0] == g), key=lambda p: p[1]):
            with np.errstate(all="ignore"):
                d = ((y - np.array(x)) ** 2).sum(1)
            open_ = [(-1.0 if np.isnan(v) else v, i) for v, i in zip(d.tolist(), ids, strict=True) if left[i]]
            out[g, k] = min(open_)[1] if open_ else None
            if open_:
                left[out[g, k]] -= 1
    return out


def taken(spark, points, centers, room):
    got = clustering.greedy_capacity(spark.createDataFrame(points, POINTS), spark.createDataFrame(centers, CENTERS), room, ["g"])
    rows = got.collect()
    assert got.columns == ["g", "key_id", "node_id"] and len({(r["g"], r["key_id"]) for r in rows}) == len(rows)
    return {(r["g"], r["key_id"]): r["node_id"] for r in rows}


def grid(n, d, sides, g, seed):
    r = random.Random(seed)
    return [(g, i, [float(r.randrange(sides)) for _ in range(d)]) for i in range(n)]


def small(monkeypatch, listed=120, short=3, block=20, share=17):
    for name, value in (("LISTED", listed), ("SHORT", short), ("BLOCK_ROWS", block), ("SHARE_ROWS", (share, share)), ("FOLDER_ROWS", 50)):
        monkeypatch.setattr(capacity, name, value)


def test_batches_shares_and_blocks_give_what_one_after_another_gives(spark, monkeypatch):
    small(monkeypatch)
    r = random.Random(3)
    points = [(0, i, [r.gauss(0, 1) for _ in range(8)]) for i in range(240)] + [(1, 7 * i - 100, [r.gauss(i % 3, 0.1)]) for i in range(31)] + [(9, 1, [0.0])]
    centers = [(0, 2 * i, points[i][2]) for i in range(60)] + [(1, i, [float(i)]) for i in range(8)]
    got = taken(spark, points, centers, 4)
    assert got == one_by_one(points, centers, 4) and (9, 1) not in got and len(got) == 271


def test_no_task_takes_a_whole_group(spark, monkeypatch):
    small(monkeypatch)
    points = grid(200, 2, 50, 0, 1)
    before = set(glob.glob(f"{tables.folder(spark).removeprefix('file://')}/orbita-tables/placed-*"))
    got = taken(spark, points, [p for p in points if p[1] % 4 == 0], 4)
    (new,) = set(glob.glob(f"{tables.folder(spark).removeprefix('file://')}/orbita-tables/placed-*")) - before
    turns = spark.read.parquet(new).groupBy("turn").count().collect()
    assert len(got) == 200 == sum(t["count"] for t in turns) and max(t["count"] for t in turns) <= 40


@pytest.mark.parametrize("sides", [1, 2, 3])
def test_equal_distances_go_to_the_smaller_id(spark, monkeypatch, sides):
    small(monkeypatch)
    points = grid(90, 3, sides, 0, sides)
    centers = [(0, 1000 - p[1], p[2]) for p in points[:30]]
    assert taken(spark, points, centers, 3) == one_by_one(points, centers, 3)


def test_ids_that_come_twice_keep_all_their_room(spark, monkeypatch):
    small(monkeypatch)
    points = grid(40, 2, 50, 0, 4)
    twice = spark.createDataFrame(points + points, POINTS)
    got = clustering.greedy_capacity(twice, spark.createDataFrame(points[:10] + points[:10], CENTERS), 4, ["g"])
    assert {tuple(r) for r in got.groupBy("node_id").count().collect()} == {(i, 8) for i in range(10)}


def test_points_beyond_all_room_take_none(spark, monkeypatch):
    points, centers = grid(50, 2, 9, 0, 5), grid(6, 2, 9, 0, 6)
    want = one_by_one(points, centers, 3)
    assert list(want.values()).count(None) == 32
    assert taken(spark, points, centers, 3) == want
    small(monkeypatch)
    assert taken(spark, points, centers, 3) == want
    assert set(taken(spark, points, centers, 0).values()) == {None}


def test_components_without_a_value_or_a_bound(spark, monkeypatch):
    small(monkeypatch, listed=60)
    points = grid(60, 2, 7, 0, 8)
    for k, x in ((3, [NAN, 1.0]), (10, [INF, 1.0]), (20, [-INF, INF]), (30, [1e200, 0.0]), (41, [NAN, NAN])):
        points[k] = (0, k, x)
    centers = [(0, i, points[i][2]) for i in range(0, 60, 3)] + [(0, 100, points[20][2]), (0, 101, points[41][2])]
    assert taken(spark, points, centers, 3) == one_by_one(points, centers, 3)


def test_vectors_of_two_dimensions_are_refused(spark):
    with pytest.raises(Exception, match="dimension"):
        taken(spark, [(0, 1, [1.0, 2.0]), (0, 2, [1.0])], [(0, 1, [0.0, 0.0])], 4)


def test_the_first_centers_of_a_product_equal_sorted_distances():
    r = np.random.default_rng(1)
    for n, d, most, far in ((3000, 8, 5, 0.0), (5000, 3, 40, 1e6), (10, 2, 50, 0.0)):
        x, c = r.normal(size=(150, d)) + far, r.normal(size=(n, d)) + far
        place, dist = capacity.first(x, c, most)
        exact = ((c[None] - x[:, None]) ** 2).sum(2)
        want = np.argsort(exact, axis=1, kind="stable")[:, :most]
        assert (place == want).all() and (dist == np.take_along_axis(exact, want, 1)).all()


def test_query_equals_one_by_one(spark):
    from orbita import queries

    sf = "/root/testdata/sf0.001"
    keys = queries._keys(spark, sf)
    centers = clustering.seeds(keys, lambda n: F.ceil(n / 8), 8, ["kv_head"]).select("kv_head", "node_id", "center")
    want = one_by_one([tuple(r) for r in keys.collect()], [tuple(r) for r in centers.collect()], 8)
    assert {(r["kv_head"], r["key_id"]): r["node_id"] for r in queries.Q["greedy_children"](spark, sf).collect()} == want
