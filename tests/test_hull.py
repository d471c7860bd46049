from itertools import combinations

import numpy as np
import pytest

from orbita.operators import hull


def by_facets(points):
    """Points of a plane, or line, that has all others on one side."""
    found = set()
    for c in combinations(range(len(points)), points.shape[1]):
        normal = np.linalg.svd(points[list(c[1:])] - points[c[0]])[2][-1]
        side = (points - points[c[0]]) @ normal
        if (side <= 1e-9).all() or (side >= -1e-9).all():
            found |= set(c)
    return {tuple(points[i].tolist()) for i in found}


@pytest.mark.parametrize("d,n", [(2, 60), (3, 24)])
def test_vertices_are_those_of_all_facets(spark, d, n):
    points = np.random.default_rng(d).normal(size=(n, d))
    rows = [(p.tolist(),) for p in points]
    df = spark.createDataFrame(rows + rows[:5] + [(None,), ([float("nan")] * d,), ([None] * d,)], "key array<double>")
    every, found = hull.vertices(df)
    assert every.count() == n
    assert {tuple(r["key"]) for r in found.collect()} == by_facets(points)


def test_points_on_edges_are_no_vertices(spark):
    square = [[float(x), float(y)] for x in range(5) for y in range(5)]
    _, found = hull.vertices(spark.createDataFrame([(p,) for p in square], "key array<double>"))
    assert {tuple(r["key"]) for r in found.collect()} == {(0, 0), (0, 4), (4, 0), (4, 4)}


def test_few_points(spark):
    of = lambda rows: tuple(hull.vertex_fraction(spark.createDataFrame([(r,) for r in rows], "key array<double>")).first())
    assert of([]) == (0, 0, None)
    assert of([[1.0, 2.0]] * 3) == (1, 1, 1.0)
    assert of([[0.0, 0.0], [1.0, 1.0], [2.0, 2.0]]) == (3, 2, 2 / 3)


def test_fraction_of_a_table(spark):
    from orbita import queries

    rows = {r["dim"]: r for r in queries.Q["hull_fraction"](spark, "/root/testdata/sf0.001").collect()}
    points = np.array([r["embedding"][:2] for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select("embedding").collect()], float)
    assert rows[2]["points"] == len(np.unique(points, axis=0))
    assert rows[2]["fraction"] <= rows[3]["fraction"] <= rows[6]["fraction"] <= 1
