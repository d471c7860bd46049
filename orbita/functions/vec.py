"""Vector expressions: Column -> Column, all arithmetic in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


def dot(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")))


def distance2(a, b) -> Column:
    return _sum(F.zip_with(_c(a), _c(b), lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def distance(a, b) -> Column:
    return F.sqrt(distance2(a, b))


def norm(a) -> Column:
    return F.sqrt(_sum(F.transform(_c(a), lambda x: x.cast("double") * x.cast("double"))))


def normalized(a) -> Column:
    n = F.greatest(norm(a), F.lit(1e-12))
    return F.transform(_c(a), lambda x: x.cast("double") / n)


def box_bound(lo, hi, q) -> Column:
    """Largest inner product of q with a point of the box."""
    sides = F.zip_with(_c(lo), _c(hi), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return _sum(F.zip_with(sides, _c(q), lambda s, x: F.when(x >= 0, s["b"]).otherwise(s["a"]).cast("double") * x.cast("double")))


def hull_bound(points, q) -> Column:
    """Largest inner product of q with one of the points (their hull has no larger)."""
    return F.array_max(F.transform(_c(points), lambda p: dot(p, _c(q))))


def ellipsoid_bound(center, inv_shape, q) -> Column:
    """<c, q> + sqrt(q' A^-1 q)."""
    rows = F.transform(_c(inv_shape), lambda r: dot(r, _c(q)))
    return dot(center, q) + F.sqrt(F.greatest(dot(rows, q), F.lit(0.0)))


def ball_bound(center, radius, q, q_norm) -> Column:
    """Largest inner product of q with a point of the ball; q needn't be of unit length."""
    return dot(center, q) + _c(q_norm) * _c(radius)


def ball_side(center, radius, q, threshold) -> Column:
    """inside (d >= r), outside (d <= -r) or crossing, d = <q, c> - t, for unit q; a point on the border is inside."""
    d = dot(center, q) - _c(threshold)
    return F.when(d >= _c(radius), "inside").when(d <= -_c(radius), "outside").otherwise("crossing")


def is_padding(a, pad: float = 0.0) -> Column:
    return F.forall(_c(a), lambda x: x == pad)


def finite_or_zero(a) -> Column:
    c = _c(a)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def unpacked(code, m: int, nbits: int) -> Column:
    """m little-endian fields of nbits each from an array of bytes (as numbers)."""

    def bit(i: Column) -> Column:
        byte = F.element_at(_c(code), (F.floor(i / 8) + 1).cast("int")).cast("int")
        return F.floor(byte / F.pow(F.lit(2), i % 8)).cast("int") % 2

    def value(f: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(nbits - 1)), F.lit(0), lambda s, j: s + bit(f * nbits + j) * F.pow(F.lit(2), j).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), value)


def checked(key, size: int | None = None) -> Column:
    """The vector; an error where a component is null or NaN, or its dimension isn't ``size``."""
    ok = F.forall(_c(key), lambda x: x.isNotNull() & ~F.isnan(x))
    if size is not None:
        ok = ok & (F.size(_c(key)) == size)
    what = "numbers only" if size is None else f"{size} numbers"
    return F.when(F.assert_true(F.coalesce(ok, F.lit(False)), f"a vector of {what} is needed").isNull(), _c(key))


def score(q, key) -> Column:
    """The inner product; an error where the dimensions differ."""
    same = F.assert_true(F.size(_c(q)) == F.size(_c(key)), "queries and keys have different dimensions")
    return F.when(same.isNull(), dot(q, key))
