"""Nearest centers with room, point after point, where only the choice itself is in sequence.

A round takes the next points of every group, a batch of bounded size.  Shares of them meet
blocks of the centers that have room, each pair in a task of its own, and every point keeps
its nearest few.  One task a group then walks through the batch in order, over these lists
alone.  The first point whose whole list was filled by points before it ends the round; what
was placed before is final, as no later point can change it.  The shorter the batch, the
longer the lists: a batch whose points mostly want the same centers gets lists to match, and
its first points, at least as many as a list is long, are always placed.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, ranks, tables

#: Places in all lists of a group's batch, and in the shortest list.
LISTED, SHORT = 1 << 20, 16
#: Centers of a block, points of a share (at least, at most), points of a folder.
BLOCK_ROWS, SHARE_ROWS, FOLDER_ROWS = 1 << 17, (1 << 10, 1 << 13), 1 << 16


def first(x: np.ndarray, c: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its ``most`` nearest rows of c, ascending by (squared distance, place): places and distances, a row each.

    A distance that is no number is -1 and comes first, as for argmin.  A product of matrices leaves what
    may be among them, and that is measured as it is.
    """
    most, wide = min(most, len(c)), c.shape[1]
    place, dist = np.empty((len(x), most), np.int64), np.empty((len(x), most))
    with np.errstate(all="ignore"):
        side = np.ascontiguousarray(np.vstack([-2 * c.T, (c * c).sum(1)]))
        step = max(1, len(c) // max(most, 4 * math.isqrt(most * len(c))))
        some = np.ascontiguousarray(side[:, ::step])
        for k in range(0, len(x), high := max(1, min(128, (1 << 21) // some.shape[1]))):
            rows = x[k : k + high]
            one, x2 = np.hstack([rows, np.ones((len(rows), 1))]), (rows * rows).sum(1)
            # the most-th of a part isn't nearer than the most-th of all
            far = np.partition(one @ some, most - 1, axis=1)[:, most - 1]
            far = far + 1e-13 * (wide + 8) * (x2 + np.abs(far)) + 1e-300
            far = np.where(np.isfinite(far), far, np.inf)[:, None]
            best, held, count = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)), [], 0
            for j in range(0, len(c), 2048):
                i, at = np.divmod(np.flatnonzero(~(one @ side[:, j : j + 2048] > far)), min(2048, len(c) - j))
                held.append((i, at + j))
                count += len(i)
                if count > 1 << 19:
                    best, held, count = _best(best, held, rows, c, most), [], 0
            i, at, d = _best(best, held, rows, c, most)
            place[k : k + high], dist[k : k + high] = at.reshape(-1, most), d.reshape(-1, most)
    return place, dist


def _best(best: tuple, held: list, x: np.ndarray, c: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``most`` nearest of each row among those so far and new ones: rows, places and distances, in order."""
    i, at = (np.concatenate([h[n] for h in held]) if held else np.zeros(0, np.int64) for n in (0, 1))
    new = [((c[at[k : k + blocks.PAIRS]] - x[i[k : k + blocks.PAIRS]]) ** 2).sum(1) for k in range(0, len(i), blocks.PAIRS)]
    d = np.concatenate([best[2], *(np.where(np.isnan(n), -1.0, n) for n in new)])
    i, at = np.concatenate([best[0], i]), np.concatenate([best[1], at])
    order = np.lexsort((at, d, i))
    i = i[order]
    order = order[np.arange(len(i)) - np.searchsorted(i, i) < most]
    return np.concatenate([best[0], *(h[0] for h in held)])[order], at[order], d[order]


def walked(lists: np.ndarray, room: dict[int, int], whole: bool) -> list[int | None]:
    """What each row takes: the first of its list with room, which is used up; up to the first row without any, unless lists are ``whole`` (then it takes none)."""
    out: list[int | None] = []
    for row in lists:
        got = next((c for c in row.tolist() if room[c]), None)
        if got is not None:
            room[got] -= 1
        elif not whole:
            break
        out.append(got)
    return out


def _matrix(table: pa.Table, column: str) -> np.ndarray:
    lists = blocks.one_array(table[column])
    if lists.null_count or len(lists.value_lengths().unique()) > 1:
        raise ValueError("vectors of one dimension are needed")
    return blocks._matrix(lists, len(lists))


def greedy(points: DataFrame, centers: DataFrame, room: int, by: list[str]) -> DataFrame:
    """by, key_id, node_id: points in the order of key_id, each to the nearest center with room (ties to the smaller id), null once none has any.

    Points of groups without centers have no row.
    """
    spark, kinds = points.sparkSession, {f.name: f.dataType.simpleString() for f in points.schema}
    types = ", ".join(f"{c} {kinds[c]}" for c in by)
    ordered = ranks.numbered(points.select(*by, F.col("key_id").cast("long").alias("key_id"), "key"), by, ["key_id", F.xxhash64("key")], "place")
    ordered = tables.saved(ordered.withColumn("folder", F.floor((F.col("place") - 1) / FOLDER_ROWS).cast("int")), "ordered", by="folder")
    seats = centers.select(*by, F.col("node_id").cast("long").alias("node_id"), F.transform("center", lambda x: x.cast("double")).alias("center"))
    # a number of its own for each center, in the order of ids, whether or not an id comes once
    seats = tables.saved(ranks.numbered(seats, by, ["node_id", F.xxhash64("center")], "seat").withColumn("seat", F.col("seat").cast("long")), "seats")
    left = seats.select(*by, "seat", "center", F.lit(room).alias("room")).filter("room > 0")
    count = lambda df, name: df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))
    state = count(ordered, "n").join(count(seats, "open"), by).withColumn("open", F.when(F.lit(room > 0), F.col("open")).otherwise(0))
    state = tables.saved(state.select("*", F.lit(0).cast("long").alias("done"), F.lit(LISTED // SHORT).cast("long").alias("size")), "state")
    root, cores, turn = f"{tables.folder(spark)}/orbita-tables/placed-{uuid.uuid4().hex}", spark.sparkContext.defaultParallelism, 0
    while True:
        batch = F.least(F.col("n") - F.col("done"), F.col("size"))
        plan = state.filter("done < n and open > 0").select(*by, "open", "done", batch.alias("batch")).withColumn("listed", F.greatest(F.lit(SHORT), F.floor(F.lit(LISTED) / F.col("batch"))))
        of = plan.agg(F.count(F.lit(1)), F.sum("batch"), F.max(F.ceil(F.col("open") / BLOCK_ROWS)), F.min(F.floor(F.col("done") / FOLDER_ROWS)), F.max(F.floor((F.col("done") + F.col("batch") - 1) / FOLDER_ROWS))).first()
        groups, rows, deep, low, high = of
        if not groups:
            break
        share = min(max(rows // (4 * cores), SHARE_ROWS[0]), SHARE_ROWS[1])
        plan = plan.withColumn("shares", F.ceil(F.col("batch") / share).cast("int")).withColumn("blocks", F.ceil(F.col("open") / BLOCK_ROWS).cast("int"))
        plan = F.broadcast(plan) if groups <= tables.BROADCAST_ROWS else plan
        lists = _lists(ordered.filter(F.col("folder").between(low, high)), left, plan, share, min((rows // share + groups) * deep, 16 * cores), by, types)
        lists = _merged(lists, by) if deep > 1 else lists.drop("listed", "dist")
        placed = tables.saved(lists.groupBy(*by).applyInArrow(_walk(by), f"{types}, key_id long, seat long"), "placed", f"{root}/turn={turn}")
        used = placed.groupBy(*by, "seat").agg(F.count(F.lit(1)).cast("int").alias("used"))
        left = left.join(used, [*by, "seat"], "left").withColumn("room", F.col("room") - F.coalesce("used", F.lit(0)))
        left = tables.saved(left.filter("room > 0").drop("used"), "room")
        # who was stopped tries about twice what was placed
        next_size = F.when(F.col("got").isNull(), F.col("size")).otherwise(F.least(F.lit(LISTED // SHORT), 2 * F.col("got")))
        state = state.drop("open").join(count(placed, "got"), by, "left").join(count(left, "open"), by, "left")
        state = tables.saved(state.select(*by, "n", F.coalesce("open", F.lit(0)).alias("open"), (F.col("done") + F.coalesce("got", F.lit(0))).alias("done"), next_size.alias("size")), "state")
        turn += 1
    without = ordered.join(state.filter("done < n"), by).filter("place > done").select(*by, "key_id", F.lit(None).cast("long").alias("seat"))
    tables.saved(without, "placed", f"{root}/turn={turn}")
    placed = spark.read.schema(f"{types}, key_id long, seat long").parquet(root)
    return placed.join(seats.select(*by, "seat", "node_id"), [*by, "seat"], "left").select(*by, "key_id", "node_id")


def _lists(ordered: DataFrame, left: DataFrame, plan: DataFrame, share: int, parts: int, by: list[str], types: str) -> DataFrame:
    """by, place, key_id, listed, whole, seat, room, dist: the nearest centers of a batch's points, a row for each point and block."""
    group = [*by, "block", "share"]
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    points = ordered.join(plan, by).filter("place > done and place <= done + batch").withColumn("share", F.floor((F.col("place") - F.col("done") - 1) / share).cast("int")).withColumn("block", every("blocks"))
    points = points.select(*group, "place", "key_id", "key", "listed", (F.col("listed") >= F.col("open")).alias("whole"))
    centers = left.join(plan, by).withColumn("block", F.pmod("seat", F.col("blocks")).cast("int")).withColumn("share", every("shares")).select(*group, "seat", "center", "room")

    def near(p: pa.Table, c: pa.Table) -> pa.Table:
        if not p.num_rows or not c.num_rows:
            place, dist, c = np.empty((0, 0), np.int64), np.empty((0, 0)), c.slice(0, 0)
            p = p.slice(0, 0)
        else:
            c = c.sort_by("seat").combine_chunks()
            x, y = _matrix(p, "key"), _matrix(c, "center")
            if x.shape[1] != y.shape[1]:
                raise ValueError("points and centers have different dimensions")
            place, dist = first(x, y, p["listed"][0].as_py())
        ends = pa.array(np.arange(p.num_rows + 1) * place.shape[1], pa.int32())
        lists = [c["seat"].to_numpy()[place.ravel()], c["room"].to_numpy()[place.ravel()], dist.ravel()]
        columns = [p[name] for name in (*by, "place", "key_id", "listed", "whole")] + [pa.ListArray.from_arrays(ends, pa.array(x)) for x in lists]
        return pa.table(columns, names=[*by, "place", "key_id", "listed", "whole", "seat", "room", "dist"])

    points = points.withColumn("place", F.col("place").cast("long")).repartition(parts, *group)
    schema = f"{types}, place long, key_id long, listed long, whole boolean, seat array<long>, room array<int>, dist array<double>"
    return points.groupBy(*group).cogroup(centers.repartition(parts, *group).groupBy(*group)).applyInArrow(near, schema)


def _merged(lists: DataFrame, by: list[str]) -> DataFrame:
    """Lists of several blocks as one."""
    nearest = F.slice(F.array_sort(F.flatten(F.collect_list(F.arrays_zip("dist", "seat", "room")))), F.lit(1), F.first("listed").cast("int"))
    return lists.groupBy(*by, "place", "key_id", "whole").agg(nearest.alias("near")).select(*by, "place", "key_id", "whole", F.col("near.seat").alias("seat"), F.col("near.room").alias("room"))


def _walk(by: list[str]):
    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by("place").combine_chunks()
        seat, room = (blocks.one_array(t[c]).flatten().to_numpy() for c in ("seat", "room"))
        has = dict(zip(seat.tolist(), room.tolist(), strict=True))
        got = walked(seat.reshape(t.num_rows, -1), has, t["whole"][0].as_py())
        return t.slice(0, len(got)).select([*by, "key_id"]).append_column("seat", pa.array(got, pa.int64()))

    return walk
