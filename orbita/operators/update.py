"""Incremental updates: forest append, and slot filling in balanced indexes."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..plans import ranks, tables
from . import clustering, index
from .index import HEAD, Index



def append_forest(old: Index, new_keys: DataFrame, iterations: int = 0, seed: int = 7, arrow: bool = False) -> Index:
    """A sub-index over the new keys beside the old one; nothing is rebalanced.

    Node ids are the ids of seed keys, which are new, so none clash.  A sub-index
    of fewer levels is extended by nodes that hold all of a head.
    """
    if new_keys.isEmpty():
        return old
    cols = [c for c in old.keys.columns if c in new_keys.columns]
    keys = old.keys.select(cols).unionByName(new_keys.select(cols))
    if old.depth == 1:
        return replace(old, keys=keys)
    sub = sub_index(old, new_keys, iterations, seed, arrow)
    nodes = old.nodes.unionByName(sub.nodes.select(old.nodes.columns))
    new = Index(keys, old.leaf.unionByName(sub.leaf.select(old.leaf.columns)), tables.saved(nodes, "nodes"), old.depth, old.bf)
    return _more_blocks(old, new, new_keys, sub.leaf, sub.nodes)


def sub_index(old: Index, new_keys: DataFrame, iterations: int = 0, seed: int = 7, arrow: bool = False) -> Index:
    """An index of the old one's depth over new keys alone."""
    return extended(index.build(new_keys, old.depth, old.bf, iterations, seed, arrow=arrow), old.depth)


def _more_blocks(old: Index, new: Index, keys: DataFrame, leaf: DataFrame, nodes: DataFrame) -> Index:
    """The new index with the old one's leaf blocks, if it has any, and blocks of the new keys; none is written again."""
    if old.blocks is None:
        return new
    cols = [c for c in old.blocks.columns if c not in ("parent_id", "block")]
    blocks, places, n = index.leaf_blocks(keys.select(cols), leaf, nodes, old.n_blocks)
    return replace(new, blocks=old.blocks.unionByName(blocks), places=old.places.unionByName(places), n_blocks=n)


def extended(sub: Index, depth: int) -> Index:
    """Levels of one node a head on top, till the depth is reached."""
    nodes, leaf = sub.nodes, sub.leaf
    for level in range(sub.depth, depth):
        if level == 1:
            below = sub.keys.select("kv_head", F.col("key_id").alias("id"), F.transform("key", lambda x: x.cast("double")).alias("point"), F.lit(0.0).alias("r"))
        else:
            below = nodes.filter(F.col("level") == level - 1).select("kv_head", F.col("node_id").alias("id"), F.col("center").alias("point"), F.col("radius").alias("r"))
        first = below.groupBy("kv_head").agg(F.min("id").alias("node_id"))
        assigned = below.join(first, "kv_head")
        center = clustering.means(below.select("kv_head", F.col("id").alias("key_id"), F.col("point").alias("key")), assigned.select("kv_head", F.col("id").alias("key_id"), "node_id"), HEAD)
        made = index.radius(assigned.select("kv_head", "point", F.col("r").alias("child_radius"), F.col("node_id").alias("parent_id")), center)
        new = made.select(F.lit(level).alias("level"), "kv_head", "node_id", "center", "radius", F.lit(None).cast("long").alias("parent_id"))
        if level == 1:
            leaf, nodes = assigned.select("kv_head", F.col("id").alias("key_id"), F.col("node_id").alias("parent_id")), new
        else:
            up = nodes.join(first.withColumnRenamed("node_id", "up"), "kv_head").withColumn("parent_id", F.when(F.col("level") == level - 1, F.col("up")).otherwise(F.col("parent_id"))).select(new.columns)
            nodes = up.unionByName(new)
        nodes = tables.saved(nodes, "nodes")
    return Index(sub.keys, leaf, nodes, depth, sub.bf)


def compact(old: Index, **how) -> Index:
    """Rebuild over all keys."""
    return index.build(old.keys, old.depth, old.bf, **how)


def place(points: DataFrame, parents: DataFrame, counts: DataFrame, bf: int, arrow: bool = False) -> DataFrame:
    """points (kv_head, key_id, key) -> kv_head, key_id, node_id (null: no room at the nearest parent), dist2.

    Per parent the nearest come first, by (distance, id), on top of what it holds.
    """
    near = clustering.nearest_assign(points, parents.select("kv_head", "node_id", "center"), HEAD, arrow)
    held = ranks.numbered(tables.saved(near, "near"), ["kv_head", "node_id"], ["dist2", "key_id"], "nth").join(counts, ["kv_head", "node_id"], "left")
    fits = F.col("nth") + F.coalesce("held", F.lit(0)) <= bf
    some = held.select("kv_head", "key_id", F.when(fits, F.col("node_id")).alias("node_id"), F.when(fits, F.col("dist2")).alias("dist2"))
    # heads without any parent have no nearest one
    return points.select("kv_head", "key_id").join(some, ["kv_head", "key_id"], "left")


def _grown(nodes: DataFrame, level: int, reach: DataFrame) -> DataFrame:
    """nodes with radii at that level raised to ``reach`` (kv_head, node_id, reach)."""
    r = reach.groupBy("kv_head", "node_id").agg(F.max("reach").alias("reach")).withColumn("level", F.lit(level))
    return nodes.join(r, ["level", "kv_head", "node_id"], "left").withColumn("radius", F.greatest("radius", F.coalesce("reach", F.lit(0.0)))).drop("reach")


def fill_slots(old: Index, new_keys: DataFrame, seed: int = 7, arrow: bool = False) -> Index:
    """New keys into free slots of their nearest parents; the rest under new parents, these into free slots of
    grandparents, and what is left under new grandparents.  Radii only grow."""
    if old.depth not in (2, 3):
        raise ValueError("slots are for two or three levels")
    if new_keys.isEmpty():
        return old
    cols = old.nodes.columns
    points = new_keys.select("kv_head", "key_id", "key")
    counts = old.leaf.groupBy("kv_head", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("held"))
    placed = tables.saved(place(points, old.level(1), counts, old.bf, arrow), "placed")
    kept = placed.filter("node_id is not null")
    nodes = _grown(old.nodes, 1, kept.select("kv_head", "node_id", F.sqrt("dist2").alias("reach"))).select(cols)
    leaf = old.leaf.unionByName(kept.select("kv_head", "key_id", F.col("node_id").alias("parent_id")))
    orphans = points.join(placed.filter("node_id is null").select("kv_head", "key_id"), ["kv_head", "key_id"], "left_semi")
    orphans = tables.saved(orphans, "orphans")
    keys = old.keys.unionByName(new_keys.select(old.keys.columns))
    new = None
    if not orphans.isEmpty():
        assigned, centers = index.one_level(orphans, old.bf, seed + 101, 0, True, arrow)
        children = orphans.join(assigned, ["kv_head", "key_id"]).select("kv_head", F.lit(0.0).alias("child_radius"), F.col("key").alias("point"), F.col("node_id").alias("parent_id"))
        new = tables.saved(index.radius(children, centers), "parents")
        leaf = leaf.unionByName(assigned.withColumnRenamed("node_id", "parent_id"))
    if old.depth == 2:
        if new is not None:
            nodes = nodes.unionByName(new.select(F.lit(1).alias("level"), "kv_head", "node_id", "center", "radius", F.lit(None).cast("long").alias("parent_id")))
        return _filled(old, Index(keys, tables.saved(leaf, "leaf"), tables.saved(nodes, "nodes"), 2, old.bf), new_keys)
    if new is not None:
        above = nodes.filter("level = 1").groupBy("kv_head", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("held"))
        as_points = new.select("kv_head", F.col("node_id").alias("key_id"), F.col("center").alias("key"))
        up = tables.saved(place(as_points, old.level(2), above, old.bf, arrow), "placed")
        loose = tables.saved(as_points.join(up.filter("node_id is null").select("kv_head", "key_id"), ["kv_head", "key_id"], "left_semi"), "loose")
        parent_of = up.filter("node_id is not null").select("kv_head", "key_id", "node_id")
        if not loose.isEmpty():
            assigned, centers = index.one_level(loose, old.bf, seed + 202, 0, True, arrow)
            parent_of = parent_of.unionByName(assigned)
            nodes = nodes.unionByName(centers.select(F.lit(2).alias("level"), "kv_head", "node_id", "center", F.lit(0.0).alias("radius"), F.lit(None).cast("long").alias("parent_id")))
        linked = new.join(parent_of.select("kv_head", F.col("key_id").alias("node_id"), F.col("node_id").alias("parent_id")), ["kv_head", "node_id"])
        nodes = nodes.unionByName(linked.select(F.lit(1).alias("level"), "kv_head", "node_id", "center", "radius", "parent_id"))
    nodes = tables.saved(nodes, "nodes")
    kids = nodes.filter("level = 1").select("kv_head", F.col("center").alias("point"), F.col("radius").alias("r"), F.col("parent_id").alias("node_id"))
    reach = kids.join(nodes.filter("level = 2").select("kv_head", "node_id", "center"), ["kv_head", "node_id"]).select("kv_head", "node_id", (vec.distance("point", "center") + F.col("r")).alias("reach"))
    return _filled(old, Index(keys, tables.saved(leaf, "leaf"), tables.saved(_grown(nodes, 2, reach).select(cols), "nodes"), 3, old.bf), new_keys)


def _filled(old: Index, new: Index, new_keys: DataFrame) -> Index:
    return new if old.blocks is None else _more_blocks(old, new, new_keys, new.leaf.join(new_keys.select("kv_head", "key_id"), ["kv_head", "key_id"], "left_semi"), new.nodes)
