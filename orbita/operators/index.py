"""Ball-tree indexes as tables: nodes and the leaf level's parents."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vec
from ..plans import ranks, tables
from . import clustering

HEAD = ["kv_head"]
#: Keys in a folder of leaf blocks.
BLOCK_KEYS = 1 << 17


@dataclass(frozen=True)
class Index:
    """keys (kv_head, key_id, key, ...), leaf (kv_head, key_id, parent_id), nodes (level, kv_head, node_id, center, radius, parent_id).

    ``blocks`` (the columns of keys, parent_id, block) is keys with leaf as ``laid_out`` stores them,
    and ``places`` (kv_head, parent_id, block) says where; block numbers are below ``n_blocks``.
    """

    keys: DataFrame
    leaf: DataFrame | None
    nodes: DataFrame | None
    depth: int
    bf: int
    blocks: DataFrame | None = None
    places: DataFrame | None = None
    n_blocks: int = 0

    def level(self, level: int) -> DataFrame:
        return self.nodes.filter(F.col("level") == level).drop("level")


def radius(children: DataFrame, centers: DataFrame) -> DataFrame:
    """children (kv_head, child, point, child_radius, parent_id) -> (kv_head, node_id, center, radius): the triangle bound."""
    d = vec.distance("point", "center") + F.col("child_radius")
    joined = children.join(centers.withColumnRenamed("node_id", "parent_id"), ["kv_head", "parent_id"])
    top = joined.groupBy("kv_head", "parent_id").agg(F.max(d).alias("radius"))
    return centers.join(top.withColumnRenamed("parent_id", "node_id"), ["kv_head", "node_id"]).select("kv_head", "node_id", "center", "radius")


def one_level(points: DataFrame, bf: int, seed: int, iterations: int, balanced: bool, arrow: bool) -> tuple[DataFrame, DataFrame]:
    """points (kv_head, key_id, key) -> (assignment: kv_head, key_id, node_id), (centers)."""
    by = HEAD
    points = tables.saved(points.select("kv_head", "key_id", "key"), "points")
    count = (lambda n: F.ceil(n / bf)) if balanced else (lambda n: F.greatest(F.lit(1), F.floor(n / bf)))
    centers = tables.saved(clustering.seeds(points, count, seed, by), "seeds")
    if balanced:
        assigned = clustering.balanced_assign(points, centers, bf, seed, by, arrow)
    else:
        centers = clustering.lloyd(points, centers, iterations, by, arrow)
        assigned = clustering.nearest_assign(points, centers, by, arrow)
    return tables.saved(assigned.select("kv_head", "key_id", "node_id"), "assigned"), centers.select("kv_head", "node_id", "center")


def build(keys: DataFrame, num_levels: int = 3, bf: int = 8, iterations: int = 0, seed: int = 7, balanced: bool = False, arrow: bool = False) -> Index:
    """num_levels counts the keys as one level; levels of less than one node a head aren't made (floor of n / bf; balanced: ceil)."""
    if num_levels < 1 or bf < 1:
        raise ValueError("num_levels and bf are at least 1")
    if balanced and num_levels not in (2, 3):
        raise ValueError("balanced indexes have two or three levels")
    points = keys.select("kv_head", "key_id", "key").withColumn("child_radius", F.lit(0.0))
    leaf, nodes, depth = None, None, 1
    size = keys.groupBy("kv_head").count().agg(F.max("count")).first()[0] or 0
    for level in range(1, num_levels):
        size = -(-size // bf) if balanced else size // bf
        if size < 1:
            break
        assigned, centers = one_level(points, bf, seed + level, iterations, balanced, arrow)
        children = points.join(assigned, ["kv_head", "key_id"]).select("kv_head", "child_radius", F.col("key").alias("point"), F.col("node_id").alias("parent_id"))
        made = tables.saved(radius(children, centers), "nodes")
        parent = assigned.withColumnRenamed("node_id", "parent_id")
        if level == 1:
            leaf = parent
        else:
            up = parent.withColumnRenamed("key_id", "node_id").withColumn("level", F.lit(level - 1))
            nodes = nodes.drop("parent_id").join(up, ["level", "kv_head", "node_id"], "left") if level == 2 else nodes.join(up.withColumnRenamed("parent_id", "up"), ["level", "kv_head", "node_id"], "left").withColumn("parent_id", F.coalesce("up", "parent_id")).drop("up")
        new = made.select(F.lit(level).alias("level"), "kv_head", "node_id", "center", "radius", F.lit(None).cast("long").alias("parent_id"))
        nodes = tables.saved(new if nodes is None else nodes.select(new.columns).unionByName(new), "nodes")
        points = made.select("kv_head", F.col("node_id").alias("key_id"), F.col("center").alias("key"), F.col("radius").alias("child_radius"))
        depth += 1
    return Index(keys, leaf, nodes, depth, bf)


def broken_bounds(index: Index, slack: float = 1e-9) -> DataFrame:
    """Edges whose parent ball doesn't hold the child's: none in a valid index."""
    if index.leaf is None:
        return index.keys.limit(0).select("kv_head", F.col("key_id").alias("child"))
    kids = index.keys.join(index.leaf, ["kv_head", "key_id"]).select(F.lit(1).alias("level"), "kv_head", F.col("key_id").alias("child"), F.transform("key", lambda x: x.cast("double")).alias("point"), F.lit(0.0).alias("r"), "parent_id")
    ups = index.nodes.filter("parent_id is not null").select((F.col("level") + 1).alias("level"), "kv_head", F.col("node_id").alias("child"), F.col("center").alias("point"), F.col("radius").alias("r"), "parent_id")
    parents = index.nodes.select("level", "kv_head", F.col("node_id").alias("parent_id"), "center", "radius")
    return kids.unionByName(ups).join(parents, ["level", "kv_head", "parent_id"]).filter(vec.distance("point", "center") + F.col("r") > F.col("radius") + slack).select("kv_head", "child")


def leaf_blocks(keys: DataFrame, leaf: DataFrame, nodes: DataFrame, first: int = 0, block_keys: int = BLOCK_KEYS, path: str | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(blocks, places, next block number): the keys of ``leaf`` stored with their parent, a folder for some neighbouring parents.

    Parents stand in the order of (head, grandparent, id), so what a search excludes above lies together;
    a parent's keys are in one folder, sorted by parent.
    """
    up = nodes.filter("level = 1").select("kv_head", F.col("node_id").alias("parent_id"), F.coalesce("parent_id", F.lit(-1)).alias("up"))
    counts = leaf.groupBy("kv_head", "parent_id").agg(F.count(F.lit(1)).alias("n")).join(up, ["kv_head", "parent_id"]).withColumn("all", F.lit(0))
    before = ranks.running(tables.saved(counts, "counts"), ["all"], ["kv_head", "up", "parent_id"], "n", "before")
    places = before.select("kv_head", "parent_id", (F.floor(F.col("before") / block_keys) + first).cast("int").alias("block"))
    places = tables.saved(places, "places", path and f"{path}/places")
    rows = keys.join(leaf, ["kv_head", "key_id"]).join(tables.small(places), ["kv_head", "parent_id"])
    order = ["block", "kv_head", "parent_id", "key_id"]
    rows = rows.select(*keys.columns, "parent_id", "block").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = tables.saved(rows, "blocks", path and f"{path}/blocks", by="block")
    return blocks, places, (places.agg(F.max("block")).first()[0] or first) + 1


def laid_out(index: Index, block_keys: int = BLOCK_KEYS) -> Index:
    """The index with its keys in leaf blocks: a search reads the folders of surviving parents only, keys with them."""
    if index.leaf is None:
        return index
    blocks, places, n = leaf_blocks(index.keys, index.leaf, index.nodes, block_keys=block_keys)
    return replace(index, blocks=blocks, places=places, n_blocks=n)


def blocks_in_reach(index: Index, parents: DataFrame) -> DataFrame:
    """parents (kv_head, parent_id, ...), few or many -> their keys, from the folders that hold any."""
    at = tables.saved(parents.join(tables.small(index.places), ["kv_head", "parent_id"]), "reach")
    folders = [r["block"] for r in at.select("block").distinct().collect()]  # a number a folder
    return index.blocks.filter(F.col("block").isin(folders)).join(at, ["block", "kv_head", "parent_id"])


def persisted(index: Index) -> Index:
    """Levels kept for many searches."""
    return replace(index, leaf=index.leaf and index.leaf.persist(), nodes=index.nodes and index.nodes.persist())
