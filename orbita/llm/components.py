"""Connected components of an edge list, by contraction.

Each round gives every node the smallest node of its neighbourhood as parent,
follows parents to their roots by pointer jumping, and replaces both ends of
every edge by their roots.  What is left are edges between roots, at most half as
many nodes, and on stars next to none; so edges are joined once or twice in all.

Every round is written to the shared folder, so lineage stays short and a lost
executor costs a round at most.  Links are never gathered: a node with a
third of all edges is a skewed join, which adaptive execution splits, and its
minimum is pre-aggregated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _simple(edges: DataFrame) -> DataFrame:
    """Each edge once, without loops."""
    return shared.written(edges.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def _rooted(parents: DataFrame) -> DataFrame:
    """(node, label) with labels that are parents -> with labels that are roots."""
    while True:
        inner = parents.filter("node != label").toDF("label", "root")
        new = shared.written(parents.join(inner, "label", "left").select("node", F.coalesce("root", "label").alias("label"), F.col("root").isNotNull().alias("moved")), "labels")
        parents = new.select("node", "label")
        if new.filter("moved").isEmpty():
            return parents


def _renamed(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Edges between the labels of their ends; an end without label stays."""
    out = edges.join(labels.toDF("a", "x"), "a", "left").join(labels.toDF("b", "y"), "b", "left")
    return out.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))


def _relabelled(labels: DataFrame, roots: DataFrame) -> DataFrame:
    return labels.join(roots.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))


def components(edges: DataFrame) -> DataFrame:
    """(a, b) -> (node, label): the smallest node of each component; only nodes with edges."""
    left, labels = _simple(edges), None
    while True:
        ends = left.select("a", "b").union(left.select("b", "a")).toDF("node", "other")
        parents = ends.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("label"))
        roots = _rooted(shared.written(parents, "labels"))
        labels = roots if labels is None else shared.written(_relabelled(labels, roots), "labels")
        left = _simple(_renamed(left, roots))
        if left.isEmpty():
            return labels


def extended(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels of ``components`` after more edges; only these are joined."""
    roots = components(_renamed(edges, labels))
    return shared.written(_relabelled(labels, roots).unionByName(roots.join(labels.select("node"), "node", "left_anti")), "labels")
