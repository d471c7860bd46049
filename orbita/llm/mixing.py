"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

A source with r = target / size words gets floor(r) whole copies of each
document for certain; for the rest, p = r - floor(r), documents are ranked by
random odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that
order until the words wanted are reached (the last one if that comes nearer).
u comes from the MD5 of the id, so reruns agree on any cluster.  p is one number a
source: sources are what has unequal odds here, and what is fixed is the words taken
from each.

The order is never gathered: words are summed by rank bin, a running sum over
the bins of a source finds the bin where its target falls, and only that bin's
rows are ranked.  What results is one cut for each source.

Defined results: null text has size 0; null source is a source of its own and
comes last; rows without id are drawn by their text; documents that tie in rank, id and size
enter or stay out together; texts of any length count whole; empty tables give no rows;
other columns are ignored (kept by ``mixed``), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

WEIGHTS = (3, 1, 2)
SHARE, MOST, BINS, BROADCAST_SOURCES = 1.5, 2, 1 << 16, 50_000


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.translate(trimmed, " \t\n\x0b\f\r", "")).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size) -> also target.  One row a source, so one task ranks them.

    Capped targets are those below the common level: with sources ordered by
    capacity over weight, a running sum gives the level without iterating.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w.cast("double")).withColumn("cap", F.col("source_size") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    rest = lambda cap, w_: (F.sum("source_size").over(everything) * share - cap) / (F.sum("w").over(everything) - w_)
    level = rest(F.coalesce(F.sum("cap").over(before), F.lit(0.0)), F.coalesce(F.sum("w").over(before), F.lit(0.0)))
    capped = ranked.withColumn("capped", level >= F.col("cap") / F.col("w"))
    inner = lambda c: F.coalesce(F.sum(F.when(F.col("capped"), F.col(c))).over(everything), F.lit(0.0))
    # try_divide: nothing is left to share where every source is capped
    free = F.try_divide(F.sum("source_size").over(everything) * share - inner("cap"), F.sum("w").over(everything) - inner("w"))
    return capped.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(free * F.col("w")).alias("target"))


def _ranked(df: DataFrame) -> DataFrame:
    """Adds u, q (null where nothing is drawn) and bin; needs doc_id, draw, whole and p."""
    u = (F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.col("draw"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("long") + 0.5) / F.lit(2.0**52)
    df = df.withColumn("u", u)
    q = F.when((F.col("p") > 0) & (F.col("p") < 1), (F.col("u") / (1 - F.col("u"))) / (F.col("p") / (1 - F.col("p"))))
    return df.withColumn("q", q).withColumn("bin", F.floor(F.col("q") / (1 + F.col("q")) * BINS).cast("int")).withColumn("key", F.coalesce(F.col("doc_id"), F.lit(-1)))


def cuts(sizes: DataFrame, **how) -> DataFrame:
    """(doc_id, source, size) -> one row a source: size, target, whole copies, p and the last rank taken."""
    per = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), **how)
    per = per.withColumn("whole", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"))
    per = shared.written(per.withColumn("p", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)) - F.col("whole")).withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    drawn = _ranked(sizes.join(_small(per), sizes.source.eqNullSafe(per.source)).drop(per.source)).filter("q is not null")
    bins = drawn.groupBy("source", "bin", "need").agg(F.sum("size").alias("words"))
    bins = bins.withColumn("below", F.sum("words").over(Window.partitionBy("source").orderBy("bin")) - F.col("words"))
    at = shared.written(bins.filter("below < need and below + words >= need").select("source", "bin", "below"), "cut-bins")
    inside = drawn.join(_small(at.withColumnRenamed("source", "s").withColumnRenamed("bin", "cut")), F.col("source").eqNullSafe(F.col("s")) & (F.col("bin") == F.col("cut")))
    peers = inside.groupBy("source", "q", "key", "size", "need", "below").agg(F.sum("size").alias("words"))
    run = peers.withColumn("had", F.col("below") + F.sum("words").over(Window.partitionBy("source").orderBy("q", "key", "size")) - F.col("words"))
    after = F.col("had") + F.col("words")
    taken = run.filter((after <= F.col("need")) | ((F.col("had") < F.col("need")) & (after - F.col("need") <= F.col("need") - F.col("had"))))
    last = taken.groupBy("source").agg(F.max(F.struct("q", "key", "size")).alias("last"))
    out = per.join(at.select(F.col("source").alias("s1"), F.col("bin").alias("cut")), F.col("source").eqNullSafe(F.col("s1")), "left").join(last.withColumnRenamed("source", "s2"), F.col("source").eqNullSafe(F.col("s2")), "left")
    return shared.written(out.select("source", "source_size", "target", "whole", "p", F.when(F.col("cut").isNotNull(), F.col("cut")).when(F.col("need") > 0, BINS + 1).otherwise(-1).alias("cut"), "last"), "cuts")


def _small(per_source: DataFrame) -> DataFrame:
    """One row a source: broadcast while these are few."""
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def copies(docs: DataFrame, per_source: DataFrame) -> DataFrame:
    """docs (doc_id, source, size and any others) -> also source_size, target, copies."""
    per = per_source.withColumnRenamed("source", "cut_source")
    df = _ranked(docs.join(_small(per), docs.source.eqNullSafe(per.cut_source)))
    more = F.col("q").isNotNull() & ((F.col("bin") < F.col("cut")) | ((F.col("bin") == F.col("cut")) & F.col("last").isNotNull() & (F.struct("q", "key", "size") <= F.col("last"))))
    return df.withColumn("copies", F.col("whole") + F.when(more, 1).otherwise(0)).drop("cut_source", "whole", "p", "cut", "last", "u", "q", "bin", "key", "draw")


def draw(text: Column) -> Column:
    """What a row without doc_id is drawn by."""
    return F.when(F.col("doc_id").isNull(), F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("draw")


def mix(docs: DataFrame, text: str = "text", **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    sizes = shared.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source"), words(F.col(text)).alias("size"), draw(F.col(text))), "sizes")
    return copies(sizes, cuts(sizes, **how)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """documents as the mix takes them: each row as often as it has copies."""
    sizes = shared.written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words(F.col("text")).alias("size"), draw(F.col("text"))), "sizes")
    named = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), words(F.col("text")).alias("size"), draw(F.col("text")))
    return copies(named, cuts(sizes, **how)).filter("copies > 0").select("row", F.explode(F.expr("sequence(1, copies)"))).select("row.*")
