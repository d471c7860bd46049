"""Threshold selectors over (group columns, score) rows, by counting instead of sorting.

A double's 64 bits, with the sign turned round, are in the order of the doubles.  A pass
counts, for all groups at once, the rows by the next 16 bits below what is known of each
wanted place, and so learns these bits; after a pass or two a place has few candidates
left, which are then looked at, and after four passes it has one value.  What a group
gathers is a histogram of at most 2^16 rows; scores are never sorted nor held together.

Scores of keys and queries (``Pairs``) are counted where they are made, without a row a score.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans import ranks, selection, tables
from ..plans.selection import Pairs
from . import vec

DIGIT = 16
#: Candidates of a place that may be gathered and sorted.
FEW = 4096
_LOW, _SIGN = (1 << 63) - 1, -(1 << 63)


def ordered_bits(x: Column) -> Column:
    """A long in the order of the doubles (as unsigned); 0.0 and -0.0 are equal, NaN is the largest."""
    raw = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), x.cast("double") + F.lit(0.0)).cast("long")
    return F.when(raw >= 0, raw.bitwiseXOR(F.lit(_SIGN).cast("long"))).otherwise(F.bitwise_not(raw))


def of_bits(u: Column) -> Column:
    """The double of an ordered long."""
    raw = F.when(u < 0, u.bitwiseXOR(F.lit(_SIGN).cast("long"))).otherwise(F.bitwise_not(u))
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), raw).cast("double")


def selected(scores: DataFrame | Pairs, by: list[str], places: dict[str, Callable[[Column], Column]], few: int = FEW) -> DataFrame:
    """by, n, and for each name the score at a place: counted from 1, ascending, a column over n; null where it isn't in 1..n."""
    if isinstance(scores, Pairs):
        if (found := selection.selected(scores, places)) is not None:
            return found.select(*by, "n", *places)
        scores = scores.rows()
    rows = scores.filter("score is not null").select(*by, ordered_bits(F.col("score")).alias("u"))
    first = tables.saved(rows.groupBy(*by, F.shiftrightunsigned("u", 64 - DIGIT).alias("digit")).agg(F.count(F.lit(1)).alias("c")), "digits")
    sizes = first.groupBy(*by).agg(F.sum("c").alias("n"))
    wanted = F.array(*(F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("place")) for name, place in places.items()))
    want = sizes.select(*by, F.explode(wanted).alias("w")).select(*by, F.lit(0).cast("long").alias("prefix"), "w.name", "w.place")
    picked, done = _picked(first.withColumn("prefix", F.lit(0).cast("long")), want, by), DIGIT
    while done < 64 and (picked.agg(F.max("c")).first()[0] or 0) > few:
        hist = _within(rows, picked, by, done).groupBy(*by, "prefix", F.shiftrightunsigned("u", 64 - DIGIT - done).bitwiseAND(F.lit((1 << DIGIT) - 1)).alias("digit")).agg(F.count(F.lit(1)).alias("c"))
        picked = _picked(tables.saved(hist, "digits"), picked.select(*by, "prefix", "name", "place"), by)
        done += DIGIT
    if done < 64:
        left = _within(rows, picked, by, done).groupBy(*by, "prefix").agg(F.sort_array(F.collect_list(F.col("u").bitwiseXOR(F.lit(_SIGN).cast("long")))).alias("some"))
        found = picked.join(left, [*by, "prefix"]).select(*by, "name", of_bits(F.element_at("some", F.col("place").cast("int")).bitwiseXOR(F.lit(_SIGN).cast("long"))).alias("score"))
    else:
        found = picked.select(*by, "name", of_bits(F.col("prefix")).alias("score"))
    wide = found.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("score"))).alias(name) for name in places))
    return sizes.join(wide, by, "left").select(*by, "n", *places)


def _within(rows: DataFrame, picked: DataFrame, by: list[str], done: int) -> DataFrame:
    """The rows that share the known bits of some wanted place."""
    known = tables.small(picked.select(*by, "prefix").distinct())
    return rows.withColumn("prefix", F.shiftrightunsigned("u", 64 - done)).join(known, [*by, "prefix"])


def _picked(hist: DataFrame, want: DataFrame, by: list[str]) -> DataFrame:
    """(by, prefix, digit, c) and (by, prefix, name, place) -> by, prefix with the digit, name, place among those, c of them."""
    upto = hist.withColumn("upto", F.sum("c").over(Window.partitionBy(*by, "prefix").orderBy("digit")))  # a histogram's rows
    got = upto.join(want, [*by, "prefix"]).filter("upto >= place and place > upto - c")
    longer = F.shiftleft("prefix", DIGIT).bitwiseOR(F.col("digit"))
    return tables.saved(got.select(*by, longer.alias("prefix"), "name", (F.col("place") - F.col("upto") + F.col("c")).alias("place"), "c"), "picked")


def _clamped(place: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.least(n, place))


def topk(scores: DataFrame | Pairs, by: list[str], k: int) -> DataFrame:
    """The k-th largest score (the least, where there are fewer): at least k hits (ties all count)."""
    return selected(scores, by, {"threshold": lambda n: _clamped(n + 1 - k, n)}).select(*by, "threshold")


def nth(scores: DataFrame | Pairs, by: list[str], target: int) -> DataFrame:
    """Zero-based index in descending order: target + 1 hits."""
    return topk(scores, by, target + 1)


def tau(scores: DataFrame | Pairs, by: list[str], share: float) -> DataFrame:
    """Value at int((1 - share) * n), zero-based, in descending order."""
    return selected(scores, by, {"threshold": lambda n: _clamped(n - F.floor((1 - share) * n), n)}).select(*by, "threshold")


def quantile(scores: DataFrame | Pairs, by: list[str], p: float, accuracy: int | None = None) -> DataFrame:
    """Linear-interpolated quantile; with accuracy, the sketch that needs no exact order."""
    if accuracy is not None:
        scores = scores.rows() if isinstance(scores, Pairs) else scores
        return scores.groupBy(*by).agg(F.percentile_approx("score", p, accuracy).alias("threshold"))
    at = lambda n: F.lit(p) * (n - 1)
    both = selected(scores, by, {"low": lambda n: F.floor(at(n)) + 1, "high": lambda n: F.ceil(at(n)) + 1})
    share = at(F.col("n")) - F.floor(at(F.col("n")))
    return both.select(*by, F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.col("low") * (1 - share) + F.col("high") * share).alias("threshold"))


def midpoint(scores: DataFrame | Pairs, by: list[str]) -> DataFrame:
    """Middle of the gap at the median: no score lies on it unless they tie."""
    upper = lambda n: _clamped(n + 1 - F.floor(n / 2), n)
    both = selected(scores, by, {"high": upper, "low": lambda n: _clamped(n - F.floor(n / 2), n)})
    return both.select(*by, ((F.col("high") + F.col("low")) / 2).alias("threshold"))


def sampled(config, keys: DataFrame, q: DataFrame, k: int) -> DataFrame:
    """query_id, q_head, threshold, by the config's method, from its sample of each head's keys.

    topk: the score of the k-th key, by the sample's share; sample_max: the sample's best score;
    sample_mean_topk: the mean of the sample's k best (of all, where there are fewer).
    """
    few = ranks.numbered(keys.select("kv_head", "key_id", "key"), ["kv_head"], _drawn("key_id"), "drawn").filter(F.col("drawn") <= config.sample_size).drop("drawn")
    few = tables.saved(few, "sample")
    by = ["query_id", "q_head"]
    scores = few.join(tables.small(q.select(*by, "kv_head", "q")), "kv_head").select(*by, "kv_head", vec.score("q", "key").alias("score"))
    if config.threshold_method == "topk":
        share = keys.groupBy("kv_head").agg(F.count(F.lit(1)).alias("all")).join(few.groupBy("kv_head").agg(F.count(F.lit(1)).alias("some")), "kv_head")
        place = F.greatest(F.lit(1), F.round(F.lit(k) * F.col("some") / F.col("all")))
        wide = scores.join(tables.small(share), "kv_head").withColumn("wanted", place.cast("long"))
        return selected(wide, [*by, "wanted"], {"threshold": lambda n: _clamped(n + 1 - F.col("wanted"), n)}).select(*by, "threshold")
    if config.threshold_method == "sample_max":
        return scores.groupBy(*by).agg(F.max("score").alias("threshold"))
    best = selected(scores, by, {"least": lambda n: _clamped(n + 1 - k, n)})
    # ties at the k-th count as often as they fill up k
    over = scores.join(tables.small(best), by).groupBy(*by, "least", "n").agg(F.sum(F.when(F.col("score") > F.col("least"), F.col("score"))).alias("above"), F.count(F.when(F.col("score") > F.col("least"), 1)).alias("c"))
    size = F.least(F.lit(k), F.col("n"))
    return over.select(*by, ((F.coalesce("above", F.lit(0.0)) + (size - F.col("c")) * F.col("least")) / size).alias("threshold"))


def _drawn(key: str) -> list:
    return [F.xxhash64(F.lit(17), key), F.col(key)]
