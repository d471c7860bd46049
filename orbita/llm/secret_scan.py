"""Secret scans, in SQL functions only: fixed patterns and a randomness test battery.

Base spans come from three patterns.  The battery looks at other runs of
token characters: the encoding is inferred from the alphabet used (hex, base32
or base64), then three statistics of a uniformly random string over that
alphabet are tested: chi-squared of character counts, number of runs of
symbols above and below the middle, and lag-one serial correlation.  The
p-values that the string is random are combined (the least, times three).  A
string whose randomness is rejected isn't a secret.  The rejections in each
stratum of encoding and length are controlled by Benjamini and Hochberg's rule,
over all candidates of the corpus (p-values in 64 bins; the bins are counted,
not the rows gathered); short strings, whose tests are weak, are rejected at a
larger rate.  What isn't rejected, and is no part of a base span, is added as
kind ``random``.

Positions count code points, end exclusive; a span is the whole match.

Defined results: null text is empty; a document without spans has the empty
string in spans and base_sha256 of the empty string; spans with equal places stand in
the order of kinds; equal strings are judged alike; repeated rows give repeated results;
texts of any length are read whole, in time and memory that grow with them; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

# The patterns and least lengths of the base spans.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = (("assign", 8), ("access", 16), ("hex", 32), ("random", 0))

#: A candidate has 20 characters at least and both a letter and a digit.
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
ALPHABETS = (("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 16), ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 32), ("base64", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 64))
BINS = 64


def _matches(text: str, pattern: str, kind: int, guard: str) -> str:
    """SQL: array of (kind, i, gap, v), the leftmost non-overlapping matches in order with the code points before each.

    Gaps between matches come from the same pattern's split.  ``guard`` is a cheap test that has no false negatives.
    """
    found = f"zip_with(regexp_extract_all({text}, r'{pattern}', 0), transform(split({text}, r'{pattern}', -1), g -> char_length(g)), (v, g) -> struct(v, g))"
    return f"if({guard}, transform(filter({found}, x -> x.v is not null), (x, i) -> struct({kind} as kind, i, x.g as gap, x.v as v)), cast(array() as array<struct<kind:int,i:int,gap:int,v:string>>))"


def _quoted(pattern: str) -> str:
    return pattern.replace("'", r"\x27")


def _normal_tail(z: Column) -> Column:
    """Two-sided tail of a standard normal (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    series = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.least(F.lit(1.0), 2 * F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series)


def battery(candidates: DataFrame) -> DataFrame:
    """Rows with value -> also enc, n, p: how likely a random string of that encoding looks as uneven."""
    v = F.rtrim(F.regexp_replace("value", "=+$", ""))
    enc = F.when(v.rlike(ALPHABETS[0][1]), 0).when(v.rlike(ALPHABETS[1][1]), 1).otherwise(2)
    df = candidates.withColumn("enc", enc).withColumn("body", F.when(F.col("enc") == 0, F.lower(v)).otherwise(F.translate(v, "-_", "+/")))
    k = F.element_at(F.array(*(F.lit(float(a[3])) for a in ALPHABETS)), F.col("enc") + 1)
    alphabet = F.element_at(F.array(*(F.lit(a[2]) for a in ALPHABETS)), F.col("enc") + 1)
    df = df.withColumn("k", k).withColumn("n", F.length("body").cast("double"))
    df = df.withColumn("codes", F.transform(F.split("body", ""), lambda c: F.call_function("instr", alphabet, c).cast("double") - 1)).withColumn("codes", F.filter("codes", lambda c: c >= 0))
    counts = F.transform(F.array_distinct("codes"), lambda c: F.size(F.filter(F.col("codes"), lambda d: d == c)).cast("double"))
    squares = F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * c)
    # variance of the sum of squares under uniform multinomial counts
    mean = F.col("n") + F.col("n") * (F.col("n") - 1) / F.col("k")
    spread = F.sqrt(2 * F.col("n") * (F.col("n") - 1) * (1 / F.col("k")) * (1 - 1 / F.col("k")))
    df = df.withColumn("z1", (squares - mean) / spread)
    middle = (F.col("k") - 1) / 2
    pairs = F.zip_with(F.slice("codes", F.lit(1), F.size("codes") - 1), F.slice("codes", F.lit(2), F.size("codes") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    df = df.withColumn("pairs", pairs)
    turns = F.aggregate("pairs", F.lit(0.0), lambda s, x: s + ((x["a"] > middle) != (x["b"] > middle)).cast("double"))
    products = F.aggregate("pairs", F.lit(0.0), lambda s, x: s + (x["a"] - middle) * (x["b"] - middle))
    variance = (F.col("k") * F.col("k") - 1) / 12
    df = df.withColumn("z2", (turns - (F.col("n") - 1) / 2) / F.sqrt((F.col("n") - 1) / 4)).withColumn("z3", products / (variance * F.sqrt(F.col("n") - 1)))
    p1 = F.when(F.col("z1") > 0, _normal_tail(F.col("z1")) / 2).otherwise(1 - _normal_tail(F.col("z1")) / 2)
    least = F.least(p1, _normal_tail(F.col("z2")), _normal_tail(F.col("z3")))
    return df.withColumn("p", F.least(F.lit(1.0), 3 * least)).drop("k", "body", "codes", "pairs", "z1", "z2", "z3")


def rate(n: Column) -> Column:
    """False discovery rate allowed when randomness is rejected: larger where the tests are weak."""
    return F.when(n < 24, 0.3).when(n < 40, 0.2).when(n < 64, 0.1).otherwise(0.05)


def rejection_limits(tested: DataFrame) -> DataFrame:
    """(enc, stratum, n, p) -> at most 3 x 8 rows: the largest rejected p-value bin of each stratum."""
    binned = tested.groupBy("enc", "stratum", F.least(F.lit(BINS - 1), F.floor(-2 * F.log2(F.greatest("p", F.lit(1e-300))))).alias("bin")).agg(F.count(F.lit(1)).alias("c"), F.min("n").alias("n"))
    w = Window.partitionBy("enc", "stratum")
    ranked = binned.withColumn("rank", F.sum("c").over(w.orderBy(F.col("bin").desc()))).withColumn("m", F.sum("c").over(w)).withColumn("least", F.min("n").over(w))
    ok = F.pow(F.lit(2.0), -F.col("bin") / 2)  # the bin's upper edge
    return ranked.filter(ok <= rate(F.col("least")) * F.col("rank") / F.col("m")).groupBy("enc", "stratum").agg(F.min("bin").alias("limit"))


def located(docs: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, doc_id) of every document, and (row, kind, start, end, value) of base spans and of candidates beside them.

    A match is a row of its own from here on; places are sums over one document's matches, so time and
    memory grow with the matches, whatever a text holds.
    """
    quoted = _quoted(ASSIGN)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    every = [
        _matches("t", quoted, 0, "t rlike '(?i:passw|secret|token|api_?key)'"),
        _matches("t", ACCESS, 1, "contains(t, 'AKIA')"),
        _matches("t", HEX[:-1] + "{32,}", 2, "t rlike '[0-9a-f]{32}'"),
        _matches("t", CANDIDATE, 3, "t rlike '[A-Za-z0-9+/_-]{20}'"),
    ]
    # written, so that row numbers stay
    rows = shared.written(rows.select("row", "doc_id", F.expr(f"concat({', '.join(every)})").alias("matches")), "matches")
    some = rows.select("row", F.explode("matches").alias("m")).select("row", "m.kind", "m.i", "m.gap", "m.v")
    upto = F.sum(F.col("gap") + F.char_length("v")).over(Window.partitionBy("row", "kind").orderBy("i")).cast("int")  # one document's
    spans = some.withColumn("end", upto).withColumn("start", F.col("end") - F.char_length("v"))
    keep = F.when(F.col("kind") == 0, F.char_length(F.regexp_extract("v", ASSIGN, 2)) >= 8).when(F.col("kind") == 1, F.char_length("v") >= 16).when(F.col("kind") == 2, True).otherwise(F.col("v").rlike("[0-9]") & F.col("v").rlike("[A-Za-z]"))
    spans = spans.filter(keep).select("row", "kind", "start", "end", F.when(F.col("kind") == 3, F.col("v")).alias("value"))
    # a candidate overlaps a base span that began before and hasn't ended, or one that begins inside
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(Window.partitionBy("row").orderBy("start", "kind"))
    after = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("kind").desc()))
    seen = spans.withColumn("before", before).withColumn("after", after)
    free = (F.coalesce("before", F.lit(0)) <= F.col("start")) & (F.col("after").isNull() | (F.col("after") >= F.col("end")))
    return rows.select("row", "doc_id"), shared.written(seen.filter(base | free).drop("before", "after"), "spans")


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows, spans = located(docs, text)
    stratum = F.least(F.lit(7), F.floor(F.log2(F.col("n") / 20.0) * 2)).cast("int")
    found = spans.filter("kind = 3")
    tested = battery(found.groupBy("value").agg(F.count(F.lit(1)).alias("rows"))).withColumn("stratum", stratum)
    tested = shared.written(tested.select("value", "enc", "stratum", "n", "p"), "tested")
    limits = rejection_limits(tested)
    random = tested.join(F.broadcast(limits), ["enc", "stratum"], "left").filter(F.col("limit").isNull() | (F.floor(-2 * F.log2(F.greatest("p", F.lit(1e-300)))) < F.col("limit"))).select("value")
    kept = spans.filter("kind < 3").unionByName(found.join(random, "value", "left_semi").select(spans.columns))
    lists = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("all"))
    every = rows.join(lists, "row", "left").withColumn("all", F.coalesce("all", F.expr("cast(array() as array<struct<start:int,kind:int,end:int>>)")))
    every = every.withColumn("base", F.filter("all", lambda x: x["kind"] < 3))
    names = ", ".join(f"'{k}'" for k, _ in KINDS)
    joined = lambda arr: F.expr(f"array_join(transform({arr}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')")
    count = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)")
    return every.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined("base"), 256).alias("base_sha256"), joined("all").alias("spans"))
