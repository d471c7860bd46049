"""SimHash document fingerprints, in DataFrame functions only.

Terms are the word pairs of a text (a lone word is its own term); each
occurrence of a term is a vote of weight one, so a term weighs as often as it
stands.  Term hashes vote on 64 signed bits.  Votes are counted two bits to a
long, in 32-bit lanes: 32 sums a document, all within generated code, and a
document's terms meet in the map-side aggregate.

Fingerprints are 16 lowercase hex digits.  Likeness is 1 - distance / 64.

Defined results: null text is empty; a text without words has the fingerprint
0000000000000000; equal texts have equal fingerprints; a null doc_id sorts as
the least; rows repeated with one id are ordered by their texts; other columns
are ignored; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

BITS, LANES = 64, 32
RADIUS, LEAD = 3, 3
ROWS_PER_BUCKET, MOST_BUCKETS = 512, 100_000
LEAST_ID = -(1 << 63)


def terms(text: Column) -> Column:
    """Array of (word, next word); the last word stands alone where it is the only one."""
    words = F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), r"[\x20\x09-\x0D]+")
    return F.when(F.size(words) > 1, F.arrays_zip(F.slice(words, F.lit(1), F.size(words) - 1).alias("a"), F.slice(words, F.lit(2), F.size(words) - 1).alias("b"))).otherwise(F.arrays_zip(words.alias("a"), F.array(F.lit("")).alias("b")))


def _lane(h: Column, j: int) -> Column:
    return F.shiftrightunsigned(h, j).bitwiseAND(F.lit(0x0000000100000001))


def fingerprints(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys -> fp (long), and n_terms.  Keys must tell texts apart; keys already dealt by aren't dealt again."""
    exploded = df.select(*keys, F.explode(terms(F.coalesce(F.col(text), F.lit(""))))).select(*keys, "col.a", "col.b")
    hashed = exploded.select(*keys, F.when((F.col("a") != "") | (F.col("b") != ""), F.xxhash64("a", "b")).alias("h"))
    votes = hashed.groupBy(*keys).agg(F.count("h").alias("n_terms"), *(F.sum(_lane(F.col("h"), j)).alias(f"v{j}") for j in range(LANES)))
    low = lambda j: F.col(f"v{j}").bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda j: F.shiftrightunsigned(F.col(f"v{j}"), 32)
    bit = lambda votes, at: F.when(votes * 2 > F.col("n_terms"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))
    fp = reduce(lambda x, y: x.bitwiseOR(y), [bit(low(j), j) for j in range(LANES)] + [bit(high(j), j + 32) for j in range(LANES)])
    return votes.select(*keys, "n_terms", F.coalesce(fp, F.lit(0).cast("long")).alias("fp"))


def shown(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def edited_neighbours(docs: DataFrame) -> DataFrame:
    """Each document with its successor in descending doc_id: bucket, rn, guest, doc_id, text, next_text.

    Ids are dealt into ranges of equal width, and dense ranges again until none holds four
    times the mean or more, so outlying ids don't gather the others; the first document of each range is also a guest
    at the end of the range before, so a window inside a range sees every
    successor and texts move once.  The table of ranges is bounded.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("id", F.coalesce("doc_id", F.lit(LEAST_ID)))
    low, high, n = rows.agg(F.min("doc_id"), F.max("doc_id"), F.count(F.lit(1))).first()
    count = max(1, min(MOST_BUCKETS, n // ROWS_PER_BUCKET))
    low, high = low or 0, high or 0
    start = lambda lo, w: F.expr(f"cast({lo} + if(doc_id is null, 0, (cast(doc_id as decimal(20, 0)) - {lo}) div {w}) * {w} as bigint)")
    rows = rows.withColumn("bucket", start(f"{low}BD", f"{max(1, -(-(high - low + 1) // count))}BD"))
    most = 4 * -(-n // count)
    while True:  # ids stand close in some ranges: these are cut again, between the ids that they have
        dense = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").cast("decimal(20, 0)").alias("lo"), F.max("doc_id").cast("decimal(20, 0)").alias("hi")).filter((F.col("n") > most) & (F.col("lo") < F.col("hi")))
        dense = shared.written(dense.selectExpr("bucket", "lo", f"greatest(1, cast(ceil((hi - lo + 1) / ceil(n * {count} / {n}D)) as decimal(20, 0))) as w"), "dense")
        if dense.isEmpty():
            break
        cut = rows.join(F.broadcast(dense), "bucket", "left")  # a quarter of the ranges at most
        rows = cut.withColumn("bucket", F.when(F.col("lo").isNull(), F.col("bucket")).otherwise(start("lo", "w"))).drop("lo", "w")
    heads = rows.groupBy("bucket").agg(F.max("id").alias("id"))
    first = F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), F.min("bucket").over(Window.partitionBy()))
    # the head of a range is a guest in the next higher one; the highest's in the lowest
    heads = heads.select("id", first.alias("host"))
    guests = rows.join(F.broadcast(heads), "id").withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("text").desc()))).filter("k = 1")
    every = rows.select("bucket", "id", "doc_id", "text", F.lit(0).alias("guest")).unionByName(guests.select(F.col("host").alias("bucket"), "id", "doc_id", "text", F.lit(1).alias("guest")))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc(), F.col("text").desc())
    return every.select("bucket", F.row_number().over(order).alias("rn"), "guest", "doc_id", "text", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next_text"))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    rows = edited_neighbours(docs)
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.select("bucket", "rn", "guest", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    keys = ["bucket", "rn", "guest", "doc_id", "n_chars", "sha", "kind"]
    both = rows.withColumn("sha", F.sha2(F.col("edited"), 256)).select(*keys[:-1], F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x")).select(*keys[:-1], "x.kind", F.col("x.t").alias("t"))
    fp = fingerprints(both, keys, "t")
    order = Window.partitionBy("bucket").orderBy("rn", "kind")  # text, edited, next text
    out = fp.select(*keys, "fp", F.lead("fp", 1).over(order).alias("e"), F.lead("fp", 2).over(order).alias("x")).filter("kind = 0 and guest = 0")
    return out.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), shown(F.col("fp")).alias("fingerprint"), shown(F.col("e")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("e")).alias("near_edited"), likeness(F.col("fp"), F.coalesce("x", "fp")).alias("near_next"))


def permuted_blocks(radius: int, lead: int = LEAD) -> tuple[list[tuple[int, int]], list[tuple[int, ...]]]:
    """(shift, width) of radius + lead blocks, and the tables: the blocks that lead in each.

    Within the radius at most ``radius`` blocks differ, so ``lead`` of them at least are equal.
    """
    n = radius + lead
    edges = [BITS * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)], list(combinations(range(n), lead))


def within_radius(fps: DataFrame, radius: int = RADIUS, lead: int = LEAD) -> DataFrame:
    """(fp) -> all pairs (a, b, distance), a < b, of distinct fingerprints within a Hamming radius.

    One table for each choice of ``lead`` blocks: fingerprints permuted so that these
    blocks lead, joined on them.  A pair is given by its first common table alone, so none
    comes twice.  Equal fingerprints meet before: they are one row here.  The leading bits
    (32 of 64 for a radius of 3 and 3 blocks of 6) are what keeps buckets small; a larger
    ``lead`` makes more tables with smaller buckets.
    """
    if not 0 <= radius < 16 or lead < 1:
        raise ValueError("radius is 0 to 15, lead 1 or more")
    distinct = fps.select("fp").filter("fp is not null").distinct()
    blocks, chosen = permuted_blocks(radius, lead)
    value = lambda fp, s, w: F.shiftrightunsigned(fp, s).bitwiseAND(F.lit((1 << w) - 1)) if w < 64 else fp
    bits = lambda k: (((1 << blocks[k][1]) - 1) << blocks[k][0]) & ((1 << 64) - 1)
    masks = [sum(bits(k) for k in c) for c in chosen]
    signed = lambda m: F.lit(m - (1 << 64) if m >> 63 else m).cast("long")
    tables = distinct.select("fp", F.posexplode(F.array(*(F.col("fp").bitwiseAND(signed(m)) for m in masks))).alias("number", "lead"))
    a, b = tables.select(F.col("fp").alias("a"), "number", "lead"), tables.select(F.col("fp").alias("b"), "number", "lead")
    near = a.join(b, ["number", "lead"]).filter("a < b").withColumn("distance", F.bit_count(F.col("a").bitwiseXOR(F.col("b"))).cast("int")).filter(F.col("distance") <= radius)
    equal = F.array(*(F.when(value(F.col("a"), s, w) == value(F.col("b"), s, w), k) for k, (s, w) in enumerate(blocks)))
    first = F.slice(F.array_compact(equal), 1, lead)
    return near.filter(first == F.element_at(F.array(*(F.array(*map(F.lit, c)) for c in chosen)), F.col("number") + 1)).select("a", "b", "distance")


def with_neighbours(report: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The report, and n_within: how many other fingerprints lie within the radius of a document's."""
    report = shared.written(report, "fingerprints")
    fp = lambda c: F.conv(c, 16, -10).cast("long")
    pairs = within_radius(report.select(fp(F.col("fingerprint")).alias("fp")), radius)
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count(F.lit(1)).alias("n_within"))
    ends = ends.select(shown(F.col("fp")).alias("fingerprint"), "n_within")
    return report.join(ends, "fingerprint", "left").select(*report.columns, F.coalesce("n_within", F.lit(0)).alias("n_within"))
