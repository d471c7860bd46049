"""Spelling variants: a symmetric-delete join over the words of a corpus.

Every word emits itself and its distinct single deletions, as 64-bit keys: polynomial
hashes of whole batches, of which a deletion takes one product, so a word's keys cost
its length once.  Equal keys meet in two equi-joins: a word with another's deletion
(one code point more), and two deletions of the same place (one code point replaced).
Keyed so, a key's rows are no more than the alphabet has letters for each place, and
every pair that meets is a link but for colliding hashes, which comparing the words
removes.  Forms are aggregates of links; roots come from joining forms to forms until
none moves, in as many rounds as the longest chain has binary digits.

Words are maximal runs of letters (A-Z, a-z and U+00C0 to U+00FF) with A-Z in lower
case; one occurrence in 97, as a hash of document and run decides, loses a code point
(these are the spelling errors to be found); words shorter than 5 code points or
with fewer than 3 occurrences are left out.

Defined results: null and empty texts have no words; a null doc_id counts as the empty
string; rows repeated count as often as they stand; ties go to the smallest word in code
point order; runs of any length are words, at the cost of their length; other columns
are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

RUN = r"[A-Za-z\u00C0-\u00FF]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ONE_IN, LEAST_LENGTH, LEAST_COUNT, RATIO = 97, 5, 3, 2
#: Base of the polynomial hash (odd, so it has an inverse modulo 2^64).
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
ROWS = 1 << 18


def without(word: Column, at: Column) -> Column:
    """The word less its code point at a place, counted from 0."""
    return F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.char_length(word)))


def occurrences(docs: DataFrame, one_in: int = ONE_IN, least: int = LEAST_LENGTH) -> DataFrame:
    """(doc_id, text) -> (word), a row an occurrence."""
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc")
    runs = docs.select(doc, F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run")).filter(F.char_length("run") >= least)
    # lower() does no more than lower-case A-Z where all is ASCII
    low = F.when(F.octet_length("run") == F.char_length("run"), F.lower("run")).otherwise(F.translate("run", UPPER, LOWER))
    runs = runs.select("doc", low.alias("run")).withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    cut = without(F.col("run"), (F.col("h") % F.char_length("run")).cast("int"))
    return runs.select(F.when(F.col("h") % one_in == 0, cut).otherwise(F.col("run")).alias("word")).filter(F.char_length("word") >= least)


def vocabulary(docs: DataFrame, least_count: int = LEAST_COUNT) -> DataFrame:
    """(id, word, n): the words with enough occurrences; ids are fixed by writing."""
    counted = occurrences(docs).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)
    return shared.written(counted.select(F.monotonically_increasing_id().alias("id"), "word", "n"), "words")


def keys_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of whole words; and for each code point of all words: hash of the word without it, its word, its place, whether it begins a run of equal ones."""
    sizes = np.array([len(w) for w in words], np.int64)
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(points)) - starts[word]
    mixed = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(32)
    powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(int(sizes.max(initial=1)), BASE, np.uint64))])
    sums = np.concatenate([[np.uint64(0)], np.add.accumulate(mixed * powers[place], dtype=np.uint64)])
    whole = sums[ends] - sums[starts]
    index = np.arange(len(points))
    less = (sums[index] - sums[starts[word]]) + (sums[ends[word]] - sums[index + 1]) * np.uint64(INVERSE)
    begins = np.ones(len(points), bool)
    begins[1:] = (points[1:] != points[:-1]) | (place[1:] == 0)
    return whole, less, word, place, begins


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, word) -> (key, place: -1 for the word itself, begins, id)."""
    for b in batches:
        ids, (whole, less, word, place, begins) = b.column(0).to_numpy(), keys_of(b.column(1).to_pylist())
        names = ["key", "place", "begins", "id"]
        yield pa.record_batch([pa.array(whole.view(np.int64)), pa.array(np.full(len(ids), -1, np.int32)), pa.array(np.ones(len(ids), bool)), pa.array(ids)], names=names)
        for at in range(0, len(less), ROWS):
            some = slice(at, at + ROWS)
            yield pa.record_batch([pa.array(less[some].view(np.int64)), pa.array(place[some].astype(np.int32)), pa.array(begins[some]), pa.array(ids[word[some]])], names=names)


def near_words(words: DataFrame) -> DataFrame:
    """(id, word, n) -> (id, n, other, other_n): both directions of every pair that differs by one code point."""
    keys = shared.written(words.select("id", "word").mapInArrow(_emit, "key long, place int, begins boolean, id long"), "keys")
    less = keys.filter("place >= 0")
    longer = less.filter("begins").select("key", "place", F.col("id").alias("a"))
    more = longer.join(keys.filter("place < 0").select("key", F.col("id").alias("b")), "key").select("a", "b", "place", F.lit(False).alias("replaced"))
    same = less.select("key", "place", F.col("id").alias("a")).join(less.select("key", "place", F.col("id").alias("b")), ["key", "place"]).filter("a < b")
    pairs = more.unionByName(same.select("a", "b", "place", F.lit(True).alias("replaced")))
    side = lambda x: words.select(F.col("id").alias(x), F.col("word").alias(f"{x}_word"), F.col("n").alias(f"{x}_n"))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    a, b, at = F.col("a_word"), F.col("b_word"), F.col("place")
    one = F.when(F.col("replaced"), (F.char_length(a) == F.char_length(b)) & (a != b) & (without(a, at) == without(b, at))).otherwise(without(a, at) == b)
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("a_n").alias("n"), b.alias("other"), F.col("b_n").alias("other_n")), F.struct(F.col("b").alias("id"), F.col("b_n").alias("n"), a.alias("other"), F.col("a_n").alias("other_n")))
    return met.filter(one).select(F.explode(ends).alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root): forms followed to the last; every form is commoner than its word, so chains end."""
    at = shared.written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        new = shared.written(at.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        at = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return at


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n."""
    words = vocabulary(docs)
    best = near_words(words).groupBy("id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    common = -F.col("best.less") >= ratio * F.col("n")
    table = words.join(best, "id", "left").select("word", F.when(common, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(common, -F.col("best.less")).alias("form_n"))
    table = shared.written(table, "forms")
    last = roots(table.filter("form is not null"))
    return table.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
