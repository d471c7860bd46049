"""Near-duplicates by Order MinHash, verified by banded alignment.

A document is its lower-cased words.  Its k-mers are runs of five words, each
labelled with its occurrence number.  For each of ``SKETCHES`` hash functions the
``LEAST`` smallest labelled k-mers are taken and put back into text order; the
hash of that tuple is one sketch.  Two texts share a sketch if the same k-mers
are least in both *and* stand in the same order, which follows edit similarity
rather than mere overlap.  Texts that share a sketch are candidates; they are a
link if their word edit similarity (1 - distance / words of the longer) is
``SIMILARITY`` or more.  It is 0.9: at 0.8 links need not share a run of five words
at all, so no method on five-word runs could find them.

No bucket is gathered or expanded into pairs.  Equal texts are one node before
that.  First each bucket's members are compared with its smallest member, and
components are formed; a bucket whose members all have one label is done.  In the
others, members whose label isn't the commonest there are compared with one that has
it, and components grow; of what is still mixed (buckets of the same members count
once), members whose label isn't the commonest are compared with
all members of other labels and fitting length, so that of the links between
candidates none is lost; words, and couples of adjacent words, as bags bound the
distance from below and spare most alignments.  Joins on pairs and words are dealt at every size; keys that very
many texts share are found in a sample and summed before they are dealt, which
changes the plan's work, never its result.

Chance of missing a link whose k-mers have Jaccard similarity j: about
(1 - j ** LEAST) ** SKETCHES.  Edits spread evenly, which spare fewest k-mers, leave j = 1 / 3
in long texts at the least similarity, and less in short ones, which have more sketches; a
test holds the share of links that meet to 0.9 wherever the edits are.  Links between
texts of at most ``SHORT`` words are all found, by keys of their own (``short_keys``).

Words are aligned by 32-bit hashes: two words of one pair of texts are taken for
the same by mistake with a chance of 2 ** -32.

Defined results: null text is empty; texts without words are equal; of texts of
fewer than ten words only equal ones are links; a row without
doc_id is its own class, with null class_id, and stays; rows that share an id
are one node, whose links are those of all their texts; of equal texts the
smallest doc_id names the class; empty tables give no rows; very long texts are
read whole, a pair of texts of n words that can't be ruled out costs up to
(1 - SIMILARITY) * n * n cells in one task; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .components import components, extended

K, LEAST, SKETCHES, SIMILARITY = 5, 3, 84, 0.9
FEW_WORDS, MORE_SKETCHES = 128, 128  # texts of few words have fewer k-mers between edits, so more sketches
SHORT, DELETED = 36, 14  # words of texts whose links are all found; of those found by deleting words
CHUNK, CHUNK_WORDS, STEPS, MOST_BINS, LEVELS = 2048, 1 << 20, 3, 4096, 4  # rows and words of a side of a block at most; of classes of length; of bags
MEMBER = ("node", "n_words", "label", "foreign")
SAMPLED, OFTEN, SHARES = 50_000, 64, 256  # texts sampled for keys that very many share; how often such a key stands in the sample; its shares
PER_LABEL = 2  # a label's texts meet foreign ones at once if that makes this many times the pairs of single buckets at most
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_LARGEST = np.uint64((1 << 64) - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _B
    return x ^ (x >> np.uint64(27))


#: Odd factors that order k-mers, one for each sketch.
_SEEDS = _mixed(_mixed(np.arange(1, MORE_SKETCHES + 1, dtype=np.uint64) * _A) * _A) | np.uint64(1)


def kmers(words: np.ndarray, k: int = K) -> np.ndarray:
    n = len(words) - k + 1
    if n <= 0:
        return _mixed(np.array([np.bitwise_xor.reduce(_mixed(words * (2 * np.arange(len(words), dtype=np.uint64) + np.uint64(1)) + _A))]))
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * _A + words[j : j + n]
    return _mixed(out)


def labelled(found: np.ndarray) -> np.ndarray:
    """k-mers with their occurrence number worked in."""
    order = np.argsort(found, kind="stable")
    ordered = found[order]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    if new.all():
        return found
    starts = np.flatnonzero(new)
    nth = np.arange(len(found)) - np.repeat(starts, np.diff(np.r_[starts, len(found)]))
    out = found.copy()
    # a first occurrence is the k-mer itself, so that texts with and without repeats agree
    out[order] = np.where(nth == 0, ordered, _mixed(ordered + nth.astype(np.uint64) * _A))
    return out


def sketch(words: np.ndarray, k: int = K, least: int = LEAST, count: int | None = None) -> np.ndarray:
    """One 64-bit value for each hash function."""
    count = count or (MORE_SKETCHES if len(words) <= FEW_WORDS else SKETCHES)
    found = kmers(words, k)
    marked = labelled(found)
    take = min(least, len(found))
    out = np.zeros(count, np.uint64)
    step = max(1, 250_000 // len(found))  # values of a turn stay in cache
    for at in range(0, count, step):
        seeds = _SEEDS[at : min(count, at + step)]
        # k-mers are mixed already, so an odd factor gives an order; the few least are taken one by one
        values = marked[None, :] * seeds[:, None]
        every = np.arange(len(seeds))
        where = np.empty((len(seeds), take), np.int64)
        for j in range(take):
            where[:, j] = values.argmin(1)
            values[every, where[:, j]] = _LARGEST
        picked = marked[np.sort(where, 1)]
        h = seeds.copy()
        for j in range(take):
            h = _mixed(h * _A + picked[:, j])
        out[at : at + step] = h
    return out


def most_edits(n: int, similarity: float = SIMILARITY) -> int:
    return int((1 - similarity) * n + 1e-9)


@lru_cache(100)
def _left(n: int) -> list[np.ndarray]:
    """Positions that are left of n words, for each number of words that may be common with a text of up to ``DELETED``."""
    sizes = {m - most_edits(m) for m in range(n, DELETED + 1) if m - most_edits(m) <= n}
    return [np.array(list(combinations(range(n), size))) for size in sorted(sizes)]


def short_keys(words: np.ndarray) -> np.ndarray:
    """Values of which two texts of at most ``SHORT`` words have one in common if they are a link.

    Where the longer one has up to ``DELETED`` words, both are the same text after
    some words are deleted.  Beyond, the longer one falls into one piece more than
    there are edits, so one of three words or more stands in both.
    """
    n, out = len(words), []
    if 0 < n <= DELETED:
        for at in _left(n):
            h = np.full(len(at), at.shape[1], np.uint64)
            for j in range(at.shape[1]):
                h = _mixed(h * _A + words[at[:, j]])
            out.append(_mixed(h ^ _B))
    if DELETED + 1 - most_edits(DELETED + 1) <= n <= SHORT:
        out.append(_mixed(kmers(words, 3) ^ _A))
    return np.unique(np.concatenate([*out, np.empty(0, np.uint64)]))


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> np.ndarray:
    """Edit distances within a band of diagonals: exact up to ``band``, else upper bounds (or 1 << 30)."""
    size, width = len(pairs), 2 * band + 1
    la, lb = (np.array([len(p[s]) for p in pairs]) for s in (0, 1))
    a = np.zeros((size, max(1, la.max())), np.int64)
    b = np.zeros((size, max(1, la.max()) + width), np.int64)
    for i, (x, y) in enumerate(pairs):
        a[i, : len(x)] = x
        own = y[: b.shape[1] - band]
        b[i, band : band + len(own)] = own
    far = np.int32(1 << 30)
    at = np.arange(width, dtype=np.int32)
    row = np.where(at >= band, at - band, far)[None, :].repeat(size, 0).astype(np.int32)
    row[:, :band] = far
    out = np.full(size, far, np.int32)
    last = lb - la + band
    ok = (last >= 0) & (last < width)
    done = np.flatnonzero(ok & (la == 0))
    out[done] = row[done, last[done]]
    shifted = np.full((size, width), far, np.int32)
    ends = {int(n): np.flatnonzero(ok & (la == n)) for n in np.unique(la)}
    for i in range(a.shape[1]):
        shifted[:, :-1] = row[:, 1:]
        row = np.minimum(row + (b[:, i : i + width] != a[:, i : i + 1]), shifted + 1)
        if i < band:  # cells before the other text's start
            row[:, : band - i - 1] = far
            row[:, band - i - 1] = i + 1
        row = np.minimum.accumulate(row - at, 1) + at
        if i + 1 in ends and len(e := ends[i + 1]):
            out[e] = row[e, last[e]]
    return out


def trimmed(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both without the words they begin and end with in common."""
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[:n] != b[:n])
    head = int(unlike[0]) if len(unlike) else n
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    unlike = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(unlike[0]) if len(unlike) else n
    return a[: len(a) - tail], b[: len(b) - tail]


def couples(words: np.ndarray) -> np.ndarray:
    """Hashes of adjacent words."""
    w = words.astype(np.uint32 if words.dtype.itemsize == 4 else np.uint64)
    return w[:-1] * w.dtype.type(0x9E3779B1) + (w[1:] ^ w[1:] >> w.dtype.type(15)) * w.dtype.type(0x85EBCA6B)


def least_distance(a: np.ndarray, b: np.ndarray) -> int:
    """A lower bound of the edit distance: an edit takes two couples of adjacent words from a text at most."""
    (x, n), (y, m) = np.unique(couples(a), return_counts=True), np.unique(couples(b), return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return max(0, -(-(max(len(a), len(b)) - 1 - int(np.minimum(n[i], m[j]).sum())) // 2))


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY) -> np.ndarray:
    """For each pair of word sequences whether its edit similarity is enough."""
    return bounds(pairs, similarity, False)[0]


def bounds(pairs: list[tuple[np.ndarray, np.ndarray]], similarity: float = SIMILARITY, below: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each pair: similar enough, and bounds of its edit distance from below and above."""
    out = np.zeros(len(pairs), bool)
    low = np.zeros(len(pairs), np.int64)
    high = np.array([max(len(a), len(b)) for a, b in pairs], np.int64)
    most = [int((1 - similarity) * max(len(a), len(b)) + 1e-9) for a, b in pairs]
    left = []
    for i, (a, b) in enumerate(pairs):
        if abs(len(a) - len(b)) <= most[i]:
            a, b = trimmed(a, b)
            if max(len(a), len(b)) <= most[i]:
                out[i], high[i] = True, max(len(a), len(b))
            else:
                left.append((i, a, b))
    band = 8
    while left:
        left.sort(key=lambda x: len(x[1]))
        again, at = [], 0
        while at < len(left):
            longest, n = len(left[at][1]), 1
            while at + n < len(left) and n < max(1, 60_000 // (2 * band + 1)) and len(left[at + n][1]) <= max(longest + 32, longest * 1.2):
                n += 1
            some = left[at : at + n]
            found = distances([(a, b) for _, a, b in some], band)
            for (i, a, b), d in zip(some, found.tolist(), strict=True):
                if d <= most[i]:
                    out[i], high[i] = True, d
                elif band < most[i] and (band > 8 or least_distance(a, b) <= most[i]):
                    again.append((i, a, b))
            at += n
        left, band = again, min(band * 6, max((most[i] for i, *_ in again), default=band))
    for i in np.flatnonzero(~out) if below else ():
        low[i] = max(most[i] + 1, least_distance(*pairs[i]))
    return out, low, high


def _words(text: str = "text"):
    plain = F.lower(F.btrim(F.coalesce(F.col(text), F.lit("")), F.lit(" \t\n\x0b\f\r")))
    return F.when(plain == "", F.expr("cast(array() as array<string>)")).otherwise(F.split(plain, r"[\x20\x09-\x0D]+"))


def sketches(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, h1, h2 (128 bits of its words), n_words, sketch (and the keys of short texts), words (32 bits of each)."""
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _words().alias("w"))
    # the constant comes first and seeds the hash: after the words it would make h2 follow from h1
    words = words.select("doc_id", F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"), F.transform("w", lambda w: F.xxhash64(w)).alias("words"))

    def run(batches):
        for b in batches:
            column = b.column(3)
            flat, cuts = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum([0, *column.value_lengths().to_pylist()])
            own = [np.r_[sketch(flat[i:j]), short_keys(flat[i:j])] if j > i else np.empty(0, np.uint64) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32)), pa.array(np.concatenate([*own, np.empty(0, np.uint64)]).view(np.int64)))
            short = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array((flat.view(np.int64) >> 32).astype(np.int32)))
            yield pa.record_batch([*b.columns[:3], pa.array(np.diff(cuts), pa.int64()), lists, short], names=["doc_id", "h1", "h2", "n_words", "sketch", "words"])

    return words.mapInArrow(run, "doc_id long, h1 long, h2 long, n_words long, sketch array<long>, words array<int>")


def verified(pairs: DataFrame, words: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b) pairs -> also near: the alignment is good enough.

    The words of b travel to a, whose own come first there, so a task holds one a
    and a few hundred b.  An a of very many pairs is dealt in shares, each with its
    words; a b has at most one pair for each of its keys.
    """
    share = max(64, pairs.count() // 4096)
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / share).cast("int").alias("shares"))
    hot = F.broadcast(shares.filter("shares > 1"))  # 4096 rows at most
    given = pairs.join(words.withColumnRenamed("doc_id", "b").hint("merge"), "b").join(hot, "a", "left")
    given = given.select("a", "b", "words", F.expr("cast(if(shares is null, 0, pmod(xxhash64(b), shares)) as int)").alias("salt"))
    own = shares.join(words.withColumnRenamed("doc_id", "a").hint("merge"), "a").select("a", F.lit(None).cast("long").alias("b"), "words", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("salt"))
    dealt = given.unionByName(own).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        first, held, asked = None, [], True
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                a, b = part.column(0).to_pylist(), part.column(1).to_pylist()
                ends, sides = [], []
                for x, y, w in zip(a, b, _lists(part.column(2)), strict=True):
                    if y is None:  # one of the texts of this a
                        if first != x or asked:
                            first, held, asked = x, [], False
                        held.append(w.copy())
                    else:
                        asked = True
                        ends += [(x, y)] * len(held)
                        sides += [(h, w) for h in held]
                if sides:
                    yield pa.record_batch([*(pa.array(e, pa.int64()) for e in zip(*ends, strict=True)), pa.array(similar(sides, similarity))], names=["a", "b", "near"])

    return dealt.select("a", "b", "words").mapInArrow(run, "a long, b long, near boolean")


def _lists(column) -> list[np.ndarray]:
    """The lists of an Arrow column as arrays."""
    cuts = np.cumsum([0, *column.value_lengths().to_pylist()])
    return np.split(column.flatten().to_numpy(zero_copy_only=False), cuts[1:-1])


def _levels(texts: list[np.ndarray], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Words as bags: one column for each bin and count up to ``LEVELS``, so that a product of rows sums their common counts; and what lies above."""
    bags = np.array([np.bincount(w.view(np.uint32) & np.uint32(bins - 1), minlength=bins).astype(np.int32) for w in texts]).reshape(len(texts), bins)
    return np.concatenate([(bags > k).astype(np.float32) for k in range(LEVELS)], 1), np.maximum(bags - LEVELS, 0).sum(1).astype(np.float32)


def alike(texts: list[np.ndarray], i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Pairs whose couples of adjacent words allow that they are near: an edit takes two couples at most."""
    held: dict[int, np.ndarray] = {}
    for k in np.unique(np.r_[i, j]).tolist():
        c = couples(texts[k]).astype(np.uint64)
        held[k] = labelled(c) if len(c) else c
    out = np.zeros(len(i), bool)
    for k, (a, b) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
        n = max(len(texts[a]), len(texts[b]))
        out[k] = n - 1 - np.intersect1d(held[a], held[b], assume_unique=True).size <= 2 * most_edits(n, similarity)
    return out


def fitting(rows: pa.Table, similarity: float, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) of one block whose texts may be near, likely ones first: by length, label and words as bags."""
    node, n, label, left, foreign = (rows[c].to_numpy(zero_copy_only=False) for c in ("node", "n_words", "label", "left", "foreign"))
    one, two = np.flatnonzero(left), np.flatnonzero(rows["right"].to_numpy(zero_copy_only=False))
    n = n.astype(np.float32)
    across = lambda x: (x[one][:, None], x[two][None, :])
    longest = np.maximum(*across(n))
    most = longest * np.float32(1 - similarity + 1e-5) + np.float32(0.01)  # rounding only lets more pairs through
    (la, lb), (na, nb) = across(label), across(node)
    # of two members of foreign labels the smaller asks
    ok = (la != lb) & (~foreign[two][None, :] | (nb > na)) & (longest - np.minimum(*across(n)) <= most)
    some, others = ok.any(1), ok.any(0)
    one, two, ok, longest, most = one[some], two[others], ok[some][:, others], longest[some][:, others], most[some][:, others]
    if not len(one):
        return one, two[:0]
    bins = min(MOST_BINS, 1 << int(np.ceil(np.log2(2 + n[np.r_[one, two]].max()))))
    (x, more), (y, rest) = (_levels([texts[i] for i in side], bins) for side in (one, two))
    # no more words than these can be common, and each of the others is an edit
    least = longest - x @ y.T - np.minimum(more[:, None], rest[None, :])
    i, j = np.nonzero(ok & (least <= most))
    order = np.argsort((least / longest.clip(1))[i, j], kind="stable")
    return one[i[order]], two[j[order]]


def across(named: DataFrame, words: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Rows of ``_buckets`` -> (a, b) links that join different labels.

    In a bucket those that ask meet those that answer, where their labels differ.  A bucket of up to ``CHUNK`` members and ``CHUNK_WORDS`` words is one block.  In
    larger ones lengths fall into classes, each ``similarity ** -STEPS`` times the one below,
    and one that asks meets those of its class, with those of both neighbours that are
    near enough to its edge to be of fitting length.  Both sides are then cut into chunks by
    hash and each pair of chunks is one block, so no task holds a bucket, and its rows grow
    with foreign members times members that answer, not with the bucket's square.

    Pairs that no cheap bound rules out are aligned, the likely ones first, unless a
    link found before in the block has joined their labels.
    """
    step = float(-np.log(min(max(similarity, 0.01), 0.99)))
    chunk = f"greatest(16, least({CHUNK}, {CHUNK_WORDS} / exp(class * {step * STEPS})))"
    named = shared.written(named, "buckets")
    sizes = named.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    sized = named.join(sizes.select("key", F.expr(f"n <= {CHUNK} and words <= {CHUNK_WORDS}").alias("small")).hint("merge"), "key")
    zero = F.lit(0)
    one = sized.filter("small").select("key", F.lit(-1).alias("class"), zero.alias("i"), zero.alias("j"), F.col("asks").alias("left"), F.col("answers").alias("right"), *MEMBER)
    large = sized.filter("not small").withColumn("at", F.ln(F.greatest("n_words", F.lit(1)).cast("double")) / step)
    cell = lambda x: F.floor(x / STEPS).cast("int")
    left = large.filter("asks").select("key", cell(F.col("at")).alias("class"), F.lit(True).alias("left"), F.lit(False).alias("right"), *MEMBER)
    # a little more than one step to each side: lengths and their logarithms are rounded
    right = large.filter("answers").select("key", F.explode(F.array_distinct(F.array(cell(F.col("at") - 1.01), cell(F.col("at")), cell(F.col("at") + 1.01)))).alias("class"), F.lit(False).alias("left"), F.lit(True).alias("right"), *MEMBER)
    counts = left.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n")).select("key", "class", F.expr(f"cast(ceil(n / {chunk}) as int)").alias("lefts"))
    rights = right.join(counts.select("key", "class").hint("merge"), ["key", "class"], "left_semi")
    sides = rights.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n")).select("key", "class", F.expr(f"cast(ceil(n / {chunk}) as int)").alias("rights"))
    dealt = left.unionByName(rights).join(counts.join(sides.hint("merge"), ["key", "class"]).hint("merge"), ["key", "class"])
    dealt = dealt.withColumn("chunk", F.expr("cast(pmod(xxhash64(node), if(left, lefts, rights)) as int)"))
    dealt = dealt.select("*", F.explode(F.sequence(zero, F.when(F.col("left"), F.col("rights")).otherwise(F.col("lefts")) - 1)).alias("other"))
    dealt = dealt.select("key", "class", F.when(F.col("left"), F.col("chunk")).otherwise(F.col("other")).alias("i"), F.when(F.col("left"), F.col("other")).otherwise(F.col("chunk")).alias("j"), "left", "right", *MEMBER)
    every = one.unionByName(dealt).join(words.withColumnRenamed("doc_id", "node").hint("merge"), "node")

    def block(table: pa.Table) -> pa.Table:
        texts = _lists(table["words"].combine_chunks())
        one, two = fitting(table, similarity, texts)
        node, label = table["node"].to_numpy(), table["label"].to_numpy()
        names, at = np.unique(label, return_inverse=True)
        root = np.arange(len(names))
        found, turn = [], 1
        while len(one):  # each turn aligns the next few pairs of every left text whose labels are still apart
            order = np.argsort(one, kind="stable")
            begins = np.flatnonzero(np.r_[True, np.diff(one[order]) != 0])
            nth = np.empty(len(one), np.int64)
            nth[order] = np.arange(len(one)) - np.repeat(begins, np.diff(np.r_[begins, len(one)]))
            now = nth < turn
            i, j = one[now], two[now]
            may = alike(texts, i, j, similarity)
            i, j = i[may], j[may]
            near = similar([(texts[x], texts[y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)], similarity)
            for x, y in zip(i[near].tolist(), j[near].tolist(), strict=True):
                if root[at[x]] != root[at[y]]:
                    found.append((int(node[x]), int(node[y])))
                    root[root == max(root[at[x]], root[at[y]])] = min(root[at[x]], root[at[y]])
            apart = ~now & (root[at[one]] != root[at[two]])
            one, two, turn = one[apart], two[apart], turn * 4
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})

    return every.groupBy("key", "class", "i", "j").applyInArrow(block, "a long, b long")


def shared_keys(texts: DataFrame) -> DataFrame:
    """(node, n_words, sketch) -> members of keys that two texts or more share: key, node, n_words, least (the smallest node of the key, or of a share of it), often.

    Keys are dealt once and looked at in order.  Those that stand ``OFTEN`` times in a sample
    of about ``SAMPLED`` texts would make a long task; they are dealt in shares by node.
    """
    each = lambda some: some.select("node", "n_words", F.explode("sketch").alias("key"))
    step = max(1, texts.count() // SAMPLED)
    hot = each(texts.filter(F.pmod(F.xxhash64("node"), F.lit(step)) == 0)).groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") >= OFTEN).select("key", F.lit(True).alias("often"))
    hot = F.broadcast(shared.written(hot, "hot-keys"))  # SAMPLED * keys of a text / OFTEN rows at most
    dealt = each(texts).join(hot, "key", "left").withColumn("often", F.coalesce("often", F.lit(False)))
    share = F.when(F.col("often"), F.pmod(F.xxhash64("node"), F.lit(SHARES))).otherwise(0)
    by_key = Window.partitionBy("key", "share")
    rows = dealt.withColumn("share", share.cast("int")).select("key", "node", "n_words", "often", F.count(F.lit(1)).over(by_key).alias("members"), F.min("node").over(by_key).alias("least"))
    return rows.filter("members > 1 or often").drop("members")


def stars_of(members: DataFrame) -> DataFrame:
    """(a, b): each member with the smallest node of its key, by way of its share's where the key has shares."""
    own = members.select(F.col("least").alias("a"), F.col("node").alias("b"))
    shares = members.filter("often").select("key", "least").distinct()  # SHARES rows a key
    tops = shares.select(F.min("least").over(Window.partitionBy("key")).alias("a"), F.col("least").alias("b"))
    return own.unionByName(tops).filter("a != b").distinct()


def _named(rows: DataFrame, labels: DataFrame) -> DataFrame:
    return rows.join(labels.hint("merge"), "node", "left").withColumn("label", F.coalesce("label", "node"))


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members whose label isn't the commonest of their bucket: key, node, n_words, label, main (the commonest), mains (how many have it), lead (the smallest of these).

    Of buckets with the same members one is enough.
    """
    named = _named(members.select("key", "node", "n_words"), labels)
    by_label = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("lead"), F.bit_xor(F.xxhash64("node")).alias("s"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("t"))
    most = F.max(F.struct("n", F.bitwise_not("label").alias("rest"), "lead")).alias("most")
    mixed = by_label.groupBy("key").agg(F.count(F.lit(1)).alias("labels"), F.sum("n").alias("n"), F.bit_xor("s").alias("s"), F.bit_xor("t").alias("t"), most).filter("labels > 1")
    mixed = mixed.groupBy("n", "s", "t", "most").agg(F.min("key").alias("key")).select("key", F.bitwise_not("most.rest").alias("main"), F.col("most.n").alias("mains"), F.col("most.lead").alias("lead"))
    return named.join(mixed.hint("merge"), "key").filter("label != main").select("key", "node", "n_words", "label", "main", "mains", "lead")


def _buckets(foreign: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that ``across`` compares: key, node, n_words, label, foreign, asks, answers.

    Foreign members of one bucket with different labels meet there.  With the members of the
    commonest label they meet once for that label, whatever number of buckets they share,
    unless its texts are so many that fewer pairs come from the single buckets.  Either way
    every pair of a bucket meets.
    """
    flags = lambda f, a: (F.lit(f).alias("foreign"), F.lit(f).alias("asks"), F.lit(a).alias("answers"))
    several = foreign.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    own = foreign.join(several.hint("merge"), "key", "left_semi").select("key", "node", "n_words", "label", *flags(True, True))
    texts = shared.written(_named(members.select("node", "n_words").distinct(), labels), "named")
    asking = shared.written(foreign.select("main", "node", "n_words", "label").distinct(), "asking")
    singly = foreign.groupBy("key", "main").agg((F.count(F.lit(1)) * F.max("mains")).alias("pairs")).groupBy("main").agg(F.sum("pairs").alias("singly"))
    sizes = asking.groupBy("main").agg(F.count(F.lit(1)).alias("n")).join(singly.hint("merge"), "main")
    sizes = sizes.join(texts.groupBy(F.col("label").alias("main")).agg(F.count(F.lit(1)).alias("size")).hint("merge"), "main")
    ways = shared.written(sizes.select("main", (F.col("n") * F.col("size") <= PER_LABEL * F.col("singly")).alias("whole")), "ways")
    whole = ways.filter("whole").select("main")
    key = F.xxhash64(F.lit("label"), F.col("main")).alias("key")
    ask = asking.join(whole.hint("merge"), "main", "left_semi").select(key, "node", "n_words", "label", *flags(True, False))
    answer = texts.withColumnRenamed("label", "main").join(whole.hint("merge"), "main", "left_semi").select(key, "node", "n_words", F.col("main").alias("label"), *flags(False, True))
    left = foreign.join(whole.hint("merge"), "main", "left_anti")
    keys = left.select("key", F.col("main").alias("label")).distinct()
    salted = lambda df: df.withColumn("key", F.xxhash64(F.lit("bucket"), F.col("key")))
    single = left.select("key", "node", "n_words", "label", *flags(True, False))
    if not keys.isEmpty():
        single = single.unionByName(_named(members.select("key", "node", "n_words"), labels).join(keys.hint("merge"), ["key", "label"], "left_semi").select("key", "node", "n_words", "label", *flags(False, True)))
    return own.unionByName(ask).unionByName(answer).unionByName(salted(single))


def links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, h1, h2, node) and (labels: node, label) of near-duplicate texts."""
    rows = shared.written(sketches(docs), "sketches")
    texts = shared.written(rows.filter("doc_id is not null").groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "n_words", "sketch")).alias("t")).select("h1", "h2", F.col("t.doc_id").alias("node"), "t.n_words", "t.sketch"), "texts")
    members = shared.written(shared_keys(texts), "members")
    stars = shared.written(stars_of(members), "pairs")
    more = members.select(F.col("node").alias("doc_id")).distinct()  # every node that a second round may ask for
    words = shared.written(rows.select("doc_id", "words").join(more.hint("merge"), "doc_id", "left_semi"), "words")
    tested = shared.written(verified(stars, words, similarity), "links")
    edges = tested.filter("near").select("a", "b").distinct()
    labels = components(edges)
    # What is left: members of one bucket with different labels.  First each is compared with one of the
    # bucket's commonest label, which joins most of what belongs together; then with all that is apart.
    few = _apart(members, labels).select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    few = shared.written(few.join(stars.hint("merge"), ["a", "b"], "left_anti"), "pairs")
    for found in (lambda: verified(few, words, similarity).filter("near").select("a", "b"), lambda: across(_buckets(shared.written(_apart(members, labels), "mixed"), members, labels), words, similarity)):
        new = shared.written(found(), "links").distinct()
        if not new.isEmpty():
            labels = extended(labels, new)
    return rows.join(texts.select("h1", "h2", "node").hint("merge"), ["h1", "h2"], "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), labels


def near_classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Per document: doc_id, class_id (the smallest doc_id of its class) and kept."""
    rows, labels = links(docs, similarity)
    out = rows.join(labels, "node", "left").select("doc_id", F.coalesce("label", "node").alias("class_id"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """documents, one of each class: the one with the smallest doc_id."""
    drop = near_classes(docs, similarity).filter("not kept").select(F.col("doc_id").alias("_dropped")).distinct()
    return docs.join(shared.written(drop, "dropped").hint("merge"), F.col("doc_id").cast("long") == F.col("_dropped"), "left_anti")
