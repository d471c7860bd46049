"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all test items.

Words are runs of ASCII letters and digits and of anything beyond ASCII, in lower case
(A-Z only).  A window is ten consecutive words of an item; an item of fewer words is one
window.  Normalising replaces bytes by bytes, so a place in the normalised UTF-8 text is
the same place in the original: words are joined by single spaces and scanned once, and an
occurrence's words lead back to code points of the original.

The automaton is built from a broadcast whose size is counted first.  A benchmark of more
than ``block_bytes`` of windows is scanned in blocks of that size, one pass each, which
hand on what they found; texts are written between passes, so memory stays bounded.

Defined results: null and empty texts have no words and no hits; equal item ids are one
item; windows of items without id hit, but such items are not listed; windows that several
items have list all of them; repeated documents are judged each; texts of any length are
scanned whole; an empty benchmark hits nothing; an empty table gives no rows; other columns
are kept or ignored as asked, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

WINDOW = 10
#: Bytes of windows in one automaton (a node takes some 40 bytes, and a window shares few).
BLOCK_BYTES = 1 << 22
#: Normalised bytes: lower case, and a space for what no word has.
NORMAL = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RUN = pa.struct([("first", pa.int64()), ("end", pa.int64())])
_FOUND = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("words", pa.list_(_RUN)), ("spans", pa.list_(_RUN)), ("items", pa.list_(pa.int64()))]
_RUNS = "array<struct<first: bigint, end: bigint>>"
FOUND = f"struct<n_words: bigint, n_hit: bigint, words: {_RUNS}, spans: {_RUNS}, items: array<bigint>>"
_automata: dict[str, tuple] = {}


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, text) -> distinct (item_id, size, pattern): the normalised words of each window, between spaces."""

    def cut(batches):
        for b in batches:
            ids, sizes, patterns = [], [], []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or b"").translate(NORMAL).split()
                for k in range(max(1, len(words) - size + 1) if words else 0):
                    some = words[k : k + size]
                    ids.append(i)
                    sizes.append(len(some))
                    patterns.append(b" %b " % b" ".join(some))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(patterns, pa.binary())], names=["item_id", "size", "pattern"])

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(cut, "item_id long, size int, pattern binary").distinct()


def _automaton(key: str, rows: list[tuple]):
    """(automaton over pattern numbers, sizes, item ids of each pattern); a worker keeps the last one."""
    if key not in _automata:
        import ahocorasick

        made, numbers, sizes, items = ahocorasick.Automaton(ahocorasick.STORE_INTS), {}, [], []
        for item, size, pattern in rows:
            if (k := numbers.setdefault(pattern, len(numbers))) == len(sizes):
                made.add_word(bytes(pattern).decode("latin-1"), k)
                sizes.append(size)
                items.append(set())
            if item is not None:
                items[k].add(item)
        if sizes:
            made.make_automaton()
        _automata.clear()
        _automata[key] = made, np.array(sizes, np.int64), items
    return _automata[key]


def occurrences(words: list[bytes], automaton, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, word after the last, pattern) of every occurrence, from one scan."""
    joined = b" %b " % b" ".join(words)
    found = np.array(list(automaton.iter(joined.decode("latin-1"))) if words and len(sizes) else [], np.int64).reshape(-1, 2)
    end = np.searchsorted(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), found[:, 0]) if len(found) else found[:, 0]
    return end - sizes[found[:, 1]] if len(found) else end, end, found[:, 1]


def merged(first: np.ndarray, end: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of words inside any of the intervals."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, first, 1)
    np.add.at(step, end, -1)
    edge = np.diff(np.concatenate([[0], (np.cumsum(step) > 0).astype(np.int8)]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def places(raw: bytes, normal: bytes, first: np.ndarray, end: np.ndarray) -> list[dict]:
    """Runs of words as code points of the original text, end exclusive."""
    inside = np.diff(np.concatenate([[0], (np.frombuffer(normal, np.uint8) != 32).astype(np.int8), [0]]))
    starts, stops = np.flatnonzero(inside == 1), np.flatnonzero(inside == -1)
    points = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
    return [{"first": a, "end": b} for a, b in zip(points[starts[first]].tolist(), points[stops[end - 1]].tolist(), strict=True)]


def _scan(batches: Iterator[pa.RecordBatch], key: str, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """(text, row, before: what earlier passes found or null) -> (text, row, found)."""
    automaton, sizes, items = _automaton(key, rows)
    for b in batches:
        out = []
        for raw, before in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            normal = (raw or b"").translate(NORMAL)
            words = normal.split()
            first, end, patterns = occurrences(words, automaton, sizes)
            before = before or {"words": [], "items": []}
            if len(first) or before["words"]:
                old = np.array([(w["first"], w["end"]) for w in before["words"]], np.int64).reshape(-1, 2)
                first, end = merged(np.concatenate([first, old[:, 0]]), np.concatenate([end, old[:, 1]]), len(words))
            listed = set(before["items"]).union(*(items[k] for k in np.unique(patterns)))
            out.append({"n_words": len(words), "n_hit": int((end - first).sum()), "words": [{"first": x, "end": y} for x, y in zip(first.tolist(), end.tolist(), strict=True)], "spans": places(raw, normal, first, end) if len(first) else [], "items": sorted(listed)})
        yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.struct(_FOUND))], names=["text", "row", "found"])


def scanned(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """row (struct of the kept columns, doc_id if none are named), n_words, n_hit, spans (maximal runs of hit words, in code points of the text, end exclusive), items (ids of items with occurring windows)."""
    sc = docs.sparkSession.sparkContext
    cut = shared.written(windows(benchmark, size), "windows")
    blocks = max(1, -(-(cut.agg(F.sum(F.length("pattern"))).first()[0] or 0) // block_bytes))
    cut = cut.withColumn("block", F.pmod(F.xxhash64("pattern", "item_id"), F.lit(blocks)))
    rows = docs.select(F.col("text").cast("binary").alias("text"), F.struct(*(F.col(f"`{c}`") for c in keep or ["doc_id"])).alias("row"), F.lit(None).cast(FOUND).alias("found"))
    schema = rows.schema
    for k in range(blocks):
        # a block's windows are bounded by block_bytes, as counted above
        side = sc.broadcast([(r["item_id"], r["size"], bytes(r["pattern"])) for r in cut.filter(F.col("block") == k).collect()])
        rows = rows.mapInArrow(lambda batches, side=side, key=uuid.uuid4().hex: _scan(batches, key, side.value), schema)
        if k < blocks - 1:
            rows = shared.written(rows, "scanned")
    return rows.select("row", "found.n_words", "found.n_hit", "found.spans", "found.items")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents without any hit, all columns as they are."""
    return scanned(docs, benchmark, docs.columns, **how).filter("n_hit = 0").select("row.*")


def listed(items: Column) -> Column:
    """sha256 of the ids, sorted as strings, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ","), 256)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = scanned(docs, benchmark)
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed(F.col("items")).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
