"""Exact dedup over a log-structured merge index.

Each map task keeps a *memtable* of digests; a full memtable is flushed as a
sorted run of (digest, smallest id, count), so a digest that a third of all
rows share leaves a task as one row per flush.  Runs are dealt by digest; each
shard spools what it gets as sorted runs with Bloom filters and compacts them,
range by range, keeping the smallest identifier.  Every hit is then verified
byte by byte against the row that stays.

Defined results: null text counts as empty; text is compared after each run of
ASCII white space became one space (no trimming); null ids sort last, a group
of null ids has a null keep_id; rows repeated with one id are all reported,
each with kept = (doc_id is keep_id); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

SPACES = r"[\x20\x09-\x0D]+"
NO_ID = (1 << 63) - 1
ENTRY = "digest binary, id long, n long"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


class Bloom:
    """Filter over 256-bit digests; their own words serve as hash values."""

    def __init__(self, n: int, bits_per_key: int = 10):
        self.bits = np.zeros(max(64, 1 << int(np.ceil(np.log2(max(1, n) * bits_per_key)))), bool)

    def _at(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        raw = np.ascontiguousarray(keys).view(np.uint8).reshape(len(keys), keys.dtype.itemsize)
        words = np.ascontiguousarray(np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8)))).view(np.uint64)
        for k in range(words.shape[1]):
            yield words[:, k] & np.uint64(len(self.bits) - 1)

    def add(self, keys: np.ndarray) -> None:
        for at in self._at(keys):
            self.bits[at] = True

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for at in self._at(keys):
            out &= self.bits[at]
        return out


def merged(keys: np.ndarray, ids: np.ndarray, counts: np.ndarray):
    """Sorted by key, one entry each: the smallest id and the summed count."""
    if not len(keys):
        return keys, ids, counts
    order = np.lexsort((ids, keys))
    keys, ids, counts = keys[order], ids[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], ids[first], np.add.reduceat(counts, first)


class LsmShard:
    """One shard of the index; memory is bounded by the memtable and one key range of each run."""

    def __init__(self, memtable_rows: int = 1 << 16, width: int = 32):
        self.rows, self.key = memtable_rows, np.dtype(f"S{width}")
        self.buffer: list[tuple] = []
        self.held = 0
        self.runs: list[tuple] = []
        self.folder: str | None = None

    def put(self, keys, ids, counts) -> Iterator[tuple]:
        """Take entries; yields each run that a full memtable flushes."""
        self.buffer.append(merged(keys, ids, counts))
        self.held += len(self.buffer[-1][0])
        if self.held >= self.rows:
            self.buffer = [merged(*map(np.concatenate, zip(*self.buffer, strict=True)))]
            self.held = len(self.buffer[0][0])
            if self.held >= self.rows // 2:
                yield from self.drain()

    def drain(self) -> Iterator[tuple]:
        if self.buffer:
            run = merged(*map(np.concatenate, zip(*self.buffer, strict=True)))
            self.buffer, self.held = [], 0
            if len(run[0]):
                yield run

    def spool(self, run: tuple) -> None:
        """Keep a run in this task's scratch, memory-mapped, with its filter."""
        self.folder = self.folder or tempfile.mkdtemp(prefix="lsm-")
        kept = []
        for name, a in zip("kic", run, strict=True):
            path = f"{self.folder}/{len(self.runs)}{name}"
            a.tofile(path)
            kept.append(np.memmap(path, dtype=a.dtype, mode="r"))
        bloom = Bloom(len(run[0]))
        bloom.add(run[0])
        self.runs.append((*kept, bloom))

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Smallest id held for each key, NO_ID if none; runs whose filter says no aren't touched."""
        out = np.full(len(keys), NO_ID)
        for k, i, _, bloom in self.runs:
            if len(hit := np.flatnonzero(bloom.may_hold(keys))):
                at = np.minimum(np.searchsorted(k, keys[hit]), len(k) - 1)
                same = k[at] == keys[hit]
                out[hit[same]] = np.minimum(out[hit[same]], i[at[same]])
        return out

    def compact(self, ranges: int = 64) -> Iterator[tuple]:
        """All entries in key order, one range of first bytes after the other."""
        edges = [np.array([bytes([256 * r // ranges])], self.key) for r in range(1, ranges)]
        cuts = [[0, *(int(np.searchsorted(k, e[0])) for e in edges), len(k)] for k, *_ in self.runs]
        for r in range(ranges):
            alone, shared_ = [], []
            for x, (k, i, c, _) in enumerate(self.runs):
                part = tuple(np.asarray(a[cuts[x][r] : cuts[x][r + 1]]) for a in (k, i, c))
                if not len(part[0]):
                    continue
                other = np.zeros(len(part[0]), bool)
                for y, run in enumerate(self.runs):
                    if y != x:
                        other |= run[3].may_hold(part[0])
                alone.append(tuple(a[~other] for a in part))
                shared_.append(tuple(a[other] for a in part))
            if alone:
                yield from (x for x in alone if len(x[0]))
                yield merged(*map(np.concatenate, zip(*shared_, strict=True)))

    def close(self) -> None:
        self.runs = []
        if self.folder:
            shutil.rmtree(self.folder, ignore_errors=True)


def _arrays(batch: pa.RecordBatch, width: int) -> tuple:
    raw = b"".join(batch.column(0).to_pylist())
    keys = np.frombuffer(raw, f"S{width}") if raw else np.empty(0, f"S{width}")
    return keys, *(batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (1, 2))


def _batch(run: tuple, width: int) -> pa.RecordBatch:
    keys = pa.Array.from_buffers(pa.binary(width), len(run[0]), [None, pa.py_buffer(np.ascontiguousarray(run[0]).tobytes())])
    return pa.record_batch([keys.cast(pa.binary()), pa.array(run[1]), pa.array(run[2])], names=["digest", "id", "n"])


def lsm_index(entries: DataFrame, width: int = 32, memtable_rows: int = 1 << 16) -> DataFrame:
    """(digest, id, n) entries -> one row per digest: smallest id, summed n."""

    def memtable(batches):
        shard = LsmShard(memtable_rows, width)
        for b in batches:
            for run in shard.put(*_arrays(b, width)):
                yield _batch(run, width)
        for run in shard.drain():
            yield _batch(run, width)

    def compacted(batches):
        shard = LsmShard(memtable_rows, width)
        try:
            for b in batches:
                for run in shard.put(*_arrays(b, width)):
                    shard.spool(run)
            for run in shard.drain():
                shard.spool(run)
            for run in shard.compact():
                if len(run[0]):
                    yield _batch(run, width)
        finally:
            shard.close()

    return entries.mapInArrow(memtable, ENTRY).repartition("digest").mapInArrow(compacted, ENTRY)


def _sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _sized(docs: DataFrame, text: str, doc_id: str, digest, carried: list[Column]) -> DataFrame:
    own = F.col(doc_id).cast("long")
    return docs.select(own.alias("doc_id"), F.coalesce(own, F.lit(NO_ID)).alias("id"), normalised(F.col(text)).alias("norm"), *carried).withColumn("digest", digest(F.col("norm")))


def _answered(docs: DataFrame, text: str, doc_id: str, digest, width: int, whole: bool = False) -> DataFrame:
    """Each row beside the index's answer for its digest (keep, n), dealt by digest and salt.

    Hot digests are dealt in shares; each share gets the text that stays, in a row
    with own = 0.  ``whole`` carries the row itself and takes its text from
    there after the shuffle, so a text travels once.
    """
    sized = _sized(docs, text, doc_id, digest, [F.struct(*docs.columns).alias("row")] if whole else [])
    index = shared.written(lsm_index(sized.select("digest", "id", F.lit(1).cast("long").alias("n")), width), "lsm")
    total = index.agg(F.sum("n")).first()[0] or 0
    most = max(64, total // 4096)  # so at most 4096 digests are hot, which bounds what is broadcast
    hot = index.filter(F.col("n") > most).select("digest", F.col("id").alias("hot_id"), F.ceil(F.col("n") / most).cast("int").alias("salts"))
    salted = sized.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.when(F.col("salts").isNull(), 0).otherwise(F.expr("cast(pmod(xxhash64(id), salts) as int)")))
    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("hot_id", F.coalesce("doc_id", F.lit(NO_ID)))
    keepers = (
        _sized(plain.join(F.broadcast(hot.select("hot_id").distinct()), "hot_id", "left_semi"), "text", "doc_id", digest, [])
        .join(F.broadcast(hot), "digest")
        .filter("id = hot_id")
        .groupBy("digest", "id", "salts")
        .agg(F.min("norm").alias("norm"))
        .select("digest", "id", F.lit(None).cast("long").alias("doc_id"), "norm", F.explode(F.expr("sequence(0, salts - 1)")).alias("salt"), F.lit(0).alias("own"))
    )
    carried = [F.lit(None).cast("string").alias("norm"), "row"] if whole else ["norm"]
    every = salted.select("digest", "id", "doc_id", "salt", F.lit(1).alias("own"), *carried).unionByName(keepers, allowMissingColumns=True)
    entries = index.join(F.broadcast(hot), "digest", "left").select("digest", F.col("id").alias("keep"), "n", F.explode(F.when(F.col("salts").isNull(), F.array(F.lit(0))).otherwise(F.expr("sequence(0, coalesce(salts, 1) - 1)"))).alias("salt"))
    out = every.join(entries.hint("merge"), ["digest", "salt"])
    return out.withColumn("norm", F.coalesce("norm", normalised(F.col("row").getField(text)))) if whole else out


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", digest=_sha256, width: int = 32) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` maps a normalised text column to ``width`` bytes (SHA-256); a
    weaker one gives the same result, as all hits are verified.
    """
    stays = F.first("norm").over(Window.partitionBy("digest", "salt").orderBy("own", "id", "norm"))
    out = _answered(docs, text, doc_id, digest, width).withColumn("same", F.col("norm") == stays).filter("own = 1")
    shown = out.select("doc_id", F.when(F.col("keep") != NO_ID, F.col("keep")).alias("keep_id"), F.col("n").alias("group_size"), "same", "digest", *([] if width == 32 else [F.sha2("norm", 256).alias("sha")]))
    shown = shared.written(shown, "dedup")
    clash = shown.filter("not same").select("digest").distinct()
    if not clash.isEmpty():  # digests that different texts share: those groups are taken apart by their bytes
        by_text = Window.partitionBy("norm")
        apart = _sized(docs, text, doc_id, digest, []).join(clash, "digest", "left_semi").select("doc_id", F.min("doc_id").over(by_text).alias("keep_id"), F.count(F.lit(1)).over(by_text).alias("group_size"), F.lit(True).alias("same"), "digest", *([] if width == 32 else [F.sha2("norm", 256).alias("sha")]))
        shown = shown.join(clash, "digest", "left_anti").select(shown.columns).unionByName(apart)
    sha = F.lower(F.hex("digest")) if width == 32 else F.col("sha")
    return shown.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), sha.alias("text_sha256"))


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """documents, of equal texts the row of smallest doc_id.

    Rows come whole through the one shuffle that verifies hits, so nothing is joined back.
    Equal texts stand side by side there: a row goes if the bytes before it are
    its own and the index doesn't name it.  Of repeated rows with one id and
    text one stays, likewise of equal texts without id.  If a digest ever had two
    texts, each stays (the second of a hot digest once a share).
    """
    order = Window.partitionBy("digest", "salt").orderBy("norm", "own", "id", F.col("row").getField(text))
    before, given = F.lag("norm").over(order), F.lag("own").over(order) == 0
    named = F.col("id") == F.col("keep")
    stays = F.when(before == F.col("norm"), named & given).otherwise(True)
    return _answered(docs, text, doc_id, _sha256, 32, whole=True).withColumn("stays", stays).filter("own = 1 and stays").select("row.*")
