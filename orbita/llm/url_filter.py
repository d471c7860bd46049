"""URL filter: rules in sorted arrays of 64-bit digests.

A rule is a host with a path prefix and a verdict; it holds for the host and
all subdomains.  Rules are written as sorted shards: xxhash64 keys, and the full
strings with offsets.  A lookup memory-maps them, forms for each url the keys of
every host suffix with every path prefix whose length some rule has, probes with
vectorised binary search and confirms each hit against the stored string; equal
keys of different strings lie side by side and are all looked at.  The longest
rule that fits decides; of equally long ones that with the longer host.  A url
that no rule fits is allowed.

Defined results: a null url, or one without ``://``, has empty host and path and
is allowed; a rule given twice counts once, and blocks if any says so; an empty
rule set allows everything; repeated pages are judged each, equal urls alike; urls of any
length are judged whole; empty tables give no rows; other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHARD = "name string, n long, low long, high long, lengths array<int>"
_SIGN = np.uint64(1 << 63)


def parts(url: str | None) -> tuple[str, str]:
    """(host, path) of a url."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    ends = [i for c in "?#" if (i := rest.find(c)) >= 0]
    rest = rest[: min(ends, default=len(rest))]
    host, slash, path = rest.partition("/")
    return host.translate(LOWER), slash + path


def keys_of(strings: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(s) for s in strings], np.uint64)


def build(rules: DataFrame, folder: str) -> list[tuple]:
    """(rule, verdict) rows -> sorted shards in the folder; returns what each holds.

    Rules are dealt by key range, so neither driver nor a task holds them all.
    """
    spark = rules.sparkSession

    def hashed(batches):
        for b in batches:
            texts = b.column(0).to_pylist()
            yield pa.record_batch([pa.array((keys_of(texts) ^ _SIGN).view(np.int64)), b.column(0), b.column(1)], names=["key", "rule", "blocks"])

    def shard(batches):
        rows = [(k, r, v) for b in batches for k, r, v in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        if rows:
            name = f"{folder}/rules-{uuid.uuid4().hex}"
            texts = [r.encode() for _, r, _ in rows]
            shared.put(f"{name}.key", np.array([k for k, *_ in rows], "<i8"))
            shared.put(f"{name}.off", np.cumsum([0, *map(len, texts)]).astype("<i8"))
            shared.put(f"{name}.txt", np.frombuffer(b"".join(texts), np.uint8))
            shared.put(f"{name}.ver", np.array([v for *_, v in rows], np.uint8))
            lengths = sorted({len(r) - r.index("/") for _, r, _ in rows})
            yield pa.record_batch([pa.array([name]), pa.array([len(rows)], pa.int64()), pa.array([rows[0][0]], pa.int64()), pa.array([rows[-1][0]], pa.int64()), pa.array([lengths], pa.list_(pa.int32()))], names=["name", "n", "low", "high", "lengths"])

    clean = rules.filter("rule like '%/%'").groupBy("rule").agg(F.max((F.col("verdict") == "block").cast("int")).alias("blocks"))
    by_key = clean.mapInArrow(hashed, "key long, rule string, blocks int").repartitionByRange("key").sortWithinPartitions("key")
    return [tuple(r) for r in shared.written(by_key.mapInArrow(shard, SHARD), "rules").collect()]  # one row a shard


class Lookup:
    """The shards, memory-mapped."""

    def __init__(self, shards: Iterable[tuple]):
        types = ((".key", "<i8"), (".off", "<i8"), (".txt", np.uint8), (".ver", np.uint8))
        self.shards = [(low, high, *(shared.mapped(f"{name}{x}", t) for x, t in types)) for name, _, low, high, _ in shards]
        self.lengths = sorted({x for *_, lengths in shards for x in lengths})

    def verdicts(self, strings: list[str]) -> np.ndarray:
        """For each string 1 (block), 0 (allow) or -1 (no such rule)."""
        keys = (keys_of(strings) ^ _SIGN).view(np.int64)
        out = np.full(len(strings), -1)
        for low, high, held, offsets, texts, verdict in self.shards:
            some = np.flatnonzero((keys >= low) & (keys <= high))
            left, right = (np.searchsorted(held, keys[some], s) for s in ("left", "right"))
            for i, a, b in zip(some[left < right], left[left < right], right[left < right], strict=True):
                own = strings[i].encode()
                for j in range(a, b):
                    if texts[offsets[j] : offsets[j + 1]].tobytes() == own:
                        out[i] = verdict[j]
        return out

    def judge(self, urls: list[str | None]) -> tuple[list, list, list, list]:
        """host, path, rule and verdict of each url."""
        split = [parts(u) for u in urls]
        asked: dict[str, int] = {}
        wanted = []
        for host, path in split:
            labels = host.split(".")
            suffixes = [".".join(labels[i:]) for i in range(len(labels))]
            own = [s + path[:n] for s in suffixes for n in self.lengths if n <= len(path)]
            for x in own:
                asked.setdefault(x, len(asked))
            wanted.append(sorted(own, key=lambda x: (-len(x), -x.index("/"))))
        found = self.verdicts(list(asked)) if asked else np.empty(0, int)
        rules = [next((x for x in own if found[asked[x]] >= 0), None) for own in wanted]
        said = ["allow" if r is None or not found[asked[r]] else "block" for r in rules]
        return [h for h, _ in split], [p for _, p in split], rules, said


def judge(pages: DataFrame, shards: list[tuple], url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict."""
    cached: list[Lookup] = []

    def run(batches):
        if not cached:
            cached.append(Lookup(shards))
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                some = b.slice(at, 4096)
                cols = cached[0].judge(some.column(1).to_pylist())
                yield pa.record_batch([some.column(0), *(pa.array(c, pa.string()) for c in cols)], names=["page_id", "host", "path", "rule", "verdict"])

    return pages.selectExpr("cast(page_id as long) as page_id", f"`{url}` as url").mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")


def filtered(pages: DataFrame, rules: Iterable[tuple[str, str]] = RULES) -> DataFrame:
    spark: SparkSession = pages.sparkSession
    return judge(pages, build(spark.createDataFrame(list(rules), "rule string, verdict string"), shared.fresh(spark, "url-rules")))
