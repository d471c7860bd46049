"""The key cache: a first batch is indexed, later ones queue and are flushed by count.

All state is in a folder: batches, leaf blocks and nodes as tables that are written once,
and a log whose newest version names those that count.  A cache opened on the folder goes
on where the last one stopped, whichever driver it was.  Batch numbers grow, as those of a
stream do, and a version holds the last one, so a batch that is delivered again is taken
once.  A flush writes what it adds; segments of like size are written together when four
have come about, so a key is written again only as often as the cache has quadrupled.  A
search sees the index and the queue.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, replace
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..config import Config
from ..operators import index, search, update
from ..plans import tables
from .store import Log

#: Segments of one size class that are kept apart.
ALIKE = 4
NODES = "level int, kv_head int, node_id long, center array<double>, radius double, parent_id long"
EMPTY: dict[str, Any] = {"batch": None, "schema": None, "depth": 1, "segments": [], "nodes": [], "queue": [], "indexed_len": 0, "queued_len": 0, "n_blocks": 0}


@dataclass
class Layer:
    """One layer's cache."""

    config: Config
    arrow: bool = False
    folder: str | None = None
    _state: dict[str, Any] | None = None
    _log: Log | None = None
    _index: tuple[int, index.Index] | None = None

    def _opened(self) -> Log:
        if self._log is None:
            spark = SparkSession.active()
            self.folder = self.folder or f"{tables.folder(spark)}/orbita-tables/cache-{uuid.uuid4().hex}"
            self._log = Log(spark, self.folder)
            self._state = self._log.latest() or {"version": 0, **EMPTY}
        return self._log

    @property
    def state(self) -> dict[str, Any]:
        """What the newest version says."""
        self._opened()
        return self._state

    def _commit(self, **changes: Any) -> None:
        new = {**self.state, **changes, "version": self.state["version"] + 1}
        self._opened().commit(new)
        self._state = new

    def _read(self, name: str, schema: StructType) -> DataFrame:
        return self._opened().spark.read.schema(schema).parquet(f"{self.folder}/{name}")

    def _written(self, df: DataFrame, kind: str) -> str:
        name = f"tables/{kind}-{uuid.uuid4().hex}"
        tables.saved(df, kind, f"{self._at(name)}")
        return name

    def _at(self, name: str) -> str:
        self._opened()
        return f"{self.folder}/{name}"

    def _schema(self) -> StructType:
        return StructType.fromJson(self.state["schema"])

    @property
    def indexed(self) -> index.Index | None:
        """The index as the newest version has it."""
        s = self.state
        if not s["segments"]:
            return None
        if self._index is None or self._index[0] != s["version"]:
            spark = self._opened().spark
            kept = StructType(self._schema().fields).add("parent_id", LongType()).add("block", IntegerType())
            blocks = reduce(DataFrame.unionByName, [self._read(f"{x['name']}/blocks", kept) for x in s["segments"]])
            keys = blocks.drop("parent_id", "block")
            if s["depth"] == 1:
                made = index.Index(keys, None, None, 1, self.config.branching_factor)
            else:
                places = reduce(DataFrame.unionByName, [spark.read.schema("kv_head int, parent_id long, block int").parquet(self._at(f"{x['name']}/places")) for x in s["segments"]])
                nodes = reduce(DataFrame.unionByName, [spark.read.schema(NODES).parquet(self._at(n)) for n in s["nodes"]])
                made = index.Index(keys, blocks.select("kv_head", "key_id", "parent_id"), nodes, s["depth"], self.config.branching_factor, blocks, places, s["n_blocks"])
            self._index = s["version"], made
        return self._index[1]

    @property
    def queue(self) -> DataFrame | None:
        names = self.state["queue"]
        return reduce(DataFrame.unionByName, [self._read(n, self._schema()) for n in names]) if names else None

    @property
    def indexed_len(self) -> int:
        return self.state["indexed_len"]

    @property
    def queued_len(self) -> int:
        return self.state["queued_len"]

    def update(self, keys: DataFrame, batch_id: int | None = None) -> Layer:
        """Take a batch (kv_head, key_id, key, ...); batch numbers grow."""
        s = self.state
        if batch_id is not None and s["batch"] is not None and batch_id <= s["batch"]:
            return self
        batch = {} if batch_id is None else {"batch": batch_id}
        if s["schema"] is None:
            keys = keys.withColumns({"kv_head": F.col("kv_head").cast("int"), "key_id": F.col("key_id").cast("long")})
            schema = StructType.fromJson(keys.schema.jsonValue())
        else:
            schema = self._schema()
            keys = keys.select([F.col(f.name).cast(f.dataType) for f in schema])
        name = self._written(keys, "batch")
        batch |= {"schema": schema.jsonValue()}
        kept = self._read(name, schema)
        length = _length(kept)
        if not s["segments"]:
            if length:
                c = self.config
                self._first(index.build(kept, c.num_levels, c.branching_factor, c.max_iterations if c.mode == "exact" else 0, balanced=c.mode == "scan", arrow=self.arrow), batch | {"indexed_len": length})
            return self
        if s["queued_len"] + length < self.config.update_every:
            self._commit(**batch, queue=[*s["queue"], name], queued_len=s["queued_len"] + length)
        else:  # the batch and its flush are one version
            self._flushed([*s["queue"], name], s["queued_len"] + length, batch)
        return self

    def flush(self) -> None:
        """The whole queue goes into the index."""
        if self.state["queue"]:
            self._flushed(self.state["queue"], self.queued_len, {})

    def _segment(self, keys: DataFrame, leaf: DataFrame | None, nodes: DataFrame | None, first: int) -> tuple[dict[str, Any], int]:
        name = f"tables/segment-{uuid.uuid4().hex}"
        if leaf is None:
            tables.saved(keys.select("*", F.lit(None).cast("long").alias("parent_id"), F.lit(first).alias("block")), "blocks", f"{self._at(name)}/blocks", by="block")
            n = first + 1
        else:
            n = index.leaf_blocks(keys, leaf, nodes, first, path=self._at(name))[2]
        rows = self._opened().spark.read.parquet(f"{self._at(name)}/blocks").count()
        return {"name": name, "rows": rows}, n

    def _first(self, made: index.Index, changes: dict[str, Any]) -> None:
        segment, n = self._segment(made.keys, made.leaf, made.nodes, 0)
        nodes = [] if made.nodes is None else [self._written(_nodes(made.nodes), "nodes")]
        self._commit(**changes, depth=made.depth, segments=[segment], nodes=nodes, n_blocks=n)

    def _flushed(self, queue: list[str], length: int, changes: dict[str, Any]) -> None:
        s, old = self.state, self.indexed
        schema = self._schema()
        new_keys = reduce(DataFrame.unionByName, [self._read(n, schema) for n in queue])
        if old.depth == 1:
            segment, n = self._segment(new_keys, None, None, s["n_blocks"])
            nodes = []
        elif self.config.mode == "exact":
            c = self.config
            sub = update.sub_index(old, new_keys, c.max_iterations, arrow=self.arrow)
            segment, n = self._segment(new_keys, sub.leaf, sub.nodes, s["n_blocks"])
            nodes = [*s["nodes"], self._written(_nodes(sub.nodes), "nodes")]
        else:
            filled = update.fill_slots(replace(old, blocks=None, places=None), new_keys, arrow=self.arrow)
            leaf = filled.leaf.join(new_keys.select("kv_head", "key_id"), ["kv_head", "key_id"], "left_semi")
            segment, n = self._segment(new_keys, leaf, filled.nodes, s["n_blocks"])
            nodes = [self._written(_nodes(filled.nodes), "nodes")]  # radii have grown
        segments, n, nodes = self._merged([*s["segments"], segment], n, nodes)
        self._commit(**changes, segments=segments, nodes=nodes, n_blocks=n, queue=[], queued_len=0, indexed_len=s["indexed_len"] + length)

    def _merged(self, segments: list[dict[str, Any]], n: int, nodes: list[str]) -> tuple[list[dict[str, Any]], int, list[str]]:
        """Segments of like size written as one, till no size class has too many; so also the nodes."""
        spark, kept = self._opened().spark, StructType(self._schema().fields).add("parent_id", LongType()).add("block", IntegerType())
        if len(nodes) >= ALIKE * ALIKE:
            nodes = [self._written(reduce(DataFrame.unionByName, [spark.read.schema(NODES).parquet(self._at(x)) for x in nodes]), "nodes")]
        while alike := _alike(segments):
            blocks = reduce(DataFrame.unionByName, [self._read(f"{x['name']}/blocks", kept) for x in alike])
            if nodes:
                up = reduce(DataFrame.unionByName, [spark.read.schema(NODES).parquet(self._at(x)) for x in nodes])
                one, n = self._segment(blocks.drop("parent_id", "block"), blocks.select("kv_head", "key_id", "parent_id"), up, n)
            else:
                one, n = self._segment(blocks.drop("parent_id", "block"), None, None, n)
            segments = [*(x for x in segments if x not in alike), one]
        return segments, n, nodes

    def clean(self) -> list[str]:
        """Delete the tables that the newest version doesn't name; no search that was begun before may still run."""
        s, log = self.state, self._opened()
        used = {*s["queue"], *s["nodes"], *(x["name"] for x in s["segments"])}
        gone = [name for name in log.tables() if name not in used]
        log.drop(gone)
        return gone

    def search(self, q: DataFrame) -> DataFrame:
        if (made := self.indexed) is None:
            raise ValueError("the cache is empty")
        hits = search.tree_search(made, q, self.config.mode)
        return hits if self.queue is None else hits.unionByName(search.flat_scan(self.queue, q))

    @property
    def sequence_length(self) -> int:
        return self.indexed_len + self.queued_len

    def mask_sizes(self, new: int) -> tuple[int, int]:
        return self.sequence_length + new, 0

    @property
    def max_shape(self) -> int:
        return -1

    def reset(self) -> None:
        """Empty, also for drivers to come; batch numbers may start again."""
        self._commit(**EMPTY)


def _alike(segments: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The segments of a size class (powers of ALIKE) that has too many."""
    classes: dict[int, list] = {}
    for x in segments:
        size = 0
        while ALIKE ** (size + 1) <= x["rows"]:
            size += 1
        classes.setdefault(size, []).append(x)
    return next((c for _, c in sorted(classes.items()) if len(c) >= ALIKE), [])


def _nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("level").cast("int").alias("level"), F.col("kv_head").cast("int").alias("kv_head"), "node_id", "center", "radius", "parent_id")


def _length(keys: DataFrame) -> int:
    """Keys of a head (the heads of a batch have as many)."""
    row = keys.groupBy("kv_head").count().agg({"count": "max"}).first()
    return row[0] or 0


class Cache:
    """Layers by number; the last ``shared`` layers hold none of their own.

    With a folder, state is kept there and a cache opened on it again goes on with it.
    """

    def __init__(self, config: Config, layers: int, shared: int = 0, arrow: bool = False, folder: str | None = None):
        self.layers = [Layer(config, arrow, folder and f"{folder.rstrip('/')}/layer-{i}") for i in range(layers - shared)]

    def update(self, keys: DataFrame, layer: int, batch_id: int | None = None) -> Layer:
        return self.layers[layer].update(keys, batch_id)

    def search(self, q: DataFrame, layer: int) -> DataFrame:
        return self.layers[layer].search(q)

    def reset(self) -> None:
        for x in self.layers:
            x.reset()

    def attach(self, stream: DataFrame, checkpoint: str):
        """A Structured Streaming query that feeds the cache; rows have a layer column.

        A batch that some layers took before the driver was lost comes again; those pass it over.
        """

        def take(batch: DataFrame, batch_id: int) -> None:
            batch = batch.persist()
            for i, layer in enumerate(self.layers):
                layer.update(batch.filter(batch.layer == i).drop("layer"), batch_id)
            batch.unpersist()

        return stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
