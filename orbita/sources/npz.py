"""NumPy archives as a data source: row ranges of an array are partitions, and a write is committed as a whole.

Archives that ``np.savez`` wrote hold arrays plain, so a task seeks to its rows and reads
them in batches; only headers are read beforehand.  Arrays that are compressed or in
Fortran order can't be entered in the middle and are one partition each.  A writer's tasks
roll files at a size; they get their names when all tasks are done, and a manifest lists them.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

#: Bytes of a partition, of a file that is written, and rows of a batch.
PART_BYTES, FILE_BYTES, BATCH_ROWS = 64 << 20, 64 << 20, 4096
SCHEMA = "kv_head int, key_id long, key array<float>"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else f"file://{uri}")


def _files(uri: str) -> list[str]:
    """Archives of a file or folder, by name; a manifest's, where there is one."""
    from pyarrow import fs

    store, path = _store(uri)
    if store.get_file_info(path).type == fs.FileType.File:
        return [path]
    names = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".npz"))
    if store.get_file_info(f"{path}/manifest.json").type == fs.FileType.File:
        with store.open_input_stream(f"{path}/manifest.json") as f:
            listed = {f"{path}/{x['file']}" for x in json.loads(f.read())["files"]}
        names = [x for x in names if x in listed]
    return names


def _head(f, info: zipfile.ZipInfo) -> tuple[int, tuple, bool, np.dtype]:
    """(place of the data in the file, shape, whether rows lie one after the other, kind) of an archive's array."""
    f.seek(info.header_offset + 26)
    lengths = f.read(4)
    start = info.header_offset + 30 + int.from_bytes(lengths[:2], "little") + int.from_bytes(lengths[2:], "little")
    with zipfile.ZipFile(f) as z, z.open(info) as data:
        head = io.BytesIO(data.read(min(info.file_size, 1 << 16)))
    version = np.lib.format.read_magic(head)
    shape, fortran, dtype = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}[version](head)
    return start + head.tell(), shape, info.compress_type == zipfile.ZIP_STORED and not fortran, dtype


@dataclass
class Rows(InputPartition):
    """Rows first to last (exclusive) of an array whose own rows begin at ``key``; at None the archive is read whole."""

    file: str
    array: str
    at: int | None
    width: int
    kind: str
    first: int
    last: int
    key: int


class NpzReader(DataSourceReader):
    def __init__(self, options):
        self.uri, self.array = options["path"], options.get("array", "keys")
        self.head, self.part_bytes = int(options.get("kvHead", 0)), int(options.get("partBytes", PART_BYTES))

    def partitions(self) -> list[Rows]:
        store, _ = _store(self.uri)
        found, key = [], 0
        for name in _files(self.uri):
            with store.open_input_file(name) as f:
                info = zipfile.ZipFile(f).getinfo(f"{self.array}.npy")
                at, shape, plain, kind = _head(f, info)
            width = int(shape[-1]) if shape else 1
            n = int(np.prod(shape[:-1], dtype=np.int64)) if shape else 1
            step = max(1, self.part_bytes // max(1, width * kind.itemsize)) if plain else max(1, n)
            found += [Rows(name, self.array, at if plain else None, width, kind.str, first, min(n, first + step), key) for first in range(0, n, step)]
            key += n
        return found

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        store, _ = _store(self.uri)
        kind = np.dtype(part.kind)
        with store.open_input_file(part.file) as f:
            if part.at is None:
                whole = np.load(f)[part.array].reshape(-1, part.width)
            for first in range(part.first, part.last, BATCH_ROWS):
                n = min(BATCH_ROWS, part.last - first)
                if part.at is None:
                    x = whole[first : first + n]
                else:
                    f.seek(part.at + first * part.width * kind.itemsize)
                    x = np.frombuffer(f.read(n * part.width * kind.itemsize), kind).reshape(n, part.width)
                flat = pa.array(np.ascontiguousarray(x, np.float32).ravel())
                keys = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), flat)
                yield pa.record_batch([pa.array(np.full(n, self.head, np.int32)), pa.array(np.arange(part.key + first, part.key + first + n)), keys], names=["kv_head", "key_id", "key"])


@dataclass
class Written(WriterCommitMessage):
    files: list


class NpzWriter(DataSourceArrowWriter):
    """Rows (kv_head, key_id, key of one width) into archives with arrays heads, ids and keys."""

    def __init__(self, options, overwrite: bool):
        self.uri, self.overwrite = options["path"], overwrite
        self.file_bytes, self.run = int(options.get("fileBytes", FILE_BYTES)), uuid.uuid4().hex

    def _draft(self) -> str:
        return f"{_store(self.uri)[1]}/.draft-{self.run}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, _ = _store(self.uri)
        store.create_dir(self._draft(), recursive=True)
        files, held, size = [], [], 0

        def put():
            heads, ids = (np.concatenate([h[i] for h in held]) for i in (0, 1))
            keys = np.concatenate([h[2] for h in held])
            name = f"part-{uuid.uuid4().hex}.npz"
            with store.open_output_stream(f"{self._draft()}/{name}") as out:
                np.savez(_Unseekable(out), heads=heads, ids=ids, keys=keys)
            files.append({"file": name, "rows": len(keys)})
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            t = {name: b.column(name) for name in ("kv_head", "key_id", "key")}
            x = t["key"].flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(b.num_rows, -1)
            held.append((t["kv_head"].to_numpy(zero_copy_only=False), t["key_id"].to_numpy(zero_copy_only=False), x))
            size += x.nbytes
            if size >= self.file_bytes:
                put()
                size = 0
        if held:
            put()
        return Written(files)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        store, path = _store(self.uri)
        old = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith((".npz", "manifest.json"))]
        files = [x for m in messages if m for x in m.files]
        if not self.overwrite and any(f.endswith("manifest.json") for f in old):
            with store.open_input_stream(f"{path}/manifest.json") as f:
                files = json.loads(f.read())["files"] + files
        for m in messages:
            for x in m.files if m else ():
                store.move(f"{self._draft()}/{x['file']}", f"{path}/{x['file']}")
        with store.open_output_stream(f"{path}/manifest.json") as f:  # what counts
            f.write(json.dumps({"files": files}).encode())
        if self.overwrite:
            for f in old:
                if f.endswith(".npz"):
                    store.delete_file(f)
        if store.get_file_info(self._draft()).type == fs.FileType.Directory:
            store.delete_dir(self._draft())

    def abort(self, messages: list) -> None:
        from pyarrow import fs

        store, _ = _store(self.uri)
        if store.get_file_info(self._draft()).type == fs.FileType.Directory:
            store.delete_dir(self._draft())


class _Unseekable(io.RawIOBase):
    """A stream that zipfile writes forward only."""

    def __init__(self, out):
        self.out = out

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        return self.out.write(bytes(data))


class NpzSource(DataSource):
    """Options: path, array, kvHead, partBytes; for writing path, fileBytes."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options)

    def writer(self, schema, overwrite: bool) -> NpzWriter:
        return NpzWriter(self.options, overwrite)


def read(spark: SparkSession, path: str, array: str = "keys", kv_head: int = 0, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of a file, or of a folder's files one after the other, numbered from 0."""
    spark.dataSource.register(NpzSource)
    return spark.read.format("npz").option("array", array).option("kvHead", kv_head).option("partBytes", part_bytes).load(path)


def write(keys: DataFrame, path: str, mode: str = "append", file_bytes: int = FILE_BYTES) -> None:
    keys.sparkSession.dataSource.register(NpzSource)
    keys.selectExpr("cast(kv_head as int) kv_head", "cast(key_id as long) key_id", "cast(key as array<float>) key").write.format("npz").mode(mode).option("fileBytes", file_bytes).save(path)
