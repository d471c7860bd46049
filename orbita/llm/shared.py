"""The shared folder: where lineage is cut and where executors exchange files.

``spark.checkpoint.dir`` is read from the session.  Only where it is unset
(as in local tests) a folder of our own is made, and refused on a cluster.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """URI of the shared folder."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="orbita-")
        spark.conf.set("spark.checkpoint.dir", base)
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    return f"{root(spark)}/orbita/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet to the shared folder and read again: survives lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def local(uri: str) -> str | None:
    """The path of a URI that this machine can open itself."""
    parts = urlparse(uri)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def clean(spark: SparkSession) -> None:
    """Delete what was written there; call it once no result of this package is read any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root(spark)}/orbita")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def put(uri: str, data: np.ndarray | list[bytes]) -> None:
    """Write an array's bytes, or strings of bytes one after the other, under a name no other task uses."""
    parts = data if isinstance(data, list) else [np.ascontiguousarray(data).view(np.uint8).data]
    if path := local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.writelines(parts)
        return
    store, path = _remote(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path) as f:
        for part in parts:
            f.write(part)


def mapped(uri: str, dtype) -> np.ndarray:
    """A file as an array: memory-mapped, or read whole from a remote store."""
    if path := local(uri):
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    store, path = _remote(uri)
    with store.open_input_stream(path) as f:
        return np.frombuffer(f.read(), dtype=dtype)
