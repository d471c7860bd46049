"""Tables in the folder that all executors share: where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that may be collected and broadcast as arrays.
BROADCAST_ROWS = 100_000


def folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="orbita-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def saved(df: DataFrame, name: str, path: str | None = None, by: str | None = None) -> DataFrame:
    """df, written (under a path of its own, unless one is given; in a folder for each value of ``by``) and read again."""
    path = path or f"{folder(df.sparkSession)}/orbita-tables/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint, once counted and few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
