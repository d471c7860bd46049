"""Readers, writers and samplers of keys and prompts."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clustering import seed_order
from . import npz


def sample(df: DataFrame, n: int, seed: int = 0, key: str = "key_id") -> DataFrame:
    """n rows without replacement in seed order; all of them where n is not positive."""
    return df if n <= 0 else df.orderBy(*seed_order(seed, key)).limit(n)


def keys(spark: SparkSession, path: str, n: int = 0, seed: int = 0) -> DataFrame:
    return sample(spark.read.parquet(path), n, seed)


def npz_keys(spark: SparkSession, path: str, array: str = "keys", kv_head: int = 0) -> DataFrame:
    """Keys from a NumPy archive or a folder of them, read by row ranges."""
    return npz.read(spark, path, array, kv_head)


def save(df: DataFrame, path: str, about: dict[str, Any]) -> None:
    """Parquet plus one JSON line of metadata beside it."""
    df.write.mode("overwrite").parquet(path)
    df.sparkSession.createDataFrame([(json.dumps(about, sort_keys=True, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.json")


def about(spark: SparkSession, path: str) -> dict[str, Any]:
    return json.loads(spark.read.text(f"{path}.json").first()[0])


#: Every character that Python's str.strip takes for white space.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def stripped(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def prompt(*columns: Column) -> Column:
    """The first string that isn't blank, stripped."""
    return F.coalesce(*(F.when(stripped(c) != "", stripped(c)) for c in columns))


def json_prompts(spark: SparkSession, path: str, limit: int = 0) -> DataFrame:
    rows = spark.read.schema("input string, question string, prompt string").json(path)
    found = rows.select(prompt(*(F.col(c) for c in rows.columns)).alias("prompt")).filter("prompt is not null")
    return found if limit <= 0 else found.limit(limit)


def text_prompts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(stripped(F.col("value")).alias("prompt")).filter("prompt != ''")


def append_csv(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("inferSchema", True).csv(path)


def heads(df: DataFrame, count: int, key_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """A wide vector as several heads of equal width."""
    width = (F.size(vector) / count).cast("int")
    return df.select(F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("kv_head"), F.col(key_id).cast("long").alias("key_id"), vector).select("kv_head", "key_id", F.slice(vector, F.col("kv_head") * width + 1, width).alias("key"))


def flattened(keys: DataFrame) -> DataFrame:
    """Heads as rows of one set."""
    return keys.select("key")
