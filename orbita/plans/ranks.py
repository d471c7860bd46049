"""Places of rows in their group, without a window over a large group.

Rows are dealt into ranges of (group, order) and sorted there, so a row's place is its
place in the range, plus the group's rows in earlier ranges: prefix sums over a table of
one row a group and range.  Groups that were counted and small keep the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tables

#: Rows of a group that a window may hold.
WINDOW_ROWS = 1 << 18


def _ranged(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """df, written, with ``__range`` and ``__at``: ranges of (by, order), and a number that grows inside a range."""
    keys = [f"__order{i}" for i in range(len(order))]
    keyed = df.select("*", *((F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip(order, keys, strict=True)))
    dealt = keyed.repartitionByRange(*by, *keys).sortWithinPartitions(*by, *keys)
    return tables.saved(dealt.select(*df.columns, F.spark_partition_id().alias("__range"), F.monotonically_increasing_id().alias("__at")), "ranges")


def _few(df: DataFrame, by: list[str], window_rows: int | None) -> bool:
    return (df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= (WINDOW_ROWS if window_rows is None else window_rows)


def numbered(df: DataFrame, by: list[str], order: list, name: str, window_rows: int | None = None) -> DataFrame:
    """df and ``name``: each row's place in its group, from 1; ``order`` (columns or expressions, ascending) must tell rows apart."""
    if _few(df, by, window_rows):
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    dealt = _ranged(df, by, order)
    parts = dealt.groupBy(*by, "__range").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy(*by).orderBy("__range")) - F.col("__rows")  # a row a range
    starts = tables.small(tables.saved(parts.select(*by, "__range", "__first", before.alias("__before")), "starts"))
    return dealt.join(starts, [*by, "__range"]).select(*df.columns, (F.col("__at") - F.col("__first") + F.col("__before") + 1).alias(name))


def running(df: DataFrame, by: list[str], order: list, value: str, name: str, window_rows: int | None = None) -> DataFrame:
    """df and ``name``: the sum of ``value`` over the rows before in the group."""
    if _few(df, by, window_rows):
        return df.withColumn(name, F.sum(value).over(Window.partitionBy(*by).orderBy(*order)) - F.col(value))
    dealt = _ranged(df, by, order)
    parts = dealt.groupBy(*by, "__range").agg(F.sum(value).alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__range")) - F.col("__sum")  # a row a range
    starts = tables.small(tables.saved(parts.select(*by, "__range", before.alias("__before")), "starts"))
    inside = F.sum(value).over(Window.partitionBy(*by, "__range").orderBy("__at")) - F.col(value)  # one range
    return dealt.join(starts, [*by, "__range"]).withColumn("__inside", inside).select(*df.columns, (F.col("__inside") + F.col("__before")).alias(name))
