"""Ordinals, islands and carried values over ordered rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive order values that are numbered together.
BUCKET = 65_536


def ordinal_within(df: DataFrame, keys: list[str], order: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """``df`` with the row's number within its key, from 1 in order of an integer column that is unique there.

    A key of any size is numbered in parallel: buckets of the order column are counted and their
    counts summed up, which windows over a few rows, and rows are numbered within their buckets.
    """
    part = F.floor(F.col(order) / F.lit(bucket)).alias("_part")
    counted = df.groupBy(*keys, part).count()
    before = F.sum("count").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("count")
    offsets = counted.select(*keys, "_part", before.alias("_before"))
    numbered = df.withColumn("_part", part).withColumn("_row", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(order)))
    return numbered.join(offsets, [*keys, "_part"]).withColumn(name, F.col("_before") + F.col("_row")).drop("_part", "_before", "_row")


def islands(df: DataFrame, keys: list[str], order: list[str], begins: Column, name: str = "island") -> DataFrame:
    """``df`` with the number of the island that each row lies in: one begins at each row where ``begins`` is true. Rows before the first are island 0."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.sum(F.when(begins, 1).otherwise(0)).over(frame))


def carried(value: Column, keys: list[str], order: list[str], default: object = None) -> Column:
    """The last non-null value before the row, within its key."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = F.last(value, ignorenulls=True).over(frame)
    return found if default is None else F.coalesce(found, F.lit(default))


def _bucketed(df: DataFrame, keys: list[str], order: str, bucket: int) -> tuple[DataFrame, list[str]]:
    return df.withColumn("_part", F.floor(F.col(order) / F.lit(bucket))), [*keys, "_part"]


def islands_within(df: DataFrame, keys: list[str], order: str, begins: Column, name: str = "island", bucket: int = BUCKET) -> DataFrame:
    """``islands`` for keys of any size, in order of an integer column that is unique within its key.

    A segmented prefix sum: buckets of the order column count their beginnings, the counts are summed up
    over buckets, which are few, and each bucket's rows add their own. No task holds more than a bucket.
    """
    df, parts = _bucketed(df.withColumn("_begins", F.when(begins, 1).otherwise(0)), keys, order, bucket)
    counted = df.groupBy(*parts).agg(F.sum("_begins").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
    offsets = counted.select(*parts, before.alias("_before"))
    own = F.sum("_begins").over(Window.partitionBy(*parts).orderBy(order))
    return df.withColumn("_own", own).join(offsets, parts).withColumn(name, F.col("_before") + F.col("_own")).drop("_begins", "_part", "_own", "_before")


def carried_within(df: DataFrame, keys: list[str], order: str, value: Column, name: str, bucket: int = BUCKET) -> DataFrame:
    """``df`` with the last non-null value before each row within its key, for keys of any size.

    A segmented scan: a bucket's summary is its last value; the last summary before a bucket is
    carried into it, and serves its rows until one of their own does.
    """
    df, parts = _bucketed(df.withColumn("_value", value), keys, order, bucket)
    summary = df.filter("_value IS NOT NULL").groupBy(*parts).agg(F.max_by("_value", order).alias("_last"))
    there = df.select(*parts).distinct().join(summary, parts, "left")
    into = F.last("_last", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    entering = there.select(*parts, into.alias("_entering"))
    own = F.last("_value", ignorenulls=True).over(Window.partitionBy(*parts).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_own", own).join(entering, parts).withColumn(name, F.coalesce("_own", "_entering")).drop("_value", "_part", "_own", "_entering")


def first_distinct(df: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """(keys, ``first``: array of the least ``n`` distinct values in order, ``more``: whether there are others). Each key keeps ``n`` + 1 values on the way, whatever it has."""
    ranked = df.select(*keys, value).distinct().withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).filter(F.col("_rank") <= n + 1)
    listed = ranked.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias("_values"))
    return listed.select(*keys, F.slice("_values", 1, n).alias("first"), (F.size("_values") > n).alias("more"))


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The columns of each key's last row in order, by one aggregation instead of a window."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of each key in order, ranked from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
