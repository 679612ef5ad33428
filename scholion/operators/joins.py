"""Joins that Spark has no operator for, and rewrites of those that it plans badly."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, width: int = 64) -> DataFrame:
    """Each point with the intervals of its key that hold it, both ends included.

    Intervals are laid out over buckets of ``width`` values, so the join is one of equal keys and
    buckets; a long interval has a row for each bucket, and no key gathers in one task.
    """
    laid = intervals.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    placed = points.withColumn("_bucket", F.floor(F.col(point) / width))
    return placed.join(laid, [*keys, "_bucket"]).filter(F.col(point).between(F.col(start), F.col(end))).drop("_bucket")


def either_semi(df: DataFrame, columns: list[str], ids: DataFrame) -> DataFrame:
    """Rows in which one of the columns is among ``ids`` (one column), each row once: a left join for each column instead of a disjunction."""
    name = ids.columns[0]
    known = ids.distinct()
    out, flags = df, []
    for k, column in enumerate(columns):
        flag = f"_hit{k}"
        out = out.join(known.select(F.col(name).alias(column), F.lit(True).alias(flag)), column, "left")
        flags.append(flag)
    kept = out.filter(reduce(Column.__or__, (F.col(x).isNotNull() for x in flags)))
    return kept.select(*df.columns)


def tuple_in(df: DataFrame, keys: list[str], allowed: DataFrame) -> DataFrame:
    return df.join(allowed.select(*keys).distinct(), keys, "left_semi")


def with_fallback(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """All of ``primary``, and of ``fallback`` the rows whose keys ``primary`` lacks."""
    return primary.unionByName(fallback.join(primary.select(*keys), keys, "left_anti"))


def both_ways(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that one side lacks, with ``side``: ``missing`` from the left or ``extra`` there."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(b, keys, "left_anti").withColumn("side", F.lit("extra")))
