"""Findings about keyed records: every check returns rows of what is wrong, none if all is well."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Classes of errors, gravest first.
PRECEDENCE = ("dangling", "duplicate", "invalid-state")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than one row, and how many they have."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def dangling(df: DataFrame, column: str, authority: DataFrame, key: str, pointer: str) -> DataFrame:
    """(``pointer``, ``key``): values of the column that the authority lacks, each once; null points nowhere."""
    values = df.select(F.col(column).cast("string").alias("key")).filter("key IS NOT NULL").distinct()
    known = authority.select(F.col(key).cast("string").alias("key"))
    return values.join(known, "key", "left_anti").select(F.lit(pointer).alias("pointer"), "key")


def all_findings(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def exactly_one_of(columns: list[str]) -> Column:
    return reduce(Column.__add__, (F.col(x).isNotNull().cast("int") for x in columns)) == 1


def mixed_licences(components: DataFrame, release: str, evidence: str, paths: str) -> DataFrame:
    """(release, ``components``, ``path_sets``): releases of several components that share one licence evidence but differ in the paths that they cover. The order of a component's paths doesn't matter; see ``without_paths`` for those that cover none."""
    found = components.groupBy(release).agg(F.count(F.lit(1)).alias("components"), F.countDistinct(evidence).alias("_evidence"), F.countDistinct(paths).alias("path_sets"))
    return found.filter("components > 1 AND _evidence = 1 AND path_sets > 1").drop("_evidence")


def without_paths(components: DataFrame, release: str, component: str, paths: str) -> DataFrame:
    """(release, component): components that don't say which paths or fields they cover."""
    return components.filter(F.coalesce(F.size(paths), F.lit(0)) <= 0).select(release, component)


def blank_texts(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks (``kind`` h or v, ``text``) without a text."""
    blank = blocks.filter(F.col("text").isNull() | (F.trim("text") == ""))
    return blank.select(*keys, F.when(F.col("kind") == "h", "blank-heading").otherwise("blank-verse").alias("finding"))


def outside_snapshot(df: DataFrame, column: str, allowed: DataFrame | None, pointer: str) -> DataFrame:
    """(``pointer``, ``key``) of values that a snapshot lacks; null passes, and so does everything where there is no snapshot."""
    if allowed is None:
        return df.select(F.lit(pointer).alias("pointer"), F.col(column).cast("string").alias("key")).filter(F.lit(False))
    return dangling(df, column, allowed, allowed.columns[0], pointer)


def unknown_columns(df: DataFrame, allowed: list[str]) -> list[str]:
    """Columns that a strict schema doesn't have."""
    return sorted(set(df.columns) - set(allowed))


def gravest(findings: DataFrame, keys: list[str], error: str = "error") -> DataFrame:
    """The gravest error of each key, of those in ``PRECEDENCE``."""
    # a rank is a number, so Spark adds rows up as they come; it would sort them first to keep a name
    names = F.array(*map(F.lit, PRECEDENCE))
    rank = F.array_position(names, F.col(error))
    return findings.groupBy(*keys).agg(F.min(rank).alias("_rank")).select(*keys, F.element_at(names, F.col("_rank").cast("int")).alias(error))


def coverage_findings(groups: DataFrame, authority: DataFrame, reference: str = "reference") -> DataFrame:
    """(``reference``, ``finding``) for coverage rows (reference, result, n_records, question) against the references to be covered.

    ``overlap``: in two groups; ``contradictory-zero``: said to be complete without records but has
    some; ``missing-records``: said to have records but has none; ``blocked-without-question``;
    ``outside``: not in the authority; ``gap``: covered by no group.
    """
    rules = {
        "contradictory-zero": "result = 'complete_zero' AND n_records > 0",
        "missing-records": "result = 'complete_with_records' AND n_records = 0",
        "blocked-without-question": "result = 'blocked' AND question IS NULL",
    }
    found = [groups.groupBy(reference).count().filter("count > 1").select(reference, F.lit("overlap").alias("finding"))]
    found += [groups.filter(rule).select(reference, F.lit(name).alias("finding")) for name, rule in rules.items()]
    known, covered = authority.select(reference).distinct(), groups.select(reference).distinct()
    found.append(covered.join(known, reference, "left_anti").select(reference, F.lit("outside").alias("finding")))
    found.append(known.join(covered, reference, "left_anti").select(reference, F.lit("gap").alias("finding")))
    return all_findings(found)


def regrade(basis: Column, anchored: Column) -> Column:
    """A basis as a mention bears it: explicit only where one quotes the attestation (``anchored``)."""
    return F.when((basis == "explicit") & ~anchored, "strongly_implied").otherwise(basis)


def regraded(attestations: DataFrame, mentions: DataFrame, keys: list[str]) -> DataFrame:
    """Attestations with ``basis`` as their mentions bear it: explicit only where a mention quotes them."""
    anchored = mentions.select(*keys).distinct().withColumn("_anchored", F.lit(True))
    return attestations.join(anchored, keys, "left").withColumn("basis", regrade(F.col("basis"), F.col("_anchored").isNotNull())).drop("_anchored")
