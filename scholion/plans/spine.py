"""Addresses, scopes and the publication gate."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators.checks import duplicates
from scholion.operators.gate import published_packages, published_rows
from scholion.operators.joins import band_join
from scholion.plans.registry import query
from scholion.sources import bind

AS_OF = datetime.datetime(2024, 2, 1)


def published(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published_packages(bind.packages(spark, sf_dir), bind.releases(spark, sf_dir), bind.approvals(spark, sf_dir), AS_OF)


@query("unit_ordinals", "SELECT refsys, book, verse, doc_id, ordinal FROM units")
def unit_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.units(spark, sf_dir)


@query("scope_units_band", "SELECT s.scope_key, u.doc_id, u.ordinal FROM scopes s JOIN units u ON u.refsys = s.refsys AND u.ordinal BETWEEN s.start_ordinal AND s.end_ordinal")
def scope_units_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return band_join(bind.units(spark, sf_dir), bind.scopes(spark, sf_dir), ["refsys"], "ordinal", "start_ordinal", "end_ordinal").select("scope_key", "doc_id", "ordinal")


@query("active_release_gate", "SELECT package_id, locale FROM published")
def active_release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return published(spark, sf_dir)


@query("row_gate", "SELECT row_kind, row_id FROM (SELECT DISTINCT row_kind, row_id FROM memberships m WHERE EXISTS (SELECT 1 FROM published p WHERE p.package_id = m.package_id))")
def row_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, gate = bind.memberships(spark, sf_dir), published(spark, sf_dir)
    return rows.join(F.broadcast(gate), "package_id", "left_semi").select("row_kind", "row_id").distinct()


@query("published_rows", "SELECT v.refsys, v.book, v.verse, length(v.text) AS size FROM verses v WHERE v.doc_id IN (SELECT row_id FROM memberships m JOIN published p ON p.package_id = m.package_id WHERE row_kind = 'verse')")
def published_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = published_rows(bind.memberships(spark, sf_dir), published(spark, sf_dir), "verse")
    return bind.verses(spark, sf_dir, F.length("text").alias("size")).join(rows, F.col("doc_id") == F.col("row_id"), "left_semi").select("refsys", "book", "verse", "size")


@query("published_entities", "SELECT e.entity_key, e.entity_type, e.name FROM entities e WHERE e.entity_id IN (SELECT row_id FROM memberships m JOIN published p ON p.package_id = m.package_id WHERE row_kind = 'entity')")
def published_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = published_rows(bind.memberships(spark, sf_dir), published(spark, sf_dir), "entity")
    return bind.entities(spark, sf_dir).join(rows, F.col("entity_id") == F.col("row_id"), "left_semi").select("entity_key", "entity_type", "name")


@query("flatten_blocks", "SELECT conv_id, turn, text FROM turns WHERE kind = 'v'")
def flatten_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholion.sources.readers import as_books, flatten_books

    return flatten_books(as_books(bind.turns(spark, sf_dir))).select(F.col("book").alias("conv_id"), F.col("verse").alias("turn"), "text")


@query("active_release_unique", "SELECT locale, count(*) AS n FROM (SELECT locale FROM releases WHERE active UNION ALL SELECT locale FROM releases WHERE package_id % 6 = 0 AND NOT active) GROUP BY locale HAVING count(*) > 1")
def active_release_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locales of more than one active release, where every sixth package that isn't active claims to be."""
    claimed = bind.releases(spark, sf_dir).filter("active OR package_id % 6 = 0")
    return duplicates(claimed, ["locale"])
