"""Authored fields, aliases, roles and slices of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.plans.registry import query
from scholion.sources import bind
from scholion.sources.bind import raw


@query("authored_fields", "SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'reviewed' END, d.source) AS note, l.doc_id IS NULL AS open_question FROM documents d LEFT JOIN labels l USING (doc_id)")
def authored_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is authored goes over what is derived; a record without a review keeps its question."""
    labels = raw(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "reviewed").alias("authored"), F.lit(True).alias("known"))
    joined = raw(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return joined.select("doc_id", F.coalesce("authored", "source").alias("note"), F.col("known").isNull().alias("open_question"))


@query("preferred_names", "SELECT e.entity_key, coalesce(o.preferred, e.name) AS name FROM entities e LEFT JOIN (VALUES ('red widget', 'Red'), ('blue bolt', 'Blue')) o(name, preferred) ON o.name = e.name")
def preferred_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("red widget", "Red"), ("blue bolt", "Blue")], "name string, preferred string")
    return bind.entities(spark, sf_dir).join(F.broadcast(names), "name", "left").select("entity_key", F.coalesce("preferred", "name").alias("name"))


@query("alias_admission", "SELECT entity_id, alias FROM (SELECT entity_id, name, CASE entity_id % 4 WHEN 0 THEN upper(left(name, 1)) || substr(name, 2) WHEN 1 THEN owner WHEN 2 THEN name ELSE 'x' || entity_id END AS alias FROM entities) WHERE regexp_matches(alias, '^[A-Z][a-z]+( [A-Za-z]+)*$') AND alias <> name AND NOT regexp_matches(alias, '[0-9]')")
def alias_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proper names that aren't the entity's own name, nor shaped like the ids of a source."""
    alias = F.expr("CASE entity_id % 4 WHEN 0 THEN upper(left(name, 1)) || substr(name, 2) WHEN 1 THEN owner WHEN 2 THEN name ELSE 'x' || entity_id END")
    found = bind.entities(spark, sf_dir).select("entity_id", "name", alias.alias("alias"))
    return found.filter(F.col("alias").rlike("^[A-Z][a-z]+( [A-Za-z]+)*$") & (F.col("alias") != F.col("name")) & ~F.col("alias").rlike("[0-9]")).select("entity_id", "alias")


@query("role_columns", "SELECT a.reference_id, count(*) FILTER (e.entity_type = 'person') AS people, count(*) FILTER (e.entity_type = 'place') AS places, count(*) FILTER (e.entity_type NOT IN ('person', 'place')) AS others FROM attestations a JOIN entities e USING (entity_id) GROUP BY a.reference_id")
def role_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = bind.attestations(spark, sf_dir).join(bind.entities(spark, sf_dir), "entity_id")
    kind = F.col("entity_type")
    return joined.groupBy("reference_id").agg(F.count_if(kind == "person").alias("people"), F.count_if(kind == "place").alias("places"), F.count_if(~kind.isin("person", "place")).alias("others"))


@query("query_intent", "SELECT doc_id, regexp_matches(text, '[0-9]+[:.][0-9]+') AS wants_reference, regexp_matches(text, '^[A-Z][a-z]+ [a-z]+') AS wants_person, trim(text) = '' AS is_empty FROM documents")
def query_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return raw(spark, sf_dir, "documents").select("doc_id", text.rlike("[0-9]+[:.][0-9]+").alias("wants_reference"), text.rlike("^[A-Z][a-z]+ [a-z]+").alias("wants_person"), (F.trim("text") == "").alias("is_empty"))


@query("claim_rendering", "SELECT DISTINCT s.name || ' ' || r.predicate || ' ' || o.name AS claim FROM relationships r JOIN entities s ON s.entity_id = r.subject_id JOIN entities o ON o.entity_id = r.object_id")
def claim_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = bind.entities(spark, sf_dir).select("entity_id", "name")
    edges = bind.relationships(spark, sf_dir).select("subject_id", "predicate", "object_id").distinct()
    subject, target = names.toDF("subject_id", "subject"), names.toDF("object_id", "object")
    return edges.join(subject, "subject_id").join(target, "object_id").select(F.concat_ws(" ", "subject", "predicate", "object").alias("claim")).distinct()


@query("uncertain_dropped", "SELECT r.predicate, count(*) AS n FROM relationships r WHERE r.subject_id NOT IN (SELECT entity_id FROM entities WHERE owner = 'Brand#7') AND r.object_id NOT IN (SELECT entity_id FROM entities WHERE owner = 'Brand#7') GROUP BY r.predicate")
def uncertain_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of uncertain entities go, at either end."""
    uncertain = bind.entities(spark, sf_dir).filter("owner = 'Brand#7'").select("entity_id")
    kept = bind.relationships(spark, sf_dir)
    for end in ("subject_id", "object_id"):
        kept = kept.join(uncertain.withColumnRenamed("entity_id", end), end, "left_anti")
    return kept.groupBy("predicate").agg(F.count("*").alias("n"))


@query("chapter_slice", "SELECT u.book, count(*) AS units, count(l.doc_id) AS labelled FROM units u LEFT JOIN labels l ON l.doc_id = u.doc_id WHERE u.refsys = 'en' AND u.verse BETWEEN 2 AND 9 GROUP BY u.book")
def chapter_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = bind.units(spark, sf_dir).filter("refsys = 'en' AND verse BETWEEN 2 AND 9").select("book", "doc_id")
    joined = part.join(raw(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("known")), "doc_id", "left")
    return joined.groupBy("book").agg(F.count("*").alias("units"), F.count("known").alias("labelled"))


@query("daily_pick", "SELECT d.day, coalesce(a.doc_id, b.doc_id) AS doc_id FROM (SELECT range AS day FROM range(1, 8)) d LEFT JOIN units a ON a.refsys = 'es' AND a.book = 'src2' AND a.verse = d.day LEFT JOIN units b ON b.refsys = 'en' AND b.book = 'src2' AND b.verse = d.day")
def daily_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's verse by its key in the first source, else in the second; null where neither has it."""
    found = bind.units(spark, sf_dir).filter("book = 'src2' AND refsys IN ('en', 'es') AND verse BETWEEN 1 AND 7").select(F.col("verse").alias("day"), "refsys", "doc_id")
    days = spark.range(1, 8).withColumnRenamed("id", "day")
    for refsys in ("es", "en"):
        days = days.join(found.filter(F.col("refsys") == refsys).select("day", F.col("doc_id").alias(refsys)), "day", "left")
    return days.select("day", F.coalesce("es", "en").alias("doc_id"))
