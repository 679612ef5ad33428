"""Data-quality findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions.keys import key_error
from scholion.operators import checks
from scholion.plans.registry import query
from scholion.sources import bind
from scholion.sources.bind import raw


@query("dup_keys", "SELECT reference_id, line, count(*) AS n FROM attestations GROUP BY ALL HAVING count(*) > 1")
def dup_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(bind.attestations(spark, sf_dir), ["reference_id", "line"])


@query("dangling_all", """SELECT DISTINCT 'attestation.reference' AS pointer, CAST(reference_id AS VARCHAR) AS key FROM attestations WHERE reference_id NOT IN (SELECT doc_id FROM documents)
    UNION ALL SELECT DISTINCT 'order.customer', CAST(o_custkey + 5 AS VARCHAR) FROM orders WHERE o_custkey + 5 NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT DISTINCT 'relationship.object', CAST(object_id * 21 AS VARCHAR) FROM relationships WHERE object_id * 21 NOT IN (SELECT entity_id FROM entities)""")
def dangling_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = raw(spark, sf_dir, "orders").select((F.col("o_custkey") + 5).alias("customer"))
    edges = bind.relationships(spark, sf_dir).select((F.col("object_id") * 21).alias("object"))
    return checks.all_findings([
        checks.dangling(bind.attestations(spark, sf_dir), "reference_id", raw(spark, sf_dir, "documents"), "doc_id", "attestation.reference"),
        checks.dangling(orders, "customer", raw(spark, sf_dir, "customer"), "c_custkey", "order.customer"),
        checks.dangling(edges, "object", bind.entities(spark, sf_dir), "entity_id", "relationship.object"),
    ])


_GROUPS = "SELECT doc_id + (doc_id % 11 = 0)::INT AS reference, CASE WHEN doc_id % 3 = 0 THEN 'complete_zero' WHEN doc_id % 3 = 1 THEN 'complete_with_records' ELSE 'blocked' END AS result, quality AS n_records, CASE WHEN toxic = 0 AND doc_id % 2 = 0 THEN 'q' END AS question FROM labels"


@query("coverage_findings", f"""WITH g AS ({_GROUPS}), a AS (SELECT doc_id AS reference FROM documents WHERE n_chars > 600)
    SELECT reference, 'overlap' AS finding FROM g GROUP BY reference HAVING count(*) > 1
    UNION ALL SELECT reference, 'contradictory-zero' FROM g WHERE result = 'complete_zero' AND n_records > 0
    UNION ALL SELECT reference, 'missing-records' FROM g WHERE result = 'complete_with_records' AND n_records = 0
    UNION ALL SELECT reference, 'blocked-without-question' FROM g WHERE result = 'blocked' AND question IS NULL
    UNION ALL SELECT DISTINCT reference, 'outside' FROM g WHERE reference NOT IN (SELECT reference FROM a)
    UNION ALL SELECT reference, 'gap' FROM a WHERE reference NOT IN (SELECT reference FROM g)""")
def coverage_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = raw(spark, sf_dir, "labels").selectExpr("doc_id + CAST(doc_id % 11 = 0 AS INT) AS reference", "CASE WHEN doc_id % 3 = 0 THEN 'complete_zero' WHEN doc_id % 3 = 1 THEN 'complete_with_records' ELSE 'blocked' END AS result", "quality AS n_records", "CASE WHEN toxic = 0 AND doc_id % 2 = 0 THEN 'q' END AS question")
    authority = raw(spark, sf_dir, "documents").filter("n_chars > 600").select(F.col("doc_id").alias("reference"))
    return checks.coverage_findings(groups, authority)


@query("kind_gating", "SELECT e.entity_type, a.kind, count(*) AS n FROM attestations a JOIN entities e USING (entity_id) WHERE (e.entity_type, a.kind) NOT IN (VALUES ('person', 'A'), ('person', 'N'), ('place', 'R'), ('group', 'N')) GROUP BY ALL")
def kind_gating(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([("person", "A"), ("person", "N"), ("place", "R"), ("group", "N")], "entity_type string, kind string")
    counted = bind.attestations(spark, sf_dir).groupBy("entity_id", "kind").agg(F.count(F.lit(1)).alias("n")).join(bind.entities(spark, sf_dir), "entity_id")
    return counted.join(F.broadcast(allowed), ["entity_type", "kind"], "left_anti").groupBy("entity_type", "kind").agg(F.sum("n").alias("n"))


@query("anchor_regrade", "SELECT a.doc_id, CASE WHEN a.basis = 'explicit' AND m.doc_id IS NULL THEN 'strongly_implied' ELSE a.basis END AS basis FROM (SELECT doc_id, CASE quality WHEN 1 THEN 'explicit' ELSE 'inferred' END AS basis FROM labels) a LEFT JOIN (SELECT DISTINCT doc_id FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9])the([^A-Za-z0-9]|$)')) m USING (doc_id)")
def anchor_regrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholion.functions.text import bounded_pattern

    found = raw(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "explicit").otherwise("inferred").alias("basis"))
    mentions = raw(spark, sf_dir, "documents").filter(F.col("text").rlike(bounded_pattern("the")))
    return checks.regraded(found, mentions, ["doc_id"])


@query("honest_grade", "SELECT doc_id, CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9])that([^A-Za-z0-9]|$)') THEN 'explicit' ELSE 'inferred' END AS basis, CASE WHEN regexp_matches(text, '(^|[^A-Za-z0-9])that([^A-Za-z0-9]|$)') THEN 'established' ELSE 'proposed' END AS status FROM documents")
def honest_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholion.functions.text import bounded_pattern

    quoted = F.col("text").rlike(bounded_pattern("that"))
    return raw(spark, sf_dir, "documents").select("doc_id", F.when(quoted, "explicit").otherwise("inferred").alias("basis"), F.when(quoted, "established").otherwise("proposed").alias("status"))


@query("text_gaps", "SELECT conv_id, turn, CASE kind WHEN 'h' THEN 'blank-heading' ELSE 'blank-verse' END AS finding FROM (SELECT conv_id, turn, kind, CASE WHEN turn % 3 = 1 THEN '  ' ELSE text END AS text FROM turns) WHERE text IS NULL OR trim(text) = ''")
def text_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blank verses and headings, where every third turn's text is blanked."""
    blanked = bind.turns(spark, sf_dir).withColumn("text", F.when(F.col("turn") % 3 == 1, "  ").otherwise(F.col("text")))
    return checks.blank_texts(blanked, ["conv_id", "turn"])


@query("exactly_one_of", "SELECT doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE (quality IS NOT NULL)::INT + (CASE WHEN n_chars > 900 THEN 1 END IS NOT NULL)::INT = 1")
def exactly_one_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = raw(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") > 900, 1).alias("long")).join(raw(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.filter(checks.exactly_one_of(["quality", "long"])).select("doc_id")


@query("state_implication", "SELECT doc_id FROM labels WHERE (toxic = 1) <> (quality = 0) AND NOT (toxic = 0 AND quality = 1)")
def state_implication(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "labels").filter(((F.col("toxic") == 1) != (F.col("quality") == 0)) & ~((F.col("toxic") == 0) & (F.col("quality") == 1))).select("doc_id")


@query("error_precedence", """SELECT key, CASE min(r) WHEN 1 THEN 'dangling' WHEN 2 THEN 'duplicate' ELSE 'invalid-state' END AS error FROM (
    SELECT reference_id AS key, 1 AS r FROM attestations WHERE reference_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT reference_id, 2 FROM attestations GROUP BY reference_id, line HAVING count(*) > 1 UNION ALL SELECT reference_id, 3 FROM attestations WHERE kind = 'N' AND basis = 'F') GROUP BY key""")
def error_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bind.attestations(spark, sf_dir)
    docs = raw(spark, sf_dir, "documents").select(F.col("doc_id").alias("reference_id"))
    parts = (("dangling", rows.join(docs, "reference_id", "left_anti")), ("duplicate", checks.duplicates(rows, ["reference_id", "line"])), ("invalid-state", rows.filter("kind = 'N' AND basis = 'F'")))
    found = checks.all_findings([x.select(F.col("reference_id").alias("key"), F.lit(name).alias("error")) for name, x in parts])
    return checks.gravest(found, ["key"])


@query("key_grammar", "SELECT entity_key, CASE WHEN NOT regexp_matches(entity_key, '^entity:[a-z0-9]+(-[a-z0-9]+)*$') THEN 'invalid-entity' END AS error, CASE WHEN NOT regexp_matches(name, '^[a-z]{2,3}(-[A-Z]{2})?$') THEN 'invalid-language' END AS name_error FROM entities")
def key_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.entities(spark, sf_dir).select("entity_key", key_error("entity", F.col("entity_key")).alias("error"), key_error("language", F.col("name")).alias("name_error"))


@query("partial_uniqueness", "SELECT entity_id, count(*) AS n FROM attestations WHERE kind = 'A' AND basis = 'O' GROUP BY entity_id, reference_id HAVING count(*) > 1")
def partial_uniqueness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.duplicates(bind.attestations(spark, sf_dir).filter("kind = 'A' AND basis = 'O'"), ["entity_id", "reference_id"]).select("entity_id", "n")


@query("immutable_rows", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'removed' ELSE 'changed' END AS finding FROM labels WHERE doc_id % 5 = 0 OR toxic = 1")
def immutable_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholion.operators.merge import changed_keys

    before = raw(spark, sf_dir, "labels")
    after = before.filter("doc_id % 5 <> 0").withColumn("quality", F.col("quality") + F.col("toxic"))
    return changed_keys(before, after, ["doc_id"])
