"""Checks across the books of a canon, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators import canon, checks
from scholion.plans.registry import query
from scholion.sources import bind
from scholion.sources.bind import raw


@query(
    "identity_splits",
    """WITH locked AS (SELECT DISTINCT 'entity:' || replace(p_name, ' ', '-') AS entity_key, p_name AS spoken FROM part UNION SELECT DISTINCT 'entity:' || string_split(p_name, ' ')[1], string_split(p_name, ' ')[1] FROM part UNION SELECT 'entity:' || n_name, lower(replace(n_name, '-', ' ')) FROM nation)
    SELECT entity_key, array_to_string(list_sort(list(DISTINCT 'entity:' || p_partkey))[1:5], ',') AS candidates FROM locked JOIN part ON contains(lower(p_name), spoken) GROUP BY entity_key""",
)
def identity_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Locked keys made of names and of their first words against parts as registered entities."""
    part = raw(spark, sf_dir, "part")
    registry = part.select(F.concat(F.lit("entity:"), "p_partkey").alias("entity_key"), F.col("p_name").alias("preferred_name"))
    labels = F.array(F.replace("p_name", F.lit(" "), F.lit("-")), F.get(F.split("p_name", " "), 0))
    locked = part.select(F.explode(labels).alias("label")).select(F.concat(F.lit("entity:"), "label").alias("entity_key"))
    locked = locked.union(raw(spark, sf_dir, "nation").select(F.concat(F.lit("entity:"), "n_name")))
    return canon.identity_splits(locked, registry).select("entity_key", F.array_join("candidates", ",").alias("candidates"))


_PACKAGES = "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'edition' ELSE 'locale' END AS layer, CASE WHEN o_custkey % 4 = 0 THEN 'pkg:bsb-' ELSE 'PKG:' END || CASE WHEN o_custkey % 5 = 0 THEN 'x-en-' ELSE '' END || o_orderkey AS package_key, CASE WHEN o_orderstatus = 'O' THEN 'edition:bsb' END AS edition_key FROM orders"
_NAMED = "contains(lower(package_key), 'bsb')"


@query(
    "canon_neutrality",
    f"""WITH p AS ({_PACKAGES})
    SELECT '/packages' AS pointer, package_key AS key, 'not-neutral' AS finding FROM p WHERE layer = 'canonical' AND ({_NAMED} OR contains(lower(package_key), '-en-')) UNION ALL SELECT '/packages', package_key, 'names-edition' FROM p WHERE layer = 'locale' AND {_NAMED}
    UNION ALL SELECT '/packages', package_key, 'unnamed-edition' FROM p WHERE layer = 'edition' AND NOT {_NAMED} UNION ALL SELECT '/packages', package_key, 'edition-key' FROM p WHERE layer <> 'edition' AND edition_key IS NOT NULL UNION ALL SELECT '/packages', package_key, 'missing-edition-key' FROM p WHERE layer = 'edition' AND edition_key IS NULL""",
)
def canon_neutrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    packages = raw(spark, sf_dir, "orders").selectExpr(
        "CASE o_orderkey % 3 WHEN 0 THEN 'canonical' WHEN 1 THEN 'edition' ELSE 'locale' END AS layer", "IF(o_custkey % 4 = 0, 'pkg:bsb-', 'PKG:') || IF(o_custkey % 5 = 0, 'x-en-', '') || o_orderkey AS package_key", "IF(o_orderstatus = 'O', 'edition:bsb', NULL) AS edition_key",
    )
    return canon.neutrality(packages, ("bsb", "-en-", "-tel-", "-ta-"), "bsb")


@query(
    "canon_registry",
    """SELECT '/registry' AS pointer, CAST(p_partkey AS VARCHAR) AS key, 'status' AS finding FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD') UNION ALL SELECT '/registry', CAST(p_partkey AS VARCHAR), 'untagged' FROM part WHERE p_size % 6 = 0 UNION ALL SELECT '/registry', CAST(p_partkey AS VARCHAR), 'derived' FROM part WHERE p_size > 45
    UNION ALL SELECT '/prose', CAST(doc_id AS VARCHAR), 'untagged' FROM documents WHERE lang <> 'en' UNION ALL SELECT DISTINCT '/relationships', predicate, 'outside-ontology' FROM relationships WHERE predicate NOT IN (SELECT o_orderstatus || 'F' FROM orders UNION SELECT 'AF')
    UNION ALL SELECT '/registry', '*', 'no-external-ids'""",
)
def canon_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registry's own rules, the language of prose and the ontology of predicates."""
    registry = raw(spark, sf_dir, "part").selectExpr("p_partkey AS entity_key", "p_type AS status", "IF(p_size % 6 = 0, NULL, 'en') AS language_tag", "IF(p_size > 45, p_size, NULL) AS verse_count", "0 AS external_ids")
    prose = raw(spark, sf_dir, "documents").selectExpr("doc_id AS key", "lang AS language_tag")
    ontology = raw(spark, sf_dir, "orders").selectExpr("o_orderstatus || 'F' AS predicate_key").distinct().union(spark.createDataFrame([("AF",)], "predicate_key string"))
    relations = bind.relationships(spark, sf_dir).select(F.col("predicate").alias("predicate_key"))
    return checks.all_findings([canon.registry_rules(registry, "en", ("ECONOMY", "STANDARD")), canon.untagged(prose, "en"), canon.outside_ontology(relations, ontology)])


_BOUND = """c AS (SELECT s_suppkey AS k, md5(s_name) AS digest, s_nationkey AS revision FROM supplier),
d AS (SELECT o_orderkey AS p, k AS on_, CASE WHEN o_orderkey % 5 = 0 THEN 'old' ELSE digest END AS digest, revision + CAST(o_orderkey % 7 = 0 AS INT) AS revision FROM orders JOIN c ON k = o_custkey % 120 WHERE o_orderkey % 11 > 0 UNION ALL SELECT o_orderkey, 0, '', 0 FROM orders WHERE o_orderkey % 13 = 0),
s AS (SELECT o_orderkey AS p, o_custkey % 120 AS k, count(d.p) AS n, max(d.on_) AS on_, max(d.digest) AS said, max(d.revision) AS rev FROM orders LEFT JOIN d ON d.p = o_orderkey GROUP BY o_orderkey, o_custkey % 120)"""


@query(
    "canon_bindings",
    f"""WITH {_BOUND}, j AS (SELECT s.*, c.digest, c.revision, n = 1 AND on_ = s.k AS bound FROM s LEFT JOIN c ON c.k = s.k)
    SELECT '/dependencies' AS pointer, CAST(p AS VARCHAR) AS key, 'unbound' AS finding FROM j WHERE NOT coalesce(bound, false) UNION ALL SELECT '/dependencies', CAST(p AS VARCHAR), 'digest' FROM j WHERE bound AND digest IS NOT NULL AND said IS DISTINCT FROM digest UNION ALL SELECT '/dependencies', CAST(p AS VARCHAR), 'revision' FROM j WHERE bound AND rev IS DISTINCT FROM revision""",
)
def canon_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as packages of suppliers' canonical ones: some have no dependency, some two, some an old digest or another revision."""
    orders = raw(spark, sf_dir, "orders").withColumn("k", F.col("o_custkey") % 120)
    canonical = raw(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("package_key"), F.md5("s_name").alias("digest"), F.col("s_nationkey").alias("revision"))
    first = orders.filter("o_orderkey % 11 > 0").join(canonical.withColumnRenamed("package_key", "k"), "k").selectExpr("o_orderkey AS package_key", "k AS depends_on", "IF(o_orderkey % 5 = 0, 'old', digest) AS digest", "revision + CAST(o_orderkey % 7 = 0 AS INT) AS revision")
    second = orders.filter("o_orderkey % 13 = 0").selectExpr("o_orderkey AS package_key", "CAST(0 AS BIGINT) AS depends_on", "'' AS digest", "0 AS revision")
    return canon.bindings(orders.selectExpr("o_orderkey AS package_key", "k AS canonical_key"), first.union(second), canonical)


_EXPECTED = "e AS (SELECT doc_id AS reference_key, doc_id % 200 AS entity_key, quality = 1 AS wanted FROM labels WHERE quality IS NOT NULL)"


@query(
    "canon_senses",
    f"""WITH {_EXPECTED}, h AS (SELECT DISTINCT reference_id AS reference_key, entity_id AS entity_key, kind FROM attestations)
    SELECT '/senses' AS pointer, reference_key || '>' || entity_key AS key, 'missing' AS finding FROM e WHERE wanted AND (reference_key, entity_key) NOT IN (SELECT (reference_key, entity_key) FROM h) UNION ALL SELECT '/senses', reference_key || '>' || entity_key, 'displaced' FROM e WHERE NOT wanted AND (reference_key, entity_key) IN (SELECT (reference_key, entity_key) FROM h)
    UNION ALL SELECT '/senses', reference_key || '>' || entity_key, 'quote' FROM (SELECT reference_key, entity_key, bool_or(kind = 'N') AS ok FROM h GROUP BY ALL) WHERE entity_key % 10 = 0 AND NOT ok""",
)
def canon_senses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spot checks of who is attested where, and of what mentions quote."""
    seen = bind.attestations(spark, sf_dir).selectExpr("reference_id AS reference_key", "entity_id AS entity_key", "kind AS quote")
    expected = raw(spark, sf_dir, "labels").filter("quality IS NOT NULL").selectExpr("doc_id AS reference_key", "doc_id % 200 AS entity_key", "quality = 1 AS wanted")
    quotes = seen.filter("entity_key % 10 = 0").select("reference_key", "entity_key", F.lit("N").alias("quote")).distinct()
    return canon.spot_checks(seen, expected, seen, quotes)


@query(
    "canon_records",
    """WITH r AS (SELECT 'claim:' || lower(p_brand) || '-' || (p_partkey % 700) AS key, p_type AS book, p_name AS content FROM part), c AS (SELECT source AS book, unnest([doc_id, doc_id + CAST(doc_id % 97 = 0 AS INT)][: 1 + CAST(doc_id % 97 = 0 AS INT)]) AS ref FROM documents WHERE doc_id % 89 > 0), n AS (SELECT book, ref, count(*) AS n FROM c GROUP BY ALL),
    b AS (SELECT coalesce(s.source, n.book) AS book, count(n.n) AS covered, count(s.doc_id) AS wanted, count(*) FILTER (n.n IS NULL OR s.doc_id IS NULL) AS apart FROM (SELECT source, doc_id FROM documents) s FULL JOIN n ON n.book = s.source AND n.ref = s.doc_id GROUP BY 1)
    SELECT DISTINCT '/records' AS pointer, key, 'invalid-key' AS finding FROM r WHERE NOT regexp_matches(key, '^claim:[a-z0-9-]+$') UNION ALL SELECT '/records', key, 'collision' FROM r GROUP BY key HAVING count(DISTINCT content) > 1
    UNION ALL SELECT '/coverage', book || '>' || ref, 'overlap' FROM n WHERE n > 1 UNION ALL SELECT '/coverage', book || ' ' || covered || '/' || wanted, 'partition' FROM b WHERE apart > 0""",
)
def canon_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record keys across books, and coverage as a partition of each book's scope."""
    records = raw(spark, sf_dir, "part").selectExpr("'claim:' || lower(p_brand) || '-' || (p_partkey % 700) AS key", "p_type AS book", "p_name AS content")
    docs = raw(spark, sf_dir, "documents")
    coverage = docs.filter("doc_id % 89 > 0").selectExpr("source AS book", "IF(doc_id % 97 = 0, array(doc_id, doc_id + 1), array(doc_id)) AS refs")
    return canon.collisions(records, "^claim:[a-z0-9-]+$").unionByName(canon.partition_findings(coverage, docs.selectExpr("source AS book", "doc_id AS ref")))


@query("components_without_paths", "SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 4 <> 1 AND (o_orderkey % 4 = 0 OR o_orderstatus = 'P')")
def components_without_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    components = raw(spark, sf_dir, "orders").selectExpr("o_custkey", "o_orderkey", "CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderstatus = 'P' AND o_orderkey % 4 <> 1 THEN CAST(array() AS array<string>) ELSE array('text') END AS paths")
    return checks.without_paths(components, "o_custkey", "o_orderkey", "paths")
