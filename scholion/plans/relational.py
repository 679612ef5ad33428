"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators.joins import both_ways, either_semi, tuple_in, with_fallback
from scholion.plans.registry import query
from scholion.plans.spine import published
from scholion.sources import bind
from scholion.sources.bind import raw


@query("orphans_left", "SELECT l.doc_id, l.quality FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id + 1 WHERE d.doc_id IS NULL")
def orphans_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, docs = raw(spark, sf_dir, "labels"), raw(spark, sf_dir, "documents").select((F.col("doc_id") - 1).alias("doc_id"))
    return labels.join(docs, "doc_id", "left_anti").select("doc_id", "quality")


@query("exists_semi", "SELECT e.entity_key FROM entities e WHERE EXISTS (SELECT 1 FROM attestations a WHERE a.entity_id = e.entity_id AND a.kind = 'R' AND a.basis = 'O')")
def exists_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.entities(spark, sf_dir).join(bind.attestations(spark, sf_dir).filter("kind = 'R' AND basis = 'O'"), "entity_id", "left_semi").select("entity_key")


@query("not_exists_anti", "SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def not_exists_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").select("doc_id").join(raw(spark, sf_dir, "labels"), "doc_id", "left_anti")


@query("tuple_in", "SELECT DISTINCT reference_id, entity_id, kind FROM attestations WHERE (entity_id, kind) IN (SELECT subject_id, substr(predicate, 1, 1) FROM relationships WHERE predicate IN ('AO', 'RF'))")
def tuple_in_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = bind.relationships(spark, sf_dir).filter("predicate IN ('AO', 'RF')").select(F.col("subject_id").alias("entity_id"), F.substring("predicate", 1, 1).alias("kind"))
    return tuple_in(bind.attestations(spark, sf_dir), ["entity_id", "kind"], allowed).select("reference_id", "entity_id", "kind").distinct()


@query("array_contains_join", "SELECT a.o_custkey, e.entity_key FROM (SELECT o_custkey, unnest(list(o_orderkey % 1000 ORDER BY o_orderkey)) AS claim FROM orders GROUP BY o_custkey) a JOIN entities e ON e.entity_id = a.claim")
def array_contains_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = raw(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.col("o_orderkey") % 1000).alias("claims"))
    exploded = claims.select("o_custkey", F.explode("claims").alias("entity_id"))
    return exploded.join(bind.entities(spark, sf_dir), "entity_id").select("o_custkey", "entity_key")


@query("or_semi", "SELECT subject_id, object_id, predicate, count(*) AS n FROM relationships WHERE subject_id IN (SELECT entity_id FROM entities WHERE name = 'red widget') OR object_id IN (SELECT entity_id FROM entities WHERE name = 'red widget') GROUP BY ALL")
def or_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = bind.entities(spark, sf_dir).filter("name = 'red widget'").select("entity_id")
    return either_semi(bind.relationships(spark, sf_dir), ["subject_id", "object_id"], ids).groupBy("subject_id", "object_id", "predicate").agg(F.count(F.lit(1)).alias("n"))


@query("self_join_roles", "SELECT s.entity_key AS subject_key, r.predicate, o.entity_key AS object_key, count(*) AS n FROM relationships r JOIN entities s ON s.entity_id = r.subject_id JOIN entities o ON o.entity_id = r.object_id WHERE s.entity_type = 'person' AND o.entity_type = 'place' GROUP BY ALL")
def self_join_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = bind.entities(spark, sf_dir)
    subject = known.filter("entity_type = 'person'").select(F.col("entity_id").alias("subject_id"), F.col("entity_key").alias("subject_key"))
    target = known.filter("entity_type = 'place'").select(F.col("entity_id").alias("object_id"), F.col("entity_key").alias("object_key"))
    # edges are counted before names join them
    edges = bind.relationships(spark, sf_dir).groupBy("subject_id", "predicate", "object_id").agg(F.count(F.lit(1)).alias("n"))
    return edges.join(subject, "subject_id").join(target, "object_id").select("subject_key", "predicate", "object_key", "n")


@query("coalesce_lookup", "SELECT d.doc_id, coalesce(e.entity_key, u.refsys || ':' || u.book) AS key FROM documents d LEFT JOIN entities e ON e.entity_id = d.doc_id * 3 LEFT JOIN units u ON u.doc_id = d.doc_id")
def coalesce_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") * 3).alias("entity_id"))
    units = bind.units(spark, sf_dir).select("doc_id", F.concat_ws(":", "refsys", "book").alias("unit_key"))
    return docs.join(bind.entities(spark, sf_dir), "entity_id", "left").join(units, "doc_id", "left").select("doc_id", F.coalesce("entity_key", "unit_key").alias("key"))


@query("values_join", "SELECT v.tag, e.entity_type, count(DISTINCT e.entity_id) AS n FROM (VALUES ('bolt', 'fastener'), ('nut', 'fastener'), ('ring', 'seal')) v(word, tag) JOIN entities e ON split_part(e.name, ' ', 2) = v.word GROUP BY ALL")
def values_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tags = spark.createDataFrame([("bolt", "fastener"), ("nut", "fastener"), ("ring", "seal")], "word string, tag string")
    named = bind.entities(spark, sf_dir).withColumn("word", F.split_part("name", F.lit(" "), F.lit(2)))
    return named.join(F.broadcast(tags), "word").groupBy("tag", "entity_type").agg(F.countDistinct("entity_id").alias("n"))


@query("substring_theta", "SELECT n.n_name, p.name, count(*) AS n FROM (SELECT n_name, lower(right(n_name, 2)) AS w FROM nation) n JOIN (SELECT name, owner FROM entities) p ON contains(lower(p.owner), n.w) GROUP BY ALL")
def substring_theta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels contained in names: distinct names are few, and meet a handful of labels, which are broadcast."""
    labels = raw(spark, sf_dir, "nation").select("n_name", F.lower(F.right("n_name", F.lit(2))).alias("w"))
    names = bind.entities(spark, sf_dir).groupBy("name", "owner").agg(F.count(F.lit(1)).alias("n"))
    return names.join(F.broadcast(labels), F.expr("contains(lower(owner), w)")).groupBy("n_name", "name").agg(F.sum("n").alias("n"))


@query("outline_interval", "SELECT t.conv_id, string_agg(DISTINCT o.label, '; ' ORDER BY o.label) AS labels FROM turns t JOIN (VALUES (0, 2, 'opening'), (1, 4, 'middle'), (4, 99, 'closing')) o(a, b, label) ON t.turn BETWEEN o.a AND o.b GROUP BY t.conv_id")
def outline_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    outline = spark.createDataFrame([(0, 2, "opening"), (1, 4, "middle"), (4, 99, "closing")], "a int, b int, label string")
    joined = bind.turns(spark, sf_dir).join(F.broadcast(outline), F.expr("turn BETWEEN a AND b"))
    return joined.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("label")), "; ").alias("labels"))


@query("union_ids", "SELECT entity_id FROM attestations WHERE kind = 'A' UNION SELECT subject_id FROM relationships WHERE predicate = 'NO' UNION SELECT object_id FROM relationships WHERE predicate = 'RF'")
def union_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = bind.relationships(spark, sf_dir)
    sources = (bind.attestations(spark, sf_dir).filter("kind = 'A'").select("entity_id"), edges.filter("predicate = 'NO'").select("subject_id"), edges.filter("predicate = 'RF'").select("object_id"))
    return sources[0].union(sources[1]).union(sources[2]).distinct()


@query("set_diff_both", "SELECT doc_id, 'missing' AS side FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id * 2 FROM labels) UNION ALL SELECT doc_id, 'extra' FROM (SELECT doc_id * 2 AS doc_id FROM labels EXCEPT SELECT doc_id FROM documents)")
def set_diff_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both_ways(raw(spark, sf_dir, "labels").select((F.col("doc_id") * 2).alias("doc_id")), raw(spark, sf_dir, "documents").select("doc_id"), ["doc_id"])


@query("set_intersect", "SELECT doc_id * 2 AS doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM documents")
def set_intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "labels").filter("toxic = 1").select((F.col("doc_id") * 2).alias("doc_id")).intersect(raw(spark, sf_dir, "documents").select("doc_id"))


@query("fallback_union", "SELECT doc_id, quality, 'labels' AS origin FROM labels UNION ALL SELECT doc_id, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END, 'length' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def fallback_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = raw(spark, sf_dir, "labels").select("doc_id", "quality", F.lit("labels").alias("origin"))
    second = raw(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") > 500).cast("int").alias("quality"), F.lit("length").alias("origin"))
    return with_fallback(first, second, ["doc_id"])


@query("membership_gate", "SELECT DISTINCT e.entity_key, m.package_id FROM entities e JOIN memberships m ON m.row_id = e.entity_id AND m.row_kind = 'entity' JOIN packages k ON k.package_id = m.package_id WHERE k.rights_cleared")
def membership_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    member = bind.memberships(spark, sf_dir).filter("row_kind = 'entity'")
    cleared = bind.packages(spark, sf_dir).filter("rights_cleared").select("package_id")
    return member.join(F.broadcast(cleared), "package_id").join(bind.entities(spark, sf_dir), F.col("row_id") == F.col("entity_id")).select("entity_key", "package_id").distinct()


@query("multiway_inner", "SELECT r.r_name, n.n_name, count(*) AS n_orders FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY ALL")
def multiway_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = raw(spark, sf_dir, "nation").join(raw(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    customers = raw(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    counted = raw(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).count()
    by_nation = counted.join(customers, "c_custkey").groupBy("c_nationkey").agg(F.sum("count").alias("n_orders"))
    return by_nation.join(F.broadcast(names), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "n_name").agg(F.sum("n_orders").alias("n_orders"))


@query("retained_edges", "SELECT DISTINCT r.subject_id, r.object_id FROM relationships r WHERE r.subject_id <> r.object_id AND r.subject_id IN (SELECT row_id FROM memberships m JOIN published p ON p.package_id = m.package_id WHERE row_kind = 'entity') AND r.object_id IN (SELECT entity_id FROM entities WHERE entity_type <> 'event')")
def retained_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholion.operators.gate import published_rows

    keep = published_rows(bind.memberships(spark, sf_dir), published(spark, sf_dir), "entity")
    targets = bind.entities(spark, sf_dir).filter("entity_type <> 'event'").select("entity_id")
    edges = bind.relationships(spark, sf_dir).filter("subject_id <> object_id").select("subject_id", "object_id").distinct()
    return edges.join(keep, F.col("subject_id") == F.col("row_id"), "left_semi").join(targets, F.col("object_id") == F.col("entity_id"), "left_semi")


@query("name_collisions", "SELECT p.entity_key AS person_key, q.entity_key AS place_key FROM (SELECT DISTINCT e.entity_key, lower(e.name) AS n, a.reference_id FROM entities e JOIN attestations a USING (entity_id) WHERE entity_type = 'person') p JOIN (SELECT DISTINCT e.entity_key, lower(e.name) AS n, a.reference_id FROM entities e JOIN attestations a USING (entity_id) WHERE entity_type = 'place') q USING (n, reference_id)")
def name_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = bind.attestations(spark, sf_dir).select("entity_id", "reference_id").distinct().join(bind.entities(spark, sf_dir), "entity_id")

    def of(kind: str, name: str) -> DataFrame:
        return seen.filter(F.col("entity_type") == kind).select(F.col("entity_key").alias(name), F.lower("name").alias("n"), "reference_id")

    return of("person", "person_key").join(of("place", "place_key"), ["n", "reference_id"]).select("person_key", "place_key")


@query("identity_bridge", "SELECT coalesce(b.new_id, e.entity_id) AS entity_id, count(*) AS n FROM attestations e LEFT JOIN (SELECT entity_id AS old_id, min(entity_id) OVER (PARTITION BY name, owner) AS new_id FROM entities) b ON b.old_id = e.entity_id GROUP BY ALL")
def identity_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = bind.entities(spark, sf_dir)
    least = known.groupBy("name", "owner").agg(F.min("entity_id").alias("new_id"))
    bridge = known.join(least, ["name", "owner"]).select("entity_id", "new_id")
    counted = bind.attestations(spark, sf_dir).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(bridge, "entity_id", "left").groupBy(F.coalesce("new_id", "entity_id").alias("entity_id")).agg(F.sum("n").alias("n"))
