"""Authorization, rights, digests and dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions import digest
from scholion.operators.gate import authorize
from scholion.plans.registry import query
from scholion.sources.bind import raw


@query("sha_digest", "SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents")
def sha_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").select("doc_id", digest.digest(F.col("text")).alias("digest"))


_JSON = """'{"doc_id":' || doc_id || ',"lang":"' || lang || '","n_chars":' || n_chars || ',"quality":' || coalesce(CAST(quality AS VARCHAR), 'null') || ',"source":"' || source || '"}'"""


@query("canonical_json", f"SELECT doc_id, {_JSON} AS json FROM documents LEFT JOIN labels USING (doc_id)")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = raw(spark, sf_dir, "documents").drop("text").join(raw(spark, sf_dir, "labels"), "doc_id", "left")
    return joined.select("doc_id", digest.canonical_json(["source", "lang", "doc_id", "quality", "n_chars"]).alias("json"))


@query("content_digest", f"SELECT doc_id, 'sha256:' || sha256({_JSON}) AS digest FROM documents LEFT JOIN labels USING (doc_id)")
def content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = raw(spark, sf_dir, "documents").drop("text").join(raw(spark, sf_dir, "labels"), "doc_id", "left").withColumn("revision", F.lit(3))
    return joined.select("doc_id", digest.content_digest(["source", "lang", "doc_id", "quality", "n_chars", "revision"]).alias("digest"))


@query("uuid5", "SELECT p_partkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST('0x' || substr(h, 17, 1) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM (SELECT p_partkey, sha1(from_hex('6ba7b8119dad11d180b400c04fd430c8') || encode(p_name || '#' || p_partkey)) AS h FROM part)")
def uuid5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "part").select("p_partkey", digest.uuid5(F.concat_ws("#", "p_name", "p_partkey")).alias("id"))


_DATES = "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '2023-02-' || (o_orderkey % 40 + 10) WHEN 2 THEN 'someday' ELSE '2024-2-3' END AS key FROM orders"


@query("date_key_valid", f"SELECT o_orderkey, key, regexp_matches(key, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$') AND TRY_CAST(key AS DATE) IS NOT NULL AS valid FROM ({_DATES})")
def date_key_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.expr("CASE o_orderkey % 4 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN '2023-02-' || (o_orderkey % 40 + 10) WHEN 2 THEN 'someday' ELSE '2024-2-3' END")
    return raw(spark, sf_dir, "orders").select("o_orderkey", key.alias("key")).select("o_orderkey", "key", digest.date_key_valid(F.col("key")).alias("valid"))


@query("grant_validity", "SELECT o_orderkey, (s IS NULL OR s <= d) AND (e IS NULL OR d <= e) AS valid FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE WHEN o_custkey % 3 > 0 THEN DATE '1997-01-01' END AS s, CASE WHEN o_custkey % 2 > 0 THEN DATE '1999-06-30' END AS e FROM orders)")
def grant_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = F.expr("IF(o_custkey % 3 > 0, DATE '1997-01-01', NULL)"), F.expr("IF(o_custkey % 2 > 0, DATE '1999-06-30', NULL)")
    return raw(spark, sf_dir, "orders").select("o_orderkey", digest.valid_on(F.to_date("o_orderdate"), start, end).alias("valid"))


@query("greeting_hours", "SELECT event_id, CASE WHEN h >= 5 AND h < 12 THEN 'morning' WHEN h >= 12 AND h < 17 THEN 'afternoon' WHEN h >= 17 AND h < 21 THEN 'evening' ELSE 'night' END AS greeting FROM (SELECT event_id, hour(ts) AS h FROM events)")
def greeting_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "events").select("event_id", digest.greeting(F.hour("ts")).alias("greeting"))


@query("clamped_prefs", "SELECT p_partkey, CASE WHEN p_size BETWEEN 5 AND 30 THEN p_size ELSE 8 END AS hour FROM part")
def clamped_prefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "part").select("p_partkey", digest.clamped(F.col("p_size"), 5, 30, 8).alias("hour"))


@query("rights_matrix", "SELECT d.doc_id, coalesce(r.display, false) AS display, coalesce(r.search, false) AS search FROM documents d LEFT JOIN (VALUES ('en', true, true), ('fr', true, false), ('de', false, true)) r(lang, display, search) USING (lang)")
def rights_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What isn't listed is denied."""
    rights = spark.createDataFrame([("en", True, True), ("fr", True, False), ("de", False, True)], "lang string, display boolean, search boolean")
    joined = raw(spark, sf_dir, "documents").select("doc_id", "lang").join(F.broadcast(rights), "lang", "left")
    return joined.select("doc_id", *(F.coalesce(x, F.lit(False)).alias(x) for x in ("display", "search")))


@query("authorize_requests", """SELECT q.request_id, CASE WHEN k >= 25 OR k % 9 = 4 THEN 'invalid-release' WHEN k % 11 = 7 THEN 'digest-not-bound' WHEN k % 5 = 1 OR component = 2 THEN 'no-grant' WHEN k % 5 = 2 AND component = 0 THEN 'grant-denied'
      WHEN d < DATE '1996-01-01' OR k % 2 = 1 AND d > DATE '2000-12-31' THEN 'grant-expired' WHEN k % 5 = 3 AND territory IS DISTINCT FROM 'IN' THEN 'territory-mismatch' WHEN k % 3 = 2 AND component = 1 AND language IS DISTINCT FROM 'ta' THEN 'language-mismatch' WHEN k % 7 = 6 THEN 'no-approval' WHEN k % 7 = 5 THEN 'digest-not-bound' END AS denial FROM
    (SELECT o_orderkey AS request_id, o_custkey % 30 AS k, o_orderkey % 3 AS component, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'US' END AS territory, CASE o_custkey % 2 WHEN 0 THEN 'ta' END AS language FROM orders) q""")
def authorize_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = raw(spark, sf_dir, "nation").selectExpr("n_nationkey AS k", "concat('rel:', n_nationkey) AS release_key", "concat('sha256:', sha2(n_name, 256)) AS digest")
    releases = nation.selectExpr("release_key", "IF(k % 9 = 4, 'invalid', 'verified') AS status", "IF(k % 11 = 7, 'none', digest) AS artifact_digest", "digest AS evidence_digest")
    both = nation.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("c")).withColumn("component_key", F.concat(F.lit("part:"), "c"))
    grants = both.filter("k % 5 <> 1").selectExpr("release_key", "component_key", "'display' AS operation", "IF(k % 5 = 2 AND c = 0, 'denied', 'allowed') AS state", "IF(k % 5 = 3, 'IN', NULL) AS territory", "IF(k % 3 = 2 AND c = 1, 'ta', NULL) AS language", "DATE '1996-01-01' AS effective_from", "IF(k % 2 = 1, DATE '2000-12-31', NULL) AS effective_to")
    approvals = both.selectExpr("release_key", "component_key", "IF(k % 7 = 6, 'rejected', 'approved') AS decision", "IF(k % 7 = 5, 'unbound', digest) AS digest", "TIMESTAMP '2024-01-02' AS created_at")
    approvals = approvals.unionByName(approvals.withColumns({"decision": F.lit("approved"), "created_at": F.expr("TIMESTAMP '2024-01-01'")}))
    requests = raw(spark, sf_dir, "orders").selectExpr("o_orderkey AS request_id", "concat('rel:', o_custkey % 30) AS release_key", "concat('part:', o_orderkey % 3) AS component_key", "'display' AS operation", "CASE o_orderkey % 4 WHEN 0 THEN 'IN' WHEN 1 THEN 'US' END AS territory", "IF(o_custkey % 2 = 0, 'ta', NULL) AS language", "CAST(o_orderdate AS DATE) AS day")
    return authorize(requests, releases, grants, approvals).select("request_id", "denial")
