"""The domain's tables, made from the shared Parquet tables: in Spark, and as SQL for the oracle.

``SQL`` holds each table's definition over the raw tables and the tables defined before it;
``with_tables`` puts those that a query names before it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions.keys import slugify
from scholion.operators.ordinals import ordinal_within

ENTITY_TYPES = ("person", "place", "group", "event")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def verses(spark: SparkSession, sf_dir: str, *columns: Column) -> DataFrame:
    """(refsys, book, verse, doc_id) and the given columns of the documents (``text`` if none): documents numbered within language and source."""
    docs = raw(spark, sf_dir, "documents").select(F.col("lang").alias("refsys"), F.col("source").alias("book"), "doc_id", *(columns or ("text",)))
    return ordinal_within(docs, ["refsys", "book"], "doc_id", "verse").select("refsys", "book", "verse", *docs.columns[2:])


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(refsys, book, verse, doc_id, ordinal): the ordered address space of each reference system.

    An ordinal is the verse's number plus the verses of the books before it, so that only counts by
    book are windowed.
    """
    found = verses(spark, sf_dir, F.lit(True).alias("there")).drop("there")
    books = raw(spark, sf_dir, "documents").groupBy(F.col("lang").alias("refsys"), F.col("source").alias("book")).count()
    before = books.selectExpr("refsys", "book", "sum(count) OVER (PARTITION BY refsys ORDER BY book) - count AS before")
    return found.join(before, ["refsys", "book"]).select("refsys", "book", "verse", "doc_id", (F.col("before") + F.col("verse")).alias("ordinal"))


def scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(refsys, scope_key, kind, start_ordinal, end_ordinal): passages of ten units, and chapters (one for each book)."""
    found = units(spark, sf_dir)
    bounds = (F.min("ordinal").alias("start_ordinal"), F.max("ordinal").alias("end_ordinal"))
    passages = found.groupBy("refsys", F.expr("(ordinal - 1) div 10").alias("part")).agg(*bounds).select("refsys", F.concat_ws(":", "refsys", F.concat(F.lit("p"), "part")).alias("scope_key"), F.lit("passage").alias("kind"), "start_ordinal", "end_ordinal")
    chapters = found.groupBy("refsys", "book").agg(*bounds).select("refsys", F.concat_ws(":", "refsys", "book").alias("scope_key"), F.lit("chapter").alias("kind"), "start_ordinal", "end_ordinal")
    return passages.union(chapters)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = raw(spark, sf_dir, "part")
    kinds = F.array(*map(F.lit, ENTITY_TYPES))
    return part.select(F.col("p_partkey").alias("entity_id"), F.concat(F.lit("entity:"), slugify(F.col("p_name")), F.lit("-"), "p_partkey").alias("entity_key"), F.get(kinds, (F.col("p_partkey") % 4).cast("int")).alias("entity_type"), F.col("p_name").alias("name"), F.col("p_brand").alias("owner"))


def attestations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("reference_id"), F.col("l_partkey").alias("entity_id"), F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("basis"), F.col("l_linenumber").alias("line"))


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("subject_id"), F.col("l_suppkey").alias("object_id"), F.concat("l_returnflag", "l_linestatus").alias("predicate"), F.col("l_orderkey").alias("scope_id"))


def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = raw(spark, sf_dir, "nation"), raw(spark, sf_dir, "region")
    joined = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    key = F.concat(F.lit("pkg:"), F.lower("n_name"))
    return joined.select(
        F.col("n_nationkey").alias("package_id"),
        key.alias("package_key"),
        F.concat_ws("-", "r_name", (F.col("n_nationkey") % 2).cast("string")).alias("locale"),
        (F.col("n_nationkey") + 1).alias("revision"),
        F.expr("timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, n_nationkey)").alias("published_at"),
        (F.col("n_nationkey") % 7 != 3).alias("rights_cleared"),
        F.sha2(F.concat(key, F.lit("@"), (F.col("n_nationkey") + 1).cast("string")), 256).alias("digest"),
    )


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(package_id, locale, active): the highest revision of each locale is the active release."""
    found = packages(spark, sf_dir)
    top = found.groupBy("locale").agg(F.max("revision").alias("top"))
    return found.join(F.broadcast(top), "locale").select("package_id", "locale", (F.col("revision") == F.col("top")).alias("active"))


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = raw(spark, sf_dir, "orders").withColumn("package_id", (F.col("o_custkey") % 25).cast("int"))
    own = packages(spark, sf_dir).select("package_id", "digest")
    decision = F.when(F.col("o_orderstatus") == "P", "rejected").otherwise("approved")
    return orders.join(F.broadcast(own), "package_id").select(F.col("o_orderkey").alias("approval_id"), "package_id", decision.alias("decision"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderkey") % 5 == 0, "stale").otherwise(F.col("digest")).alias("subject_digest"))


def memberships(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = raw(spark, sf_dir, "supplier").select(F.lit("supplier").alias("row_kind"), F.col("s_suppkey").alias("row_id"), F.col("s_nationkey").alias("package_id"))
    part = raw(spark, sf_dir, "part").select(F.lit("entity"), "p_partkey", (F.col("p_partkey") % 25).cast("int"))
    doc = raw(spark, sf_dir, "documents").select(F.lit("verse"), "doc_id", (F.col("doc_id") % 25).cast("int"))
    return supplier.union(part).union(doc)


def op_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, k, seq, op, ts): adds and removes of bookmarks, in order of seq."""
    events = raw(spark, sf_dir, "events")
    op = F.when(F.col("event_type").isin("purchase", "click"), "add").when(F.col("event_type") == "error", "remove")
    return events.select("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_id").alias("seq"), op.alias("op"), "ts").filter("op IS NOT NULL")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, kind, text): headings are user turns, verses all others."""
    found = raw(spark, sf_dir, "conversations")
    return found.select("conv_id", "turn", F.when(F.col("role") == "user", "h").otherwise("v").alias("kind"), "text")


SQL = {
    "verses": "SELECT lang AS refsys, source AS book, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS verse, doc_id, text FROM documents",
    "units": "SELECT refsys, book, verse, doc_id, row_number() OVER (PARTITION BY refsys ORDER BY book, verse) AS ordinal FROM verses",
    "scopes": "SELECT refsys, refsys || ':p' || ((ordinal - 1) // 10) AS scope_key, 'passage' AS kind, min(ordinal) AS start_ordinal, max(ordinal) AS end_ordinal FROM units GROUP BY ALL UNION ALL SELECT refsys, refsys || ':' || book, 'chapter', min(ordinal), max(ordinal) FROM units GROUP BY refsys, book",
    "entities": "SELECT p_partkey AS entity_id, 'entity:' || regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') || '-' || p_partkey AS entity_key, CASE p_partkey % 4 WHEN 0 THEN 'person' WHEN 1 THEN 'place' WHEN 2 THEN 'group' ELSE 'event' END AS entity_type, p_name AS name, p_brand AS owner FROM part",
    "attestations": "SELECT l_orderkey AS reference_id, l_partkey AS entity_id, l_returnflag AS kind, l_linestatus AS basis, l_linenumber AS line FROM lineitem",
    "relationships": "SELECT l_partkey AS subject_id, l_suppkey AS object_id, l_returnflag || l_linestatus AS predicate, l_orderkey AS scope_id FROM lineitem",
    "packages": "SELECT n_nationkey AS package_id, 'pkg:' || lower(n_name) AS package_key, r_name || '-' || (n_nationkey % 2) AS locale, n_nationkey + 1 AS revision, TIMESTAMP '2024-01-01' + to_days(n_nationkey) AS published_at, n_nationkey % 7 <> 3 AS rights_cleared, sha256('pkg:' || lower(n_name) || '@' || (n_nationkey + 1)) AS digest FROM nation JOIN region ON n_regionkey = r_regionkey",
    "releases": "SELECT package_id, locale, revision = max(revision) OVER (PARTITION BY locale) AS active FROM packages",
    "approvals": "SELECT o_orderkey AS approval_id, package_id, CASE o_orderstatus WHEN 'P' THEN 'rejected' ELSE 'approved' END AS decision, o_orderdate AS created_at, CASE WHEN o_orderkey % 5 = 0 THEN 'stale' ELSE digest END AS subject_digest FROM orders JOIN packages ON o_custkey % 25 = package_id",
    "memberships": "SELECT 'supplier' AS row_kind, s_suppkey AS row_id, s_nationkey AS package_id FROM supplier UNION ALL SELECT 'entity', p_partkey, p_partkey % 25 FROM part UNION ALL SELECT 'verse', doc_id, doc_id % 25 FROM documents",
    "op_log": "SELECT * FROM (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id AS seq, CASE WHEN event_type IN ('purchase', 'click') THEN 'add' WHEN event_type = 'error' THEN 'remove' END AS op, ts FROM events) WHERE op IS NOT NULL",
    "turns": "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'h' ELSE 'v' END AS kind, text FROM conversations",
    "published": "SELECT p.package_id, p.locale FROM packages p JOIN releases r USING (package_id) JOIN (SELECT package_id, arg_max({'decision': decision, 'd': subject_digest}, (created_at, approval_id)) AS a FROM approvals GROUP BY package_id) l USING (package_id) WHERE r.active AND p.published_at <= TIMESTAMP '2024-02-01' AND p.rights_cleared AND a.decision = 'approved' AND a.d = p.digest",
}


def with_tables(sql: str) -> str:
    """The query with the domain tables that it names before it."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in SQL:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b|,\s*{name}\b", text):
                needed.add(name)
                visit(SQL[name])

    visit(sql)
    if not needed:
        return sql
    tables = ", ".join(f"{name} AS ({SQL[name]})" for name in SQL if name in needed)
    body = sql.strip()
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.upper().startswith(head):
            return f"{head}{tables}, {body[len(head):]}"
    return f"WITH {tables} {body}"
