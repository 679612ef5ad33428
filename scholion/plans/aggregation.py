"""Aggregations: counts, duplicates, value sets, token statistics, rollups and conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators import checks
from scholion.plans.registry import query
from scholion.sources import bind
from scholion.sources.bind import raw


@query("count_distinct_tuple", "SELECT kind, count(*) AS n, count(DISTINCT entity_id) AS n_entities, count(DISTINCT (reference_id, line)) AS n_places FROM attestations GROUP BY kind")
def count_distinct_tuple(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.attestations(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("entity_id").alias("n_entities"), F.countDistinct(F.struct("reference_id", "line")).alias("n_places"))


@query("keep_min_dupes", "SELECT reference_id, line, min(entity_id) AS kept, count(*) - 1 AS dropped FROM attestations GROUP BY reference_id, line HAVING count(*) > 1")
def keep_min_dupes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.attestations(spark, sf_dir).groupBy("reference_id", "line").agg(F.min("entity_id").alias("kept"), (F.count("*") - 1).alias("dropped")).filter("dropped > 0")


@query("shared_alias", "SELECT name, count(DISTINCT owner) AS owners FROM entities GROUP BY name HAVING count(DISTINCT owner) > 1")
def shared_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.entities(spark, sf_dir).groupBy("name").agg(F.countDistinct("owner").alias("owners")).filter("owners > 1")


@query("value_set_groups", "SELECT signature, count(*) AS n_refs, min(o_orderkey) AS first_ref, CASE WHEN signature = '' THEN 'complete_zero' ELSE 'complete_with_records' END AS result FROM (SELECT o_orderkey, coalesce(s.signature, '') AS signature FROM orders LEFT JOIN (SELECT reference_id, string_agg(DISTINCT kind || basis, ',' ORDER BY kind || basis) AS signature FROM attestations GROUP BY reference_id) s ON s.reference_id = o_orderkey) GROUP BY signature")
def value_set_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = bind.attestations(spark, sf_dir).groupBy("reference_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("kind", "basis"))), ",").alias("signature"))
    every = raw(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference_id")).join(sets, "reference_id", "left").withColumn("signature", F.coalesce("signature", F.lit("")))
    grouped = every.groupBy("signature").agg(F.count("*").alias("n_refs"), F.min("reference_id").alias("first_ref"))
    return grouped.withColumn("result", F.when(F.col("signature") == "", "complete_zero").otherwise("complete_with_records"))


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, token): the distinct words of each document, of small ASCII letters."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))
    return raw(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.explode(words).alias("token"))


_TOKENS = "tokens AS (SELECT doc_id, lang, source, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]+'))) AS token FROM documents)"


@query("token_df", f"WITH {_TOKENS} SELECT token, count(*) AS df FROM tokens WHERE length(token) >= 3 GROUP BY token")
def token_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tokens(spark, sf_dir).filter("length(token) >= 3").groupBy("token").agg(F.count("*").alias("df"))


@query(
    "token_lift_argmax",
    f"""WITH {_TOKENS},
    n AS (SELECT count(*) AS docs FROM documents), c AS (SELECT lang, count(*) AS docs FROM documents GROUP BY lang),
    d AS (SELECT token, count(*) AS df FROM tokens WHERE length(token) >= 3 GROUP BY token),
    h AS (SELECT lang, token, count(*) AS hits FROM tokens WHERE length(token) >= 3 GROUP BY ALL),
    s AS (SELECT h.lang, h.token, round(hits / c.docs, 6) AS coverage, round((hits / c.docs) / (df / n.docs), 6) AS lift FROM h JOIN c USING (lang) JOIN d USING (token), n WHERE c.docs >= 15 AND hits / c.docs >= 0.5 AND (hits / c.docs) / (df / n.docs) >= 8)
    SELECT lang, arg_max(token, {{'a': lift, 'b': coverage, 'c': length(token), 'd': token}}) AS token, max(lift) AS lift FROM s GROUP BY lang""",
)
def token_lift_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token that marks each language most."""
    tokens = _tokens(spark, sf_dir).filter("length(token) >= 3")
    return lift_argmax(tokens, raw(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs")), "lang")


def lift_argmax(tokens: DataFrame, sizes: DataFrame, entity: str, min_refs: int = 15, min_coverage: float = 0.5, min_lift: float = 8.0) -> DataFrame:
    """For each entity of enough references the token that marks it most: by lift, coverage, length, then the token itself. ``tokens`` has a row for each reference and distinct token, ``sizes`` the entity's references as ``docs``."""
    counted = tokens.groupBy(entity, "token").agg(F.count("*").alias("hits"))
    df = counted.groupBy("token").agg(F.sum("hits").alias("df"))
    total = sizes.agg(F.sum("docs").alias("total"))
    share = F.col("hits") / F.col("docs")
    often = counted.join(sizes, entity).filter((F.col("docs") >= min_refs) & (share >= min_coverage))
    lift = share / (F.col("df") / F.col("total"))
    scored = often.join(df, "token").join(F.broadcast(total)).filter(lift >= min_lift).select(entity, "token", F.round(share, 6).alias("coverage"), F.round(lift, 6).alias("lift"))
    return scored.groupBy(entity).agg(F.max_by("token", F.struct("lift", "coverage", F.length("token"), "token")).alias("token"), F.max("lift").alias("lift"))


@query("home_book_argmin", "SELECT e.entity_id, arg_min(u.book, {'a': u.ordinal, 'b': u.refsys}) AS home, count(*) AS n FROM attestations e JOIN units u ON u.doc_id = e.reference_id GROUP BY e.entity_id")
def home_book_argmin(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = bind.attestations(spark, sf_dir).join(bind.units(spark, sf_dir), F.col("reference_id") == F.col("doc_id"))
    return joined.groupBy("entity_id").agg(F.min_by("book", F.struct("ordinal", "refsys")).alias("home"), F.count("*").alias("n"))


@query("first_last_ref", "SELECT e.entity_id, min(u.ordinal) AS first_ordinal, max(u.ordinal) AS last_ordinal, arg_min(u.book || ':' || u.verse, {'a': u.ordinal, 'b': u.refsys}) AS first_label, arg_max(u.book || ':' || u.verse, {'a': u.ordinal, 'b': u.refsys}) AS last_label FROM attestations e JOIN units u ON u.doc_id = e.reference_id GROUP BY e.entity_id")
def first_last_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = bind.attestations(spark, sf_dir).join(bind.units(spark, sf_dir), F.col("reference_id") == F.col("doc_id"))
    label, order = F.concat_ws(":", "book", "verse"), F.struct("ordinal", "refsys")
    return joined.groupBy("entity_id").agg(F.min("ordinal").alias("first_ordinal"), F.max("ordinal").alias("last_ordinal"), F.min_by(label, order).alias("first_label"), F.max_by(label, order).alias("last_label"))


@query("status_counts", "SELECT package_id, count(*) FILTER (decision = 'approved') AS n_approved, count(*) FILTER (decision = 'rejected') AS n_rejected, count(*) FILTER (subject_digest = 'stale') AS n_stale FROM approvals GROUP BY package_id")
def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.approvals(spark, sf_dir).groupBy("package_id").agg(F.count_if(F.col("decision") == "approved").alias("n_approved"), F.count_if(F.col("decision") == "rejected").alias("n_rejected"), F.count_if(F.col("subject_digest") == "stale").alias("n_stale"))


@query("kind_hist", "SELECT kind, count(*) AS n FROM attestations GROUP BY kind")
def kind_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.attestations(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"))


@query("coverage_rollup", "SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n_docs, count(l.doc_id) AS n_labelled, CAST(coalesce(sum(l.quality), 0) AS BIGINT) AS n_good, count(DISTINCT d.doc_id) AS n_distinct FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ROLLUP (lang, source)")
def coverage_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = raw(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(raw(spark, sf_dir, "labels").withColumn("known", F.lit(1)), "doc_id", "left")
    out = joined.rollup("lang", "source").agg(F.count("*").alias("n_docs"), F.count("known").alias("n_labelled"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("n_good"), F.countDistinct("doc_id").alias("n_distinct"))
    return out.withColumns({x: F.coalesce(x, F.lit("*")) for x in ("lang", "source")})


@query("coverage_dominance", "SELECT source, lang, CASE WHEN bool_or(l.doc_id IS NOT NULL) THEN 'with_records' ELSE 'zero' END AS result, count(*) FILTER (l.doc_id IS NULL) AS n_zero FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def coverage_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = raw(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(raw(spark, sf_dir, "labels").select("doc_id", F.lit(True).alias("known")), "doc_id", "left")
    return joined.groupBy("source", "lang").agg(F.when(F.bool_or(F.col("known").isNotNull()), "with_records").otherwise("zero").alias("result"), F.count_if(F.col("known").isNull()).alias("n_zero"))


@query("cross_book_totals", "SELECT count(*) AS n_entities, CAST(sum(n) AS BIGINT) AS n_attested, count(*) FILTER (books > 1) AS in_several FROM (SELECT e.entity_id, count(*) AS n, count(DISTINCT u.book) AS books FROM attestations e JOIN units u ON u.doc_id = e.reference_id GROUP BY e.entity_id)")
def cross_book_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = bind.attestations(spark, sf_dir).join(bind.units(spark, sf_dir), F.col("reference_id") == F.col("doc_id"))
    each = joined.groupBy("entity_id").agg(F.count("*").alias("n"), F.countDistinct("book").alias("books"))
    return each.agg(F.count("*").alias("n_entities"), F.sum("n").alias("n_attested"), F.count_if(F.col("books") > 1).alias("in_several"))


@query("conflicting_defs", "SELECT reference_id, line, count(DISTINCT (entity_id, kind, basis)) AS definitions FROM attestations GROUP BY reference_id, line HAVING count(DISTINCT (entity_id, kind, basis)) > 1")
def conflicting_defs(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.sha2(F.to_json(F.struct("basis", "entity_id", "kind")), 256)
    return bind.attestations(spark, sf_dir).groupBy("reference_id", "line").agg(F.countDistinct(content).alias("definitions")).filter("definitions > 1")


@query("label_clusters", "SELECT name, string_agg(entity_key, ',' ORDER BY entity_key) AS candidates FROM entities WHERE entity_type = 'group' GROUP BY name, owner HAVING count(*) > 1")
def label_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bind.entities(spark, sf_dir).filter("entity_type = 'group'").groupBy("name", "owner").agg(F.array_sort(F.collect_list("entity_key")).alias("keys"))
    return found.filter("size(keys) > 1").select("name", F.array_join("keys", ",").alias("candidates"))


@query("books_per_candidate", "SELECT e.entity_id, string_agg(DISTINCT u.book, ',' ORDER BY u.book) AS books FROM attestations e JOIN units u ON u.doc_id = e.reference_id WHERE e.kind = 'R' GROUP BY e.entity_id")
def books_per_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = bind.attestations(spark, sf_dir).filter("kind = 'R'").join(bind.units(spark, sf_dir), F.col("reference_id") == F.col("doc_id"))
    return joined.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set("book")), ",").alias("books"))


@query("kind_consistency", "SELECT e.entity_key, e.entity_type, string_agg(DISTINCT a.kind, ',' ORDER BY a.kind) AS kinds FROM entities e JOIN attestations a USING (entity_id) GROUP BY ALL HAVING NOT bool_or(a.kind = 'N')")
def kind_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = bind.attestations(spark, sf_dir).groupBy("entity_id").agg(F.array_sort(F.collect_set("kind")).alias("kinds")).filter(~F.array_contains("kinds", "N"))
    return kinds.join(bind.entities(spark, sf_dir), "entity_id").select("entity_key", "entity_type", F.array_join("kinds", ",").alias("kinds"))


@query("license_isolation", "SELECT release, count(*) AS components, count(DISTINCT paths) AS path_sets FROM (SELECT p_brand || '/' || p_type AS release, CASE WHEN p_partkey % 31 = 0 THEN p_name ELSE p_type END AS evidence, p_size // 10 AS paths FROM part) GROUP BY release HAVING count(*) > 1 AND count(DISTINCT evidence) = 1 AND count(DISTINCT paths) > 1")
def license_isolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases whose components share one licence evidence though they cover different paths."""
    components = raw(spark, sf_dir, "part").selectExpr("concat(p_brand, '/', p_type) AS release", "IF(p_partkey % 31 = 0, p_name, p_type) AS evidence", "p_size div 10 AS paths")
    return checks.mixed_licences(components, "release", "evidence", "paths")


@query("receipt_counts", "SELECT count(*) AS planned, count(l.doc_id) AS existing, count(*) - count(l.doc_id) AS inserted, count(*) FILTER (l.quality = 0) AS rejected FROM documents d LEFT JOIN labels l USING (doc_id)")
def receipt_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = raw(spark, sf_dir, "documents").select("doc_id").join(raw(spark, sf_dir, "labels").withColumn("known", F.lit(1)), "doc_id", "left")
    return joined.agg(F.count("*").alias("planned"), F.count("known").alias("existing"), (F.count("*") - F.count("known")).alias("inserted"), F.count_if(F.col("quality") == 0).alias("rejected"))


@query("package_totals", "SELECT source, count(*) AS files, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM documents GROUP BY source")
def package_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"))


@query("parity_compare", "SELECT coalesce(a.source, b.source) AS source, coalesce(a.n, 0) AS n_en, coalesce(b.n, 0) AS n_fr FROM (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1) a FULL JOIN (SELECT source, count(*) AS n FROM documents WHERE lang = 'fr' GROUP BY 1) b USING (source) WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)")
def parity_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = raw(spark, sf_dir, "documents").groupBy("source").agg(F.count_if(F.col("lang") == "en").alias("n_en"), F.count_if(F.col("lang") == "fr").alias("n_fr"))
    return counted.filter("n_en <> n_fr")
