"""Batteries over packages, jobs, chapters, bundles, submissions and the canon, and merges of packages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators import packages
from scholion.plans.registry import query
from scholion.sources import bind
from scholion.sources.bind import raw


def _anti(pointer: str, finding: str, keys: str, authority: str) -> str:
    return f"SELECT DISTINCT '{pointer}' AS pointer, CAST(k AS VARCHAR) AS key, '{finding}' AS finding FROM ({keys}) WHERE k IS NOT NULL AND k NOT IN ({authority})"


def _twice(pointer: str, keys: str) -> str:
    return f"SELECT '{pointer}' AS pointer, CAST(k AS VARCHAR) AS key, 'duplicate' AS finding FROM ({keys}) GROUP BY k HAVING count(*) > 1"


# what the jobs approve, and their snapshots
_ENTITY, _CLAIM, _EVIDENCE, _SCOPE, _REFERENCE = "SELECT p_partkey FROM part WHERE p_partkey % 7 <> 0", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0", "SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 <> 0", "SELECT doc_id FROM documents", "SELECT doc_id FROM documents WHERE n_chars > 500"
_COVERAGE = "SELECT doc_id AS g, CASE doc_id % 4 WHEN 0 THEN 'complete_zero' WHEN 1 THEN 'blocked' ELSE 'complete_with_records' END AS result, [doc_id, doc_id + CAST(doc_id % 13 = 0 AS INT)] AS refs, CASE WHEN quality = 1 THEN [doc_id * 3] ELSE [] END AS records, CASE WHEN toxic = 1 THEN [doc_id] ELSE [] END AS questions, CASE WHEN doc_id % 29 = 0 THEN 'other' ELSE '{cls}' END AS cls FROM labels"


def _coverage_sql(cls: str, records: str, questions: str, covered: str = _REFERENCE) -> str:
    own = f"(SELECT * FROM ({_COVERAGE.format(cls=cls)}) WHERE cls <> 'other')"
    refs = f"SELECT unnest(list_distinct(refs)) AS k FROM {own}"
    every = f"SELECT unnest(refs) AS k FROM {own}"
    return f"""SELECT '/coverage', CAST(g AS VARCHAR), 'wrong-class' FROM ({_COVERAGE.format(cls=cls)}) WHERE cls = 'other'
    UNION ALL SELECT '/coverage', CAST(k AS VARCHAR), 'overlap' FROM ({every}) GROUP BY k HAVING count(*) > 1
    UNION ALL SELECT '/coverage', CAST(g AS VARCHAR), 'contradictory-zero' FROM {own} WHERE result = 'complete_zero' AND len(records) > 0
    UNION ALL SELECT '/coverage', CAST(g AS VARCHAR), 'missing-records' FROM {own} WHERE result = 'complete_with_records' AND len(records) = 0
    UNION ALL SELECT '/coverage', CAST(g AS VARCHAR), 'blocked-without-question' FROM {own} WHERE result = 'blocked' AND len(questions) = 0
    UNION ALL {_anti('/coverage', 'undefined-record', f'SELECT unnest(records) AS k FROM {own}', records)}
    UNION ALL {_anti('/coverage', 'undefined-question', f'SELECT unnest(questions) AS k FROM {own}', questions)}
    UNION ALL {_anti('/coverage', 'outside', refs, covered)}
    UNION ALL {_anti('/coverage', 'gap', covered.replace('doc_id', 'doc_id AS k', 1), refs)}"""


def _coverage(spark: SparkSession, sf_dir: str, layer: str) -> DataFrame:
    none = "CAST(array() AS array<bigint>)"
    return raw(spark, sf_dir, "labels").selectExpr(
        "doc_id AS group_id", "CASE doc_id % 4 WHEN 0 THEN 'complete_zero' WHEN 1 THEN 'blocked' ELSE 'complete_with_records' END AS result", "array(doc_id, doc_id + CAST(doc_id % 13 = 0 AS INT)) AS refs",
        f"IF(quality = 1, array(doc_id * 3), {none}) AS record_keys", f"IF(toxic = 1, array(doc_id), {none}) AS question_keys", f"IF(doc_id % 29 = 0, 'other', '{packages.CLASSES[layer]}') AS annotation_class",
    )


def _job(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    docs = raw(spark, sf_dir, "documents")
    return {
        "entity": raw(spark, sf_dir, "part").filter("p_partkey % 7 <> 0").select("p_partkey"),
        "claim": raw(spark, sf_dir, "orders").filter("o_orderkey % 3 <> 0").select("o_orderkey"),
        "evidence": raw(spark, sf_dir, "supplier").filter("s_suppkey % 10 <> 0").select("s_suppkey"),
        "scope": docs.select("doc_id"),
        "reference": docs.filter("n_chars > 500").select("doc_id"),
    }


_LINES = "SELECT l_orderkey * 10 + l_linenumber AS k, * FROM lineitem"
# claims are of every second order; candidates 0 to 99 are reconciled with entities, a few with candidates that aren't there or with none
_OWN_CLAIM = "SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0"
_CANDIDATES = "SELECT p_partkey % 1900 AS k FROM part"
_RECONCILED = "SELECT CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_partkey END AS candidate, p_partkey * 7 AS entity FROM part WHERE p_partkey < 100 OR p_partkey >= 1950"
_TRUSTED = f"SELECT entity FROM ({_RECONCILED}) WHERE candidate IS NULL OR candidate IN (SELECT k FROM ({_CANDIDATES}))"
_RECORDS = f"SELECT k FROM ({_CANDIDATES}) UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 UNION SELECT k FROM ({_LINES}) UNION SELECT o_orderkey FROM orders"


def _canonical_sql(entities: str, claims: str, evidence: str, closed: bool = False) -> str:
    snapshots = "" if closed else f"UNION ALL {_anti('/relevance/scope_key', 'outside-authority', 'SELECT o_orderkey AS k FROM orders', _SCOPE)} UNION ALL {_anti('/scope/canon_key', 'outside-snapshot', 'SELECT r_name AS k FROM region', 'SELECT r_name FROM region WHERE r_regionkey > 0')}"
    return f"""{_twice('/candidates', _CANDIDATES)} UNION ALL {_twice('/claims', 'SELECT o_orderkey AS k FROM orders WHERE o_orderkey % 2 = 0')} UNION ALL {_twice('/attestations', f'SELECT k FROM ({_LINES})')}
    UNION ALL {_anti('/reconciliations/candidate_key', 'unknown-candidate', f'SELECT candidate AS k FROM ({_RECONCILED})', _CANDIDATES)}
    UNION ALL {_anti('/claims/subject_key', 'unresolved-entity', 'SELECT o_custkey AS k FROM orders WHERE o_orderkey % 2 = 0', entities)} UNION ALL {_anti('/claims/citation_keys', 'undefined-citation', 'SELECT unnest([o_orderkey * 10 + 1, o_orderkey * 10 + 2]) AS k FROM orders WHERE o_orderkey % 2 = 0', f'SELECT k FROM ({_LINES})')}
    UNION ALL {_anti('/citations/claim_keys', 'undefined-claim', 'SELECT l_orderkey + 1 AS k FROM lineitem', claims)} UNION ALL {_anti('/citations/evidence_key', 'undefined-evidence', 'SELECT l_suppkey AS k FROM lineitem', evidence)} UNION ALL {_twice('/citations', f'SELECT k FROM ({_LINES})')}
    UNION ALL {_anti('/attestations/entity_key', 'unresolved-entity', 'SELECT l_partkey AS k FROM lineitem', entities)} {snapshots} UNION ALL {_twice('/relevance', 'SELECT o_orderkey AS k FROM orders')}
    UNION ALL {_anti('/questions/record_key', 'unknown-record', 'SELECT doc_id * 3 AS k FROM labels', f'{_RECORDS} UNION SELECT doc_id // 2 FROM labels')} UNION ALL {_twice('/questions', 'SELECT doc_id // 2 AS k FROM labels')}"""


def _canonical(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part, orders, lines, labels = (raw(spark, sf_dir, x) for x in ("part", "orders", "lineitem", "labels"))
    return {
        "scope": raw(spark, sf_dir, "region").selectExpr("r_name AS canon_key", "r_name AS reference_system_key"),
        "candidates": part.selectExpr("p_partkey % 1900 AS candidate_key"),
        "reconciliations": part.filter("p_partkey < 100 OR p_partkey >= 1950").selectExpr("IF(p_partkey % 9 = 0, NULL, p_partkey) AS candidate_key", "p_partkey * 7 AS entity_key"),
        "claims": orders.filter("o_orderkey % 2 = 0").selectExpr("o_orderkey AS claim_key", "o_custkey AS subject_key", "array(o_orderkey * 10 + 1, o_orderkey * 10 + 2) AS citation_keys"),
        "citations": lines.selectExpr("l_orderkey * 10 + l_linenumber AS citation_key", "array(l_orderkey + 1) AS claim_keys", "l_suppkey AS evidence_key"),
        "attestations": lines.selectExpr("l_orderkey * 10 + l_linenumber AS attestation_key", "l_partkey AS entity_key"),
        "relevance": orders.selectExpr("o_orderkey AS relevance_key", "o_orderkey AS scope_key"),
        "questions": labels.selectExpr("doc_id div 2 AS question_key", "doc_id * 3 AS record_key"),
    }


_CANONICAL = f"{_canonical_sql(f'{_ENTITY} UNION {_TRUSTED}', f'{_CLAIM} UNION {_OWN_CLAIM}', _EVIDENCE)} UNION ALL {_coverage_sql('canonical', _RECORDS, 'SELECT doc_id // 2 FROM labels')}"


@query("canonical_battery", _CANONICAL)
def canonical_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approved entities and those of reconciled candidates are known, and claims that are approved or the package's own."""
    job = _job(spark, sf_dir) | {"canon": raw(spark, sf_dir, "region").filter("r_regionkey > 0").select("r_name")}
    return packages.battery("canonical", _canonical(spark, sf_dir) | {"coverage": _coverage(spark, sf_dir, "canonical")}, job)


@query("closed_battery", _canonical_sql(_TRUSTED, _OWN_CLAIM, "SELECT s_suppkey FROM supplier WHERE false", closed=True))
def closed_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same package under a job that approves nothing and has no snapshots: only what the package vouches for is known, and no scope is outside."""
    return packages.battery("canonical", _canonical(spark, sf_dir), {})


@query("edition_battery", f"""{_twice('/mentions', f'SELECT k FROM ({_LINES})')} UNION ALL {_anti('/mentions/attestation_key', 'undefined-attestation', 'SELECT l_orderkey * 3 AS k FROM lineitem', 'SELECT o_orderkey FROM orders')} UNION ALL {_anti('/mentions/verse_key', 'outside-authority', 'SELECT l_orderkey AS k FROM lineitem', _REFERENCE)}
    UNION ALL {_anti('/mentions/claim_keys', 'undefined-claim', 'SELECT unnest([l_orderkey, l_orderkey + 2]) AS k FROM lineitem', _CLAIM)} UNION ALL {_anti('/questions/record_key', 'unknown-record', 'SELECT doc_id * 10 + 1 AS k FROM labels', f'SELECT k FROM ({_LINES})')}
    UNION ALL {_coverage_sql('edition', f'SELECT k FROM ({_LINES})', 'SELECT doc_id FROM labels WHERE doc_id % 5 > 0')}""")
def edition_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, labels = raw(spark, sf_dir, "lineitem"), raw(spark, sf_dir, "labels")
    package = {
        "mentions": lines.selectExpr("l_orderkey * 10 + l_linenumber AS mention_key", "l_orderkey * 3 AS attestation_key", "l_orderkey AS verse_key", "array(l_orderkey, l_orderkey + 2) AS claim_keys"),
        "questions": labels.selectExpr("doc_id * 10 + 1 AS record_key", "IF(doc_id % 5 > 0, doc_id, NULL) AS question_key"),
        "coverage": _coverage(spark, sf_dir, "edition"),
    }
    return packages.battery("edition", package, _job(spark, sf_dir) | {"attestation": raw(spark, sf_dir, "orders").select("o_orderkey")})


@query("locale_battery", f"""{_twice('/profiles', 'SELECT p_partkey % 1950 AS k FROM part')} UNION ALL {_anti('/profiles/entity_key', 'unresolved-entity', 'SELECT p_partkey AS k FROM part', _ENTITY)} UNION ALL {_anti('/profiles/language_tag', 'outside-snapshot', "SELECT CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'xx' END AS k FROM part", 'SELECT lang FROM documents')}
    UNION ALL {_twice('/contexts', 'SELECT doc_id AS k FROM documents')} UNION ALL {_anti('/contexts/scope_key', 'outside-authority', 'SELECT doc_id + 1 AS k FROM documents', _SCOPE)} UNION ALL {_anti('/contexts/open_question_key', 'undefined-question', "SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id END AS k FROM documents", 'SELECT doc_id FROM labels')}
    UNION ALL {_anti('/localizations/relevance_key', 'undefined-relevance', 'SELECT l_orderkey * 2 AS k FROM lineitem', 'SELECT o_orderkey FROM orders')} UNION ALL {_twice('/localizations', f'SELECT k FROM ({_LINES})')} UNION ALL {_twice('/questions', 'SELECT doc_id AS k FROM labels')}
    UNION ALL {_anti('/questions/record_key', 'unknown-record', 'SELECT doc_id * 2 AS k FROM labels', 'SELECT doc_id FROM documents')} UNION ALL {_coverage_sql('locale', 'SELECT doc_id FROM documents', 'SELECT doc_id FROM labels', _SCOPE)}""")
def locale_battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, docs, lines, labels = (raw(spark, sf_dir, x) for x in ("part", "documents", "lineitem", "labels"))
    package = {
        "profiles": part.selectExpr("p_partkey % 1950 AS profile_key", "p_partkey AS entity_key", "CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'xx' END AS language_tag"),
        "contexts": docs.selectExpr("doc_id AS context_key", "doc_id + 1 AS scope_key", "IF(doc_id % 2 = 0, doc_id, NULL) AS open_question_key"),
        "localizations": lines.selectExpr("l_orderkey * 10 + l_linenumber AS localization_key", "l_orderkey * 2 AS relevance_key"),
        "questions": labels.selectExpr("doc_id AS question_key", "doc_id * 2 AS record_key"),
        "coverage": _coverage(spark, sf_dir, "locale"),
    }
    job = _job(spark, sf_dir) | {"language": docs.select("lang").distinct(), "relevance": raw(spark, sf_dir, "orders").select("o_orderkey")}
    return packages.battery("locale", package, job)


@query("battery_verdict", f"SELECT pointer, CASE min(CASE WHEN regexp_matches(finding, '^unresolved|^undefined|^unknown-record$') THEN 0 WHEN finding = 'duplicate' THEN 1 ELSE 2 END) WHEN 0 THEN 'dangling' WHEN 1 THEN 'duplicate' ELSE 'invalid-state' END AS error FROM ({_CANONICAL}) GROUP BY pointer")
def battery_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class under which each part of the canonical package fails: the gravest of its findings."""
    return packages.verdict(canonical_battery(spark, sf_dir), ["pointer"])


_MENTIONS = "SELECT doc_id * 2 + k AS mention_key, doc_id + CASE WHEN doc_id % 17 = 0 THEN 1000000 ELSE 0 END AS verse_key, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE k + 1 END AS ordinal, doc_id, k FROM labels, (SELECT unnest([0, 1]) AS k)"


def _job_sql() -> str:
    from scholion.plans.texts import _HITS

    return f"""WITH {_HITS}, m AS ({_MENTIONS}), p AS (SELECT m.*, d.doc_id AS known, h.start, h.start + 3 AS stop, substr(d.text, greatest(h.start - 20, 0) + 1, h.start - greatest(h.start - 20, 0)) AS prefix FROM m LEFT JOIN documents d ON d.doc_id = m.verse_key LEFT JOIN hits h ON h.doc_id = m.verse_key AND h.quote = 'the' AND h.ordinal = m.ordinal),
    o AS (SELECT mention_key, stop, lead(start) OVER (PARTITION BY verse_key ORDER BY start, stop, mention_key) AS next FROM p WHERE start IS NOT NULL)
    SELECT mention_key, CASE WHEN known IS NULL THEN 'unknown-verse' WHEN start IS NULL THEN 'ordinal-unresolved' ELSE 'context-mismatch' END AS finding FROM p WHERE known IS NULL OR start IS NULL OR mention_key % 5 = 0 UNION ALL SELECT mention_key, 'overlap' FROM o WHERE next < stop"""


@query("job_validation", _job_sql())
def job_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions against their verses; every fifth recorded another prefix."""
    from scholion.functions import text

    docs = raw(spark, sf_dir, "documents").select(F.col("doc_id").alias("verse_key"), "text")
    made = raw(spark, sf_dir, "labels").select("doc_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    made = made.selectExpr("doc_id * 2 + k AS mention_key", "doc_id + IF(doc_id % 17 = 0, 1000000, 0) AS verse_key", "IF(doc_id % 6 = 0, 1, k + 1) AS ordinal")
    around = text.context(F.col("text"), text.selector_span(F.col("text"), "the", F.col("ordinal")))
    mentions = made.join(docs, "verse_key", "left").select("mention_key", "verse_key", "ordinal", F.when(F.col("mention_key") % 5 == 0, "\x01").otherwise(around["prefix"]).alias("prefix"), around["suffix"].alias("suffix"))
    return packages.mention_findings(mentions, docs, "the")


@query("chapter_validation", """WITH c AS (SELECT CASE WHEN conv_id % 11 = 0 THEN 'é' WHEN conv_id % 13 = 0 THEN '' ELSE 'Neh' || conv_id END AS book, conv_id - 3 AS chapter, CASE WHEN conv_id % 17 = 0 THEN 'h' ELSE kind END AS kind, turn // 2 + CASE WHEN conv_id % 7 = 0 THEN -1 ELSE 1 END AS number, CASE WHEN turn = 3 THEN ' ' ELSE text END AS text FROM turns)
    SELECT DISTINCT book, chapter, finding FROM (SELECT book, chapter, 'book' AS finding FROM c WHERE book = '' OR book = 'é' UNION ALL SELECT book, chapter, 'chapter' FROM c WHERE chapter <= 0 UNION ALL SELECT book, chapter, 'number' FROM c WHERE kind = 'v' AND number <= 0 OR kind = 'h' AND number < 0
    UNION ALL SELECT book, chapter, 'text' FROM c WHERE text IS NULL OR trim(text) = '' UNION ALL SELECT book, chapter, 'empty' FROM c GROUP BY book, chapter HAVING count(*) FILTER (kind = 'v') = 0 UNION ALL SELECT book, chapter, 'duplicate' FROM c WHERE kind = 'v' GROUP BY book, chapter, number HAVING count(*) > 1)""")
def chapter_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = bind.turns(spark, sf_dir).selectExpr("CASE WHEN conv_id % 11 = 0 THEN 'é' WHEN conv_id % 13 = 0 THEN '' ELSE 'Neh' || conv_id END AS book", "conv_id - 3 AS chapter", "IF(conv_id % 17 = 0, 'h', kind) AS kind", "turn div 2 + IF(conv_id % 7 = 0, -1, 1) AS number", "IF(turn = 3, ' ', text) AS text")
    return packages.chapter_findings(blocks)


@query("bundle_order", "SELECT o_custkey, 'claims' AS list FROM (SELECT o_custkey, list(o_orderkey % 97 ORDER BY o_orderdate, o_orderkey) AS a FROM orders GROUP BY o_custkey) WHERE a <> list_sort(a) UNION ALL SELECT o_custkey, 'keys' FROM (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey) AS a FROM orders GROUP BY o_custkey) WHERE a <> list_sort(a)")
def bundle_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bundles whose lists aren't in order: one listed by date, one by key, which always is."""
    orders = raw(spark, sf_dir, "orders")
    dated = F.transform(F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey"))), lambda x: F.struct((x["o_orderkey"] % 97).alias("claim")))
    keyed = F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda x: F.struct(x.alias("claim")))
    return packages.unsorted_lists(orders.groupBy("o_custkey").agg(dated.alias("claims"), keyed.alias("keys")), ["o_custkey"], {"claims": ("claim",), "keys": ("claim",)})


@query("published_row_findings", """WITH r AS (SELECT doc_id, lang AS edition_key, source AS book, CAST(doc_id % 50 AS INT) AS chapter, CAST(n_chars - 400 AS BIGINT) AS verse, CASE WHEN doc_id % 9 = 0 THEN '' ELSE 'k' END AS local_key, CASE WHEN doc_id % 8 = 0 THEN NULL ELSE text END AS text, CASE WHEN doc_id % 6 = 0 THEN 'sha256:0' ELSE 'sha256:' || sha256(text) END AS digest FROM documents)
    SELECT doc_id, 'chapter' AS finding FROM r WHERE chapter <= 0 UNION ALL SELECT doc_id, 'verse' FROM r WHERE verse < 0 UNION ALL SELECT doc_id, 'local-key' FROM r WHERE local_key = '' UNION ALL SELECT doc_id, 'text' FROM r WHERE text IS NULL UNION ALL SELECT doc_id, 'digest' FROM r WHERE NOT regexp_matches(digest, '^sha256:[0-9a-f]{64}$')""")
def published_row_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = raw(spark, sf_dir, "documents").selectExpr("doc_id", "lang AS edition_key", "source AS book", "CAST(doc_id % 50 AS INT) AS chapter", "n_chars - 400 AS verse", "IF(doc_id % 9 = 0, '', 'k') AS local_key", "IF(doc_id % 8 = 0, NULL, text) AS text", "IF(doc_id % 6 = 0, 'sha256:0', 'sha256:' || sha2(text, 256)) AS digest")
    return packages.row_findings(rows, ["doc_id"], packages.VERSE_RULES)


@query("preview_validation", "SELECT p_partkey, 'name' AS finding FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT p_partkey, 'type' FROM part WHERE p_type NOT IN ('ECONOMY', 'STANDARD') UNION ALL SELECT p_partkey, 'verse' FROM part WHERE p_size NOT BETWEEN 1 AND 20")
def preview_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a preview by its structural rules: names, types, verses of the passage."""
    rows = raw(spark, sf_dir, "part").selectExpr("p_partkey", "IF(p_partkey % 10 = 0, '', p_name) AS name", "p_type", "p_size")
    return packages.row_findings(rows, ["p_partkey"], {"name": "name <> ''", "type": "p_type IN ('ECONOMY', 'STANDARD')", "verse": "p_size BETWEEN 1 AND 20"})


# drafts made of orders; what is wrong with one depends on several of its columns
_SUBMITTED = """'{"schema_version":"' || CASE WHEN o_custkey % 9 = 0 THEN '1.0' ELSE '1.0.' || o_custkey END || '","package_kind":"' || CASE WHEN o_orderstatus = 'P' THEN 'other' ELSE 'entity-profile-draft' END || '","records":[' ||
    CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE '{"record_key":"r' || o_orderkey || '"' || CASE WHEN o_custkey % 10 = 1 THEN '' ELSE ',"record_kind":"profile"' END || CASE WHEN o_orderkey % 8 = 2 THEN '' ELSE ',"entity_key":"entity:' || o_custkey || '"' END || ',"language_tag":"' || CASE WHEN o_orderkey % 12 = 5 THEN 'te' ELSE 'en' END || '"}' ||
    CASE WHEN o_orderkey % 5 = 0 THEN ',{"record_key":"r' || (o_orderkey + o_custkey % 2) || '","record_kind":"note","more":[1]}' ELSE '' END END || '],"open_questions":[],"editorial_observations":' || CASE WHEN o_orderkey % 23 = 0 THEN '{}' ELSE '[]' END || CASE WHEN o_custkey % 13 = 0 THEN ',"x":1' ELSE '' END || CASE WHEN o_orderkey % 19 = 0 THEN '' ELSE '}' END"""


@query(
    "submission_validation",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 19 = 0 THEN 'invalid-json' WHEN o_orderkey % 17 > 0 AND o_orderkey % 5 = 0 AND o_custkey % 2 = 0 THEN 'duplicate-key' WHEN o_custkey % 9 = 0 OR o_orderkey % 17 = 0 OR o_custkey % 10 = 1 OR o_orderkey % 23 = 0 OR o_custkey % 13 = 0 THEN 'schema-violation'
    WHEN o_orderstatus = 'P' THEN 'package-kind' WHEN o_orderkey % 8 = 2 OR o_orderkey % 12 = 5 THEN 'missing-key' ELSE CASE o_custkey % 3 WHEN 0 THEN 'replay' WHEN 1 THEN 'replay-changed' ELSE 'accepted' END END AS status FROM orders""",
)
def submission_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sent = raw(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.expr(_SUBMITTED).alias("raw"))
    known = sent.withColumn("known", F.when(F.col("o_custkey") % 3 == 0, F.sha2("raw", 256)).when(F.col("o_custkey") % 3 == 1, "other"))
    return known.select("o_orderkey", packages.submission_status("raw", ("entity-profile-draft",), "en", "known").alias("status"))


@query("canon_validation", """WITH e AS (SELECT p_partkey % 1800 AS entity_key, p_brand AS book, p_name AS content FROM part)
    SELECT '/entities' AS pointer, CAST(entity_key AS VARCHAR) AS key, 'collision' AS finding FROM e GROUP BY entity_key HAVING count(DISTINCT content) > 1 UNION ALL SELECT DISTINCT '/entities', CAST(entity_key AS VARCHAR), 'unregistered' FROM e WHERE entity_key NOT IN (SELECT s_suppkey * 3 FROM supplier)
    UNION ALL SELECT DISTINCT '/dependencies', package_key || '>' || depends_on, 'unbound' FROM (SELECT 'pkg' || n_nationkey AS package_key, 'pkg' || n_regionkey AS depends_on, n_nationkey FROM nation) WHERE n_nationkey % 4 = 0
    UNION ALL SELECT DISTINCT '/books', source, 'missing-book' FROM documents WHERE source NOT IN (SELECT book FROM e) UNION ALL SELECT DISTINCT '/books', book, 'extra-book' FROM e WHERE book NOT IN (SELECT source FROM documents)""")
def canon_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = raw(spark, sf_dir, "part").selectExpr("p_partkey % 1800 AS entity_key", "p_brand AS book", "p_name AS content")
    nation = raw(spark, sf_dir, "nation")
    digests = nation.selectExpr("'pkg' || n_nationkey AS package_key", "sha2(n_name, 256) AS digest")
    bound = nation.selectExpr("n_nationkey AS own", "'pkg' || n_nationkey AS package_key", "'pkg' || n_regionkey AS depends_on")
    known = digests.select(F.col("package_key").alias("depends_on"), "digest")
    dependencies = bound.join(F.broadcast(known), "depends_on").select("package_key", "depends_on", F.when(F.col("own") % 4 == 0, "old").otherwise(F.col("digest")).alias("digest"))
    expected = raw(spark, sf_dir, "documents").select(F.col("source").alias("book")).distinct()
    return packages.canon_findings(entities, raw(spark, sf_dir, "supplier").selectExpr("s_suppkey * 3 AS entity_key"), dependencies, digests, entities.select("book").distinct(), expected)


@query("package_merge", "WITH e AS (SELECT doc_id AS k, quality AS v, row_number() OVER (ORDER BY doc_id) AS pos FROM labels), i AS (SELECT doc_id AS k, 9 AS v, row_number() OVER (ORDER BY doc_id) AS pos FROM documents WHERE n_chars > 900) SELECT k, v, pos FROM e WHERE k NOT IN (SELECT k FROM i) UNION ALL SELECT i.k, i.v, coalesce(e.pos, (SELECT max(pos) FROM e) + i.pos) FROM i LEFT JOIN e USING (k)")
def package_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Incoming records over existing ones, in their places."""
    from scholion.operators.ordinals import ordinal_within

    one = F.lit(1).alias("all")
    existing = ordinal_within(raw(spark, sf_dir, "labels").select("doc_id", "quality", one), ["all"], "doc_id", "pos").selectExpr("doc_id AS k", "quality AS v", "pos")
    incoming = ordinal_within(raw(spark, sf_dir, "documents").filter("n_chars > 900").select("doc_id", one), ["all"], "doc_id", "pos").selectExpr("doc_id AS k", "9 AS v", "pos")
    return packages.merge_records(existing, incoming, ["k"], "pos")


@query("scope_remap", "SELECT a.scope_key AS old, coalesce(b.scope_key, a.scope_key) AS new FROM (SELECT 'cut:' || scope_key AS scope_key, start_ordinal, end_ordinal - CAST(start_ordinal % 3 = 0 AS INT) AS end_ordinal, refsys FROM scopes WHERE kind = 'passage') a LEFT JOIN (SELECT min(scope_key) AS scope_key, refsys, start_ordinal, end_ordinal FROM scopes GROUP BY refsys, start_ordinal, end_ordinal) b USING (refsys, start_ordinal, end_ordinal)")
def scope_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A foreign scheme's passages, a third of them cut short, onto scopes of the same range."""
    own = bind.scopes(spark, sf_dir)
    foreign = own.filter("kind = 'passage'").selectExpr("'cut:' || scope_key AS scope_key", "refsys", "start_ordinal", "end_ordinal - CAST(start_ordinal % 3 = 0 AS INT) AS end_ordinal")
    return packages.same_ranges(foreign, own, ["refsys", "start_ordinal", "end_ordinal"])


@query("superseded_keys", "SELECT a.reference_id, a.line, coalesce(m.new, a.entity_id) AS entity_id, count(*) AS n FROM attestations a LEFT JOIN (SELECT p_partkey AS old, p_partkey + 1 AS new FROM part WHERE p_partkey % 3 = 0) m ON m.old = a.entity_id GROUP BY ALL")
def superseded_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attestations of superseded entities point to those that took their place."""
    mapping = raw(spark, sf_dir, "part").filter("p_partkey % 3 = 0").selectExpr("p_partkey AS old", "p_partkey + 1 AS new")
    return packages.remapped(bind.attestations(spark, sf_dir), "entity_id", mapping).groupBy("reference_id", "line", "entity_id").agg(F.count(F.lit(1)).alias("n"))


@query("required_lookup", "SELECT reference_id, entity_id, name FROM (SELECT DISTINCT reference_id, entity_id FROM attestations) LEFT JOIN (SELECT p_partkey AS entity_id, p_name AS name FROM part WHERE p_partkey % 50 > 0) USING (entity_id) WHERE name IS NULL")
def required_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of scope and entity whose lookup is missing: what fails a preview before it is written."""
    names = raw(spark, sf_dir, "part").filter("p_partkey % 50 > 0").selectExpr("p_partkey AS entity_id", "p_name AS name")
    pairs = bind.attestations(spark, sf_dir).select("reference_id", "entity_id").distinct()
    return pairs.join(names, "entity_id", "left_anti").select("reference_id", "entity_id", F.lit(None).cast("string").alias("name"))
