"""Text: keys, quotes, spans, search and references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.functions import keys, text
from scholion.plans.registry import query
from scholion.sources import bind
from scholion.sources.bind import raw

QUOTES = ("the", "que", "der", "los")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").select("doc_id", "lang", "text")


@query("slugify", "SELECT url, page_id, coalesce(nullif(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'x') AS slug FROM pages")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "pages").select("url", "page_id", keys.slugify(F.col("url")).alias("slug"))


@query("plain_text", r"SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\x{a0}]+', ' ', 'g'))) AS digest FROM documents")
def plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.plain_text(F.col("text")), 256).alias("digest"))


@query(
    "mixed_content",
    r"""SELECT conv_id, sha256(trim(regexp_replace(string_agg(CASE turn % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN text || ' ' WHEN 2 THEN '  ' ELSE ' ' END, '' ORDER BY turn), '[\s\x{a0}]+', ' ', 'g'))) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""",
)
def mixed_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as lists of strings, objects with a text, objects without one, and numbers."""
    turns = raw(spark, sf_dir, "conversations").filter("text IS NOT NULL")
    quoted = F.regexp_extract(F.to_json(F.array("text")), r"(?s)^\[(.*)\]$", 1)
    noted = F.concat(F.lit('{"noteId":'), F.col("turn").cast("string"), F.lit("}"))
    item = F.when(F.col("turn") % 4 == 0, quoted).when(F.col("turn") % 4 == 1, F.to_json(F.struct("text"))).when(F.col("turn") % 4 == 2, noted).otherwise(F.col("turn").cast("string"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", item.alias("item")))).alias("x"))
    content = F.parse_json(F.concat(F.lit("["), F.array_join(F.transform("x", lambda x: x["item"]), ","), F.lit("]")))
    return listed.select("conv_id", F.sha2(text.mixed_text(content), 256).alias("digest"))


# pieces between the quotes' literals give their places; those between word bounds are numbered
_HITS = f"""quotes AS (SELECT unnest({list(QUOTES)}) AS quote),
pieces AS (SELECT doc_id, quote, generate_subscripts(x, 1) AS n, unnest(x) AS piece FROM (SELECT doc_id, quote, string_split(text, quote) AS x FROM documents, quotes WHERE contains(text, quote))),
placed AS (SELECT doc_id, quote, n, CASE WHEN piece = '' AND n > 1 THEN right(quote, 1) ELSE right(piece, 1) END AS before, lead(piece) OVER w AS next, lead(n, 2) OVER w AS after_next, CAST(sum(length(piece)) OVER w + (n - 1) * length(quote) AS BIGINT) AS start FROM pieces WINDOW w AS (PARTITION BY doc_id, quote ORDER BY n)),
hits AS (SELECT doc_id, quote, start, row_number() OVER (PARTITION BY doc_id, quote ORDER BY start) AS ordinal FROM placed WHERE next IS NOT NULL AND NOT regexp_matches(before, '[A-Za-z0-9]')
  AND NOT regexp_matches(CASE WHEN next = '' AND after_next IS NOT NULL THEN left(quote, 1) ELSE left(next, 1) END, '[A-Za-z0-9]'))"""


def _hits(spark: SparkSession, sf_dir: str, contexts: bool = False) -> DataFrame:
    """(doc_id, quote, ordinal, start, end): word-bounded quotes, numbered by occurrence; with their contexts, which are cut before rows multiply."""
    def found(quote: str):
        spans = text.quote_positions(F.col("text"), quote)
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), *([text.context(F.col("text"), x).alias("around")] if contexts else [])))

    each = F.array(*(F.struct(F.lit(q).alias("quote"), found(q).alias("spans")) for q in QUOTES))
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(each).alias("x"))
    rows = rows.select("doc_id", "x.quote", F.posexplode("x.spans").alias("pos", "span"))
    return rows.select("doc_id", "quote", (F.col("pos") + 1).cast("long").alias("ordinal"), "span.*")


@query("bounded_quote_hits", f"WITH {_HITS} SELECT doc_id, quote, ordinal, start, start + length(quote) AS stop FROM hits")
def bounded_quote_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("doc_id", "quote", "ordinal", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


@query("selector_resolve", f"WITH {_HITS} SELECT d.doc_id, h.start FROM documents d LEFT JOIN hits h ON h.doc_id = d.doc_id AND h.quote = 'the' AND h.ordinal = 2")
def selector_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.selector_span(F.col("text"), "the", 2)["start"].cast("long").alias("start"))


@query("prefix_suffix_check", f"""WITH {_HITS}, around AS (SELECT h.*, substr(text, greatest(start - 20, 0) + 1, start - greatest(start - 20, 0)) AS prefix, substr(text, start + length(quote) + 1, 20) AS suffix FROM hits h JOIN documents USING (doc_id))
    SELECT doc_id, quote, ordinal, sha256(prefix || '|' || suffix) AS around, prefix = CASE WHEN ordinal % 5 = 0 THEN 'recorded otherwise' ELSE prefix END AND suffix = CASE WHEN ordinal % 7 = 0 THEN '' ELSE suffix END AS verified FROM around""")
def prefix_suffix_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the text around each quote is what its selector recorded; every fifth prefix and every seventh suffix was recorded otherwise."""
    rows = _hits(spark, sf_dir, contexts=True).select("doc_id", "quote", "ordinal", "around.*")
    recorded = rows.withColumns({"said_prefix": F.when(F.col("ordinal") % 5 == 0, "recorded otherwise").otherwise(F.col("prefix")), "said_suffix": F.when(F.col("ordinal") % 7 == 0, "").otherwise(F.col("suffix"))})
    verified = (F.col("said_prefix") == F.col("prefix")) & (F.col("said_suffix") == F.col("suffix"))
    return recorded.select("doc_id", "quote", "ordinal", F.sha2(F.concat_ws("|", "prefix", "suffix"), 256).alias("around"), verified.alias("verified"))


@query("utf16_offsets", "SELECT doc_id, CAST(length(text) // 2 + len(list_filter(range(1, length(text) // 2 + 1), lambda i: unicode(substr(text, i, 1)) > 65535)) AS BIGINT) AS half FROM documents")
def utf16_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.utf16_offset(F.col("text"), F.floor(F.length("text") / 2).cast("int")).alias("half"))


@query("search_like_literal", "SELECT doc_id, length(text) AS size FROM documents WHERE translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') LIKE '%\\%\\%\\% of%' ESCAPE '\\' ORDER BY lang, doc_id LIMIT 20")
def search_like_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty whose text holds the literal, small and capital letters of ASCII alike."""
    pattern = F.concat(F.lit("%"), text.like_escape(F.lit("%%% of")), F.lit("%"))
    lowered = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return _docs(spark, sf_dir).filter(F.like(lowered, pattern)).orderBy("lang", "doc_id").limit(20).select("doc_id", F.length("text").alias("size"))


@query("search_lower_topk", "SELECT doc_id, lang FROM documents WHERE contains(lower(text), lower('THEREAN')) ORDER BY lang, doc_id LIMIT 20")
def search_lower_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty in canonical order, which is the feature: a capped search."""
    return _docs(spark, sf_dir).filter(F.contains(F.lower("text"), F.lower(F.lit("THEREAN")))).orderBy("lang", "doc_id").limit(20).select("doc_id", "lang")


@query("rights_search", "SELECT doc_id FROM documents WHERE contains(lower(text), 'eand') AND lang IN ('en', 'de')")
def rights_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rights = spark.createDataFrame([("en", True), ("de", True), ("fr", False)], "lang string, searchable boolean")
    allowed = rights.filter("searchable").select("lang")
    return _docs(spark, sf_dir).join(F.broadcast(allowed), "lang", "left_semi").filter(F.contains(F.lower("text"), F.lit("eand"))).select("doc_id")


@query("bullets", r"""SELECT doc_id, CAST(len(list_filter(list_transform(string_split(regexp_replace(text, '([.!?]["''”’)]*)[ \t\n\x0B\f\r]+([A-Z“"''(])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: trim(regexp_replace(x, '[ \t\n\x0B\f\r]+', ' ', 'g'))), lambda x: x <> '')) AS BIGINT) AS n FROM documents""")
def bullets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.size(text.bullets(F.col("text"))).cast("long").alias("n"))


_DECODED = "regexp_replace(t, '<[^>]+>', ' ', 'g')"
for _entity, _char in text.ENTITIES:
    _DECODED = f"replace({_DECODED}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"


@query("comment_sanitize", f"""WITH c AS (SELECT page_id, trim(regexp_replace({_DECODED}, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS out FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'see <b>Dan</b>&amp;co ' || page_id WHEN 1 THEN 'as the Atlas says' WHEN 2 THEN 'a &lt; b' ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END AS t FROM pages))
    SELECT page_id, CASE WHEN out <> '' AND length(out) <= 200 AND NOT regexp_matches(out, '{text.LEFT_OVER}') AND NOT regexp_matches(out, '{text.SOURCE_MARKERS}') THEN out END AS comment FROM c""")
def comment_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("CASE page_id % 4 WHEN 0 THEN 'see <b>Dan</b>&amp;co ' || page_id WHEN 1 THEN 'as the Atlas says' WHEN 2 THEN 'a &lt; b' ELSE regexp_extract(html, '<title>(.*?)</title>', 1) END")
    return raw(spark, sf_dir, "pages").select("page_id", text.sanitize_comment(said).alias("comment"))


@query("snippet", "SELECT doc_id, CASE WHEN length(text) > 120 THEN left(text, 117) || '…' ELSE text END AS snippet FROM documents")
def snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.snippet(F.col("text")).alias("snippet"))


@query("short_role", "SELECT doc_id, CASE WHEN length(h) > 42 THEN trim(left(h, 42)) || '…' ELSE trim(h) END AS role FROM (SELECT doc_id, regexp_extract(text, '^[^;.]*') AS h FROM documents)")
def short_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.short_role(F.col("text")).alias("role"))


_GROUP, _LAND = "the|and|for", "is|was|are"
# whether what comes before a name, from the last character that no list has, ends in a head and a list
_LED = "(^|[^A-Za-z''’-])([A-Za-z''’-]*[''’-])?(%s)\\s+of\\s+(((and|of)\\s+)*[A-Za-z''’-]+(\\s*,\\s*|\\s+and\\s+))*((and|of)\\s+)*$"
_SENSES = f"""clauses AS (SELECT doc_id, generate_subscripts(x, 1) AS n, unnest(x) AS clause FROM (SELECT doc_id, string_split_regex(text, '[^A-Za-z''’\\s,-]') AS x FROM documents WHERE contains(text, 'that'))),
cut AS (SELECT doc_id, n, generate_subscripts(x, 1) AS k, unnest(x) AS part, clause FROM (SELECT *, string_split(clause, 'that') AS x FROM clauses WHERE contains(clause, 'that'))),
named AS (SELECT doc_id, n, k, left(clause, CAST(sum(length(part)) OVER w + (k - 1) * 4 AS BIGINT)) AS before, lead(part) OVER w AS after, clause, CAST(sum(length(part)) OVER w + (k - 1) * 4 AS BIGINT) AS pos FROM cut WINDOW w AS (PARTITION BY doc_id, n ORDER BY k)),
mentions AS (SELECT doc_id, before, substr(clause, pos + 5, 1) AS next, right(before, 1) AS last FROM named WHERE after IS NOT NULL),
judged AS (SELECT doc_id, NOT regexp_matches(last, '[A-Za-z0-9]') AND NOT regexp_matches(next, '[A-Za-z0-9]') AS said, NOT regexp_matches(next, '[A-Za-z]') AND regexp_matches(before, '{_LED % _GROUP}') AS g, NOT regexp_matches(next, '[A-Za-z]') AND regexp_matches(before, '{_LED % _LAND}') AS t FROM mentions)"""


@query("sense_classify", f"WITH {_SENSES} SELECT doc_id, CASE WHEN bool_or(said AND NOT g AND NOT t) THEN 'person' WHEN bool_or(g) THEN 'group' WHEN bool_or(t) THEN 'territory' ELSE 'person' END AS sense FROM judged WHERE said OR g OR t GROUP BY doc_id")
def sense_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("text")
    found = text.sense(body, ("that",), text.governed_spans(body, _GROUP, "that"), text.governed_spans(body, _LAND, "that"))
    # generated, not filtered: a filter would be pushed below and judge each text twice
    return _docs(spark, sf_dir).select("doc_id", F.explode(F.array_compact(F.array(found))).alias("sense"))


_REFS = "refs AS (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'en:Gen.' || (o_orderkey % 50) || '.' || (o_custkey % 30) WHEN 1 THEN 'Gen.' || (o_orderkey % 50) WHEN 2 THEN 'Neh.2.' || (o_orderkey % 20) || '-' || (o_custkey % 20) WHEN 3 THEN '' WHEN 4 THEN 'Gen 1:1' ELSE '1Sam.3.' || (o_orderkey % 9 + 1) || '-' || (o_custkey % 9 + 1) || '.4' END AS ref FROM orders)"


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "orders").selectExpr("o_orderkey", _REFS[_REFS.index("CASE") : _REFS.index(" AS ref")] + " AS ref")


_PARSED = rf"""parsed AS (SELECT *, CASE WHEN ref = '' THEN 'empty' WHEN NOT ok THEN 'grammar' WHEN c = 0 OR coalesce(v, 1) = 0 OR ec = 0 OR coalesce(ev, 1) = 0 THEN 'zero' WHEN ec < c OR ec = c AND coalesce(ev, 0) < coalesce(v, 0) THEN 'order' END AS error
    FROM (SELECT o_orderkey, ref, ok, c, v, coalesce(g5, c) AS ec, coalesce(g6, v) AS ev FROM (SELECT o_orderkey, ref, regexp_matches(ref, p) AS ok, TRY_CAST(regexp_extract(ref, p, 3) AS INT) AS c, TRY_CAST(regexp_extract(ref, p, 4) AS INT) AS v, TRY_CAST(regexp_extract(ref, p, 5) AS INT) AS g5, TRY_CAST(regexp_extract(ref, p, 6) AS INT) AS g6 FROM refs, (SELECT '{keys.REFERENCE}' AS p))))"""


@query("parse_reference", f"WITH {_REFS}, {_PARSED} SELECT o_orderkey, ref, error, CASE WHEN error IS NULL THEN c END AS chapter, CASE WHEN error IS NULL THEN v END AS verse, CASE WHEN error IS NULL THEN ec END AS end_chapter, CASE WHEN error IS NULL THEN ev END AS end_verse FROM parsed")
def parse_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _references(spark, sf_dir).select("o_orderkey", "ref", keys.parse_reference(F.col("ref")).alias("x")).select("o_orderkey", "ref", "x.error", "x.chapter", "x.verse", "x.end_chapter", "x.end_verse")


@query("format_reference", f"WITH {_REFS}, {_PARSED} SELECT o_orderkey, c || ':' || v || CASE WHEN ec <> c THEN '–' || ec || ':' || ev WHEN ev <> v THEN '–' || ev ELSE '' END AS label FROM parsed WHERE error IS NULL AND v IS NOT NULL")
def format_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _references(spark, sf_dir).select("o_orderkey", keys.parse_reference(F.col("ref")).alias("x")).select("o_orderkey", "x.*").filter("error IS NULL AND verse IS NOT NULL")
    return found.select("o_orderkey", keys.format_range(F.col("chapter"), F.col("verse"), F.col("end_chapter"), F.col("end_verse")).alias("label"))


@query("scope_kinds", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'verse' WHEN o_orderkey % 4 = 1 THEN 'chapter' WHEN o_orderkey % 10 = o_custkey % 10 THEN 'chapter' ELSE 'range' END AS kind FROM orders")
def scope_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    local = F.expr("CASE WHEN o_orderkey % 4 = 0 THEN 'gen.1.' || o_custkey WHEN o_orderkey % 4 = 1 THEN 'gen.' || o_custkey ELSE 'gen.1.' || (o_orderkey % 10) || '-gen.1.' || (o_custkey % 10) END")
    return raw(spark, sf_dir, "orders").select("o_orderkey", keys.scope_kind(local).alias("kind"))


@query("autolink_refs", "SELECT o_orderkey, 'gen.' || (o_orderkey % 50) || '.' || (o_custkey % 30) || CASE WHEN o_custkey % 2 = 0 THEN '-' || (o_custkey % 40) ELSE '' END AS link FROM orders")
def autolink_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.expr("'as in Gen ' || (o_orderkey % 50) || ':' || (o_custkey % 30) || IF(o_custkey % 2 = 0, '–' || (o_custkey % 40), '') || ', it is said'")
    return raw(spark, sf_dir, "orders").select("o_orderkey", F.explode(text.links(said)).alias("link"))


# every full stop is followed by references of three forms, whose numbers are the row's own
_SAID = "replace(text, '. ', '. See Ezra ' || (doc_id % 10 + 1) || ':' || (doc_id % 30 + 1) || '–' || (doc_id % 30 + 3) || ' (vv' || (doc_id % 20 + 1) || ', ' || (doc_id % 20 + 2 + doc_id % 3) || '), Version 2 and v' || (doc_id % 7 + 1) || ' of Neh ' || (doc_id % 13) || '. ')"
_PROSE = text.PROSE_REFERENCE
_KEY = f"""CASE WHEN regexp_extract(x, '{_PROSE}', 1) <> '' THEN CASE WHEN book IN ('See Ezra', 'Neh') THEN replace(book, 'See ', '') || '.' || chap || CASE WHEN v = '' THEN '' ELSE '.' || v END || CASE WHEN v_end = '' THEN '' ELSE '-' || replace(book, 'See ', '') || '.' || chap || '.' || v_end END END
    ELSE lang || '.' || (doc_id % 50) || '.' || head || CASE WHEN head = tail THEN '' ELSE '-' || lang || '.' || (doc_id % 50) || '.' || tail END END"""


@query(
    "linked_prose",
    f"""WITH said AS (SELECT doc_id, lang, {_SAID} AS said FROM documents),
    found AS (SELECT doc_id, lang, unnest(l) AS x, generate_subscripts(l, 1) AS n FROM (SELECT doc_id, lang, regexp_extract_all(said, '{_PROSE}') AS l FROM said)),
    parts AS (SELECT *, regexp_extract(x, '{_PROSE}', 1) AS book, regexp_extract(x, '{_PROSE}', 2) AS chap, regexp_extract(x, '{_PROSE}', 3) AS v, regexp_extract(x, '{_PROSE}', 4) AS v_end, trim(string_split(regexp_extract(x, '{_PROSE}', 5), ',')[1]) AS head, CASE WHEN regexp_extract(x, '{_PROSE}', 6) <> '' THEN regexp_extract(x, '{_PROSE}', 6) ELSE trim(string_split(regexp_extract(x, '{_PROSE}', 5), ',')[-1]) END AS tail FROM found)
    SELECT doc_id, link, count(*) AS n FROM (SELECT doc_id, {_KEY} AS link FROM parts) WHERE link IS NOT NULL GROUP BY ALL""",
)
def linked_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document links to each passage: by book, or by verses of the passage that it is about."""
    said = _docs(spark, sf_dir).withColumn("said", F.expr(_SAID))
    spans = text.linked_spans(F.col("said"), {"See Ezra": "Ezra", "Neh": "Neh"}, F.col("lang"), F.col("doc_id") % 50)
    return said.select("doc_id", F.explode(spans).alias("x")).filter("x.key IS NOT NULL").groupBy("doc_id", F.col("x.key").alias("link")).agg(F.count(F.lit(1)).alias("n"))


# Words in titles of events and the tags that they give, in order.
TAGS = (("vision", "vision"), ("prayer", "prayer"), ("genealog", "genealogy"), ("covenant", "covenant"), ("law", "law"), ("song", "song"), ("psalm", "song"), ("letter", "letter"), ("prophec", "prophecy"), ("parable", "teaching"), ("sermon", "teaching"), ("miracle", "miracle"), ("battle", "battle"), ("war", "battle"), ("journey", "journey"), ("journeys", "journey"), ("birth", "birth"), ("death", "death"), ("genealogy", "genealogy"), ("commission", "commission"), ("conquest", "battle"), ("dedication", "worship"), ("worship", "worship"), ("census", "census"), ("plague", "judgment"), ("judgment", "judgment"), ("instruction", "teaching"), ("teaching", "teaching"), ("discourse", "teaching"))


@query("keyword_tags", f"SELECT o_orderkey, CASE {' '.join(f"WHEN contains(title, '{word}') THEN '{tag}'" for word, tag in TAGS)} ELSE 'narrative' END AS tag FROM (SELECT o_orderkey, lower('The ' || list_extract({[w.capitalize() for w, _ in TAGS] + ['Wall', 'Gate']}, CAST(o_orderkey % 31 + 1 AS INT)) || ' and the ' || list_extract({[w for w, _ in TAGS] + ['x', 'y']}, CAST(o_custkey % 31 + 1 AS INT)) || ' ' || o_orderkey) AS title FROM orders)")
def keyword_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles by the first word of the list that they hold."""
    names = [F.get(F.array(*(F.lit(x) for x in words)), F.expr(f"CAST({key} % 31 AS INT)")) for words, key in (([w.capitalize() for w, _ in TAGS] + ["Wall", "Gate"], "o_orderkey"), ([w for w, _ in TAGS] + ["x", "y"], "o_custkey"))]
    title = F.lower(F.concat(F.lit("The "), names[0], F.lit(" and the "), names[1], F.lit(" "), "o_orderkey"))
    first = F.coalesce(*(F.when(F.contains(title, F.lit(word)), tag) for word, tag in TAGS), F.lit("narrative"))
    return raw(spark, sf_dir, "orders").select("o_orderkey", first.alias("tag"))


@query("importance_buckets", "SELECT entity_id, CASE WHEN count(*) >= 35 THEN 'central' WHEN count(*) >= 25 THEN 'supporting' ELSE 'background' END AS importance FROM attestations GROUP BY entity_id")
def importance_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return bind.attestations(spark, sf_dir).groupBy("entity_id").agg(F.when(n >= 35, "central").when(n >= 25, "supporting").otherwise("background").alias("importance"))


@query("first_names_per_scope", "SELECT reference_id, string_agg(name, ', ' ORDER BY name) AS names FROM (SELECT reference_id, name, row_number() OVER (PARTITION BY reference_id ORDER BY name) AS r FROM (SELECT DISTINCT reference_id, name FROM attestations JOIN entities USING (entity_id))) WHERE r <= 8 GROUP BY reference_id")
def first_names_per_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = bind.attestations(spark, sf_dir).join(bind.entities(spark, sf_dir).select("entity_id", "name"), "entity_id")
    return joined.groupBy("reference_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, 8), ", ").alias("names"))
