"""Names of a table found in texts: every form, longest-first spans, and the first form of each entity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators import needles
from scholion.plans.registry import query
from scholion.sources.bind import raw

#: Words of an item's opening that its forms have, most preferred first.
FORMS = (4, 3, 2, 1)

_FORMS = f"""opened AS (SELECT item_id, string_split_regex(text, '[ \\t\\n\\r]+') AS w FROM benchmark WHERE text IS NOT NULL),
forms AS (SELECT item_id, r - 1 AS rank, array_to_string(w[1:n], ' ') AS needle FROM opened, (SELECT unnest({list(FORMS)}) AS n, unnest(range(1, {len(FORMS) + 1})) AS r) WHERE len(w) >= n)"""
# pieces between a needle's places; those between word bounds are numbered
_HITS = f"""{_FORMS}, needles AS (SELECT needle FROM forms WHERE regexp_matches(needle, '[A-Za-z0-9]') UNION SELECT p_name FROM part WHERE regexp_matches(p_name, '[A-Za-z0-9]')),
pieces AS (SELECT doc_id, needle, generate_subscripts(x, 1) AS n, unnest(x) AS piece FROM (SELECT doc_id, needle, string_split(text, needle) AS x FROM documents, needles WHERE contains(text, needle))),
placed AS (SELECT doc_id, needle, n, CASE WHEN piece = '' AND n > 1 THEN right(needle, 1) ELSE right(piece, 1) END AS before, lead(piece) OVER w AS next, lead(n, 2) OVER w AS after_next, CAST(sum(length(piece)) OVER w + (n - 1) * length(needle) AS BIGINT) AS start FROM pieces WINDOW w AS (PARTITION BY doc_id, needle ORDER BY n)),
hits AS (SELECT doc_id, needle, row_number() OVER (PARTITION BY doc_id, needle ORDER BY start) AS ordinal, start, start + length(needle) AS stop FROM placed WHERE next IS NOT NULL AND NOT regexp_matches(before, '[A-Za-z0-9]')
  AND NOT regexp_matches(CASE WHEN next = '' AND after_next IS NOT NULL THEN left(needle, 1) ELSE left(next, 1) END, '[A-Za-z0-9]'))"""


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, rank, needle): how each benchmark item may be called: by its opening words, the most first."""
    words = raw(spark, sf_dir, "benchmark").filter("text IS NOT NULL").select("item_id", F.split("text", "[ \\t\\n\\r]+").alias("w"))
    each = F.array(*(F.when(F.size("w") >= n, F.struct(F.lit(r).cast("long").alias("rank"), F.array_join(F.slice("w", 1, n), " ").alias("needle"))) for r, n in enumerate(FORMS)))
    return words.select("item_id", F.explode(F.array_compact(each)).alias("x")).select("item_id", "x.*")


def _needles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms(spark, sf_dir).select("needle").union(raw(spark, sf_dir, "part").select("p_name"))


def _hits(spark: SparkSession, sf_dir: str, width: int = 0) -> DataFrame:
    return needles.find_leftmost(raw(spark, sf_dir, "documents").select("doc_id", "text"), _needles(spark, sf_dir), width=width)


@query("alias_hits", f"WITH {_HITS} SELECT doc_id, needle, ordinal, start, stop FROM hits")
def alias_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name of a part and every form of an item in all documents."""
    return _hits(spark, sf_dir).select("doc_id", "needle", "ordinal", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


@query(
    "alias_spans",
    f"""WITH {_HITS},
    listed AS (SELECT doc_id, list({{'n': start - stop, 's': start, 'k': needle, 'e': stop}} ORDER BY start - stop, start, needle) AS l FROM hits GROUP BY doc_id),
    folded AS (SELECT doc_id, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.s < x.e AND x.s < y.e)) > 0 THEN acc ELSE list_append(acc, x) END, l[:0]) AS r FROM (SELECT doc_id, list_transform(l, lambda x: x) AS l FROM listed))
    SELECT doc_id, x.s AS start, x.e AS stop, x.k AS needle FROM (SELECT doc_id, unnest(r) AS x FROM folded)""",
)
def alias_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of those that overlap, the longest: what a reader is shown."""
    chosen = needles.longest_first(_hits(spark, sf_dir).select("doc_id", "needle", "start", "end"))
    return chosen.select("doc_id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"), "needle")


@query(
    "entity_mentions",
    f"""WITH {_HITS}, chosen AS (SELECT doc_id, item_id, min({{'rank': rank, 'needle': needle}}) AS x FROM (SELECT DISTINCT doc_id, needle FROM hits) JOIN forms USING (needle) GROUP BY doc_id, item_id)
    SELECT c.doc_id, c.item_id, c.x.rank AS rank, h.ordinal, h.start, sha256(substr(d.text, greatest(h.start - 20, 0) + 1, h.start - greatest(h.start - 20, 0)) || '|' || substr(d.text, h.stop + 1, 20)) AS around
    FROM chosen c JOIN hits h ON h.doc_id = c.doc_id AND h.needle = c.x.needle JOIN documents d ON d.doc_id = c.doc_id""",
)
def entity_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions as selectors: for each item and document the first form that occurs, all its occurrences with their ordinals, and the text around them."""
    # contexts are cut while a text is at hand once, before rows multiply
    chosen = needles.preferred_form(_hits(spark, sf_dir, 20), forms(spark, sf_dir), "item_id")
    return chosen.select("doc_id", "item_id", "rank", "ordinal", F.col("start").cast("long").alias("start"), F.sha2(F.concat_ws("|", "prefix", "suffix"), 256).alias("around"))
