"""Benchmark decontamination by a prefix-filtered join of documents with benchmark windows.

A window is ``WINDOW`` consecutive words of an item (a shorter item is one window). Exact
containment of a window needs every word pair of it, so one pair is a necessary prefix: the pair of
least frequency in the documents. Documents are joined with the windows of such pairs. Length and
position bound the windows that can lie around the place where they met; these are then compared
word by word.

Documents are cut into words twice: once to count the benchmark's pairs in all of them, once to
find the prefixes. Their words are spread out and met by broadcast hash joins inside one stage, so
no word of a document is ever shuffled, only counts of pairs and verified hits. A broadcast holds
``PAIRS_AT_ONCE`` pairs or prefixes at most, by count; a larger benchmark takes several passes over
the documents, each for the pairs of one residue. Everything is DataFrame and SQL functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.llm.common import materialize, row_key, table

WINDOW = 10
#: Pairs, and then prefixes with the item's words around them, that are broadcast at once.
PAIRS_AT_ONCE = 200_000
#: Contaminated documents whose keys are broadcast to drop them; more are joined by a shuffle.
BROADCAST_KEYS = 200_000

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str | Column) -> Column:
    """The words of a text with A-Z in lower case; none for null."""
    lowered = F.translate(F.coalesce(text if isinstance(text, Column) else F.col(text), F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def item_places(benchmark: DataFrame, window: int, *, id_col: str, text_col: str) -> DataFrame:
    """A row for each window and each pair in it: ``item``, window ``start`` and ``length``, ``place`` and ``pair``, and the item's words around the place.

    A window of one word has that word alone for a pair, marked ``single``. Pairs are 64-bit hashes;
    what they find is compared word by word.
    """
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), words_of(text_col).alias("words")).filter(F.col("item").isNotNull() & (F.size("words") > 0)).distinct()
    items = items.withColumn("length", F.least(F.size("words"), F.lit(window))).withColumn("item_key", F.xxhash64("item", "words"))
    starts = items.select("*", F.explode(F.expr("sequence(0, size(words) - length)")).alias("start"))
    places = starts.select("*", F.explode(F.expr("sequence(start, start + greatest(length - 2, 0))")).alias("place"))
    return places.select(
        "item", "item_key", "start", "length", "place",
        (F.col("length") == 1).alias("single"),
        F.expr("if(length = 1, xxhash64(words[place]), xxhash64(words[place], words[place + 1]))").alias("pair"),
        F.expr(f"slice(words, greatest(place - {window - 2}, 0) + 1, {2 * window - 2})").alias("around"),
        F.expr(f"greatest(place - {window - 2}, 0)").alias("around_start"),
    )


def _spread(words: DataFrame, singles: bool) -> DataFrame:
    """A row for each place of each document, and one behind the last with a null ``word``: ``at``, the ``pair`` that begins there and, if wanted, once more for the word alone."""
    spread = words.select("*", F.posexplode(F.concat("words", F.array(F.lit(None).cast("string")))).alias("at", "word"))
    pair = F.expr("xxhash64(word, get(words, at + 1))")
    if not singles:
        return spread.withColumn("pair", pair)
    alone = F.when(F.col("word").isNotNull() & F.expr("get(words, at + 1)").isNotNull(), F.array(pair, F.xxhash64("word"))).otherwise(F.array(pair))
    return spread.withColumn("pair", F.explode(alone))


def _residue(k: int, passes: int) -> Column:
    return F.pmod("pair", F.lit(passes)) == k


def _prefixes(words: DataFrame, places: DataFrame, pairs_at_once: int, singles: bool) -> DataFrame:
    """The rarest pair of each window with its ``place`` and the item's words ``around``, by pair and place; windows of a pair that no document has are left out."""
    pairs = materialize(places.select("pair").distinct(), "pairs")
    passes = max(1, -(-pairs.count() // pairs_at_once))
    counted = []
    for k in range(passes):
        met = _spread(words.select("words"), singles).select("pair").join(F.broadcast(pairs.filter(_residue(k, passes))), "pair").groupBy("pair").count()
        counted.append(met if passes == 1 else materialize(met, "counts"))
    ranked = places.join(reduce(DataFrame.union, counted), "pair", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    order = F.struct("count", "pair", "place")
    prefix = ranked.groupBy("item", "item_key", "start", "length").agg(F.min_by(F.struct("pair", "place", "around", "around_start", "count"), order).alias("x")).filter("x.count > 0")
    prefix = prefix.groupBy("item", "item_key", "length", F.col("x.pair").alias("pair"), F.col("x.place").alias("place")).agg(F.first("x.around").alias("around"), F.first("x.around_start").alias("around_start"), F.collect_set("start").alias("starts"))
    return materialize(prefix.drop("item_key"), "prefixes")


def _search(docs: DataFrame, benchmark: DataFrame, window: int, pairs_at_once: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """For each document a row with ``n_words``, and for each place where a window's prefix lies, a row with the ``item``, the windows' ``length`` and where those that occur begin (``starts``, may be empty); all with ``_id`` and ``_hash``, in a scratch table."""
    words = docs.select(F.col(id_col).alias("id"), *row_key(id_col, text_col), words_of(text_col).alias("words"))
    places = materialize(item_places(benchmark, window, id_col=item_col, text_col=item_text_col), "windows")
    singles = not places.filter("single").isEmpty()
    prefix = _prefixes(words, places, pairs_at_once, singles)
    passes = max(1, -(-prefix.count() // pairs_at_once))
    # a window that starts s in the item starts at - place + s in the document
    same = """filter(transform(starts, s -> at - place + s), d -> d >= near_start AND d + length <= near_start + size(near)
        AND slice(near, d - near_start + 1, length) = slice(around, d - at + place - around_start + 1, length))"""
    near_start = F.greatest(F.col("at") - (window - 2), F.lit(0))
    found = []
    for k in range(passes):
        met = _spread(words, singles).join(F.broadcast(prefix.filter(_residue(k, passes))), "pair", "left")
        last = F.col("word").isNull() & F.lit(k == 0)
        met = met.filter(F.col("item").isNotNull() | last)
        # the words around the place go on, not all words; higher-order functions come last, since they end generated code and what stands before them would then be held row by row
        near = F.when(F.col("item").isNotNull(), F.slice("words", near_start + 1, 2 * window - 2))
        met = met.select("id", "_id", "_hash", F.when(last, F.size("words")).alias("n_words"), "item", "length", "at", "place", "starts", "around", "around_start", near_start.alias("near_start"), near.alias("near"))
        found.append(materialize(met.withColumn("starts", F.expr(same)).select("id", "_id", "_hash", "n_words", "item", "length", "starts"), "found"))
    return reduce(DataFrame.union, found)


def _hits(found: DataFrame) -> DataFrame:
    """(``_id``, ``_hash``, ``items``, ``n_hit``) for each document in which windows occur."""
    spans = F.flatten(F.collect_set(F.expr("transform(starts, d -> struct(d AS d, length AS n))")))
    covered = F.expr("""aggregate(array_sort(spans), named_struct('end', 0, 'n', 0),
        (acc, x) -> named_struct('end', greatest(acc.end, x.d + x.n), 'n', acc.n + greatest(x.d + x.n - greatest(acc.end, x.d), 0)), acc -> acc.n)""")
    hits = found.filter("size(starts) > 0").groupBy("_id", "_hash").agg(F.array_sort(F.collect_set("item")).alias("items"), spans.alias("spans"))
    return hits.select("_id", "_hash", "items", covered.alias("n_hit"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pairs_at_once: int = PAIRS_AT_ONCE) -> DataFrame:
    """One row for each row of ``docs``: the id, ``n_words``, ``n_hit`` (words inside an occurrence of a window), ``items`` (ids as strings, sorted) and ``contaminated``.

    Null and empty texts have no words and no hits. An item without words, or with a null id, is left
    out; items that share an id count as one. Repeated rows get equal results, and rows that share an
    id but not a text their own. An empty table on either side gives an empty result or no hits.
    Columns other than those named are ignored, so none can clash. Whole texts are searched, however
    long.
    """
    found = _search(docs, benchmark, window, pairs_at_once, id_col, text_col, item_col, item_text_col)
    every = found.filter("n_words IS NOT NULL").select("id", "_id", "_hash", "n_words")
    return every.join(_hits(found), ["_id", "_hash"], "left").select(
        F.col("id").alias(id_col),
        F.col("n_words").cast("long").alias("n_words"),
        F.coalesce(F.col("n_hit").cast("long"), F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", pairs_at_once: int = PAIRS_AT_ONCE, broadcast_keys: int = BROADCAST_KEYS) -> DataFrame:
    """The rows of ``docs``, whole, in which no window occurs. Texts are shuffled only if more than ``broadcast_keys`` documents go."""
    found = _search(docs, benchmark, window, pairs_at_once, id_col, text_col, item_col, item_text_col)
    hits = materialize(found.filter("size(starts) > 0").select(F.col("_id").alias("__hit_id"), F.col("_hash").alias("__hit_hash")).distinct(), "hits")
    if hits.count() <= broadcast_keys:
        hits = F.broadcast(hits)
    own_id, own_hash = row_key(id_col, text_col)
    keyed = docs.select("*", own_id.alias("__own_id"), own_hash.alias("__own_hash"))
    kept = keyed.join(hits, (keyed["__own_id"] == hits["__hit_id"]) & (keyed["__own_hash"] == hits["__hit_hash"]), "left_anti")
    return kept.select(*(keyed[x] for x in docs.columns))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        "contaminated",
    )


OP5_SQL = r"""
WITH
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
b AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
w AS (SELECT DISTINCT item, least(len(words), 10) AS n, words[s : s + least(len(words), 10) - 1] AS win FROM (SELECT item, words, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS s FROM b WHERE len(words) > 0)),
g AS (SELECT r, n, s, words[s : s + n - 1] AS win FROM (SELECT r, words, n, unnest(range(1, len(words) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM w) WHERE len(words) >= n)),
h AS (SELECT g.r, w.item, g.s, g.n FROM g JOIN w ON g.win = w.win AND g.n = w.n),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM h) GROUP BY r),
i AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN i USING (r)
"""
