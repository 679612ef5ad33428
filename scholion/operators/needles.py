"""Literals of a table found in texts, all in one pass, and choices among what was found.

A literal stands between word bounds, so the runs of word characters that it is made of are whole
runs of the text. Texts are cut into runs once; each run of word characters carries the few runs that
follow it, as many as the longest literal has, and joins the literals that begin with it. What joins
is compared in full. So the cost is that of the text's words and of the places where a literal's
first word stands, whatever the number of literals.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from scholion.functions.text import bound, greedy_spans, running_sums
from scholion.operators.ordinals import islands

ASCII_WORD = "A-Za-z0-9"
#: Literals that are broadcast at most; more are joined in a shuffle by first word.
BROADCAST = 200_000


def dictionary(needles: DataFrame, needle: str = "needle", word: str = ASCII_WORD) -> DataFrame:
    """The distinct literals with their parts: what comes before the first word (``lead``), that word (``first``), all up to the last word's end (``core``, of ``runs`` runs), and what follows (``tail``).

    A literal without a character of the class has no bounds to stand between, and is left out.
    """
    parts = needles.select(F.col(needle).alias("needle")).filter(F.col("needle").rlike(f"[{word}]")).distinct()
    lead = F.regexp_extract("needle", f"^[^{word}]*", 0)
    tail = F.regexp_extract("needle", f"[^{word}]*$", 0)
    core = F.substr("needle", F.length(lead) + 1, F.length("needle") - F.length(lead) - F.length(tail))
    found = parts.select("needle", lead.alias("lead"), tail.alias("tail"), core.alias("core"))
    return found.select("*", F.regexp_extract("core", f"^[{word}]+", 0).alias("first"), F.size(F.regexp_extract_all("core", F.lit(f"[{word}]+|[^{word}]+"), F.lit(0))).alias("runs"))


def _words(text: Column, longest: int, word: str) -> Column:
    """``array<struct<start, first, window, before, opening>>``: each word of a text, with the runs from it on and the one before."""
    runs = F.regexp_extract_all(text, F.lit(f"[{word}]+|[^{word}]+"), F.lit(0))

    def placed(found: Column) -> Column:
        begin = F.when(F.get(found, 0).rlike(f"^[{word}]"), 1).otherwise(2)

        def each(sums: Column) -> Column:
            return F.transform(
                F.sequence(begin, F.size(found), F.lit(2)),
                lambda i: F.struct(
                    F.element_at(sums, i).alias("start"),
                    F.element_at(found, i).alias("first"),
                    F.slice(found, i, F.lit(longest)).alias("window"),
                    F.when(i > 1, F.get(found, i - 2)).otherwise("").alias("before"),
                    (i <= 2).alias("opening"),
                ),
            )

        # a text of one run that is no word has none, and a sequence from 2 to 1 would run backwards
        return F.when(begin <= F.size(found), bound(running_sums(F.transform(found, F.length)), each))

    return bound(runs, placed)


def _matched(docs: DataFrame, known: DataFrame, key: str, text: str, word: str, first_only: bool = False, width: int = 0) -> DataFrame:
    """(key, ``needle``, ``ordinal``, ``start``, ``end``, ``prefix``, ``suffix``): the places of counted literals, in one pass over Arrow batches.

    A text's words are looked up among the literals' first words, and the rest is compared in place. With
    ``first_only`` a literal's places that overlap an earlier one of it are left out; ``width`` characters of the text are given on either side.
    """
    by_first: dict[str, list[tuple[str, int]]] = {}
    for needle, first, lead in known.select("needle", "first", F.length("lead")).collect():
        by_first.setdefault(first, []).append((needle, lead))
    runs, inside = re.compile(f"[{word}]+"), re.compile(f"[{word}]")
    names = [key, "needle", "ordinal", "start", "end", "prefix", "suffix"]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def places(body: str) -> Iterator[tuple[str, int, int, int, str, str]]:
        reached: dict[str, tuple[int, int]] = {}
        for m in runs.finditer(body):
            for needle, lead in by_first.get(m[0], ()):
                start, end = m.start() - lead, m.start() - lead + len(needle)
                if start < 0 or not body.startswith(needle, start) or (start and inside.match(body, start - 1)) or inside.match(body, end):
                    continue
                stop, ordinal = reached.get(needle, (0, 0))
                if first_only and start < stop:
                    continue
                reached[needle] = end, ordinal + 1
                yield needle, ordinal + 1, start, end, body[max(start - width, 0) : start], body[end : end + width]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # few texts at a time: their places are many
            for part in (batch.slice(k, 256) for k in range(0, len(batch), 256)):
                found = [(row, *place) for row, body in enumerate(part.column(1).to_pylist()) if body for place in places(body)]
                if found:
                    rows, *columns = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows, pa.int32())), *(pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True))], names=names)

    schema = StructType([StructField(key, docs.schema[key].dataType), *StructType.fromDDL("needle string, ordinal long, start int, end int, prefix string, suffix string").fields])
    return docs.select(key, text).mapInArrow(match, schema)


def find(docs: DataFrame, needles: DataFrame, key: str = "doc_id", text: str = "text", word: str = ASCII_WORD) -> DataFrame:
    """(key, ``needle``, ``start``, ``end``): every place of every literal (``needle`` of ``needles``) between characters that aren't of the class ``word``.

    Occurrences of one literal that overlap one another are all there; see ``leftmost``. Null and empty
    texts have none. Literals are counted and their longest measured before the plan is made: up to ``BROADCAST`` of
    them go to all tasks, more join the texts' words in a shuffle.
    """
    known = dictionary(needles, word=word)
    count, longest = known.agg(F.count("*"), F.coalesce(F.max("runs"), F.lit(0))).first()
    if count <= BROADCAST:
        return _matched(docs, known, key, text, word).select(key, "needle", "start", "end")
    words = docs.select(key, F.explode(_words(F.col(text), longest + 2, word)).alias("x")).select(key, "x.*")
    joined = words.join(known, "first")
    after = F.coalesce(F.get("window", F.col("runs")), F.lit(""))
    # a lead that is the whole run before would have a word before it, unless the text begins there; so with the tail
    leads = (F.col("lead") == "") | F.endswith("before", F.col("lead")) & ((F.length("before") > F.length("lead")) | F.col("opening"))
    tails = (F.col("tail") == "") | F.startswith(after, F.col("tail")) & ((F.length(after) > F.length("tail")) | (F.size("window") == F.col("runs") + 1))
    same = F.array_join(F.slice("window", F.lit(1), F.col("runs")), "") == F.col("core")
    start = F.col("start") - F.length("lead")
    return joined.filter(same & leads & tails).select(key, "needle", start.alias("start"), (start + F.length("needle")).alias("end"))


def find_leftmost(docs: DataFrame, needles: DataFrame, key: str = "doc_id", text: str = "text", word: str = ASCII_WORD, width: int = 0) -> DataFrame:
    """(key, ``needle``, ``ordinal``, ``start``, ``end``, ``prefix``, ``suffix``): ``leftmost`` of ``find``, with ``width`` characters of the text on either side. A text's places are known where it is read, so counted literals need no shuffle."""
    known = dictionary(needles, word=word)
    if known.count() <= BROADCAST:
        return _matched(docs, known, key, text, word, True, width)
    hits = leftmost(find(docs, needles, key, text, word), key)
    before = F.greatest(F.col("start") - width, F.lit(0))
    return hits.join(docs.select(key, F.col(text).alias("_text")), key).select(*hits.columns, F.substr("_text", before + 1, F.col("start") - before).alias("prefix"), F.substr("_text", F.col("end") + 1, F.lit(width)).alias("suffix"))


def _by_chain(spans: DataFrame, keys: list[str], choose) -> DataFrame:
    """The spans (keys, ``start``, ``end``, ``key``) that ``choose`` keeps of each chain of overlaps: spans that no chain joins don't bear on one another."""
    frame = Window.partitionBy(*keys).orderBy("start", "end", "key")
    reached = F.max("end").over(frame.rowsBetween(Window.unboundedPreceding, -1))
    chained = islands(spans.withColumn("_reached", reached), keys, ["start", "end", "key"], F.col("_reached").isNull() | (F.col("start") >= F.col("_reached")), "_chain")
    listed = chained.groupBy(*keys, "_chain").agg(F.collect_list(F.struct("start", "end", "key")).alias("spans"))
    return listed.select(*keys, F.explode(choose(F.col("spans"))).alias("x")).select(*keys, "x.*")


def greedy_select(spans: DataFrame, keys: list[str]) -> DataFrame:
    """The spans (keys, ``start``, ``end``, ``key``) that ``greedy_spans`` keeps of each key's: longest first."""
    return _by_chain(spans, keys, greedy_spans)


def _in_order(spans: Column) -> Column:
    ranked = F.array_sort(spans)
    return F.aggregate(ranked, F.filter(ranked, lambda x: F.lit(False)), lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["end"] > x["start"]), acc).otherwise(F.concat(acc, F.array(x))))


def leftmost(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ``needle``, ``ordinal``, ``start``, ``end``): of each literal's hits those that a search from left to right finds, numbered from 1."""
    kept = _by_chain(hits.withColumn("key", F.col("needle")), [key, "needle"], _in_order)
    return kept.select(key, "needle", F.row_number().over(Window.partitionBy(key, "needle").orderBy("start")).cast("long").alias("ordinal"), "start", "end")


def longest_first(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ``start``, ``end``, ``needle``): hits that don't overlap: the longest first, then the earliest, then the least literal."""
    return greedy_select(hits.withColumnRenamed("needle", "key"), [key]).select(key, "start", "end", F.col("key").alias("needle"))


def preferred_form(hits: DataFrame, forms: DataFrame, owner: str, key: str = "doc_id") -> DataFrame:
    """The hits of the first form of each owner that a text has, of ``forms`` (owner, ``rank``, ``needle``), with owner and ``rank``."""
    order = Window.partitionBy(key, owner).orderBy("rank", "needle")
    return hits.join(forms, "needle").withColumn("_form", F.rank().over(order)).filter("_form = 1").drop("_form")
