"""Native search with places: all matches of a pattern in a text, with offsets in code points.

A pattern's matches and the pieces of text between them, in turn, are the whole text. So lengths
summed up along both give every match's place, without any function outside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:int,end:int,found:string>>"


def _empty() -> Column:
    return F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("out"))


def _span(start: Column, end: Column, found: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), found.alias("found"))


def matches(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, found>>``: the leftmost non-overlapping matches, none for null. The end is exclusive.

    ``pattern`` is a Java pattern that matches no empty string. Texts without a match are only
    searched, not cut up.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    both = F.filter(F.zip_with(gaps, found, lambda gap, x: F.struct(gap.alias("gap"), x.alias("found"))), lambda x: x["found"].isNotNull())
    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["found"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(_span(start, end, x["found"]))).alias("out"))

    # places are summed up within parts of about as many matches as there are parts, then shifted part by part
    def summed(xs: Column) -> Column:
        size = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(16))
        parts = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, size), lambda k: F.slice(xs, k + 1, size))
        return F.transform(parts, lambda part: F.aggregate(part, _empty(), step))

    def shifted(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(F.lit(0)), lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + part["at"])))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda part, at: F.transform(part["out"], lambda x: _span(x["start"] + at, x["end"] + at, x["found"]))))

    return F.when(text.rlike(pattern), _bound(_bound(both, summed), shifted)).otherwise(F.array().cast(SPANS))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """What ``body`` makes of a value that is computed once: inside a lambda an outer expression would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), 0)
