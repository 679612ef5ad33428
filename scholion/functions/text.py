"""Functions over text and spans: all offsets are code points from 0, ends are exclusive."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = "A-Za-z0-9"
_SPANS = "array<struct<start:int,end:int>>"


def plain_text(text: Column) -> Column:
    """White space, Unicode's included, collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def mixed_text(content: Column) -> Column:
    """The plain text of a variant that lists strings and objects.

    Strings follow one another as they are; an object gives its ``text``, if that is a string, and ends a span, so
    a blank follows it; anything else is a blank. Null where the variant is no list.
    """
    kind = F.schema_of_variant
    items = F.try_variant_get(content, "$", "array<variant>")

    def said(x: Column) -> Column:
        own = F.try_variant_get(x, "$.text", "variant")
        inner = F.when(kind(own) == "STRING", F.try_variant_get(x, "$.text", "string")).otherwise(" ")
        return F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string")).when(F.startswith(kind(x), F.lit("OBJECT")), F.concat(inner, F.lit(" "))).otherwise(" ")

    return plain_text(F.array_join(F.transform(items, said), ""))


def normalized(text: Column) -> Column:
    return F.lower(F.trim(text))


def bounded_pattern(quote: str) -> str:
    """A Java pattern for a literal that stands between other characters than letters and digits of ASCII."""
    return f"(?<![{_WORD}]){re.escape(quote)}(?![{_WORD}])"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """What ``body`` makes of a value that is computed once: inside a lambda an outer expression would be computed again for each element."""
    return F.get(F.transform(F.array(value), body), 0)


def running_sums(xs: Column) -> Column:
    """For each number the sum of those before it. Sums are made within runs of about as many numbers as there are runs: appending to one array would take time in its square."""
    zero = F.array(F.lit(0))

    def summed(values: Column) -> Column:
        run = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(8))
        parts = F.transform(F.sequence(F.lit(0), F.size(values) - 1, run), lambda k: F.slice(values, k + 1, run))
        return F.transform(parts, lambda part: F.aggregate(part, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))))

    def shifted(parts: Column) -> Column:
        before = F.aggregate(parts, zero, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.element_at(x, -1))))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda x, at: F.transform(F.slice(x, F.lit(1), F.size(x) - 1), lambda y: y + at)))

    return bound(xs, lambda values: F.when(F.size(values) > 0, bound(summed(values), shifted)).otherwise(F.array().cast("array<int>")))


def positions(text: Column, pattern: str) -> Column:
    """``array<struct<start, end>>`` of the leftmost non-overlapping matches of a pattern, by the lengths of the pieces between."""
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    lengths = F.filter(F.zip_with(gaps, found, lambda gap, x: F.struct(F.length(gap).alias("gap"), F.length(x).alias("size"))), lambda x: x["size"].isNotNull())
    none = F.array().cast("array<struct<start:int,end:int>>")

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        return F.struct((begin + x["size"]).alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("start"), (begin + x["size"]).alias("end")))).alias("out"))

    # summed up within runs of about as many matches as there are runs: appending to one array would take time in their square
    def summed(xs: Column) -> Column:
        run = F.greatest(F.ceil(F.sqrt(F.size(xs))).cast("int"), F.lit(8))
        runs = F.transform(F.sequence(F.lit(0), F.size(xs) - 1, run), lambda k: F.slice(xs, k + 1, run))
        return F.transform(runs, lambda part: F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), step))

    def shifted(parts: Column) -> Column:
        before = F.aggregate(parts, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x["at"])))
        return F.flatten(F.zip_with(parts, F.slice(before, F.lit(1), F.size(parts)), lambda x, at: F.transform(x["out"], lambda y: F.struct((y["start"] + at).alias("start"), (y["end"] + at).alias("end")))))

    return F.when(text.rlike(pattern), bound(bound(lengths, summed), shifted)).otherwise(none)


def quote_positions(text: Column, quote: str) -> Column:
    """Word-bounded, non-overlapping occurrences of a literal. Texts without it are told by a plain search."""
    return F.when(F.contains(text, F.lit(quote)), positions(text, bounded_pattern(quote))).otherwise(F.array().cast(_SPANS))


def overlapping_positions(text: Column, literal: str) -> Column:
    """Every occurrence of a literal, also those that overlap one another: its first character where the rest follows."""
    found = positions(text, re.escape(literal[0]) + (f"(?={re.escape(literal[1:])})" if len(literal) > 1 else ""))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), (x["start"] + len(literal)).alias("end")))


def selector_span(text: Column, quote: str, ordinal: Column | int) -> Column:
    """The occurrence of that ordinal (from 1), or null."""
    return F.try_element_at(quote_positions(text, quote), F.lit(ordinal) if isinstance(ordinal, int) else ordinal)


def context(text: Column, span: Column, width: int = 20) -> Column:
    """The code points before and after a span."""
    before = F.greatest(span["start"] - width, F.lit(0))
    return F.struct(F.substr(text, before + 1, span["start"] - before).alias("prefix"), F.substr(text, span["end"] + 1, F.lit(width)).alias("suffix"))


def utf16_offset(text: Column, offset: Column) -> Column:
    """The offset in UTF-16 code units of an offset in code points."""
    return (F.octet_length(F.encode(F.left(text, offset), "UTF-16BE")) / 2).cast("long")


def greedy_spans(spans: Column) -> Column:
    """Spans (``start``, ``end``, ``key``) that don't overlap: longest first, then earliest, then least key; in order of place."""
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct((x["start"] - x["end"]).alias("less"), x["start"].alias("start"), x["key"].alias("key"), x["end"].alias("end"))))
    none = F.filter(ranked, lambda x: F.lit(False))
    kept = F.aggregate(ranked, none, lambda acc, x: F.when(F.exists(acc, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])), acc).otherwise(F.concat(acc, F.array(x))))
    return F.array_sort(F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["key"].alias("key"))))


def snippet(text: Column, longest: int = 120) -> Column:
    return F.when(F.length(text) > longest, F.concat(F.left(text, F.lit(longest - 3)), F.lit("…"))).otherwise(text)


def bullets(text: Column) -> Column:
    """Sentences, without blank ones: each ends at a stop, question or exclamation mark, and quotes behind it, before white space and a capital, quote or bracket, so that "Neh. 1" stays whole."""
    parts = F.split(F.regexp_replace(text, r"""([.!?]["'”’)]*)[ \t\n\x0B\f\r]+(?=[A-Z“"'(])""", "$1\x01"), "\x01")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$", "")), lambda x: x != "")


def short_role(text: Column, longest: int = 42) -> Column:
    """What stands before the first stop or semicolon; if it is longer, that many characters, trimmed, and an ellipsis."""
    head = F.get(F.split(text, "[;.]"), 0)
    return F.when(F.length(head) > longest, F.concat(F.trim(F.left(head, F.lit(longest))), F.lit("…"))).otherwise(F.trim(head))


def humanize(slug: Column) -> Column:
    return F.initcap(F.translate(slug, "-_", "  "))


def like_escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\%_])", r"\\$1")


# The entities that comments may hold, in the order in which they are decoded, the patterns
# that mark prose taken from reference works, and what is left of markup and links.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"))
SOURCE_MARKERS = (
    r"(?i)\b(according to|encyclopedia|dictionary|lexicon|commentary|journal|"
    r"volume\s+\d+|press|publisher|wikidata|wikipedia|zondervan|nelson|"
    r"archaeolog|excavat|scholar|remains date|treatise|atlas|says)\b"
    r"|\(\s*(1[5-9]|20)\d{2}\s*\)"
)
LEFT_OVER = r"(?i)[<>]|https?://|www\."


def sanitize_comment(html: Column, longest: int = 200) -> Column:
    """Text with tags as blanks and entities decoded; null if it is blank, too long, holds a link or what is left of a tag, or reads like a reference work."""
    out = F.regexp_replace(html, "<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    out = F.trim(F.regexp_replace(out, r"[ \t\n\x0B\f\r]+", " "))
    return F.when((out != "") & (F.length(out) <= longest) & ~out.rlike(LEFT_OVER) & ~out.rlike(SOURCE_MARKERS), out)


def links(text: Column) -> Column:
    """References ``Book 1:2`` and ``Book 1:2–5`` in a text, as ``book.chapter.verse[-verse]``."""
    found = F.regexp_extract_all(text, F.lit(r"([A-Z][a-z]+) ([0-9]{1,3}):([0-9]{1,3})(?:[-–]([0-9]{1,3}))?"), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(F.lower(x), "[ :]", "."), "–", "-"))


# A fixed value: how prose refers to passages, by book and chapter ("Ezra 4:17–23", "Neh 1") or by verses of the passage at hand ("v10", "vv13–15", "vv13, 15").
PROSE_REFERENCE = r"\b([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)\s+(\d+)(?::(\d+)(?:\s*[–-]\s*(\d+))?)?|\bv{1,2}\.?(\d+(?:\s*,\s*\d+)*)(?:\s*[–-]\s*(\d+))?"


def linked_spans(text: Column, books: dict[str, str], book: Column, chapter: Column) -> Column:
    """``array<struct<text, key>>``: a text cut at its references, in order and whole.

    A reference with a book of ``books`` (name to code) has its own address; verses alone are of the passage's
    ``book`` and ``chapter``. Plain parts, and what looks like a reference to an unknown book, have a null key.
    """
    codes = F.create_map(*(F.lit(x) for pair in books.items() for x in pair)) if books else F.create_map().cast("map<string,string>")

    def number(x: Column) -> Column:
        return F.regexp_replace(F.trim(x), r"^0+(?=\d)", "")

    def key(found: Column) -> Column:
        name, chap, first, last, verses, end = (F.regexp_extract(found, PROSE_REFERENCE, k) for k in range(1, 7))
        code = F.element_at(codes, name)
        own = F.when(first == "", F.concat_ws(".", code, number(chap))).otherwise(F.concat_ws(".", code, number(chap), number(first)))
        absolute = F.when(last == "", own).otherwise(F.concat(own, F.lit("-"), F.concat_ws(".", code, number(chap), number(last))))
        listed = F.split(verses, ",")
        begin, stop = number(F.get(listed, 0)), F.when(end != "", number(end)).otherwise(number(F.element_at(listed, -1)))
        here = F.concat_ws(".", book, chapter.cast("string"), begin)
        relative = F.when(begin == stop, here).otherwise(F.concat(here, F.lit("-"), F.concat_ws(".", book, chapter.cast("string"), stop)))
        return F.when(name != "", F.when(code.isNotNull(), absolute)).otherwise(relative)

    def part(value: Column, link: Column) -> Column:
        return F.struct(value.alias("text"), link.alias("key"))

    gaps, found = F.split(text, PROSE_REFERENCE, -1), F.regexp_extract_all(text, F.lit(PROSE_REFERENCE), F.lit(0))
    pairs = F.zip_with(gaps, found, lambda gap, x: F.array(part(gap, F.lit(None).cast("string")), part(x, F.when(x.isNotNull(), key(x)))))
    return F.filter(F.flatten(pairs), lambda x: x["text"] != "")


# Words that, followed by "of" and a name or a list of names, make it a tribe, a people or a land.
TRIBE_HEADS = "half-tribe|tribes|tribe"
FAMILY_HEADS = "sons|children|descendants|house|people|men|stick|sticks|staff|staves|hand"
TERRITORY_HEADS = "land|lands|territory|territories|cities|city|mount|mountains|mountain|hills|borders|coasts|wilderness|fields|kingdom|kings|king"

#: What a list of names is written with; any other character ends a clause, and no list goes on over it.
_LISTED = r"[^A-Za-z'’\-\s,]"


def governed_spans(text: Column, heads: str, name: str) -> Column:
    """``array<struct<start, end>>``: from a head to a name that it governs: "the gates of Dor", "the gates of Gezer, Dor" and "the gates of Gezer and of Dor" for Dor.

    ``heads`` are words split by bars; the name is one word. A text is read word by word from each head with its "of" on: a
    head is remembered until the next word, "of" behind it opens a list, in the list a comma or "and" makes the next
    word a member, and whatever else comes closes it. Texts come in Arrow batches.
    """
    words = frozenset(heads.split("|"))
    letters = "A-Za-z'’\\-"
    runs = re.compile(f"[{letters}]+|[^{letters}]+")
    opener = re.compile(rf"(?:{heads})\s+of(?![{letters}])", re.ASCII)
    word_before = re.compile(f"[{letters}]")
    last_part = re.compile(rf"^.*['’\-]({heads})$")
    ends_clause = re.compile(_LISTED, re.ASCII)
    one_comma = re.compile(r"\s*,\s*", re.ASCII)
    behind_name = re.compile(r"['’\-]|$")

    def read(text: str) -> Iterator[dict[str, int]]:
        pos = 0
        while found := opener.search(text, pos):
            start, pos = found.start(), len(text)
            while start and word_before.match(text[start - 1]):
                start -= 1
            # open_: 0 behind a member, 1 where one must come, 2 behind an "and" or "of" that could be one
            head, begun, open_ = -1, -1, 0
            for m in runs.finditer(text, start):
                run = m[0]
                if not word_before.match(run):
                    if run != " " and ends_clause.search(run):
                        head, begun = -1, -1
                    elif "," in run:
                        begun = begun if open_ != 1 and one_comma.fullmatch(run) else -1
                        head, open_ = -1, 1
                elif run == "of" and head >= 0:
                    begun, head, open_ = head, -1, 1
                else:
                    member, joins = begun >= 0 and open_ > 0, run in ("and", "of")
                    head = m.start() if run in words else -1
                    # the last part of a word may be the head
                    if head < 0 and (part := last_part.match(run)):
                        head = m.start() + part.start(1)
                    if member:
                        head, open_ = (-1, 2) if joins else (head, 0)
                        if not joins and run.startswith(name) and behind_name.match(run, len(name)):
                            yield {"start": begun, "end": m.start() + len(name)}
                    elif run == "and":
                        open_ = 1
                    else:
                        begun, open_ = -1, 0
                if head < 0 and begun < 0 and m.end() >= found.end():
                    pos = m.end()
                    break

    def spans(text: str | None) -> list[dict[str, int]]:
        return list(read(text)) if text and name in text else []

    @F.arrow_udf(_SPANS)
    def governed(texts: pa.Array) -> pa.Array:
        return pa.array([spans(x) for x in texts.to_pylist()], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))

    return governed(text)


def people_spans(text: Column, name: str, peoples: tuple[str, ...] = ()) -> tuple[Column, Column]:
    """Spans in which a progenitor's name is his people's (his tribe, family words, "all", or their own names), and those in which it is their land's."""
    groups = [governed_spans(text, f"{TRIBE_HEADS}|{FAMILY_HEADS}", name), *(quote_positions(text, x) for x in (f"all {name}", *peoples))]
    return F.concat(*groups), governed_spans(text, TERRITORY_HEADS, name)


def sense(text: Column, names: tuple[str, ...], group: Column, territory: Column) -> Column:
    """``person``, ``group`` or ``territory``: what a text that names one of the names means by it, given the spans of group and territory.

    A mention that no such span covers is of the person, and wins. Else the text means the group where
    there is a group span, the territory where there is one of those, and the person where there is
    neither. Null where the text has no name and no span.
    """
    def placed(spans: Column, kind: int) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))

    def bare(spans: Column) -> Column:
        """In order of their starts, a span of either kind covers a mention if it is the one of those before it that reaches farthest and reaches its end: one pass, not all pairs."""
        ordered = F.array_sort(F.concat(placed(spans["group"], 0), placed(spans["land"], 0), placed(spans["said"], 1)))
        state = F.struct(F.lit(-1).alias("reach"), F.lit(False).alias("bare"))

        def step(acc: Column, x: Column) -> Column:
            known = x["kind"] == 0
            return F.struct(F.when(known, F.greatest(acc["reach"], x["end"])).otherwise(acc["reach"]).alias("reach"), (acc["bare"] | ~known & (acc["reach"] < x["end"])).alias("bare"))

        return F.aggregate(ordered, state, step, lambda acc: acc["bare"])

    def judged(spans: Column) -> Column:
        return F.when(bare(spans), "person").when(F.size(spans["group"]) > 0, "group").when(F.size(spans["land"]) > 0, "territory").when(F.size(spans["said"]) > 0, "person")

    said = F.concat(*(quote_positions(text, x) for x in names))
    return bound(F.struct(group.alias("group"), territory.alias("land"), said.alias("said")), judged)


# What keeps a nation's name a person's, as patterns, each with the characters before the name and
# after its beginning (besides its own length) in which it must be found (none: the whole text), and
# whether it is only for a name that isn't the nation's own.
PERSON_GUARDS = (
    (r"\b(?:son|sons|children|firstborn|seed|father|descended)\s+of\b", (40, None), False),
    (r"Israel shall be your name", None, False),
    (r"\bcalled Israel\b", None, False),
    (r"\bnamed Israel\b", None, False),
    (r"\bnamed Jacob\b", None, False),
    (r"\bGod of (?:Israel|Jacob)\b", (40, 0), True),
    (r"\b(?:My|His|Your|my|his|your)\s+servant\s+(?:Israel|Jacob)\b", (40, 0), True),
    (r"\b(?:Abraham|Isaac)\b", (40, 0), True),
    (r"\b(?:with|accompanied|along with)\b.{0,12}$", (40, None), False),
    (r"\bfather\b", (12, 12), False),
    (r"\b(?:wife|husband|married|marry|wedding)\b", (0, 16), False),
    (r"\b(?:fled|flee|fleeing|flight)\b", (16, 16), True),
)
UNCERTAIN = r"(?i)(?<![A-Za-z0-9_])(possib|probab|maybe|may be|uncertain|disputed|perhaps|likely the same|same as|identified with|either)(?![A-Za-z0-9_])"


def stays_person(text: Column, start: Column, length: int, own_name: bool = True) -> Column:
    """Whether the words around a name that is a nation's too say that it is a person's there. ``own_name``: whether it is the man's own name, for which there are further signs, or the nation's."""
    def holds(pattern: str, reach: tuple[int, int | None] | None) -> Column:
        if reach is None:
            return text.rlike(pattern)
        begin = F.greatest(start - reach[0], F.lit(0))
        stop = start if reach[1] is None else start + length + reach[1]
        return F.substr(text, begin + 1, stop - begin).rlike(pattern)

    found = F.lit(False)
    for pattern, reach, further in PERSON_GUARDS:
        if own_name or not further:
            found = found | holds(pattern, reach)
    return found


def uncertain(text: Column) -> Column:
    return text.rlike(UNCERTAIN)


def bounded_occurrences(text: Column, phrase: str) -> Column:
    """Every occurrence of a phrase between word bounds, also those that overlap one another."""
    rest = f"(?={re.escape(phrase[1:])}(?![{_WORD}]))"
    found = positions(text, f"(?<![{_WORD}]){re.escape(phrase[0])}{rest}")
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), (x["start"] + len(phrase)).alias("end")))


def quote_at(text: Column, quote: str, start: Column) -> Column:
    """A struct of ``ordinal``, ``start`` and the context of the occurrence that begins at a recorded offset, or else of the first; null without any."""
    def chosen(spans: Column) -> Column:
        at = F.array_position(F.transform(spans, lambda x: x["start"]), start.cast("int"))
        ordinal = F.greatest(F.coalesce(at, F.lit(0)), F.lit(1)).cast("int")
        span = F.try_element_at(spans, ordinal)
        around = context(text, span)
        return F.when(span.isNotNull(), F.struct(ordinal.alias("ordinal"), span["start"].alias("start"), around["prefix"].alias("prefix"), around["suffix"].alias("suffix")))

    return bound(quote_positions(text, quote), chosen)


def segments(text: Column, anchors: list[tuple[str, str, int]]) -> Column:
    """``array<struct<text, slug>>``: the text cut at anchors (phrase, slug, ordinal from 1); plain parts have a null slug. Of anchors that overlap the earliest stays, then the longest."""
    found = [F.struct(F.try_element_at(bounded_occurrences(text, phrase), F.lit(ordinal))["start"].alias("at"), F.lit(-len(phrase)).alias("less"), F.lit(slug).alias("slug")) for phrase, slug, ordinal in anchors]
    placed = F.array_sort(F.filter(F.array(*found), lambda x: x["at"].isNotNull()))
    kind = "struct<cursor:int,out:array<struct<text:string,slug:string>>>"

    def part(value: Column, slug: Column) -> Column:
        return F.array(F.struct(value.alias("text"), slug.alias("slug")))

    def step(acc: Column, x: Column) -> Column:
        plain = F.when(x["at"] > acc["cursor"], part(F.substr(text, acc["cursor"] + 1, x["at"] - acc["cursor"]), F.lit(None).cast("string"))).otherwise(F.array().cast("array<struct<text:string,slug:string>>"))
        taken = F.struct((x["at"] - x["less"]).alias("cursor"), F.concat(acc["out"], plain, part(F.substr(text, x["at"] + 1, -x["less"]), x["slug"])).alias("out"))
        return F.when(x["at"] < acc["cursor"], acc).otherwise(taken)

    def end(acc: Column) -> Column:
        tail = F.substr(text, acc["cursor"] + 1, F.length(text))
        return F.when(F.length(text) > acc["cursor"], F.concat(acc["out"], part(tail, F.lit(None).cast("string")))).otherwise(acc["out"])

    empty = F.struct(F.lit(0).alias("cursor"), F.array().cast("array<struct<text:string,slug:string>>").alias("out")).cast(kind)
    return F.aggregate(placed, empty, step, end)


def script_tokens(text: Column, block: str = r"\u0c00-\u0c7f") -> Column:
    """Runs of characters of one script block, Telugu's as it stands."""
    return F.regexp_extract_all(text, F.lit(f"[{block}]+"), F.lit(0))


def transliterated(text: Column, tokens: tuple[tuple[str, str], ...] = (("G-D", "GOD"), ("G-d", "God"))) -> Column:
    for token, word in tokens:
        text = F.replace(text, F.lit(token), F.lit(word))
    return text


def listed(numbers: Column, most: int = 12) -> Column:
    """The first numbers in order, and "among others" where there are more."""
    head = F.array_join(F.transform(F.slice(F.array_sort(numbers), 1, most), lambda x: x.cast("string")), ", ")
    return F.concat(head, F.when(F.size(numbers) > most, ", among others.").otherwise("."))


def attestation_kind(entity_type: Column) -> Column:
    return F.when(entity_type == "place", "location").otherwise("participant")


def search_cap(limit: int, most: int = 50) -> int:
    """How many hits a search may return: at least one, and never more than ``most``."""
    return min(max(int(limit), 1), most)
