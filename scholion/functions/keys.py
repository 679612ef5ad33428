"""References, keys and their grammars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(text: Column) -> Column:
    """Small letters and digits joined by single hyphens; ``x`` where nothing is left."""
    joined = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(joined, "^-+|-+$", ""), F.lit("")), F.lit("x"))


REFERENCE = r"^(?:([a-z_]+):)?([1-3]?[A-Za-z]+)\.([0-9]+)(?:\.([0-9]+)(?:-(?:([0-9]+)\.)?([0-9]+))?)?$"


def parse_reference(reference: Column) -> Column:
    """A struct of a reference ``[refsys:]Book.chapter[.verse[-[chapter.]verse]]`` and an error code, null if it is valid.

    Codes in order: ``empty``, ``grammar``, ``zero`` (chapters and verses count from 1), ``order`` (the
    range ends before it begins).
    """
    text = F.trim(F.coalesce(reference, F.lit("")))

    def group(k: int) -> Column:
        return F.nullif(F.regexp_extract(text, REFERENCE, k), F.lit(""))

    chapter, verse = group(3).cast("int"), group(4).cast("int")
    end_chapter, end_verse = F.coalesce(group(5).cast("int"), chapter), F.coalesce(group(6).cast("int"), verse)
    error = (
        F.when(text == "", "empty")
        .when(~text.rlike(REFERENCE), "grammar")
        .when((chapter == 0) | (F.coalesce(verse, F.lit(1)) == 0) | (end_chapter == 0) | (F.coalesce(end_verse, F.lit(1)) == 0), "zero")
        .when(F.struct(end_chapter, F.coalesce(end_verse, F.lit(0))) < F.struct(chapter, F.coalesce(verse, F.lit(0))), "order")
    )
    valid = error.isNull()
    parts = {"refsys": group(1), "book": group(2), "chapter": chapter, "verse": verse, "end_chapter": end_chapter, "end_verse": end_verse}
    return F.struct(*(F.when(valid, x).alias(n) for n, x in parts.items()), error.alias("error"))


def format_range(chapter: Column, verse: Column, end_chapter: Column, end_verse: Column) -> Column:
    """``2:1``, ``2:1–8`` or ``2:1–3:4``."""
    head = F.concat_ws(":", chapter.cast("string"), verse.cast("string"))
    tail = F.when(end_chapter != chapter, F.concat_ws(":", end_chapter.cast("string"), end_verse.cast("string"))).when(end_verse != verse, end_verse.cast("string"))
    return F.when(tail.isNull(), head).otherwise(F.concat(head, F.lit("–"), tail))


def ordinal_of(book: Column, chapter: Column, verse: Column) -> Column:
    """The global ordinal: books by millions, chapters by thousands."""
    return (book * 1_000_000 + chapter * 1_000 + verse).cast("long")


def scope_key(*parts: Column) -> Column:
    return F.lower(F.concat_ws(".", *parts))


def scope_kind(key: Column) -> Column:
    """``verse``, ``range`` or ``chapter`` by the shape of a local key; a range that ends where it begins is its chapter."""
    pair = F.split(key, "-")
    return (
        F.when(key.rlike(r"^[a-z0-9]+\.[0-9]+\.[0-9]+-[a-z0-9]+\.[0-9]+\.[0-9]+$"), F.when(F.get(pair, 0) == F.get(pair, 1), "chapter").otherwise("range"))
        .when(key.rlike(r"^[a-z0-9]+\.[0-9]+\.[0-9]+$"), "verse")
        .when(key.rlike(r"^[a-z0-9]+\.[0-9]+$"), "chapter")
    )


# Grammars of keys, by kind, and what a mapping between reference systems may be.
SYSTEMS = "eng-v22|tel-v1|tam-v1"
GRAMMARS = {
    "entity": r"^entity:[a-z0-9]+(-[a-z0-9]+)*$",
    "package": r"^pkg:[a-z0-9_]+$",
    "digest": r"^sha256:[0-9a-f]{64}$",
    "language": r"^[a-z]{2,3}(-[A-Z]{2})?$",
    "canon": r"^canon:prot-66$",
    "reference-system": rf"^refsys:({SYSTEMS})$",
    "work": r"^work:[A-Za-z1-9]+:prot-66$",
    "scope": rf"^scope:[a-z0-9-]+:refsys:({SYSTEMS}):[A-Za-z1-9]+\.[0-9]+(\.[0-9]+)?(-[A-Za-z1-9]+\.[0-9]+\.[0-9]+)?$",
    "translation-work": r"^trans:(bsb|tel_irv|tam_irv)$",
    "translation-edition": r"^edition:(bsb|tel_irv|tam_irv)@[0-9]{8}:sha-[0-9a-f]{8}$",
    "source": r"^source:[a-z0-9:.-]+$",
    "source-release": r"^release:source:[a-z0-9:.-]+@[a-z0-9._-]+:sha-[0-9a-f]{8,64}$",
    "candidate": rf"^candidate:(person|deity|event|place|collective|polity|role|object|structure|practice|institution|theme):refsys:({SYSTEMS}):[a-z0-9-]+$",
}
MAPPING_KINDS = ("equivalent", "split", "merge", "overlap", "renumbered", "omitted", "added", "uncertain")


def key_error(kind: str, key: Column) -> Column:
    """``empty``, ``invalid-`` and the kind, or null. A release that names a branch is invalid, since it can change."""
    trimmed = F.trim(key)
    wrong = ~trimmed.rlike(GRAMMARS[kind])
    if kind == "source-release":
        wrong = wrong | F.contains(trimmed, F.lit("branch")) | F.contains(trimmed, F.lit("main"))
    return F.when(key.isNull() | (trimmed == ""), "empty").when(wrong, f"invalid-{kind}")


def mapping_kind_valid(kind: Column) -> Column:
    return F.coalesce(kind.isin(*MAPPING_KINDS), F.lit(False))


def outline_entry(entry: Column) -> Column:
    """A struct of ``title``, ``start`` and ``end`` of an outline's ``Title (3-5)`` or ``Title (3)``; null for anything else."""
    pattern = r"^(.*)\(([0-9]+)(?:\s*[-–]\s*([0-9]+))?\)\s*$"
    start = F.regexp_extract(entry, pattern, 2).try_cast("int")
    end = F.coalesce(F.regexp_extract(entry, pattern, 3).try_cast("int"), start)
    return F.when(entry.rlike(pattern), F.struct(F.trim(F.regexp_extract(entry, pattern, 1)).alias("title"), start.alias("start"), end.alias("end")))


def short_range(value: Column) -> Column:
    """``Neh.2.1–Neh.2.8`` as ``2:1–8``; what doesn't lie in one chapter, without the book alone."""
    compact = F.regexp_replace(value, r"[1-3]?[A-Za-z]+\.", "")
    pattern = r"^([0-9]+)\.([0-9]+)(?:–([0-9]+)\.([0-9]+))?$"
    chapter, verse, last_chapter, last = (F.nullif(F.regexp_extract(compact, pattern, k), F.lit("")) for k in (1, 2, 3, 4))
    inside = compact.rlike(pattern) & (chapter == F.coalesce(last_chapter, chapter))
    return F.when(inside, F.concat(chapter, F.lit(":"), verse, F.lit("–"), F.coalesce(last, verse))).otherwise(compact)


def server_location(translation: Column, book: Column, chapter: Column, known: str = "bsb") -> Column:
    """``Book.chapter`` of the one translation that syncs, or null."""
    return F.when((translation == known) & (book != "") & (chapter >= 1), F.concat_ws(".", book, chapter.cast("string")))


def local_coordinates(location: Column) -> Column:
    """A struct of ``book`` and ``chapter`` of a server's location, or null."""
    pattern = r"^([1-3]?[A-Za-z]+)\.([0-9]+)$"
    return F.when(location.rlike(pattern), F.struct(F.regexp_extract(location, pattern, 1).alias("book"), F.regexp_extract(location, pattern, 2).cast("int").alias("chapter")))


def display_name(friendly: Column) -> Column:
    """A name without the number that tells it from others of that name."""
    return F.regexp_replace(friendly, r"\s+[0-9]+$", "")
