"""Readers of the file formats of curated content: explicit schemas, and failures before anything is parsed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOOK = "osis string, name string, chapters array<struct<n:int,blocks:array<struct<t:string,n:int,text:string>>>>"
PLACE = "id string, friendly_id string, comment string, identifications array<struct<id:string>>, extra string"
PERSON = ("person_id", "person_name", "unique_attribute", "tribe", "person_notes")
PERSON_VERSE = ("person_id", "reference_id", "person_label")
RELATIONSHIP = ("person_id_1", "person_id_2", "relationship_type", "relationship_category", "reference_id")


def read_books(spark: SparkSession, path: str, order: DataFrame) -> DataFrame:
    """All book files under a path, with their canon order (``osis``, ``position``); books without one come last."""
    books = spark.read.schema(BOOK).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return books.join(F.broadcast(order), "osis", "left").withColumn("position", F.coalesce("position", F.lit(10**6)))


def flatten_books(books: DataFrame) -> DataFrame:
    """(book, chapter, verse, text) of the verse blocks."""
    chapters = books.select(F.col("osis").alias("book"), F.inline("chapters"))
    blocks = chapters.select("book", F.col("n").alias("chapter"), F.inline("blocks"))
    return blocks.filter("t = 'v'").select("book", "chapter", F.col("n").alias("verse"), "text")


def as_books(turns: DataFrame) -> DataFrame:
    """Conversations in the shape of books, of one chapter each: what ``flatten_books`` undoes."""
    blocks = F.array_sort(F.collect_list(F.struct(F.col("turn").alias("n"), F.col("kind").alias("t"), "text")))
    grouped = turns.groupBy(F.col("conv_id").alias("osis")).agg(blocks.alias("blocks"))
    return grouped.select("osis", F.array(F.struct(F.lit(1).alias("n"), "blocks")).alias("chapters"))


def _csv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """A headed CSV by column name, whatever the order of its columns; a byte order mark is dropped, and missing columns fail."""
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    found = found.toDF(*(x.removeprefix("\ufeff").strip() for x in found.columns))
    if missing := [x for x in columns if x not in found.columns]:
        raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    return found.select(*(F.trim(x).alias(x) for x in columns))


def read_persons(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Persons with an id whose names aren't excluded."""
    named = F.coalesce("person_name", F.lit(""))
    return _csv(spark, path, PERSON).filter((F.coalesce("person_id", F.lit("")) != "") & ~F.array_contains(F.lit(list(excluded)).cast("array<string>"), named))


def read_person_verses(spark: SparkSession, path: str, persons: DataFrame) -> DataFrame:
    """(person_id, refs, labels): the verses ``code.chapter.verse`` and labels of each known person, from references ``CODE c:v``."""
    pattern = r"^([1-3]?[A-Za-z]+) ([0-9]+):([0-9]+)$"
    parts = [F.regexp_extract("reference_id", pattern, k) for k in (1, 2, 3)]
    rows = _csv(spark, path, PERSON_VERSE).filter(F.col("reference_id").rlike(pattern)).join(persons, "person_id", "left_semi")
    return rows.groupBy("person_id").agg(F.array_sort(F.collect_set(F.concat_ws(".", *parts))).alias("refs"), F.array_sort(F.collect_set("person_label")).alias("labels"))


def read_relationships(spark: SparkSession, path: str, vocabulary: DataFrame) -> DataFrame:
    """Edges whose type the vocabulary (``relationship_type``, ``predicate``) knows."""
    return _csv(spark, path, RELATIONSHIP).join(F.broadcast(vocabulary), "relationship_type").select(F.col("person_id_1").alias("subject_id"), "predicate", F.col("person_id_2").alias("object_id"), "reference_id")


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """(place_id, slug, comment, refs, identified): places of a JSON Lines file, with the references in the JSON text of ``extra``."""
    from scholion.functions.keys import slugify
    from scholion.functions.text import sanitize_comment

    rows = spark.read.schema(PLACE).option("mode", "FAILFAST").json(path)
    refs = F.from_json("extra", "osises array<string>")["osises"]
    return rows.select(F.col("id").alias("place_id"), slugify(F.regexp_replace("friendly_id", r"\s+[0-9]+$", "")).alias("slug"), sanitize_comment(F.col("comment")).alias("comment"), F.coalesce(refs, F.array().cast("array<string>")).alias("refs"), F.transform("identifications", lambda x: x["id"]).alias("identified"))


def _checked(content: Column, expected: str) -> Column:
    return F.when(F.sha2(content, 256) == expected.removeprefix("sha256:"), content).otherwise(F.raise_error(F.lit(f"digest-mismatch: expected {expected}")))


def read_verified(spark: SparkSession, path: str, expected: str) -> DataFrame:
    """(path, text) of a file whose bytes have the expected SHA-256; any other fails."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode(_checked(F.col("content"), expected), "UTF-8").alias("text"))


def lines_with_header(files: DataFrame, header: str) -> DataFrame:
    """(path, line_number, line) of verified files that hold the header; without it they fail."""
    text = F.when(F.contains("text", F.lit(header)), F.col("text")).otherwise(F.raise_error(F.lit(f"header-missing: {header}")))
    return files.select("path", F.posexplode(F.split(text, r"\r?\n"))).select("path", (F.col("pos") + 1).alias("line_number"), F.col("col").alias("line"))


def xml_tokens(files: DataFrame, tag: str = "w") -> DataFrame:
    """(path, tokens): how many elements of a tag each verified XML file opens."""
    return files.select("path", F.regexp_count("text", F.lit(rf"<{tag}(?=[\s/>])")).alias("tokens"))


def by_kind(files: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """(path, kind): the first kind whose key a JSON file has at its top; null for none."""
    found = F.coalesce(*(F.when(F.array_contains(F.json_object_keys("text"), key), kind) for key, kind in kinds.items()))
    return files.select("path", found.alias("kind"))


def translation_map(books: DataFrame) -> DataFrame:
    """(book, chapter, verse, text) with one row for each address: what a translation says there."""
    return flatten_books(books).groupBy("book", "chapter", "verse").agg(F.min("text").alias("text"))


def verse_text(books: DataFrame, book: str, chapter: int, verse: int | None = None) -> DataFrame:
    """A chapter's verses, or one of them."""
    found = flatten_books(books.filter(F.col("osis") == book)).filter(F.col("chapter") == chapter)
    return found if verse is None else found.filter(F.col("verse") == verse)


def without_identified(places: DataFrame) -> DataFrame:
    """Places that no other place is identified as."""
    taken = places.select(F.explode("identified").alias("place_id")).distinct()
    return places.join(taken, "place_id", "left_anti")


def person_extras(persons: DataFrame) -> DataFrame:
    """(person_id, slug, notes, uncertain) of persons; whose notes doubt who they are is uncertain."""
    from scholion.functions.keys import slugify
    from scholion.functions.text import uncertain

    notes = F.concat_ws(" ", "person_notes", "unique_attribute")
    return persons.select("person_id", F.concat(F.lit("p-"), slugify(F.col("person_id"))).alias("slug"), notes.alias("notes"), uncertain(notes).alias("uncertain"))


DATASET = "chapter struct<number:int,content:array<struct<type:string,number:int,content:variant>>>"


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """(path, chapter, t, n, text) of a raw dataset's chapter files: headings and verses, whose content mixes strings and objects with a text."""
    from scholion.functions.text import mixed_text

    rows = spark.read.schema(DATASET).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.col("_metadata.file_path").alias("path"), F.col("chapter.number").alias("chapter"), F.posexplode("chapter.content").alias("place", "block"))
    kind = F.when(F.col("block.type") == "heading", "h").when(F.col("block.type") == "verse", "v")
    return rows.select("path", "chapter", "place", kind.alias("t"), F.col("block.number").alias("n"), mixed_text(F.col("block.content")).alias("text")).filter("t IS NOT NULL")


def order_from_source(files: DataFrame, expected: int) -> DataFrame:
    """(osis, testament, position) from a registry's source text; fails unless it has as many books as expected."""
    pattern = r"osis:\s*'([A-Za-z1-9]+)'[^}]*?testament:\s*'(OT|NT)'"
    found = F.regexp_extract_all("text", F.lit(pattern), F.lit(0))
    checked = F.when(F.size(found) == expected, found).otherwise(F.raise_error(F.concat(F.lit(f"expected {expected} books, found "), F.size(found).cast("string"))))
    return files.select(F.posexplode(checked).alias("position", "x")).select(F.regexp_extract("x", pattern, 1).alias("osis"), F.regexp_extract("x", pattern, 2).alias("testament"), (F.col("position") + 1).alias("position"))


def first_available(*sources: Callable[[], DataFrame]) -> DataFrame:
    """The rows of the first source that can be read and has any; of the last one otherwise. The driver decides, before a job is planned."""
    for source in sources[:-1]:
        try:
            found = source()
            if not found.isEmpty():
                return found
        except Exception:  # noqa: BLE001  whatever keeps a source from being read, the next one is asked
            continue
    return sources[-1]()
