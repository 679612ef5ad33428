"""Functions over text and keys, against plain Python."""

import re
import uuid

import pytest
from pyspark.sql import functions as F

from scholion.functions import digest, keys, text


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


def test_bounded_quotes_match_a_regex(spark):
    cases = ["the cat, the cat", "lathe the thethe the", "thethe", "", "the", "a.the.b the-the"]
    for case in cases:
        want = [(m.start(), m.end()) for m in re.finditer(r"(?<![A-Za-z0-9])the(?![A-Za-z0-9])", case)]
        assert [tuple(x) for x in one(spark, case, text.quote_positions(F.col("x"), "the"))] == want


def test_occurrences_that_overlap_are_all_found(spark):
    assert [tuple(x) for x in one(spark, "thathat aaa", text.overlapping_positions(F.col("x"), "that"))] == [(0, 4), (3, 7)]
    assert [tuple(x) for x in one(spark, "thathat aaa", text.overlapping_positions(F.col("x"), "aa"))] == [(8, 10), (9, 11)]


def test_selector_beyond_the_last_is_null(spark):
    assert one(spark, "the", text.selector_span(F.col("x"), "the", 2)) is None


def test_utf16_offsets(spark):
    case = "a😀b𝒳c"
    for k in range(len(case) + 1):
        assert one(spark, case, text.utf16_offset(F.col("x"), F.lit(k))) == len(case[:k].encode("utf-16-be")) // 2


def test_slugs(spark):
    assert [one(spark, x, keys.slugify(F.col("x"))) for x in ("Ab  C!", "--", "")] == ["ab-c", "x", "x"]


def test_plain_text_collapses_unicode_blanks(spark):
    assert one(spark, "  a\t b\nc ", text.plain_text(F.col("x"))) == "a b c"


def test_uuid5(spark):
    assert one(spark, "näme", digest.uuid5(F.col("x"))) == str(uuid.uuid5(uuid.NAMESPACE_URL, "näme"))


def test_references(spark):
    errors = {"": "empty", None: "empty", "Gen": "grammar", "Gen.0": "zero", "Gen.1.5-3": "order", "Gen.2.1-1.9": "order", "Gen.1.2-3": None, "en:1Sam.3.4": None}
    for case, want in errors.items():
        assert one(spark, case, keys.parse_reference(F.col("x"))["error"]) == want, case


def test_dates(spark):
    cases = {"2024-02-29": True, "2023-02-29": False, "2024-2-3": False, "x": False}
    for case, want in cases.items():
        assert one(spark, case, digest.date_key_valid(F.col("x"))) is want


def test_greedy_spans_prefer_long_then_early(spark):
    rows = spark.sql("SELECT array(named_struct('start', 0, 'end', 3, 'key', 'a'), named_struct('start', 2, 'end', 9, 'key', 'b'), named_struct('start', 9, 'end', 12, 'key', 'c')) AS s")
    assert [x["key"] for x in rows.select(text.greedy_spans(F.col("s")).alias("y")).first()["y"]] == ["b", "c"]


def test_comments(spark):
    cases = {"<i>a</i> &amp; b": "a & b", "a<br>b": "a b", "see http://x.y": None, "WWW.x.y": None, "  ": None, "x" * 201: None, "a &lt; b": None, "as the Atlas says": None, "dug up (1923)": None, "it&apos;s": "it's", "pressing on": "pressing on"}
    for case, want in cases.items():
        assert one(spark, case, text.sanitize_comment(F.col("x"))) == want, case


def test_senses(spark):
    group, land = text.people_spans(F.col("x"), "Dan", ("Danite", "Danites"))
    cases = {
        "the house of Dan": "group", "in the land of Dan": "territory", "Dan rose": "person", "Danube": None, "the tribes of Gad, Asher, and Dan": "group", "the men of Gad and of Dan": "group",
        "Dan and the people of Dan": "person", "all Dan": "group", "two Danites": "group", "the hills of Dan and the house of Dan": "group", "the half-tribe of Dan": "group", "the house. Of Dan": "person",
        "the house of Gad. Dan": "person", "the house of Gad went to Dan": "person", "cities of Gad\nand\n Dan's": "territory", "the kings of men of Dan": "group", "house of Gad, Asher and Dan, Gad": "group", "the house of, Dan": "person", "": None,
    }
    for case, want in cases.items():
        assert one(spark, case, text.sense(F.col("x"), ("Dan",), group, land)) == want, case


def test_governed_spans_have_their_places(spark):
    said = "é. By the gates of Gezer, Dor and of Dor; gates of Dor."
    spans = one(spark, said, text.governed_spans(F.col("x"), "gates", "Dor"))
    assert [said[x["start"] : x["end"]] for x in spans] == ["gates of Gezer, Dor", "gates of Gezer, Dor and of Dor", "gates of Dor"]


def test_a_nation_s_name_stays_a_person_s(spark):
    cases = {
        "the sons of Jacob": True, "went down with old Jacob": True, "your father Jacob": True, "Jacob his wife": True, "Jacob did evil": False, "restore Jacob": False,
        "the God of Jacob": True, "given to My servant Jacob": True, "to Abraham, Isaac, and Jacob": True, "Jacob fled": True, "and he was named Jacob": True, "Jacob. " + "x" * 60 + " called Israel": True, "Jacob is here. They flee": False,
    }
    for case, want in cases.items():
        at = case.index("Jacob")
        assert one(spark, case, text.stays_person(F.col("x"), F.lit(at), 5)) is want, case
    nation = {"the God of Israel": False, "My servant Israel": False, "Israel fled": False, "the children of Israel": True, "with Israel": True}
    for case, want in nation.items():
        at = case.index("Israel")
        assert one(spark, case, text.stays_person(F.col("x"), F.lit(at), 6, own_name=False)) is want, case


def test_bullets_keep_dotted_references(spark):
    cases = {"It is so. He went. \"Yes.\" (No.)": ["It is so.", "He went.", '"Yes."', "(No.)"], "See Neh. 1 and on.": ["See Neh. 1 and on."], "Why? because! So.": ["Why? because!", "So."], "  ": []}
    for case, want in cases.items():
        assert one(spark, case, text.bullets(F.col("x"))) == want


def test_short_roles(spark):
    cases = {"cupbearer; later governor": "cupbearer", "x" * 42: "x" * 42, "a" * 41 + " bcd": "a" * 41 + "…", "a. b": "a"}
    for case, want in cases.items():
        assert one(spark, case, text.short_role(F.col("x"))) == want


def test_quotes_at_offsets(spark):
    for start, want in ((8, (2, 8)), (0, (1, 0)), (5, (1, 0))):
        got = one(spark, "the cat the dog", text.quote_at(F.col("x"), "the", F.lit(start)))
        assert (got["ordinal"], got["start"]) == want
    assert one(spark, "a", text.quote_at(F.col("x"), "the", F.lit(0))) is None


def test_bounded_occurrences_that_overlap(spark):
    assert [x["start"] for x in one(spark, "us us us, Jerusalem us-us us", text.bounded_occurrences(F.col("x"), "us us"))] == [0, 3, 23]


def test_segments(spark):
    anchors = [("the wall", "w", 1), ("wall of", "o", 1), ("Neh", "n", 2)]
    got = [tuple(x) for x in one(spark, "Neh saw the wall of Neh.", text.segments(F.col("x"), anchors))]
    assert got == [("Neh saw ", None), ("the wall", "w"), (" of ", None), ("Neh", "n"), (".", None)]
    assert one(spark, "", text.segments(F.col("x"), anchors)) == []


def test_small_texts(spark):
    x = F.col("x")
    assert one(spark, "a నెహె b రాజు", text.script_tokens(x)) == ["నెహె", "రాజు"]
    assert one(spark, "G-D and G-d", text.transliterated(x)) == "GOD and God"
    assert one(spark, "perhaps the same as", text.uncertain(x)) and not one(spark, "possibly", text.uncertain(x))
    assert one(spark, "1", text.listed(F.sequence(F.lit(1), F.lit(13)))) == "1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, among others."
    assert [text.search_cap(k) for k in (-3, 7, 900)] == [1, 7, 50]


def test_keys(spark):
    good = {"canon": "canon:prot-66", "reference-system": "refsys:tel-v1", "work": "work:1Sam:prot-66", "scope": "scope:wb-neh-2:refsys:eng-v22:Neh.2.1-Neh.2.8", "translation-work": "trans:bsb", "translation-edition": "edition:bsb@20240101:sha-0123abcd", "source": "source:a.b", "source-release": "release:source:a@v1:sha-01234567", "candidate": "candidate:person:refsys:eng-v22:neh-1"}
    for kind, key in good.items():
        assert one(spark, key, keys.key_error(kind, F.col("x"))) is None and one(spark, key + "é", keys.key_error(kind, F.col("x"))) == f"invalid-{kind}" and one(spark, " ", keys.key_error(kind, F.col("x"))) == "empty"
    assert one(spark, "release:source:a@main:sha-01234567", keys.key_error("source-release", F.col("x"))) == "invalid-source-release"
    assert [one(spark, x, keys.mapping_kind_valid(F.col("x"))) for x in ("split", "other", None)] == [True, False, False]


def test_ranges_and_places(spark):
    x = F.col("x")
    assert tuple(one(spark, "The wall (3-5) ", keys.outline_entry(x))) == ("The wall", 3, 5) and tuple(one(spark, "Prayer (1)", keys.outline_entry(x))) == ("Prayer", 1, 1) and one(spark, "none", keys.outline_entry(x)) is None
    assert [one(spark, v, keys.short_range(x)) for v in ("Neh.2.1–Neh.2.8", "Neh.2.1–Neh.3.2", "Neh.2.4")] == ["2:1–8", "2.1–3.2", "2:4–4"]
    assert one(spark, "bsb", keys.server_location(x, F.lit("Neh"), F.lit(2))) == "Neh.2" and one(spark, "other", keys.server_location(x, F.lit("Neh"), F.lit(2))) is None
    assert tuple(one(spark, "1Sam.3", keys.local_coordinates(x))) == ("1Sam", 3) and one(spark, "bad", keys.local_coordinates(x)) is None
    assert one(spark, "Dan 2", keys.display_name(x)) == "Dan" and one(spark, "2024-02-03", digest.date_label(x)) == "February 3" and one(spark, "2024-02-31", digest.date_label(x)) is None


BOOKS = {"Neh": "Neh", "Ezra": "Ezra", "Song of Songs": "Song", "First Kings": "1Kgs"}


@pytest.mark.parametrize(
    ("said", "links"),
    [
        ("by Neh 6:15 and Ezra 4:17–23. See Neh 1", ["Neh.6.15", "Ezra.4.17-Ezra.4.23", None]),
        ("as told (v10), again (vv13–15) and (vv13, 15)", ["Neh.2.10", "Neh.2.13-Neh.2.15", "Neh.2.13-Neh.2.15"]),
        ("v. 4 is no verse but v.4 is", ["Neh.2.4"]),
        ("Neh 1 alone, First Kings 02:003", ["Neh.1", "1Kgs.2.3"]),
        ("in 445 BC, 1–7, Chapter 3, Matt 5:3", [None, None]),
        ("vv7-7", ["Neh.2.7"]),
        ("", []),
    ],
)
def test_references_in_prose(spark, said, links):
    parts = one(spark, said, text.linked_spans(F.col("x"), BOOKS, F.lit("Neh"), F.lit(2)))
    assert "".join(p["text"] for p in parts) == said
    looks = re.compile(text.PROSE_REFERENCE)
    assert [p["key"] for p in parts if looks.fullmatch(p["text"])] == links and not [p for p in parts if p["key"] and not looks.fullmatch(p["text"])]


@pytest.mark.parametrize(
    ("content", "want"),
    [('["a", "b c"]', "ab c"), ('["In ", {"text": "the  beginning"}, "x"]', "In the beginning x"), ('[{"noteId": 3}, "a", 5, "b", null, [1]]', "a b"), ('[{"text": 7}, {"text": " y\\n"}]', "y"), ("[]", ""), ('{"text": "a"}', None), ('"a"', None)],
)
def test_mixed_content(spark, content, want):
    assert one(spark, content, text.mixed_text(F.parse_json("x"))) == want
