"""Cases that reviews found: odd rows and larger tables against the oracles' SQL."""

from __future__ import annotations

import shutil
import time
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq

from scholion.plans import registry
from tests.oracle import connect, rows_of_spark, rows_of_sql



def tables(sf: str, folder: Path, **own: pa.Table) -> str:
    """A copy of the smallest tables in which some are replaced."""
    for path in Path(sf).glob("*.parquet"):
        if path.stem not in own:
            shutil.copy(path, folder)
    for name, table in own.items():
        pq.write_table(table, folder / f"{name}.parquet")
    return str(folder)


def documents(texts: list[str | None], ids: list[int] | None = None) -> pa.Table:
    return pa.table({"doc_id": pa.array(ids or range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(texts), "source": ["web"] * len(texts), "n_chars": pa.array([len(x or "") for x in texts], pa.int64())})


def same(spark, sf_dir: str, name: str) -> list[tuple]:
    names, rows = rows_of_spark(registry.queries()[name](spark, sf_dir))
    assert (names, rows) == rows_of_sql(connect(sf_dir), registry.oracle_sql()[name])
    return rows


def test_nation_guards_where_the_text_has_the_letters_itself(spark, sf, tmp_path):
    texts = [x for said in ("de mirrar. Jacobo de doja", "Jacobo that is", "all that is with that Jacobo", "married that wife", None, "none") for x in [said] * 4]
    rows = same(spark, tables(sf, tmp_path, documents=documents(texts, [*range(len(texts))])), "nation_guards")
    assert {x for _, x in rows} == {True, False}


def test_senses_of_texts_of_many_mentions(spark, sf, tmp_path):
    """Texts of thousands of mentions, whose pairs of mentions and spans would be millions, and lists in all their forms."""
    forms = ("the of that. ", "house-the of x and that's; ", "the of a, b and of that. ", "the\tof x,\nthat; ", "is of a and that. ", "that. ", "the house. ")
    texts = [f"{a}{b}" for a in forms for b in forms] + ["the of that. " * 20_000, "is of that; " * 20_000 + "that", None, ""]
    folder = tables(sf, tmp_path, documents=documents(texts))
    assert {x for _, x in same(spark, folder, "sense_classify")} == {"person", "group", "territory"}
    same(spark, folder, "curation_build")
    began = time.perf_counter()
    same(spark, folder, "tribe_senses")
    assert time.perf_counter() - began < 60


def test_identity_splits_broadcast_no_table_that_grows(spark, sf):
    from scholion.plans.canons import identity_splits

    plan = identity_splits(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_identity_splits_of_entities_that_share_names(spark):
    from scholion.operators import canon

    registry = spark.createDataFrame([(f"e{k}", ("Old Dan", "old dan", "Dan", None)[k % 4]) for k in range(40)], "entity_key string, preferred_name string")
    locked = spark.createDataFrame([("entity:dan",), ("entity:old-dan",), ("entity:x",), ("entity:",)], "entity_key string")
    found = {x: y for x, y in canon.identity_splits(locked, registry, 3).collect()}
    assert found == {"entity:dan": ["e0", "e1", "e10"], "entity:old-dan": ["e0", "e1", "e12"]}


NEEDLES = ["a", "a a", "-a", "a.", "b-b", "é", "x é", "12", " ", "aé"]
SAID = ["a a a a", "-a a. b-b-b b-bb", "xa a é x é aé", "12-12 a12", "", None, "a", "--a..", "b-b-b-b"]


def test_literals_by_both_ways(spark, monkeypatch):
    """Few literals go to all tasks, many join in a shuffle: both find the same places."""
    from scholion.operators import needles

    docs = spark.createDataFrame(list(enumerate(SAID)), "doc_id long, text string")
    known = spark.createDataFrame([(x,) for x in NEEDLES], "needle string")
    key = lambda rows: sorted(map(tuple, rows))
    few = [key(needles.find(docs, known).collect()), key(needles.find_leftmost(docs, known, width=2).collect())]
    monkeypatch.setattr(needles, "BROADCAST", 0)
    many = [key(needles.find(docs, known).collect()), key(needles.find_leftmost(docs, known, width=2).select("doc_id", "needle", "ordinal", "start", "end", "prefix", "suffix").collect())]
    assert few == many and len(few[0]) > len(few[1]) > 10
    assert all(SAID[doc][start:end] == needle for doc, needle, start, end in few[0])


def test_names_are_matched_without_a_shuffle_of_words(spark, sf):
    from scholion.plans.aliases import alias_hits

    plan = alias_hits(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan


def test_blocks_of_queries_are_small_whatever_their_number():
    import numpy as np

    from scholion.llm.negatives import BLOCK_BYTES, pieces

    for width in (1, 64, 100_000):
        parts = list(pieces(np.arange(10_000), width))
        assert np.array_equal(np.concatenate(parts), np.arange(10_000))
        assert all(len(x) == 1 or 4 * width * len(x) <= BLOCK_BYTES for x in parts)


def test_only_frequent_phrases_leave_their_segments(spark, monkeypatch):
    """Where the bitmap lets every phrase through, as it does the more, the more there are, rows are still those of the frequent ones."""
    import numpy as np

    from scholion.llm import phrases

    full = lambda keys: np.full(1 << phrases.BITMAP - 6, 2**64 - 1, np.uint64)
    made, texts_of = [], phrases._texts_of

    def counted(*args):
        found = texts_of(*args)
        made.append(sorted(x.phrase for x in found.collect()))
        return found

    monkeypatch.setattr(phrases, "bitmap", full)
    monkeypatch.setattr(phrases, "_texts_of", counted)
    rows = [("en", "one two three four"), ("en", "one two three")] * 3 + [("en", f"x{k} y{k} z{k}") for k in range(500)]
    got = phrases.mine_phrases(spark.createDataFrame(rows, "lang string, text string"), least=4).collect()
    assert [tuple(x)[:7] for x in got] == [("en", 1, "one two three", 6, 6, 6, 1521)]
    assert made == [["one two", "one two three", "two three"]]


def test_bitmap_takes_two_parts_of_a_key(spark):
    import numpy as np

    from scholion.llm import phrases

    keys = [1 << 40 | 5, -(1 << 50) | 77, 0, -1]
    bits = phrases.bitmap(spark.createDataFrame([(k,) for k in keys], "key long"))
    assert phrases.in_bitmap(bits, np.array(keys, np.int64).view(np.uint64)).all()
    assert not phrases.in_bitmap(bits, np.array([1 << 40 | 6, 1 << 45 | 5, -(1 << 50) | 78], np.int64).view(np.uint64)).any()


def test_batteries_check_all_pointers_by_one_aggregation(spark, sf):
    """No join or sort for each pointer, whose memory adds up in a task, and no sort of all findings for a verdict."""
    plan = registry.queries()["battery_verdict"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "LeftAnti" not in plan
    same(spark, sf, "battery_verdict")


def test_batteries_of_keys_that_play_several_parts(spark):
    """One key may be known to one authority and not to another, and be pointed to by several records."""
    from scholion.operators import packages

    make = lambda schema, *found: spark.createDataFrame(list(found), schema)
    package = {
        "candidates": make("candidate_key string", ("a",), ("a",), ("b",)),
        "claims": make("claim_key string, subject_key string, citation_keys array<string>", ("b", "a", ["b", "a", None]), ("c", "b", None), ("d", None, [])),
        "relevance": make("relevance_key string, entity_key string, scope_key string", ("r", "b", "b")),
        "coverage": make("annotation_class string, group_id string, result string, refs array<string>, record_keys array<string>, question_keys array<string>", (packages.CLASSES["canonical"], "g", "done", ["a", None, "c"], ["a", "z"], ["a"]), ("x", "h", "done", ["q"], ["q"], ["q"])),
    }
    job = {"entity": make("k string", ("a",), (None,)), "reference": make("k string", ("a",), ("b",), ("b",), (None,))}
    found = sorted(map(tuple, packages.battery("canonical", package, job).collect()))
    assert found == [
        ("/candidates", "a", "duplicate"),
        ("/claims/citation_keys", "a", "undefined-citation"), ("/claims/citation_keys", "b", "undefined-citation"), ("/claims/subject_key", "b", "unresolved-entity"),
        ("/coverage", "a", "undefined-question"), ("/coverage", "b", "gap"), ("/coverage", "c", "outside"), ("/coverage", "h", "wrong-class"), ("/coverage", "z", "undefined-record"),
        ("/relevance/entity_key", "b", "unresolved-entity"),
    ]


def test_senses_are_checked_without_joins(spark, sf):
    """One shuffle (and one of the distinct quotes) deals all facts by verse and entity into as many parts as there are, so a task's memory is that of its part."""
    plan = registry.queries()["canon_senses"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 2 and "REPARTITION_BY_NUM" in plan
    same(spark, sf, "canon_senses")


def test_spot_checks_of_odd_rows(spark):
    """Null keys and quotes, expectations that repeat or contradict, several quotes of which one is enough, and mentions of another table."""
    from scholion.operators import canon

    kinds = "reference_key long, entity_key long"
    seen = spark.createDataFrame([(1, 1, "N"), (1, 1, "N"), (1, 2, None), (None, 3, "N"), (2, 2, "A"), (2, 2, "B")], f"{kinds}, quote string")
    expected = spark.createDataFrame([(1, 1, False), (1, 1, False), (1, 1, True), (9, 9, True), (9, 9, True), (None, 3, True), (None, 3, False), (1, 2, None)], f"{kinds}, wanted boolean")
    quotes = spark.createDataFrame([(1, 1, "N"), (1, 2, "N"), (1, 2, None), (2, 2, "x"), (2, 2, "B"), (None, 3, "N"), (7, 7, "N")], f"{kinds}, quote string")
    senses = [("1>1", "displaced"), ("1>1", "displaced"), ("3", "missing"), ("9>9", "missing"), ("9>9", "missing")]
    key = lambda found: sorted((x.key, x.finding) for x in found.collect())
    assert key(canon.spot_checks(seen, expected)) == senses
    assert key(canon.spot_checks(seen, expected, seen, quotes)) == sorted([*senses, ("1>2", "quote"), ("3", "quote"), ("7>7", "quote")])
    assert key(canon.spot_checks(seen, expected, seen.filter("quote <> 'B'"), quotes)) == sorted([*senses, ("1>2", "quote"), ("2>2", "quote"), ("3", "quote"), ("7>7", "quote")])
