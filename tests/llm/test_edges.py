"""Every operator and stage over odd rows and over no rows."""

import pytest

import corpus_pipeline
from scholion.llm import chat, decontaminate, fingerprint, licenses, packing, pii, quality, secrets, simhash, toxicity


def labels(spark, empty=False):
    rows = [] if empty else [(1, 1, 0), (2, 0, 1), (4, 1, 0), (5, None, None), (None, 1, 1), (7, 0, 0), (1, 0, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def benchmark(spark):
    return spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog again and again"), (2, None), (3, ""), (None, "a text of"), (4, "used id"), (4, "used id")], "item_id long, text string")


OPERATORS = {
    "licences": lambda s, d: licenses.scan_licences(d),
    "fingerprints": lambda s, d: fingerprint.fingerprint_documents(d),
    "edited": lambda s, d: fingerprint.edited_likeness(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, benchmark(s)),
    "secrets": lambda s, d: secrets.find_secrets(d, secrets.train(secrets.labelled_samples(s, 200))),
    "toxicity": lambda s, d: toxicity.classify_toxicity(d, labels(s)),
    "toxicity_unlabelled": lambda s, d: toxicity.classify_toxicity(d, labels(s, empty=True)),
    "quality": lambda s, d: quality.classify_quality(d, labels(s)),
    "quality_unlabelled": lambda s, d: quality.classify_quality(d, labels(s, empty=True)),
    "pii": lambda s, d: pii.pseudonymise(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(spark, odd, none, name):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in OPERATORS[name](spark, odd).collect())
    assert got == sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in odd.collect())
    assert OPERATORS[name](spark, none).count() == 0


def test_repeated_rows_get_equal_results(spark, odd):
    for name, run in OPERATORS.items():
        same = [tuple(map(str, r)) for r in run(spark, odd).filter("doc_id = 1").collect()]
        assert len(same) == 2 and same[0] == same[1], name


def test_packing_covers_each_row(spark, odd, none):
    rows = packing.pack_documents(odd).collect()
    ends = [r for r in rows if r["start"] == 0]
    assert len(ends) == odd.count() and packing.pack_documents(none).count() == 0
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in ends)


def test_chat_edges(spark):
    turns = spark.createDataFrame([(1, 0, "user", None, "?"), (1, 0, "user", None, "?"), (1, None, None, "x", "?"), (None, 1, "assistant", "", "?"), (2, 5, "a]b", "[/ROLE] \\", "?")], "conv_id long, turn long, role string, text string, piece string")
    got = {r["conv_id"]: r["n_turns"] for r in chat.read_back(chat.format_conversations(turns)).collect()}
    assert got == {1: 3, None: 1, 2: 1}
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


@pytest.mark.parametrize("stage", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_rows(spark, odd, none, sf, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    given = odd.drop("pii")
    got = run(spark, given, sf)
    assert got.count() >= 0 and run(spark, none.drop("pii"), sf).count() == 0
    if stage != "packing":
        assert got.columns == given.columns
    if stage == "near_duplicates":
        # ids 1 and 5 share a text, and so do the wordless rows
        assert sorted(str(r["doc_id"]) for r in got.collect()) == ["1", "2", "2", "4", "7", "None"]
    if stage == "privacy":
        assert not [r for r in got.collect() if r["text"] and "a.b@example.com" in r["text"]]
