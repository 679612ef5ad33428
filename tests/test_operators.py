"""Operators on small fixtures: one case for each rule."""

import datetime
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from scholion.operators import checks, gate, joins, merge, ordinals
from scholion.sources import readers, sinks


def frame(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_ordinals_match_row_number_across_buckets(spark):
    df = spark.range(100).selectExpr("id % 3 AS k", "id * 7 AS o")
    got = ordinals.ordinal_within(df, ["k"], "o", "n", bucket=50)
    want = df.selectExpr("*", "row_number() OVER (PARTITION BY k ORDER BY o) AS n")
    assert rows(got.select("k", "o", "n")) == rows(want)


def test_band_join_matches_between(spark):
    points = spark.range(200).selectExpr("id % 2 AS k", "id AS p")
    spans = frame(spark, "k long, a long, b long", (0, 0, 10), (0, 60, 140), (1, 63, 64), (1, 5, 5))
    got = joins.band_join(points, spans, ["k"], "p", "a", "b", width=16)
    want = points.join(spans, "k").filter("p BETWEEN a AND b")
    assert rows(got.select("k", "p", "a", "b")) == rows(want.select("k", "p", "a", "b"))


def test_either_semi_keeps_each_row_once(spark):
    df = frame(spark, "a int, b int", (1, 1), (1, 2), (3, 1), (3, 4), (None, 1))
    ids = frame(spark, "x int", (1,), (1,))
    assert rows(joins.either_semi(df, ["a", "b"], ids)) == rows(df.filter("a = 1 OR b = 1"))


def test_replay_is_a_no_op(spark):
    target = frame(spark, "k int, v string", (1, "a"))
    incoming = frame(spark, "k int, v string", (1, "b"), (2, "c"), (2, "c"))
    once = merge.insert_ignore(target, incoming, ["k"])
    assert rows(once) == [(1, "a"), (2, "c")] and rows(merge.insert_ignore(once, incoming, ["k"])) == rows(once)
    up = merge.upsert(target, incoming.distinct(), ["k"])
    assert rows(up) == [(1, "b"), (2, "c")] and rows(merge.upsert(up, incoming.distinct(), ["k"])) == rows(up)
    assert rows(merge.upsert(target, incoming.distinct(), ["k"], guarded=frame(spark, "k int", (1,)))) == [(1, "a"), (2, "c")]


def test_op_log_ties_go_to_the_remove(spark):
    t = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    ops = frame(spark, "k int, op string, ts timestamp", (1, "add", t[0]), (1, "remove", t[0]), (2, "add", t[1]), (2, "remove", t[0]), (3, "remove", t[2]), (4, "add", None))
    got = {r["k"]: (r["active"], r["pending"]) for r in merge.fold_op_log(ops, ["k"]).collect()}
    assert got == {1: (False, 0), 2: (True, 0), 3: (False, 0), 4: (False, 1)}


def test_pull_merge_keeps_the_earliest_and_applies_tombstones(spark):
    t = [datetime.datetime(2024, 1, d) for d in (1, 2, 3)]
    local, remote = frame(spark, "k int, created_at timestamp", (1, t[1]), (2, t[0])), frame(spark, "k int, created_at timestamp", (1, t[0]), (3, t[2]))
    dead = frame(spark, "k int, deleted_at timestamp", (2, t[0]), (3, t[1]))
    assert rows(merge.pull_merge(local, remote, dead, ["k"])) == [(1, t[0]), (3, t[2])]


def test_changed_keys(spark):
    before, after = frame(spark, "k int, v string", (1, "a"), (2, None), (3, "c")), frame(spark, "k int, v string", (1, "a"), (2, "x"), (4, "d"))
    assert rows(merge.changed_keys(before, after, ["k"])) == [(2, "changed"), (3, "removed")]


GOOD = "sha256:" + "0" * 64
BASE = dict(release_key="r", component_key="c", operation="show", territory="IN", language=None, day=datetime.date(2024, 1, 5))
GRANT = dict(release_key="r", component_key="c", operation="show", state="allowed", territory="IN", language=None, effective_from=datetime.date(2024, 1, 1), effective_to=datetime.date(2024, 1, 9))


@pytest.mark.parametrize(
    ("request_change", "grant_change", "release", "approval", "denial"),
    [
        ({}, {}, ("verified", GOOD, GOOD), ("approved", GOOD), None),
        ({"release_key": "q"}, {}, ("verified", GOOD, GOOD), ("approved", GOOD), "invalid-release"),
        ({}, {}, ("invalid", GOOD, GOOD), ("approved", GOOD), "invalid-release"),
        ({}, {}, ("verified", "x", GOOD), ("approved", GOOD), "digest-not-bound"),
        ({}, {}, ("verified", GOOD, "sha256:0"), ("approved", GOOD), "digest-not-bound"),
        ({"operation": "print"}, {}, ("verified", GOOD, GOOD), ("approved", GOOD), "no-grant"),
        ({"component_key": "d"}, {}, ("verified", GOOD, GOOD), ("approved", GOOD), "no-grant"),
        ({}, {"state": "unknown"}, ("verified", GOOD, GOOD), ("approved", GOOD), "grant-denied"),
        ({"day": datetime.date(2023, 12, 31)}, {}, ("verified", GOOD, GOOD), ("approved", GOOD), "grant-expired"),
        ({"day": datetime.date(2024, 1, 10)}, {}, ("verified", GOOD, GOOD), ("approved", GOOD), "grant-expired"),
        ({"territory": "US"}, {}, ("verified", GOOD, GOOD), ("approved", GOOD), "territory-mismatch"),
        ({"territory": None}, {}, ("verified", GOOD, GOOD), ("approved", GOOD), "territory-mismatch"),
        ({}, {"language": "ta"}, ("verified", GOOD, GOOD), ("approved", GOOD), "language-mismatch"),
        ({}, {}, ("verified", GOOD, GOOD), ("rejected", GOOD), "no-approval"),
        ({}, {}, ("verified", GOOD, GOOD), ("approved", "old"), "digest-not-bound"),
    ],
)
def test_each_denial(spark, request_change, grant_change, release, approval, denial):
    ask, grant = BASE | request_change, GRANT | grant_change
    requests = frame(spark, "request_id int, release_key string, component_key string, operation string, territory string, language string, day date", (1, *ask.values()))
    grants = frame(spark, "release_key string, component_key string, operation string, state string, territory string, language string, effective_from date, effective_to date", tuple(grant.values()))
    releases = frame(spark, "release_key string, status string, artifact_digest string, evidence_digest string", ("r", *release))
    approvals = frame(spark, "release_key string, component_key string, decision string, digest string, created_at int", ("r", "c", "approved", GOOD, 0), ("r", "c", *approval, 1))
    assert gate.authorize(requests, releases, grants, approvals).first()["denial"] == denial


def test_one_licence_for_mixed_components(spark):
    components = frame(spark, "release string, evidence string, paths string", ("a", "e", "p"), ("a", "e", "q"), ("b", "e", "p"), ("b", "e", "p"), ("c", "e", "p"), ("c", "f", "q"), ("d", "e", "p"))
    assert rows(checks.mixed_licences(components, "release", "evidence", "paths")) == [("a", 2, 2)]


def test_rows_by_caller(spark):
    table = frame(spark, "package_id int, owner_id int", (1, 7), (2, 8))
    published = frame(spark, "package_id int, locale string", (1, "en"))
    seen = {role: rows(gate.visible_rows(table, role, published, 8)) for role in ("anon", "authenticated", "owner", "service", "other")}
    assert seen == {"anon": [(1, 7)], "authenticated": [(1, 7)], "owner": [(2, 8)], "service": [(1, 7), (2, 8)], "other": []}
    assert rows(gate.visible_rows(table, "anon")) == []
    for role, privileged, error in (("anon", True, "public"), ("importer", False, "importer"), ("editor", True, "importer")):
        with pytest.raises(PermissionError, match=error):
            gate.assert_can_import(role, privileged)
    gate.assert_can_import("service_role", True)


def test_snapshots(spark):
    df = frame(spark, "lang string", ("en",), ("xx",), (None,))
    assert rows(checks.outside_snapshot(df, "lang", frame(spark, "tag string", ("en",)), "/language")) == [("/language", "xx")]
    assert rows(checks.outside_snapshot(df, "lang", None, "/language")) == [] and checks.unknown_columns(df, ["key"]) == ["lang"]


@pytest.mark.parametrize("change", ["none", "future", "rights", "release", "rejected", "stale"])
def test_the_gate_needs_every_condition(spark, change):
    day = datetime.datetime
    packages = frame(spark, "package_id int, locale string, published_at timestamp, rights_cleared boolean, digest string", (1, "en", day(2025, 1, 1) if change == "future" else day(2024, 1, 1), change != "rights", "d"))
    releases = frame(spark, "package_id int, active boolean", (1, change != "release"))
    last = ("rejected", "d") if change == "rejected" else ("approved", "old" if change == "stale" else "d")
    approvals = frame(spark, "package_id int, approval_id int, decision string, subject_digest string, created_at timestamp", (1, 1, "approved", "d", day(2023, 1, 1)), (1, 2, *last, day(2023, 1, 2)))
    assert gate.published_packages(packages, releases, approvals, day(2024, 6, 1)).count() == (change == "none")


@pytest.mark.parametrize(
    ("row", "finding"),
    [((1, "complete_zero", 1, None), "contradictory-zero"), ((1, "complete_with_records", 0, None), "missing-records"), ((1, "blocked", 0, None), "blocked-without-question"), ((9, "complete_zero", 0, None), "outside")],
)
def test_each_coverage_finding(spark, row, finding):
    groups = frame(spark, "reference int, result string, n_records int, question string", row, (2, "complete_zero", 0, None))
    authority = frame(spark, "reference int", (1,), (2,))
    want = [(9, "outside"), (1, "gap")] if finding == "outside" else [(1, finding)]
    assert rows(checks.coverage_findings(groups, authority)) == sorted(want, key=repr)


def test_publish_skips_what_is_there_and_keeps_what_fails_out(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    df = frame(spark, "k int, v string", (1, "a"), (2, None))
    assert sinks.publish(df, root) and not sinks.publish(df.orderBy(F.desc("k")), root)
    with pytest.raises(ValueError, match="not published"):
        sinks.publish(df.limit(1), root, findings=lambda x: x)
    assert rows(sinks.read_current(spark, root)) == rows(df)
    assert sinks.publish(df.limit(1), root) and sinks.read_current(spark, root).count() == 1


def test_of_two_writers_one_fails(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    a, b, c = (frame(spark, "k int", (k,)) for k in range(3))
    assert sinks.publish(a, root)
    known = sinks.current_version(spark, root)[1]
    assert sinks.publish(b, root, expected=known)
    with pytest.raises(sinks.Conflict):
        sinks.publish(c, root, expected=known)
    assert rows(sinks.read_current(spark, root)) == rows(b) and len(list((tmp_path / "v/versions").iterdir())) == 2
    # while one writer checks its rows, another publishes
    def overtaken(tables):
        sinks.publish(a, root)
        return tables["rows"].limit(0)

    with pytest.raises(sinks.Conflict):
        sinks.publish_tables({"rows": c}, root, findings=overtaken)
    assert rows(sinks.read_current(spark, root)) == rows(a)


def test_tables_are_published_together_and_orphans_recovered(spark, tmp_path):
    root = f"file://{tmp_path}/v"
    first, second = ({"a": frame(spark, "k int", (k,)), "b": frame(spark, "v string", (str(k),))} for k in (1, 2))
    assert sinks.publish_tables(first, root) and not sinks.publish_tables(first, root)
    with pytest.raises(ValueError, match="not published"):
        sinks.publish_tables(second, root, findings=lambda tables: tables["b"])
    assert {k: rows(v) for k, v in sinks.read_tables(spark, root).items()} == {"a": [(1,)], "b": [("1",)]}
    # a writer that died after its first table, and one before its pointer had its name
    second["a"].write.parquet(f"{root}/versions/dead/a")
    (tmp_path / "v/pointer/_half").write_text("{")
    assert sinks.recover(spark, root) == []
    assert sinks.recover(spark, root, idle_seconds=-60) == ["pointer/_half", "versions/dead"]
    assert sinks.publish_tables(second, root) and sinks.publish_tables(first, root)
    assert len(sinks.recover(spark, root, keep=1, idle_seconds=-60)) == 4 and rows(sinks.read_tables(spark, root)["a"]) == [(1,)]


def test_earlier_rows_can_be_published_again(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    a, b = frame(spark, "k int, v string", (1, "a"), (1, "a"), (2, None)), frame(spark, "k int, v string", (1, "a"), (2, None))
    assert sinks.publish(a, root)
    first = sinks.read_current(spark, root)
    assert sinks.publish(b, root) and sinks.publish(a, root) and not sinks.publish(a, root)
    assert rows(first) == rows(a) == rows(sinks.read_current(spark, root)) and sinks.current_version(spark, root)[1] == 3
    assert not sinks.drifted(a, root) and sinks.drifted(b, root)


def test_manifests_and_caches(spark):
    df = frame(spark, "f string, text string", ("x", "a"), ("x", "bé"), ("y", None))
    got = {r["file"]: (r["rows"], r["bytes"], r["digest"]) for r in sinks.manifest(df, F.col("f")).collect()}
    again = {r["file"]: r["digest"] for r in sinks.manifest(df.orderBy(F.desc("text")), F.col("f")).collect()}
    assert got["x"][:2] == (2, 4) and got["y"][:2] == (1, 0) and {k: v[2] for k, v in got.items()} == again and got["x"][2] != got["y"][2]
    cache = frame(spark, "scope string, schema_version int, document string", ("s", 1, "old"), ("t", 1, "kept"))
    after = sinks.cached_documents(cache, frame(spark, "scope string, document string", ("s", "new")), ["scope"], 2)
    assert rows(sinks.readable_documents(after, 2)) == [("s", 2, "new")] and rows(sinks.readable_documents(after, 1)) == [("t", 1, "kept")]
    assert sinks.rendered(frame(spark, "o int, k string", (2, "b"), (1, "a")), "o", F.format_string("  '%s',", "k"), "[", "]") == "[\n  'a',\n  'b',\n]\n"


def test_more_readers(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps({"chapter": {"number": 1, "content": [{"type": "heading", "content": ["A  head"]}, {"type": "verse", "number": 1, "content": ["In ", {"text": "the  start"}, {"noteId": 3}]}, {"type": "line_break"}]}}))
    assert rows(readers.read_dataset(spark, str(tmp_path / "1.json")).select("chapter", "t", "n", "text")) == [(1, "h", None, "A head"), (1, "v", 1, "In the start")]
    source = frame(spark, "text string", ("{ osis: 'Gen', x: 1, testament: 'OT' }, { osis: 'Mat', testament: 'NT' }",))
    assert rows(readers.order_from_source(source, 2)) == [("Gen", "OT", 1), ("Mat", "NT", 2)]
    with pytest.raises(Exception, match="expected 3 books"):
        readers.order_from_source(source, 3).collect()
    places = frame(spark, "place_id string, identified array<string>", ("a", ["b"]), ("b", []), ("c", []))
    assert rows(readers.without_identified(places).select("place_id")) == [("a",), ("c",)]
    persons = frame(spark, "person_id string, person_notes string, unique_attribute string", ("A 1", "perhaps his son", None), ("B", None, "king"))
    assert rows(readers.person_extras(persons).select("slug", "uncertain")) == [("p-a-1", True), ("p-b", False)]
    books = readers.as_books(frame(spark, "conv_id string, turn int, kind string, text string", ("Gen", 1, "v", "one"), ("Gen", 2, "v", "two")))
    assert rows(readers.verse_text(books, "Gen", 1, 2)) == [("Gen", 1, 2, "two")] and readers.translation_map(books).count() == 2
    assert rows(readers.first_available(lambda: spark.read.parquet(f"{tmp_path}/none"), lambda: places.limit(0), lambda: places.select("place_id"))) == [("a",), ("b",), ("c",)]


def test_slices_that_come_back_empty_are_cleared(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace_slices(frame(spark, "k int, v string", (1, "a"), (2, "c")), path, ["k"])
    sinks.replace_slices(frame(spark, "k int, v string", (1, "x")), path, ["k"], cleared=[{"k": 2}])
    assert rows(spark.read.parquet(path).select("k", "v")) == [(1, "x")]


def test_slices_are_replaced_whole(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace_slices(frame(spark, "k int, v string", (1, "a"), (1, "b"), (2, "c")), path, ["k"])
    sinks.replace_slices(frame(spark, "k int, v string", (1, "x")), path, ["k"])
    assert rows(spark.read.parquet(path).select("k", "v")) == [(1, "x"), (2, "c")]


@pytest.mark.parametrize("name", ["", "/etc/x", "../x", "a/../../x", "a\\b"])
def test_unsafe_names(name):
    with pytest.raises(ValueError, match="unsafe"):
        sinks.safe_path("/root", name)


def test_verified_reads(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"HEAD v1\r\n<w id='1'/><w>\n<word/>")
    good = hashlib.sha256((tmp_path / "a.txt").read_bytes()).hexdigest()
    files = readers.read_verified(spark, str(tmp_path / "a.txt"), f"sha256:{good}")
    assert [r["line"] for r in readers.lines_with_header(files, "HEAD").collect()] == ["HEAD v1", "<w id='1'/><w>", "<word/>"]
    assert readers.xml_tokens(files).first()["tokens"] == 2
    with pytest.raises(Exception, match="header-missing"):
        readers.lines_with_header(files, "OTHER").collect()
    with pytest.raises(Exception, match="digest-mismatch"):
        readers.read_verified(spark, str(tmp_path / "a.txt"), "0" * 64).collect()


def test_books_places_and_persons(spark, tmp_path):
    (tmp_path / "b.json").write_text(json.dumps({"osis": "Gen", "name": "G", "chapters": [{"n": 1, "blocks": [{"t": "h", "text": "head"}, {"t": "v", "n": 1, "text": "one"}]}]}))
    books = readers.read_books(spark, str(tmp_path / "b.json"), frame(spark, "osis string, position int", ("Gen", 1)))
    assert rows(readers.flatten_books(books)) == [("Gen", 1, 1, "one")]
    (tmp_path / "p.jsonl").write_text(json.dumps({"id": "p1", "friendly_id": "Old Town 2", "comment": "<b>x</b>", "identifications": [{"id": "i1"}], "extra": json.dumps({"osises": ["Gen.1.1"]})}))
    assert rows(readers.read_places(spark, str(tmp_path / "p.jsonl"))) == [("p1", "old-town", "x", ["Gen.1.1"], ["i1"])]
    (tmp_path / "n.csv").write_text("﻿person_id,person_name,unique_attribute,tribe,person_notes\n a , Ann ,,,\n,none,,,\n")
    persons = readers.read_persons(spark, str(tmp_path / "n.csv"))
    assert [r["person_name"] for r in persons.collect()] == ["Ann"]
    (tmp_path / "v.csv").write_text("person_id,reference_id,person_label\na,GEN 1:2,Ann\na,bad,x\nz,GEN 1:3,Z\n")
    assert rows(readers.read_person_verses(spark, str(tmp_path / "v.csv"), persons)) == [("a", ["GEN.1.2"], ["Ann"])]
    with pytest.raises(ValueError, match="lacks columns"):
        readers.read_persons(spark, str(tmp_path / "v.csv"))


def test_streamed_ops_end_in_the_batch_state(spark, sf, tmp_path):
    from scholion.sources import bind
    from scholion.streaming import oplog

    ops = bind.op_log(spark, sf)
    for k in range(3):
        ops.filter(F.col("seq") % 3 == k).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    root, names = f"file://{tmp_path}/state", ["user_id", "k", "added_at", "deleted_at", "active"]
    for _ in range(2):  # the second run finds nothing new
        oplog.run(spark, f"file://{tmp_path}/in", root, f"file://{tmp_path}/cp").awaitTermination()
    want = rows(merge.fold_op_log(ops, oplog.KEYS).select(*names))
    assert rows(oplog.state(spark, root).select(*names)) == want
    last = oplog.compact(spark, root)
    assert rows(oplog.state(spark, root).select(*names)) == want and not [x for x in (tmp_path / "state/deltas").iterdir() if x.name.startswith("batch=")]
    # a later batch writes the states of its own keys, and no others
    later = frame(spark, oplog.SCHEMA, (1, 10**6, 10**9, "add", datetime.datetime(2030, 1, 1)))
    later.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    oplog.run(spark, f"file://{tmp_path}/in", root, f"file://{tmp_path}/cp").awaitTermination()
    delta = spark.read.parquet(f"{root}/deltas").filter(F.col("batch") > last)
    assert rows(delta.select("user_id", "k")) == [(1, 10**6)]
    assert rows(oplog.state(spark, root).select(*names)) == rows(merge.fold_op_log(ops.unionByName(later), oplog.KEYS).select(*names))
    assert oplog.compact(spark, root) > last and oplog.state(spark, root).count() == len(want) + 1


def ledger(spark, registry, applied):
    sha = lambda sql: "sha256:" + hashlib.sha256(sql.encode()).hexdigest()
    found = merge.ledger_actions(frame(spark, "version int, name string, sql string", *registry), frame(spark, "version int, name string, sql_sha256 string", *((v, n, sha(x) if x else "md5:0") for v, n, x in applied)))
    return dict(rows(found))


def test_a_ledger_goes_in_order_and_stops_at_the_first_drift(spark):
    registry = [(3, "0003_c", "c"), (1, "0001_init", "a"), (4, "0004_d", "d"), (2, "0002_b", "b")]
    assert ledger(spark, registry, [(1, "0001_init", "a")]) == {1: "skip", 2: "apply", 3: "apply", 4: "apply"}
    assert ledger(spark, registry, [(1, "0001_init", "a"), (3, "0003_c", "changed")]) == {1: "skip", 2: "apply", 3: "ledger-drift", 4: "blocked"}
    assert ledger(spark, registry, [(1, "other", "a"), (3, "0003_c", "changed")]) == {1: "ledger-drift", 2: "blocked", 3: "blocked", 4: "blocked"}
    assert ledger(spark, [], []) == {}


@pytest.mark.parametrize(("entry", "error"), [((0, "a", "x"), "invalid-version"), ((5, "Bad Name", "x"), "invalid-name"), ((5, "", "x"), "invalid-name"), ((5, "a", " "), "empty-migration"), ((5, "a", None), "empty-migration"), ((1, "b", "x"), "duplicate-version")])
def test_one_invalid_migration_stops_all(spark, entry, error):
    got = ledger(spark, [(1, "a", "x"), (2, "b", "y"), entry], [(1, "a", "drift")])
    want = {2: "blocked", entry[0]: error} if error == "duplicate-version" else {1: "blocked", 2: "blocked", entry[0]: error}
    assert got == want


def test_a_damaged_ledger_stops_all(spark):
    assert ledger(spark, [(1, "a", "x"), (2, "b", "y")], [(1, "a", "x"), (9, "z", None)]) == {1: "blocked", 2: "blocked", 9: "ledger-invalid"}
    assert ledger(spark, [(1, "a", "x")], [(1, "a", "x"), (1, "a", "x")])[1] in ("blocked", "ledger-invalid")


@pytest.mark.parametrize("bucket", [1, 7, 1000])
def test_segmented_scans_match_windows(spark, bucket):
    df = spark.range(400).selectExpr("id % 3 AS k", "CAST(id * 5 AS BIGINT) AS o", "IF(id % 11 = 4 OR id % 7 = 1, id, NULL) AS v")
    got = ordinals.carried_within(ordinals.islands_within(df, ["k"], "o", F.col("v").isNotNull(), "i", bucket), ["k"], "o", F.col("v"), "c", bucket)
    want = df.selectExpr("*", "sum(IF(v IS NOT NULL, 1, 0)) OVER (PARTITION BY k ORDER BY o) AS i", "last_value(v) IGNORE NULLS OVER (PARTITION BY k ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS c")
    assert rows(got.select("k", "o", "v", "i", "c")) == rows(want)


def test_least_values_of_a_key(spark):
    df = frame(spark, "k int, v int", (1, 3), (1, 1), (1, 1), (1, 2), (2, 5), (2, 5))
    assert rows(ordinals.first_distinct(df, ["k"], "v", 2)) == [(1, [1, 2], True), (2, [5], False)]


def battery(spark, layer, package, job=None):
    make = lambda tables: {k: frame(spark, schema, *values) for k, (schema, *values) in tables.items()}
    from scholion.operators import packages

    return [tuple(x) for x in rows(packages.battery(layer, make(package), make(job or {})))]


CANONICAL = {
    "candidates": ("candidate_key string", ("c1",)),
    "reconciliations": ("candidate_key string, entity_key string", ("c1", "e1"), (None, "e2"), ("c9", "e9")),
    "claims": ("claim_key string, subject_key string, citation_keys array<string>", ("k1", "e1", ["t1"]), ("k2", "e2", []), ("k3", "e9", ["t2"]), ("k4", "e4", [])),
    "citations": ("citation_key string, claim_keys array<string>, evidence_key string", ("t1", ["k1", "k7"], "v1")),
    "relevance": ("relevance_key string, scope_key string", ("r1", "s1")),
}


def test_absent_approvals_are_closed_and_absent_snapshots_open(spark):
    closed = battery(spark, "canonical", CANONICAL)
    assert closed == [
        ("/citations/claim_keys", "k7", "undefined-claim"),
        ("/citations/evidence_key", "v1", "undefined-evidence"),
        ("/claims/citation_keys", "t2", "undefined-citation"),
        ("/claims/subject_key", "e4", "unresolved-entity"),
        ("/claims/subject_key", "e9", "unresolved-entity"),
        ("/reconciliations/candidate_key", "c9", "unknown-candidate"),
    ]
    job = {"entity": ("k string", ("e4",)), "claim": ("k string", ("k7",)), "evidence": ("k string", ("v1",)), "scope": ("k string", ("s2",))}
    assert battery(spark, "canonical", CANONICAL, job) == [("/claims/citation_keys", "t2", "undefined-citation"), ("/claims/subject_key", "e9", "unresolved-entity"), ("/reconciliations/candidate_key", "c9", "unknown-candidate"), ("/relevance/scope_key", "s1", "outside-authority")]


def test_only_the_canonical_layer_vouches_for_itself(spark):
    mentions = {"mentions": ("mention_key string, attestation_key string, claim_keys array<string>", ("m1", "a1", ["k1"])), "claims": ("claim_key string", ("k1",)), "questions": ("question_key string, record_key string", ("q1", "q1"))}
    assert battery(spark, "edition", mentions) == [("/mentions/attestation_key", "a1", "undefined-attestation"), ("/mentions/claim_keys", "k1", "undefined-claim"), ("/questions/record_key", "q1", "unknown-record")]
    assert battery(spark, "canonical", {"questions": mentions["questions"]}) == []


def test_a_package_fails_for_the_gravest(spark):
    from scholion.operators import packages

    error = lambda *found: rows(packages.verdict(frame(spark, "finding string", *((x,) for x in found))))
    assert error() == [] and error("outside-authority", "unknown-candidate", "overlap") == [("invalid-state",)]
    assert error("overlap", "duplicate") == [("duplicate",)] and error("duplicate", "unknown-record") == [("dangling",)]


DRAFT = {"schema_version": "1.0.0", "package_kind": "entity-profile-draft", "records": [{"record_key": "a", "record_kind": "p", "entity_key": "e", "language_tag": "en", "more": 1}], "open_questions": [], "editorial_observations": []}
RECORD = DRAFT["records"][0]


@pytest.mark.parametrize(
    ("change", "status"),
    [
        ({}, "accepted"),
        ("{", "invalid-json"), ("null", "invalid-json"), (None, "invalid-json"), ("[]", "schema-violation"), ("3", "schema-violation"),
        ({"records": {}}, "invalid-json"), ({"records": [None]}, "invalid-json"), ({"records": []}, "schema-violation"), ({"records": 3}, "schema-violation"),
        ({"records": [RECORD, RECORD]}, "duplicate-key"), ({"records": [{"record_kind": "p"}, {"record_kind": "q"}]}, "duplicate-key"),
        ({"records": [{"record_key": "a"}]}, "schema-violation"), ({"records": [{**RECORD, "record_key": ""}]}, "schema-violation"), ({"records": [{**RECORD, "record_key": 7}]}, "schema-violation"),
        ({"schema_version": "1.0"}, "schema-violation"), ({"schema_version": 1}, "schema-violation"), ({"extra": 1}, "schema-violation"), ({"open_questions": {}}, "schema-violation"), ({"editorial_observations": None}, "schema-violation"),
        ({"package_kind": ""}, "schema-violation"), ({"package_kind": "x"}, "package-kind"),
        ({"records": [{**RECORD, "entity_key": ""}]}, "missing-key"), ({"records": [{**RECORD, "language_tag": "te"}]}, "missing-key"),
    ],
)
def test_submissions(spark, change, status):
    from scholion.operators import packages

    said = json.dumps({**DRAFT, **change}) if isinstance(change, dict) else change
    assert frame(spark, "raw string", (said,)).select(packages.submission_status("raw", ("entity-profile-draft",), "en")).first()[0] == status
