"""Batteries of findings over layered packages, jobs, chapters, bundles and submissions.

A package is a dict of record tables by name, one row for each record, with pointers to other records
as columns or arrays of keys. A battery is a table of rules: which keys must be unique, which
pointers must be known to which authorities, and how coverage must partition them. Each finding is
a row (``pointer``, ``key``, ``finding``); all pointers are checked by one aggregation on keys, and all
findings are collected before anything fails.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholion.operators import checks

#: (record, key) that must be unique, by layer.
UNIQUE = {
    "canonical": (("candidates", "candidate_key"), ("claims", "claim_key"), ("citations", "citation_key"), ("attestations", "attestation_key"), ("relationships", "relationship_key"), ("events", "event_key"), ("relevance", "relevance_key"), ("questions", "question_key")),
    "edition": (("mentions", "mention_key"),),
    "locale": (("contexts", "context_key"), ("profiles", "profile_key"), ("localizations", "localization_key"), ("questions", "question_key")),
}
#: (record, pointer column, authority, finding), by layer. A pointer may be an array.
POINTERS = {
    "canonical": (
        ("reconciliations", "candidate_key", "candidate", "unknown-candidate"),
        ("claims", "subject_key", "entity", "unresolved-entity"), ("claims", "object_key", "entity", "unresolved-entity"), ("claims", "object_scope", "scope", "outside-authority"), ("claims", "citation_keys", "citation", "undefined-citation"),
        ("citations", "claim_keys", "claim", "undefined-claim"), ("citations", "evidence_key", "evidence", "undefined-evidence"),
        ("attestations", "entity_key", "entity", "unresolved-entity"), ("attestations", "claim_keys", "claim", "undefined-claim"),
        ("relationships", "subject_key", "entity", "unresolved-entity"), ("relationships", "object_key", "entity", "unresolved-entity"), ("relationships", "claim_keys", "claim", "undefined-claim"), ("relationships", "scope_keys", "scope", "outside-authority"),
        ("events", "participant_keys", "entity", "unresolved-entity"), ("events", "place_keys", "entity", "unresolved-entity"), ("events", "scope_keys", "scope", "outside-authority"),
        ("places", "evidence_key", "evidence", "undefined-evidence"), ("places", "claim_keys", "claim", "undefined-claim"),
        ("relevance", "entity_key", "entity", "unresolved-entity"), ("relevance", "claim_keys", "claim", "undefined-claim"), ("relevance", "scope_key", "scope", "outside-authority"),
        ("questions", "record_key", "named", "unknown-record"),
        ("scope", "canon_key", "canon", "outside-snapshot"), ("scope", "reference_system_key", "reference_system", "outside-snapshot"),
    ),
    "edition": (
        ("mentions", "attestation_key", "attestation", "undefined-attestation"), ("mentions", "verse_key", "reference", "outside-authority"), ("mentions", "claim_keys", "claim", "undefined-claim"),
        ("questions", "record_key", "record", "unknown-record"),
        ("scope", "canon_key", "canon", "outside-snapshot"), ("scope", "reference_system_key", "reference_system", "outside-snapshot"), ("scope", "language_tag", "language", "outside-snapshot"), ("scope", "edition_key", "edition", "outside-snapshot"),
    ),
    "locale": (
        ("profiles", "entity_key", "entity", "unresolved-entity"), ("profiles", "claim_keys", "claim", "undefined-claim"), ("profiles", "language_tag", "language", "outside-snapshot"),
        ("contexts", "scope_key", "scope", "outside-authority"), ("contexts", "claim_keys", "claim", "undefined-claim"), ("contexts", "language_tag", "language", "outside-snapshot"), ("contexts", "open_question_key", "question", "undefined-question"),
        ("localizations", "relevance_key", "relevance", "undefined-relevance"), ("localizations", "entity_key", "entity", "unresolved-entity"), ("localizations", "claim_keys", "claim", "undefined-claim"), ("localizations", "scope_key", "scope", "outside-authority"), ("localizations", "language_tag", "language", "outside-snapshot"),
        ("questions", "record_key", "record", "unknown-record"),
        ("scope", "canon_key", "canon", "outside-snapshot"), ("scope", "reference_system_key", "reference_system", "outside-snapshot"), ("scope", "language_tag", "language", "outside-snapshot"),
    ),
}
#: What a package itself vouches for, by layer: authority -> (record, key)s. Only the canonical layer defines claims of its own; the others refer to approved ones.
OWN = {
    "canonical": {
        "candidate": (("candidates", "candidate_key"),),
        "claim": (("claims", "claim_key"),),
        "citation": (("citations", "citation_key"),),
        "record": tuple(x for x in UNIQUE["canonical"] if x[0] != "questions"),
        "named": UNIQUE["canonical"],
        "question": (("questions", "question_key"),),
    },
    "edition": {"record": UNIQUE["edition"], "question": (("questions", "question_key"),)},
    "locale": {"record": (("contexts", "context_key"),), "question": (("questions", "question_key"),)},
}
#: Authorities that a job may leave out: it then has no snapshot, and nothing is outside it. All others are closed: what a job leaves out approves nothing.
SNAPSHOTS = ("scope", "reference", "language", "canon", "reference_system", "edition")
#: The annotation class that the coverage of a layer has, and the snapshot that it must partition.
CLASSES = {"canonical": "canonical_entity_attestation", "edition": "translation_mention", "locale": "passage_context_localization"}
COVERED = {"canonical": "reference", "edition": "reference", "locale": "scope"}
#: Findings of references that lead nowhere; others are duplicates or invalid states.
_DANGLING = "^unresolved|^undefined|^unknown-record$"


def _values(df: DataFrame, column: str) -> DataFrame:
    """(``key``): the values of a column, or of an array's elements, as text; without null."""
    values = F.explode(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)
    return df.select(values.alias("key")).select(F.col("key").cast("string").alias("key")).filter("key IS NOT NULL")


def _keys(df: DataFrame, column: str) -> DataFrame:
    """(``key``): the distinct values of a column, or of an array's elements, as text; without null."""
    return _values(df, column).distinct()


def _finding(df: DataFrame, pointer: str, finding: str) -> DataFrame:
    return df.select(F.lit(pointer).alias("pointer"), F.col("key").cast("string").alias("key"), F.lit(finding).alias("finding"))


def coverage(groups: DataFrame, layer: str) -> DataFrame:
    """Findings about coverage groups (``annotation_class``, ``group_id``, ``result``, arrays ``refs``, ``record_keys``, ``question_keys``) that need nothing else.

    A group of another layer's class is only that.
    """
    own = groups.filter(F.col("annotation_class") == CLASSES[layer])
    refs = own.select(F.explode("refs").alias("key")).select(F.col("key").cast("string").alias("key"))
    return checks.all_findings([
        _finding(groups.filter(F.col("annotation_class") != CLASSES[layer]).select(F.col("group_id").alias("key")), "/coverage", "wrong-class"),
        _finding(refs.groupBy("key").count().filter("count > 1"), "/coverage", "overlap"),
        *(_finding(own.filter(rule).select(F.col("group_id").alias("key")), "/coverage", name) for name, rule in (("contradictory-zero", "result = 'complete_zero' AND size(record_keys) > 0"), ("missing-records", "result = 'complete_with_records' AND size(record_keys) = 0"), ("blocked-without-question", "result = 'blocked' AND size(question_keys) = 0"))),
    ])


def _trusted(package: dict[str, DataFrame]) -> list[DataFrame]:
    """(``key``): entities that reconciliations stand for, the only way in which candidates become entities: those of a candidate of the package, or of none, which name an entity that is registered already."""
    if "reconciliations" not in package or "entity_key" not in package["reconciliations"].columns:
        return []
    rows = package["reconciliations"].select(F.col("candidate_key").cast("string").alias("candidate"), F.col("entity_key").alias("key"))
    found = [rows.filter("candidate IS NULL")]
    if "candidates" in package:
        found.append(rows.join(_keys(package["candidates"], "candidate_key").withColumnRenamed("key", "candidate"), "candidate", "left_semi"))
    return [_keys(x, "key") for x in found]


def _references(layer: str, package: dict[str, DataFrame], job: dict[str, DataFrame]) -> DataFrame | None:
    """Findings of keys that some record points to and no authority knows, and of keys that coverage must have and lacks.

    What counts as known under an authority's name is what the job gives and what the package vouches for; where
    the job has no such snapshot, nothing is outside it. Each use of a key and each authority that knows it is a bit, so one
    aggregation by key answers for all pointers, and a key that many records share is held once.
    """
    bits: dict[str, int] = {}
    facts: list[tuple[DataFrame, str, list[str]]] = []
    rules: list[tuple[str, str, str, str]] = []  # pointer, finding, and the bits that a key has and hasn't

    def points(df: DataFrame, column: str, name: str, pointer: str, finding: str) -> None:
        if name not in SNAPSHOTS or name in job:
            facts.append((df, column, [use := f"{pointer} {column}"]))
            rules.append((pointer, finding, use, name))

    for record, column, name, finding in POINTERS[layer]:
        if record in package and column in package[record].columns:
            points(package[record], column, name, f"/{record}/{column}", finding)
    if "coverage" in package:
        own = package["coverage"].filter(F.col("annotation_class") == CLASSES[layer])
        for column, name, finding in (("record_keys", "record", "undefined-record"), ("question_keys", "question", "undefined-question"), ("refs", COVERED[layer], "outside")):
            points(own, column, name, "/coverage", finding)
        if COVERED[layer] in job:
            rules.append(("/coverage", "gap", COVERED[layer], "/coverage refs"))
    if not rules:
        return None
    asked = {x for rule in rules for x in rule[2:]}
    vouched: dict[tuple[str, str], list[str]] = {}
    for name in asked & set(OWN[layer]):
        for record, key in OWN[layer][name]:
            if record in package and key in package[record].columns:
                vouched.setdefault((record, key), []).append(name)
    facts += [(package[record], key, names) for (record, key), names in vouched.items()]
    facts += [(job[name], job[name].columns[0], [name]) for name in job if name in asked]
    if layer == "canonical" and "entity" in asked:
        facts += [(df, "key", ["entity"]) for df in _trusted(package)]
    for rule in rules:
        for name in rule[2:]:
            bits.setdefault(name, 1 << len(bits))
    marked = reduce(DataFrame.union, (_values(df, column).withColumn("bits", F.lit(sum(bits[x] for x in set(names))).cast("long")) for df, column, names in facts))
    broken = [((F.col("bits").bitwiseAND(bits[use]) != 0) & (F.col("bits").bitwiseAND(bits[name]) == 0), pointer, finding) for pointer, finding, use, name in rules]
    wrong = marked.groupBy("key").agg(F.bit_or("bits").alias("bits")).filter(reduce(Column.__or__, (x for x, _, _ in broken)))
    each = F.array_compact(F.array(*(F.when(x, F.struct(F.lit(pointer).alias("pointer"), F.lit(finding).alias("finding"))) for x, pointer, finding in broken)))
    return wrong.select("key", F.explode(each).alias("found")).select("found.pointer", "key", "found.finding")


def battery(layer: str, package: dict[str, DataFrame], job: dict[str, DataFrame]) -> DataFrame:
    """All findings about a package of a layer.

    ``job`` has the approved keys (``entity``, ``claim``, ``attestation``, ``relevance``, ``evidence``) and the snapshots
    (``SNAPSHOTS``), each a table whose first column holds keys. Approvals are closed: where a job has none,
    every reference that the package doesn't vouch for itself is a finding. A snapshot that
    isn't there is open. Record tables that aren't there have no rows, and a null pointer points nowhere.
    """
    found = []
    for record, key in UNIQUE[layer]:
        if record in package and key in package[record].columns:
            found.append(_finding(checks.duplicates(package[record].select(F.col(key).alias("key")), ["key"]), f"/{record}", "duplicate"))
    if (references := _references(layer, package, job)) is not None:
        found.append(references)
    if "coverage" in package:
        found.append(coverage(package["coverage"], layer))
    return checks.all_findings(found)


def verdict(findings: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, ``error``): the class under which a package fails, gravest first; no row if it passes."""
    error = F.when(F.col("finding").rlike(_DANGLING), "dangling").when(F.col("finding") == "duplicate", "duplicate").otherwise("invalid-state")
    if keys:
        return checks.gravest(findings.select(*keys, error.alias("error")), keys)
    return checks.gravest(findings.select(F.lit(1).alias("_one"), error.alias("error")), ["_one"]).drop("_one")


def mention_findings(mentions: DataFrame, verses: DataFrame, quote: str) -> DataFrame:
    """(``mention_key``, ``finding``) for mentions (``mention_key``, ``verse_key``, ``ordinal``, ``prefix``, ``suffix``) of a quote in verses (``verse_key``, ``text``).

    ``unknown-verse``, ``ordinal-unresolved``, ``context-mismatch``, and ``overlap`` for a mention whose
    neighbour in the verse begins before it ends.
    """
    from scholion.functions import text

    spans = verses.select("verse_key", text.quote_positions(F.col("text"), quote).alias("spans"), F.lit(True).alias("known"), "text")
    placed = mentions.join(spans, "verse_key", "left").withColumn("span", F.when(F.col("ordinal") >= 1, F.try_element_at("spans", F.greatest(F.col("ordinal"), F.lit(1)).cast("int"))))
    around = text.context(F.col("text"), F.col("span"))
    finding = F.when(F.col("known").isNull(), "unknown-verse").when(F.col("span").isNull(), "ordinal-unresolved").when((around["prefix"] != F.col("prefix")) | (around["suffix"] != F.col("suffix")), "context-mismatch")
    judged = placed.select("mention_key", "verse_key", F.col("span.start").alias("start"), F.col("span.end").alias("end"), finding.alias("finding"))
    next_start = F.lead("start").over(Window.partitionBy("verse_key").orderBy("start", "end", "mention_key"))
    overlaps = judged.filter("start IS NOT NULL").withColumn("next", next_start).filter(F.col("next") < F.col("end")).select("mention_key", F.lit("overlap").alias("finding"))
    return judged.filter("finding IS NOT NULL").select("mention_key", "finding").unionByName(overlaps)


def chapter_findings(chapters: DataFrame) -> DataFrame:
    """(``book``, ``chapter``, ``finding``) for blocks (``book``, ``chapter``, ``kind``, ``number``, ``text``) that can't be installed.

    ``book``: no ASCII code; ``chapter``: not positive; ``empty``: no verses; ``number``: a verse below 1 or
    a heading below 0; ``text``: blank; ``duplicate``: a verse number twice.
    """
    keys = ["book", "chapter"]
    verse = F.col("kind") == "v"
    each = chapters.select(*keys, F.explode(F.array_compact(F.array(
        F.when(F.col("book").isNull() | (F.col("book") == "") | F.col("book").rlike("[^\\x00-\\x7F]"), "book"),
        F.when(F.col("chapter") <= 0, "chapter"),
        F.when(verse & (F.col("number") <= 0) | ~verse & (F.col("number") < 0), "number"),
        F.when(F.col("text").isNull() | (F.trim("text") == ""), "text"),
    ))).alias("finding"))
    empty = chapters.groupBy(*keys).agg(F.count_if(verse).alias("n")).filter("n = 0").select(*keys, F.lit("empty").alias("finding"))
    twice = chapters.filter(verse).groupBy(*keys, "number").count().filter("count > 1").select(*keys, F.lit("duplicate").alias("finding"))
    return reduce(DataFrame.unionByName, (each, empty, twice)).distinct()


def unsorted_lists(bundles: DataFrame, keys: list[str], lists: dict[str, tuple[str, ...]]) -> DataFrame:
    """(keys, ``list``): bundles of which a list isn't in order of its fields, numbers as numbers."""
    def out_of_order(name: str, fields: tuple[str, ...]):
        order = F.transform(F.col(name), lambda x: F.struct(*(x[f].alias(f) for f in fields)))
        return F.when(order != F.array_sort(order), F.lit(name))

    found = F.array_compact(F.array(*(out_of_order(name, fields) for name, fields in lists.items())))
    return bundles.select(*keys, F.explode(found).alias("list"))


def row_findings(df: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """(keys, ``finding``): rows that break rules, which are SQL conditions by name; null breaks a rule."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(F.expr(rule), F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return df.select(*keys, F.explode(broken).alias("finding"))


#: What published rows must be.
VERSE_RULES = {"edition": "edition_key <> ''", "book": "book <> ''", "chapter": "chapter > 0", "verse": "verse >= 0", "local-key": "local_key <> ''", "text": "text IS NOT NULL", "digest": "digest RLIKE '^sha256:[0-9a-f]{64}$'"}


def submission_status(raw_text: str, kinds: tuple[str, ...], language: str, known_digest: str | None = None):
    """A column with the first thing wrong with a submission's JSON text in the column ``raw_text``, ``replay`` or ``accepted``.

    ``invalid-json`` (also where ``records`` isn't a list of objects), ``duplicate-key`` (two records with one key, or
    without any), ``schema-violation`` (see ``_draft_schema``), ``package-kind``, ``missing-key`` (the first
    record's entity or language), ``replay-changed`` (another text under a known attempt, whose digest is in
    the column ``known_digest``).
    """
    text = F.col(raw_text)
    parsed = F.try_parse_json(text)
    records = F.try_variant_get(parsed, "$.records", "array<variant>")
    kind = lambda v: F.schema_of_variant(v)
    broken = parsed.isNull() | (kind(parsed) == "VOID") | records.isNotNull() & F.exists(records, lambda x: kind(x) == "VOID") | F.startswith(kind(F.try_variant_get(parsed, "$.records", "variant")), F.lit("OBJECT"))
    keys = F.transform(records, lambda x: F.coalesce(F.try_variant_get(x, "$.record_key", "string"), F.lit("\0")))
    first = F.try_element_at(records, F.lit(1))
    known = F.col(known_digest) if known_digest else F.lit(None).cast("string")
    digest = F.sha2(text, 256)
    return (
        F.when(text.isNull() | F.coalesce(broken, F.lit(False)), "invalid-json")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "duplicate-key")
        .when(~F.coalesce(_draft_schema(text, parsed, records), F.lit(False)), "schema-violation")
        .when(~F.coalesce(F.try_variant_get(parsed, "$.package_kind", "string").isin(*kinds), F.lit(False)), "package-kind")
        .when((F.coalesce(F.try_variant_get(first, "$.entity_key", "string"), F.lit("")) == "") | ~F.try_variant_get(first, "$.language_tag", "string").eqNullSafe(F.lit(language)), "missing-key")
        .when(known.isNotNull() & (known != digest), "replay-changed")
        .when(known == digest, "replay")
        .otherwise("accepted")
    )


# A fixed value: the fields of a draft, all of which it must have, and no others.
DRAFT_FIELDS = ("schema_version", "package_kind", "records", "open_questions", "editorial_observations")


def _draft_schema(text: Column, parsed: Column, records: Column) -> Column:
    """Whether a draft has just the fields that it must: a version of three numbers, a kind, lists of questions and observations, and one record or more, each with a key and a kind and whatever else."""
    def named(v: Column, path: str) -> Column:
        return (F.schema_of_variant(F.try_variant_get(v, path, "variant")) == "STRING") & (F.try_variant_get(v, path, "string") != "")

    def listed(path: str) -> Column:
        return F.startswith(F.schema_of_variant(F.try_variant_get(parsed, path, "variant")), F.lit("ARRAY"))

    whole = named(parsed, "$.schema_version") & F.try_variant_get(parsed, "$.schema_version", "string").rlike(r"^\d+\.\d+\.\d+$") & named(parsed, "$.package_kind")
    fields = F.size(F.array_except(F.json_object_keys(text), F.array(*map(F.lit, DRAFT_FIELDS)))) == 0
    each = (F.size(records) > 0) & F.forall(records, lambda x: F.coalesce(named(x, "$.record_key") & named(x, "$.record_kind"), F.lit(False)))
    return whole & fields & each & listed("$.open_questions") & listed("$.editorial_observations")


def canon_findings(entities: DataFrame, registry: DataFrame, dependencies: DataFrame, digests: DataFrame, books: DataFrame, expected: DataFrame) -> DataFrame:
    """Findings across all books of a canon.

    entities (``entity_key``, ``book``, ``content``): ``collision`` where a key has several contents;
    registry (``entity_key``): ``unregistered``; dependencies (``package_key``, ``depends_on``, ``digest``) and
    digests (``package_key``, ``digest``): ``unbound`` where a dependency isn't bound to the digest that
    its package has; books (``book``) and expected (``book``): ``missing-book`` and ``extra-book``.
    """
    several = entities.groupBy(F.col("entity_key").alias("key")).agg(F.countDistinct("content").alias("n")).filter("n > 1")
    known = registry.select(F.col("entity_key").cast("string").alias("key"))
    bound = digests.select(F.col("package_key").alias("depends_on"), "digest")
    unbound = dependencies.join(bound, ["depends_on", "digest"], "left_anti").select(F.concat_ws(">", "package_key", "depends_on").alias("key")).distinct()
    have, want = _keys(books, "book"), _keys(expected, "book")
    return checks.all_findings([
        _finding(several, "/entities", "collision"),
        _finding(_keys(entities, "entity_key").join(known, "key", "left_anti"), "/entities", "unregistered"),
        _finding(unbound, "/dependencies", "unbound"),
        _finding(want.join(have, "key", "left_anti"), "/books", "missing-book"),
        _finding(have.join(want, "key", "left_anti"), "/books", "extra-book"),
    ])


def merge_records(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Both tables by key: an incoming record takes the place (``order``) of the one that it replaces, new ones come after the last, in their order."""
    last = existing.agg(F.coalesce(F.max(order), F.lit(0)).alias("_last"))
    places = existing.groupBy(*keys).agg(F.min(order).alias("_place"))
    first = incoming.groupBy(*keys).agg(F.max_by(F.struct(*(x for x in incoming.columns if x not in keys)), order).alias("_new"), F.min(order).alias("_at"))
    taken = first.join(places, keys, "left").join(F.broadcast(last)).select(*keys, F.col("_new.*"), F.coalesce("_place", F.col("_last") + F.col("_at")).alias("_order"))
    taken = taken.drop(order).withColumnRenamed("_order", order)
    return existing.join(first.select(*keys), keys, "left_anti").unionByName(taken.select(*existing.columns))


def remapped(df: DataFrame, column: str, mapping: DataFrame) -> DataFrame:
    """``df`` with the column's keys replaced as the mapping (``old``, ``new``) says; other keys stay."""
    joined = df.join(mapping.select(F.col("old").alias(column), F.col("new").alias("_new")), column, "left")
    return joined.withColumn(column, F.coalesce("_new", column)).select(*df.columns)


def same_ranges(scopes: DataFrame, others: DataFrame, bounds: list[str]) -> DataFrame:
    """(``old``, ``new``): scopes of one scheme and the least key of another's that has the same bounds; its own key where none has."""
    known = others.groupBy(*bounds).agg(F.min("scope_key").alias("new"))
    return scopes.join(known, bounds, "left").select(F.col("scope_key").alias("old"), F.coalesce("new", "scope_key").alias("new"))
