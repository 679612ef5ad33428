"""Checks across all books of a canon that no single package can make: identities, neutrality, ontology, registry, bindings and senses.

Each returns findings (``pointer``, ``key``, ``finding``), by one join or aggregation on keys, so they
can be put together and counted like those of a package.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.operators.ordinals import first_distinct

# How sure an identification may be, and what derived fields a registry must not keep.
STATUSES = ("established", "traditional", "proposed", "disputed", "unknown")
DERIVED = ("verse_count", "first_reference", "last_reference")


def _found(df: DataFrame, pointer: str, key: Column, finding: str | Column) -> DataFrame:
    return df.select(F.lit(pointer).alias("pointer"), key.cast("string").alias("key"), (F.lit(finding) if isinstance(finding, str) else finding).alias("finding"))


def _rules(df: DataFrame, pointer: str, key: str, rules: dict[str, Column]) -> DataFrame:
    """A finding for each rule (by name) that holds for a row."""
    broken = F.array_compact(F.array(*(F.when(F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))
    return _found(df.select(key, F.explode(broken).alias("_finding")), pointer, F.col(key), F.col("_finding"))


def identity_splits(locked: DataFrame, registry: DataFrame, most: int = 5) -> DataFrame:
    """(``entity_key``, ``candidates``): locked keys (``entity:label``) that the registry (``entity_key``, ``preferred_name``) lacks though it has entities whose name holds the label; the first ``most`` of their keys.

    A label may stand anywhere in a name, so names meet labels by the three characters that a label begins with, and what
    meets is compared in full. Entities of one name have the same labels, so each different name is cut once, and
    carries only the first ``most`` keys of its entities.
    """
    label = F.regexp_replace("entity_key", "^.*?entity:", "")
    missing = locked.select("entity_key").distinct().join(registry.select("entity_key").hint("merge"), "entity_key", "left_anti").withColumn("label", F.lower(label))
    spoken = missing.withColumn("spoken", F.replace("label", F.lit("-"), F.lit(" "))).filter("spoken <> ''").select("entity_key", "spoken", F.left("spoken", F.lit(3)).alias("begin"))
    named = registry.filter("preferred_name IS NOT NULL").select(F.lower("preferred_name").alias("name"), F.col("entity_key").alias("candidate"))
    names = first_distinct(named, ["name"], "candidate", most).select("name", F.col("first").alias("candidates"))
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substr("name", i, n))))
    # keys and a name's pieces are many more bytes than statistics of stored columns tell, so the joins are told not to broadcast them
    met = names.withColumn("begin", F.explode(F.array_distinct(grams))).hint("merge").join(spoken, "begin")
    same = met.filter(F.contains("name", F.col("spoken"))).select("entity_key", F.explode("candidates").alias("candidate"))
    return first_distinct(same, ["entity_key"], "candidate", most).select("entity_key", F.col("first").alias("candidates"))


def neutrality(packages: DataFrame, marks: tuple[str, ...], edition_mark: str) -> DataFrame:
    """Packages (``package_key``, ``layer``, ``edition_key``) whose identity says the wrong thing about editions: canonical ones name no edition or language (``marks``), locale ones no edition, and edition packages must."""
    name, layer = F.lower("package_key"), F.col("layer")
    named = F.contains(name, F.lit(edition_mark))
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(name, F.lit(mark))
    return _rules(packages, "/packages", "package_key", {
        "not-neutral": (layer == "canonical") & marked,
        "names-edition": (layer == "locale") & named,
        "unnamed-edition": (layer == "edition") & ~named,
        "edition-key": layer.isin("canonical", "locale") & F.col("edition_key").isNotNull(),
        "missing-edition-key": (layer == "edition") & F.col("edition_key").isNull(),
    })


def untagged(prose: DataFrame, language: str) -> DataFrame:
    """Labels and texts (``key``, ``language_tag``) of the canonical layer that don't carry their language."""
    return _found(prose.filter(~F.col("language_tag").eqNullSafe(F.lit(language))), "/prose", F.col("key"), "untagged")


def registry_rules(registry: DataFrame, language: str, statuses: tuple[str, ...] = STATUSES) -> DataFrame:
    """Registered entities of no known status, without their name's language, or with values that are derived from texts; and one finding if none of them has an outer identifier (``external_ids``: a number of them)."""
    kept = F.lit(False)
    for name in DERIVED:
        if name in registry.columns:
            kept = kept | F.col(name).isNotNull()
    each = _rules(registry, "/registry", "entity_key", {"status": ~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), "untagged": ~F.col("language_tag").eqNullSafe(F.lit(language)), "derived": kept})
    if "external_ids" not in registry.columns:
        return each
    none = registry.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max("external_ids"), F.lit(0)).alias("most")).filter("n > 0 AND most = 0")
    return each.unionByName(_found(none, "/registry", F.lit("*"), "no-external-ids"))


def outside_ontology(relationships: DataFrame, allowed: DataFrame) -> DataFrame:
    """Predicates (``predicate_key``) that the ontology lacks, each once."""
    wrong = relationships.select("predicate_key").filter("predicate_key IS NOT NULL").distinct().join(allowed.select("predicate_key"), "predicate_key", "left_anti")
    return _found(wrong, "/relationships", F.col("predicate_key"), "outside-ontology")


def bindings(packages: DataFrame, dependencies: DataFrame, canonical: DataFrame) -> DataFrame:
    """Packages (``package_key``, ``canonical_key``) that aren't bound to their canonical package (``package_key``, ``digest``, ``revision``) by exactly one dependency (``package_key``, ``depends_on``, ``digest``, ``revision``) of its digest and revision."""
    own = canonical.select(F.col("package_key").alias("canonical_key"), F.col("digest").alias("_digest"), F.col("revision").alias("_revision"))
    counted = dependencies.groupBy("package_key").agg(F.count(F.lit(1)).alias("_n"), F.max(F.struct("depends_on", "digest", "revision")).alias("_said"))
    joined = packages.select("package_key", "canonical_key").join(counted, "package_key", "left").join(own, "canonical_key", "left")
    bound = F.coalesce((F.col("_n") == 1) & (F.col("_said.depends_on") == F.col("canonical_key")), F.lit(False))
    return _rules(joined, "/dependencies", "package_key", {
        "unbound": ~bound,
        "digest": bound & F.col("_digest").isNotNull() & ~F.col("_said.digest").eqNullSafe(F.col("_digest")),
        "revision": bound & ~F.col("_said.revision").eqNullSafe(F.col("_revision")),
    })


def spot_checks(attestations: DataFrame, expected: DataFrame, mentions: DataFrame | None = None, quotes: DataFrame | None = None) -> DataFrame:
    """Verses whose attestations (``reference_key``, ``entity_key``) aren't as expected (``reference_key``, ``entity_key``, ``wanted``: true or false), and mentions (``reference_key``, ``entity_key``, ``quote``) that don't quote what they must (``quotes``).

    Everything known of a verse and entity is dealt by both and meets in one place, in as many parts as Spark's
    shuffles have, since its rows are so few bytes that Spark would put many millions into one task. An expectation
    without a key is met by nothing, one that is there several times fails as often, and one quote of several is enough.
    """
    keys, (have, must, said, right) = ["reference_key", "entity_key"], (1, 2, 4, 8)
    has = lambda bit: F.col("bits").bitwiseAND(bit) != 0
    whole = F.col("reference_key").isNotNull() & F.col("entity_key").isNotNull()
    quoted = F.when(F.col("quote").isNotNull(), said).otherwise(0)

    def facts(df: DataFrame, bits: Column, quote: Column | None = None, missing: Column | None = None, displaced: Column | None = None) -> DataFrame:
        none = F.lit(0)
        return df.select(*keys, (F.lit(None) if quote is None else quote).cast("string").alias("quote"), bits.cast("int").alias("bits"), *((none if x is None else x).cast("long").alias(name) for name, x in (("missing", missing), ("displaced", displaced))))

    parts = [facts(expected.filter("wanted IS NOT NULL"), F.lit(0), None, F.col("wanted"), ~F.col("wanted"))]
    if mentions is not None and quotes is not None:
        parts += [facts(mentions.filter(whole), quoted + (have if mentions is attestations else 0), F.col("quote")), facts(quotes, F.lit(must), F.col("quote"))]
    if mentions is not attestations or quotes is None:
        parts.append(facts(attestations.filter(whole), F.lit(have)))
    sums = [F.bit_or("bits").alias("bits"), F.sum("missing").alias("missing"), F.sum("displaced").alias("displaced")]
    dealt = reduce(DataFrame.union, parts).repartition(int(expected.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    by_quote = dealt.groupBy(*keys, "quote").agg(*sums).withColumn("bits", F.when(has(must) & has(said), F.col("bits").bitwiseOR(right)).otherwise(F.col("bits")))
    times = {"missing": F.when(~has(have), F.col("missing")).otherwise(0), "displaced": F.when(has(have), F.col("displaced")).otherwise(0), "quote": (has(must) & ~has(right)).cast("long")}
    each = F.flatten(F.array(*(F.array_repeat(F.lit(name), n.cast("int")) for name, n in times.items())))
    wrong = by_quote.groupBy(*keys).agg(*sums).filter(reduce(Column.__or__, (n > 0 for n in times.values())))
    return _found(wrong.select(*keys, F.explode(each).alias("_finding")), "/senses", F.concat_ws(">", *keys), F.col("_finding"))


def collisions(records: DataFrame, pattern: str) -> DataFrame:
    """Record keys (``key``, ``book``, ``content``) out of their grammar, and keys that stand for different contents."""
    invalid = records.filter(~F.coalesce(F.col("key").cast("string").rlike(pattern), F.lit(False))).select("key").distinct()
    several = records.groupBy("key").agg(F.countDistinct("content").alias("n")).filter("n > 1")
    return _found(invalid, "/records", F.col("key"), "invalid-key").unionByName(_found(several, "/records", F.col("key"), "collision"))


def partition_findings(coverage: DataFrame, scopes: DataFrame) -> DataFrame:
    """Books (``book``) whose coverage (``book``, ``refs``: an array for each group) isn't a partition of their scope (``book``, ``ref``): what is covered twice, and how many of how many are covered."""
    refs = coverage.select("book", F.explode("refs").alias("ref")).groupBy("book", "ref").agg(F.count(F.lit(1)).alias("n"))
    twice = _found(refs.filter("n > 1"), "/coverage", F.concat_ws(">", "book", "ref"), "overlap")
    both = scopes.select("book", "ref").distinct().withColumn("_in", F.lit(1)).join(refs, ["book", "ref"], "full")
    sums = both.groupBy("book").agg(F.count("n").alias("covered"), F.count("_in").alias("wanted"), F.count_if(F.col("n").isNull() | F.col("_in").isNull()).alias("apart")).filter("apart > 0")
    return twice.unionByName(_found(sums, "/coverage", F.concat(F.col("book"), F.lit(" "), F.col("covered").cast("string"), F.lit("/"), F.col("wanted").cast("string")), "partition"))
