"""Changes of keyed tables as functions of snapshots: inserts, upserts, replays and folds of op logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def insert_ignore(target: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` and the incoming rows of new keys; rows that repeat a key among the incoming are one."""
    return target.unionByName(incoming.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], guarded: DataFrame | None = None) -> DataFrame:
    """``incoming`` over ``target`` by key; keys in ``guarded`` keep what the target has, or stay out."""
    if guarded is not None:
        incoming = incoming.join(guarded.select(*keys).distinct(), keys, "left_anti")
    return target.join(incoming.select(*keys), keys, "left_anti").unionByName(incoming)


def replay_action(receipts: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """``incoming`` (with ``revision`` and ``digest``) and what importing it does: ``insert``, ``noop``, ``conflict`` or ``migrate``."""
    known = receipts.select(*keys, F.col("revision").alias("known_revision"), F.col("digest").alias("known_digest"))
    action = (
        F.when(F.col("known_digest").isNull(), "insert")
        .when(F.col("known_digest") == F.col("digest"), "noop")
        .when(F.col("revision") <= F.col("known_revision"), "conflict")
        .otherwise("migrate")
    )
    return incoming.join(known, keys, "left").withColumn("action", action).drop("known_revision", "known_digest")


def bumped_revision(digest: Column, known_digest: Column, known_revision: Column) -> Column:
    """The next revision where the content changed, the known one where it didn't, 1 for what is new."""
    return F.when(known_digest.isNull(), 1).when(known_digest == digest, known_revision).otherwise(known_revision + 1)


def fold_op_log(ops: DataFrame, keys: list[str]) -> DataFrame:
    """The state of each key after its ops (``op``, ``ts``, ``seq``): ``active``, ``added_at``, ``deleted_at``.

    A remove at or after an add's time wins over it, and a newer add clears the remove. So the
    state is that of the greatest times: the latest remove and the latest add, which aggregate
    without order. An op without a time stays pending and counts for nothing.
    """
    added = F.max(F.when(F.col("op") == "add", F.col("ts")))
    removed = F.max(F.when(F.col("op") == "remove", F.col("ts")))
    found = ops.groupBy(*keys).agg(added.alias("added_at"), removed.alias("deleted_at"), F.count_if(F.col("ts").isNull()).alias("pending"))
    return found.withColumn("active", F.col("added_at").isNotNull() & (F.col("deleted_at").isNull() | (F.col("added_at") > F.col("deleted_at"))))


def pull_merge(local: DataFrame, remote: DataFrame, tombstones: DataFrame, keys: list[str]) -> DataFrame:
    """Local bookmarks (``created_at``) after a pull: unknown remote ones join them, the earliest time of two wins, and tombstones as late as a bookmark take it away."""
    merged = local.select(*keys, "created_at").unionByName(remote.select(*keys, "created_at")).groupBy(*keys).agg(F.min("created_at").alias("created_at"))
    dead = tombstones.groupBy(*keys).agg(F.max("deleted_at").alias("deleted_at"))
    return merged.join(dead, keys, "left").filter(F.col("deleted_at").isNull() | (F.col("created_at") > F.col("deleted_at"))).drop("deleted_at")


def recents(target: DataFrame, incoming: DataFrame, owner: str, key: str, ts: str, keep: int) -> DataFrame:
    """(owner, key, ``ts``): the newest time of each key after the incoming rows, and of each owner the newest ``keep`` keys."""
    from scholion.operators.ordinals import newest

    merged = target.select(owner, key, ts).unionByName(incoming.select(owner, key, ts)).groupBy(owner, key).agg(F.max(ts).alias(ts))
    return newest(merged, [owner], [F.desc(ts), F.asc(key)], keep, "_rank").drop("_rank")


def ledger_actions(registry: DataFrame, ledger: DataFrame) -> DataFrame:
    """(``version``, ``action``) for migrations (``version``, ``name``, ``sql``) against those applied (``version``, ``name``, ``sql_sha256``).

    The registry is judged whole before anything is applied: ``invalid-version``, ``invalid-name``,
    ``empty-migration`` and ``duplicate-version``. Then the ledger is: ``ledger-invalid`` for rows without a
    positive version, a name or a digest, and for versions that it has twice. Either stops all: every other version is ``blocked``. Else
    versions go in order: ``skip`` what is applied, ``apply`` what isn't, until one has changed since
    (``ledger-drift``); those behind it are ``blocked``. An empty registry has no actions but the ledger's.
    """
    digest = F.concat(F.lit("sha256:"), F.sha2("sql", 256))
    counted = registry.join(registry.groupBy("version").agg(F.count(F.lit(1)).alias("_n")), "version")
    corrupt = ~F.coalesce((F.col("version") > 0) & (F.col("name") != "") & F.col("sql_sha256").rlike("^sha256:[0-9a-f]{64}$"), F.lit(False))
    rows = ledger.groupBy("version").agg(F.max(F.struct("name", "sql_sha256")).alias("_known"), (F.max(corrupt) | (F.count(F.lit(1)) > 1)).alias("_corrupt"))
    invalid = (
        F.when(F.coalesce(F.col("version") <= 0, F.lit(True)), "invalid-version")
        .when(~F.coalesce(F.col("name").rlike("^[a-z0-9_]+$"), F.lit(False)), "invalid-name")
        .when(F.coalesce(F.trim("sql"), F.lit("")) == "", "empty-migration")
        .when(F.col("_n") > 1, "duplicate-version")
    )
    judged = counted.withColumn("_invalid", invalid).join(rows, "version", "left")
    drift = F.col("_known").isNotNull() & ((F.col("_known.name") != F.col("name")) | (F.col("_known.sql_sha256") != digest))
    # one row: whether anything stops all, and where the order stops
    stops = judged.agg(F.coalesce(F.max(F.col("_invalid").isNotNull()), F.lit(False)).alias("_refused"), F.min(F.when(drift, F.col("version"))).alias("_drift"))
    stops = stops.join(F.broadcast(rows.agg(F.coalesce(F.max("_corrupt"), F.lit(False)).alias("_damaged"))))
    action = (
        F.when(F.col("_invalid").isNotNull(), F.col("_invalid"))
        .when(F.col("_refused") | F.col("_damaged") | (F.col("version") > F.col("_drift")), "blocked")
        .when(F.col("version") == F.col("_drift"), "ledger-drift")
        .when(F.col("_known").isNull(), "apply")
        .otherwise("skip")
    )
    found = judged.join(F.broadcast(stops)).select("version", action.alias("action")).distinct()
    # a registry that is refused is never held against the ledger
    damaged = rows.filter("_corrupt").join(F.broadcast(stops.filter("NOT _refused").select("_refused"))).select("version", F.lit("ledger-invalid").alias("action"))
    return found.unionByName(damaged)


def changed_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """What an append-only table must not show: keys that are gone (``removed``) or whose other columns differ (``changed``)."""
    rest = sorted(set(before.columns) - set(keys))
    content = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    old, new = before.select(*keys, content.alias("_old")), after.select(*keys, content.alias("_new"))
    return old.join(new, keys, "left").filter(F.col("_new").isNull() | (F.col("_new") != F.col("_old"))).select(*keys, F.when(F.col("_new").isNull(), "removed").otherwise("changed").alias("finding"))
