"""Merges, replays and the bookmark op log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholion.operators import merge
from scholion.plans.registry import query
from scholion.sources import bind
from scholion.sources.bind import raw


def _target(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("value"))


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").filter("n_chars > 800").select("doc_id", F.lit(7).alias("value"))


@query("insert_ignore", "SELECT doc_id, quality AS value FROM labels UNION ALL SELECT doc_id, 7 FROM documents WHERE n_chars > 800 AND doc_id NOT IN (SELECT doc_id FROM labels)")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.insert_ignore(_target(spark, sf_dir), _incoming(spark, sf_dir), ["doc_id"])


@query("upsert_priority", "SELECT doc_id, 7 AS value FROM documents WHERE n_chars > 800 UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars > 800)")
def upsert_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(_target(spark, sf_dir), _incoming(spark, sf_dir), ["doc_id"])


@query("guarded_upsert", "WITH i AS (SELECT doc_id FROM documents WHERE n_chars > 800 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)) SELECT doc_id, 7 AS value FROM i UNION ALL SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM i)")
def guarded_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.upsert(_target(spark, sf_dir), _incoming(spark, sf_dir), ["doc_id"], guarded=raw(spark, sf_dir, "labels").filter("toxic = 1"))


@query("owned_resync", "SELECT row_kind, row_id, package_id FROM memberships WHERE package_id IN (SELECT package_id FROM published) UNION ALL SELECT 'verse', doc_id, CAST(doc_id % 25 AS INT) FROM labels WHERE doc_id % 25 NOT IN (SELECT package_id FROM published)")
def owned_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scholion.plans.spine import published

    gate = published(spark, sf_dir).select("package_id")
    kept = bind.memberships(spark, sf_dir).join(F.broadcast(gate), "package_id", "left_semi").select("row_kind", "row_id", "package_id")
    fresh = raw(spark, sf_dir, "labels").select(F.lit("verse").alias("row_kind"), F.col("doc_id").alias("row_id"), (F.col("doc_id") % 25).cast("int").alias("package_id"))
    return kept.unionByName(fresh.join(F.broadcast(gate), "package_id", "left_anti").select("row_kind", "row_id", "package_id"))


@query("membership_backfill", "SELECT row_kind, count(*) AS n FROM (SELECT row_kind, row_id, package_id FROM memberships UNION SELECT 'verse', doc_id, CAST(doc_id % 25 AS INT) FROM labels UNION SELECT 'attestation', reference_id, CAST(entity_id % 25 AS INT) FROM attestations) GROUP BY row_kind")
def membership_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bind.memberships(spark, sf_dir)
    new = [
        raw(spark, sf_dir, "labels").select(F.lit("verse").alias("row_kind"), F.col("doc_id").alias("row_id"), (F.col("doc_id") % 25).cast("int").alias("package_id")),
        bind.attestations(spark, sf_dir).select(F.lit("attestation").alias("row_kind"), F.col("reference_id").alias("row_id"), (F.col("entity_id") % 25).cast("int").alias("package_id")),
    ]
    for part in new:
        found = merge.insert_ignore(found, part, ["row_kind", "row_id", "package_id"])
    return found.groupBy("row_kind").agg(F.count(F.lit(1)).alias("n"))


@query("replay_action", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'insert' WHEN doc_id % 5 = 1 THEN 'noop' WHEN doc_id % 5 < 4 THEN 'conflict' ELSE 'migrate' END AS action FROM labels")
def replay_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Against receipts that lack a fifth of the keys, know a fifth as they are, and the rest with other content at a newer, the same or an older revision."""
    incoming = raw(spark, sf_dir, "labels").select("doc_id", F.lit(5).alias("revision"), F.concat_ws(":", "quality", "toxic").alias("digest"))
    part = F.col("doc_id") % 5
    receipts = incoming.filter(part > 0).select("doc_id", F.when(part == 2, 6).when(part == 4, 4).otherwise(5).alias("revision"), F.when(part == 1, F.col("digest")).otherwise("other").alias("digest"))
    return merge.replay_action(receipts, incoming, ["doc_id"]).select("doc_id", "action")


@query("oplog_fold", "SELECT user_id, k, max(ts) FILTER (op = 'add') AS added_at, max(ts) FILTER (op = 'remove') AS deleted_at, coalesce(max(ts) FILTER (op = 'add') > coalesce(max(ts) FILTER (op = 'remove'), TIMESTAMP '1970-01-01'), false) AS active FROM op_log GROUP BY user_id, k")
def oplog_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.fold_op_log(bind.op_log(spark, sf_dir), ["user_id", "k"]).select("user_id", "k", "added_at", "deleted_at", "active")


_SIDES = "l AS (SELECT user_id, k, min(ts) AS created_at FROM op_log WHERE op = 'add' AND user_id % 2 = 0 GROUP BY ALL), r AS (SELECT user_id, k, max(ts) AS created_at FROM op_log WHERE op = 'add' GROUP BY ALL), t AS (SELECT user_id, k, ts AS deleted_at FROM op_log WHERE op = 'remove')"


@query("pull_merge", f"WITH {_SIDES} SELECT user_id, k, created_at FROM (SELECT user_id, k, min(created_at) AS created_at FROM (SELECT * FROM l UNION ALL SELECT * FROM r) GROUP BY ALL) m WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.user_id = m.user_id AND t.k = m.k AND m.created_at <= t.deleted_at)")
def pull_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = bind.op_log(spark, sf_dir)
    adds = ops.filter("op = 'add'")
    local = adds.filter("user_id % 2 = 0").groupBy("user_id", "k").agg(F.min("ts").alias("created_at"))
    remote = adds.groupBy("user_id", "k").agg(F.max("ts").alias("created_at"))
    return merge.pull_merge(local, remote, ops.filter("op = 'remove'").select("user_id", "k", F.col("ts").alias("deleted_at")), ["user_id", "k"])


@query("sync_counters", "SELECT user_id, count(*) FILTER (op = 'add') AS pushed, count(*) FILTER (op = 'remove') AS removed, count(DISTINCT k) AS locations FROM op_log GROUP BY user_id")
def sync_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bind.op_log(spark, sf_dir).groupBy("user_id").agg(F.count_if(F.col("op") == "add").alias("pushed"), F.count_if(F.col("op") == "remove").alias("removed"), F.countDistinct("k").alias("locations"))


@query("ack_processed", "SELECT seq FROM op_log o WHERE seq NOT IN (SELECT seq FROM op_log WHERE op = 'remove')")
def ack_processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = bind.op_log(spark, sf_dir)
    return ops.select("seq").join(ops.filter("op = 'remove'").select("seq"), "seq", "left_anti")


@query("atomic_batch", "SELECT source, count(*) AS n, CASE WHEN bool_or(n_chars < 60) THEN 'rejected' ELSE 'accepted' END AS outcome FROM documents GROUP BY source")
def atomic_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.when(F.bool_or(F.col("n_chars") < 60), "rejected").otherwise("accepted").alias("outcome"))


@query("resume_jobs", "SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality = 0")
def resume_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs whose input digest isn't that of their checkpoint."""
    jobs = raw(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    done = jobs.join(raw(spark, sf_dir, "labels"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, F.col("digest")).otherwise("old").alias("seen"))
    return jobs.join(done, "doc_id", "left").filter(~F.col("digest").eqNullSafe(F.col("seen"))).select("doc_id")
