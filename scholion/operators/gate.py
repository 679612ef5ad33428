"""What is published, and who may do what."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholion.operators.ordinals import latest


def published_packages(packages: DataFrame, releases: DataFrame, approvals: DataFrame, as_of: datetime.datetime) -> DataFrame:
    """(package_id, locale) of packages that are published at ``as_of``: not in the future, cleared, in an active release, and last approved as they are now."""
    last = latest(approvals, ["package_id"], ["created_at", "approval_id"], ["decision", "subject_digest"])
    approved = last.filter(F.col("decision") == "approved").select("package_id", F.col("subject_digest").alias("digest"))
    ready = packages.filter((F.col("published_at") <= F.lit(as_of)) & F.col("rights_cleared"))
    return ready.join(approved, ["package_id", "digest"], "left_semi").join(releases.filter("active"), ["package_id"], "left_semi").select("package_id", "locale")


def published_rows(memberships: DataFrame, published: DataFrame, row_kind: str) -> DataFrame:
    """Distinct ``row_id`` of a kind that belong to a published package, many packages or one."""
    return memberships.filter(F.col("row_kind") == row_kind).join(published, "package_id", "left_semi").select("row_id").distinct()


#: Denial codes in the order in which they are checked.
DENIALS = ("invalid-release", "digest-not-bound", "no-grant", "grant-denied", "grant-expired", "territory-mismatch", "language-mismatch", "no-approval", "digest-not-bound")
_DIGEST = "^sha256:[0-9a-f]{64}$"


def authorize(requests: DataFrame, releases: DataFrame, grants: DataFrame, approvals: DataFrame) -> DataFrame:
    """(``request_id``, ``allowed``, ``denial``): the first check that fails, in the order of ``DENIALS``.

    requests: request_id, release_key, component_key, operation, territory, language, day; releases:
    release_key, status, artifact_digest, evidence_digest; grants: release_key, component_key,
    operation, state, territory, language, effective_from, effective_to; approvals: release_key,
    component_key, decision, digest, created_at, of which the latest for a component counts.

    Of several grants the best counts: the one whose failing check comes last. A grant that is
    restricted to a territory or language denies requests that leave it out.
    """
    subject = ["release_key", "component_key"]
    last = latest(approvals, subject, ["created_at", "decision"], ["decision", "digest"])
    known = releases.select("release_key", "status", "artifact_digest", "evidence_digest")
    grant_columns = ("state", "territory", "language", "effective_from", "effective_to")
    given = grants.select(*subject, "operation", *(F.col(x).alias(f"g_{x}") for x in grant_columns))
    last = last.select(*subject, F.col("decision").alias("a_decision"), F.col("digest").alias("a_digest"))
    joined = requests.join(known, "release_key", "left").join(given, [*subject, "operation"], "left").join(last, subject, "left")

    def restricted(name: str) -> Column:
        return F.col(f"g_{name}").isNotNull() & ~F.col(name).eqNullSafe(F.col(f"g_{name}"))

    checks = (
        F.col("status").isNull() | (F.col("status") == "invalid"),
        ~F.col("artifact_digest").rlike(_DIGEST) | ~F.col("evidence_digest").rlike(_DIGEST),
        F.col("g_state").isNull(),
        F.col("g_state") != "allowed",
        (F.col("g_effective_from") > F.col("day")) | (F.col("g_effective_to") < F.col("day")),
        restricted("territory"),
        restricted("language"),
        ~F.coalesce(F.col("a_decision") == "approved", F.lit(False)),
        ~F.coalesce(F.col("a_digest").rlike(_DIGEST), F.lit(False)),
    )
    rank = F.coalesce(*(F.when(F.coalesce(x, F.lit(False)), k) for k, x in enumerate(checks)), F.lit(len(checks)))
    best = joined.groupBy("request_id").agg(F.max(rank).alias("rank"))
    return best.select("request_id", (F.col("rank") == len(checks)).alias("allowed"), F.get(F.array(*map(F.lit, DENIALS)), F.col("rank")).alias("denial"))


#: Who may read what: rows of published packages, one's own rows, or none.
POLICIES = {"anon": "published", "authenticated": "published", "owner": "own", "service": "all"}


def visible_rows(df: DataFrame, role: str, published: DataFrame | None = None, owner: object = None, package: str = "package_id", owned_by: str = "owner_id") -> DataFrame:
    """The rows that a caller of a role may read; an unknown role reads none. A filter, not enforcement: whoever reads the files sees all."""
    policy = POLICIES.get(role)
    if policy == "all":
        return df
    if policy == "published" and published is not None:
        return df.join(published.select(F.col("package_id").alias(package)).distinct(), package, "left_semi")
    if policy == "own" and owner is not None:
        return df.filter(F.col(owned_by) == F.lit(owner))
    return df.filter(F.lit(False))


def assert_can_import(role: str, privileged: bool) -> None:
    """Fails for whoever isn't a privileged importer."""
    if role in ("anon", "authenticated"):
        raise PermissionError("forbidden-public")
    if not privileged or role not in ("importer", "service_role"):
        raise PermissionError("forbidden-not-importer")


def acquisition_status(authorized: Column, fetched: Column, media_ok: Column, size_ok: Column, digest: Column, expected: Column, cached: Column) -> Column:
    """What becomes of an acquisition: ``denied`` before anything is written, ``quarantined_mismatch`` where what came isn't what was expected or differs from an earlier receipt, ``idempotent`` where the receipt is there, else ``success``."""
    return (
        F.when(~authorized | ~fetched, "denied")
        .when(~media_ok | ~size_ok | (digest != expected) | (cached.isNotNull() & (cached != digest)), "quarantined_mismatch")
        .when(cached == digest, "idempotent")
        .otherwise("success")
    )


_SHELL, _CONTROL = r"[;&|`$()]", r"[\x00-\x1F\x7F]"


def path_error(path: Column, root: str) -> Column:
    """The first rule that a quarantine path breaks."""
    return F.when(~F.startswith(path, F.lit(root)), "invalid-quarantine-path").when(F.contains(path, F.lit("..")) | F.contains(path, F.lit("//")), "path-traversal").when(path.rlike(_SHELL), "shell-interpolation").when(path.rlike(_CONTROL), "control-characters")


def url_error(url: Column, hosts: tuple[str, ...], prefixes: tuple[str, ...] = ()) -> Column:
    """The first rule that a source's address breaks."""
    scheme, host, path = (F.regexp_extract(url, "^([a-z]+)://([^/:?#]+)[^/?#]*([^?#]*)", k) for k in (1, 2, 3))
    allowed = F.lit(True) if not prefixes else F.coalesce(*(F.when(F.startswith(path, F.lit(x)), F.lit(True)) for x in prefixes), F.lit(False))
    return F.when(host == "", "invalid-url").when(~scheme.isin("https", "http"), "invalid-protocol").when(~host.isin(*hosts), "host-not-allowed").when(~allowed, "path-not-allowed").when(url.rlike(_SHELL), "shell-interpolation-url")


def size_error(actual: Column, expected: Column, most: int) -> Column:
    return F.when(expected.isNotNull() & (actual != expected), "size-mismatch").when(actual > most, "size-exceeds-limit").when(actual <= 0, "invalid-size")
