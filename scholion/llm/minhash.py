"""Near-duplicate groups by one-permutation MinHash, banded buckets and star-shaped candidate edges.

A document is the set of its distinct 4-word shingles, as 64-bit keys; documents of equal sets are
one node. The sorted keys are the one permutation: cut into equal ranges ("bins"), the least key of
each is the set's signature, and an empty bin borrows that of another bin drawn by a hash of the bin
and the attempt (optimal densification). Four bins make a band, and nodes that agree in a band
share a bucket. Sets of few shingles would fill too few bins, so up to ``SHORT`` shingles the
buckets are instead the least keys of a set, as many as any partner of the similarity must share
one of: those lose nothing. Sets up to a quarter longer, which may be their partners, take part in both.

Candidates are stars: each member of a bucket meets only the bucket's least node, so a bucket of n
makes n - 1 edges, not their square. Links are confirmed on full sets, in three rounds:

1. each node against the centre with which it shares most buckets;
2. the other star edges whose ends aren't in one group yet;
3. what stars can't decide: in buckets that still hold several groups, members of different groups
   are compared in blocks dealt to many tasks, by signature and then by set, until no two of them link that aren't
   joined. A block gives no more links than join its groups, never its pairs. Most buckets hold one group by then.

Nodes are 64-bit hashes of full sets; so two different sets of a corpus share one with a chance of
about n^2 / 2^65. A pair at a similarity of exactly 0.8 shares no bucket with a chance of 3e-6 where it
fills its bins, and of about 1e-4 at 41 shingles; at 0.9 of less than 1e-10.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.llm.common import discard, materialize, python_ready, row_key, table
from scholion.llm.simhash import components
from scholion.llm.words import LOWER, WordHashes, mix, runs

WORDS = 4
#: Links: 100 times the intersection is at least this many times the union.
PERCENT = 80
BINS, ROWS = 96, 4
#: Shingles up to which sets are met by their least keys.
SHORT = 40
#: Candidate nodes whose row keys are broadcast at most (about 10 MB); more are joined in a shuffle.
BROADCAST_NODES = 200_000
#: Members that a centre's task compares at most; more centres' tasks share them. Members of a block in the last round.
STAR, BLOCK = 2_000, 512
#: Standard deviations of a signature's estimate below the similarity down to which a pair of the last round is compared by set.
MARGIN = 5

_STARTS = np.array([(k << 64) // BINS for k in range(BINS)], dtype=np.uint64)
_BANDS = BINS // ROWS


def shingle_set(text: str, hashes: WordHashes, words: int = WORDS) -> np.ndarray:
    """The distinct shingle keys in rising order; the whole sequence is one shingle where there are fewer words."""
    found = hashes.of(text.encode().translate(LOWER).split())
    keys = np.sort(runs(found, min(words, len(found)) or 1))
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def signatures(sets: list[np.ndarray], starts: np.ndarray = _STARTS) -> np.ndarray:
    """The least key of each bin, densified: a row for each set, none of them empty."""
    minima, full = np.zeros((len(sets), BINS), dtype=np.uint64), np.zeros((len(sets), BINS), dtype=bool)
    for k, keys in enumerate(sets):
        ends = np.append(np.searchsorted(keys, starts.astype(keys.dtype)), len(keys))
        full[k] = ends[1:] > ends[:-1]
        minima[k, full[k]] = keys[ends[:-1][full[k]]]
    rows, bins = np.nonzero(~full)
    attempt = 0
    while len(rows):
        source = (mix((bins + BINS * attempt + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BINS)).astype(np.int64)
        hit = full[rows, source]
        minima[rows[hit], bins[hit]] = minima[rows[hit], source[hit]]
        rows, bins, attempt = rows[~hit], bins[~hit], attempt + 1
    return minima


def bands(minima: np.ndarray) -> np.ndarray:
    """A bucket for each band of each row."""
    parts = minima.reshape(len(minima), _BANDS, ROWS)
    total = np.broadcast_to(np.arange(1, _BANDS + 1, dtype=np.uint64) << np.uint64(32), parts.shape[:2]).copy()
    for k in range(ROWS):
        total = mix(total + parts[:, :, k])
    return total


def can_link(size: np.ndarray | int, other: np.ndarray | int, percent: int = PERCENT) -> np.ndarray:
    return 100 * np.minimum(size, other) >= percent * np.maximum(size, other)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sets of rising keys reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return False
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def signed_sets(docs: DataFrame, *, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """For each row: ``id``, ``text_hash``, ``node``, ``size``, and its buckets (``bands``, ``least``)."""
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    fields = T.StructType(
        [T.StructField("id", kept.schema["id"].dataType)]
        + [T.StructField(x, T.LongType()) for x in ("text_hash", "node", "size")]
        + [T.StructField(x, T.ArrayType(T.LongType())) for x in ("bands", "least")]
    )
    reach = SHORT * 100 // percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, text_hashes = batch.column(0), batch.column(1)
            for start in range(0, len(batch), 512):
                sets = [shingle_set(x.as_py() or "", hashes, words) for x in batch.column(2)[start : start + 512]]
                long = [k for k, x in enumerate(sets) if len(x) > SHORT]
                minima = signatures([sets[k] for k in long])
                banded = bands(minima).view(np.int64)
                place = {k: i for i, k in enumerate(long)}
                nodes = [xxhash.xxh64_intdigest(x.tobytes(), 7) - 2**63 if len(x) else None for x in sets]
                least = [x[: len(x) - -(-percent * len(x) // 100) + 1].view(np.int64) if 0 < len(x) <= reach else [] for x in sets]
                columns = [
                    pa.array(nodes, pa.int64()),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([banded[place[k]] if k in place else [] for k in range(len(sets))], pa.list_(pa.int64())),
                    pa.array(least, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays([ids[start : start + 512], text_hashes[start : start + 512], *columns], names=fields.names)

    return python_ready(kept).mapInArrow(run, fields)


def _full_sets(docs: DataFrame, wanted: DataFrame, *, id_col: str, text_col: str, words: int) -> DataFrame:
    """(``node``, ``keys``) of the rows in ``wanted`` (``_id``, ``_hash``, ``node``); a row that repeats may give its set again."""
    keyed = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text"))
    few = wanted.count() <= BROADCAST_NODES
    found = keyed.join(F.broadcast(wanted) if few else wanted, ["_id", "_hash"]).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, seen = WordHashes(), set()
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if node not in seen:
                    seen.add(node)
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.int64()), pa.array([shingle_set(text.as_py() or "", hashes, words).tobytes()], pa.binary())], names=["node", "keys"])

    return python_ready(found).mapInArrow(run, "node long, keys binary")


def confirmed(edges: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the edges (``a``, ``b``) whose full sets reach the similarity.

    The sets of a centre's members stream past the centre's own. A centre of many members is split
    over tasks, to each of which its set goes.
    """
    shares = edges.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("int").alias("shares"))
    centres = shares.join(sets.withColumnRenamed("node", "a"), "a").select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), "keys")
    members = edges.join(shares, "a").select("a", F.pmod(F.hash("b"), F.col("shares")).alias("share"), "b").join(sets.withColumnRenamed("node", "b"), "b").select("a", "share", "b", "keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            found: list[tuple[int, int]] = []
            for a, b, keys in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
                theirs = np.frombuffer(keys.as_buffer(), dtype=np.uint64)
                if b is None:
                    centre, own = a, theirs.copy()
                elif a == centre and linked(own, theirs, percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    both = python_ready(centres.unionByName(members)).repartition("a", "share").sortWithinPartitions("a", "share", F.col("b").asc_nulls_first())
    return both.mapInArrow(run, "a long, b long")


class _Groups(dict):
    """Which groups have been joined so far."""

    def of(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            x = up
        return x


def _block_links(rows: list[tuple], percent: int) -> list[tuple[int, int]]:
    """Links between members of a block that weren't in one group: as many as join them, not all.

    Rows are (short, low chunk, high chunk, bucket, band, chunk, node, root, size, upper key halves). A pair is tried
    only in the first bucket that it shares.
    """
    short, low, high, bucket, band = rows[0][:5]
    nodes, sizes = (np.array([r[k] for r in rows], dtype=np.int64) for k in (6, 8))
    keys = [np.frombuffer(r[9], dtype="<u4") for r in rows]
    chunk, groups, out = np.array([r[5] for r in rows]), _Groups(), []
    left, right = (np.flatnonzero(chunk == x) for x in (low, high))
    minima = None if short else signatures(keys, _STARTS >> np.uint64(32))
    before = np.uint32((bucket % 2**64) >> 32)
    for i in left:
        own = groups.of(rows[i][7])
        others = right[(np.array([groups.of(rows[j][7]) for j in right]) != own) & can_link(sizes[right], sizes[i], percent)]
        if low == high:
            others = others[nodes[others] > nodes[i]]
        if not short and len(others):
            agree = minima[others] == minima[i]
            p = percent / 100
            good = agree.mean(axis=1) >= p - MARGIN * np.sqrt(p * (1 - p) / np.minimum(np.minimum(sizes[others], sizes[i]), BINS))
            good &= ~agree[:, : band * ROWS].reshape(len(others), band, ROWS).all(axis=2).any(axis=1)
            others = others[good][np.argsort(-agree.mean(axis=1)[good], kind="stable")]
        for j in others:
            if groups.of(rows[i][7]) == groups.of(rows[j][7]) or short and len(np.intersect1d(keys[i][keys[i] < before], keys[j][keys[j] < before])):
                continue
            if linked(keys[i], keys[j], percent):
                groups[groups.of(rows[j][7])] = groups.of(rows[i][7])
                out.append((min(int(nodes[i]), int(nodes[j])), max(int(nodes[i]), int(nodes[j]))))
    return out


def _blocks_met(members: DataFrame, percent: int) -> DataFrame:
    """(``a``, ``b``): links that join members of one bucket (``bucket``, ``short``, ``band``, ``node``, ``root``, ``size``, ``upper``) but of different groups.

    A bucket of many members is cut into chunks by a hash of the node, and each pair of chunks is
    a block of its own, so no task holds more than two chunks at a time. Sets are compared by the
    upper halves of their keys, which can only let too much through.
    """
    counts = members.groupBy("bucket", "short").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("chunks"))
    dealt = members.join(counts, ["bucket", "short"]).withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("short", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "bucket", "band", "chunk", "node", "root", "size", "upper")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []

        def ended() -> Iterator[pa.RecordBatch]:
            if len({r[7] for r in rows}) > 1 and (found := _block_links(rows, percent)):
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:4] != block:
                    yield from ended()
                    block, rows = row[:4], []
                rows.append(row)
        yield from ended()

    order = ["short", "low", "high", "bucket"]
    return python_ready(dealt).repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def _upper_halves(sets: DataFrame) -> DataFrame:
    """(``node``, ``upper``): the sets' keys at half their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            halves = [(np.frombuffer(x.as_buffer(), dtype=np.uint64) >> np.uint64(32)).astype("<u4").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(halves, pa.binary())], names=["node", "upper"])

    return python_ready(sets.select("node", "keys")).mapInArrow(run, "node long, upper binary")


def _joined(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """(``node``, ``root``) after further links; a node that no link touches isn't listed."""
    if known is None:
        return components(links)
    ends = links
    for end in ("a", "b"):
        ends = ends.join(known.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}")), end, "left").withColumn(end, F.coalesce(f"root_{end}", end)).drop(f"root_{end}")
    more = materialize(components(ends.filter("a <> b").select("a", "b").distinct()), "more")
    tops = more.select(F.col("node").alias("root"), F.col("root").alias("top"))
    grown = known.join(tops, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    out = materialize(grown.union(more.join(known, "node", "left_anti").select("node", "root")), "grown")
    discard(more)
    return out


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one group."""
    roots = [known.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b")]
    found = pairs.join(roots[0], "a", "left").join(roots[1], "b", "left")
    return found.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def minhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: the id, ``text_hash``, ``n_shingles`` and ``component_id``, the smallest id that links reach.

    A null text has no words; texts without words are linked with nothing, and their component is
    their own id. Repeated ids are separate documents where their texts differ, rows that repeat id
    and text share a result, and a null id is larger than all others. Ties can't change a result.
    An empty table gives an empty result. Whole texts count, however long; other columns are ignored.
    """
    signed = materialize(signed_sets(docs, id_col=id_col, text_col=text_col, words=words, percent=percent), "signed")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    nodes = signed.filter("node IS NOT NULL").groupBy("node").agg(F.min(order).alias("first"), *(F.first(x).alias(x) for x in ("size", "bands", "least")))
    nodes = materialize(nodes, "nodes")
    first = materialize(nodes.select("node", "first"), "first")
    buckets = nodes.select("node", "size", F.lit(False).alias("short"), F.posexplode("bands").alias("band", "bucket")).union(nodes.select("node", "size", F.lit(True), F.posexplode("least")))
    heads = buckets.groupBy("bucket", "short").agg(F.min(F.struct("node", "size")).alias("head"), F.count("*").alias("members")).filter("members > 1")
    members = materialize(buckets.join(heads, ["bucket", "short"]).select("bucket", "short", "band", "node", "size", "head"), "members")
    star = members.filter("node <> head.node").filter(100 * F.least("size", "head.size") >= percent * F.greatest("size", "head.size"))
    star = materialize(star.groupBy(F.col("head.node").alias("a"), F.col("node").alias("b")).agg(F.count("*").alias("shared")), "star")

    ends = members.select("node").distinct()
    wanted = first.join(ends, "node").select(F.coalesce(F.col("first.id").cast("string"), F.lit("\0")).alias("_id"), F.col("first.text_hash").alias("_hash"), "node")
    wanted = materialize(wanted, "wanted")
    sets = materialize(_full_sets(docs, wanted, id_col=id_col, text_col=text_col, words=words), "sets")

    nearest = star.groupBy("b").agg(F.max_by("a", F.struct("shared", "a")).alias("a")).select("a", "b")
    known = _joined(None, materialize(confirmed(nearest, sets, percent), "links"))
    others = materialize(_apart(star.select("a", "b").join(nearest, ["a", "b"], "left_anti"), known), "others")
    known = _joined(known, materialize(confirmed(others, sets, percent), "links"))

    grouped = members.join(known, "node", "left").select("bucket", "short", "band", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = grouped.groupBy("bucket", "short").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket", "short")
    mixed = grouped.join(mixed, ["bucket", "short"]).join(_upper_halves(sets), "node")
    rest = materialize(_blocks_met(mixed, percent), "rest")
    known = _joined(known, materialize(confirmed(rest, sets, percent), "links"))
    discard(nodes, members, star, wanted, sets, others, rest)

    keyed = first.join(known, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "first")
    firsts = keyed.groupBy("root").agg(F.min("first").alias("least"))
    component = keyed.join(firsts, "root").select("node", "least")
    out = signed.select("id", "text_hash", "node", "size").join(component, "node", "left")
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("size").alias("n_shingles"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("least.id")).alias("component_id"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
