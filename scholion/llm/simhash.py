"""Near-duplicate groups by SimHash fingerprints and meet-in-the-middle ball hashing.

A fingerprint of 64 bits sums up the 4-word shingles of a text. Two fingerprints link where they
differ in at most four bits; then some value lies within two bits of both. So every distinct
fingerprint stands for all its variants within two bits (2,081 of them), variants meet by value,
and whatever collides is verified.

The variants themselves are never shuffled. A linear map over bits gives each value a block
number, and that of ``f ^ e`` is that of ``f`` xor that of the pattern ``e``. A fingerprint
travels once to each block in which it has variants, and the block makes just those variants
again from a table of patterns by block number: 8 bytes for each block instead of 16 for each
variant. Blocks double in number once a block's fingerprints would outgrow ``block_prints``; inside
a block, finer block numbers bound the variants in memory at a time. No collision is dropped.

All fingerprints that share a variant are within four bits of one another, so a colliding run
links its members to its least one, not in pairs. Each block returns a spanning forest, and
``components`` joins the forests by hooking and pointer jumping, in rounds of joins and minima that
pre-aggregate, whose results are written to the shared folder.

One fingerprint in a radius of four finds exact copies and most copies of a shingle similarity of
0.95; ``tables`` of independent fingerprints find more, since a link in any of them counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.llm.common import discard, materialize, python_ready, table

WORDS = 4
SEED = 42
RADIUS = 4
#: Blocks at least, as a power of two, and fingerprints that a block holds at most before blocks double.
BLOCK_BITS = 6
BLOCK_PRINTS = 1 << 25
#: Variants of a block in memory at a time, about.
VARIANTS_AT_ONCE = 1 << 21

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_HASHES_AT_ONCE = 1 << 16


def simhashes(text: str, words: int = WORDS, seed: int = SEED, tables: int = 1) -> list[int]:
    """The fingerprints of a text, one for each table: unsigned, zero if it has no words. Later tables mix the first one's shingle hashes anew."""
    found = text.encode().translate(_LOWER).split()
    if not found:
        return [0] * tables
    line = b" ".join(found)
    ends, at = [], -1
    for word in found:
        at += len(word) + 1
        ends.append(at)
    starts = [0, *(x + 1 for x in ends[:-1])]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[a:b], seed) for a, b in zip(starts, ends[words - 1 :])] or [digest(line, seed)]
    counts = np.zeros((tables, 64), dtype=np.int64)
    for k in range(0, len(hashes), _HASHES_AT_ONCE):
        part = np.array(hashes[k : k + _HASHES_AT_ONCE], dtype="<u8")
        for table in range(tables):
            if table:
                part = part * np.uint64(0x9E3779B97F4A7C15)
                part = (part ^ part >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
                part ^= part >> np.uint64(29)
            counts[table] += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return [int(np.packbits(x * 2 > len(hashes), bitorder="little").view("<u8")[0]) for x in counts]


def simhash(text: str, words: int = WORDS, seed: int = SEED) -> int:
    return simhashes(text, words, seed)[0]


def _spread(x: int) -> int:
    """A well mixed 64-bit value of a small integer."""
    x = (x + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x = (x ^ x >> 27) * 0x94D049BB133111EB & (1 << 64) - 1
    return x ^ x >> 31


def block_columns(bits: int) -> np.ndarray:
    """The linear map: the block number of each single bit. Block numbers of fewer bits are their upper ones."""
    return np.array([_spread(k) >> (64 - bits) if bits else 0 for k in range(64)], dtype=np.int64)


def block_of(values: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(len(values), dtype=np.int64)
    for k, column in enumerate(block_columns(bits)):
        out ^= np.where(values >> np.uint64(k) & np.uint64(1), column, 0)
    return out


def patterns_by_block(bits: int) -> list[np.ndarray]:
    """All patterns of at most two bits, by their block number."""
    one = [1 << k for k in range(64)]
    every = np.array([0, *one, *(a | b for i, a in enumerate(one) for b in one[:i])], dtype=np.uint64)
    numbers = block_of(every, bits)
    order = np.argsort(numbers, kind="stable")
    return np.split(every[order], np.searchsorted(numbers[order], np.arange(1, 1 << bits)))


def forest(links: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """The least node of each node's component, for nodes 0 to n - 1."""
    a, b = links
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if not (x != y).any():
            return root
        least = np.minimum(x, y)
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while (root[root] != root).any():
            root = root[root]


def linked_in_block(prints: np.ndarray, block: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints with the least one of their component, as far as variants of this block show it; those alone are left out."""
    prints = np.unique(prints)
    fine = bits
    while fine < 16 and len(prints) * 2081 >> fine > VARIANTS_AT_ONCE:
        fine += 1
    patterns, numbers = patterns_by_block(fine), block_of(prints, fine)
    order = np.argsort(numbers, kind="stable")
    classes = np.split(order, np.searchsorted(numbers[order], np.arange(1, 1 << fine)))
    root = np.arange(len(prints))
    for target in range(block << fine - bits, block + 1 << fine - bits):
        made = [(members, patterns[target ^ c]) for c, members in enumerate(classes) if len(members) and len(patterns[target ^ c])]
        if not made:
            continue
        variants = np.concatenate([(prints[members][:, None] ^ found[None, :]).ravel() for members, found in made])
        owners = np.concatenate([np.repeat(members.astype(np.int32), len(found)) for members, found in made])
        order = np.argsort(variants)
        variants, owners = variants[order], owners[order]
        same = variants[1:] == variants[:-1]
        if not same.any():
            continue
        first = np.concatenate([[True], ~same])
        heads = np.flatnonzero(first)[np.cumsum(first) - 1][1:][same]
        a, b = owners[heads].astype(np.int64), owners[1:][same].astype(np.int64)
        close = np.bitwise_count(prints[a] ^ prints[b]) <= RADIUS
        pairs = np.unique(a[close] * len(prints) + b[close])
        a, b = pairs // len(prints), pairs % len(prints)
        root = forest((np.concatenate([a, np.arange(len(prints))]), np.concatenate([b, root])), len(prints))
    linked = np.flatnonzero(root != np.arange(len(prints)))
    return prints[linked], prints[root[linked]]


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, tables: int = 1) -> DataFrame:
    """(id, ``text_hash``, ``print``, ``more``) for each row: the first fingerprint and an array of the other tables', as signed integers. A null text has no words."""
    kept = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"), F.col(text_col).alias("text"))
    fields = T.StructType([T.StructField("id", kept.schema["id"].dataType), T.StructField("text_hash", T.LongType()), T.StructField("print", T.LongType()), T.StructField("more", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([simhashes(x.as_py() or "", words, SEED, tables) for x in batch.column(2)], dtype=np.uint64).view(np.int64)
            more = pa.array(list(found[:, 1:]), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found[:, 0]), more], names=fields.names)

    return python_ready(kept).mapInArrow(run, fields)


def links(prints: DataFrame, count: int) -> DataFrame:
    """(``a``, ``b``): links that join all fingerprints within the radius, directly or by way of others. ``prints`` holds ``count`` distinct ones."""
    bits = BLOCK_BITS
    while count * min(1.0, 2081 / 2**bits) > BLOCK_PRINTS:
        bits += 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = np.array([len(x) > 0 for x in patterns_by_block(bits)])
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            numbers = block_of(values, bits)
            for block in range(1 << bits):
                if len(mine := values[has[numbers ^ block]]):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([mine.tobytes()], pa.binary())], names=["block", "packed"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = -1, []

        def linked() -> Iterator[pa.RecordBatch]:
            a, b = linked_in_block(np.concatenate(parts), block, bits) if parts else (np.zeros(0, np.uint64),) * 2
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        for batch in batches:
            for number, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if number != block:
                    yield from linked()
                    block, parts = number, []
                parts.append(np.frombuffer(packed.as_py(), dtype=np.uint64))
        yield from linked()

    dealt = python_ready(prints).select("print").mapInArrow(deal, "block int, packed binary")
    # in order of block, so that a task holds one block at a time
    return dealt.repartition(1 << bits, "block").sortWithinPartitions("block").mapInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(``node``, ``root``) for each node of the edges (``a``, ``b``): the least node that it reaches.

    In each round a node takes the least root among its neighbours and then its root's root, so
    the rounds grow with the logarithm of the longest path. It ends when no root changes.
    """
    both = materialize(edges.union(edges.select("b", "a")), "edges")
    roots = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "roots")
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = roots.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        up = roots.select(F.col("node").alias("mid"), F.col("root").alias("up"))
        jumped = hooked.join(up, "mid").select("node", F.least("mid", "up").alias("root"), (F.col("old") != F.least("mid", "up")).alias("moved"))
        after = materialize(jumped, "roots")
        discard(roots)
        if after.filter("moved").isEmpty():
            discard(both)
            return after.select("node", "root")
        roots = after


def _groups(prints: DataFrame, distinct: DataFrame, tables: int) -> DataFrame:
    """(``print``, ``root``) for each first fingerprint: the least one in its group.

    Groups of the first table are joined further by the links of each later one. There, what links
    are groups, so links inside a group, which are nearly all, fall away before anything is joined.
    """
    roots = components(links(distinct, distinct.count()))
    known = distinct.select("print").join(roots.withColumnRenamed("node", "print"), "print", "left").select("print", F.coalesce("root", "print").alias("root"))
    if tables > 1:
        known = materialize(known, "groups")
    for table in range(1, tables):
        pairs = prints.select(F.col("more")[table - 1].alias("other"), "print").distinct().join(known, "print").select("other", "root").distinct()
        pairs = materialize(pairs, "pairs")
        heads = materialize(pairs.groupBy("other").agg(F.min("root").alias("head")), "heads")
        edges = pairs.join(heads, "other").filter("root <> head").select(F.col("root").alias("a"), F.col("head").alias("b"))
        linked = links(heads.select(F.col("other").alias("print")), heads.count())
        for end in ("a", "b"):
            linked = linked.join(heads.select(F.col("other").alias(end), F.col("head").alias(f"head_{end}")), end)
        edges = edges.union(linked.filter("head_a <> head_b").select(F.col("head_a").alias("a"), F.col("head_b").alias("b"))).distinct()
        joined = components(edges).select(F.col("node").alias("root"), F.col("root").alias("top"))
        before, known = known, materialize(known.join(joined, "root", "left").select("print", F.coalesce("top", "root").alias("root")), "groups")
        discard(before, pairs, heads)
    return known


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, tables: int = 1) -> DataFrame:
    """One row for each row of ``docs``: the id, ``text_hash``, ``fingerprint`` (16 hex digits), ``component_id`` and ``keep``.

    Documents link where the fingerprints of their shingles of ``words`` words differ in at most four
    bits, in the first of ``tables`` or any other. ``component_id`` is the smallest id in the group of
    documents that links join, the document's own included. ``keep`` is true for the rows of the one
    document (id and text) that stands for its group; rows that repeat it whole are true too.

    A null text counts as empty; texts without words have fingerprint zero and link like any
    other. Repeated ids are separate documents where their texts differ; a null id is larger than
    all others, and a group of null ids alone has a null ``component_id``. An empty table gives an
    empty result. Columns other than the two named are ignored, so none can clash. Whole texts
    count, however long.
    """
    prints = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, words=words, tables=tables), "prints")
    order = F.struct(F.col("id").isNull(), "id", "text_hash")
    distinct = materialize(prints.groupBy("print").agg(F.min(order).alias("first")), "distinct")
    grouped = distinct.join(_groups(prints, distinct, tables), "print").select("print", "root", "first")
    firsts = grouped.groupBy("root").agg(F.min("first").alias("least"))
    known = grouped.join(firsts, "root").select("print", "least")
    return prints.join(known, "print").select(
        F.col("id").alias(id_col),
        "text_hash",
        F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"),
        F.col("least.id").alias("component_id"),
        (F.col("least.id").eqNullSafe(F.col("id")) & (F.col("least.text_hash") == F.col("text_hash"))).alias("keep"),
    )


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, tables: int = 1) -> DataFrame:
    """The rows of ``docs``, whole, that stand for their groups: one for each group.

    Of rows that repeat the kept document's id and text, one stays. Other columns may have any name.
    Texts are shuffled once, after rows that repeat have met within their partitions.
    """
    own = [F.coalesce(F.col(id_col).cast("string"), F.lit("\0")).alias("__own_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__own_hash")]
    marked = near_duplicates(docs, id_col=id_col, text_col=text_col, words=words, tables=tables).filter("keep")
    marked = marked.select(own[0], F.col("text_hash").alias("__own_hash")).distinct()
    found = docs.select("*", *own)
    return found.dropDuplicates(["__own_id", "__own_hash"]).join(marked, ["__own_id", "__own_hash"], "left_semi").select(*(found[x] for x in docs.columns))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
