"""Document fingerprints by Order MinHash.

A text's k-mers of code points are numbered by occurrence, so that repeats differ. For each of
``sketches`` hash functions the ``width`` least numbered k-mers are taken, put back in text order,
and hashed as a tuple. Two texts agree in a position of their fingerprints where they share those
k-mers in the same order, so that the share of equal positions falls with edit distance and not
only with the sets of k-mers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.llm.common import python_ready, table

K = 8
WIDTH = 2
SKETCHES = 64
#: Ranges of ids for each shuffle partition, so that hashing ranges to partitions evens out.
RANGES = 8

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x100000001B3)
_CANDIDATES = 6
_CHUNK = 1024
#: Bits of a k-mer's hash that give way to its place while k-mers are grouped; longer texts are grouped by a slower sort.
_PLACE_BITS = 20
_ODD_MIX = np.uint32(0x85EBCA6B)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _functions(sketches: int) -> np.ndarray:
    """An odd multiplier for each hash function."""
    return (_mix(np.arange(1, sketches + 1, dtype=np.uint64) * _MULTIPLIER) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def hashed(low: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The values that hash functions give to 32-bit hashes: multiplied, folded and multiplied again, so that no order carries over from one function to another."""
    out = low * by
    out ^= out >> np.uint32(15)
    out *= _ODD_MIX
    return out


def numbered_kmers(text: str, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each k-mer with its number of occurrence, and its place. A shorter text is one k-mer; an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    if not len(codes):
        return codes, codes
    n = max(1, len(codes) - k + 1)
    value = np.zeros(n, dtype=np.uint64)
    for j in range(min(k, len(codes))):
        value = value * _BASE + codes[j : j + n] + np.uint64(1)
    value = _mix(value * _MULTIPLIER)
    bits = np.uint64(_PLACE_BITS)
    if n <= 1 << _PLACE_BITS:
        # the place goes in the low bits, so one sort both groups equal k-mers and keeps text order
        key = np.sort((value >> bits << bits) | np.arange(n, dtype=np.uint64))
        value, place = key >> bits, key & ((np.uint64(1) << bits) - np.uint64(1))
    else:
        value = value >> bits
        place = np.argsort(value, kind="stable")
        value, place = value[place], place.astype(np.uint64)
    at = np.arange(n, dtype=np.int64)
    first = np.empty(n, dtype=bool)
    first[0] = True
    np.not_equal(value[1:], value[:-1], out=first[1:])
    number = at - np.maximum.accumulate(np.where(first, at, 0))
    return _mix(value * _MULTIPLIER + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), place


@dataclass
class Sketch:
    """A fingerprint and what it was taken from: for each hash function (``rows``) the values below ``share``, their k-mers and places."""

    fingerprint: np.ndarray
    share: float
    rows: np.ndarray
    values: np.ndarray
    kmers: np.ndarray
    places: np.ndarray


def _candidates(kmers: np.ndarray, places: np.ndarray, sketches: int, share: float) -> tuple[np.ndarray, ...]:
    """The rows, values, k-mers and places where a hash function gives less than ``share`` of its range."""
    low, by = (kmers >> np.uint64(32)).astype(np.uint32), _functions(sketches)[:, None]
    most = None if share >= 1 else np.uint32(share * 2**32)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64))]
    for at in range(0, len(low), _CHUNK):
        part = low[at : at + _CHUNK]
        values = hashed(part[None, :], by).ravel()
        hit = np.flatnonzero(values < most) if most is not None else np.arange(len(values))
        rows = hit // len(part)
        found.append((rows, values[hit], hit - rows * len(part) + at))
    rows, values, columns = (np.concatenate(x) for x in zip(*found, strict=True))
    return rows, values, kmers[columns], places[columns]


def _least(found: tuple[np.ndarray, ...], take: int, sketches: int) -> np.ndarray | None:
    """The fingerprint of the ``take`` least candidates of each function, in text order; none where a function has fewer."""
    rows, values, kmers, places = found
    counts = np.bincount(rows, minlength=sketches)
    if counts.min() < take:
        return None
    order = np.lexsort((places, rows.astype(np.uint64) << np.uint64(32) | values))
    chosen = order[(np.cumsum(counts) - counts)[:, None] + np.arange(take)]
    chosen = np.take_along_axis(chosen, np.argsort(places[chosen], axis=1), axis=1)
    out = np.full(sketches, take, dtype=np.uint64)
    for j in range(take):
        out = _mix((out ^ kmers[chosen[:, j]]) * _MULTIPLIER)
    return (out >> np.uint64(32)).astype(np.uint32)


def sketched(text: str, k: int = K, width: int = WIDTH, sketches: int = SKETCHES) -> Sketch:
    """The text's fingerprint with its candidates."""
    kmers, places = numbered_kmers(text, k)
    n = len(kmers)
    if not n:
        return Sketch(np.zeros(sketches, dtype=np.uint32), 1.0, *_candidates(kmers, places, sketches, 1.0))
    share = _CANDIDATES * width / n
    while True:
        found = _candidates(kmers, places, sketches, share)
        out = _least(found, min(width, n), sketches)
        if out is not None:
            return Sketch(out, share, *found)
        share *= 4


def order_minhash(text: str, k: int = K, width: int = WIDTH, sketches: int = SKETCHES) -> np.ndarray:
    """The fingerprint: ``sketches`` unsigned 32-bit integers, all zero for the empty text."""
    return sketched(text, k, width, sketches).fingerprint


def continued(before: Sketch, text: str, same: int, k: int = K, width: int = WIDTH, sketches: int = SKETCHES) -> np.ndarray:
    """The fingerprint of a text that begins with the first ``same`` code points of another, whose sketch is known.

    K-mers within that beginning have the same numbers and values in both texts, so only the others are hashed.
    """
    kmers, places = numbered_kmers(text, k)
    if not len(kmers):
        return np.zeros(sketches, dtype=np.uint32)
    kept = max(0, same - k + 1)
    old, new = before.places < kept, places >= kept
    more = _candidates(kmers[new], places[new], sketches, before.share)
    found = tuple(np.concatenate((x[old], y)) for x, y in zip((before.rows, before.values, before.kmers, before.places), more, strict=True))
    out = _least(found, min(width, len(kmers)), sketches)
    return order_minhash(text, k, width, sketches) if out is None else out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The share of positions in which two fingerprints agree."""
    return float((a == b).mean())


def spell(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH, sketches: int = SKETCHES) -> DataFrame:
    """(id, ``fingerprint``) for each row, 8 hex digits for each hash function.

    A null text counts as empty, and empty texts have a fingerprint of their own (zeros). Equal
    texts have equal fingerprints. Rows are taken one by one, whatever their ids; an empty table
    gives an empty result; columns other than the two named are ignored.
    """
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    fields = T.StructType([T.StructField(id_col, kept.schema["id"].dataType), T.StructField("fingerprint", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [spell(order_minhash(x.as_py() or "", k, width, sketches)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=fields.names)

    return python_ready(kept).mapInArrow(run, fields)


def with_following(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """Rows (``range``, ``guest``, ``id``, ``hash``, ``text``) to be read in order within each range, and the number of partitions.

    Rows are in order of id and, where ids repeat, of a hash of the text. They are cut into ranges of
    about equal counts: first by ids, and an id that fills several ranges (as null may) by its hashes.
    The rows that begin a range come once more, as guests, at the end of the range before it (those
    of the first range at the end of the last), so that each row's follower lies in the same range.
    One shuffle moves each text once; the driver sees the ends of the ranges alone, a few for each
    shuffle partition.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    shares = [k / (RANGES * parts) for k in range(1, RANGES * parts)]
    cuts = keyed.agg(F.percentile_approx("id", shares or [0.5], F.lit(max(10_000, 4 * RANGES * parts))).alias("x")).first()["x"] or []
    cuts = np.array(cuts, dtype=np.int64)

    def ranges(ids: pd.Series, hashes: pd.Series) -> np.ndarray:
        """The range before an id's first cut, or one for each of the id's cuts by how high the hash is."""
        ids = ids.to_numpy()
        first, after = np.searchsorted(cuts, ids, side="left"), np.searchsorted(cuts, ids, side="right")
        height = (hashes.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64
        own = first + 1 + np.minimum((height * (after - first)).astype(np.int64), after - first - 1)
        return np.where(after - first > 1, own, after).astype(np.int32)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        return pd.Series(ranges(ids, hashes))

    first = F.min(F.struct("id", "hash"))
    ends = python_ready(keyed.select("id", "hash")).groupBy(range_of("id", "hash").alias("range")).agg(first.alias("x")).orderBy("range").collect()
    before = {(x["x"]["id"], x["x"]["hash"]): ends[k - 1]["range"] for k, x in enumerate(ends)}

    @F.pandas_udf("array<int>")
    def places(ids: pd.Series, hashes: pd.Series) -> pd.Series:
        own = ranges(ids, hashes)
        return pd.Series([[int(at), -1 - before[key]] if key in before else [int(at)] for key, at in zip(zip(ids.tolist(), hashes.tolist()), own, strict=True)])

    dealt = keyed.select(F.explode(places("id", "hash")).alias("at"), "id", "hash", "text")
    dealt = dealt.select(F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(F.col("at")).alias("range"), (F.col("at") < 0).alias("guest"), "id", "hash", "text")
    return dealt.repartition(parts, "range").sortWithinPartitions("range", "guest", "id", "hash"), parts


def edited_likeness(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = K, width: int = WIDTH, sketches: int = SKETCHES) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how alike they and the next document's are.

    The edited text is the text with its last quarter of code points (rounded down) replaced by the
    first as many, or all, of the next document: the next in ascending order of id, then of a hash of
    the text; after the last the first. Rows that repeat both id and text are one document, so they
    get equal results. Ids are integers; a null id comes first and is given back as null. A document
    that is alone follows itself. Null texts count as empty. An empty table gives an empty result.
    """
    ordered, _ = with_following(docs, id_col=id_col, text_col=text_col)
    names = [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    fields = T.StructType([T.StructField(n, t) for n, t in zip(names, [T.LongType(), T.LongType(), T.StringType(), T.StringType(), T.StringType(), T.DoubleType(), T.DoubleType()], strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the document that waits for its follower: range, guest, id, hash, text, sketch, and how many rows it has
        held: list | None = None
        rows: list[tuple] = []

        def follow(text: str, mark: Sketch) -> None:
            _, guest, was, _, before, own, copies = held
            if guest:
                return
            cut = len(before) // 4
            edited = before[: len(before) - cut] + text[:cut]
            after = continued(own, edited, len(before) - cut, k, width, sketches)
            mine = own.fingerprint
            row = (None if was == -(2**63) else was, len(before), hashlib.sha256(edited.encode()).hexdigest(), spell(mine), spell(after), likeness(mine, after), likeness(mine, mark.fingerprint))
            rows.extend([row] * copies)

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in range(4)]
            for span, guest, name, hashed_text, text in zip(*columns, batch.column(4), strict=True):
                if held is not None and held[0] == span and held[2:4] == [name, hashed_text]:
                    if guest and not held[1]:
                        # the only document of all: it follows itself
                        follow(held[4], held[5])
                        held[1] = True
                    elif not guest:
                        held[6] += 1
                    continue
                if held is None or held[0] != span:
                    held = None
                text = text.as_py()
                mark = sketched(text, k, width, sketches)
                if held is not None:
                    follow(text, mark)
                held = [span, guest, name, hashed_text, text, mark, 1]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows.clear()

    return ordered.mapInArrow(run, fields)


def op2_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
