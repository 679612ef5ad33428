"""Collocations: phrases of two to four words by how much of their parts' uses they make up.

Words and runs of words are 64-bit keys (of the language too), so counting works on arrays. Texts are read three times:

1. Words and pairs are tallied: a task counts about ``CHUNK`` words at a time and sends sorted
   keys and counts to segments (ranges of the key), where they are merged. What occurs less than ``least`` times falls away.
2. Runs of three and four words, all of whose pairs are frequent, are tallied likewise: a longer phrase
   can't be frequent where a part isn't (Apriori). The mappers know frequent pairs by a bitmap of fixed size with two
   bits for each, which may let an infrequent one through, never the reverse. Each segment gets a minimal perfect hash of its candidates, frequent
   words and pairs among them, whose slots hold the keys, so that any other key is known for one. Mappers count
   into one array for each segment (bincount by slot), several of them share a segment, and their arrays are summed.
3. The texts of what the bitmap takes for frequent are sent to the segments, which give those whose slot
   has ``least`` or more. Their cuts are sent to the segments and read by slot.

Everything that grows with the texts is dealt to segments, whose number grows with the texts; only the bitmap
is broadcast. Two different phrases share a key with a chance of about n^2 / 2^65 for n phrases.
"""

from __future__ import annotations

import math
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholion.llm.common import discard, materialize, python_ready, table
from scholion.llm.words import LOWER, WordHashes, mix, runs

LEAST, TOP, COVERED = 30, 2000, 80
LONGEST = 4
#: Bytes of text to a segment, segments at least, and mappers that share one.
SEGMENT_BYTES, SEGMENTS, SHARES = 1 << 27, 128, 2
#: Keys of a tally's row at most: rows of megabytes are costly to keep in a heap.
PIECE = 8_192
#: Words that a task counts at a time, and that it holds as text at a time.
CHUNK, TEXT_CHUNK = 2_000_000, 750_000
#: Bits of the bitmap of frequent keys, as a power of two: 8 MB. A key has two, by its upper and by its lower bits.
BITMAP = 26
#: Keys whose texts a task remembers to have sent.
SENT = 1_000_000

_END = b"\xff"
#: A-Z become small, what ends a piece becomes a byte that no text holds, tabs become blanks.
_BYTES = bytes(0xFF if x in b".,;:!?\x0a\x0b\x0c\x0d" else 0x20 if x == 9 else LOWER[x] for x in range(256))


class PerfectHash:
    """A minimal perfect hash of different keys: each has a slot of its own below their number.

    Level by level, keys that meet no other in a table of twice their number take its bit, and the
    others go on; a slot is the count of bits before. Slots hold their keys, so others have none (-1).
    """

    def __init__(self, keys: np.ndarray) -> None:
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, placed = keys, 0
        while len(rest):
            size = max(64, -(-2 * len(rest) // 64) * 64)
            at = self._place(rest, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            bits = np.packbits(alone, bitorder="little").view("<u8")
            ones = np.cumsum(np.bitwise_count(bits), dtype=np.int64)
            self.levels.append((size, bits, np.concatenate([[0], ones[:-1]]) + placed))
            placed += int(ones[-1])
            rest = rest[~alone[at]]
        self.keys = np.zeros(0, np.uint64)
        slots = self._slots(keys)
        self.keys = np.empty(len(keys), np.uint64)
        self.keys[slots] = keys

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64)) % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1, dtype=np.int64), np.arange(len(keys))
        for level, (size, bits, before) in enumerate(self.levels):
            if not len(rest):
                break
            at = self._place(keys[rest], level, size)
            word, bit = bits[at >> 6], (at & 63).astype(np.uint64)
            has = (word >> bit & np.uint64(1)).astype(bool)
            out[rest[has]] = before[at[has] >> 6] + np.bitwise_count(word[has] & ((np.uint64(1) << bit[has]) - np.uint64(1)))
            rest = rest[~has]
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int64)
        out = self._slots(keys)
        out[self.keys[out] != keys] = -1
        return out


def tag(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode(), 11))


def keys_of(hashes: np.ndarray, n: int, lang: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the runs of ``n`` words, and whether a run lies within a piece (a hash of zero ends one)."""
    keys = mix(runs(hashes, n) ^ lang)
    inside = np.ones(len(keys), dtype=bool)
    for k in range(n):
        inside &= hashes[k : k + len(keys)] != 0
    return keys, inside


def _pieces(texts: list[str]) -> list[bytes]:
    """The words of texts, with an end after each piece and text."""
    return (_END.join(x.encode().translate(_BYTES) for x in texts) + _END).replace(_END, b" \xff ").split()


def _chunks(batches: Iterator[pa.RecordBatch], at_once: int, keep_words: bool) -> Iterator[dict[str, tuple[np.ndarray, list[bytes]]]]:
    """By language, about ``at_once`` words of whole texts: hashes, and words where asked for. Columns are lang and text."""
    hashes = WordHashes({_END: 0})
    held: dict[str, tuple[list[np.ndarray], list[bytes]]] = {}
    count = 0

    def given() -> dict[str, tuple[np.ndarray, list[bytes]]]:
        return {lang: (np.concatenate(arrays), words) for lang, (arrays, words) in held.items()}

    for batch in batches:
        for start in range(0, len(batch), 1024):
            texts: dict[str, list[str]] = {}
            for lang, text in zip(*(batch.column(k)[start : start + 1024].to_pylist() for k in (0, 1)), strict=True):
                texts.setdefault("und" if lang is None else lang, []).append(text or "")
            for lang, found in texts.items():
                words = _pieces(found)
                arrays, kept = held.setdefault(lang, ([], []))
                arrays.append(hashes.of(words))
                count += len(words)
                if keep_words:
                    kept += words
            if count >= at_once:
                yield given()
                held, count = {}, 0
    if count:
        yield given()


def _tallied(keys: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in rising order, and how often each came (or the sums of the counts)."""
    every = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    if counts is None:
        keys.clear()
        return np.unique(every, return_counts=True)
    found, at = np.unique(every, return_inverse=True)
    total = np.zeros(len(found), dtype=np.int64)
    np.add.at(total, at, np.concatenate(counts) if counts else np.zeros(0, np.int64))
    return found, total


def _segment(keys: np.ndarray, segments: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def segment_of(key: Column, segments: int) -> Column:
    return F.shiftright(F.shiftrightunsigned(key, 32) * segments, 32).cast("int")


def _dealt(level: int, keys: np.ndarray, counts: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
    """Rising keys and their counts, in rows of one segment each and of at most ``PIECE`` keys."""
    ends = np.searchsorted(_segment(keys, segments), np.arange(segments + 1)).tolist()
    cuts = [(k, at, min(at + PIECE, ends[k + 1])) for k in range(segments) for at in range(ends[k], ends[k + 1], PIECE)]
    columns = [[x[start:stop].tobytes() for _, start, stop in cuts] for x in (keys, counts.astype(np.int64))]
    arrays = [pa.array([k for k, _, _ in cuts], pa.int32()), pa.array([level] * len(cuts), pa.int32()), *(pa.array(x, pa.binary()) for x in columns)]
    yield pa.RecordBatch.from_arrays(arrays, names=["segment", "level", "keys", "counts"])


_TALLIES = "segment int, level int, keys binary, counts binary"


def tally(texts: DataFrame, levels: tuple[int, ...], segments: int, pairs=None) -> DataFrame:
    """Tallies of the runs of ``levels`` words in ``texts`` (lang, text); of those alone whose pairs are all in the bitmap, if one is given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = pairs.value if pairs is not None else None
        for chunk in _chunks(batches, CHUNK, False):
            good = {}
            for lang, (hashes, _) in chunk.items() if bits is not None else ():
                keys, inside = keys_of(hashes, 2, tag(lang))
                good[lang] = inside & in_bitmap(bits, keys)
            for n in levels:  # one level's keys at a time
                found = []
                for lang, (hashes, _) in chunk.items():
                    keys, inside = keys_of(hashes, n, tag(lang))
                    for k in range(n - 1 if lang in good else 0):
                        inside &= good[lang][k : k + len(keys)]
                    found.append(keys[inside])
                    del keys, inside
                yield from _dealt(n, *_tallied(found), segments)

    return python_ready(texts).mapInArrow(run, _TALLIES)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), dtype=bool)
    rest = np.arange(len(keys))
    for at in (keys >> np.uint64(64 - BITMAP), keys & np.uint64((1 << BITMAP) - 1)):
        at = at[rest]
        rest = rest[(bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)]
    out[rest] = True
    return out


def bitmap(keys: DataFrame) -> np.ndarray:
    """Two bits for each ``key``, at the values of its upper and of its lower bits: of one size, whatever the number of keys."""
    at = keys.select(F.shiftrightunsigned("key", 64 - BITMAP).alias("at")).union(keys.select(F.col("key").bitwiseAND((1 << BITMAP) - 1)))
    found = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits")).toArrow()
    out = np.zeros(1 << BITMAP - 6, dtype=np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def _by_segment(frame: DataFrame, order: tuple[str, ...], fold, schema: str, key: int = 1) -> DataFrame:
    """Streams the rows of each segment, in ``order``, through ``fold(segment key, rows)``; its first ``key`` columns name a segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, state = None, None
        for batch in batches:
            for row in zip(*(c.to_pylist() if not pa.types.is_binary(c.type) else c for c in batch.columns), strict=True):
                if row[:key] != own:
                    if state is not None:
                        yield from state.end()
                    own, state = row[:key], fold(*row[:key])
                state.add(*row[key:])
        if state is not None:
            yield from state.end()

    return python_ready(frame).repartition(*frame.columns[:key]).sortWithinPartitions(*order).mapInArrow(run, schema)


def _numbers(body: pa.Scalar, kind: type) -> np.ndarray:
    return np.frombuffer(body.as_buffer(), dtype=kind)


class _Merge:
    """Sums the tallies of a segment and level; those that meet wait until they are many, so memory follows the different keys."""

    def __init__(self, segment: int, level: int, least: int) -> None:
        self.segment, self.level, self.least = segment, level, least
        self.keys, self.counts, self.waiting = [], [], 0

    def add(self, keys: pa.Scalar, counts: pa.Scalar) -> None:
        self.keys.append(_numbers(keys, np.uint64).copy())
        self.counts.append(_numbers(counts, np.int64).copy())
        self.waiting += len(self.keys[-1])
        if self.waiting > 2 * len(self.keys[0]) + 2_000_000:
            self._merge()

    def _merge(self) -> None:
        keys, counts = _tallied(self.keys, self.counts)
        self.keys, self.counts, self.waiting = [keys], [counts], 0

    def end(self) -> Iterator[pa.RecordBatch]:
        self._merge()
        often = self.counts[0] >= self.least
        if often.any():
            yield pa.RecordBatch.from_arrays([pa.array([self.segment], pa.int32()), pa.array([self.level], pa.int32()), pa.array([self.keys[0][often].tobytes()], pa.binary()), pa.array([self.counts[0][often].tobytes()], pa.binary())], names=["segment", "level", "keys", "counts"])


def merged(tallies: DataFrame, least: int) -> DataFrame:
    """Tallies again, one row for each segment and level: the keys that occur ``least`` times or more."""
    return _by_segment(tallies, ("segment", "level"), lambda segment, level: _Merge(segment, level, least), _TALLIES, key=2)


class _Candidates(_Merge):
    def __init__(self, segment: int) -> None:
        super().__init__(segment, 0, 0)

    def add(self, level: int, keys: pa.Scalar) -> None:
        self.keys.append(_numbers(keys, np.uint64).copy())
        self.waiting += len(self.keys[-1])
        if self.waiting > 2 * len(self.keys[0]) + 2_000_000:
            self.keys, self.waiting = [np.unique(np.concatenate(self.keys))], 0

    def end(self) -> Iterator[pa.RecordBatch]:
        body = pickle.dumps(PerfectHash(np.unique(np.concatenate(self.keys))))
        yield pa.RecordBatch.from_arrays([pa.array([self.segment], pa.int32()), pa.array([body], pa.binary())], names=["segment", "hash"])


class _Bincount:
    """A mapper: counts the tallies that reach it into an array, by slot of the segment's hash."""

    def __init__(self, segment: int, share: int) -> None:
        self.segment, self.counts = segment, np.zeros(0, np.int64)

    def add(self, kind: int, keys: pa.Scalar, counts: pa.Scalar) -> None:
        if kind == 0:
            self.hash = pickle.loads(keys.as_py())
            self.counts = np.zeros(len(self.hash.keys), dtype=np.int64)
            return
        slots, found = self.hash.slots(_numbers(keys, np.uint64)), _numbers(counts, np.int64)
        known = slots >= 0
        # a tally's slots are all different, so this is its bincount, exact beyond 2^53
        self.counts[slots[known]] += found[known]

    def end(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([self.segment], pa.int32()), pa.array([self.counts.tobytes()], pa.binary())], names=["segment", "counts"])


class _Sum:
    def __init__(self, segment: int) -> None:
        self.segment, self.total = segment, None

    def add(self, counts: pa.Scalar) -> None:
        found = _numbers(counts, np.int64)
        self.total = found.copy() if self.total is None else self.total + found

    def end(self) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([self.segment], pa.int32()), pa.array([self.total.tobytes()], pa.binary())], names=["segment", "counts"])


def counted(tallies: DataFrame) -> DataFrame:
    """(``segment``, ``hash``, ``counts``): each segment's perfect hash of its keys, and their counts by slot."""
    hashes = materialize(_by_segment(tallies.select("segment", "level", "keys"), ("segment",), _Candidates, "segment int, hash binary"), "hashes")
    shares = hashes.select("segment", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"), F.lit(0).alias("kind"), F.col("hash").alias("keys"), F.lit(b"").alias("counts"))
    given = tallies.select("segment", F.pmod(F.xxhash64("keys"), F.lit(SHARES)).cast("int").alias("share"), F.lit(1).alias("kind"), "keys", "counts")
    arrays = _by_segment(shares.union(given), ("segment", "share", "kind"), _Bincount, "segment int, counts binary", key=2)
    return materialize(_by_segment(arrays, ("segment",), _Sum, "segment int, counts binary").join(hashes, "segment").select("segment", "hash", "counts"), "counted")


class _Read:
    """Answers requests for counts, of a bounded number at a time."""

    def __init__(self, segment: int) -> None:
        self.asked: list[tuple[int, int]] = []
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, kind: int, request: int, key: int, body: pa.Scalar, counts: pa.Scalar) -> None:
        if kind == 0:
            self.hash, self.counts = pickle.loads(body.as_py()), _numbers(counts, np.int64).copy()
        else:
            self.asked.append((request, key))

    def end(self) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(self.asked), 65536):
            part = np.array(self.asked[start : start + 65536], dtype=np.int64)
            slots = self.hash.slots(part[:, 1].copy().view(np.uint64))
            known = slots >= 0
            yield pa.RecordBatch.from_arrays([pa.array(part[known, 0]), pa.array(part[known, 1]), pa.array(self.counts[slots[known]])], names=["request", "key", "count"])


def read_counts(counts: DataFrame, requests: DataFrame, segments: int) -> DataFrame:
    """(``request``, ``key``, ``count``): each request's count, read in its segment by slot."""
    own = counts.select("segment", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("request"), F.lit(0).cast("long").alias("key"), F.col("hash").alias("body"), "counts")
    asked = requests.select(segment_of(F.col("key"), segments).alias("segment"), F.lit(1).alias("kind"), "request", "key", F.lit(b"").alias("body"), F.lit(b"").alias("counts"))
    return _by_segment(own.union(asked), ("segment", "kind"), _Read, "request long, key long, count long")


def _each(frame: DataFrame) -> DataFrame:
    """A row (``key``, ``level``, ``count``) for each of the keys in tallies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for level, keys, counts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                found = _numbers(keys, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), level, np.int32)), pa.array(_numbers(counts, np.int64))], names=["key", "level", "count"])

    return python_ready(frame.select("level", "keys", "counts")).mapInArrow(run, "key long, level int, count long")


def _frequent(counts: DataFrame, least: int) -> DataFrame:
    """(``key``, ``count``) of all slots with ``least`` or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, array in zip(*batch.columns, strict=True):
                keys, found = pickle.loads(body.as_py()).keys, _numbers(array, np.int64)
                often = found >= least
                yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array(found[often])], names=["key", "count"])

    return python_ready(counts.select("hash", "counts")).mapInArrow(run, "key long, count long")


class _Distinct:
    """The different phrases of a segment, from the tasks that met them, with their keys and counts: those alone that occur ``least`` times or more."""

    def __init__(self, segment: int, least: int) -> None:
        self.least, self.hash = least, PerfectHash(np.zeros(0, np.uint64))
        self.counts = np.zeros(0, np.int64)
        self.phrases: dict[str, set[bytes]] = {}

    def add(self, kind: int, lang: str, body: pa.Scalar, counts: pa.Scalar) -> None:
        if kind == 0:
            self.hash, self.counts = pickle.loads(body.as_py()), _numbers(counts, np.int64).copy()
        else:
            self.phrases.setdefault(lang, set()).update(zlib.decompress(body.as_buffer()).split(b"\n"))

    def end(self) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for lang, every in self.phrases.items():
            by_size: dict[int, list[bytes]] = {}
            for phrase in every:
                by_size.setdefault(phrase.count(b" ") + 1, []).append(phrase)
            for n, phrases in by_size.items():
                for start in range(0, len(phrases), 65536):
                    part = phrases[start : start + 65536]
                    keys = keys_of(hashes.of(b" ".join(part).split(b" ")), n, tag(lang))[0][::n]
                    slots = self.hash.slots(keys)
                    often = np.flatnonzero(slots >= 0)
                    often = often[self.counts[slots[often]] >= self.least]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[often].view(np.int64)), pa.array([lang] * len(often), pa.string()), pa.array([part[k].decode() for k in often.tolist()], pa.string()), pa.array(self.counts[slots[often]])], names=["key", "lang", "phrase", "a"])


def _texts_of(texts: DataFrame, known, counts: DataFrame, least: int, segments: int) -> DataFrame:
    """(``key``, ``lang``, ``phrase``, ``a``) of the phrases of two words and more that occur ``least`` times or more. A task sends each that is in the bitmap about once, packed by segment, where they become distinct and are looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sent = known.value, np.zeros(0, np.uint64)
        for chunk in _chunks(batches, TEXT_CHUNK, True):
            fresh_keys = []
            for lang, (hashes, words) in chunk.items():
                met: dict[int, list[bytes]] = {}
                for n in range(2, LONGEST + 1):
                    keys, inside = keys_of(hashes, n, tag(lang))
                    at = np.flatnonzero(inside & in_bitmap(bits, keys))
                    found, first = np.unique(keys[at], return_index=True)
                    if len(sent):
                        fresh = sent[np.minimum(np.searchsorted(sent, found), len(sent) - 1)] != found
                        found, first = found[fresh], first[fresh]
                    fresh_keys.append(found)
                    for segment, k in zip(_segment(found, segments).tolist(), at[first].tolist(), strict=True):
                        met.setdefault(segment, []).append(b" ".join(words[k : k + n]))
                packed = [zlib.compress(b"\n".join(sorted(x)), 1) for x in met.values()]
                yield pa.RecordBatch.from_arrays([pa.array(list(met), pa.int32()), pa.array([lang] * len(met), pa.string()), pa.array(packed, pa.binary())], names=["segment", "lang", "packed"])
            sent = np.sort(np.concatenate([*([sent] if len(sent) < SENT else []), *fresh_keys]))

    packed = python_ready(texts).mapInArrow(run, "segment int, lang string, packed binary")
    own = counts.select("segment", F.lit(0).alias("kind"), F.lit("").alias("lang"), F.col("hash").alias("body"), "counts")
    met = packed.select("segment", F.lit(1).alias("kind"), "lang", F.col("packed").alias("body"), F.lit(b"").alias("counts"))
    return _by_segment(own.union(met), ("segment", "kind"), lambda segment: _Distinct(segment, least), "key long, lang string, phrase string, a long")


def _parts(phrases: DataFrame) -> DataFrame:
    """(``key``, ``k``, ``first``, ``rest``, ``inner``): for each cut its parts' keys, and at the first cut those of all shorter phrases inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[tuple] = []
            for key, lang, phrase in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, mark = hashes.of(phrase.encode().split(b" ")), tag(lang)
                n = len(own)
                signed = {(i, m): int(k) for m in range(1, n) for i, k in enumerate(keys_of(own, m, mark)[0].view(np.int64))}
                inner = [signed[i, m] for m in range(2, n) for i in range(n - m + 1)]
                out += [(key, k, signed[0, k], signed[k, n - k], inner if k == 1 else []) for k in range(1, n)]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], kind) for c, kind in enumerate(kinds)], names=["key", "k", "first", "rest", "inner"])

    return python_ready(phrases.select("key", "lang", "phrase")).mapInArrow(run, "key long, k int, first long, rest long, inner array<long>")


def _totals(texts: DataFrame) -> DataFrame:
    """(``lang``, ``n``): words of each language."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09.,;:!?\x0A-\x0D]+"), lambda x: x != ""))
    return texts.groupBy(F.coalesce("lang", F.lit("und")).alias("lang")).agg(F.sum(words.cast("long")).alias("n"))


def ranked(frame: DataFrame, group: str, order: list[Column], top: int) -> DataFrame:
    """The first ``top`` rows of each group, with their ``rank``: by ranges of the order, so no group meets in one task."""
    spread = frame.repartitionByRange(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(group), *order)
    lined = materialize(spread.sortWithinPartitions(group, *order).withColumns({"at": F.monotonically_increasing_id(), "part": F.spark_partition_id()}), "lined")
    runs_of = lined.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    before = F.sum("rows").over(Window.partitionBy(group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    placed = runs_of.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < top).select(group, "part", "first", "before")
    found = lined.join(placed, [group, "part"]).withColumn("rank", F.col("at") - F.col("first") + F.col("before") + 1)
    return found.filter(F.col("rank") <= top).drop("at", "part", "first", "before")


def mine_phrases(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A null text has no words and a null language is ``und``. Rows that repeat count as often as they come, and ties
    are ordered by count and then by the phrase's bytes. Whole texts count, however long; other columns
    are ignored. No table, no words or no phrase of ``least`` uses gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    segments = max(SEGMENTS, math.ceil(size / SEGMENT_BYTES))
    context = spark.sparkContext

    few = materialize(merged(tally(texts, (1, 2), segments), least), "few")
    pairs = context.broadcast(bitmap(_each(few.filter("level = 2"))))
    longer = materialize(tally(texts, tuple(range(3, LONGEST + 1)), segments, pairs), "longer")
    counts = counted(few.union(longer))
    often = materialize(_frequent(counts, least), "often")
    known = context.broadcast(bitmap(often))
    phrases = materialize(_texts_of(texts, known, counts, least, segments), "phrases")
    parts = materialize(_parts(phrases), "parts")
    asked = parts.select(F.explode(F.array("first", "rest")).alias("key")).distinct().select(F.col("key").alias("request"), "key")
    parts_counts = materialize(read_counts(counts, asked, segments), "read").select("key", "count")

    big = lambda x: F.col(x).cast("decimal(38,0)")
    cuts = parts.drop("inner").join(phrases.select("key", "a"), "key")
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts_counts.select(F.col("key").alias(part), F.col("count").alias(name)), part)
    cuts = cuts.withColumns({"a": big("a"), "both": big("l") + big("r")}).withColumn("score", F.expr("2000000BD * a div both"))
    best = cuts.groupBy("key").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longest = parts.filter(F.size("inner") > 0).join(phrases.select("key", F.col("a").alias("outer_a")), "key").select(F.explode("inner").alias("key"), "outer_a").groupBy("key").agg(F.max("outer_a").alias("outer_a"))
    kept = phrases.join(longest, "key", "left").filter(F.col("outer_a").isNull() | (big("outer_a") * 100 < big("a") * covered)).drop("outer_a")
    rows = kept.join(best, "key").select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    found = ranked(rows, "lang", [F.desc("score"), F.desc("a"), F.asc("phrase")], top).join(F.broadcast(_totals(texts)), "lang")
    discard(few, longer)
    return found.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS words FROM pieces
), totals AS (
  SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM worded GROUP BY lang
), sizes(m) AS (VALUES (1), (2), (3), (4)), counts AS (
  SELECT lang, m, phrase, count(*) AS f FROM (
    SELECT lang, m, unnest(list_transform(range(1, len(words) - m + 2), lambda i: array_to_string(words[i : i + m - 1], ' '))) AS phrase
    FROM worded, sizes WHERE len(words) >= m
  ) GROUP BY lang, m, phrase
), candidates AS (
  SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE m >= 2 AND f >= 30
), cuts AS (
  SELECT lang, phrase, a, k, array_to_string(words[1 : k], ' ') AS head, array_to_string(words[k + 1 : ], ' ') AS tail
  FROM (SELECT *, unnest(range(1, m)) AS k FROM candidates)
), scored AS (
  SELECT c.lang, c.phrase, c.a, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f + y.f) AS BIGINT) AS score
  FROM cuts c
  JOIN counts x ON x.lang = c.lang AND x.m = c.k AND x.phrase = c.head
  JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(words[i : i + q - 1], ' ') AS phrase, a
  FROM (SELECT *, unnest(range(1, m - q + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS q FROM candidates))
), covered AS (
  SELECT lang, phrase, max(a) AS outer_a FROM inner_phrases GROUP BY lang, phrase
)
SELECT s.lang, row_number() OVER w AS rank, s.phrase, s.a, s.l, s.r, t.n, s.score
FROM scored s JOIN totals t ON t.lang = s.lang LEFT JOIN covered c ON c.lang = s.lang AND c.phrase = s.phrase
WHERE c.outer_a IS NULL OR 100::HUGEINT * c.outer_a < 80::HUGEINT * s.a
WINDOW w AS (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase)
QUALIFY row_number() OVER w <= 2000
"""
