"""Packing of documents into training sequences, hierarchically over context-size tiers.

Each document becomes token ids plus an end id. Its whole windows of ``max_len`` tokens become
sequences at once; the rest of it is routed to the smallest tier (a power of two) that holds it.
Tiers are packed from the longest down: the longest rest opens a window of its tier, and the gap
behind it is filled with the longest rests of shorter tiers that still fit, then by cutting the
longest rest at hand. A window therefore ends full, or the pool of documents is used up; then its
parts wait for the next pool of the same partition. What is left at the end of a partition, fewer
tokens than the longest tier, becomes sequences of falling powers of two, so that nothing is
padded; those below the smallest tier are of no tier's length but their own.

Sequences of one length are dealt out to step groups of equal token counts, heaviest attention cost
first and in serpentine order, so that the groups of a pool cost about the same. Only at the end of
a partition are there groups of fewer tokens: what is left of each length is dealt evenly, so that
its groups differ by one sequence at most.

Everything happens inside the partitions of the input, in one pass and without a shuffle: memory
is bounded by a pool (``pool_tokens``) and the longest document. Ids of sequences and groups hold
the partition's number, so a task that runs again gives the same rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Callable, Iterator
from struct import pack

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.llm.common import python_ready, table

MAX_LEN = 4096
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
POOL_TOKENS = 1_000_000
STEP_TOKENS = 8 * MAX_LEN
VOCABULARY = "word_bpe_49k.json"
#: Words whose ids a worker keeps at most, beyond which it starts over, and the longest that it keeps.
CACHED_WORDS, CACHED_LETTERS = 200_000, 48

#: Control characters, the next line, the Mongolian vowel separator, the zero-width space and the
#: byte order mark: white space that str.split() and the vocabulary file may see differently.
_ODD_SPACE = "".join(map(chr, (0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0x180E, 0x200B, 0xFEFF)))
#: Letters up to here are lowered alike by Python and the tokenizer, where what they become lies in this range too.
_LATIN = "\u024f"
#: What keeps a lowered text from the short way: those, other scripts, and marks that may be special tokens.
_SPECIAL = re.compile(f"[{_ODD_SPACE}]|[^\\x00-{_LATIN}]|<\\|")


def _word_pattern() -> re.Pattern:
    """The vocabulary file's pattern of words, over Latin characters, for the quicker of two engines."""
    chars = list(map(chr, range(ord(_LATIN) + 1)))
    letters, numbers, blanks = ("".join(re.escape(c) for c in chars if regex.fullmatch(kind, c)) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{blanks}{letters}{numbers}]+")


_WORDS = _word_pattern().findall


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def _byte_letters() -> dict[int, int]:
    """For str.translate: each byte, as a Latin-1 letter, to the letter that stands for it in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(rest)}


def _packed(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


class _Words(dict):
    """Word in small Latin letters -> its ids as little-endian bytes, by the tokenizer's own merge model."""

    def __init__(self, model) -> None:
        super().__init__()
        self.tokenize, self.letters = model.tokenize, _byte_letters()

    def __missing__(self, word: str) -> bytes:
        found = self.tokenize(word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters))
        ids = _packed([x.id for x in found])
        if len(word) <= CACHED_LETTERS:
            self[word] = ids
        return ids


class TextEncoder:
    """Token ids of whole texts, equal to the tokenizer's own.

    Latin texts are cut into words, whose ids are remembered. The vocabulary's normaliser and word
    pattern never join characters across white space, so the ids of any text are those of its
    chunks in turn, and only chunks that hold other scripts or marks go through the tokenizer itself.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(self.tokenizer.model)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _plain(self, lowered: str) -> bytes:
        return b"".join(map(self.words.__getitem__, _WORDS(lowered)))

    def _chunk(self, text: str) -> bytes:
        lowered = text.lower()
        return self._whole(text) if _SPECIAL.search(lowered) else self._plain(lowered)

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        lowered = text.lower()
        if not _SPECIAL.search(lowered):
            return self._plain(lowered)
        if any(x in text for x in _ODD_SPACE):
            return self._whole(text)
        return b"".join(map(self._chunk, text.split()))


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One for each Python worker: the vocabulary is read once. What it has met goes at the end of a task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


class Packer:
    """Packs one partition. A part is (length, number of the document here, first id)."""

    def __init__(self, first: int, emit: Callable[[tuple, int, int, int, int, int], None], max_len: int, tiers: tuple[int, ...], step_tokens: int) -> None:
        self.next_sequence = self.next_group = first
        self.emit, self.max_len, self.tiers, self.step_tokens = emit, max_len, tiers, step_tokens
        self.parts: list[tuple[int, int, int]] = []  # in order of length
        self.waiting: dict[int, list[list[tuple[int, int, int]]]] = {}
        self.held = 0

    def add(self, number: int, length: int) -> None:
        start = 0
        while length - start >= self.max_len:
            self.sequence(self.max_len, [(self.max_len, number, start)])
            start += self.max_len
        if length > start:
            self.parts.append((length - start, number, start))
        self.held += length

    def sequence(self, tier: int, parts: list[tuple[int, int, int]]) -> None:
        self.waiting.setdefault(tier, []).append(parts)

    def pack(self) -> None:
        """Fill windows until the parts run out; those of the last window stay."""
        parts = sorted(self.parts)
        while parts:
            longest = parts.pop()
            tier = next(x for x in self.tiers if x >= longest[0])
            window, gap = [longest], tier - longest[0]
            while gap and parts:
                if k := bisect_right(parts, (gap, float("inf"))):
                    part = parts.pop(k - 1)
                else:
                    length, number, start = parts.pop()
                    part = (gap, number, start)
                    insort(parts, (length - gap, number, start + gap))
                window.append(part)
                gap -= part[0]
            if gap:
                parts = window
                break
            self.sequence(tier, window)
        self.parts = parts
        self.held = sum(x[0] for x in parts)

    def steps(self, last: bool) -> None:
        """Give out the full step groups; at the end, all that wait."""
        for tier, found in self.waiting.items():
            size = max(1, self.step_tokens // tier)
            groups = -(-len(found) // size) if last else len(found) // size
            if not groups:
                continue
            found.sort(key=lambda parts: -sum(x[0] ** 2 for x in parts))
            given = found[: groups * size]
            for rank, parts in enumerate(given):
                turn, k = divmod(rank, groups)
                group = self.next_group + (groups - 1 - k if turn % 2 else k)
                offset = 0
                for part in parts:
                    self.emit(part, self.next_sequence, offset, tier, group, len(parts))
                    offset += part[0]
                self.next_sequence += 1
            self.next_group += groups
            self.waiting[tier] = found[groups * size :]

    def finish(self) -> None:
        """The remaining parts, fewer than one window, as sequences of falling powers of two."""
        self.pack()
        parts, total = self.parts[::-1], sum(x[0] for x in self.parts)
        self.parts, self.held = [], 0
        while total:
            tier = gap = 1 << (total.bit_length() - 1)
            window = []
            while gap:
                length, number, start = parts.pop()
                if length > gap:
                    parts.append((length - gap, number, start + gap))
                window.append((min(length, gap), number, start))
                gap -= window[-1][0]
            self.sequence(tier, window)
            total -= tier
        self.steps(last=True)


def pack_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    max_len: int = MAX_LEN,
    tiers: tuple[int, ...] = TIERS,
    end_id: int = END_ID,
    pool_tokens: int = POOL_TOKENS,
    step_tokens: int = STEP_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece of a document: where it lies in which sequence.

    Columns: the id, ``start`` (the document's ids before the piece), ``length``, ``ids_crc32`` (of
    the ids as little-endian unsigned 32-bit integers), ``doc_tokens``, ``sequence_id``, ``offset``
    (in the sequence), ``tier`` (the sequence's length), ``step_group``, ``pieces`` (of the
    sequence), and with ``with_ids`` the ``ids`` themselves.

    A null or empty text is a document of the end id alone. Rows are documents, whatever their ids:
    repeated or null ids are packed row by row. An empty table gives an empty result. Columns other
    than the id and the text are ignored, so none can clash. A very long text is encoded whole.
    ``tiers`` are rising powers of two, the last of them ``max_len``.
    """
    if list(tiers) != sorted(set(tiers)) or tiers[-1] != max_len or any(x & (x - 1) for x in tiers):
        raise ValueError("tiers are rising powers of two that end with max_len")
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    id_type = kept.schema["id"].dataType
    numbers = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "pieces")
    fields = [T.StructField(id_col, id_type), *(T.StructField(x, T.LongType()) for x in numbers)]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = vocabulary or vocabulary_path()
        encode = encoder(path).encode
        rows: list[list] = [[] for _ in fields]
        held: dict[int, tuple[object, bytes]] = {}
        schema: pa.Schema | None = None

        def emit(part: tuple[int, int, int], sequence: int, offset: int, tier: int, group: int, pieces: int) -> None:
            length, number, start = part
            name, ids = held[number]
            piece = ids[4 * start : 4 * (start + length)]
            values = [name, start, length, zlib.crc32(piece), len(ids) // 4, sequence, offset, tier, group, pieces]
            if with_ids:
                values.append(memoryview(piece).cast("I").tolist())
            for column, value in zip(rows, values, strict=True):
                column.append(value)

        def flush() -> pa.RecordBatch:
            arrays = [pa.array(x, type=f.type) for x, f in zip(rows, schema, strict=True)]
            for x in rows:
                x.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=schema)

        packer = Packer(TaskContext.get().partitionId() << 33, emit, max_len, tiers, step_tokens)
        number = 0
        for batch in batches:
            if schema is None:
                kinds = [batch.schema.field(0).type, *[pa.int64()] * len(numbers), *[pa.list_(pa.int32())] * with_ids]
                schema = pa.schema([pa.field(f.name, kind) for f, kind in zip(fields, kinds, strict=True)])
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                held[number] = (name, ids)
                packer.add(number, len(ids) // 4)
                number += 1
                if packer.held >= pool_tokens:
                    packer.pack()
                    packer.steps(last=False)
                    needed = {x[1] for x in packer.parts} | {x[1] for found in packer.waiting.values() for parts in found for x in parts}
                    held = {k: v for k, v in held.items() if k in needed}
                    if rows[0]:
                        yield flush()
        packer.finish()
        encoder(path).words.clear()
        if schema is not None and rows[0]:
            yield flush()

    return python_ready(kept).mapInArrow(run, T.StructType(fields))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
