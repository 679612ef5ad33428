"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

Terms of a text are its lower-cased words and the beginnings of these. A bounded sample of labelled
documents gives the examples, the vocabulary (all their terms), and each term's weight: its inverse
document frequency times the root of the G statistic by which it tells the labels apart. Plain
TF-IDF finds texts of the same topic and misses most toxic ones (figures in the README), so the
second factor is needed; no term is left out by it. The G statistic counts a term by the documents
that use it, but no more often than by the words before it, so that copies of one document are no
evidence; document frequencies are plain.

The examples lie in an inverted index in two parts. The ``HEAD`` terms of highest document
frequency, which most examples use, have a weight for each example, and a block of queries is
multiplied with them at once. Postings of all other terms are cut into blocks of alike examples,
each with its largest weight. A query bounds every block by what the head gives its examples plus
those weights, opens the blocks of highest bounds, and then all whose bound reaches the k-th
neighbour so far; so the neighbours are exact. They vote with weights that fall with distance;
votes are calibrated on the examples themselves, each left out in turn.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.llm.common import materialize, python_ready, table
from scholion.llm.labelled import fold, sampled_texts

FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
NEIGHBOURS = 15
#: Labelled rows of either class that the examples are sampled from, at most.
PER_CLASS = 1024
#: Lengths of the beginnings of words that are terms.
STEMS = (4, 5)
#: Share of its G statistic that a term keeps where label 0 uses it more, and what is added so that none weighs nothing.
AGAINST, LEAST = 0.1, 1e-3
#: Terms whose weights are held for each example.
HEAD = 1024
#: Examples in a block of the index, and blocks that a query opens first.
BLOCK = 128
OPENED = 2
#: Queries that are multiplied with the head at once.
AT_ONCE = 64
#: Words of at most so many letters whose terms a worker keeps, and texts whose results it keeps, at most.
LONGEST, WORDS, TEXTS = 48, 200_000, 10_000
#: Dimensions that examples are compared in to lay alike ones into one block; any order gives the same neighbours.
ALIKE = 64

_WORD = re.compile(r"[^\W\d_]+")
_NUMBERS = Struct(f"={1 + len(STEMS)}i")


def word_terms(word: str) -> list[str]:
    """The word itself and, marked, the beginnings that it may share with other forms of its stem."""
    return [word, *(f"^{word[:k]}" for k in STEMS if len(word) > k)]


_LETTERS = str.maketrans({x: " " for x in map(chr, range(128)) if not x.isalpha()})


def words_of(text: str) -> list[str]:
    """The runs of letters (and of numerals that aren't digits) in small letters."""
    text = text.lower()
    return text.translate(_LETTERS).split() if text.isascii() else _WORD.findall(text)


def _ranges(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after the other."""
    ends = np.cumsum(counts)
    return np.repeat(begins - ends + counts, counts) + np.arange(ends[-1] if len(ends) else 0)


def alike_first(ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """An order of the examples in which blocks hold alike ones: halved again and again along the direction in which they differ most."""
    mixed = (terms.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    at = ids * ALIKE + (mixed >> np.uint64(58)).astype(np.int64) % ALIKE
    signs = np.where(mixed >> np.uint64(57) & np.uint64(1), 1.0, -1.0)
    dense = np.bincount(at, signs * weights, size * ALIKE).reshape(size, ALIKE)
    out: list[np.ndarray] = []
    waiting = [np.arange(size)]
    while waiting:
        members = waiting.pop()
        if len(members) <= BLOCK:
            out.append(members)
            continue
        around = dense[members] - dense[members].mean(axis=0)
        spread, axis = around.T @ around, np.ones(ALIKE)
        for _ in range(20):
            axis = spread @ axis
            axis /= max(np.linalg.norm(axis), 1e-12)
        members = members[np.argsort(np.round(around @ axis, 9), kind="stable")]
        half = (len(members) // BLOCK + 1) // 2 * BLOCK
        waiting += [members[half:], members[:half]]
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Index:
    """Block-max inverted index of unit vectors, over terms in order of falling document frequency.

    ``head`` has the weights of the first terms by term and place. Postings of the others lie by
    term and place. The postings of a term within a block of places are a cell, which has its block,
    its largest weight and where its postings begin; ``cells`` has where the cells of each term
    begin. ``names`` has the number of the example at each place, -1 where there is none.
    """

    head: np.ndarray
    cells: np.ndarray
    blocks: np.ndarray
    highest: np.ndarray
    begins: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    names: np.ndarray

    @staticmethod
    def laid(ids: np.ndarray, terms: np.ndarray, weights: np.ndarray, size: int, n_terms: int, head: int = HEAD) -> Index:
        """From postings: the number of an example, the term and the weight."""
        order = alike_first(ids, terms, weights, size)
        blocks = -(-size // BLOCK)
        names = np.full(blocks * BLOCK, -1, dtype=np.int64)
        names[:size] = order
        place_of = np.empty(size, np.int64)
        place_of[order] = np.arange(size)
        places, often = place_of[ids], terms < head
        dense = np.zeros((min(head, n_terms), len(names)))
        dense[terms[often], places[often]] = weights[often]
        places, terms, weights = places[~often], terms[~often], weights[~often]
        order = np.lexsort((places, terms))
        places, terms, weights = places[order].astype(np.int32), terms[order], weights[order]
        begins = np.flatnonzero(np.diff(terms * (blocks + 1) + places // BLOCK, prepend=-1))
        highest = np.maximum.reduceat(weights, begins) if len(begins) else np.zeros(0)
        cells = np.searchsorted(terms[begins], np.arange(n_terms + 1))
        return Index(dense, cells, places[begins] // BLOCK, highest, np.append(begins, len(places)), places, weights, names)

    def heads(self, queries: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the head gives each place for each query. Blocks of queries are always of one size, so a query's result doesn't depend on the others."""
        out = np.zeros((len(queries), self.head.shape[1]))
        for at in range(0, len(queries), AT_ONCE):
            block = np.zeros((AT_ONCE, len(self.head)))
            for row, (terms, weights) in zip(block, queries[at : at + AT_ONCE]):
                n = np.searchsorted(terms, len(self.head))
                row[terms[:n]] = weights[:n]
            out[at : at + AT_ONCE] = (block @ self.head)[: len(queries) - at]
        return out

    def nearest(self, terms: np.ndarray, weights: np.ndarray, head: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the ``k`` examples of highest cosine above zero, and the cosines; ties go to the lower number.

        ``terms`` rise; ``head`` is what the head gives each place.
        """
        n = np.searchsorted(terms, len(self.head))
        terms, weights = terms[n:], weights[n:]
        counts = self.cells[terms + 1] - self.cells[terms]
        cells = _ranges(self.cells[terms], counts)
        share, of = np.repeat(weights, counts), self.blocks[cells]
        many = len(self.names) // BLOCK
        bounds = head.reshape(many, BLOCK).max(axis=1, initial=0.0) + np.bincount(of, share * self.highest[cells], many)
        opening = np.zeros(many, bool)
        opening[np.argsort(-bounds, kind="stable")[:OPENED]] = True
        closed = (bounds > 0) & ~opening
        sums = np.zeros(len(head))
        while True:
            chosen = np.flatnonzero(opening[of])
            begins = self.begins[cells[chosen]]
            counts = self.begins[cells[chosen] + 1] - begins
            posts = _ranges(begins, counts)
            found = head + np.bincount(self.places[posts], self.weights[posts] * np.repeat(share[chosen], counts), len(head))
            sums.reshape(many, BLOCK)[opening] = np.round(found.reshape(many, BLOCK)[opening], 12)
            if without >= 0:
                sums[self.names == without] = 0
            least = np.partition(sums, -k)[-k] if len(sums) >= k else 0.0
            opening = closed & (bounds >= least - 1e-9)
            if not opening.any():
                break
            closed &= ~opening
        hit = np.flatnonzero((sums > 0) & (sums >= least))
        hit = hit[np.lexsort((self.names[hit], -sums[hit]))[:k]]
        return self.names[hit], sums[hit]


class _Terms(dict):
    """Word -> the numbers of its terms, as many for each word, in bytes; what isn't in the vocabulary has the number after the last. Words without any aren't kept."""

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms, self.unknown = terms, np.full(1 + len(STEMS), len(terms), dtype=np.int32).tobytes()

    def __reduce__(self) -> tuple:
        return _Terms, (self.terms,)

    def __missing__(self, word: str) -> bytes:
        none, find = len(self.terms), self.terms.get
        # the vocabulary has every beginning of its words, so a word whose least beginning isn't there has no term there
        if find("^" + word[: STEMS[0]] if len(word) > STEMS[0] else word, none) == none:
            return self.unknown
        out = _NUMBERS.pack(find(word, none), *[find("^" + word[:k], none) if len(word) > k else none for k in STEMS])
        if len(word) <= LONGEST:
            self[word] = out
        return out


@dataclass
class ToxicityModel:
    """What is broadcast to score documents; it is as large as the sample's texts, whatever the input."""

    terms: dict[str, int]
    worth: np.ndarray
    index: Index
    names: list[object]
    labels: np.ndarray
    votes: np.ndarray
    empty_score: float
    steps: tuple[np.ndarray, np.ndarray]
    known: _Terms = field(init=False, repr=False)
    met: dict[bytes, tuple[float, list]] = field(default_factory=dict, init=False, repr=False)

    def __post_init__(self) -> None:
        self.known = _Terms(self.terms)

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary's terms in the whole text, rising, and how often each is there."""
        words = Counter(words_of(text))
        if len(self.known) > WORDS:
            self.known.clear()
        ids = np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32)
        often = np.repeat(np.fromiter(words.values(), np.float64, len(words)), 1 + len(STEMS))
        there = np.flatnonzero(ids < len(self.terms))
        there = there[np.argsort(ids[there], kind="stable")]
        ids, often = ids[there], often[there]
        first = np.flatnonzero(np.diff(ids, prepend=-1))
        return ids[first].astype(np.int64), np.add.reduceat(often, first) if len(first) else often

    def weighed(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The unit vector of terms and counts."""
        weights = (1 + np.log(counts)) * self.worth[terms]
        return weights / np.sqrt((weights * weights).sum())

    def vote(self, near: np.ndarray, cosine: np.ndarray) -> float:
        """The weighted share of toxic neighbours. Weights fall with angular distance."""
        weights = self.votes[near] / (0.05 + np.arccos(np.clip(cosine, 0, 1)))
        return float((weights * self.labels[near]).sum() / weights.sum())

    def shares(self, found: list[tuple[np.ndarray, np.ndarray]], without: list[int] | None = None) -> list[tuple[float | None, np.ndarray]]:
        """The votes for texts of those terms and counts, and the neighbours; null without any."""
        queries = [(terms, self.weighed(terms, counts)) for terms, counts in found]
        out = []
        for k, ((terms, weights), head) in enumerate(zip(queries, self.index.heads(queries), strict=True)):
            near, cosine = self.index.nearest(terms, weights, head, NEIGHBOURS, -1 if without is None else without[k])
            out.append((self.vote(near, cosine) if len(near) else None, near))
        return out

    def judge(self, texts: list[str]) -> list[tuple[float, list]]:
        """The calibrated score of each text, and the ids of the examples that speak for it."""
        keys = [blake2b(x.encode("utf-8", "surrogatepass"), digest_size=16).digest() for x in texts]
        if len(self.met) > TEXTS:
            self.met.clear()
        new = {key: text for key, text in zip(keys, texts, strict=True) if key not in self.met}
        for at in range(0, len(new), AT_ONCE):
            part = list(new)[at : at + AT_ONCE]
            found = [self.counts(new[key]) for key in part]
            asked = [k for k, (terms, _) in enumerate(found) if len(terms)]
            for key in part:
                self.met[key] = (self.empty_score, [])
            for k, (share, near) in zip(asked, self.shares([found[k] for k in asked]), strict=True):
                if share is not None:
                    self.met[part[k]] = (round(float(np.interp(share, *self.steps)), 9), [self.names[x] for x in near])
        return [self.met[key] for key in keys]


def _rising(x: np.ndarray, hits: np.ndarray, weights: np.ndarray) -> list[list[float]]:
    """Pools (weighted sum of ``x``, hits, weight) whose mean hits rise, of points in order of ``x``: neighbours that fall or stay are pooled."""
    pools: list[list[float]] = []
    for point in zip(x * weights, hits, weights, strict=True):
        pools.append(list(point))
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return pools


def _calibration(shares: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A rising curve through the weighted mean labels of examples by share. Examples of one share count together, in whatever order they come.

    A vote of doubt on either side keeps the scores of small pools off the ends; what it puts out of order is pooled again.
    """
    x, at = np.unique(shares, return_inverse=True)
    total, hits = (np.bincount(at, weights=w) for w in (weights, labels * weights))
    first = np.array(_rising(x, hits, total))
    doubt = weights.mean()
    last = np.array(_rising(first[:, 0] / first[:, 2], first[:, 1] + doubt / 2, first[:, 2] + doubt))
    return last[:, 0] / last[:, 2], last[:, 1] / last[:, 2]


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = PER_CLASS) -> ToxicityModel:
    """Fit on at most ``per_class`` labelled documents of each class, outside the held-out fold.

    The driver gets the sample's vocabulary and counts, which the sample's texts bound; examples are
    left out in turn by tasks.
    """
    sample, by_class = sampled_texts(docs, labels, label, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out, per_class=per_class)
    sample = materialize(sample, "examples")
    sizes = {x["label"]: x["count"] for x in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words, found = words_of(text.as_py()), {}
                for before, word in zip(["", *words], words):
                    for term in word_terms(word):
                        found.setdefault(term, before)
                columns = [pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.string()), pa.array([y] * len(found), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=["term", "before", "label"])

    used = python_ready(sample).select("label", "text").mapInArrow(use, "term string, before string, label int")
    used = used.groupBy("term", "before").agg(F.sum("label").alias("n1"), F.sum(1 - F.col("label")).alias("n0"))
    evidence = {f"n{k}": F.least(F.sum(f"n{k}"), F.count_if(F.col(f"n{k}") > 0)).cast("double").alias(f"n{k}") for k in (0, 1)}
    used = used.groupBy("term").agg(*evidence.values(), F.sum(F.col("n0") + F.col("n1")).alias("df")).select("term", "df", "n1", (F.col("n0") + F.col("n1")).alias("n"))
    n, hit = F.col("n"), F.col("n1")
    cells = ((hit, n * n1 / (n1 + n0 or 1)), (n - hit, n * n0 / (n1 + n0 or 1)), (n1 - hit, (n1 + n0 - n) * n1 / (n1 + n0 or 1)), (n0 - n + hit, (n1 + n0 - n) * n0 / (n1 + n0 or 1)))
    apart = 2 * sum(F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0) for seen, due in cells)
    strength = F.sqrt(F.greatest(F.when(hit * n0 > (n - hit) * n1, apart).otherwise(AGAINST * apart), F.lit(0.0)) + LEAST)
    rarity = F.log((1 + n0 + n1) / (1 + F.col("df"))) + 1
    chosen = used.select("term", "df", (strength * rarity).alias("worth")).toArrow().sort_by([("df", "descending"), ("term", "ascending")])
    terms = {x: k for k, x in enumerate(chosen["term"].to_pylist())}
    total = sum(by_class.values())
    prior = by_class.get(1, 0) / total if total else 0.0
    none = Index.laid(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0, len(terms))
    model = ToxicityModel(terms, chosen["worth"].to_numpy(), none, [], np.zeros(0), np.zeros(0), prior, (np.array([0.0, 1.0]), np.array([0.0, 1.0])))
    context = sample.sparkSession.sparkContext
    sent = context.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.counts(x.as_py()) for x in batch.column(2)]
            packed = [pa.array([pair[k].astype(kind).tobytes() for pair in found], pa.binary()) for k, kind in ((0, np.int32), (1, np.float64))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], names=["id", "label", "terms", "counts"])

    fields = T.StructType([T.StructField("id", sample.schema["id"].dataType), T.StructField("label", T.IntegerType()), T.StructField("terms", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    counted = materialize(sample.select("id", "label", "text").mapInArrow(count, fields), "counted")
    rows = sorted(counted.collect(), key=lambda x: x["id"])
    votes = {k: by_class.get(k, 0) / max(1, sizes.get(k, 0)) for k in (0, 1)}
    empty = Counter(x["label"] for x in rows if not x["terms"])
    if empty:
        model.empty_score = empty[1] * votes[1] / (empty[1] * votes[1] + empty[0] * votes[0])
    rows = [x for x in rows if x["terms"]]
    if not rows:
        return model
    found = [_unpacked(x["terms"], x["counts"]) for x in rows]
    ids = np.repeat(np.arange(len(found)), [len(x) for x, _ in found])
    model.index = Index.laid(ids, np.concatenate([x for x, _ in found]), np.concatenate([model.weighed(*x) for x in found]), len(found), len(terms))
    model.names = [x["id"] for x in rows]
    model.labels = np.array([x["label"] for x in rows], dtype=np.float64)
    model.votes = np.array([votes[x["label"]] for x in rows], dtype=np.float64)
    model.known.clear()
    indexed = context.broadcast(model)
    number_of = {name: k for k, name in enumerate(model.names)}

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [number_of[x] for x in batch.column(0).to_pylist()]
            pairs = [_unpacked(x.as_py(), y.as_py()) for x, y in zip(batch.column(1), batch.column(2), strict=True)]
            shares = [share for share, _ in indexed.value.shares(pairs, without=numbers)]
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(shares, pa.float64())], names=["number", "share"])

    asked = counted.filter(F.octet_length("terms") > 0).select("id", "terms", "counts").repartition(max(2, context.defaultParallelism))
    voted = {x["number"]: x["share"] for x in python_ready(asked).mapInArrow(left_out, "number int, share double").collect()}
    shares = np.array([model.empty_score if voted[k] is None else voted[k] for k in range(len(rows))])
    model.steps = _calibration(shares, model.labels, model.votes)
    for x in (sent, indexed):
        x.unpersist()
    return model


def _unpacked(terms: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(terms, dtype=np.int32).astype(np.int64), np.frombuffer(counts, dtype=np.float64)


def classify_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = PER_CLASS) -> DataFrame:
    """One row for each row of ``docs``: the id, ``held_out``, ``score`` (0 to 1), ``predicted`` (1 from ``threshold`` on) and ``evidence``.

    ``evidence`` lists the ids of the labelled examples that voted, nearest first. Only labelled rows
    outside the held-out fold teach labels; a score depends on the text alone. A text without terms
    of any example, null and empty texts among them, gets the share of label 1 among the examples
    without terms, or among all labelled rows where there are none, and has no evidence. Where no
    row is labelled with 0 or 1 every score is 0.
    Repeated rows get equal scores. A null id is in no fold, so held_out is false. An empty table
    gives an empty result. Columns other than the two named are ignored, so none can clash.
    """
    model = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out, per_class=per_class)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    evidence = labels.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.judge([x.as_py() or "" for x in batch.column(1)])
            shown = pa.array([x for _, x in found], pa.list_(kinds[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.float64()), shown], names=["id", "score", "evidence"])

    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(evidence)]
    fields = T.StructType([kept.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(evidence))])
    return python_ready(kept).mapInArrow(run, fields).select(
        F.col("id").alias(id_col),
        F.coalesce(fold("id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        "evidence",
    )


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
