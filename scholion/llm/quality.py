"""Quality by nearest-neighbour voting in a latent semantic space.

Terms of a text are its byte trigrams, its trigrams of character classes, and the repeats of its
words; their log counts, weighted by rarity, are projected on the leading singular directions of a
bounded sample of labelled documents. Every document's vector is multiplied, block by block, with
the broadcast vectors of that sample, and its nearest neighbours vote with a weight that grows with
cosine similarity. The sample has as many rows of either class, so votes count by how many labelled
rows each stands for.

Documents are always multiplied in blocks of one size, in double precision, and cosines are rounded
before they are compared, so a text's score doesn't depend on the texts beside it. Of equal cosines
the sampled row of smaller id is nearer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholion.llm.common import python_ready, table
from scholion.llm.labelled import PER_CLASS, fold, sampled_texts

FOLDS, HELD_OUT = 3, 1
THRESHOLD = 0.5
DIMENSIONS = 48
NEIGHBOURS = 25
#: Votes are weighted by the cosine to this power.
SHARPNESS = 16
#: The weight of repeated words beside the families of n-grams.
REPEATS = 3
BLOCK = 256

_GRAMS = 2048
_SHAPES = 512
_WIDTH = _GRAMS + _SHAPES + 2


def _classes() -> np.ndarray:
    """The class of each byte: letters by case, digits, blanks, line ends, stops, brackets and quotes, other signs. Bytes beyond ASCII count as small letters."""
    kind = np.zeros(256, dtype=np.uint32)
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", b".,;:!?", b"()[]{}<>\"'`"), 1):
        kind[list(chars)] = k
    rest = [b for b in range(128) if not chr(b).islower() and not kind[b]]
    kind[rest] = 7
    return kind


_CLASS = _classes()


def term_counts(text: str) -> np.ndarray:
    """Counts of the text's terms, by term number."""
    out = np.zeros(_WIDTH, dtype=np.float32)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(data) >= 3:
        wide = data.astype(np.uint32)
        code = wide[:-2] << np.uint32(16) | wide[1:-1] << np.uint32(8) | wide[2:]
        out[:_GRAMS] = np.bincount((code * np.uint32(0x9E3779B1)) >> np.uint32(21), minlength=_GRAMS)
        kind = _CLASS[data]
        shape = kind[:-2] << np.uint32(6) | kind[1:-1] << np.uint32(3) | kind[2:]
        out[_GRAMS : _GRAMS + _SHAPES] = np.bincount(shape, minlength=_SHAPES)
    words = text.split()
    out[-2] = sum(map(eq, words, words[1:]))
    out[-1] = len(words) - len(set(words))
    return out


def _shares(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts, by families of length one; repeats go with the classes."""
    found = np.sqrt(counts)
    for a, b in ((0, _GRAMS), (_GRAMS, _GRAMS + _SHAPES)):
        norm = np.linalg.norm(found[:, a:b], axis=1, keepdims=True)
        found[:, a:b] /= np.maximum(norm, 1e-9)
    found[:, _GRAMS + _SHAPES :] *= REPEATS / np.maximum(norm, 1e-9)
    return found


@dataclass
class QualityModel:
    """Fixed in size by its parameters: what is broadcast to score documents."""

    weights: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    votes: np.ndarray
    prior: float

    def project(self, shares: np.ndarray) -> np.ndarray:
        found = shares.astype(np.float64) @ (self.weights[:, None] * self.directions)
        return found / np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)

    def score(self, texts: list[str]) -> np.ndarray:
        """The share of weighted votes for label 1; the labelled rows' own share where there is no sample or no likeness."""
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        k = min(NEIGHBOURS, len(self.labels))
        for at in range(0, len(texts), BLOCK):
            part = texts[at : at + BLOCK]
            shares = np.zeros((BLOCK, _WIDTH), dtype=np.float32)
            shares[: len(part)] = _shares(np.stack([term_counts(x) for x in part]))
            cosine = np.round((self.project(shares) @ self.vectors.T)[: len(part)], 9)
            least = np.partition(cosine, cosine.shape[1] - k, axis=1)[:, -k][:, None]
            tied = cosine == least
            wanted = k - (cosine > least).sum(axis=1, keepdims=True)
            near = np.nonzero((cosine > least) | tied & (np.cumsum(tied, axis=1) <= wanted))[1].reshape(len(part), k)
            weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0) ** SHARPNESS * self.votes[near]
            total = weight.sum(axis=1)
            out[at : at + BLOCK] = np.where(total > 1e-12, (weight * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-12), self.prior)
        return np.round(np.clip(out, 0, 1), 9)


def fit(shares: np.ndarray, labels: np.ndarray, by_class: dict[int, int], dimensions: int = DIMENSIONS) -> QualityModel:
    """A model of the sampled rows' shares of terms and labels; ``by_class`` counts all labelled rows. ``shares`` is weighted in place."""
    n = len(labels)
    total = sum(by_class.values())
    prior = by_class.get(1, 0) / total if total else 0.5
    if not n:
        return QualityModel(np.zeros(_WIDTH, np.float32), np.zeros((_WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), labels, labels, prior)
    weights = (1 + np.log((1 + n) / (1 + np.count_nonzero(shares, axis=0)))).astype(np.float32)
    shares *= weights
    size = max(1, min(dimensions, n, _WIDTH))
    # subspace iteration from a fixed start, for the leading right singular vectors
    basis = np.random.default_rng(7).standard_normal((_WIDTH, size + 8)).astype(np.float32)
    for _ in range(6):
        basis, _ = np.linalg.qr(shares.T @ (shares @ basis))
    small = shares @ basis
    _, turn = np.linalg.eigh(small.T @ small)
    directions = (basis @ turn[:, ::-1][:, :size]).astype(np.float64)
    sampled = np.bincount(labels, minlength=2)
    votes = np.array([by_class.get(int(x), 0) / sampled[x] for x in labels], dtype=np.float64)
    found = np.concatenate([shares[k : k + BLOCK].astype(np.float64) @ directions for k in range(0, n, BLOCK)])
    found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-9)
    return QualityModel(weights.astype(np.float64), directions, found, labels, votes, prior)


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", *, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = PER_CLASS) -> QualityModel:
    """Fit on at most ``per_class`` labelled documents of each class, outside the held-out fold."""
    texts, by_class = sampled_texts(docs, labels, label, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out, per_class=per_class)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [_shares(term_counts(x.as_py())[None, :]).astype(np.float16).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "label", "shares"])

    kind = texts.schema["id"].dataType
    fields = T.StructType([T.StructField("id", kind), T.StructField("label", T.IntegerType()), T.StructField("shares", T.BinaryType())])
    rows = python_ready(texts).mapInArrow(count, fields).collect()
    rows.sort(key=lambda x: x["id"])
    known = np.array([x["label"] for x in rows], dtype=np.int64)
    shares = np.zeros((len(rows), _WIDTH), dtype=np.float32)
    for k in range(len(rows)):
        shares[k], rows[k] = np.frombuffer(rows[k]["shares"], dtype=np.float16), None
    return fit(shares, known, by_class)


def score_texts(docs: DataFrame, model: object, score_type: str = "score double", *, text_col: str = "text") -> DataFrame:
    """``docs`` with the model's score of each text as a last column. A null text is scored as the empty one."""
    given = docs.columns
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = given.index(text_col)
    fields = T.StructType([*docs.schema.fields, *T._parse_datatype_string(score_type).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.score([x.as_py() or "" for x in batch.column(at)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*given, fields[-1].name])

    return python_ready(docs).mapInArrow(run, fields)


def classify_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, folds: int = FOLDS, held_out: int = HELD_OUT, per_class: int = PER_CLASS) -> DataFrame:
    """One row for each row of ``docs``: the id, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Only labelled rows outside the held-out fold teach labels; a score depends on the text alone.
    Null and empty texts are scored like other texts, from no terms: they get the labelled rows'
    share of label 1. So does everything where no row is labelled with 0 or 1 (0.5 without any).
    A null id is in no fold, so held_out is false. Repeated rows get equal scores. An empty table
    gives an empty result. Columns other than the two named are ignored, so none can clash.
    """
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col, folds=folds, held_out=held_out, per_class=per_class)
    kept = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return score_texts(kept, model).select(
        F.col("id").alias(id_col),
        F.coalesce(fold("id", folds) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
