"""Quality by the votes of nearest labelled neighbours in a latent semantic space.

A text is a vector of hashed words (tf-idf) and of word shapes, projected by the singular vectors of a labelled
sample. Every document is compared with every labelled vector by blocked matrix products; the labels of its
nearest neighbours vote with their cosines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.bytewords import NOT_SPACE, owners, sliced, text_buffer, word_hashes
from shelfsight.llm.labelled import held_out, training_sample
from shelfsight.workspace import written

SHAPES = ("upper", "capital", "lower", "digit", "symbol", "mark", "only_symbols", "repeated", "beyond_ascii", "long")


@dataclass(frozen=True)
class QualitySettings:
    """At most ``sample`` labelled ids are neighbours. ``shape_weight`` is the length of the shape part against the
    word part, which has length 1. A vote counts its cosine to the power ``sharpness``."""

    sample: int = 4_000
    buckets: int = 4_096
    rank: int = 32
    neighbours: int = 25
    shape_weight: float = 3.0
    sharpness: float = 8.0
    threshold: float = 0.3


def _member(characters: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters.encode())] = True
    return table


_UPPER = _member("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LOWER = _member("abcdefghijklmnopqrstuvwxyz")
_DIGIT = _member("0123456789")
_SYMBOL = _member("#*$%&|<>!=+~^@\\/_{}[]")
_MARK = _member(".,;:?")


def text_vectors(data: np.ndarray, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed words (texts x buckets) and shares of words by shape (texts x SHAPES)."""
    texts = len(at) - 1
    hashes, starts, ends, first = word_hashes(data, at, NOT_SPACE, fold=True)
    who = owners(first)
    words = np.bincount(who * buckets + (hashes % np.uint64(buckets)).astype(np.int64), minlength=texts * buckets)

    def inside(table: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(table[data])])
        return sums[ends] - sums[starts]

    upper, lower, digit, symbol, mark = map(inside, (_UPPER, _LOWER, _DIGIT, _SYMBOL, _MARK))
    beyond = inside(np.arange(256) >= 0x80)
    size = ends - starts
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (who[1:] == who[:-1])
    shapes = np.stack(
        [
            (upper > 1) & (lower == 0), (upper == 1) & (lower > 0), (lower > 0) & (upper == 0), digit > 0,
            (symbol > 0) & (symbol < size), mark > 0, symbol == size, again, beyond > 0, size > 14,
        ],
        axis=1,
    ).astype(np.float64)
    sums = np.zeros((texts, len(SHAPES)))
    for k in range(len(SHAPES)):
        sums[:, k] = np.bincount(who, shapes[:, k], texts)
    return words.reshape(texts, buckets), sums / np.maximum(np.diff(first), 1)[:, None]


def weighted(words: np.ndarray, shapes: np.ndarray, idf: np.ndarray, shape_weight: float) -> np.ndarray:
    part = np.log1p(words) * idf
    part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-12)
    side = shapes * shape_weight / np.maximum(np.linalg.norm(shapes, axis=1, keepdims=True), 1e-12)
    return np.concatenate([part, side], axis=1).astype(np.float32)


def document_frequencies(docs: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """Texts with a word in each bucket, and texts, over all of ``docs``; ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets + 1, np.int64)
        for part in sliced(batches, "text"):
            hashes, _, _, first = word_hashes(*text_buffer(part.column(0)), NOT_SPACE, fold=True)
            seen = np.zeros((part.num_rows, buckets), bool)
            seen[owners(first), (hashes % np.uint64(buckets)).astype(np.int64)] = True
            total[:-1] += seen.sum(0)
            total[-1] += part.num_rows
        hit = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[hit])], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets + 1)
    for row in rows.collect():
        out[row["bucket"]] = row["n"]
    return out[:-1], int(out[-1])


def sample_matrix(sample: DataFrame, idf: np.ndarray, settings: QualitySettings) -> tuple[np.ndarray, np.ndarray]:
    """Weighted vectors of ``sample`` (doc_id, text, label) and their labels, by doc_id. Texts are counted in tasks; of
    each the driver gets at most ``buckets`` counts and the shapes, however long it is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "text"):
            for a in range(0, part.num_rows, 256):
                rows = part.slice(a, 256)
                words, shapes = text_vectors(*text_buffer(rows.column(1)), settings.buckets)
                who, bucket = np.nonzero(words)
                at = np.concatenate([[0], np.cumsum(np.bincount(who, minlength=rows.num_rows))]).astype(np.int32)
                each = np.arange(rows.num_rows + 1, dtype=np.int32) * len(SHAPES)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0), pa.ListArray.from_arrays(at, bucket.astype(np.int32)),
                        pa.ListArray.from_arrays(at, words[who, bucket].astype(np.int64)),
                        pa.ListArray.from_arrays(each, shapes.ravel()), rows.column(2),
                    ],
                    ["doc_id", "bucket", "n", "shapes", "label"],
                )

    schema = "doc_id long, bucket array<int>, n array<long>, shapes array<double>, label double"
    given = sample.select("doc_id", "text", F.col("label").cast("double"))
    got = given.mapInArrow(run, schema).toArrow().sort_by("doc_id").combine_chunks()
    if not len(got):
        return np.zeros((0, settings.buckets + len(SHAPES)), np.float32), np.zeros(0)
    blocks = []
    for a in range(0, len(got), 256):
        rows = got.slice(a, 256)
        words = np.zeros((len(rows), settings.buckets), np.int64)
        sizes = rows["bucket"].combine_chunks().value_lengths().to_numpy()
        buckets, counts, shapes = (rows[c].combine_chunks().flatten().to_numpy() for c in ("bucket", "n", "shapes"))
        words[np.repeat(np.arange(len(rows)), sizes), buckets] = counts
        blocks.append(weighted(words, shapes.reshape(len(rows), len(SHAPES)), idf, settings.shape_weight))
    return np.concatenate(blocks), got["label"].to_numpy()


def singular_vectors(matrix: np.ndarray, rank: int, seed: int = 5) -> np.ndarray:
    """Leading right singular vectors (columns) by randomised subspace iteration, of a fixed sign."""
    rank = min(rank, *matrix.shape)
    basis = np.random.default_rng(seed).standard_normal((matrix.shape[1], min(rank + 10, *matrix.shape))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    _, _, vt = np.linalg.svd(matrix @ basis, full_matrices=False)
    return basis @ vt[:rank].T


def _unit(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)


def votes(vectors: np.ndarray, neighbours: np.ndarray, labels: np.ndarray, k: int, sharpness: float) -> np.ndarray:
    """Mean label of the k nearest by cosine, weighted by cosine ** sharpness; of equal cosines the earlier ones.
    A vector without direction gets the mean label."""
    prior = labels.mean() if len(labels) else 0.5
    if not len(labels):
        return np.full(len(vectors), prior)
    k = min(k, len(labels))
    cosines = np.clip(_unit(vectors) @ neighbours.T, 0, 1)
    nearest = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.take_along_axis(cosines, nearest, 1).astype(np.float64) ** sharpness
    total = weight.sum(1)
    return np.where(total > 1e-9, (weight * labels[nearest]).sum(1) / np.maximum(total, 1e-9), prior)


def quality_scores(docs: DataFrame, labels: DataFrame, settings: QualitySettings = QualitySettings()) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs`` (doc_id, text; nothing else is read), from
    ``labels`` (doc_id, quality). Word statistics cover all documents. A null or empty text has no direction and
    gets the sample's mean label; without usable labels every score is 0.5. Repeated rows give repeated results;
    empty input gives empty output."""
    frequency, texts = document_frequencies(docs, settings.buckets)
    idf = np.log((texts + 1) / (frequency + 1))
    sample = written(training_sample(docs, labels, "quality", settings.sample), "quality-sample")
    matrix, label = sample_matrix(sample, idf, settings)
    if len(label):
        projection = singular_vectors(matrix, settings.rank)
        neighbours = _unit(matrix @ projection)
    else:
        projection = np.zeros((settings.buckets + len(SHAPES), 1), np.float32)
        neighbours = np.zeros((0, 1), np.float32)
    sent = docs.sparkSession.sparkContext.broadcast((idf, projection, neighbours, label))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, projection, neighbours, label = sent.value
        for part in sliced(batches, "text"):
            for a in range(0, part.num_rows, 256):
                rows = part.slice(a, 256)
                vectors = weighted(
                    *text_vectors(*text_buffer(rows.column(2)), settings.buckets), idf, settings.shape_weight
                ) @ projection
                score = votes(vectors, neighbours, label, settings.neighbours, settings.sharpness)
                chosen = (score >= settings.threshold).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), rows.column(1), pa.array(score), pa.array(chosen)],
                    ["doc_id", "held_out", "score", "predicted"],
                )

    given = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return given.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
