"""Quality classifier: votes of the nearest labelled documents in a latent semantic space.

A text is the counts of its hashed byte trigrams, damped by a logarithm, weighted by inverse document frequency and scaled to length one, beside terms for how far it repeats itself: the level of the share of distinct word
trigrams, and of words that equal the one before. A truncated singular value decomposition of the labelled documents' matrix gives the latent
space. The labelled documents' vectors there are broadcast; for every document, in blocks, the exact cosines to all of them are one matrix product, and the labels of the NEIGHBOURS nearest vote with their similarity, to a power, as weight.

The classifier is fitted on at most MAX_LABELLED labelled rows, those of the least hash of their id; so the model's size does not depend on the corpus. Every document is scored by its whole text and by nothing else.

Rows: null text counts as empty; a text of no trigrams is unlike all and gets the labelled share of label 1. A very long text is counted whole. Labels of a null id or a null label are not learnt from; an id with two labels votes once with each, and
of documents that share an id the least text is learnt from. Neighbours as near as the last of the nearest vote too. Without any labelled row every score is 0.5. An empty table gives an empty one; columns other than those named are not read but kept.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspar.llm.common import byte_text, map_rows, texts, with_text

#: Labelled rows that are learnt from, at most.
MAX_LABELLED = 4_000
#: Hashed trigrams, dimensions of the latent space, votes, and the power of a similarity that weighs a vote.
BUCKETS, DIMENSIONS, NEIGHBOURS, POWER = 4_096, 64, 15, 4
#: Weight of the labelled share beside the votes.
PRIOR = 0.5
#: Levels of each repetition term, and their weight beside the unit vector of trigrams.
LEVELS, REPEATS = 8, 0.7
TERMS = BUCKETS + 2 * LEVELS


def repetition(text: str) -> tuple[float, float]:
    """The share of distinct word trigrams, 1 if there are none, and the share of words that equal the one before."""
    words = text.split()
    n = len(words)
    distinct = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    same = sum(map(str.__eq__, words, words[1:])) / n if n else 0.0
    return distinct, same


def counts(texts: list[str]) -> np.ndarray:
    """Logarithmic counts of hashed byte trigrams, then the levels of repetition as zeros and ones: a row for each text."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for k, text in enumerate(texts):
        raw = np.frombuffer(text.encode(), np.uint8).astype(np.uint32)
        if len(raw) >= 3:
            h = (raw[:-2] * np.uint32(0x01000193) ^ raw[1:-1]) * np.uint32(0x01000193) ^ raw[2:]
            h = (h * np.uint32(0x9E3779B1)) >> np.uint32(20)
            out[k, :BUCKETS] = np.log1p(np.bincount(h, minlength=BUCKETS))
        for j, share in enumerate(repetition(text)):
            out[k, BUCKETS + LEVELS * j + min(int(share * LEVELS), LEVELS - 1)] = 1
    return out


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _weighted(rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.empty_like(rows)
    out[:, :BUCKETS] = _unit(rows[:, :BUCKETS] * weights)
    out[:, BUCKETS:] = rows[:, BUCKETS:] * np.float32(REPEATS)
    return out


@dataclass
class Model:
    """A fitted classifier: term weights, the map into the latent space, the labelled vectors there and their labels."""

    weights: np.ndarray
    into: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    @property
    def share(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def embed(self, texts: list[str]) -> np.ndarray:
        return _unit(_weighted(counts(texts), self.weights) @ self.into)

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of a block of texts, from 0 to 1."""
        if not len(self.labels):
            return np.full(len(texts), 0.5)
        near = self.embed(texts) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        last = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        row, at = np.nonzero(near >= last[:, None])
        weight = np.clip(near[row, at], 0, 1).astype(np.float64) ** POWER
        votes, every = np.bincount(row, weight * self.labels[at], len(texts)), np.bincount(row, weight, len(texts))
        return np.clip((votes + PRIOR * self.share) / (every + PRIOR), 0, 1)


def decompose(x: np.ndarray, dimensions: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors of ``x``, as columns, by randomised subspace iteration."""
    width = min(dimensions + 10, *x.shape)
    q = np.random.default_rng(11).standard_normal((x.shape[1], width)).astype(np.float32)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, v = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ v.T)[:, :dimensions].astype(np.float32)


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """A model of labelled rows of ``counts``."""
    if not len(labels):
        return Model(np.ones(BUCKETS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels.astype(np.float64))
    held = (rows[:, :BUCKETS] > 0).sum(axis=0)
    weights = (np.log((1 + len(rows)) / (1 + held)) + 1).astype(np.float32)
    x = _weighted(rows, weights)
    into = decompose(x, DIMENSIONS)
    return Model(weights, into, _unit(x @ into), labels.astype(np.float64))


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", learnt: Column | None = None, most: int = MAX_LABELLED) -> Model:
    """Fit on the documents that ``labels`` (an id and a label of 0 or 1) marks, where ``learnt`` (of the labels' columns) holds."""
    spark = docs.sparkSession
    if learnt is not None:
        labels = labels.filter(learnt)
    chosen = (
        labels.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.col(f"`{label}`").cast("int").alias("label"))
        .filter(F.col("id").isNotNull() & F.col("label").isin(0, 1))
        .distinct()
        .orderBy(F.xxhash64("id"), "id", "label")
        .limit(most)
        .collect()
    )
    known = F.broadcast(spark.createDataFrame([tuple(r) for r in chosen], "id bigint, label int"))
    marked = docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).join(known, "id")
    # One text for each label chosen, whatever rows share its id: so what is collected is bounded by the labels.
    marked = marked.groupBy("id", "label").agg(F.min("text").alias("text"))

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            at, value = [], []
            for row in counts(byte_text(batch, "text")):
                held = np.flatnonzero(row)
                at.append(held.astype("<u2").tobytes())
                value.append(row[held].astype("<f2").tobytes())
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.binary()), pa.array(value, pa.binary())], names=["id", "label", "at", "value"])

        return work

    found = sorted(map(tuple, map_rows(marked, make, "id bigint, label int, at binary, value binary").collect()))
    rows = np.zeros((len(found), TERMS), np.float32)
    for k, (_, _, at, value) in enumerate(found):
        rows[k, np.frombuffer(at, "<u2")] = np.frombuffer(value, "<f2")
    return fit(rows, np.array([r[1] for r in found]))


def classify(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``keep`` columns, score (0 to 1, higher: label 1 likelier) and predicted (1 from 0.5), under the names of ``out``."""
    kept, schema = with_text(docs, keep, text)
    schema = schema.add(out[0], "double").add(out[1], "integer")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        fitted = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            score = fitted.score(texts(batch))
            return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, *out])

        return work

    return map_rows(kept, make, schema)
