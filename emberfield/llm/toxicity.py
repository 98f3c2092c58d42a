"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.llm import spans
from emberfield.llm.cluster import map_arrow, map_column
from emberfield.llm.quality import labelled_rows

# Labelled rows that the model is fitted on at most (of each label, those of least hash), and the hashed features.
SAMPLE_ROWS = 3_000
FEATURES = 1 << 30
# The penalty that decides which features get a weight; no other bound on how rare a feature may be.
L1 = 10.0
# Size of the bit table that tells most grams without a weight apart before the exact look-up.
SIEVE = 1 << 20
TOXIC_SCORE = 0.7
# Words that stand together: single, neighbours, and neighbours but one.
GRAMS = ((0,), (0, 1), (0, 2))
# Bytes at a word's beginning that stand for its inflected forms.
STEMS = (4, 5, 6)


@dataclass
class SparseModel:
    """The features (ascending) that L1 left a weight, and the bias: a few thousand numbers, fit to broadcast."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def sieve(self) -> np.ndarray:
        out = np.zeros(SIEVE, dtype=bool)
        out[self.index & (SIEVE - 1)] = True
        return out

    def scores(self, sieve: np.ndarray, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The score of each row of a slice."""
        owner, feature = grams(data, at)
        n = len(at) - 1
        met = np.flatnonzero(sieve[feature & (SIEVE - 1)])
        place = np.searchsorted(self.index, feature[met])
        hit = self.index[np.minimum(place, len(self.index) - 1)] == feature[met] if len(self.index) else np.zeros(0, dtype=bool)
        # the different grams of each row
        pair = np.unique(owner[met[hit]].astype(np.int64) * len(self.index) + place[hit])
        z = np.full(n, self.bias)
        if len(pair):
            z += np.bincount(pair // len(self.index), weights=self.weight[pair % len(self.index)], minlength=n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def grams(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hashed feature) of all word grams and word stems of a slice, repeats included."""
    data = spans.LOWER[data]
    starts, ends, rows = spans.words(data, at, spans.LETTERS)
    hashes = spans.hash_spans(data, starts, ends)
    owner, feature = [], []
    for k, steps in enumerate(GRAMS):
        first, h = (np.arange(len(hashes)), hashes) if len(steps) == 1 else spans.windows(hashes, rows, steps)
        owner.append(rows[first])
        feature.append(((h + np.uint64(k)) & np.uint64(FEATURES - 1)).astype(np.int64))
    for stem in STEMS:
        longer = np.flatnonzero(ends - starts > stem)
        h = spans.hash_spans(data, starts[longer], starts[longer] + stem, stem)
        owner.append(rows[longer])
        feature.append((h & np.uint64(FEATURES - 1)).astype(np.int64))
    return np.concatenate(owner), np.concatenate(feature)


class Ftrl:
    """FTRL-proximal with per-coordinate rates: weights are derived from two sums per feature and mostly stay zero."""

    def __init__(self, size: int, alpha: float = 1.0, beta: float = 1.0, l1: float = L1, l2: float = 0.1):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)
        self.alpha, self.beta = alpha, beta
        # the bias, the last coordinate, is not penalised
        self.l1, self.l2 = np.full(size + 1, l1), np.full(size + 1, l2)
        self.l1[-1] = self.l2[-1] = 0.0

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1[i], 0.0)
        return -shrunk / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2[i])

    def learn(self, i: np.ndarray, y: int, importance: float) -> None:
        """One document with the (different) features i."""
        w = self.weights(i)
        g = importance * (1 / (1 + np.exp(-np.clip(w.sum(), -50, 50))) - y)
        sigma = (np.sqrt(self.n[i] + g * g) - np.sqrt(self.n[i])) / self.alpha
        self.z[i] += g - sigma * w
        self.n[i] += g * g


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learned: crc32 of the id's text modulo 3 is not 1."""
    return F.crc32(F.col(doc_id).cast("string")) % 3 != 1


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, epochs: int = 5, l1: float = L1) -> SparseModel:
    """Fit on at most ``sample_rows`` labelled rows outside the held-out third.

    Tasks turn the sample's texts into sets of hashed grams; the driver learns from them document by document, in an
    order fixed by hash. A document moves a feature's sum by its importance at most in each epoch, one label up and
    the other down, so features that neither label's documents can move beyond ``l1`` keep weight zero: only those
    are left out beforehand. Without rows of both labels every score is 0.5 or the one label's share.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in spans.slices(batch.column(2)):
                n = len(at) - 1
                owner, feature = grams(data, at)
                pair = np.unique(owner.astype(np.int64) * FEATURES + feature)
                cuts = np.searchsorted(pair, np.arange(n + 1) * FEATURES).astype(np.int32)
                sets = pa.ListArray.from_arrays(pa.array(cuts), pa.array((pair % FEATURES).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), sets], ["doc_id", "y", "grams"])

    sample = labelled_rows(docs, labels, "toxic", sample_rows, condition=learnable(), balanced=True).select("doc_id", "y", "text")
    table = map_arrow(sample, work, "doc_id long, y int, grams array<int>").toArrow()
    in_turn = np.argsort(np.asarray(table["doc_id"].combine_chunks()), kind="stable")
    y = np.asarray(table["y"].combine_chunks(), dtype=np.int64)
    lists = table["grams"].combine_chunks()
    at, flat = np.asarray(lists.offsets), np.asarray(lists.values)
    # both labels weigh alike in sum
    share = {k: max(1, int((y == k).sum())) / max(1, len(y)) for k in (0, 1)}
    importance = {k: min(4.0, 0.5 / share[k]) for k in (0, 1)}
    entered = np.empty(0, dtype=np.int32)
    for k in (0, 1):
        in_order = np.sort(np.concatenate([flat[:0], *[flat[at[d] : at[d + 1]] for d in np.flatnonzero(y == k)]]))
        first = np.flatnonzero(np.append(True, in_order[1:] != in_order[:-1])[: len(in_order)])
        entered = np.union1d(entered, in_order[first[np.diff(np.append(first, len(in_order))) * importance[k] * epochs > l1]])
        del in_order, first
    known = []
    for d in range(len(y)):
        own = flat[at[d] : at[d + 1]]
        place = np.searchsorted(entered, own).astype(np.int32)
        known.append(place[entered[np.minimum(place, len(entered) - 1)] == own] if len(entered) else place[:0])
    del table, lists, flat
    ftrl = Ftrl(len(entered), l1=l1)
    for epoch in range(epochs):
        for d in in_turn[np.argsort(spans.random_words(len(y), epoch), kind="stable")]:
            i = np.append(known[d], len(entered))
            ftrl.learn(i, int(y[d]), importance[int(y[d])])
    w = ftrl.weights(np.arange(len(entered) + 1))
    left = np.flatnonzero(w[:-1])
    return SparseModel(entered[left].astype(np.int64), w[left], float(w[-1]))


def toxicity(docs: DataFrame, model: SparseModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted, one row per input row, without a shuffle.

    The score is the logistic of the bias plus the weights of the different grams of the whole text. Null and empty
    texts score the bias alone. Repeated rows give repeated results; a null doc_id stays null (held_out is then
    null); other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        sieve = model.sieve()
        for batch in batches:
            for row, data, at in spans.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(at) - 1), pa.array(model.scores(sieve, data, at))], ["doc_id", "score"])

    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = map_arrow(frame, work, "doc_id long, score double")
    return out.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= TOXIC_SCORE).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose text the fitted model does not reject, in one pass over the documents.

    Only the texts go to Python and only scores come back; the rows stay where they are.

    Null and empty texts are judged as above; all columns and repeated rows stay as they are.
    """
    model = fit(docs, labels)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        sieve = model.sieve()
        for column in texts:
            yield pa.array(np.concatenate([np.empty(0), *[model.scores(sieve, data, at) for _, data, at in spans.slices(column)]]))

    score = map_column(docs.sparkSession, work, "double")(F.col("text").cast("string"))
    return docs.filter(score < TOXIC_SCORE)
