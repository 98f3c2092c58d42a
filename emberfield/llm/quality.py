"""Quality rules: exact base measures, then a calibrated logistic regression over hashed n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberfield.llm import spans
from emberfield.llm.cluster import map_arrow

# Fixed rules of the base measures.
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SYMBOLS = b"#*$%&|<>"
# The classifier: labelled rows it is fitted on at most (chosen by hash), hashed features, least probability to keep.
SAMPLE_ROWS = 2_000
FEATURES = 1 << 18
KEEP_PROBABILITY = 0.5

_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, *range(0x09, 0x0E)]] = False
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


@dataclass
class Model:
    """Feature weights, and the two numbers that turn a score into a calibrated probability."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, score: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * score + self.shift, -500, 500)))


def base_measures(data: np.ndarray, at: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each row of a slice."""
    n = len(at) - 1
    word_byte = _WORD[data]
    total = lambda mask: np.diff(np.append(0, np.cumsum(mask, dtype=np.int64))[at])
    out = {"n_words": np.bincount(rows, minlength=n), "word_chars": total(word_byte & ((data & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[data])}

    first, last, owner = spans.lines(data, at)
    held = np.append(0, np.cumsum(word_byte, dtype=np.int64))
    worded = held[last] > held[first]
    first, last, owner = first[worded], last[worded], owner[worded]
    # lines equal to an earlier one: those of the row, less the different ones
    key = spans.mix(spans.hash_spans(data, first, last, 5) + owner.astype(np.uint64))
    _, where = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(owner[where], minlength=n)

    begin, window = spans.windows(hashes, rows, tuple(range(WINDOW)))
    covered = np.zeros(len(hashes) + 1, dtype=np.int64)
    if len(begin):
        key = spans.mix(window + rows[begin].astype(np.uint64))
        ordered = np.sort(key)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if len(twice):
            again = begin[np.isin(key, twice)]
            np.add.at(covered, again, 1)
            np.add.at(covered, again + WINDOW, -1)
    out["n_repeat_words"] = np.bincount(rows[np.cumsum(covered)[:-1] > 0], minlength=n)
    return out


def features(data: np.ndarray, at: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, hashed feature) of every word 1- and 2-gram, then of every character 3- and 4-gram; case counts."""
    pairs, pair = spans.windows(hashes, rows, (0, 1))
    yield np.concatenate([rows, rows[pairs]]), (np.concatenate([hashes, pair]) & np.uint64(FEATURES - 1)).astype(np.int64)
    char = np.flatnonzero((data & 0xC0) != 0x80)
    padded = np.append(data, np.zeros(3, dtype=np.uint8)).astype(np.uint32)
    code = padded[char]
    size = np.diff(np.append(char, len(data)))
    for k in (1, 2, 3):  # a character is its UTF-8 bytes as one number
        longer = size > k
        code[longer] |= padded[char[longer] + k] << np.uint32(8 * k)
    owner = np.searchsorted(at, char, side="right") - 1
    code = spans.mix(code.astype(np.uint64) + np.uint64(1 << 40))
    found_rows, found = [], []
    for size in (3, 4):
        n = len(code) - size + 1
        if n > 0:
            gram = np.zeros(n, dtype=np.uint64)
            for k in range(size):
                gram += code[k : k + n] * np.uint64(2 * k * k + 6 * k + 3)
            inside = owner[:n] == owner[size - 1 :]
            found_rows.append(owner[:n][inside])
            found.append(((gram[inside] ^ (gram[inside] >> np.uint64(29))) & np.uint64(FEATURES - 1)).astype(np.int64))
    if found:
        yield np.concatenate(found_rows), np.concatenate(found)


def _hashed(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, rows = spans.words(data, at, _WORD)
    return starts, ends, rows, spans.hash_spans(data, starts, ends)


def scores(weights: np.ndarray, bias: float, data: np.ndarray, at: np.ndarray, rows: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """The linear score of each row: the mean weight of its word grams plus that of its character grams."""
    n = len(at) - 1
    out = np.full(n, bias)
    for owner, feature in features(data, at, rows, hashes):
        count = np.bincount(owner, minlength=n)
        out += np.bincount(owner, weights=weights[feature], minlength=n) / np.maximum(count, 1)
    return out


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, limit: int, text: str = "text", doc_id: str = "doc_id", condition: Column | None = None, balanced: bool = False) -> DataFrame:
    """(doc_id, y, text): at most ``limit`` labelled documents, those of least hash. Null labels are left out.

    ``balanced`` takes half of them from either label, as far as there are so many.

    The chosen ids are at most ``limit`` rows, so they are broadcast to the documents. Of several documents with one id
    the one of least text hash counts.
    """
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    if condition is not None:
        known = known.filter(condition)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    first = lambda rows, n: rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(known.filter("y = 1"), limit // 2).unionByName(first(known.filter("y = 0"), limit // 2)) if balanced else first(known, limit)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("least"))
    return one.select("doc_id", "y", F.col("least.text").alias("text"))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, steps: int = 80) -> Model:
    """Fit on a bounded sample of labelled rows: three quarters give the weights, one quarter the calibration.

    The tasks hash the sample's n-grams to sparse rows; the driver gets those of at most ``sample_rows`` documents.
    Without rows of both labels the model keeps everything (probability 1).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, data, at in spans.slices(batch.column(2)):
                _, _, rows, hashes = _hashed(data, at)
                n = len(at) - 1
                index: list[list[np.ndarray]] = [[] for _ in range(n)]
                value: list[list[np.ndarray]] = [[] for _ in range(n)]
                for owner, feature in features(data, at, rows, hashes):
                    pair, times = np.unique(owner.astype(np.int64) * FEATURES + feature, return_counts=True)
                    owner, feature = pair // FEATURES, pair % FEATURES
                    share = times / np.maximum(np.bincount(owner, weights=times, minlength=n), 1)[owner]
                    cuts = np.searchsorted(owner, np.arange(n + 1))
                    for i in range(n):
                        index[i].append(feature[cuts[i] : cuts[i + 1]])
                        value[i].append(share[cuts[i] : cuts[i + 1]])
                join = lambda parts, kind: pa.array([np.concatenate(p).astype(kind) if p else np.empty(0, kind) for p in parts], pa.list_(pa.from_numpy_dtype(kind)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, n), batch.column(1).slice(row, n), join(index, np.int32), join(value, np.float32)], ["doc_id", "y", "index", "value"])

    sample = labelled_rows(docs, labels, "quality", sample_rows).select("doc_id", "y", "text")
    table = map_arrow(sample, work, "doc_id long, y int, index array<int>, value array<float>").toArrow()
    table = table.sort_by("doc_id")
    y = np.asarray(table["y"].combine_chunks(), dtype=np.float64)
    if len(np.unique(y)) < 2:
        return Model(np.zeros(FEATURES, dtype=np.float32), 0.0, 0.0, 500.0)
    index, value = table["index"].combine_chunks(), table["value"].combine_chunks()
    at = np.asarray(index.offsets)
    index, value = np.asarray(index.values)[at[0] : at[-1]], np.asarray(value.values)[at[0] : at[-1]].astype(np.float64)
    owner = np.repeat(np.arange(len(y)), np.diff(at))
    held = np.arange(len(y)) % 4 == 3
    rate = y.mean()
    importance = np.where(held, 0.0, np.where(y == 1, 0.5 / rate, 0.5 / (1 - rate)))
    importance /= importance.sum()
    weights, bias = np.zeros(FEATURES), 0.0
    velocity = np.zeros(FEATURES + 1)
    for step in range(steps):  # each coordinate's step is scaled by the gradients it has seen
        z = np.bincount(owner, weights=weights[index] * value, minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) * importance
        slope = np.append(np.bincount(index, weights=error[owner] * value, minlength=FEATURES) + 1e-7 * weights, error.sum())
        velocity += slope * slope
        change = slope / (np.sqrt(velocity) + 1e-12)
        weights -= 3.0 / np.sqrt(1 + step) * change[:-1]
        bias -= 0.3 / np.sqrt(1 + step) * change[-1]
    z = np.bincount(owner, weights=weights[index] * value, minlength=len(y)) + bias
    a, b = platt(z[held], y[held]) if len(np.unique(y[held])) == 2 else (1.0, 0.0)
    return Model(weights.astype(np.float32), float(bias), a, b)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve of y over z (Newton steps with smoothed targets)."""
    up, down = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target = np.where(y == 1, up, down)
    scale = max(float(np.abs(z).max()), 1e-9)
    x = np.stack([z / scale, np.ones_like(z)], axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        w -= np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (p - target) + 1e-3 * w)
    return float(w[0] / scale), float(w[1])


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def quality(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the five measures, base_failed, probability and kept, one row per input row, without a shuffle.

    ``base_failed``: fewer than 20 words, or over 30 % of the words in 8-word windows that occur twice or more.
    ``kept``: not base_failed, and a calibrated probability of at least 0.5. Null and empty texts have no words and
    fail. Repeated rows give repeated results; a null doc_id stays null; other columns are not read.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            for row, data, at in spans.slices(batch.column(1)):
                starts, ends, rows, hashes = _hashed(data, at)
                m = base_measures(data, at, starts, ends, rows, hashes)
                failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
                p = model.probability(scores(model.weights, model.bias, data, at, rows, hashes))
                columns = [pa.array(m[k].astype(np.int64)) for k in MEASURES]
                columns += [pa.array(failed), pa.array(p), pa.array(~failed & (p >= KEEP_PROBABILITY))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(failed)), *columns], ["doc_id", *MEASURES, "base_failed", "probability", "kept"])

    frame = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return map_arrow(frame, work, "doc_id long, " + ", ".join(f"{m} long" for m in MEASURES) + ", base_failed boolean, probability double, kept boolean")
