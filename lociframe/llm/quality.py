"""Document quality: fixed rules on counts, then a calibrated classifier on hashed word and character n-grams.

The classifier is a logistic regression on the relative frequencies of hashed words and three-byte n-grams. It is fitted
on at most ``SAMPLE_ROWS`` labelled rows (those with the smallest hash of their id), a quarter of which only calibrate its
probabilities. Counts, scores and verdicts cover every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrow_text

SAMPLE_ROWS = 3000
DIMENSIONS = 1 << 18  # half for words, half for characters
EPOCHS = 12
RATE = 0.5
SCALE = 30.0
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
# Kept from this calibrated probability of good quality on.
KEEP_FROM = 0.5
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -60, 60)))


def grams(data: np.ndarray, found: arrow_text.Words) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words and of the three-byte n-grams that start at each byte."""
    half = np.uint64(DIMENSIONS // 2)
    words = (arrow_text.span_hashes(data, found.start, found.end) & (half - np.uint64(1))).astype(np.int64)
    wide = np.zeros(len(data), np.uint64)
    if len(data) > 2:
        wide[:-2] = data[:-2].astype(np.uint64) | data[1:-1].astype(np.uint64) << np.uint64(8) | data[2:].astype(np.uint64) << np.uint64(16)
    chars = (arrow_text.mix(wide) & (half - np.uint64(1))).astype(np.int64) + DIMENSIONS // 2
    return words, chars


def _totals(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def margins(model: Model, data: np.ndarray, offsets: np.ndarray, found: arrow_text.Words) -> np.ndarray:
    words, chars = grams(data, found)
    byte_end = np.maximum(offsets[1:] - 2, offsets[:-1])
    sums = np.concatenate([[0.0], np.cumsum(model.weights[chars], dtype=np.float64)])
    by_char = sums[byte_end] - sums[offsets[:-1]]
    by_word = _totals(model.weights[words].astype(np.float64), found.first)
    return model.bias + SCALE * (by_word / np.maximum(np.diff(found.first), 1) + by_char / np.maximum(byte_end - offsets[:-1], 1))


def counts(data: np.ndarray, offsets: np.ndarray, found: arrow_text.Words) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    n_words = np.diff(found.first)
    inside = ~arrow_text.SPACE[data]
    out = {"n_words": n_words, "word_chars": _totals(inside & ((data & 0xC0) != 0x80), offsets), "n_symbols": _totals(SYMBOLS[data], offsets)}
    # Lines: cut at each line feed and at the ends of rows.
    feeds = np.flatnonzero(data == 10)
    feed_row = np.searchsorted(offsets, feeds, "right") - 1
    start, row = np.concatenate([offsets[:-1], feeds + 1]), np.concatenate([np.arange(n), feed_row])
    order = np.lexsort((start, row))
    start, row = start[order], row[order]
    end = np.append(start[1:] - 1, 0)
    last = np.append(row[1:] != row[:-1], True)
    end[last] = offsets[row[last] + 1]
    worded = np.searchsorted(found.start, end) > np.searchsorted(found.start, start)
    start, end, row = start[worded], end[worded], row[worded]
    line = arrow_text.span_hashes(data, start, end)
    order = np.lexsort((line, row))
    again = (line[order][1:] == line[order][:-1]) & (row[order][1:] == row[order][:-1])
    out["n_dup_lines"] = np.bincount(row[order][1:][again], minlength=n)
    # Words inside windows that occur again in the same row.
    windows = arrow_text.sliding(arrow_text.span_hashes(data, found.start, found.end), WINDOW)
    whole = np.flatnonzero(arrow_text.run_starts(found.first, WINDOW))
    covered = np.zeros(len(found.start) + 1, np.int32)
    if len(whole):
        key = arrow_text.mix(windows[whole] + found.rows()[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(whole), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, whole[twice], 1)
        np.add.at(covered, whole[twice] + WINDOW, -1)
    out["n_repeat_words"] = _totals(np.cumsum(covered[:-1]) > 0, found.first)
    out["base_failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED_PERCENT * n_words)
    return out


def _verdicts(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    found = arrow_text.words(data, offsets)
    out = counts(data, offsets, found)
    out["p_good"] = np.ones(len(offsets) - 1) if model is None else model.probability(margins(model, data, offsets, found))
    out["kept"] = ~out["base_failed"] & (out["p_good"] >= KEEP_FROM)
    return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        rows: int = SAMPLE_ROWS) -> Model | None:
    """Model from at most ``rows`` labelled documents; None (everything passes) unless both labels occur.

    Labels of one id are averaged, NULL ones are left out. The sample's hashed features, not its texts, reach the driver.
    """
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("label_id"))
              .agg((F.avg(F.col(label_col).cast("double")) >= 0.5).alias("good")).orderBy(F.xxhash64("label_id"), "label_id").limit(rows))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrow_text.pieces(batch, "text"):
                found = arrow_text.words(data, offsets)
                words, chars = grams(data, found)
                at, share = [], []
                for i in range(len(part)):
                    k, c = np.unique(words[found.first[i]:found.first[i + 1]], return_counts=True)
                    to = max(offsets[i + 1] - 2, offsets[i])
                    k2, c2 = np.unique(chars[offsets[i]:to], return_counts=True)
                    at.append(np.concatenate([k, k2]).astype("<i4").tobytes())
                    share.append(np.concatenate([c / max(c.sum(), 1), c2 / max(c2.sum(), 1)]).astype("<f4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(at, pa.binary()), pa.array(share, pa.binary())],
                                                 names=["id", "good", "at", "share"])

    # At most ``rows`` short rows are broadcast.
    sample = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id"))
              .select(F.col("id").cast("string").alias("id"), "good", "text")
              .mapInArrow(features, "id string, good boolean, at binary, share binary"))
    found = sorted(sample.collect(), key=lambda r: (r["id"], r["at"]))
    data = [(np.frombuffer(r["at"], "<i4"), np.frombuffer(r["share"], "<f4") * SCALE, float(r["good"])) for r in found]
    if len({y for _, _, y in data}) < 2:
        return None
    weights, squares, bias, bias_square = np.zeros(DIMENSIONS, np.float32), np.full(DIMENSIONS, 1e-6, np.float32), 0.0, 1e-6
    order = np.random.default_rng(0).permutation(len(data))
    held, train = order[:len(order) // 4], order[len(order) // 4:]
    for epoch in range(EPOCHS):
        for i in np.random.default_rng(epoch + 1).permutation(train):
            at, x, y = data[i]
            slip = 1 / (1 + np.exp(-np.clip(float(weights[at] @ x) + bias, -60, 60))) - y
            step = slip * x
            squares[at] += step * step
            weights[at] -= RATE * step / np.sqrt(squares[at] + 0.1)
            bias_square += slip * slip
            bias -= RATE * slip / np.sqrt(bias_square + 0.1)
    slope, shift = calibrate(np.array([float(weights[data[i][0]] @ data[i][1]) + bias for i in held]), np.array([data[i][2] for i in held]))
    return Model(weights, bias, slope, shift)


def calibrate(margin: np.ndarray, good: np.ndarray, rows: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of a logistic curve by damped Newton steps, with softened targets; (1, 0) where one label is missing.

    An entry stands for one row, or for ``rows`` of them.
    """
    rows = np.ones(len(margin)) if rows is None else rows
    plus, minus = (rows * good).sum(), (rows * (1 - good)).sum()
    if not plus or not minus:
        return 1.0, 0.0
    target = np.where(good > 0, (plus + 1) / (plus + 2), 1 / (minus + 2))
    x = np.stack([margin, np.ones(len(margin))], 1)
    order = np.argsort(np.abs(margin))
    upto = np.cumsum(rows[order])
    middle = np.abs(margin)[order][np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], "right")].mean()
    at = np.array([1 / max(middle, 1e-6), 0.0])  # where the curve is not yet flat
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -60, 60)))
        at = at - np.linalg.solve((x * (rows * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (rows * (p - target))) * 0.5
    return float(at[0]), float(at[1])


def judge(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, the counts, base_failed, p_good and kept for each row; a NULL text has no words and fails. No shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    longs = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrow_text.pieces(batch, "text"):
                found = _verdicts(shared.value, data, offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(found[c].astype(np.int64)) for c in longs], pa.array(found["base_failed"]),
                     pa.array(found["p_good"]), pa.array(found["kept"])], names=["id", *longs, "base_failed", "p_good", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"id {kind}, " + ", ".join(f"{c} bigint" for c in longs) + ", base_failed boolean, p_good double, kept boolean")
    return out.withColumnRenamed("id", id_col)


def keep_good(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows that ``judge`` keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in arrow_text.pieces(batch, text_col):
                yield part.filter(pa.array(_verdicts(shared.value, data, offsets)["kept"]))

    return docs.mapInArrow(run, docs.schema)
