"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the n-grams of its lower-cased, space-normalised characters (code points),
hashed into a fixed table and counted once. Each is scaled by the log ratio of its smoothed shares among
toxic and other texts, and a logistic regression is fitted on the scaled features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavespan.llm.batches import bounded

ORDERS = (3, 4, 5)
BITS = 18
#: The classifier is fitted on at most this many labelled rows, those of least hash, and on no more
#: of them than have features of so many bytes together.
MAX_ROWS, MAX_BYTES = 6_000, 512 << 20
EPOCHS = 8
RATE = 1.0
PENALTY = 1e-6
#: Keeps the sums over a text's thousands of features in the range of the step sizes.
SCALE = 1 / 30


def features(text: str, bits: int = BITS, orders: tuple[int, ...] = ORDERS) -> np.ndarray:
    """Hashed n-grams of a whole text, with repeats."""
    data = (" " + " ".join(text.lower().split()) + " ").encode("utf-32-le", "replace")
    codes = np.frombuffer(data, "<u4")
    h, found = np.full(len(codes), 0x9E3779B1, np.uint32), []
    for n in range(1, max(orders) + 1):
        h = h[:len(codes) - n + 1]
        if not len(h):
            break
        h = (h ^ codes[n - 1:]) * np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(15)
        if n in orders:
            found.append((h * np.uint32(0xC2B2AE35 + 2 * n)) >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def fit_rows(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS,
             rate: float = RATE, penalty: float = PENALTY,
             scale: float = SCALE) -> tuple[np.ndarray, float]:
    """Weights (ratio included) and bias for rows of (distinct features, label).

    Labels of one class only, or none, give weights of 0 and the smoothed share as bias.
    """
    positive = sum(y for _, y in rows)
    share = (positive + 1) / (len(rows) + 2)
    size, bias = 1 << bits, float(np.log(share / (1 - share)))
    if not 0 < positive < len(rows):
        return np.zeros(size, np.float32), bias
    counts = [np.ones(size), np.ones(size)]
    for x, y in rows:
        counts[y][x] += 1
    ratio = (np.log(counts[1] / (positive + 2)) - np.log(counts[0] / (len(rows) - positive + 2)))
    ratio = (ratio * scale).astype(np.float32)
    w, steps, bias_steps = np.zeros(size, np.float32), np.full(size, 1e-6, np.float32), 1e-6
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            x, y = rows[i]
            f, own = ratio[x], w[x]
            off = 1 / (1 + np.exp(-np.clip(f @ own + bias, -30, 30))) - y
            slope = off * f + penalty * own
            seen = steps[x] + slope * slope
            steps[x] = seen
            w[x] = own - rate * slope / np.sqrt(seen)
            bias_steps += off * off
            bias -= rate * off / np.sqrt(bias_steps)
    return w * ratio, float(bias)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, bits: int = BITS,
          orders: tuple[int, ...] = ORDERS, max_bytes: int = MAX_BYTES) -> tuple[np.ndarray, float]:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic 0 or 1).

    Null labels and ids are left out; a document labelled twice counts as toxic if one label says
    so; a null text counts as empty. Of rows that share an id, the one whose features have the
    least fingerprint is fitted. The ``max_rows`` labels of least hash take part, in this order
    until their features have ``max_bytes``, so the sample, which goes to one task, and the
    weights, which come back, have fixed bounds. Without rows the weights are 0.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(
        F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("long").alias("y"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(sample), "doc_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(features(t, bits, orders)).astype("<u4").tobytes()
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.binary()), batch.column(2)],
                names=["doc_id", "found", "y"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, left = [], max_bytes
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                left -= len(row[1])
                if left >= 0:
                    taken.append(row)
        taken.sort()
        w, bias = fit_rows([(np.frombuffer(f, "<u4"), y) for _, f, y in taken], bits)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()),
                                          pa.array([bias], pa.float64())], names=["w", "bias"])

    found = bounded(rows).mapInArrow(extract, "doc_id bigint, found binary, y bigint")
    first = Window.partitionBy("doc_id").orderBy(F.xxhash64("found"), "found")
    found = found.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
    ordered = found.repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id")
    model = bounded(ordered).mapInArrow(fit, "w binary, bias double").first()
    if model is None:
        return fit_rows([], bits)
    return np.frombuffer(model["w"], np.float32), model["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], bits: int = BITS,
          orders: tuple[int, ...] = ORDERS) -> DataFrame:
    """doc_id and score (0 to 1) of every row of ``docs`` (doc_id, text), whole texts.

    A null or empty text has no features but its two end marks, and scores by the bias.
    """
    weights, bias = model

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        present = np.zeros(1 << bits, np.float32)
        for batch in batches:
            scores = []
            for text in batch.column(1).to_pylist():
                x = features(text or "", bits, orders)
                present[x] = 1
                scores.append(float(present @ weights) + bias)
                present[x] = 0
            out = 1 / (1 + np.exp(-np.clip(np.array(scores, dtype=float), -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())],
                                             names=["doc_id", "score"])

    return bounded(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(
        judge, "doc_id bigint, score double")
