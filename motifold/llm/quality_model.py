"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - threshold_k) with one weight vector for all grades and ordered thresholds.  ``x`` holds
hashed words of the text (those that several rated texts have) and the shares of a few word shapes.  A score
gives every tail probability and the expected grade, and selection takes the tail of a grade.

The model is fitted on at most ``SAMPLE`` rated documents, those with the smallest hash of their id: a documented
bound.  Their feature lists (``FEATURES`` numbers at most each) go to one task, which runs the gradient steps; the fitted
model is one vector of ``FEATURES`` numbers and is broadcast.  All documents are scored, in a map over rows.

Defined cases: a null or empty text has no features and gets the thresholds' own probabilities; without ratings every
document gets the top grade's tails as 0.5; ratings of absent documents and null ratings are left out, a document
rated twice counts twice; long texts are read whole; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifold.llm.tokens import Hasher, U, chunks, distinct, per_text, words
from motifold.llm.work import bounded

FEATURES = 1 << 18
SAMPLE = 20_000
#: A word counts if so many rated texts have it.
LEAST_TEXTS = 5
SHAPES = 16
_SHAPE_SCALE = 4.0


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    thresholds: np.ndarray


def _features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashed words of all texts, the number before each text, and shape shares per text."""
    starts, ends, before = words(data, offsets)
    # A word without the marks around it: the hash skips one trailing mark, which is what prose has.
    plain = np.zeros(256, bool)
    plain[[*b".,;:!?\"')("]] = True
    trimmed = ends.copy()
    for _ in range(3):
        more = (trimmed > starts + 1) & plain[data[trimmed - 1]] if len(data) else np.zeros(0, bool)
        trimmed = trimmed - more
    bucket = (Hasher(data, fold=True).spans(starts, trimmed) & U(FEATURES - 1)).astype(np.int64)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    present = distinct(text * FEATURES + bucket)
    n = np.maximum(np.diff(before), 1)

    def within(mask: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=sums[1:])
        return sums[ends] - sums[starts]

    upper = within((data >= 65) & (data <= 90))
    lower = within(((data >= 97) & (data <= 122)) | (data >= 128))
    marks = within(np.isin(data, np.frombuffer(b"#*$%&|<>@{}[]\\^~_=+", np.uint8)))
    digits = within((data >= 48) & (data <= 57))
    shape = np.minimum(upper, 2) + 3 * (lower == 0) + 6 * (marks > 0)
    shares = np.zeros((len(offsets) - 1, SHAPES))
    for s in range(12):
        shares[:, s] = per_text((shape == s).astype(np.int64), before) / n
    shares[:, 12] = per_text((digits > 0).astype(np.int64), before) / n
    count = np.searchsorted(present, np.arange(len(offsets)) * FEATURES)
    shares[:, 13] = np.diff(count) / n
    shares[:, 14] = np.diff(before) < 20
    return present & FEATURES - 1, count, shares * _SHAPE_SCALE


def _rated_features(rated: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                index, count, shares = _features(data, offsets)
                lists = pa.ListArray.from_arrays(pa.array(count.astype(np.int32)), pa.array(index.astype(np.int32)))
                shapes = [row.tobytes() for row in shares]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, end - first), lists, pa.array(shapes, pa.binary())],
                    ["grade", "words", "shapes"],
                )

    return bounded(rated).select("grade", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, "grade int, words array<int>, shapes binary"
    )


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_arrays(
    grade: np.ndarray, index: np.ndarray, before: np.ndarray, shares: np.ndarray, levels: int, rounds: int = 150
) -> Model:
    """Adaptive-step gradient descent on the cumulative-link likelihood."""
    index = index.astype(np.int64)
    texts = np.bincount(index, minlength=FEATURES)
    kept = texts[index] >= LEAST_TEXTS
    before = np.concatenate([[0], np.cumsum(kept)])[before]
    index = index[kept]
    row = np.repeat(np.arange(len(grade)), np.diff(before))
    weights = np.zeros(FEATURES + SHAPES)
    reached = (grade[:, None] >= np.arange(1, levels)[None, :]).astype(float)
    share = np.clip(reached.mean(axis=0), 0.01, 0.99)
    thresholds = -np.log(share / (1 - share))
    square_w, square_t = np.full(len(weights), 1e-6), np.full(len(thresholds), 1e-6)
    active = np.flatnonzero(np.bincount(index, minlength=FEATURES))
    for _ in range(rounds):
        z = per_text(weights[index], before) + shares @ weights[FEATURES:]
        # The cumulative-link likelihood's slope: of P(grade = k) = tail_k - tail_(k+1).
        tails = _sigmoid(z[:, None] - thresholds[None, :])
        full = np.column_stack([np.ones(len(z)), tails, np.zeros(len(z))])
        at = np.arange(len(z))
        chance = np.maximum(full[at, grade] - full[at, grade + 1], 1e-9)
        slope = full * (1 - full)
        dz = (slope[at, grade] - slope[at, grade + 1]) / chance
        dt = np.zeros_like(full)
        dt[at, grade] -= slope[at, grade] / chance
        dt[at, grade + 1] += slope[at, grade + 1] / chance
        g = np.zeros(len(weights))
        g[:FEATURES] = np.bincount(index, weights=dz[row], minlength=FEATURES)
        g[FEATURES:] = shares.T @ dz
        g[active] -= 2.0 * weights[active]
        g[FEATURES:] -= 0.1 * weights[FEATURES:]
        gt = dt[:, 1:-1].sum(axis=0)
        square_w += g * g
        square_t += gt * gt
        weights += 0.3 * g / np.sqrt(square_w)
        thresholds = np.maximum.accumulate(thresholds + 0.3 * gt / np.sqrt(square_t))
    return Model(weights, thresholds)


def fit(docs: DataFrame, ratings: DataFrame, levels: int = 3, sample: int = SAMPLE) -> Model:
    """From ``ratings`` (doc_id, grade), of which ``sample`` are used at most.

    Ratings without a grade, or with one that is not in 0 to levels - 1, are left out.
    """
    graded = ratings.where(F.col("grade").isin(list(range(levels))))
    narrow = graded.select("doc_id", F.col("grade").cast("int").alias("grade"))
    chosen = narrow.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    # At most ``sample`` pairs of numbers.
    rated = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if len(batch)]
        if not held:
            return
        table = pa.Table.from_batches(held)
        lists = table["words"].combine_chunks()
        before = np.asarray(lists.offsets, np.int64)
        shares = np.frombuffer(b"".join(table["shapes"].to_pylist())).reshape(-1, SHAPES)
        grade = np.asarray(table["grade"], np.int64)
        index = np.asarray(lists.values)[before[0] : before[-1]]
        model = fit_arrays(grade, index, before - before[0], shares, levels)
        yield pa.RecordBatch.from_arrays(
            [pa.array([model.weights.astype(np.float32).tobytes()]), pa.array([model.thresholds.tolist()])],
            ["weights", "thresholds"],
        )

    features = _rated_features(rated).repartition(1)
    fitted = features.mapInArrow(run, "weights binary, thresholds array<double>").first()
    if fitted is None:
        return Model(np.zeros(FEATURES + SHAPES, np.float32), np.zeros(levels - 1))
    return Model(np.frombuffer(fitted["weights"], np.float32), np.array(fitted["thresholds"]))


def score(docs: DataFrame, model: Model, key: str = "doc_id") -> DataFrame:
    """(key, expected_grade, tails): tails[k - 1] is P(grade >= k)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, thresholds = shared.value.weights, shared.value.thresholds
        for batch in batches:
            tails = np.empty((len(batch), len(thresholds)))
            for first, end, data, offsets in chunks(batch.column(1)):
                index, count, shares = _features(data, offsets)
                z = per_text(weights[index].astype(float), count) + shares @ weights[FEATURES:]
                tails[first:end] = _sigmoid(z[:, None] - thresholds[None, :])
            lists = pa.ListArray.from_arrays(
                pa.array(np.arange(len(batch) + 1, dtype=np.int32) * len(thresholds)), pa.array(tails.reshape(-1))
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tails.sum(axis=1)), lists], [key, "expected_grade", "tails"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return bounded(docs).select(key, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, f"`{key}` {kind}, expected_grade double, tails array<double>"
    )
