"""Whitening of embeddings with an exact covariance from bit-sliced cross-products.

Each entry c becomes the integer x = floor(64 c) + 1000000.  A task takes its vectors in blocks, shifts each dimension by its
least value in the block and packs every bit plane of a dimension across the block's rows into 64-bit words.  The sum of the
products of two dimensions is then the sum over their pairs of planes of 2^(a+b) times the number of bits set in both: AND and
popcount, no multiplication of entries.  Shifts are undone by integer algebra, so all sums are exact whatever the blocks are.
A vector of unusual size adds planes to its own block only.

Tasks emit one row per pair of dimensions, with the sum cut into 32-bit limbs, which Spark adds up.  The driver receives
D (D + 1) / 2 rows for D dimensions, whatever the number of vectors, forms n * sum(x y) - S_x S_y in integers, divides once
and calls ``eigh``.  A second pass projects the rows.  The table is read twice and no row is shuffled.

``identity_error`` is the largest entry of W'VW - I for the covariance V and the whitening matrix W as used: the covariance of
the whitened rows, since they are linear in x.  Tests compare it with the covariance measured on the rows.

Defined cases: vectors that are null, empty or hold null or non-finite entries are left out, and so are those of another length than
most (ties: the longer); rows without an id and equal rows stay as rows of their own; an entry whose x is no 64-bit integer becomes
the nearest one; components whose eigenvalue is zero to double precision (constant or dependent dimensions, a single vector) are not returned, as
nothing can be divided by it; ``deviation`` is exact to 38 digits and null beyond; an empty table gives no rows; other columns of
the input are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifold.llm.work import bounded

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Entries of a block, so that its integers and planes stay small whatever the dimension.
BLOCK_ENTRIES = 1 << 19
#: Words of one AND at most.
STEP_WORDS = 1 << 19
LIMBS = 6
_LIMB = 32
_LONG = 1 << 63
#: Eigenvalues below this part of the largest, times the dimension, are rounding.
_NOTHING = 2.0**-50


def entries(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, doubles) of the usable vectors of a batch, one pair per length."""
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), 0), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    starts = np.cumsum(lengths) - lengths
    for length in np.unique(lengths[lengths > 0]).tolist():
        rows = np.flatnonzero(lengths == length)
        values = flat[starts[rows, None] + np.arange(length)]
        usable = np.isfinite(values).all(axis=1)
        yield rows[usable], values[usable]


def integers(values: np.ndarray) -> np.ndarray:
    """floor(64 c) as int64, ``SHIFT`` left out; what x cannot hold becomes the nearest x."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * SCALE)
    low, high = -_LONG + 1024, _LONG - 1024 - SHIFT
    if len(scaled) and (scaled.min() < low or scaled.max() > high):
        exact = [min(max(int(v), -_LONG - SHIFT), _LONG - 1 - SHIFT) if abs(v) < 2.0**80 else (
            -_LONG - SHIFT if v < 0 else _LONG - 1 - SHIFT) for v in scaled.reshape(-1)]
        return np.array(exact, object).reshape(scaled.shape)
    return scaled.astype(np.int64)


def planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, dimension and bit of each plane, least value per dimension); a row of ``words`` is a plane across all rows."""
    least = y.min(axis=0)
    raised = (y - least).astype(np.uint64)
    widths = [max(int(w).bit_length(), 1) for w in raised.max(axis=0)]
    size = -(-len(y) // 64)
    words = np.zeros((sum(widths), size), np.uint64)
    dims, bits, at = [], [], 0
    for d, width in enumerate(widths):
        column = np.zeros(size * 64, np.uint64)
        column[: len(y)] = raised[:, d]
        for b in range(width):
            words[at] = np.packbits(((column >> np.uint64(b)) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")
            dims.append(d)
            bits.append(b)
            at += 1
    return words, np.array(dims), np.array(bits), least


def scatter(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums per dimension, sums of products of dimensions i <= j) as exact integers."""
    words, dims, bits, least = planes(y)
    n_dims = y.shape[1]
    wide = 2 * int(bits.max()) + int(len(y)).bit_length() + 2 > 62
    kind = object if wide else np.int64
    weights = np.array([1 << int(b) for b in bits], kind)
    first = np.searchsorted(dims, np.arange(n_dims))
    ends = np.append(first[1:], len(dims))
    sums = np.add.reduceat(np.bitwise_count(words).sum(axis=1, dtype=np.int64).astype(kind) * weights, first)
    products = np.zeros((n_dims, n_dims), object)
    for i in range(n_dims):
        own = words[first[i] : ends[i]]
        step = max(1, STEP_WORDS // (own.size or 1))
        counts = [
            np.bitwise_count(own[:, None, :] & words[a : a + step][None, :, :]).sum(axis=2, dtype=np.int64)
            for a in range(first[i], len(words), step)
        ]
        joint = np.concatenate(counts, axis=1).astype(kind)
        joint = (joint * weights[first[i] : ends[i], None]).sum(axis=0) * weights[first[i] :]
        products[i, i:] = np.add.reduceat(joint, first[i:] - first[i])
    sums, least = sums.astype(object), least.astype(object)
    shifted = np.outer(least, sums)
    products = products + np.triu(shifted + shifted.T + len(y) * np.outer(least, least))
    return sums + len(y) * least, products


def _limbs(number: int) -> list[int]:
    mask = (1 << _LIMB) - 1
    return [(number >> (_LIMB * k)) & mask for k in range(LIMBS - 1)] + [number >> (_LIMB * (LIMBS - 1))]


@dataclass(frozen=True)
class Model:
    """``components`` has one unit eigenvector a column, ``values`` its eigenvalue."""

    n: int
    sums: tuple[int, ...]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float


def totals(vectors: DataFrame, column: str = "embedding") -> dict[int, tuple[int, list[int], dict[tuple[int, int], int]]]:
    """Per length of vectors: their number, the sums of floor(64 c) and the sums of products, all exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[np.ndarray]] = defaultdict(list)
        done: dict[int, list] = {}

        def close(length: int) -> None:
            y = np.concatenate(waiting.pop(length))
            for a in range(0, len(y), max(64, BLOCK_ENTRIES // length)):
                block = y[a : a + max(64, BLOCK_ENTRIES // length)]
                sums, products = scatter(block)
                old = done.get(length)
                done[length] = [len(block), sums, products] if old is None else [
                    old[0] + len(block), old[1] + sums, old[2] + products]

        for batch in batches:
            for _, values in entries(batch.column(0)):
                if len(values):
                    length = values.shape[1]
                    waiting[length].append(integers(values))
                    if sum(map(len, waiting[length])) * length >= BLOCK_ENTRIES:
                        close(length)
        for length in list(waiting):
            close(length)
        for length, (n, sums, products) in done.items():
            keys = [(-1, -1)] + [(-1, j) for j in range(length)]
            numbers = [n, *sums.tolist()]
            for i in range(length):
                keys += [(i, j) for j in range(i, length)]
                numbers += products[i, i:].tolist()
            limbs = np.array([_limbs(int(v)) for v in numbers], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(keys), length, np.int32)),
                    pa.array(np.array(keys, np.int32)[:, 0]),
                    pa.array(np.array(keys, np.int32)[:, 1]),
                    *[pa.array(limbs[:, k]) for k in range(LIMBS)],
                ],
                ["d", "i", "j", *names],
            )

    names = [f"l{k}" for k in range(LIMBS)]
    schema = "d int, i int, j int, " + ", ".join(f"{name} long" for name in names)
    parts = bounded(vectors).select(column).mapInArrow(run, schema)
    merged = parts.groupBy("d", "i", "j").agg(*[F.sum(name).alias(name) for name in names])
    count: dict[int, int] = {}
    sums: dict[int, dict[int, int]] = defaultdict(dict)
    products: dict[int, dict[tuple[int, int], int]] = defaultdict(dict)
    for row in merged.collect():
        number = sum(row[3 + k] << (_LIMB * k) for k in range(LIMBS))
        if row.j < 0:
            count[row.d] = number
        elif row.i < 0:
            sums[row.d][row.j] = number
        else:
            products[row.d][row.i, row.j] = number
    return {d: (n, [sums[d][j] for j in range(d)], products[d]) for d, n in count.items()}


def fit(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Model | None:
    """The model of the usable vectors; None where there are none."""
    found = totals(vectors, column)
    if not found:
        return None
    length = max(found, key=lambda d: (found[d][0], d))
    n, sums, products = found[length]
    covariance = np.zeros((length, length))
    for (i, j), total in products.items():
        covariance[i, j] = covariance[j, i] = (n * total - sums[i] * sums[j]) / (n * n)  # one rounding
    values, lines = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > max(values[-1], 0.0) * length * _NOTHING]
    values, lines = values[order], lines[:, order]
    trace = float(sum(n * products[i, i] - sums[i] * sums[i] for i in range(length)) / (n * n))
    matrix = lines.astype(np.longdouble) / np.sqrt(values.astype(np.longdouble))
    gap = matrix.T @ covariance.astype(np.longdouble) @ matrix - np.eye(len(values))
    error = float(np.abs(gap).max()) if len(values) else 0.0
    return Model(n, tuple(sums), lines, values, trace, error)


def deviations(y: np.ndarray, n: int, sums: tuple[int, ...]) -> list[Decimal | None]:
    """Per row the sum over dimensions of (n y - S)^2, exact; None beyond 38 digits."""
    if not len(y):
        return []
    most = max(abs(n * int(y.max())), abs(n * int(y.min()))) + max(abs(s) for s in sums)
    small = most < 1 << 62 and most * most * len(sums) < 1 << 62
    kind = np.int64 if small else object
    away = y.astype(kind) * n - np.array(sums, kind)
    return [Decimal(v) if v < 10**38 else None for v in (away * away).sum(axis=1).tolist()]


def whiten(vectors: DataFrame, model: Model | None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): one row per usable vector and component."""
    tail = (
        "component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    )
    schema = T.StructType([vectors.schema[key], *T._parse_datatype_string(tail).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = len(model.values)
        means = np.array([s / model.n for s in model.sums])
        project = model.components / np.sqrt(model.values)
        explained = model.values / model.trace
        for batch in batches:
            for rows, values in entries(batch.column(1)):
                if values.shape[1] != len(model.sums) or not len(rows):
                    continue
                y = integers(values)
                white = (y.astype(np.float64) - means) @ project
                away = pa.array(deviations(y, model.n, model.sums), pa.decimal128(38, 0))
                repeated = pa.array(np.repeat(np.arange(len(rows)), count))
                size = len(rows) * count
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(rows, count))),
                        pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(rows))),
                        pa.array(np.full(size, model.n, np.int64)),
                        away.take(repeated),
                        pa.array(white.reshape(-1)),
                        pa.array(np.tile(explained, len(rows))),
                        pa.array(np.full(size, model.identity_error)),
                    ],
                    schema.names,
                )

    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], schema)
    return bounded(vectors).select(key, column).mapInArrow(run, schema)
