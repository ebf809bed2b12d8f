"""Whitening of vectors from an exact scatter matrix, counted on bit planes.

Entries are turned into integers.  Each dimension is shifted by its least value
over the fit list, so that its values are short and not negative, and its bit
planes are packed across rows: one bit a row, 64 rows a word.  The product sum of
two dimensions is then the sum, over pairs of planes, of 2 to the planes' weights
times the number of set bits in the AND of their words.  Tasks add these sums as
integers, Spark adds the tasks' sums, and the scatter is centred as integers
(n * sum(xy) - sum(x) * sum(y)) before its one division, so V is exact up to the
rounding of that division.  Only then come doubles: the eigenvectors of V.

The fit list holds each distinct integer vector once, so copies weigh nothing;
copies are combined before the shuffle.

Defined cases: rows whose vector is null or holds null or non-finite entries take
no part; shorter vectors count as padded with zero entries; entries beyond
2 ** 52 / 64 end there; a deviation beyond 64 bits ends at the largest long;
repeated rows, and rows without an id, are rows of their own; components whose
eigenvalue is zero (up to rounding) have no scale and are left out, so fewer than
two distinct vectors, or an empty table, give an empty result.  Eigenvectors are
those of a double-precision solver: an eigenvalue a factor of 1e11 below the
largest keeps about four digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casebook.llm.common import stored

SCALE = 64
SHIFT = 1_000_000
LIMIT = 2.0**52  # of a scaled entry
COMPONENTS = 16
WORD_ROWS = 64
CHUNK_ROWS = 16_384  # rows whose planes are packed at once
LIMB = 60  # sums leave a task as high * 2 ** LIMB + low
LARGEST = 2**63 - 1

LIMITS = "dim int, n long, least long, most long, high decimal(38,0), low decimal(38,0)"
SUMS = "i int, j int, high decimal(38,0), low decimal(38,0)"
MOMENTS = "i int, j int, value double"
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


# --- integer vectors ------------------------------------------------------------------
def _sound() -> Column:
    return F.coalesce(
        F.col("embedding").isNotNull() & F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def integers(embeddings: DataFrame) -> DataFrame:
    """(vec_id, x) of the rows that take part."""
    entry = lambda c: F.floor(F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), c.cast("double") * SCALE))).cast("long") + SHIFT
    return embeddings.where(_sound()).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", entry).alias("x"))


def padded(vectors: DataFrame) -> tuple[DataFrame, int]:
    """`vectors` with all x of the greatest length, and that length."""
    width = vectors.agg(F.max(F.size("x"))).first()[0] or 0
    missing = F.array_repeat(F.lit(SHIFT).cast("long"), F.lit(width) - F.size("x"))
    return vectors.withColumn("x", F.when(F.size("x") < width, F.concat("x", missing)).otherwise(F.col("x"))), width


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, width)


# --- the scatter ----------------------------------------------------------------------
def _limbs(values: list[int]) -> list[pa.Array]:
    """High and low parts of whole numbers of any size, as decimals."""
    number = pa.decimal128(38, 0)
    return [pa.array([v >> LIMB for v in values], pa.int64()).cast(number), pa.array([v & (2**LIMB - 1) for v in values], pa.int64()).cast(number)]


def _limits(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Rows, least, greatest and summed values of each dimension in this task."""
    n, least, most, total = 0, None, None, [0] * width
    for batch in batches:
        x = _matrix(batch.column("x"), width)
        if not len(x):
            continue
        n += len(x)
        low, high = x.min(axis=0), x.max(axis=0)
        least, most = (low, high) if least is None else (np.minimum(least, low), np.maximum(most, high))
        # Halves of 32 bits cannot overflow within a batch.
        total = [t + (int(h) << 32) + int(s) for t, h, s in zip(total, (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
    if n:
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(least), pa.array(most), *_limbs(total)],
            names=["dim", "n", "least", "most", "high", "low"])


@dataclass
class Shape:
    """Of the fit list: rows, each dimension's sum, least value and number of bit planes."""

    n: int
    sums: list[int]
    least: np.ndarray
    bits: list[int]


def shape_of(fit: DataFrame, width: int) -> Shape:
    rows = fit.mapInArrow(partial(_limits, width=width), LIMITS).groupBy("dim").agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    found = sorted(rows.collect(), key=lambda r: r["dim"])  # a row per dimension
    return Shape(
        found[0]["n"] if found else 0, [(int(r["high"]) << LIMB) + int(r["low"]) for r in found],
        np.array([r["least"] for r in found], np.int64), [int(r["most"] - r["least"]).bit_length() for r in found])


def bit_planes(y: np.ndarray, bits: list[int]) -> np.ndarray:
    """(plane, word): planes of the dimensions one after another, lowest bit first, 64 rows a word."""
    words = -(-len(y) // WORD_ROWS)
    packed = np.zeros((sum(bits), words * WORD_ROWS // 8), np.uint8)
    at = 0
    for d, count in enumerate(bits):
        column = np.ascontiguousarray(y[:, d])
        for b in range(count):
            row = np.packbits((column >> b & 1).astype(bool))
            packed[at, : len(row)] = row
            at += 1
    return packed.view(np.uint64)


def shared_bits(planes: np.ndarray) -> np.ndarray:
    """Set bits common to each pair of planes (upper triangle)."""
    counts = np.zeros((len(planes), len(planes)), np.int64)
    for p in range(len(planes)):
        counts[p, p:] = np.bitwise_count(planes[p] & planes[p:]).sum(axis=1, dtype=np.int64)
    return counts


def weighted(counts: np.ndarray, bits: list[int]) -> list[list[int]]:
    """Product sums of each pair of dimensions from the counts of their planes' common bits."""
    starts = np.concatenate(([0], np.cumsum(bits))).tolist()
    full = counts + np.triu(counts, 1).T
    products = []
    for i, wide in enumerate(bits):
        row = []
        for j in range(i, len(bits)):
            block = full[starts[i] : starts[i + 1], starts[j] : starts[j + 1]].tolist()
            row.append(sum(c << a + b for a in range(wide) for b, c in enumerate(block[a]) if c))
        products.append(row)
    return products


def _products(batches: Iterator[pa.RecordBatch], least: np.ndarray, bits: list[int]) -> Iterator[pa.RecordBatch]:
    """Product sums of the shifted dimensions over this task's rows."""
    counts, width = np.zeros((sum(bits), sum(bits)), np.int64), len(bits)
    for batch in batches:
        y = _matrix(batch.column("x"), width) - least
        for at in range(0, len(y), CHUNK_ROWS):
            counts += shared_bits(bit_planes(y[at : at + CHUNK_ROWS], bits))
    if not counts.any():
        return
    for i, row in enumerate(weighted(counts, bits)):
        yield pa.RecordBatch.from_arrays(
            [pa.array([i] * len(row), pa.int32()), pa.array(range(i, width), pa.int32()), *_limbs(row)], names=["i", "j", "high", "low"])


def covariance(fit: DataFrame, shape: Shape) -> np.ndarray:
    """V over the fit list: exact sums, centred as integers, divided once."""
    width, n = len(shape.bits), shape.n
    sums = fit.mapInArrow(partial(_products, least=shape.least, bits=shape.bits), SUMS).groupBy("i", "j").agg(
        F.sum("high").alias("high"), F.sum("low").alias("low"))
    shifted = [s - n * int(m) for s, m in zip(shape.sums, shape.least, strict=True)]
    products = {(r["i"], r["j"]): (int(r["high"]) << LIMB) + int(r["low"]) for r in sums.collect()}  # a row per pair of dimensions
    v = np.zeros((width, width))
    for i in range(width):
        for j in range(i, width):
            v[i, j] = v[j, i] = (n * products.get((i, j), 0) - shifted[i] * shifted[j]) / (n * n)
    return v


# --- components -----------------------------------------------------------------------
@dataclass
class Whitener:
    n: int
    sums: list[int]
    scaled: np.ndarray  # (dimension, component): unit eigenvectors over the root of their eigenvalue
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(x - S/n as doubles from whole numerators, deviation)."""
        top = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        if top * top * max(1, x.shape[1]) <= LARGEST:
            gaps = self.n * x - np.array(self.sums, np.int64)
            return gaps / self.n, (gaps * gaps).sum(axis=1)
        gaps = x.astype(object) * self.n - np.array(self.sums, object)
        if top <= 2**53 * self.n:  # the differences themselves fit a double's digits after division
            near = (gaps / self.n).astype(float)
        else:
            near = np.array([[g / self.n for g in row] for row in gaps], float).reshape(x.shape)
        return near, np.array([min(LARGEST, sum(g * g for g in row)) for row in gaps], np.int64)

    def whitened(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near, deviation = self.centred(x)
        return near @ self.scaled, deviation


def whitener(shape: Shape, v: np.ndarray, components: int = COMPONENTS) -> Whitener:
    values, vectors = np.linalg.eigh(v)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    real = values > max(values.max(initial=0.0), 0.0) * len(values) * np.finfo(float).eps
    kept = min(components, int(real.sum()))
    trace = float(np.trace(v))
    return Whitener(shape.n, shape.sums, vectors[:, :kept] / np.sqrt(values[:kept]), values[:kept] / trace if trace else values[:kept])


def _moments(batches: Iterator[pa.RecordBatch], model: Whitener, width: int) -> Iterator[pa.RecordBatch]:
    """Sums of whitened values (j = -1) and of their products in this task."""
    k = model.scaled.shape[1]
    total, products = np.zeros(k), np.zeros((k, k))
    for batch in batches:
        z, _ = model.whitened(_matrix(batch.column("x"), width))
        total += z.sum(axis=0)
        products += z.T @ z
    i, j = np.triu_indices(k)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((np.arange(k), i)), pa.int32()), pa.array(np.concatenate((np.full(k, -1), j)), pa.int32()),
         pa.array(np.concatenate((total, products[i, j])))], names=["i", "j", "value"])


def identity_error(fit: DataFrame, model: Whitener, width: int) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    sums = fit.mapInArrow(partial(_moments, model=model, width=width), MOMENTS).groupBy("i", "j").agg(F.sum("value").alias("value"))
    found = {(r["i"], r["j"]): r["value"] / model.n for r in sums.collect()}  # at most COMPONENTS squared
    return max(
        (abs(v - found[i, -1] * found[j, -1] - (i == j)) for (i, j), v in found.items() if j >= 0), default=0.0)


def _whiten(batches: Iterator[pa.RecordBatch], model: Whitener, width: int, error: float) -> Iterator[pa.RecordBatch]:
    k = model.scaled.shape[1]
    for batch in batches:
        z, deviation = model.whitened(_matrix(batch.column("x"), width))
        rows = len(z)
        ids = batch.column("vec_id").take(pa.array(np.repeat(np.arange(rows), k)))
        yield pa.RecordBatch.from_arrays(
            [ids, pa.array(np.tile(np.arange(1, k + 1), rows), pa.int32()), pa.array(np.full(rows * k, model.n, np.int64)),
             pa.array(np.repeat(deviation, k)), pa.array(z.ravel()), pa.array(np.tile(model.explained, rows)), pa.array(np.full(rows * k, error))],
            names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """A row per vector that takes part and component: its whitened value, with the figures of the fit."""
    spark = embeddings.sparkSession
    vectors, width = padded(integers(embeddings))
    fit = stored(vectors.select("x").distinct(), "whiten-fit")
    shape = shape_of(fit, width) if width else Shape(0, [], np.zeros(0, np.int64), [])
    if not shape.n or not any(shape.bits):  # nothing varies
        return spark.createDataFrame([], OUT)
    model = whitener(shape, covariance(fit, shape), components)
    return vectors.mapInArrow(partial(_whiten, model=model, width=width, error=identity_error(fit, model, width)), OUT)
