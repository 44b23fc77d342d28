"""Whitening of embeddings by a randomised range finder.

Entries become integers x. The fit list, each distinct x vector once, is written to the shared folder; its size, sums and trace come
from it exactly, as integers. A Gaussian test matrix of ``most`` + ``oversampling`` columns is multiplied by the covariance in passes
over all rows of the fit list, centred before multiplying; after each pass the basis is made orthonormal and Rayleigh-Ritz gives
components with their residuals. If after ``passes`` of these, or by what one pass gains, the residuals, also against the gaps between eigenvalues, aren't those of
double precision, the basis is expanded to the full dimension, which one more pass makes exact. A last pass measures the covariance of
the whitened fit list.

What a pass sends to the driver is one row per dimension and 64 columns; tasks' sums are added by Spark.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped; a null id stays; repeated rows have their
results each, but count once in the fit list; vectors of several lengths are fitted by length, each on its own (more than
``most_lengths`` lengths are an error); components without variance (constant dimensions, a single distinct vector, empty vectors)
give no rows; an entry beyond 2^53 after scaling is an error; ``deviation`` is a decimal and
exact, null beyond 38 digits; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from questlake.llm.common import importable, pieces, written

# Fixed values of the transformation of entries: x = floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Columns that one row of a pass's sums holds.
WIDE = 64
#: Greatest residual and loss of direction that pass for double precision, relative to the greatest eigenvalue.
RESIDUAL, DIRECTION = 1e-13, 1e-11
OUT = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"


@dataclass
class Model:
    """n distinct vectors, shifted sums by dimension (exact), components as columns, eigenvalues, trace of the covariance; passes: how many
    were needed, full: whether the basis had to be expanded."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float
    passes: int
    full: bool


def integers(vectors: pa.Array) -> tuple[np.ndarray, int]:
    """Shifted entries floor(64 c) of vectors of one length, one row each."""
    n = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = np.floor(SCALE * flat)
    if len(x) and np.abs(x).max() >= 2.0**53:
        raise ValueError("an entry is beyond 2^53")
    return x.astype(np.int64).reshape(n, -1), n


def packed(x: np.ndarray) -> list[bytes]:
    """Rows as bytes; equal rows have equal bytes, whatever batch they are in."""
    small = np.all((x >= -(1 << 15)) & (x < 1 << 15), axis=1)
    return [b"h" + r.astype("<i2").tobytes() if s else b"q" + r.astype("<i8").tobytes() for r, s in zip(x, small.tolist())]


def unpacked(rows: list[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(r, "<i2" if r[:1] == b"h" else "<i8", offset=1) for r in rows]).astype(np.int64)


def usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return df.select(F.col(id_col).cast("bigint").alias("vec_id"), v.alias("v")).where(v.isNotNull() & ~bad & (F.size(v) > 0))


def fit_list(rows: DataFrame) -> DataFrame:
    """Distinct vectors of one length, packed."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch):
                yield pa.RecordBatch.from_arrays([pa.array(packed(integers(part.column(0))[0]), pa.binary())], names=["x"])

    return written(rows.select("v").mapInArrow(keyed, "x binary").distinct(), "whitening-fit")


def exact_sums(distinct: DataFrame, d: int) -> tuple[int, list[int], list[int]]:
    """Rows, sums and sums of squares by dimension, as Python integers."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, a, b = 0, [0] * d, [0] * d
        for batch in batches:
            for part in pieces(batch):
                x = unpacked(part.column(0).to_pylist())
                if np.abs(x).max() < 1 << 20:
                    one, two = x.sum(0).tolist(), (x * x).sum(0).tolist()
                else:
                    big = x.astype(object)
                    one, two = big.sum(0).tolist(), (big * big).sum(0).tolist()
                n, a, b = n + len(x), [p + q for p, q in zip(a, one)], [p + q for p, q in zip(b, two)]
        if n:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_arrays([pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array(map(Decimal, a), kind), pa.array(map(Decimal, b), kind)], names=["i", "n", "a", "b"])

    got = distinct.mapInArrow(summed, "i int, n bigint, a decimal(38,0), b decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")).orderBy("i").collect()  # a row a dimension
    return (int(got[0].n), [int(r.a) for r in got], [int(r.b) for r in got]) if got else (0, [], [])


def covariance_times(distinct: DataFrame, n: int, mean: np.ndarray, right: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """left' C' C right / n over all centred rows C of the fit list (left: the identity)."""
    height, width = (len(mean) if left is None else left.shape[1]), right.shape[1]
    cols = [f"c{k}" for k in range(min(WIDE, width))]

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                c = unpacked(part.column(0).to_pylist()) - mean
                got = (c if left is None else c @ left).T @ (c @ right)
                total = got if total is None else total + got
        if total is not None:
            for at in range(0, width, WIDE):
                block = total[:, at : at + WIDE]
                block = np.pad(block, ((0, 0), (0, len(cols) - block.shape[1])))
                yield pa.RecordBatch.from_arrays([pa.array(range(height), pa.int32()), pa.array([at] * height, pa.int32()), *(pa.array(block[:, k]) for k in range(len(cols)))], names=["i", "at", *cols])

    sums = distinct.mapInArrow(product, "i int, at int, " + ", ".join(f"{c} double" for c in cols)).groupBy("i", "at").agg(*[F.sum(c).alias(c) for c in cols]).collect()
    out = np.zeros((height, -(-width // len(cols)) * len(cols)))
    for r in sums:
        out[r["i"], r["at"] : r["at"] + len(cols)] = [r[c] for c in cols]
    return out[:, :width] / n


def ritz(basis: np.ndarray, image: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, bool, float, float]:
    """Rayleigh-Ritz of a basis and its image under the covariance: values, vectors, whether they are true to double precision, and by what
    factor a pass lessens the greatest residual, estimated from the first value outside of the components, with that residual."""
    small = basis.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    k = min(most, len(values))
    vectors = basis @ turn[:, :k]
    rest = np.linalg.norm(image @ turn[:, :k] - vectors * values[:k], axis=0)
    top = max(values[0], np.finfo(float).tiny)
    others = np.r_[np.inf, values, 0.0 if len(values) == len(basis) else values[-1]]
    gaps = np.minimum(others[:k] - others[1 : k + 1], others[1 : k + 1] - others[2 : k + 2])
    true = bool(np.all(rest <= RESIDUAL * top) and np.all(rest <= DIRECTION * np.maximum(gaps, 0)))
    return values[:k], vectors, true, values[-1] / values[k - 1] if values[k - 1] > 0 else 0.0, float(rest.max()) / top


def fit(distinct: DataFrame, d: int, most: int = 16, oversampling: int = 10, passes: int = 6, seed: int = 13) -> Model | None:
    """None if no dimension varies."""
    n, sums, squares = exact_sums(distinct, d)
    spread = sum(n * b - a * a for a, b in zip(sums, squares))  # n^2 times the trace, exact
    if not spread:
        return None
    trace, mean = spread / n**2, np.array([a / n for a in sums])
    width = min(d, most + oversampling)
    basis, full = np.random.default_rng(seed).normal(size=(d, width)), width == d
    basis = np.eye(d) if full else np.linalg.qr(basis)[0]
    done = 0
    while True:
        image, done = covariance_times(distinct, n, mean, basis), done + 1
        values, vectors, true, factor, residual = ritz(basis, image, most)
        if true or full:
            break
        full = done >= passes or (done > 1 and residual * factor ** (passes - done) > RESIDUAL)  # no hope of the passes that are left
        basis = np.eye(d) if full else np.linalg.qr(image)[0]
    some = values > values[0] * d * np.finfo(float).eps
    values, vectors = values[some], vectors[:, some]
    whitening = vectors / np.sqrt(values)
    error = np.abs(covariance_times(distinct, n, mean, whitening, whitening) - np.eye(len(values))).max()
    return Model(n, sums, vectors, values, trace, float(error), done, full)


def project(rows: DataFrame, model: Model) -> DataFrame:
    """A row for each vector and component."""
    n, sums, k = model.n, model.sums, len(model.values)
    scaled, explained = model.components / np.sqrt(model.values), (model.values / model.trace).tolist()
    limit = (1 << 62) // max(n, 1) - max(map(abs, sums)) // max(n, 1) - 1

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1 << 20):
                x, m = integers(part.column(1))
                fits = int(np.abs(x).max()) < limit
                y = n * (x if fits else x.astype(object)) - np.array(sums, np.int64 if fits else object)
                exact = fits and x.shape[1] * int(np.abs(y).max()) ** 2 < 1 << 63
                y2 = y if exact else y.astype(object)
                deviation = pa.array([Decimal(int(v)) if v < 10**38 else None for v in (y2 * y2).sum(1)], pa.decimal128(38, 0))
                white = (y.astype(np.float64) / n) @ scaled
                at = pa.array(np.repeat(np.arange(m), k))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), deviation.take(at), pa.array(white.ravel()), pa.array(explained * m, pa.float64()), pa.array(np.full(m * k, model.identity_error))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(made, OUT)


def whitened(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 16, most_lengths: int = 64, **options) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error)."""
    spark = df.sparkSession
    importable(spark)
    rows = usable(df, id_col, vec_col)
    lengths = [r.d for r in rows.groupBy(F.size("v").alias("d")).count().orderBy("d").limit(most_lengths + 1).collect()]
    if len(lengths) > most_lengths:
        raise ValueError(f"vectors of more than {most_lengths} lengths")
    out = spark.createDataFrame([], OUT)
    for d in lengths:
        own = rows.where(F.size("v") == d)
        model = fit(fit_list(own), d, most, **options)
        if model is not None:
            got = project(own, model)
            out = got if len(lengths) == 1 else out.unionByName(got)
    return out
